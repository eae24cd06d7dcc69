"""Queries of the sources: payloads and pages, written from the tables and read back.

Bodies are built per order (a handful of line items each), so the work grows with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from playbill.catalog import sql
from playbill.catalog.bindings import Data
from playbill.catalog.registry import Registry
from playbill.functions import text as tx, values as vl
from playbill.operators import lifecycle as lc
from playbill.plans import nightly as ny
from playbill.schema import SHOWING_RECORD, conform, ensure_columns
from playbill.session import checkpoint_root, materialise
from playbill.sources import adapters as ad, markup as mk, pages as pg, payloads as pl, tables as tb

registry = Registry()
query = registry.query

_DAY = "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)"
_LINES = f"lines AS (SELECT l_orderkey AS o, 'Film ' || l_partkey || 'x' AS title, {_DAY} AS date, {sql.CLOCK} AS time, l_returnflag AS language, l_linestatus AS screen, l_partkey, l_suppkey, l_tax FROM lineitem)"


def _lines(d: Data) -> DataFrame:
    clock = F.concat_ws(":", F.lpad((F.col("l_linenumber") + 14).cast("string"), 2, "0"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0"))
    return d.table("lineitem").select(
        F.col("l_orderkey").alias("o"), F.concat(F.lit("Film "), "l_partkey", F.lit("x")).alias("title"), F.to_date("l_shipdate").cast("string").alias("date"), clock.alias("time"),
        F.col("l_returnflag").alias("language"), F.col("l_linestatus").alias("screen"), "l_partkey", "l_suppkey", "l_tax",
    )


def _bodies(lines: DataFrame, item: Column, body) -> DataFrame:
    """One payload per order from the items of its lines."""
    grouped = lines.groupBy("o").agg(F.sort_array(F.collect_list(item)).alias("items"), F.min("date").alias("target_date"))
    return grouped.select(
        F.col("o").alias("landed_seq"), F.lit("shop").alias("source_slug"), F.concat(F.lit("https://h.org/o/"), "o").alias("url"), F.lit("1998-01-01").cast("date").alias("run_date"),
        "target_date", body(F.col("items")).alias("body"),
    )


def _session_payloads(d: Data, title: Column | None = None) -> DataFrame:
    # Only what differs between lines is grouped, in the order of the fields of a film.
    start = F.concat("date", F.lit("T"), "time", F.lit(":00+02:00"))
    item = F.struct("title", F.concat(F.lit("/film/"), "l_partkey").alias("url"), F.concat("date", F.lit("T00:00:00")).alias("day"), start.alias("start"), "screen", "language")

    def film(i: Column) -> Column:
        attributes = F.array(F.struct(F.lit("3D").alias("name"), F.lit("Format").alias("attributeType")), F.struct(i["language"].alias("name"), F.lit("Language").alias("attributeType")))
        session = F.struct(i["start"].alias("startTime"), i["screen"].alias("screenName"), attributes.alias("attributes"))
        group = F.struct(i["day"].alias("date"), F.array(session).alias("sessions"))
        return F.struct(
            i["title"].alias("filmTitle"), i["url"].alias("filmUrl"), F.lit("/p.jpg").alias("posterImageSrc"), F.lit(95).alias("runningTime"),
            F.array(F.struct(F.lit("g").alias("name"))).alias("genres"), F.array(group).alias("showingGroups"),
        )

    lines = _lines(d) if title is None else _lines(d).withColumn("title", title)
    return _bodies(lines, item, lambda items: F.to_json(F.struct(F.transform(items, film).alias("result"))))


def _flat(films: DataFrame, showings: DataFrame) -> DataFrame:
    """Showings with the title of their film, lists as text."""
    named = films.select("source_slug", F.col("seq").alias("film_seq"), "title", "source_poster", "duration")
    text = {c: F.array_join(c, ",") for c in ("times", "session_attributes")}
    return showings.join(named, ["source_slug", "film_seq"]).withColumns(text)


@query("session_api", f"""WITH {_LINES} SELECT title, date, time AS times, screen, language, '3D,' || language AS session_attributes, 'https://h.org/film/' || l_partkey AS source_url,
 'https://h.org/p.jpg' AS source_poster, '95 min' AS duration FROM lines""")
def _(d: Data) -> DataFrame:
    flat = _flat(*pl.flatten_session_api(_session_payloads(d), "https://h.org", "https://h.org/c"))
    return flat.select("title", "date", "times", "screen", "language", "session_attributes", "source_url", "source_poster", "duration")


@query("accumulated_films", f"WITH {_LINES} SELECT title, count(*) AS showings FROM lines GROUP BY title")
def _(d: Data) -> DataFrame:
    films, showings, _ = ad.session_api(_session_payloads(d), "Shop", "shop", "https://h.org", "https://h.org/c")
    return _flat(films, showings).groupBy("title").agg(F.count("*").alias("showings"))


@query("programming_api", f"""WITH {_LINES}, t AS (SELECT o, min(date) AS target FROM lines GROUP BY o)
 SELECT title, target AS date, CASE WHEN l_tax < 0.04 OR date = target THEN time ELSE '' END AS times, screen, language, '3D' AS session_attributes FROM lines JOIN t USING (o) WHERE l_suppkey <> 7""")
def _(d: Data) -> DataFrame:
    performance = F.struct(F.col("time").alias("actual_start_at"), F.when(F.col("l_tax") >= 0.04, F.col("date")).alias("day"))
    variant = F.struct(F.struct(F.col("language").alias("name")).alias("language"), F.struct(F.col("screen").alias("name")).alias("screen"), F.array(performance).alias("performances"))
    film = F.struct("title", F.lit("x").alias("slug"), (F.col("l_suppkey") == 7).alias("not_today"), F.array(F.struct(F.array(variant).alias("3D"))).alias("screens"))
    payloads = _bodies(_lines(d), film, lambda items: F.to_json(F.struct(items.alias("data"))))
    return _flat(*pl.flatten_programming_api(payloads, "https://h.org")).select("title", "date", "times", "screen", "language", "session_attributes")


def _block() -> Column:
    """Ten suppliers to a body: bodies stay small however many there are."""
    return F.floor(F.col("s_suppkey") / 10)


def _venues(d: Data) -> DataFrame:
    venue = F.struct(F.col("s_suppkey").alias("cinemaId"), F.col("s_name").alias("cinemaName"), F.lit("/x").alias("whatsOnUrl"))
    grouped = d.table("supplier").groupBy(_block().alias("block")).agg(F.collect_list(venue).alias("cinemas"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("A").alias("letter"), "cinemas")).alias("deep")).alias("result")))
    return grouped.select(F.lit("api").alias("source_slug"), F.col("block").cast("string").alias("url"), body.alias("body"))


@query("find_nodes", "SELECT CAST(s_suppkey // 10 AS VARCHAR) AS url, s_suppkey AS id FROM supplier")
def _(d: Data) -> DataFrame:
    return pl.find_nodes_with_key(_venues(d), "cinemaId").select("url", F.get_json_object("node", "$.cinemaId").cast("bigint").alias("id"))


@query("resolve_venues", "SELECT s_name AS source_slug, CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE -1 END AS venue_id FROM supplier")
def _(d: Data) -> DataFrame:
    name = F.when(F.col("s_acctbal") > 0, F.concat(F.lit("The "), "s_name")).otherwise("Unlisted")
    sources = d.table("supplier").select(F.col("s_name").alias("source_slug"), name.alias("name"), F.lit("https://h.org/cinema/nowhere/x").alias("cinema_url"), F.lit(-1).cast("bigint").alias("venue_id"))
    return pl.resolve_venues(sources, pl.find_nodes_with_key(_venues(d), "cinemaId")).select("source_slug", "venue_id")


# ---- pages ----------------------------------------------------------------------------

_SCREENINGS = f"WITH {_LINES} SELECT o, title, date, string_agg(DISTINCT time, ',' ORDER BY time) AS times, '95 min' AS duration, 'https://h.org/f/' || l_partkey AS source_url FROM lines GROUP BY o, title, l_partkey, date"


def _jsonld_pages(d: Data) -> DataFrame:
    link = F.concat(F.lit("/f/"), "l_partkey")
    # Only what differs between lines is grouped, in the order of the fields of a film and its screening.
    item = F.struct(link.alias("link"), "title", F.concat("date", F.lit("T"), "time", F.lit(":00+01:00")).alias("start"))

    def movie(i: Column) -> Column:
        return F.struct(F.lit("Movie").alias("@type"), i["link"].alias("@id"), i["title"].alias("name"), F.lit("PT1H35M").alias("duration"))

    def event(i: Column) -> Column:
        return F.struct(F.lit("ScreeningEvent").alias("@type"), i["start"].alias("startDate"), F.struct(i["link"].alias("@id")).alias("workPresented"))

    def body(items: Column) -> Column:
        graph = F.concat(F.transform(items, lambda i: F.to_json(movie(i))), F.transform(items, lambda i: F.to_json(event(i))))
        return F.concat(F.lit('<html><head><script type="application/ld+json">{"@graph":['), F.array_join(graph, ","), F.lit("]}</script></head><body><p>x</body></html>"))

    return _bodies(_lines(d), item, body)


def _microdata_pages(d: Data) -> DataFrame:
    item = F.struct("title", "date", "time", F.concat(F.lit("/f/"), "l_partkey").alias("link"))

    def one(i: Column) -> Column:
        return F.concat(
            F.lit('<div itemscope itemtype="https://schema.org/Movie"><h2 itemprop="name">'), i["title"], F.lit('</h2><meta itemprop="url" content="'), i["link"],
            F.lit('"><meta itemprop="duration" content="PT95M"><div itemscope itemtype="https://schema.org/ScreeningEvent"><time itemprop="startDate" datetime="'), i["date"], F.lit("T"), i["time"],
            F.lit('">soon</time></div></div>'),
        )

    return _bodies(_lines(d), item, lambda items: F.concat(F.lit("<ul><li>menu<li>more</ul>"), F.array_join(F.transform(items, one), "")))


def _screenings(pages: DataFrame) -> DataFrame:
    landed = materialise(pages)  # pages are landed before they are read
    films, showings = pg.build_entities(pg.extract_screenings(landed))
    flat = _flat(films, showings)
    # The high bits of an order number are the landing number of the page.
    order = F.floor(F.col("film_seq") / F.lit(2**56).cast("decimal(20,0)")).cast("bigint")
    return flat.select(order.alias("o"), "title", "date", "times", "duration", "source_url")


@query("jsonld_screenings", _SCREENINGS)
def _(d: Data) -> DataFrame:
    return _screenings(_jsonld_pages(d))


@query("microdata_screenings", _SCREENINGS)
def _(d: Data) -> DataFrame:
    return _screenings(_microdata_pages(d))


@query("single_page_source", f"WITH {_LINES} SELECT date, count(DISTINCT o || title) AS showings FROM lines WHERE date IN ('1998-03-02', '1998-03-03') GROUP BY date")
def _(d: Data) -> DataFrame:
    pages = materialise(_jsonld_pages(d))  # pages are landed before they are read
    _, showings, _ = ad.single_page(pages, "Shop", "shop", ["1998-03-02", "1998-03-03"])
    return showings.groupBy("date").agg(F.count("*").alias("showings"))


def _push_pages(d: Data, chunk: int | None = None) -> DataFrame:
    """A page of pushed films for each order, in one script or cut into scripts of so many characters."""
    show = F.struct(F.date_format(F.col("date").cast("date"), "yyyyMMdd").alias("date"), F.col("time").alias("orario"), F.when(F.col("l_suppkey") == 7, "noprog").alias("opzioni"))
    details = F.struct(F.lit("(Rossi)").alias("regia"), F.lit("a, b").alias("genere"))
    title = F.when(F.col("screen") == "F", F.concat("title", F.lit(" dal vivo"))).otherwise(F.col("title"))
    entry = F.struct(
        F.col("l_partkey").alias("id"), title.alias("title"), F.col("l_partkey").cast("string").alias("slug"), F.concat(F.lit("https://h.org/films/"), "l_partkey", F.lit("-"), "screen").alias("permalink"),
        F.lit("Text").alias("content"), details.alias("details"), F.array(show).alias("shows"),
    )

    def body(items: Column) -> Column:
        return F.concat(F.lit('<script>self.__next_f.push([1,"'), F.replace(F.to_json(items), F.lit('"'), F.lit('\\"')), F.lit('"])</script>'))

    def cut(items: Column) -> Column:
        text = F.to_json(items)
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / chunk)), lambda k: F.to_json(F.array(F.substr(text, (k * chunk + 1).cast("int"), F.lit(chunk)))))
        return F.array_join(F.transform(pieces, lambda p: F.concat(F.lit("<script>self.__next_f.push([1,"), F.substr(p, F.lit(2), F.length(p) - 2), F.lit("])</script>"))), "")

    return _bodies(_lines(d), entry, cut if chunk else body)


@query("pushed_chunks", f"""WITH {_LINES} SELECT 'https://h.org/o/' || o AS page_id, 'https://h.org/films/' || l_partkey || '-' || screen AS permalink, count(DISTINCT date || time) AS shows FROM lines GROUP BY ALL""")
def _(d: Data) -> DataFrame:
    """Films that the end of a script cuts in two, wherever it falls."""
    entries, shows = pg.extract_push_payload(_push_pages(d, 97))
    return entries.select("page_id", "permalink").join(shows, ["page_id", "permalink"]).groupBy("page_id", "permalink").agg(F.count("*").alias("shows"))


@query("push_entries", f"""WITH {_LINES} SELECT DISTINCT 'https://h.org/o/' || o AS page_id, 'https://h.org/films/' || l_partkey || '-' || screen AS permalink, '(Rossi)' AS regia, 'Text' AS content FROM lines WHERE screen <> 'F'""")
def _(d: Data) -> DataFrame:
    entries, _ = pg.extract_push_payload(_push_pages(d))
    return pg.drop_event_stubs(entries).select("page_id", "permalink", F.col("details.regia").alias("regia"), "content")


@query("push_shows", f"""WITH {_LINES} SELECT 'https://h.org/o/' || o AS page_id, 'https://h.org/films/' || l_partkey || '-' || screen AS permalink, date, string_agg(DISTINCT time, ',' ORDER BY time) AS times
 FROM lines WHERE l_suppkey <> 7 AND date IN ('1998-03-02', '1998-03-03', '1998-03-04') GROUP BY ALL""")
def _(d: Data) -> DataFrame:
    _, shows = pg.extract_push_payload(_push_pages(d))
    kept = pg.filter_shows(shows, ["1998-03-02", "1998-03-03", "1998-03-04"], "page_id", "permalink")
    return kept.select("page_id", "permalink", "date", F.array_join("times", ",").alias("times"))


@query("reconciled_times", f"""WITH {_LINES}, l AS (SELECT l_partkey, date, string_agg(DISTINCT time, ',' ORDER BY time) AS t FROM lines WHERE screen = 'O' GROUP BY ALL),
 x AS (SELECT l_partkey, date, string_agg(DISTINCT time, ',' ORDER BY time) AS t FROM lines WHERE language <> 'N' AND l_suppkey > 3 GROUP BY ALL),
 h AS (SELECT DISTINCT l_partkey FROM l JOIN x USING (l_partkey, date))
 SELECT l.l_partkey, l.date, CASE WHEN h.l_partkey IS NULL THEN l.t ELSE x.t END AS times FROM l LEFT JOIN x USING (l_partkey, date) LEFT JOIN h ON h.l_partkey = l.l_partkey
 WHERE h.l_partkey IS NULL OR x.t IS NOT NULL""")
def _(d: Data) -> DataFrame:
    def slots(rows: DataFrame) -> DataFrame:
        return rows.groupBy("l_partkey", "date").agg(F.array_sort(F.collect_set("time")).alias("times"))

    lines = _lines(d)
    done = pg.reconcile_two_sources(slots(lines.filter("screen = 'O'")), slots(lines.filter("language <> 'N' and l_suppkey > 3")), "l_partkey")
    return done.select("l_partkey", "date", F.array_join("times", ",").alias("times"))


def _cards(d: Data, box: str, item: str, link: str) -> DataFrame:
    rows = d.table("supplier").select(_block().alias("block"), F.struct("s_suppkey", "s_name").alias("s"))
    grouped = rows.groupBy("block").agg(F.array_sort(F.collect_list("s")).alias("items"))
    one = lambda i: F.concat(
        F.lit(f'<li class="{item}"><a href="{link}'), i["s_suppkey"].cast("string"), F.lit('/"><img src="https://h.org/_next/image?url=https%3A%2F%2Fi%2F'), i["s_suppkey"].cast("string"),
        F.lit('.jpg&w=1"></a><h2>'), i["s_name"], F.lit("</h2><p>by A &amp; B</p><span class='showtime'>20:30</span><span class='showtime'>soon</span></li>"),
    )
    body = F.concat(F.lit(f'<ul class="{box}">'), F.array_join(F.transform("items", one), ""), F.lit("</ul>"))
    return grouped.select(F.col("block").cast("string").alias("url"), F.col("block").alias("landed_seq"), F.lit("t").alias("source_slug"), F.lit("1998-03-02").cast("date").alias("run_date"), body.alias("body"))


@query("page_cards", "SELECT CAST(s_suppkey // 10 AS VARCHAR) AS page_id, CAST(s_suppkey AS VARCHAR) AS slug, 'https://i/' || s_suppkey || '.jpg' AS poster, s_name AS title, 'by A & B' AS director FROM supplier")
def _(d: Data) -> DataFrame:
    nodes = mk.elements(_cards(d, "movie-container", "movie-item", "/films/"))
    return pg.page_cards(nodes).select("page_id", "slug", "poster", "title", "director")


@query("rendered_cards", "SELECT CAST(s_suppkey // 10 AS VARCHAR) AS page_id, s_name AS title, 'https://h.org/film/' || s_suppkey || '/' AS source_url, '20:30' AS times, '1998-03-02' AS date FROM supplier")
def _(d: Data) -> DataFrame:
    nodes = mk.elements(_cards(d, "showing-listing__list", "x", "/film/"))
    cards = pg.rendered_listing_cards(nodes, "https://h.org", "https://h.org/c", "1998-03-02")
    return cards.select("page_id", "title", "source_url", F.array_join("times", ",").alias("times"), "date")


# ---- source adapters over many pages ----------------------------------------------------


def _supplier_pages(d: Data, body: Column, slug: str = "s", url: Column | None = None, spread: bool = False) -> DataFrame:
    """A landed page for each supplier, ``spread`` if pages are large."""
    address = F.concat(F.lit("https://h.org/films/"), F.col("s_suppkey").cast("string")) if url is None else url
    suppliers = d.spread("supplier") if spread else d.table("supplier")
    return suppliers.select(
        F.lit(slug).alias("source_slug"), address.alias("url"), F.col("s_suppkey").alias("landed_seq"), F.lit("1998-03-02").cast("date").alias("run_date"), body.alias("body")
    )


def _block_pages(d: Data, item: Column, before: str, after: str) -> DataFrame:
    """A landed page for each block of suppliers, from one item of text for each."""
    grouped = d.table("supplier").groupBy(_block().alias("landed_seq")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select(
        F.lit("s").alias("source_slug"), F.concat(F.lit("https://h.org/p/"), "landed_seq").alias("url"), "landed_seq", F.lit("1998-03-02").cast("date").alias("run_date"),
        F.concat(F.lit(before), F.array_join("items", ","), F.lit(after)).alias("body"),
    )


def _screening(time: str) -> Column:
    text = f'<div itemscope itemtype="https://schema.org/ScreeningEvent"><h2 itemprop="name">Film %sx</h2><time itemprop="startDate" datetime="1998-03-02T{time}">soon</time></div>'
    return F.format_string(text, "s_suppkey")


@query("two_phase_source", "SELECT 'Film ' || s_suppkey || 'x' AS title, '1998-03-02' AS date, '20:30' AS times FROM supplier")
def _(d: Data) -> DataFrame:
    home = _block_pages(d, F.format_string('<a href="/films/%s">x</a><a href="/other/%s">y</a>', "s_suppkey", "s_suppkey"), "<body>", "</body>")
    films, showings, _ = ad.listing_and_details(home, _supplier_pages(d, _screening("20:30")), "M", "m", "https://h.org", r"^/films/[^/]+/?$", ["1998-03-02"])
    return _flat(films, showings).select("title", "date", "times")


@query("fallback_source", """SELECT 'home' || s_suppkey % 2 AS source_slug, 'Film ' || s_suppkey || 'x' AS title, CASE WHEN s_suppkey % 2 = 0 THEN '20:30' ELSE '18:00' END AS times FROM supplier""")
def _(d: Data) -> DataFrame:
    slug = F.concat(F.lit("home"), (F.col("landed_seq") % 2).cast("string"))
    home = _supplier_pages(d, F.when(F.col("s_suppkey") % 2 == 0, _screening("20:30")).otherwise("<p>closed</p>")).withColumn("source_slug", slug)
    week = _supplier_pages(d, _screening("18:00")).withColumn("source_slug", slug)
    return _flat(*ad.page_with_fallback(home, week, "Z", "z", None)[:2]).select("source_slug", "title", "times")


def _push_text(times: str) -> Column:
    shows = f'[{{\\"date\\":\\"19980302\\",\\"orario\\":\\"{times}\\"}}]'
    text = '{\\"id\\":%s,\\"title\\":\\"Film %sx\\",\\"slug\\":\\"%s\\",\\"permalink\\":\\"https://h.org/films/%s\\",\\"shows\\":' + shows + "}"
    return F.format_string(text, *["s_suppkey"] * 4)


_PUSH_CALL = 'self.__next_f.push([1,"'


@query("pushed_source", "SELECT 'Film ' || s_suppkey || 'x' AS title, '1998-03-02' AS date, CASE WHEN s_suppkey % 2 = 0 THEN '22:00' ELSE '20:30' END AS times FROM supplier")
def _(d: Data) -> DataFrame:
    home = _block_pages(d, _push_text("20:30"), f"<script>{_PUSH_CALL}[", ']"])</script>')
    detail = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(f"<script>{_PUSH_CALL}"), _push_text("22:00"), F.lit('"])</script>'))).otherwise("<p>x</p>")
    films, showings, _ = ad.pushed_script(home, _supplier_pages(d, detail), "P", "s", ["1998-03-02"])
    return _flat(films, showings).select("title", "date", "times")


@query("long_pushed_films", "SELECT 'https://h.org/films/' || s_suppkey AS permalink, 650 AS shows, 12000 + length(CAST(s_suppkey AS VARCHAR)) AS chars FROM supplier")
def _(d: Data) -> DataFrame:
    """Films with hundreds of shows, and texts of thousands of characters between their fields."""
    day = lambda k: F.struct(F.date_format(F.date_add(F.lit("1998-01-01").cast("date"), k), "yyyyMMdd").alias("date"), F.lit("20:30").alias("orario"))
    film = F.struct(
        F.col("s_suppkey").alias("id"), "s_name", F.lit("t").alias("title"), F.lit("s").alias("slug"), F.concat(F.lit("https://h.org/films/"), "s_suppkey").alias("permalink"),
        F.concat(F.repeat(F.lit("long text "), F.lit(1200)), F.col("s_suppkey").cast("string")).alias("content"), F.transform(F.sequence(F.lit(0), F.lit(649)), day).alias("shows"),
    )
    body = F.concat(F.lit(f"<script>{_PUSH_CALL}"), F.replace(F.to_json(film), F.lit('"'), F.lit('\\"')), F.lit('"])</script>'))
    entries, shows = pg.extract_push_payload(_supplier_pages(d, body, spread=True))
    counts = shows.groupBy("permalink").agg(F.count("*").cast("int").alias("shows"))
    return entries.select("permalink", F.length("content").alias("chars")).join(counts, "permalink")


@query("rendered_source", "SELECT s_name AS title, 'https://h.org/film/' || s_suppkey || '/' AS source_url, '20:30' AS times FROM supplier")
def _(d: Data) -> DataFrame:
    films, showings, _ = ad.rendered_page(_cards(d, "showing-listing__list", "x", "/film/"), "T", "t", "https://h.org", "https://h.org/c", "1998-03-02")
    return _flat(films, showings).select("title", "source_url", "times")


@query("nested_links", "SELECT s_suppkey, 'https://h.org/x' || s_suppkey AS url FROM supplier")
def _(d: Data) -> DataFrame:
    """Links that climb more levels than a page is deep."""
    link = F.concat(F.repeat(F.lit("../"), (F.col("s_suppkey") % 15 + 9).cast("int")), F.lit("./y/../x"), F.col("s_suppkey").cast("string"))
    deep = F.concat(F.lit("https://h.org/"), F.repeat(F.lit("d/"), (F.col("s_suppkey") % 15 + 9).cast("int")), F.lit("page"))
    return d.table("supplier").select("s_suppkey", vl.absolute_url(link, deep).alias("url"))


_HREFS = r"""h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""


@query("page_links", rf"WITH {_HREFS} SELECT DISTINCT CAST(page_id AS VARCHAR) AS page_id, 'https://h.org' || href AS link FROM h WHERE regexp_matches(href, '^/[A-Za-z]+$')")
def _(d: Data) -> DataFrame:
    nodes = mk.elements(d.table("pages"), "page_id", "html")
    return pg.discover_links(nodes, "https://h.org", r"^/[A-Za-z]+$").select("page_id", "link")


@query("page_headings", r"""SELECT CAST(page_id AS VARCHAR) AS page_id, 'title' AS tag, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;?', '&', 'g')) AS text FROM pages""")
def _(d: Data) -> DataFrame:
    nodes = mk.elements(d.table("pages"), "page_id", "html")
    return nodes.filter("tag = 'title'").select("page_id", "tag", F.trim("text").alias("text"))


@query("detail_texts", """SELECT CAST(c_custkey AS VARCHAR) AS page_id, CASE WHEN c_nationkey < 8 THEN 'pushed ' || c_name WHEN c_nationkey < 16 THEN 'paragraph ' || c_name ELSE 'meta ' || c_name END AS description FROM customer""")
def _(d: Data) -> DataFrame:
    nation, name = F.col("c_nationkey"), F.col("c_name")
    entry = F.concat(
        F.lit('<script>self.__next_f.push([1,"{\\"id\\":1,\\"title\\":\\"t\\",\\"slug\\":\\"'), F.col("c_custkey").cast("string"), F.lit('\\",\\"permalink\\":\\"p\\",\\"content\\":\\"pushed '), name, F.lit('\\"}"])</script>')
    )
    paragraph = F.concat(F.lit("<article><p>paragraph "), name, F.lit("</p><p>later</p></article>"))
    meta = F.concat(F.lit('<meta name="description" content="meta '), name, F.lit('">'))
    body = F.concat(meta, F.when(nation < 16, paragraph).otherwise(""), F.when(nation < 8, entry).otherwise(""))
    pages = d.table("customer").select(F.col("c_custkey").cast("string").alias("url"), body.alias("body"))
    return pg.detail_text(pages, mk.elements(pages))


@query("knowledge_entities", """SELECT 'Q' || p_partkey AS entity_id, 'Film ' || p_name AS title, p_size || ' min' AS duration, 1990 + p_size AS year, 'Dir ' || p_brand AS director,
 CASE WHEN p_size > 20 THEN 'en ' || p_name END AS original_title FROM part UNION ALL SELECT DISTINCT 'P' || p_brand, 'Dir ' || p_brand, NULL, NULL, NULL, NULL FROM part""")
def _(d: Data) -> DataFrame:
    part, size = d.table("part"), F.col("p_size")
    claim = lambda value: F.array(F.struct(F.struct(F.struct(value.alias("value")).alias("datavalue")).alias("mainsnak")))
    label = lambda text: F.struct(text.alias("value"))
    claims = F.struct(
        claim(F.struct(F.concat(F.lit("P"), "p_brand").alias("id"))).alias("P57"), claim(size.cast("double")).alias("P2047"),
        claim(F.struct(F.concat(F.lit("+"), (size + 1990).cast("string"), F.lit("-01-01T00:00:00Z")).alias("time"))).alias("P577"),
    )
    labels = F.struct(label(F.concat(F.lit("Film "), "p_name")).alias("it"), F.when(size > 20, label(F.concat(F.lit("en "), "p_name"))).alias("en"))
    films = part.select(F.concat(F.lit("Q"), "p_partkey").alias("entity_id"), F.to_json(F.struct(claims.alias("claims"), labels.alias("labels"))).alias("body"))
    people = part.select("p_brand").distinct().select(F.concat(F.lit("P"), "p_brand").alias("entity_id"), F.to_json(F.struct(F.struct(label(F.concat(F.lit("Dir "), "p_brand")).alias("en")).alias("labels"))).alias("body"))
    return pl.flatten_knowledge_entities(films.unionByName(people)).select("entity_id", "title", "duration", "year", "director", "original_title")


@query("candidate_entities", """SELECT CAST(l_orderkey AS VARCHAR) AS lookup_key, arg_min(l_partkey || '-' || l_suppkey, l_linenumber * CAST(10000000000 AS BIGINT) + l_partkey * 1000 + l_suppkey) AS entity_id
 FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey""")
def _(d: Data) -> DataFrame:
    rank = F.col("l_linenumber") * F.lit(10**10) + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    text = F.when(F.col("l_returnflag") == "N", "a novel").when(F.col("l_returnflag") == "A", "1999 FILM").otherwise("the Movie")
    hits = d.table("lineitem").select(F.col("l_orderkey").cast("string").alias("lookup_key"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("entity_id"), rank.alias("rank"), text.alias("description"))
    return pl.candidate_entities(hits)


# ---- tables, cache, exports ------------------------------------------------------------


@query("last_known_good", "SELECT source, lang, doc_id FROM documents WHERE source <> 'src7' UNION ALL SELECT 'src7', 'old', doc_id FROM documents WHERE source = 'src7' AND doc_id % 2 = 0")
def _(d: Data) -> DataFrame:
    documents = d.table("documents").select(F.col("source").alias("source_slug"), "lang", "doc_id")
    cache = documents.filter("doc_id % 2 = 0").withColumn("lang", F.lit("old"))
    # One attempt log entry per source: the one that raised twice has no rows of its own.
    attempts = documents.groupBy("source_slug").agg(F.count("*").alias("rows")).select(
        "source_slug", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), (F.col("source_slug") == "src7").alias("raised"), F.lit(0).alias("errors"), "rows"
    )
    return tb.last_known_good(documents, cache, tb.failed_sources(attempts)).withColumnRenamed("source_slug", "source")


@query("union_sources", "SELECT 'pages' AS source_slug, 0 AS source_pos, count(*) AS rows, count(url) AS urls FROM pages UNION ALL SELECT 'documents', 1, count(*), 0 FROM documents")
def _(d: Data) -> DataFrame:
    union = tb.union_sources({"pages": d.table("pages").select(F.col("page_id").alias("seq"), "url"), "documents": d.table("documents").select(F.col("doc_id").alias("seq"), "lang")})
    return union.groupBy("source_slug", "source_pos").agg(F.count("*").alias("rows"), F.count("url").alias("urls"))


@query("ensure_columns", "SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS removed_at FROM supplier")
def _(d: Data) -> DataFrame:
    columns = {"removed_at": "string", "s_name": "string"}
    return ensure_columns(ensure_columns(d.table("supplier").select("s_suppkey", "s_name"), columns), columns)


@query("error_log", "SELECT o_orderkey || '' AS url, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, 'detail' AS phase FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) = DATE '1998-03-02'")
def _(d: Data) -> DataFrame:
    path = f"{checkpoint_root(d.spark)}/playbill/{uuid.uuid4().hex}"
    failed = d.table("orders").filter("o_orderstatus = 'F'")
    errors = tb.make_errors(failed, F.col("o_orderpriority"), F.lit("Timeout"), "detail", F.col("o_orderkey").cast("string"), F.lit("x"), F.col("o_orderdate"))
    of_day = lambda day: errors.filter(F.col("timestamp").startswith(day))
    tb.replace_errors_for_day(of_day("1998-03-03"), "1998-03-02", path)
    tb.replace_errors_for_day(of_day("1998-03-02"), "1998-03-02", path)
    tb.replace_errors_for_day(of_day("1998-03-03"), "1998-03-03", path)
    tb.replace_errors_for_day(errors.limit(0), "1998-03-03", path)
    return tb.read_errors(d.spark, path).select("url", F.col("day").cast("string").alias("day"), "phase")


def _state(d: Data) -> tuple[DataFrame, DataFrame]:
    """Films with a history and flat showings, as a run leaves them."""
    event = lambda date, action: F.struct(F.lit(date).alias("date"), F.lit(action).alias("action"))
    added, updated = event("1998-01-01", "added"), event("1998-02-01", "updated")
    films = d.films.select(
        F.col("id").alias("arrival_seq"), F.concat("title", F.lit(" &amp; co")).alias("title"), F.concat_ws(" ", "title_normalized", "id").alias("title_normalized"), F.col("poster_url").alias("poster"),
        F.col("synopsis").alias("description"), F.array("genres").alias("genres"), F.lit(lc.ACTIVE).alias("status"), F.concat(F.lit("1h "), "runtime_minutes", F.lit("m")).alias("duration"), "director",
        "original_title", "year", "wikidata_id", F.when(F.col("year").isNull(), F.array(added)).otherwise(F.array(added, updated)).alias("history"), "removed_at",
    )
    shows = d.showings.select(
        F.col("film_id").alias("arrival_seq"), F.col("id").alias("showing_seq"), F.col("cinema_slug").alias("cinema"), "cinema_slug", F.col("date").cast("string").alias("date"), "times", "screen",
        F.col("buy_url").alias("source_url"), "language",
    )
    return conform(films, lc.STATE_FILMS), conform(shows, SHOWING_RECORD)


@query("export_films", f"""{sql.STORE} SELECT id AS seq, title_normalized || ' ' || id AS id, title || ' & co' AS title, (60 + runtime_minutes) || ' min' AS duration, year, '1998-01-01' AS first_seen,
 CASE WHEN year IS NULL THEN '1998-01-01' ELSE '1998-02-01' END AS last_seen FROM films""")
def _(d: Data) -> DataFrame:
    return tb.export_films(_state(d)[0]).select("seq", "id", "title", "duration", "year", "first_seen", "last_seen")


_EXPORTED = f"""{sql.STORE} SELECT f.title_normalized || ' ' || f.id AS film_id, s.cinema_slug, CAST(s.date AS VARCHAR) AS date, string_agg(DISTINCT s.clock, ',' ORDER BY s.clock) AS times, s.screen, s.language
 FROM showings s JOIN films f ON f.id = s.film_id GROUP BY ALL"""


@query("export_showings", _EXPORTED)
def _(d: Data) -> DataFrame:
    return tb.export_showings(*_state(d)).select("film_id", "cinema_slug", "date", F.array_join("times", ",").alias("times"), "screen", "language")


@query("publish_and_read", _EXPORTED)
def _(d: Data) -> DataFrame:
    root = f"{checkpoint_root(d.spark)}/playbill/{uuid.uuid4().hex}"
    films, showings = _state(d)
    # The second version replaces the first, which had less.
    for version, rows in ((1, showings.filter("date < '1992-02-01'")), (2, showings)):
        tb.write_snapshot(tb.export_films(films), tb.export_showings(films, rows), d.cinemas, "1998-01-01", "1998-01-08", root, version)
    snapshot = tb.read_snapshot(d.spark, root)
    return snapshot.showings.select("film_id", "cinema_slug", "date", F.array_join("times", ",").alias("times"), "screen", "language")


@query("previous_state", f"{sql.STORE} SELECT id AS arrival_seq, title || ' &amp; co' AS title, CAST(NULL AS VARCHAR) AS wikidata_id, 1 AS version FROM films")
def _(d: Data) -> DataFrame:
    """A state that was written before one of its columns existed."""
    root = f"{checkpoint_root(d.spark)}/playbill/{uuid.uuid4().hex}"
    films, _ = _state(d)
    first = tb.read_previous(d.spark, root, "films", lc.STATE_FILMS).withColumn("version", F.lit(0))
    tb.publish({"films": films.drop("wikidata_id")}, root, 1)
    later = tb.read_previous(d.spark, root, "films", lc.STATE_FILMS).withColumn("version", F.lit(1))
    return first.unionByName(later).select("arrival_seq", "title", "wikidata_id", "version")


@query("exported_cinemas", "SELECT s_suppkey AS seq, lower(s_name) AS slug, s_name AS name, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(d: Data) -> DataFrame:
    places = d.table("supplier").join(d.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    located = places.select(F.col("s_suppkey").alias("seq"), F.lower("s_name").alias("slug"), F.col("s_name").alias("name"), F.col("n_name").alias("city"))
    return tb.cinema_rows(located).select("seq", "slug", "name", "city")


@query("nested_state", f"""{sql.STORE}, g AS (SELECT film_id, cinema_slug, date, language, screen FROM showings GROUP BY ALL)
 SELECT f.title_normalized || ' ' || f.id AS title_normalized, (SELECT count(*) FROM g WHERE g.film_id = f.id) AS showings, CASE WHEN year IS NULL THEN 1 ELSE 2 END AS events FROM films f""")
def _(d: Data) -> DataFrame:
    return tb.nest_state(*_state(d)).select("title_normalized", F.size("present_in").cast("bigint").alias("showings"), F.size("history").alias("events"))


@query("archived_state", f"{sql.STORE} SELECT id AS arrival_seq, '1998-03-02' AS run_date FROM films WHERE year IS NULL UNION ALL SELECT id, '1998-03-01' FROM films")
def _(d: Data) -> DataFrame:
    path = f"{checkpoint_root(d.spark)}/playbill/{uuid.uuid4().hex}"
    films, _ = _state(d)
    for day, rows in (("1998-03-01", films), ("1998-03-02", films), ("1998-03-02", films.filter("year is null"))):
        tb.archive_snapshot(rows, day, path)
    return d.spark.read.parquet(path).select("arrival_seq", F.col("run_date").cast("string").alias("run_date"))


@query("nightly_run", f"""WITH {_LINES} SELECT md5(CAST(l_partkey AS VARCHAR)) || 'x' AS title, count(*) AS slots FROM
 (SELECT DISTINCT l_partkey, date, screen, language FROM lines) GROUP BY l_partkey""")
def _(d: Data) -> DataFrame:
    # Titles that resemble each other would rightly become one film.
    title = F.concat(F.md5(F.col("l_partkey").cast("string")), F.lit("x"))
    source = ad.session_api(_session_payloads(d, title), "Shop", "shop", "https://h.org", "https://h.org/c")
    empty_films = d.spark.createDataFrame([], lc.STATE_FILMS)
    empty_showings = d.spark.createDataFrame([], SHOWING_RECORD)
    dimension = d.spark.createDataFrame(
        [], "lookup_key string, found boolean, poster string, description string, director string, duration string, original_title string, wikidata_id string, year int"
    )
    result = ny.run_nightly({"shop": source}, empty_films, empty_showings, dimension, "1998-03-02")
    return result.showings.groupBy(tx.title_key(F.col("film_id")).alias("title")).agg(F.count("*").alias("slots"))
