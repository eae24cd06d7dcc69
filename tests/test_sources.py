"""Flattening of payloads and pages of the shapes the sources publish."""

import json
import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

from playbill.catalog.bindings import Data
from playbill.schema import PAYLOADS
from playbill.sources import adapters as ad, markup as mk, pages as pg, payloads as pl


def landed(spark, *bodies, slug="s", target="2026-09-25"):
    rows = [(n, slug, url, None, target, body) for n, (url, body) in enumerate(bodies)]
    return spark.createDataFrame(rows, PAYLOADS).withColumn("run_date", F.lit("2026-09-25").cast("date"))


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


SESSION = {
    "result": [
        {
            "filmId": "f1", "filmTitle": "Dune - 3D", "filmUrl": "/film/dune", "posterImageSrc": "/img/d.jpg", "synopsisShort": "S", "runningTime": 155,
            "isDurationUnknown": False, "director": " Villeneuve ", "genres": [{"name": "Sci-fi"}, {"name": "Epic"}],
            "showingGroups": [
                {"date": "2026-09-25T00:00:00", "sessions": [
                    {"startTime": "2026-09-25T18:30:00+02:00", "screenName": "Sala 1", "attributes": [
                        {"name": "3D", "attributeType": "Session"}, {"name": "Italiano", "attributeType": "Language"}]},
                    {"showTime": "21:15 ca"}, {"screenName": "no time"}]},
                {"date": "not a date", "sessions": [{"startTime": "2026-09-25T10:00:00"}]},
            ],
        },
        {"title": "Alien", "filmId": "f2", "runningTime": 90, "isDurationUnknown": True, "genres": ["x"]},
        {"filmId": "untitled"},
    ]
}


def test_session_api(spark):
    films, showings, errors = ad.session_api(landed(spark, ("u", json.dumps(SESSION)), ("v", "not json")), "C", "c", "https://h.it", "https://h.it/c")
    assert rows(films, "title", "title_normalized", "poster", "duration", "director", "genres") == [
        ("Alien", "Alien", None, None, None, ["x"]),
        ("Dune - 3D", "Dune", "https://h.it/img/d.jpg", "155 min", "Villeneuve", ["Sci-fi", "Epic"]),
    ]
    assert rows(showings, "date", "times", "screen", "source_url", "language", "session_attributes") == [
        ("2026-09-25", ["18:30"], "Sala 1", "https://h.it/film/dune", "Italiano", ["3D", "Italiano"]),
        ("2026-09-25", ["21:15"], None, "https://h.it/film/dune", None, []),
    ]
    assert rows(errors, "url", "phase") == [("v", "parse_api_film")]
    nested = {"films": {"items": SESSION["result"]}}
    assert pl.flatten_session_api(landed(spark, ("u", json.dumps(nested))), "https://h.it", "x")[0].count() == 2


def test_programming_api(spark):
    def movie(title, performances, **more):
        return {"title": title, "slug": title.lower(), "poster": "https://p/x.jpg", "description": "<p>A test film</p>", "genres": [{"name": "G"}],
                "screens": [{"3D": [{"language": {"name": "IT"}, "screen": {"name": "Sala 2"}, "performances": performances}], "bad": "x"}], **more}

    day = [{"actual_start_at": "20:30", "day": "2026-09-25"}, {"actual_start_at": "18:00"}, {"actual_start_at": "10:00", "day": "2026-09-26"}]
    body = {"data": [movie("One", day), movie("Hidden", day, not_today=True), movie("Empty", [{"actual_start_at": "1", "day": "2026-09-26"}]), {"title": "None", "screens": []}]}
    films, showings, _ = ad.programming_api(landed(spark, ("u", json.dumps(body))), "U", "u", "https://u.it")
    assert rows(films, "title", "description", "genres", "source_poster") == [("Empty", "A test film", ["G"], "https://p/x.jpg"), ("One", "A test film", ["G"], "https://p/x.jpg")]
    assert rows(showings, "date", "times", "screen", "language", "session_attributes", "source_url") == [
        ("2026-09-25", ["18:00", "20:30"], "Sala 2", "IT", ["3D"], "https://u.it/film/one/"),
        ("2026-09-25", [], "Sala 2", "IT", ["3D"], "https://u.it/film/empty/"),
    ]


def test_venues(spark):
    listed = [{"letter": "T", "cinemas": [{"cinemaId": "1006", "cinemaName": "Terni"}]}, {"C": [{"deep": {"cinemaId": 1027, "cinemaName": "?", "whatsOnUrl": "/cinema/corciano/al-cinema"}}]}]
    for payload in (listed, {"a": listed[0], "b": listed[1]}):
        venues = pl.find_nodes_with_key(landed(spark, ("u", json.dumps(payload))), "cinemaId")
        sources = spark.createDataFrame(
            [("t", "Grand Cinema Terni", "https://h/x", 1), ("k", "Nowhere", "https://h/cinema/corciano/al-cinema", 2), ("n", "None", "https://h/cinema/roma/x", 3)],
            "source_slug string, name string, cinema_url string, venue_id bigint",
        )
        assert rows(pl.resolve_venues(sources, venues), "source_slug", "venue_id") == [("k", 1027), ("n", 3), ("t", 1006)]


JSONLD = """<html><head><script type="application/ld+json">{"@graph":[
 {"@type":["Movie","X"],"@id":"/f/dune","name":"Dune &amp; co","image":{"url":"/i.jpg"},"duration":"PT2H35M","dateCreated":"2021-09-03","genre":["A",""],"director":[{"name":"Villeneuve"}]},
 {"@type":"ScreeningEvent","workPresented":{"@id":"/f/dune"},"startDate":"2026-09-25T21:00:00+02:00","location":{"name":"Aurora"}},
 {"@type":"ScreeningEvent","workPresented":{"@id":"/f/dune"},"startDate":"2026-09-25T18:00:00+02:00"},
 {"@type":"ScreeningEvent","workPresented":{"name":"Inline"},"startDate":"2026-09-26T18:00"},
 {"@type":"ScreeningEvent","name":"By name","workPresented":"","startDate":"2026-09-27"},
 {"@type":"ScreeningEvent","name":"Bad date","startDate":"soon"}]}</script>
 <script type="application/ld+json">{broken</script></head></html>"""

MICRODATA = """<div itemscope itemtype="https://schema.org/Movie"><h2 itemprop="name">Serpenti &amp; scale</h2>
 <meta itemprop="url" content="/films/serpenti/"><img itemprop="image" src="/s.jpg"><span itemprop="genre">Horror</span><span itemprop="genre">B</span>
 <div itemscope itemtype="https://schema.org/ScreeningEvent"><time itemprop="startDate" datetime="2026-09-25T18:30:00+02:00">x</time>
   <div itemprop="location" itemscope><span itemprop="name">Splendor</span></div></div>
 <div itemscope itemtype="http://schema.org/ScreeningEvent/"><div itemprop="startDate" content="2026-09-25T16:00"></div></div></div>
<div itemscope itemtype="https://schema.org/ScreeningEvent"><span itemprop="startDate" content="2026-09-26T20:00"></span>
 <div itemprop="workPresented" itemscope itemtype="https://schema.org/Movie"><span itemprop="name">Nested</span><span itemprop="duration" content="PT90M"></span></div></div>
<div itemscope itemtype="https://schema.org/ScreeningEvent"><span itemprop="startDate" content="2026-09-26T22:00"></span><meta itemprop="workPresented" content="Only text"></div>
<div itemscope itemtype="https://schema.org/ScreeningEvent"><span itemprop="name">No start</span></div>"""


def test_screenings_of_pages(spark):
    pages = landed(spark, ("https://z.it/home", JSONLD), ("https://m.it/x", MICRODATA), ("https://e.it", "<p>nothing"))
    films, showings = pg.build_entities(pg.extract_screenings(pages))
    assert rows(films, "title", "title_normalized", "source_poster", "duration", "year", "genres", "director") == [
        ("By name", "By name", None, None, None, [], None),
        ("Dune & co", "Dune & co", "https://z.it/i.jpg", "155 min", 2021, ["A"], "Villeneuve"),
        ("Inline", "Inline", None, None, None, [], None),
        ("Nested", "Nested", None, "90 min", None, [], None),
        ("Only text", "Only text", None, None, None, [], None),
        ("Serpenti & scale", "Serpenti & scale", "https://m.it/s.jpg", None, None, ["Horror", "B"], None),
    ]
    assert rows(showings, "date", "times", "source_url", "cinema") == [
        ("2026-09-25", ["16:00", "18:30"], "https://m.it/films/serpenti/", "Splendor"),
        ("2026-09-25", ["18:00", "21:00"], "https://z.it/f/dune", "Aurora"),
        ("2026-09-26", ["18:00"], None, ""),
        ("2026-09-26", ["20:00"], None, ""),
        ("2026-09-26", ["22:00"], None, ""),
        ("2026-09-27", ["00:00"], None, ""),
    ]
    kept, days = pg.filter_to_dates(films, showings, ["2026-09-27"])
    assert rows(kept, "title") == [("By name",)] and days.count() == 1


def test_fallback_page(spark):
    home, week = landed(spark, ("https://z.it", "<p>empty</p>")), landed(spark, ("https://z.it/week", MICRODATA))
    films, showings, errors = ad.page_with_fallback(home, week, "Z", "z", ["2026-09-25"])
    assert rows(films, "title") == [("Serpenti & scale",)] and rows(showings, "cinema_slug", "times") == [("z", ["16:00", "18:30"])]
    films, _, _ = ad.page_with_fallback(landed(spark, ("https://z.it", JSONLD)), week, "Z", "z", None)
    assert "Nested" not in {r.title for r in films.collect()} and errors.count() == 0


def test_links_and_detail_pages(spark):
    home = landed(spark, ("https://m.it/", """<a href="/films/a/?x=1">a</a><a href="https://m.it/films/a">again</a><a href="/films/">index</a>
      <meta itemprop="url" content="https://m.it/films/b/"><a href="https://o.it/films/c/">other site</a><a href="/films/gone/">gone</a>"""))  # fmt: skip
    links = pg.discover_links(mk.elements(home, "url"), "https://m.it", r"^/films/[^/]+/?$")
    assert [r.link for r in links.orderBy("rank").collect()] == ["https://m.it/films/b/", "https://m.it/films/a/", "https://m.it/films/gone/"]
    details = landed(spark, ("https://m.it/films/a", MICRODATA), ("https://m.it/films/b/", MICRODATA), ("https://m.it/films/unlinked", JSONLD))
    films, showings, errors = ad.listing_and_details(home, details, "M", "m", "https://m.it", r"^/films/[^/]+/?$", ["2026-09-25"])
    assert rows(films, "title") == [("Serpenti & scale",)]
    assert rows(showings, "date", "times", "cinema_slug") == [("2026-09-25", ["16:00", "18:30"], "m")]
    assert rows(errors, "url", "phase") == [("https://m.it/films/gone/", "detail")]


def push(*entries):
    text = json.dumps(list(entries), ensure_ascii=False, separators=(",", ":")).replace('"', '\\"')
    return f'<script>self.__next_f.push([1,"short"])</script><script>self.__next_f.push([1,"{text}"])</script>'


def entry(n, title, slug, shows, path="films", **more):
    return {"id": n, "title": title, "slug": slug, "permalink": f"https://p.it/{path}/{slug}/", **more, "shows": shows}


def test_pushed_script(spark):
    one = [{"date": "20260925", "orario": "21:00", "opzioni": ""}, {"date": "20260925", "orario": "18:00", "opzioni": None}]
    hidden = [{"date": "20260925", "orario": "21:00", "opzioni": "noprog"}]
    details = {"regia": "(Mario Rossi)", "genere": "Drammatico, Noir", "durata": "100", "youtube_cover": {"url": "https://y/c.jpg"}}
    cards = """<ul class="movie-container"><li class="movie-item"><a href="/films/uno/"><img src="/_next/image?url=https%3A%2F%2Fi%2Fu.jpg&w=1"></a><h2>Uno</h2></li></ul>"""
    home = landed(spark, ("https://p.it/", cards + push(
        entry(1, "Uno & due", "uno", one, content="Sinossi à", details=details), entry(2, "Concerto dal vivo", "c", one), entry(3, "Evento", "e", one, path="eventi"),
        entry(4, "Nascosto", "n", hidden), entry(5, "Tre", "tre", one[:1], details=details), entry(1, "Uno & due", "uno", [*one[:1], {"date": "20260926", "orario": "10:00"}]),
    )))
    pages = landed(spark, ("https://p.it/films/tre/", "<article><p>Testo</p></article>" + push(entry(5, "Tre", "tre", [{"date": "20260925", "orario": "22:00"}]))))
    films, showings, _ = ad.pushed_script(home, pages, "P", "p", ["2026-09-25", "2026-09-26"])
    assert rows(films, "title", "description", "genres", "source_poster", "director", "duration") == [
        ("Tre", "Testo", ["Drammatico", "Noir"], "https://y/c.jpg", "Mario Rossi", "100"),
        ("Uno & due", "Sinossi à", ["Drammatico", "Noir"], "https://i/u.jpg", "Mario Rossi", "100"),
    ]
    assert rows(showings, "source_url", "date", "times") == [
        ("https://p.it/films/tre/", "2026-09-25", ["22:00"]),
        ("https://p.it/films/uno/", "2026-09-25", ["18:00", "21:00"]),
        ("https://p.it/films/uno/", "2026-09-26", ["10:00"]),
    ]
    spare, none, _ = ad.pushed_script(landed(spark, ("https://p.it/", cards)), pages, "P", "p", ["2026-09-25"])
    assert rows(spare, "title", "source_poster") == [("Uno", "https://i/u.jpg")] and none.count() == 0


def test_detail_text_order(spark):
    meta = '<meta name="description" content=" cut... ">'
    pages = landed(spark, ("https://p.it/films/a/", push(entry(1, "A", "a", [], content="Full")) + meta), ("https://p.it/films/b/", "<div class='description'><p>Para</p></div>" + meta), ("https://p.it/films/c/", meta))
    got = rows(pg.detail_text(pages, mk.elements(pages, "url")), "page_id", "description")
    assert [g[1] for g in got] == ["Full", "Para", "cut..."]


def test_rendered_cards(spark):
    body = """<ul class="showing-listing__list"><li><h3>Dune</h3><a href="/film/dune">x</a><img src="/d.jpg"><span class="showtime">18:30</span><span class="showtime">no</span></li></ul>
      <div class="film-card"><span class="film-title">Alien</span></div><div class="film-card"></div>"""
    films, showings, _ = ad.rendered_page(landed(spark, ("u", body)), "T", "t", "https://h.it", "https://h.it/c", "2026-09-25")
    assert rows(films, "title", "source_poster") == [("Alien", None), ("Dune", "https://h.it/d.jpg")]
    assert rows(showings, "times", "source_url") == [(["18:30"], "https://h.it/film/dune"), ([], "https://h.it/c")]


def test_knowledge_base(spark):
    def claim(value):
        return [{"mainsnak": {"datavalue": {"value": value}}}]

    film = {"claims": {"P18": claim("Dune.jpg"), "P57": claim("text") + claim({"id": "Q7"}), "P2047": claim("155.0"), "P577": claim({"time": "+2021-10-22T00:00:00Z"})},
            "labels": {"it": {"value": "Dune (it)"}, "en": {"value": "Dune"}}, "descriptions": {"en": {"value": "film"}}}
    person = {"labels": {"en": {"value": "Villeneuve"}}}
    dump = spark.createDataFrame([("Q1", json.dumps(film)), ("Q7", json.dumps(person))], "entity_id string, body string")
    hits = spark.createDataFrame([("dune", 0, "Q9", "a novel"), ("dune", 1, "Q1", "2021 Film by D. V."), ("dune", 2, "Q2", "movie")], "lookup_key string, rank int, entity_id string, description string")
    todo = spark.createDataFrame([("dune",), ("nothing",)], "lookup_key string")
    got = rows(pl.build_dimension(todo, hits, dump), "lookup_key", "found", "poster", "director", "duration", "year", "original_title", "description")
    assert got == [("dune", True, pl.IMAGE_FOLDER + "Dune.jpg", "Villeneuve", "155 min", 2021, "Dune", "film"), ("nothing", False, None, None, None, None, None, None)]


def test_two_rendered_pages(spark):
    page = lambda title, at: f"""<ul class="showing-listing__list"><li><h3>{title}</h3><span class="showtime">{at}</span></li></ul>"""
    films, showings, _ = ad.rendered_page(landed(spark, ("u", page("Dune", "18:30")), ("v", page("Alien", "21:00"))), "T", "t", "https://h.it", "https://h.it/c", "2026-09-25")
    named = showings.join(films.select(F.col("seq").alias("film_seq"), "title"), "film_seq")
    assert rows(named, "title", "times") == [("Alien", ["21:00"]), ("Dune", ["18:30"])]


def test_two_listing_pages(spark):
    detail = lambda t: f'<div itemscope itemtype="https://schema.org/ScreeningEvent"><h2 itemprop="name">{t}</h2><time itemprop="startDate" datetime="2026-09-25T20:30">x</time></div>'
    home = landed(spark, ("https://m.it/a", '<a href="/films/uno">1</a>'), ("https://m.it/b", '<a href="/films/due">2</a>'))
    details = landed(spark, ("https://m.it/films/uno", detail("Uno")), ("https://m.it/films/due", detail("Due")))
    films, showings, _ = ad.listing_and_details(home, details, "M", "m", "https://m.it", r"^/films/[^/]+/?$", ["2026-09-25"])
    assert rows(films, "title") == [("Due",), ("Uno",)] and showings.count() == 2


def test_a_film_on_two_pushed_pages_and_slug_matched_details(spark):
    show = [{"date": "20260925", "orario": "21:00"}]
    home = landed(spark, ("https://p.it/", push(entry(1, "Uno", "uno", show))), ("https://p.it/b", push(entry(1, "Uno", "uno", [{"date": "20260925", "orario": "23:00"}]), entry(2, "Due", "due", show))))
    moved = entry(2, "Due", "due", [{"date": "20260925", "orario": "22:00"}], path="archive")
    details = landed(spark, ("https://p.it/films/due/", push(moved)))
    films, showings, _ = ad.pushed_script(home, details, "P", "p", ["2026-09-25"])
    named = showings.join(films.select(F.col("seq").alias("film_seq"), "title"), "film_seq")
    assert rows(named, "title", "times") == [("Due", ["22:00"]), ("Uno", ["21:00", "23:00"])]


def test_long_pushed_films_keep_all_their_shows(spark):
    shows = [{"date": f"2026{m:02}{d:02}", "orario": f"{h}:00"} for m in range(1, 13) for d in range(1, 29) for h in (18, 21)]
    film = entry(1, "Uno", "uno", shows, content="x" * 9000, details={"regia": "y" * 9000})
    entries, found = pg.extract_push_payload(landed(spark, ("u", push(film))))
    assert found.count() == len(shows) and entries.first().details.regia == "y" * 9000 and len(entries.first().content) == 9000


def test_bodies_that_cannot_be_read_hold_no_node(spark):
    bodies = landed(spark, ("a", "[" * 100_000), ("b", None), ("c", '{"x": [{"k": 1}, {"y": {"k": 2}}]}'))
    assert rows(pl.find_nodes_with_key(bodies, "k"), "url", "node_seq") == [("c", 0), ("c", 1)]


def chunked(text, *cuts):
    """A text in several pushed scripts, cut at these places."""
    ends = [0, *cuts, len(text)]
    return "".join(f"<script>self.__next_f.push([1,{json.dumps(text[a:b])}])</script>" for a, b in zip(ends, ends[1:]))


def film_text(n):
    return json.dumps({"id": n, "title": f"T{n}", "slug": f"s{n}", "permalink": f"https://p.it/{n}", "content": 'a { b } [ " c', "shows": [{"date": "20260925", "orario": "20:00"}]})


def test_pushed_texts_are_one_stream(spark):
    """Films in a chunk each, a list cut anywhere, also within a film, an escape or a name, and a gap."""
    three = "".join(chunked(f"{n}:{film_text(n)}\n") for n in (1, 2, 3))
    whole = "5:[" + ",".join(film_text(n) for n in range(1, 6)) + "]\n"
    pages = [("three", three)] + [(f"cut {k}", chunked(whole, *cuts)) for k, cuts in enumerate([(40,), (len(whole) // 2,), (7, 60, 200, 201, 500), tuple(range(1, len(whole), 3))])]
    pages.append(("gap", chunked(film_text(1)) + '<script>self.__next_f.push([1,"\\q"])</script>' + chunked("[" + film_text(2) + "," + film_text(3)[:50])))
    entries, shows = pg.extract_push_payload(landed(spark, *pages), "url")
    got = {}
    for r in entries.collect():
        got.setdefault(r.page_id, []).append(r.permalink[-1])
    want = {"three": "123", "gap": "12"} | {f"cut {k}": "12345" for k in range(4)}
    assert {k: "".join(sorted(v)) for k, v in got.items()} == want
    assert shows.count() == sum(map(len, want.values()))


def test_what_is_whole_in_broken_json():
    found = lambda text: list(mk._objects(text))
    assert found('x {"a": [1, {"b": 2}], "c": {"d": 3}, "e": {"f"') == [[1, {"b": 2}], {"d": 3}]
    assert found('{"a": {"b": 1} oops {"c": 2}') == [{"b": 1}, {"c": 2}]
    assert json.loads(film_text(1)) in found('{"a": "unclosed {' + film_text(1))
    deep = "{\"a\":" * 3000 + "{}" + "}" * 3000
    (value,) = found(deep)
    for _ in range(3000):
        value = value["a"]
    assert value == {}


def test_unclosed_braces_take_linear_time():
    """Every brace of these opens an object that never ends."""
    seconds = []
    for size in (20_000, 160_000):
        text = ('{"a":[' * size) + film_text(7)
        begin = time.perf_counter()
        assert [f["id"] for v in mk._objects(text) for f in mk._films(v)] == [7]
        seconds.append(time.perf_counter() - begin)
    assert seconds[1] < 40 * max(seconds[0], 0.02)


LD = 'type="application/ld+json"'


@pytest.mark.parametrize(
    "body, found",
    [
        (f'<script {LD}>1</script><script async {LD.upper()} id="x>y">"<b>"</ScRipt ><p>"</p>', ["1", '"<b>"']),
        (f"<!-- <script {LD}>1</script> --><script type=application/ld+json>2</script>", ["2"]),
        (f'<script>var a = "<!--";</script><script {LD}>1</script><!-- b -->', ["1"]),
        (f'<div data-x="<!--"><script {LD}>1</script></div><!-- a -->', ["1"]),
        (f'<script src="json"/><script {LD}>1</script>', ["1"]),
        (f"<script {LD}>1", None),  # left open: whatever the tokeniser makes of it
        (f"<!-- <script {LD}>1</script>", []),
        (f'<script data-{LD} type="text/json">1</script><script type="text/json" {LD}>2</script>', []),
        (f"<style>a > b <script {LD}>1</script></style><script {LD}>2</script>", ["2"]),
        (f"<style>a</script><script {LD}>1</script></style><script {LD}>2</script>", ["2"]),
        ('<script type="application/ld&#43;json">1</script>', ["1"]),
        (f"a < b <script {LD}></script> <script-x {LD}>1</script-x><script\n {LD}\n>2</script\n>", ["", "2"]),
        (f"<p title='x\"y'><script {LD} \"junk\">1</script>", ["1"]),
        ("json", []),
        ("", []),
        (None, []),
    ],
)
def test_linked_scripts_equal_those_of_the_tokeniser(spark, body, found):
    pages = spark.createDataFrame([("p", body)], "url string, body string")
    kind = F.lower(F.coalesce(mk.attr("type"), F.lit("")))
    tokenised = mk.elements(pages, marked_only=True).filter((F.col("tag") == "script") & (kind == "application/ld+json"))
    told = [r["text"] for r in tokenised.orderBy("eid").collect()]
    assert found is None or told == found
    assert [r["text"] for r in mk.linked_scripts(pages).orderBy("eid").collect()] == told


def test_linked_values_that_are_lists_or_objects(spark):
    film = {"@type": ["Thing", "Movie"], "@id": "#f", "name": "[REC] &amp; co", "director": [{"name": "A"}, {"name": "B"}], "image": {"url": "/i.jpg"}, "genre": ["Drama"], "dateCreated": 1999}
    event = {"@type": "ScreeningEvent", "startDate": "2026-09-25T21:00:00", "workPresented": {"@id": "#f"}, "location": {"name": ["Sala"]}}
    inline = {"@type": "ScreeningEvent", "startDate": "2026-09-26T20:00:00", "workPresented": {"name": "Solo", "director": {"name": "C"}}, "location": "x"}
    spoken = {"@type": "ScreeningEvent", "startDate": "2026-09-27T20:00:00", "workPresented": ["Detto"], "name": "E"}
    body = f"<script {LD}>{json.dumps({'@graph': [film, event, inline, spoken, 3, {}]})}</script>"
    pages = spark.createDataFrame([(1, "s", "https://m.it/p", body)], "landed_seq bigint, source_slug string, url string, body string")
    got = pg.extract_screenings(pages).orderBy("date").collect()
    assert [(r["title"], r["director"], r["poster"], r["year"], r["genres"], r["location_name"]) for r in got] == [
        ("[REC] & co", "A", "https://m.it/i.jpg", 1999, ["Drama"], "Sala"),
        ("Solo", "C", None, None, [], None),
        ("Detto", None, None, None, [], None),
    ]


def spans(spark, seed):
    """Random nested elements (eid, end) of four pages, some outer, some inner, some both."""
    dice, rows = random.Random(seed), []
    for page in "abcd":
        open_, n = [], dice.randrange(1, 40)
        ends = {}
        for eid in range(n):
            while open_ and dice.random() < 0.4:
                ends[open_.pop()] = eid - 1
            open_.append(eid)
        ends |= dict.fromkeys(open_, n - 1)
        rows += [(page, eid, ends[eid], dice.random() < 0.4, dice.random() < 0.4, dice.choice([None, "x", "y"])) for eid in range(n)]
    return rows, spark.createDataFrame(rows, "page_id string, eid int, end int, outer boolean, inner boolean, value string")


@pytest.mark.parametrize("seed", range(3))
def test_elements_in_elements_equal_all_pairs(spark, seed):
    rows, table = spans(spark, seed)
    outer, inner = table.filter("outer").select("page_id", "eid", "end"), table.filter("inner").select("page_id", "eid", "value")
    pairs = [(o[0], o[1], i[1], i[5]) for o in rows for i in rows if o[3] and i[4] and o[0] == i[0] and o[1] < i[1] <= o[2]]
    assert sorted(tuple(r)[:3] for r in mk.inside(inner, outer).select("page_id", "o_eid", "eid").collect()) == sorted(p[:3] for p in pairs)
    assert {(r.page_id, r.eid) for r in mk.within_any(inner, outer).collect()} == {(p[0], p[2]) for p in pairs}
    found = mk.first_inside(outer, table, {"any": (F.col("inner"), F.col("value")), "x": (F.col("inner") & F.expr("value <=> 'x'"), F.col("eid"))}).collect()
    wanted = []
    for page, eid, *_ in (r for r in rows if r[3]):
        mine = sorted((p[2], p[3]) for p in pairs if p[:2] == (page, eid)) if any(p[:2] == (page, eid) for p in pairs) else []
        wanted.append((page, eid, mine[0][1] if mine else None, next((e for e, v in mine if v == "x"), None)))
    assert sorted(map(tuple, found), key=lambda r: r[:2]) == sorted(wanted, key=lambda r: r[:2])


def test_deep_pages_take_linear_time(spark):
    deep = 100_000
    body = "<ul class='movie-container'><li class='movie-item'>" + "<div><!-- -->t" * deep + "<a href='/films/x'>X</a></i>" * 3 + "</div>" * deep + "</li></ul>"
    started = time.monotonic()
    cards = pg.page_cards(mk.elements(spark.createDataFrame([("u", body)], "url string, body string"))).collect()
    assert [(r.slug, r.link) for r in cards] == [("x", "/films/x")] and time.monotonic() - started < 30


def test_a_payload_is_read_in_one_pass(spark):
    payloads = landed(spark, ("u", json.dumps(SESSION)), ("v", json.dumps({"result": [], "films": {"items": ["x", {"title": 7, "showingGroups": "no"}]}})))
    films, showings = pl.flatten_session_api(payloads, "https://h.it", "https://h.it/c")
    assert rows(films, "title") == [("7",), ("Alien",), ("Dune - 3D",)]
    # A list that is taken apart is not filtered by its size first, which would read it twice.
    plan = showings._jdf.queryExecution().optimizedPlan().toString()
    assert "try_variant_get" not in plan and "size(" not in plan


def test_properties_are_read_once(spark, monkeypatch):
    written, write = [], pg.materialise
    monkeypatch.setattr(pg, "materialise", lambda frame: written.append(frame.columns) or write(frame))
    page = '<div itemscope itemtype="https://schema.org/Movie"><b itemprop="name">A &amp; B</b><div itemscope itemtype="https://schema.org/ScreeningEvent"><time itemprop="startDate" datetime="2024-01-31T20:00">x</time></div></div>'
    events = pg.extract_screenings(landed(spark, ("u", page)))
    assert ["page_id", "eid", "end", "scope", "name", "value", "is_item", "is_movie"] in written
    films, showings = pg.build_entities(events)
    assert rows(films, "title") == [("A & B",)] and rows(showings, "date", "times") == [("2024-01-31", ["20:00"])]


@pytest.mark.parametrize("seed", range(3))
def test_plain_start_tags_equal_the_standard_parser(monkeypatch, seed):
    rng = random.Random(seed)
    pieces = ["<div>", "<DIV Class=\"a b\">", "<p itemprop>", "<p a=\"1\"b=\"2\">", "<b x='1'>", "<br/>", "<a href=\"?a=1&amp;b\">", "<i a=\"<>\">", "<li\n id=\"x\" ID=\"y\">", "<title>", "</title>",
              "<script>", "</script>", "<div", "<span a=\"", "\"", ">", "text &amp; more", "</div>", "</p>", "<!-- x -->", "<div a = \"1\">", "<h2 itemtype=\"http://s.org/Movie/\" itemscope>", "<td >", "<x-y>", "<time class=\"showtime\">"]

    def read(body):
        tokens = mk._Tokeniser()
        tokens.feed(body)
        return [mk._columns(r) for r in tokens.finish()]

    bodies = ["".join(rng.choices(pieces, k=30)) for _ in range(300)]
    fast = [read(body) for body in bodies]
    monkeypatch.delattr(mk._Tokeniser, "parse_starttag")
    assert fast == [read(body) for body in bodies]


def test_programmed_films_of_any_shape(spark):
    """What has another shape than a field's is as if it were not there."""
    at = lambda **more: {"performances": [{"actual_start_at": "20:30"}, "x", {"actual_start_at": ""}], **more}
    lists = [at(screen="Sala 1"), at(screen={"name": "Sala 2"}, language="IT"), at(screen={}), at(screen=""), {"screen": ["x"], "performances": "none"}, "no variant", None]
    films = ["no film", None, {"title": 7, "not_today": "no", "screens": [{"3D": lists, "IMAX": "x"}, "x", None]}, {"title": "Gone", "not_today": True, "screens": [{"3D": lists}]}, {"title": "Bare", "screens": {}}]
    payloads = landed(spark, ("u", json.dumps({"data": films})), ("v", json.dumps({"data": {}})), ("w", "not json"))
    found, showings = pl.flatten_programming_api(payloads, "https://u.it")
    assert rows(found, "title") == [("7",)]
    assert rows(showings, "times", "screen", "language", "session_attributes") == [
        (["20:30"], "3D", None, []), (["20:30"], "Sala 2", None, ["3D"]), (["20:30"], None, None, ["3D"]), (["20:30"], None, None, ["3D"]), ([], "3D", None, []),
    ]
    # Bodies are parsed once, for both.
    assert "try_parse_json" not in "".join(frame._jdf.queryExecution().optimizedPlan().toString() for frame in (found, showings))


def test_elements_are_deleted_once_their_events_are_written(spark, monkeypatch):
    written, write = [], pg.materialise
    monkeypatch.setattr(pg, "materialise", lambda frame: written.append(write(frame)) or written[-1])
    page = '<script type="application/ld+json">{"@type":"ScreeningEvent","name":"A","startDate":"2024-01-31T20:00"}</script>'
    assert pg.extract_screenings(landed(spark, ("u", page))).count() == 1
    left = lambda table: any(pathlib.Path(table.folder.removeprefix("file://")).glob("*.parquet"))
    assert {"raw", "attrs"} <= {c for table in written if not left(table) for c in table.columns}
    assert left(written[-1])


def test_pages_made_of_small_rows_are_dealt_to_all_tasks(spark, tmp_path):
    spark.range(4).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    data = Data(spark, str(tmp_path))
    assert data.table("supplier").rdd.getNumPartitions() == 1 and data.spread("supplier").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert data.spread("supplier").count() == 4
