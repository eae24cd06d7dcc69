"""Listings inside web pages: linked data, microdata, pushed scripts, cards and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playbill.functions import text as tx, values as vl
from playbill.operators import grouping as gr
from playbill.schema import blank, filled
from playbill.session import discard, materialise
from playbill.sources import markup as mk
from playbill.sources.payloads import FILM_FIELDS, SHOWING_FIELDS, position

EVENT_FIELDS = (
    "page_id", "seq", "title", "source_url", "poster", "description", "director", "duration", "year", "genres", "location_name", "date", "time",
)
MOVIE_FIELDS = ("title", "source_url", "poster", "description", "director", "duration", "year", "genres")

# Words in a title that mark an event with guests rather than a film.
EVENT_HINTS = ["presentano", "ospiti", "rassegna", "ospite", "dal vivo", "live", "in concerto", "concerto"]

# ---- linked data ----------------------------------------------------------------------


_FILM_KEYS = ("name", "@id", "url", "image", "description", "director", "duration", "dateCreated", "datePublished")
#: An object is read once, as a struct of the texts that matter; what is a list or an object within it is looked into afterwards.
_TEXT_KEYS = (*_FILM_KEYS, "workPresented", "location", "startDate")
_NODE = "struct<`@type`:variant,genre:variant," + ",".join(f"`{key}`:string" for key in _TEXT_KEYS) + ">"


def _string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _types(kind: Column) -> Column:
    return F.coalesce(F.try_variant_get(kind, "$", "array<string>"), F.array(_string(kind)))


def _opens(text: Column) -> Column:
    """Whether a text may be a list or an object."""
    return F.coalesce(text.startswith("[") | text.startswith("{"), F.lit(False))


def _texts(rows: DataFrame, values: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds the text of each value, which may be a text, a list or an object with a name or link.

    A value comes as text and as variant. Most are texts; only what reads as a list or object is looked into. Done in steps
    over named columns: nested in one expression, every step would be repeated for each use of the one before.
    """
    inner = lambda n, then: F.when(_opens(F.col(f"_s_{n}")), then)
    told = rows.withColumns({f"_s_{n}": text for n, (text, _) in values.items()})
    told = told.withColumns({f"_v_{n}": inner(n, value) for n, (_, value) in values.items()})
    listed = told.withColumns({f"_l_{n}": inner(n, F.try_variant_get(F.col(f"_v_{n}"), "$", "array<variant>")) for n in values})
    single = listed.withColumns({f"_v_{n}": inner(n, F.when(F.col(f"_l_{n}").isNull(), F.col(f"_v_{n}")).otherwise(F.try_element_at(f"_l_{n}", F.lit(1)))) for n in values})

    def spoken(name: str) -> Column:
        value = F.col(f"_v_{name}")
        field = lambda f: filled(F.try_variant_get(value, f"$.{f}", "string"))
        is_object = F.schema_of_variant(value).startswith("OBJECT")
        return inner(name, F.when(is_object, F.coalesce(field("name"), field("url"))).otherwise(_string(value))).otherwise(F.col(f"_s_{name}"))

    said = single.withColumns({n: tx.strip(spoken(n)) for n in values}).drop(*[f"_{k}_{n}" for k in "lsv" for n in values])
    decoded = said.withColumn("_decoded", tx.decode_entities_of([F.col(n) for n in values]))
    return decoded.withColumns({n: filled(F.col("_decoded")[k]) for k, n in enumerate(values)}).drop("_decoded")


def extract_jsonld(scripts: DataFrame) -> DataFrame:
    """(page_id, seq, node, raw, types): entries of every linked-data script that lists a screening.

    ``scripts`` is (page_id, eid, text). Lists and graphs are flattened; malformed scripts are skipped. ``types`` is null for
    entries that are neither films nor screenings; ``raw`` is only there if a text of the node is a list or object.
    """
    parsed = scripts.filter(F.contains("text", F.lit("ScreeningEvent"))).select("page_id", "eid", F.try_parse_json("text").alias("root"))
    root = F.col("root")
    listed = F.coalesce(
        F.try_variant_get(root, "$", "array<variant>"), F.try_variant_get(root, "$['@graph']", "array<variant>"), F.array(root)
    )
    items = parsed.select("page_id", "eid", listed.alias("items"))
    wanted = F.exists("items", lambda i: F.array_contains(_types(F.try_variant_get(i, "$['@type']", "variant")), "ScreeningEvent"))
    # The outer form of explode: for the other one the planner adds a filter that would read every list again.
    exploded = items.select("page_id", "eid", F.posexplode_outer(F.when(wanted, F.col("items"))).alias("i", "raw"))
    read = exploded.select("page_id", "eid", "i", "raw", F.try_variant_get("raw", "$", _NODE).alias("node"))
    node = F.col("node")
    # Scripts in page order, then items in script order.
    seq = F.shiftleft(F.col("eid").cast("bigint"), 24) + F.col("i")
    compound = F.exists(F.array(*[node[key] for key in _TEXT_KEYS]), _opens)
    kinds = _types(node["@type"])
    kept = F.when(F.array_contains(kinds, "ScreeningEvent") | F.array_contains(kinds, "Movie"), kinds)
    return read.select("page_id", seq.alias("seq"), node.alias("node"), F.when(compound, F.col("raw")).alias("raw"), kept.alias("types"))


def jsonld_events(items: DataFrame, bases: DataFrame) -> DataFrame:
    """Screenings joined with the film they present, by reference or inline.

    ``bases`` is (page_id, base_url). The title falls back to the presented work, then to the
    name of the event; events without a readable start are skipped.
    """
    get = lambda value, key, kind="variant": F.try_variant_get(value, f"$['{key}']", kind)
    node, raw = F.col("node"), F.col("raw")
    film = items.filter(F.array_contains("types", "Movie")).withColumn("work_id", node["@id"]).filter("work_id is not null")
    films = film.groupBy("page_id", "work_id").agg(F.max_by(F.struct("node", "raw"), "seq").alias("film"))
    place = get(raw, "location", "struct<name:variant>")["name"]
    events = items.filter(F.array_contains("types", "ScreeningEvent")).withColumns({"date": vl.start_date(node["startDate"]), "time": vl.start_time(node["startDate"])}).filter("date is not null")
    events = events.select("page_id", "seq", "date", "time", node["name"].alias("event_name"), node["workPresented"].alias("work"), "raw", get(raw, "workPresented", _NODE).alias("inline"), place.alias("place"))
    events = events.withColumn("work_id", F.col("inline")["@id"])
    joined = events.join(films, ["page_id", "work_id"], "left").join(bases, "page_id", "left")
    inline = F.struct(F.col("inline").alias("node"), get(raw, "workPresented").alias("raw"))
    shown = joined.withColumn("shown", F.coalesce("film", F.when(F.col("inline").isNotNull(), inline)))
    values = {f"f_{key}": (F.col("shown.node")[key], get(F.col("shown.raw"), key)) for key in _FILM_KEYS}
    values["work_text"] = (F.when(F.col("inline").isNull(), F.col("work")), get(raw, "workPresented"))
    values |= {"event_text": (F.col("event_name"), get(raw, "name")), "location_name": (_string(F.col("place")), F.col("place"))}
    read = _texts(shown.withColumn("genre", F.col("shown.node")["genre"]), values)
    text = {key: F.col(f"`f_{key}`") for key in _FILM_KEYS}
    return read.select(
        "page_id", "seq", F.coalesce(text["name"], "work_text", "event_text").alias("title"),
        vl.absolute_url(F.coalesce(text["@id"], text["url"]), F.col("base_url")).alias("source_url"), vl.absolute_url(text["image"], F.col("base_url")).alias("poster"),
        text["description"].alias("description"), text["director"].alias("director"), text["duration"].alias("duration"),
        vl.parse_year(F.coalesce(text["dateCreated"], text["datePublished"])).alias("year"), vl.variant_genres(F.col("genre")).alias("genres"), "location_name", "date", "time",
    )


# ---- microdata ------------------------------------------------------------------------


def _has_type(name: str) -> Column:
    ends = F.transform(F.split(F.coalesce(mk.attr("itemtype"), F.lit("")), r"\s+"), lambda t: F.regexp_extract(t, r"([^/]*)/*$", 1))
    # Most elements have no type at all, or another one.
    return F.coalesce(F.contains(mk.attr("itemtype"), F.lit(name)), F.lit(False)) & F.array_contains(ends, name)


def microdata_items(nodes: DataFrame, kind: str) -> DataFrame:
    """Elements of an item type, told by the last segment of the type URL, at any depth."""
    return nodes.filter(_has_type(kind))


def microdata_properties(nodes: DataFrame) -> DataFrame:
    """(page_id, eid, end, scope, name, value, is_item, is_movie) of every ``itemprop`` element.

    The value is its ``content``, else the attribute its tag carries values in, else its text.
    """
    tag = F.col("tag")
    value = (
        F.when(mk.attr("content").isNotNull(), mk.attr("content"))
        .when(tag.isin("a", "area", "link"), mk.attr("href"))
        .when(tag.isin("img", "audio", "video", "embed", "iframe", "source", "track"), mk.attr("src"))
        .when(tag == "time", F.coalesce(mk.attr("datetime"), filled(F.col("text"))))
        .when(tag == "data", mk.attr("value"))
        .otherwise(filled(F.col("spaced")))
    )
    props = nodes.filter(mk.attr("itemprop").isNotNull())
    return props.select(
        "page_id", "eid", "end", "scope", mk.attr("itemprop").alias("name"), tx.decode_entities(value).alias("value"),
        F.map_contains_key("attrs", "itemscope").alias("is_item"), _has_type("Movie").alias("is_movie"),
    )


def owned(items: DataFrame, props: DataFrame) -> DataFrame:
    """Properties of each item: those whose nearest enclosing scope is the item itself.

    Items come with ``item_eid``, ``item_end`` and ``item_scope`` (the scope their properties
    carry). An item without ``itemscope`` shares the scope around it and is told by its span.
    """
    named = props.select(
        "page_id", F.coalesce("scope", F.lit(-1)).alias("item_scope"), F.col("eid").alias("p_eid"), F.col("end").alias("p_end"), "name", "value", "is_item", "is_movie"
    )
    joined = items.join(named, ["page_id", "item_scope"])
    return joined.filter((F.col("p_eid") > F.col("item_eid")) & (F.col("p_eid") <= F.col("item_end")))


def _as_items(nodes: DataFrame, is_item: Column, eid: str = "eid", end: str = "end", scope: str = "scope") -> DataFrame:
    around = F.when(is_item, F.col(eid)).otherwise(F.coalesce(scope, F.lit(-1)))
    return nodes.withColumns({"item_eid": F.col(eid), "item_end": F.col(end), "item_scope": around})


def _first(name: str) -> Column:
    """Aggregate: value of the first element with a property name, even if it has none."""
    return F.min_by("value", F.when(F.col("name") == name, F.col("p_eid")))


def _movie_fields(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """(page_id, item_eid, movie struct) of every film item."""
    films = _as_items(microdata_items(nodes, "Movie"), F.map_contains_key("attrs", "itemscope")).select("page_id", "item_eid", "item_end", "item_scope")
    genre = F.struct(F.col("p_eid").alias("at"), F.col("value").alias("value"))
    genres = F.array_sort(F.collect_list(F.when((F.col("name") == "genre") & ~blank(F.col("value")), genre)))
    read = owned(films, props).groupBy("page_id", "item_eid").agg(
        _first("name").alias("title"), _first("url").alias("source_url"), _first("image").alias("poster"), _first("description").alias("description"),
        _first("director").alias("director"), _first("duration").alias("duration"), vl.parse_year(_first("dateCreated")).alias("year"),
        F.transform(genres, lambda g: g["value"]).alias("genres"),
    )
    return read.select("page_id", "item_eid", F.struct(*MOVIE_FIELDS).alias("movie"))


def microdata_events(nodes: DataFrame, bases: DataFrame) -> DataFrame:
    """Screenings of microdata pages: the nested film, completed from an enclosing one."""
    # Properties are read once: those of films, screenings and places are all found among them.
    props = materialise(microdata_properties(nodes))
    events = _as_items(microdata_items(nodes, "ScreeningEvent"), F.map_contains_key("attrs", "itemscope"))
    events = events.select("page_id", "item_eid", "item_end", "item_scope", F.col("movie").alias("around_eid"))
    mine = owned(events, props)
    work = F.struct(F.col("p_eid").alias("eid"), (F.col("is_item") & F.col("is_movie")).alias("nested"), F.col("value").alias("value"))
    place = F.struct(F.col("p_eid").alias("eid"), F.col("p_end").alias("end"), F.col("is_item").alias("is_item"), F.col("item_scope").alias("scope"))
    pick = lambda column, name: F.min_by(column, F.when(F.col("name") == name, F.col("p_eid")))
    read = mine.groupBy("page_id", F.col("item_eid").alias("event_eid"), "around_eid").agg(
        _first("startDate").alias("start"), _first("name").alias("event_name"), pick(work, "workPresented").alias("work"), pick(place, "location").alias("place")
    )
    read = read.withColumns({"date": vl.start_date(F.col("start")), "time": vl.start_time(F.col("start"))}).filter("date is not null")

    films = _movie_fields(nodes, props)
    nested = films.select("page_id", F.col("item_eid").alias("work_eid"), F.col("movie").alias("nested"))
    around = films.select("page_id", F.col("item_eid").alias("around_eid"), F.col("movie").alias("around"))
    places = read.filter("place is not null").select("page_id", "event_eid", "place.*")
    places = _as_items(places, F.col("is_item")).select("page_id", "event_eid", "item_eid", "item_end", "item_scope")
    place_names = owned(places, props).groupBy("page_id", "event_eid").agg(_first("name").alias("location_name"))

    joined = (
        read.withColumn("work_eid", F.when(F.col("work.nested"), F.col("work.eid")))
        .join(nested, ["page_id", "work_eid"], "left")
        .join(around, ["page_id", "around_eid"], "left")
        .join(place_names, ["page_id", "event_eid"], "left")
        .join(bases, "page_id", "left")
    )
    text = lambda c: F.coalesce(filled(F.col(f"nested.{c}")), filled(F.col(f"around.{c}")))
    spoken = F.when(~F.coalesce("work.nested", F.lit(False)), F.col("work.value"))
    listed = F.when(F.size("nested.genres") > 0, F.col("nested.genres")).otherwise(F.coalesce("around.genres", F.array().cast("array<string>")))
    title = F.coalesce(filled(F.col("nested.title")), filled(spoken), filled(F.col("around.title")), filled(F.col("event_name")))
    url = lambda c: F.coalesce(*[vl.absolute_url(filled(F.col(f"{side}.{c}")), F.col("base_url")) for side in ("nested", "around")])
    return joined.select(
        "page_id", F.col("event_eid").cast("bigint").alias("seq"), title.alias("title"), url("source_url").alias("source_url"), url("poster").alias("poster"),
        text("description").alias("description"), text("director").alias("director"), text("duration").alias("duration"),
        F.coalesce("nested.year", "around.year").alias("year"), listed.alias("genres"), "location_name", "date", "time",
    )


# ---- screenings of a page and their films ----------------------------------------------


def extract_screenings(pages: DataFrame, base_url: Column | None = None) -> DataFrame:
    """Screenings of landed pages, from linked data where a page has it, else from microdata.

    Links resolve against ``base_url``, the page itself by default. Event numbers are unique in
    the order the pages landed.
    """
    numbered = pages.withColumn("page_id", F.col("landed_seq").cast("string"))
    bases = numbered.select("page_id", (F.col("url") if base_url is None else base_url).alias("base_url"))
    scripts = mk.linked_scripts(numbered, "page_id")
    items = materialise(extract_jsonld(scripts))
    discard(scripts.held)
    linked = items.filter("types is not null")
    # Other pages are tokenised, once, if they have microdata at all; only elements that carry some are kept.
    marked = numbered.select("page_id", "body").filter(F.contains(F.lower("body"), F.lit("itemprop")) | F.contains(F.lower("body"), F.lit("itemtype")))
    nodes = materialise(mk.elements(marked.join(linked.select("page_id"), "page_id", "left_anti"), "page_id", marked_only=True))
    plain = microdata_events(nodes, bases)
    events = jsonld_events(linked, bases).unionByName(plain)
    origin = numbered.select("page_id", "source_slug", "landed_seq", "url")
    joined = events.join(origin, "page_id")
    numbered_events = joined.withColumn("seq", position((F.col("landed_seq"), 0), (F.col("seq"), 56)))
    # Films and showings are both derived from the events; parsing again would cost more than a
    # table that is small next to the pages. What they were made of is not read again.
    found = materialise(numbered_events)
    discard(items, nodes)
    return found


def build_entities(events: DataFrame, cinema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(films, showings) of screenings, one film per source, page and normalised title: first
    filled value of each field in page order, distinct sorted times per date."""
    keyed = events.withColumn("title", tx.strip(F.col("title"))).withColumn("title_normalized", tx.normalize_title(F.col("title")))
    # Titles are normalised once: films, days and the films of the days are all derived from these rows.
    keyed = materialise(keyed.filter("title <> '' and title_normalized <> ''"))
    order = F.col("seq")
    first = lambda c: gr.first_filled(F.col(c), order).alias(c)
    films = keyed.groupBy("source_slug", "page_id", "title_normalized").agg(
        F.min_by("title", "seq").alias("title"), first("source_url"), first("poster"), first("description"), first("director"), first("duration"),
        gr.first_value(F.col("year"), order).alias("year"), gr.first_list(F.col("genres"), order).alias("genres"), first("location_name"), F.min("seq").alias("seq"),
    )
    films = films.withColumns({"duration": vl.iso_duration(F.col("duration")), "genres": F.coalesce("genres", F.array().cast("array<string>")), "source_poster": F.col("poster")})
    key = ["source_slug", "page_id", "title_normalized"]
    days = keyed.groupBy(*key, "date").agg(F.array_sort(F.collect_set(filled(F.col("time")))).alias("times"))
    place = F.lit(cinema) if cinema else F.coalesce("location_name", F.lit(""))
    showings = days.join(films.select(*key, "source_url", F.col("seq").alias("film_seq"), place.alias("cinema")), key)
    none = F.lit(None).cast("string")
    showings = showings.withColumns(
        {"seq": position((F.col("film_seq"), 0), (F.unix_date(F.col("date").try_cast("date")), 20)), "screen": none, "language": none, "session_attributes": F.array().cast("array<string>")}
    )
    return films.withColumn("poster", none).select(*FILM_FIELDS), showings.select(*SHOWING_FIELDS, "cinema")


def filter_to_dates(films: DataFrame, showings: DataFrame, dates: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Showings on the wanted dates, and the films left with one; no dates means no filter."""
    if dates is None:
        return films, showings
    kept = showings.filter(F.col("date").isin(dates))
    return films.join(kept.select("source_slug", F.col("film_seq").alias("seq")), ["source_slug", "seq"], "left_semi"), kept


def accumulate_by_key(films: DataFrame, showings: DataFrame, union: bool = False) -> tuple[DataFrame, DataFrame]:
    """One film per source and normalised title, as first seen; showings follow it.

    With ``union`` the times of one date, location and screen become one showing.
    """
    key = ["source_slug", "title_normalized"]
    firsts = materialise(films.groupBy(*key).agg(F.min("seq").alias("first_seq")))
    owner = films.join(firsts, key).select("source_slug", F.col("seq").alias("film_seq"), "first_seq")
    kept = films.join(firsts.select("source_slug", F.col("first_seq").alias("seq")), ["source_slug", "seq"], "left_semi")
    moved = showings.join(owner, ["source_slug", "film_seq"]).withColumn("film_seq", F.col("first_seq")).drop("first_seq")
    if union:
        places = ["cinema"] if "cinema" in moved.columns else []
        moved = moved.withColumns({"screen": F.coalesce("screen", F.lit("")), "showing_seq": F.col("seq")}).drop("seq")
        moved = gr.union_times(moved, "source_slug", "film_seq", "date", *places, "screen").withColumn("screen", filled(F.col("screen")))
        moved = moved.withColumnRenamed("showing_seq", "seq")
    return kept, moved.select(*showings.columns)


def page_fallback(primary: DataFrame, secondary: DataFrame, key: str = "source_slug") -> DataFrame:
    """Rows of the primary page; the secondary one only for sources the primary left empty."""
    return primary.unionByName(secondary.join(primary.select(key).distinct(), key, "left_anti"))


# ---- links ----------------------------------------------------------------------------


def discover_links(nodes: DataFrame, base_url: str, path_pattern: str) -> DataFrame:
    """(page_id, link, rank): links of a page to detail pages of the same site, in order of
    appearance, marked-up links first; a closing slash makes no difference."""
    # One pass over the elements: each is a marked-up link, an anchor, both or neither.
    link = lambda kind, wanted, raw: F.when(wanted, F.struct(F.lit(kind).alias("kind"), raw.alias("raw")))
    marked = link(0, mk.attr("itemprop") == "url", F.coalesce(mk.attr("content"), mk.attr("href")))
    anchor = link(1, (F.col("tag") == "a") & mk.attr("href").isNotNull(), mk.attr("href"))
    found = nodes.select("page_id", "eid", F.explode(F.array_compact(F.array(marked, anchor))).alias("l")).select("page_id", "eid", "l.*").withColumn("full", vl.absolute_url(tx.strip(F.col("raw")), F.lit(base_url + "/")))
    host = F.regexp_extract("full", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace("full", r"[?#].*$", "")
    path = F.regexp_replace(bare, r"^[^:]+://[^/]*", "")
    same = (host == F.regexp_extract(F.lit(base_url), r"://([^/?#]*)", 1)) & path.rlike(path_pattern)
    links = found.filter(same).withColumns({"link": bare, "bare": F.regexp_replace(bare, "/+$", "")})
    order = F.struct("kind", "eid")
    return links.groupBy("page_id", "bare").agg(F.min_by("link", order).alias("link"), F.min(order).alias("rank")).select("page_id", "link", "rank")


# ---- pushed scripts --------------------------------------------------------------------

DETAILS = "struct<regia:string,genere:string,durata:string,youtube_cover:struct<url:string>>"
SHOWS = "array<struct<date:string,orario:string,opzioni:string>>"


def extract_push_payload(pages: DataFrame, page_id: str = "url") -> tuple[DataFrame, DataFrame]:
    """(entries, shows) of pushed scripts, one entry per page and permalink.

    An entry may appear several times in the stream: details come from the first that has them,
    the synopsis is the fullest, and shows add up without repeating a date and time.
    """
    # Pages are read once: entries and shows both come from this table.
    raw = materialise(mk.push_entries(pages, page_id).filter(~F.contains("permalink", F.lit("/eventi/"))))
    details = F.from_json("details", DETAILS)
    read = raw.withColumns({"details": F.when(F.col("details") != "{}", details), "shows": F.from_json("shows", SHOWS)})
    key = ["page_id", "permalink"]
    shows = read.select(*key, "seq", F.posexplode("shows").alias("i", "show")).select(*key, "seq", "i", "show.*")
    shows = shows.groupBy(*key, "date", "orario").agg(F.min_by("opzioni", F.struct("seq", "i")).alias("opzioni"))
    # Entries without any show are left out, which their own rows tell; those of a page without address belong to none.
    entries = read.filter("page_id is not null").groupBy(*key).agg(
        F.min("seq").alias("seq"), F.min_by("title", "seq").alias("title"), F.min_by("slug", "seq").alias("slug"),
        gr.first_value(F.col("details"), F.col("seq")).alias("details"), tx.fullest(F.col("content"), F.col("seq")).alias("content"),
        F.max(F.coalesce(F.size("shows"), F.lit(0))).alias("_shows"),
    )
    return entries.filter("_shows > 0").drop("_shows"), shows


def drop_event_stubs(entries: DataFrame) -> DataFrame:
    """Leave out events with guests: by their path, or by a word of their title."""
    hints = "|".join(EVENT_HINTS)
    stub = F.contains(F.lower("permalink"), F.lit("/eventi/")) | F.lower("title").rlike(hints)
    return entries.filter(~stub)


def filter_shows(shows: DataFrame, dates: list[str], *keys: str) -> DataFrame:
    """Distinct sorted times per key and wanted ISO date; hidden shows and blank times go."""
    dated = shows.withColumn("iso", vl.compact_date(F.col("date")))
    kept = dated.filter(F.col("iso").isin(dates) & ~blank(F.col("orario")) & (F.coalesce("opzioni", F.lit("")) != "noprog"))
    return kept.groupBy(*keys, F.col("iso").alias("date")).agg(F.array_sort(F.collect_set("orario")).alias("times"))


def reconcile_two_sources(listing: DataFrame, detail: DataFrame, *keys: str) -> DataFrame:
    """Times of the listing, replaced by those of the detail page where the two disagree.

    Only dates of the listing count, and a detail page without any of them changes nothing. Both
    sides are (keys, date, times). Dates are compared one by one; no list per film is built.
    """
    ours = detail.join(listing.select(*keys, "date"), [*keys, "date"], "left_semi")
    both = listing.select(*keys, "date", F.col("times").alias("l_times")).join(
        ours.select(*keys, "date", F.col("times").alias("d_times")), [*keys, "date"], "left"
    )
    has_detail = ours.select(*keys).distinct().withColumn("_detail", F.lit(True))
    judged = both.join(has_detail, list(keys), "left")
    # Where the detail page knows the film, its dates are the truth: equal ones stay as they are.
    times = F.when(F.col("_detail"), F.col("d_times")).otherwise(F.col("l_times"))
    return judged.withColumn("times", times).filter("times is not null").select(*keys, "date", "times")


def detail_text(pages: DataFrame, nodes: DataFrame, page_id: str = "url") -> DataFrame:
    """(page_id, description): pushed synopsis of the page's own film, else the first paragraph
    of its article, else the meta description."""
    pushed = mk.push_entries(pages, page_id)
    own = F.regexp_extract(F.regexp_replace("page_id", "/+$", ""), r"([^/]+)$", 1)
    synopsis = pushed.filter(F.col("slug") == own).groupBy("page_id").agg(F.min_by("content", "seq").alias("pushed"))
    block = (F.col("tag") == "article") | mk.has_class("film-content") | mk.has_class("description")
    mark = mk.class_like("synopsis") | mk.has_class("synopsis") | mk.has_class("film-description")
    nodes = materialise(nodes.filter(block | mark | F.col("tag").isin("p", "meta")))
    inner = mk.within_any(nodes.filter("tag = 'p'").select("page_id", "eid", "text"), nodes.filter(block))
    paragraphs = inner.groupBy("page_id").agg(F.min_by("text", "eid").alias("paragraph"))
    metas = nodes.filter((F.col("tag") == "meta") & (mk.attr("name") == "description")).groupBy("page_id").agg(F.min_by(tx.strip(mk.attr("content")), "eid").alias("meta"))
    marked = nodes.filter(mark).groupBy("page_id").agg(F.min_by("text", "eid").alias("marked"))
    rows = pages.select(F.col(page_id).cast("string").alias("page_id")).distinct()
    for part in (synopsis, marked, paragraphs, metas):
        rows = rows.join(part, "page_id", "left")
    best = F.coalesce(*[filled(F.col(c)) for c in ("pushed", "marked", "paragraph", "meta")])
    return rows.select("page_id", best.alias("description"))


# ---- cards -----------------------------------------------------------------------------


def page_cards(nodes: DataFrame) -> DataFrame:
    """Cards of a listing page, first per slug: (page_id, slug, poster, title, director, link)."""
    # Pages are tokenised once: everything below reads the elements that cards are made of.
    nodes = materialise(nodes.filter(F.col("tag").isin("ul", "li", "a", "img", "h2", "p")))
    boxes = nodes.filter((F.col("tag") == "ul") & mk.has_class("movie-container")).select("page_id", F.col("eid").alias("parent"))
    cards = nodes.filter((F.col("tag") == "li") & mk.has_class("movie-item")).join(boxes, ["page_id", "parent"], "left_semi")
    tag, href = F.col("tag"), mk.attr("href")
    parts = {
        "link": ((tag == "a") & F.contains(href, F.lit("/films/")), href), "image": (tag == "img", mk.attr("src")),
        "title": (tag == "h2", F.col("text")), "director": (tag == "p", F.col("text")),
    }
    read = mk.first_inside(cards, nodes, parts).filter("link is not null")
    slug = F.regexp_extract(F.regexp_replace("link", "/+$", ""), r"([^/]+)$", 1)
    read = read.select("page_id", "eid", slug.alias("slug"), vl.clean_image_url(F.col("image")).alias("poster"), F.coalesce("title", slug).alias("title"), "director", "link")
    rest = ["poster", "title", "director", "link"]
    return read.groupBy("page_id", "slug").agg(*[F.min_by(c, "eid").alias(c) for c in rest], F.min("eid").alias("eid"))


def rendered_listing_cards(nodes: DataFrame, base_url: str, page_url: str, day: str) -> DataFrame:
    """Cards of a rendered listing: (page_id, eid, title, source_url, poster, date, times) for the
    current day, with or without times."""
    clock = mk.class_like("time") | mk.has_class("session-time") | mk.has_class("showtime")
    title = F.col("tag").isin("h2", "h3") | mk.has_class("film-title") | mk.class_like("title")
    card = mk.has_class("film-card") | mk.class_like("film")
    nodes = materialise(nodes.filter(clock | title | card | mk.has_class("showing-listing__list") | F.col("tag").isin("li", "a", "img")))
    lists = nodes.filter(mk.has_class("showing-listing__list")).select("page_id", F.col("eid").alias("parent"))
    items = nodes.filter("tag = 'li'").join(lists, ["page_id", "parent"], "left_semi")
    cards = items.unionByName(nodes.filter(card)).dropDuplicates(["page_id", "eid"])
    link = (F.col("tag") == "a") & F.contains(mk.attr("href"), F.lit("/film/"))
    parts = {"title": (title, F.col("text")), "href": (link, mk.attr("href")), "src": (F.col("tag") == "img", mk.attr("src"))}
    read = mk.first_inside(cards, nodes, parts).filter(~blank(F.col("title")))
    clocks = nodes.filter(clock & F.col("text").rlike(r"^\d{1,2}:\d{2}"))
    shown = mk.inside(clocks.select("page_id", "eid", "text"), cards.select("page_id", "eid", "end"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("eid", "text"))), lambda t: t["text"])
    times = shown.groupBy("page_id", F.col("o_eid").alias("eid")).agg(ordered.alias("times"))
    site = lambda c: F.when(c.startswith("http"), c).otherwise(vl.absolute_url(c, F.lit(base_url)))
    return read.join(times, ["page_id", "eid"], "left").select(
        "page_id", "eid", "title", F.coalesce(site(F.col("href")), F.lit(page_url)).alias("source_url"), site(F.col("src")).alias("poster"),
        F.lit(day).alias("date"), F.coalesce("times", F.array().cast("array<string>")).alias("times"),
    )
