"""Flattening of API payloads.

Every flattener takes landed payloads and returns (films, showings): one row per appearance of a
film, in order, and its showings linked by ``film_seq``. Shapes that vary between releases of an
API are read as variants, so a wrong type is a null and never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from playbill.functions import text as tx, values as vl
from playbill.schema import SEQ, blank, filled
from playbill.session import materialise
from playbill.sources.markup import in_frames

FILM_FIELDS = (
    "source_slug", "seq", "title", "title_normalized", "poster", "description", "genres", "source_poster", "duration", "director", "year",
)
SHOWING_FIELDS = ("source_slug", "film_seq", "seq", "date", "times", "screen", "source_url", "language", "session_attributes")


def position(*parts: tuple[Column, int]) -> Column:
    """Order number of a nested item: each part takes the given number of bits.

    A decimal has room for any number of landed bodies with any number of items.
    """
    number = parts[0][0].cast(SEQ)  # nothing is before the first part
    for part, bits in parts[1:]:
        number = (number * F.lit(2**bits).cast("decimal(20,0)") + part.cast(SEQ)).cast(SEQ)
    return number


def _text(value: Column, *paths: str) -> Column:
    """First non-empty text among several spellings of a field."""
    # An empty text has no character to match: one evaluation per path, where a comparison with
    # the empty string would take two.
    return F.coalesce(*[F.regexp_substr(F.try_variant_get(value, f"$.{p}", "string"), F.lit("(?s)^.+$")) for p in paths])


def _list(value: Column, path: str) -> Column:
    found = F.try_variant_get(value, f"$.{path}", "array<variant>")
    return F.when(F.size(found) > 0, found)


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _site_url(url: Column, base_url: str) -> Column:
    return F.when(url.startswith("http"), url).otherwise(vl.absolute_url(url, F.lit(base_url)))


#: What is read of a session payload, in one pass over it; what has another shape is null.
_SESSION = "struct<startTime:string,showTime:string,screenName:string,attributes:array<struct<name:string,value:string,attributeType:string>>>"
_SESSION_FILM = (
    "struct<filmUrl:string,filmId:string,runningTime:string,isDurationUnknown:boolean,filmTitle:string,title:string,posterImageSrc:string,panelImageUrl:string,"
    f"synopsisShort:string,synopsis:string,genres:variant,director:string,showingGroups:array<struct<date:string,sessions:array<{_SESSION}>>>>"
)


def flatten_session_api(payloads: DataFrame, base_url: str, cinema_url: str) -> tuple[DataFrame, DataFrame]:
    """Films → groups by date → sessions → attributes. One showing per session with a time."""
    # Intermediate values get columns of their own, so that each is computed once per row.
    listed = payloads.select("source_slug", "landed_seq", F.try_parse_json("body").alias("root"), F.lit(None).cast(f"array<{_SESSION_FILM}>").alias("films"))
    for path in ("result", "films", "result.films", "result.items", "films.films", "films.items"):
        # The first list with items counts; the next path is only read if there was none.
        tried = F.when(F.size("films") > 0, F.col("films")).otherwise(F.try_variant_get("root", f"$.{path}", f"array<{_SESSION_FILM}>"))
        listed = listed.withColumn("films", tried)
    # The outer forms of explode: for the others the planner adds filters that would read every list again.
    rows = listed.select("source_slug", "landed_seq", F.posexplode_outer("films").alias("i", "film"))
    said = lambda row, *fields: F.coalesce(*[filled(F.col(row)[f]) for f in fields])
    film = F.col("film")
    film_id = said("film", "filmId")
    fallback = F.when(film_id.isNotNull(), F.concat(F.lit(f"{base_url}/film/"), film_id)).otherwise(F.lit(cinema_url))
    minutes = said("film", "runningTime")
    unknown = F.coalesce(film["isDurationUnknown"], F.lit(False))
    rows = rows.select(
        "source_slug",
        position((F.col("landed_seq"), 0), (F.col("i"), 24)).alias("seq"),
        said("film", "filmTitle", "title").alias("title"),
        said("film", "filmUrl").alias("link"),
        fallback.alias("fallback"),
        said("film", "posterImageSrc", "panelImageUrl").alias("image"),
        said("film", "synopsisShort", "synopsis").alias("description"),
        F.when((minutes != "0") & ~unknown, F.concat(minutes, F.lit(" min"))).alias("duration"),
        vl.variant_genres(film["genres"]).alias("genres"),
        filled(tx.strip(said("film", "director"))).alias("director"),
        film["showingGroups"].alias("groups"),
    ).filter("title is not null")
    rows = rows.withColumns(
        {
            "title_normalized": tx.normalize_title(F.col("title")),
            "url": F.coalesce(_site_url(F.col("link"), base_url), "fallback"),
            "poster": _site_url(F.col("image"), base_url),
        }
    )
    # Bodies are parsed once: films and showings both come from this table.
    rows = materialise(rows)
    films_out = rows.withColumns({"source_poster": F.col("poster"), "year": F.lit(None).cast("int")}).select(*FILM_FIELDS)

    groups = rows.select("source_slug", "seq", "url", F.posexplode_outer("groups").alias("g", "group"))
    groups = groups.select("source_slug", "seq", "url", "g", vl.start_date(said("group", "date")).alias("date"), F.col("group")["sessions"].alias("sessions"))
    sessions = groups.select("source_slug", "seq", "url", "g", "date", F.posexplode_outer("sessions").alias("k", "session")).filter("date is not null")
    sessions = sessions.withColumn("start", said("session", "startTime", "showTime"))
    start = F.col("start")
    plain = F.when(start.rlike(r"^\d{1,2}:\d{2}"), F.substring(start, 1, 5))
    # Anything but an object has no name and is left out below.
    attributes = F.transform(
        F.coalesce(F.col("session")["attributes"], F.array().cast("array<struct<name:string,value:string,attributeType:string>>")),
        lambda a: F.struct(F.coalesce(filled(a["name"]), filled(a["value"])).alias("name"), filled(a["attributeType"]).alias("kind")),
    )
    read = sessions.select(
        "source_slug", F.col("seq").alias("film_seq"), position((F.col("seq"), 0), (F.col("g"), 24), (F.col("k"), 24)).alias("seq"), "date",
        F.coalesce(vl.start_time(start), plain).alias("time"), said("session", "screenName").alias("screen"), F.col("url").alias("source_url"),
        F.filter(attributes, lambda a: a["name"].isNotNull()).alias("named"),
    ).filter("time is not null")
    languages = F.filter("named", lambda a: a["kind"] == "Language")
    showings = read.withColumns(
        {
            "times": F.array("time"),
            "language": F.try_element_at(F.transform(languages, lambda a: a["name"]), F.lit(1)),
            "session_attributes": F.transform("named", lambda a: a["name"]),
        }
    )
    return films_out, showings.select(*SHOWING_FIELDS)


#: What is read of a programming payload, in one pass over it; only the screen of a variant may be a text or an object.
_PERFORMANCE = "struct<day:string,actual_start_at:string>"
_PROGRAMMED_FILM = (
    "struct<not_today:boolean,slug:string,poster:string,top_image:string,title:string,description:string,genres:variant,"
    f"screens:array<map<string,array<struct<screen:variant,language:struct<name:string>,performances:array<{_PERFORMANCE}>>>>>>"
)


def flatten_programming_api(payloads: DataFrame, base_url: str) -> tuple[DataFrame, DataFrame]:
    """Films → formats → variants → performances of the requested date.

    Films flagged as not shown that day, or left without variants, are dropped; a variant whose
    performances all fall on other days stays as a showing without times.
    """
    said = lambda row, *fields: F.coalesce(*[filled(F.col(row)[f]) for f in fields])
    parsed = payloads.select("source_slug", "landed_seq", "target_date", F.try_variant_get(F.try_parse_json("body"), "$.data", f"array<{_PROGRAMMED_FILM}>").alias("movies"))
    # The outer forms of explode: for the others the planner adds filters that would read every list again.
    rows = parsed.select("source_slug", "landed_seq", "target_date", F.posexplode_outer("movies").alias("i", "film"))
    film = F.col("film")
    slug = said("film", "slug")
    poster = said("film", "poster", "top_image")
    rows = rows.select(
        "source_slug",
        "target_date",
        position((F.col("landed_seq"), 0), (F.col("i"), 24)).alias("seq"),
        said("film", "title").alias("title"),
        F.coalesce(F.concat(F.lit(f"{base_url}/film/"), slug, F.lit("/")), F.lit(base_url)).alias("url"),
        F.when(poster.startswith("http"), poster).alias("poster"),
        said("film", "description").alias("raw_description"),
        vl.variant_genres(film["genres"]).alias("genres"),
        film["screens"].alias("screens"),
        F.coalesce(film["not_today"], F.lit(False)).alias("absent"),
    ).filter("not absent and title is not null").drop("absent")
    # Bodies are parsed once: films and showings both come from this table.
    rows = materialise(rows.withColumn("title_normalized", tx.normalize_title(F.col("title"))))

    formats = rows.select("source_slug", "target_date", "seq", "url", F.posexplode_outer("screens").alias("g", "group"))
    named = formats.select("source_slug", "target_date", "seq", "url", "g", F.posexplode_outer("group").alias("f", "format", "list"))
    variants = named.select("source_slug", "target_date", "seq", "url", "g", "f", "format", F.posexplode_outer("list").alias("k", "variant"))
    variants = variants.filter("variant is not null")
    variant = F.col("variant")
    on = variant["screen"]
    screen_object = F.try_variant_get(on, "$", "map<string,variant>").isNotNull() | filled(F.try_variant_get(on, "$", "string")).isNull()
    screen = F.when(screen_object, F.try_variant_get(on, "$.name", "string")).otherwise(F.col("format"))
    wanted = F.filter(
        F.coalesce(variant["performances"], F.array().cast(f"array<{_PERFORMANCE}>")),
        lambda p: F.coalesce(filled(p["day"]) == F.col("target_date"), F.lit(True)),
    )
    starts = F.filter(F.transform(wanted, lambda p: filled(p["actual_start_at"])), lambda t: t.isNotNull())
    showings = variants.select(
        "source_slug", F.col("seq").alias("film_seq"), position((F.col("seq"), 0), (F.col("g"), 20), (F.col("f"), 20), (F.col("k"), 20)).alias("seq"),
        F.col("target_date").alias("date"), F.array_sort(starts).alias("times"), screen.alias("screen"), F.col("url").alias("source_url"),
        variant["language"]["name"].alias("language"),
        F.when(~blank(F.col("format")) & ~F.col("format").eqNullSafe(screen), F.array("format")).otherwise(F.array().cast("array<string>")).alias("session_attributes"),
    )
    films = rows.join(showings.select(F.col("film_seq").alias("seq")), "seq", "left_semi")
    films = films.withColumns(
        {
            "description": filled(tx.strip_html(F.col("raw_description"))),
            "source_poster": F.col("poster"),
            "duration": F.lit(None).cast("string"),
            "director": F.lit(None).cast("string"),
            "year": F.lit(None).cast("int"),
        }
    )
    return films.select(*FILM_FIELDS), showings.select(*SHOWING_FIELDS)


def find_nodes_with_key(payloads: DataFrame, key: str) -> DataFrame:
    """(source_slug, url, node_seq, node): objects that hold a key, at any depth, as JSON text.

    The walk stops at a match. Payload shapes differ in depth, hence one small function per body
    rather than a fixed number of explodes. Bodies that are no JSON, or nested too deeply to read, hold no node.
    """

    def walk(tree) -> Iterator[dict]:
        todo = [tree]
        while todo:
            node = todo.pop()
            if isinstance(node, dict) and key in node:
                yield node
            elif isinstance(node, (dict, list)):
                todo += reversed(list(node.values()) if isinstance(node, dict) else node)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for slug, url, body in zip(batch["source_slug"], batch["url"], batch["body"]):
                try:
                    yield from [(slug, url, n, json.dumps(node)) for n, node in enumerate(walk(json.loads(body)))]
                except (TypeError, ValueError, RecursionError):
                    continue

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_frames(found(batches), ["source_slug", "url", "node_seq", "node"], {})

    return payloads.select("source_slug", "url", "body").mapInPandas(rows, "source_slug string, url string, node_seq bigint, node string")


def resolve_venues(sources: DataFrame, venues: DataFrame) -> DataFrame:
    """Current venue id of each configured source, else the configured one.

    ``sources`` is (source_slug, name, cinema_url, venue_id); ``venues`` is (node_seq, node) with
    ``cinemaId``, ``cinemaName`` and ``whatsOnUrl``. A venue matches when its short name is part
    of the public name, or its link holds the city of the public page.
    """
    node = F.try_parse_json("node")
    read = venues.select(
        "node_seq",
        _text(node, "cinemaId").try_cast("bigint").alias("found_id"),
        F.lower(tx.strip(_text(node, "cinemaName"))).alias("short_name"),
        F.split(F.lower(F.coalesce(_text(node, "whatsOnUrl"), F.lit(""))), "/").alias("segments"),
    ).filter("found_id is not null")
    # Every part of a public name is spelled out, so that "is contained in" is an equi-join.
    name = F.lower("name")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length(name)),
            lambda start: F.transform(F.sequence(F.lit(1), F.length(name) - start + 1), lambda size: F.substr(name, start, size)),
        )
    )
    by_name = sources.select("source_slug", F.explode(F.array_distinct(spans)).alias("short_name")).join(read, "short_name")
    city = filled(F.lower(F.regexp_extract("cinema_url", r"^[^:]+://[^/]+/cinema/([^/?#]+)", 1)))
    # The link must have the city between two slashes: neither its first nor its last segment.
    inner = F.slice("segments", F.lit(2), F.greatest(F.size("segments") - 2, F.lit(0)))
    by_city = sources.select("source_slug", city.alias("city")).join(read.select("node_seq", "found_id", F.explode(inner).alias("city")), "city")
    columns = ["source_slug", "node_seq", "found_id"]
    best = by_name.select(*columns).unionByName(by_city.select(*columns)).groupBy("source_slug").agg(F.min_by("found_id", "node_seq").alias("found_id"))
    return sources.join(best, "source_slug", "left").withColumn("venue_id", F.coalesce("found_id", "venue_id")).drop("found_id")


# ---- knowledge base -------------------------------------------------------------------

IMAGE_FOLDER = "https://commons.wikimedia.org/wiki/Special:FilePath/"


def candidate_entities(hits: DataFrame) -> DataFrame:
    """(lookup_key, entity_id): the best-ranked hit of each lookup that describes a film."""
    described = F.lower("description")
    films = hits.filter(F.contains(described, F.lit("film")) | F.contains(described, F.lit("movie")))
    return films.groupBy("lookup_key").agg(F.min_by("entity_id", "rank").alias("entity_id"))


def flatten_knowledge_entities(dump: DataFrame) -> DataFrame:
    """Films of an entity dump (entity_id, body), directors named through a self join."""
    entity = F.try_parse_json("body")
    value = lambda claim: F.try_variant_get(entity, f"$.claims.{claim}[0].mainsnak.datavalue.value", "variant")
    scalar = lambda v: F.when(F.try_variant_get(v, "$", "map<string,variant>").isNull(), filled(F.try_variant_get(v, "$", "string")))
    people = F.filter(
        F.transform(
            F.try_variant_get(entity, "$.claims.P57", "array<variant>"),
            lambda c: F.struct(
                F.try_variant_get(c, "$.mainsnak.datavalue.value", "map<string,variant>").isNotNull().alias("named"),
                F.try_variant_get(c, "$.mainsnak.datavalue.value.id", "string").alias("id"),
            ),
        ),
        lambda p: p["named"],
    )
    label = lambda lang: filled(F.try_variant_get(entity, f"$.labels.{lang}.value", "string"))
    description = F.coalesce(*[F.try_variant_get(entity, f"$.descriptions.{lang}.value", "string") for lang in ("it", "en")])
    minutes = scalar(value("P2047")).try_cast("double").cast("int")
    read = dump.select(
        "entity_id",
        F.concat(F.lit(IMAGE_FOLDER), scalar(value("P18"))).alias("poster"),
        F.try_element_at(F.transform(people, lambda p: p["id"]), F.lit(1)).alias("director_id"),
        F.concat(minutes.cast("string"), F.lit(" min")).alias("duration"),
        F.regexp_extract(F.try_variant_get(value("P577"), "$.time", "string"), r"[+-]?(\d{4})", 1).try_cast("int").alias("year"),
        F.coalesce(label("it"), label("en")).alias("title"),
        F.when(F.lower(label("en")) != F.lower(label("it")), label("en")).alias("original_title"),
        description.alias("description"),
    )
    people_names = read.select(F.col("entity_id").alias("director_id"), F.col("title").alias("director"))
    return read.join(people_names, "director_id", "left").drop("director_id").withColumn("wikidata_id", F.col("entity_id"))


def build_dimension(worklist: DataFrame, hits: DataFrame, dump: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Reference table of lookups, hits and misses alike, added to what was known."""
    fields = ["poster", "description", "director", "duration", "original_title", "wikidata_id", "year"]
    entities = flatten_knowledge_entities(dump).select("entity_id", *fields)
    looked = worklist.select("lookup_key").join(candidate_entities(hits), "lookup_key", "left").join(entities, "entity_id", "left")
    fresh = looked.select("lookup_key", F.col("wikidata_id").isNotNull().alias("found"), *fields)
    return fresh if known is None else known.unionByName(fresh)
