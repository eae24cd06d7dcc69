"""Queries of the published API, and the grouping operators under them."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from playbill.catalog import sql
from playbill.catalog.bindings import Data
from playbill.catalog.registry import Registry
from playbill.operators import grouping as gr, joins as jn
from playbill.plans import search_index as si
from playbill.session import checkpoint_root

DAY, QUERY = "1998-03-02", "bolt"
registry = Registry()
query = registry.query
FILM = ["id", "title", "year", "genres", "director"]


def joined(column: str, by: str = ",") -> Column:
    return F.array_join(column, by).alias(column)


@query("films_today", f"""{sql.STORE} SELECT id, title, year, genres, director FROM films f WHERE removed_at IS NULL AND EXISTS
 (SELECT 1 FROM showings s WHERE s.film_id = f.id AND s.removed_at IS NULL AND s.date = DATE '{DAY}')""")
def _(d: Data) -> DataFrame:
    return d.listing.films_today(DAY).select(*FILM)


@query("films_this_week", f"""{sql.STORE} SELECT id, title, year, genres, director FROM films f WHERE removed_at IS NULL AND EXISTS
 (SELECT 1 FROM showings s WHERE s.film_id = f.id AND s.removed_at IS NULL AND s.date BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 6)""")
def _(d: Data) -> DataFrame:
    return d.listing.films_this_week(DAY).select(*FILM)


@query("films_in_range", f"""{sql.STORE} SELECT id, title, year, genres, director FROM films f WHERE removed_at IS NULL AND EXISTS
 (SELECT 1 FROM showings s WHERE s.film_id = f.id AND s.removed_at IS NULL AND s.date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30')""")
def _(d: Data) -> DataFrame:
    return d.listing.films_between("1997-01-01", "1997-06-30").select(*FILM)


@query("active_showings", f"""{sql.STORE}, {sql.ACTIVE} SELECT cinema_slug, language, count(*) AS showings, count(DISTINCT film_id) AS films FROM active GROUP BY ALL""")
def _(d: Data) -> DataFrame:
    active = jn.active_showings(d.showings, d.films)
    return active.groupBy("cinema_slug", "language").agg(F.count("*").alias("showings"), F.count_distinct("film_id").alias("films"))


_SCHEDULE = """SELECT s.id, CAST(s.date AS VARCHAR) AS date, s.clock AS times, s.language, s.screen, f.title, c.name, c.city
 FROM showings s JOIN films f ON f.id = s.film_id AND f.removed_at IS NULL JOIN cinemas c ON c.slug = s.cinema_slug WHERE s.removed_at IS NULL"""


def _schedule(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("date").cast("string").alias("date"), joined("times"), "language", "screen", "film.title", "cinema.name", "cinema.city")


@query("showings_on_date", f"{sql.STORE} {_SCHEDULE} AND s.date = DATE '{DAY}'")
def _(d: Data) -> DataFrame:
    return _schedule(d.listing.showings_on(DAY))


@query("cinema_schedule", f"{sql.STORE} {_SCHEDULE} AND s.cinema_slug = 's7' AND s.date BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 7")
def _(d: Data) -> DataFrame:
    return _schedule(d.listing.cinema_schedule("s7", DAY))


@query("schedule_range", f"{sql.STORE} {_SCHEDULE} AND s.date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
def _(d: Data) -> DataFrame:
    return _schedule(d.listing.schedule("1998-01-01", "1998-12-31"))


_BOARD = f"""{sql.STORE}, {sql.ACTIVE} SELECT f.id, f.title, string_agg(DISTINCT c.name, '|' ORDER BY c.name) AS cinema_names,
 string_agg(DISTINCT c.slug, '|' ORDER BY c.slug) AS cinema_slugs FROM active s JOIN films f ON f.id = s.film_id JOIN cinemas c ON c.slug = s.cinema_slug
 WHERE s.date = DATE '{DAY}' GROUP BY f.id, f.title"""


def _board(rows: DataFrame) -> DataFrame:
    return rows.select("id", "title", joined("cinema_names", "|"), joined("cinema_slugs", "|"))


@query("daily_board", _BOARD)
def _(d: Data) -> DataFrame:
    return _board(d.listing.daily_board(DAY))


@query("featured_films", f"{_BOARD} ORDER BY f.title, f.id LIMIT 6")
def _(d: Data) -> DataFrame:
    return _board(d.listing.featured(DAY))


@query("board_of_cinema", f"{_BOARD} HAVING bool_or(s.cinema_slug = 's3')")
def _(d: Data) -> DataFrame:
    return _board(d.listing.daily_board(DAY, "s3"))


@query("films_with_cinemas", f"""{sql.STORE} SELECT film_id, string_agg(DISTINCT c.name, '|' ORDER BY c.name) AS cinema_names,
 string_agg(DISTINCT c.slug, '|' ORDER BY c.slug) AS cinema_slugs FROM showings s JOIN cinemas c ON c.slug = s.cinema_slug GROUP BY film_id""")
def _(d: Data) -> DataFrame:
    return gr.films_with_cinemas(d.showings, d.cinemas).select("film_id", joined("cinema_names", "|"), joined("cinema_slugs", "|"))


_TIMES = """SELECT s.film_id, CAST(s.date AS VARCHAR) AS date, s.cinema_slug AS slug, c.name,
 string_agg(s.clock || '/' || s.screen || '/' || s.language || '/' || coalesce(s.buy_url, ''), '|'
   ORDER BY s.clock, s.screen, s.language, s.buy_url NULLS FIRST) AS entries
 FROM {0} s JOIN cinemas c ON c.slug = s.cinema_slug {1} GROUP BY ALL"""


def _times(rows: DataFrame) -> DataFrame:
    text = F.transform("entries", lambda e: F.concat_ws("/", e["time"], e["screen"], e["language"], F.coalesce(e["buy_url"], F.lit(""))))
    return rows.select("film_id", F.col("date").cast("string").alias("date"), "slug", "name", F.array_join(text, "|").alias("entries"))


@query("showtimes_by_cinema", f"{sql.STORE} {_TIMES.format('showings', '')}")
def _(d: Data) -> DataFrame:
    return _times(gr.showtimes_by_cinema(d.showings, d.cinemas))


@query("showtimes_of_film", f"{sql.STORE}, {sql.ACTIVE} {_TIMES.format('active', f'''WHERE s.film_id = 6 AND s.date = DATE '1996-11-18' ''')}")
def _(d: Data) -> DataFrame:
    return _times(d.listing.showtimes(6, '1996-11-18'))


@query("search_films", f"""{sql.STORE} SELECT id, title, year, genres, director FROM films WHERE removed_at IS NULL AND contains(title_normalized, '{QUERY}')
 ORDER BY title, id LIMIT 20""")
def _(d: Data) -> DataFrame:
    return d.listing.search(f" {QUERY.upper()}! ").select(*FILM)


_NEEDLES = [QUERY, "blue bolt", "bo", "no such film", "steel"]


@query("search_films_indexed", f"""{sql.STORE}, n AS (SELECT unnest({_NEEDLES}) AS needle)
 SELECT needle, id, title, year FROM (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY title, id) AS k FROM films, n
  WHERE removed_at IS NULL AND contains(title_normalized, needle)) WHERE k <= 20""")
def _(d: Data) -> DataFrame:
    root = f"{checkpoint_root(d.spark)}/playbill/{uuid.uuid4().hex}"
    si.update_index(d.films.filter("id % 2 = 0"), root)
    si.update_index(d.films, root)
    listing = replace(d.listing, index=root)
    found = [listing.search(n).select(F.lit(n).alias("needle"), "id", "title", "year") for n in _NEEDLES]
    return reduce(DataFrame.unionByName, found)


@query("search_with_cinemas", f"""{sql.STORE}, {sql.ACTIVE}, found AS (SELECT * FROM films WHERE removed_at IS NULL AND contains(title_normalized, 'blue {QUERY}')
 ORDER BY title, id LIMIT 50) SELECT f.id, f.title, coalesce(string_agg(DISTINCT c.name, '|' ORDER BY c.name), '') AS cinema_names FROM found f
 LEFT JOIN active s ON s.film_id = f.id AND s.date BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 7 LEFT JOIN cinemas c ON c.slug = s.cinema_slug GROUP BY f.id, f.title""")
def _(d: Data) -> DataFrame:
    return d.listing.search_with_cinemas(f"blue {QUERY}", DAY, 50).select("id", "title", joined("cinema_names", "|"))


_DETAIL = """SELECT f.id, f.title, coalesce(string_agg(CAST(s.date AS VARCHAR) || ' ' || s.id || ' ' || s.cinema_slug || ' ' || s.clock, '|'
   ORDER BY s.date, s.id, s.cinema_slug, s.clock), '') AS showings
 FROM films f LEFT JOIN showings s ON s.film_id = f.id AND s.removed_at IS NULL AND s.date >= DATE '{0}' WHERE f.removed_at IS NULL {1} GROUP BY f.id, f.title"""


def _detail(rows: DataFrame) -> DataFrame:
    text = F.transform("showings", lambda s: F.concat_ws(" ", s["date"].cast("string"), s["showing_id"].cast("string"), s["cinema_slug"], F.array_join(s["times"], ",")))
    return rows.select("id", "title", F.array_join(text, "|").alias("showings"))


@query("film_details", f"""{sql.STORE} SELECT f.id, f.title, CAST(s.date AS VARCHAR) AS date, s.cinema_slug, s.clock AS times FROM films f
 LEFT JOIN showings s ON s.film_id = f.id AND s.removed_at IS NULL AND s.date >= DATE '2001-01-01' WHERE f.removed_at IS NULL""")
def _(d: Data) -> DataFrame:
    rows = d.listing.film_details(d.films, "2001-01-01")
    return rows.select("id", "title", F.col("showing.date").cast("string").alias("date"), "showing.cinema_slug", F.array_join("showing.times", ",").alias("times"))


@query("film_detail", f"{sql.STORE} {_DETAIL.format(DAY, 'AND f.id = 6')}")
def _(d: Data) -> DataFrame:
    return _detail(d.listing.film_detail(6, DAY))


@query("cinema_list", f"{sql.STORE} SELECT slug, name, city, address, region, lat, lon, website, maps_place_url FROM cinemas")
def _(d: Data) -> DataFrame:
    return d.listing.cinema_list().drop("phone")


@query("cinemas_with_count", f"""{sql.STORE}, {sql.ACTIVE} SELECT c.slug, c.name, count(s.id) AS showings_count FROM cinemas c
 LEFT JOIN active s ON s.cinema_slug = c.slug AND s.date >= DATE '{DAY}' GROUP BY c.slug, c.name""")
def _(d: Data) -> DataFrame:
    return d.listing.cinemas_with_count(DAY).select("slug", "name", "showings_count")


@query("point_lookups", f"""{sql.STORE} SELECT 'film' AS kind, CAST(id AS VARCHAR) AS key, title AS label FROM films WHERE id = 6 AND removed_at IS NULL
 UNION ALL SELECT 'cinema', slug, name FROM cinemas WHERE slug = 's3'""")
def _(d: Data) -> DataFrame:
    film = d.listing.film(6).select(F.lit("film").alias("kind"), F.col("id").cast("string").alias("key"), F.col("title").alias("label"))
    return film.unionByName(d.listing.cinema("s3").select(F.lit("cinema").alias("kind"), F.col("slug").alias("key"), F.col("name").alias("label")))


@query("bulk_lookup", f"""{sql.STORE} SELECT id, title FROM films WHERE removed_at IS NULL AND id IN (SELECT film_id FROM showings WHERE language = 'R')""")
def _(d: Data) -> DataFrame:
    keys = d.showings.filter("language = 'R'").select(F.col("film_id").alias("id"))
    return d.listing.lookup("films", keys, "id").select("id", "title")


@query("freshness", f"""{sql.STORE}, l AS (SELECT max(scraped_on) AS latest, count(*) AS showings FROM showings)
 SELECT CAST(latest AS VARCHAR) AS latest, round(date_diff('minute', CAST(latest AS TIMESTAMP), TIMESTAMP '2001-12-01 07:30:00') / 60.0, 2) AS age_hours,
 date_diff('minute', CAST(latest AS TIMESTAMP), TIMESTAMP '2001-12-01 07:30:00') / 60.0 > 36 AS is_stale, showings, (SELECT count(*) FROM cinemas) AS cinemas FROM l""")
def _(d: Data) -> DataFrame:
    row = d.listing.freshness("2001-12-01 07:30:00")
    return row.select(F.to_date("latest_scraped_at").cast("string").alias("latest"), "age_hours", "is_stale", "showings", "cinemas")


@query("dataset_counts", f"""{sql.STORE} SELECT (SELECT count(*) FROM cinemas) AS cinemas, (SELECT count(*) FROM films) AS films, count(*) AS showings,
 CAST(max(scraped_on) AS VARCHAR) AS latest FROM showings""")
def _(d: Data) -> DataFrame:
    row = d.listing.dataset_counts()
    return row.select("cinemas", "films", "showings", F.to_date("latest_scraped_at").cast("string").alias("latest"))


@query("available_dates", f"{sql.STORE} SELECT DISTINCT CAST(date AS VARCHAR) AS date FROM showings")
def _(d: Data) -> DataFrame:
    return gr.available_dates(d.showings).select(F.col("date").cast("string").alias("date"))


@query("film_dates", f"""{sql.STORE}, {sql.ACTIVE} SELECT DISTINCT CAST(date AS VARCHAR) AS date FROM active WHERE film_id = 6 AND date BETWEEN DATE '1996-11-15' AND DATE '1996-11-15' + 6""")
def _(d: Data) -> DataFrame:
    return d.listing.film_dates(6, '1996-11-15').select(F.col("date").cast("string").alias("date"))


@query("count_active_in_window", f"""{sql.STORE} SELECT cinema_slug, count(*) AS existing FROM showings WHERE removed_at IS NULL
 AND date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' GROUP BY cinema_slug""")
def _(d: Data) -> DataFrame:
    return gr.count_active_in_window(d.showings, F.lit("1998-01-01").cast("date"), F.lit("1998-03-31").cast("date"))


@query("showing_counts", f"{sql.STORE} SELECT film_id, count(*) AS showing_count FROM showings GROUP BY film_id")
def _(d: Data) -> DataFrame:
    return gr.showing_counts(d.showings)


@query("programme_report", f"""{sql.STORE} SELECT s.cinema_slug, f.title, s.film_id, CAST(s.date AS VARCHAR) AS date, string_agg(DISTINCT s.clock, ',' ORDER BY s.clock) AS times,
 CASE s.cinema_slug WHEN 's2' THEN 1 WHEN 's1' THEN 2 ELSE 2147483648 END AS rank FROM showings s JOIN films f ON f.id = s.film_id
 WHERE f.removed_at IS NULL AND s.date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31' GROUP BY ALL""")
def _(d: Data) -> DataFrame:
    films = d.films.select(F.col("id").alias("film_id"), "title", F.when(F.col("removed_at").isNull(), "in_programmazione").otherwise("rimosso").alias("status"))
    report = gr.programme_report(films, d.showings, "1998-03-01", "1998-03-31", order=["s2", "s1"])
    return report.select("cinema_slug", "title", "film_id", F.col("date").cast("string").alias("date"), joined("times"), "rank")


@query("programme_totals", f"""{sql.STORE} SELECT cinema_slug, count(DISTINCT film_id) AS films FROM showings GROUP BY cinema_slug""")
def _(d: Data) -> DataFrame:
    films = d.films.select(F.col("id").alias("film_id"), "title", F.lit("x").alias("status"))
    return gr.programme_totals(gr.programme_report(films, d.showings, all_status=True))


_RAW = f"""raw AS (SELECT l_orderkey AS owner, 's' || l_suppkey AS cinema_slug, 'c' || l_suppkey AS cinema, CAST(l_shipdate AS DATE) AS date, {sql.CLOCK} AS clock,
 CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS language, CASE WHEN l_linestatus <> 'O' THEN l_linestatus END AS screen, l_linenumber AS showing_seq,
 CASE WHEN l_tax < 0.04 THEN 'u' || l_partkey END AS source_url, l_partkey FROM lineitem)"""


def _raw(d: Data) -> DataFrame:
    """Raw showings as sources send them: several rows per slot, empty texts for missing ones."""
    blank = lambda c, v: F.when(F.col(c) != v, F.col(c)).otherwise("")
    line = d.table("lineitem")
    return line.select(
        F.col("l_orderkey").alias("owner"), F.concat(F.lit("s"), "l_suppkey").alias("cinema_slug"), F.concat(F.lit("c"), "l_suppkey").alias("cinema"),
        F.to_date("l_shipdate").alias("date"),
        F.array(F.concat_ws(":", F.lpad((F.col("l_linenumber") + 14).cast("string"), 2, "0"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0")), F.lit("")).alias("times"),
        blank("l_returnflag", "N").alias("language"), blank("l_linestatus", "O").alias("screen"), F.col("l_linenumber").alias("showing_seq"),
        F.when(F.col("l_tax") < 0.04, F.concat(F.lit("u"), "l_partkey")).alias("source_url"), F.array(F.col("l_linestatus"), F.lit("A")).alias("session_attributes"), "l_partkey",
    )


@query("consolidate_showings", f"""WITH {_RAW} SELECT l_partkey, cinema, cinema_slug, CAST(date AS VARCHAR) AS date, language, screen,
 string_agg(DISTINCT clock, ',' ORDER BY clock) AS times, min(showing_seq) AS showing_seq FROM raw GROUP BY ALL""")
def _(d: Data) -> DataFrame:
    merged = gr.consolidate_showings(_raw(d), "l_partkey")
    return merged.select("l_partkey", "cinema", "cinema_slug", F.col("date").cast("string").alias("date"), "language", "screen", joined("times"), "showing_seq")


@query("merge_showings_per_key", f"""WITH {_RAW} SELECT cinema_slug, CAST(date AS VARCHAR) AS date, string_agg(DISTINCT clock, ',' ORDER BY clock) AS times,
 CASE WHEN count(DISTINCT screen) = 1 THEN min(screen) END AS screen, count(*) > 0 AS any FROM raw GROUP BY cinema_slug, date""")
def _(d: Data) -> DataFrame:
    merged = gr.merge_showings_per_key(_raw(d).withColumn("buy_url", F.lit("")), "cinema_slug", "date")
    return merged.select("cinema_slug", F.col("date").cast("string").alias("date"), joined("times"), "screen", F.lit(True).alias("any"))


@query("first_filled_values", f"""WITH {_RAW} SELECT owner, arg_min(language, CAST(showing_seq AS BIGINT) * 1000000000 + l_partkey) FILTER (language IS NOT NULL) AS language,
 arg_min(source_url, CAST(showing_seq AS BIGINT) * 1000000000 + l_partkey) FILTER (source_url IS NOT NULL) AS source_url FROM raw GROUP BY owner""")
def _(d: Data) -> DataFrame:
    order = F.struct("showing_seq", "l_partkey")
    return _raw(d).groupBy("owner").agg(gr.first_filled(F.col("language"), order).alias("language"), gr.first_filled(F.col("source_url"), order).alias("source_url"))


@query("union_times", f"""WITH {_RAW} SELECT cinema_slug, language, CAST(date AS VARCHAR) AS date, string_agg(DISTINCT clock, ',' ORDER BY clock) AS times,
 min(showing_seq) AS showing_seq FROM (SELECT * REPLACE (coalesce(language, '') AS language) FROM raw) GROUP BY ALL""")
def _(d: Data) -> DataFrame:
    rows = _raw(d).select("cinema_slug", "language", "date", "times", "showing_seq")
    return gr.union_times(rows, "cinema_slug", "language", "date").select("cinema_slug", "language", F.col("date").cast("string").alias("date"), joined("times"), "showing_seq")


@query("event_slots", """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, string_agg(DISTINCT strftime(ts, '%H:%M'), ',' ORDER BY strftime(ts, '%H:%M')) AS times,
 CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS screen FROM events GROUP BY ALL""")
def _(d: Data) -> DataFrame:
    events = d.table("events").select(
        "user_id", F.to_date("ts").alias("date"), F.array(F.date_format("ts", "HH:mm")).alias("times"), F.col("event_type").alias("screen"),
        F.lit("").alias("language"), F.lit("").alias("buy_url"), F.lit("").alias("source_url"), F.col("event_id").alias("showing_seq"),
    )
    return gr.merge_showings_per_key(events, "user_id", "date").select("user_id", F.col("date").cast("string").alias("date"), joined("times"), "screen")


@query("linked_pairs", f"""{sql.STORE}, g AS (SELECT title, min(id) AS a FROM films GROUP BY title HAVING count(*) > 1)
 SELECT f.title, g.a, f.id AS b, g.a || ':' || f.id AS pair FROM films f JOIN g ON f.title = g.title AND f.id > g.a""")
def _(d: Data) -> DataFrame:
    return gr.linked_pairs(d.films, "title")


@query("showing_by_id", f"{sql.STORE} SELECT id, film_id, cinema_slug, screen FROM showings WHERE id = (SELECT max(id) FROM showings)")
def _(d: Data) -> DataFrame:
    last = d.showings.agg(F.max("id")).first()[0]
    return d.listing.showing(last).select("id", "film_id", "cinema_slug", "screen")
