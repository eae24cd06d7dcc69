"""Queries of the store: identity, upserts, reconciliation, loads, life cycle and maintenance."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from playbill.catalog import sql
from playbill.catalog.bindings import Data
from playbill.catalog.registry import Registry
from playbill.operators import components as cc, grouping as gr, joins as jn, lifecycle as lc, ranking as rk, similarity as sm, upsert as up
from playbill.plans import dedup as dd, history as hs, load as ld
from playbill.schema import CINEMAS, FILMS, SHOWINGS, conform
from playbill.session import checkpoint_root

registry = Registry()
query = registry.query

NOW = "2002-01-01"


def _now():
    return F.lit(NOW).cast("timestamp")


# Films under finer keys, and a store that knows half of the types.
_NAMED = """named AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS title, lower(replace(p_name || ' ' || p_brand, '#', ' ')) AS key,
 CASE WHEN p_size <= 40 THEN 1990 + p_size // 20 END AS year, CASE WHEN p_size <= 8 THEN 'Q' || p_brand || p_type || p_size END AS wid, p_type, p_size, p_name FROM part),
 known AS (SELECT min(id) AS id, key, year, min(wid) AS wid FROM named WHERE p_type IN ('SMALL', 'LARGE', 'PROMO') GROUP BY key, year)"""


def _named(d: Data) -> DataFrame:
    films = d.films.select("id", "year", "wikidata_id", F.col("genres").alias("p_type"), F.col("runtime_minutes").alias("p_size"))
    part = d.table("part").select(F.col("p_partkey").alias("id"), "p_name", F.concat_ws(" ", "p_name", "p_brand").alias("title"))
    return films.join(part, "id").withColumn("title_normalized", F.lower(F.replace("title", F.lit("#"), F.lit(" "))))


def _known(named: DataFrame) -> DataFrame:
    kept = named.filter(F.col("p_type").isin("SMALL", "LARGE", "PROMO"))
    return kept.groupBy("title_normalized", "year").agg(F.min("id").alias("id"), F.min("wikidata_id").alias("wikidata_id"))


@query("match_natural_key", f"""WITH {_NAMED}, m AS (SELECT i.id AS seq, min(k.id) FILTER (k.year IS NOT DISTINCT FROM i.year) AS exact,
 count(k.id) FILTER (k.year IS NULL OR i.year IS NULL) AS n, min(k.id) FILTER (k.year IS NULL OR i.year IS NULL) AS lone FROM named i JOIN known k ON k.key = i.key GROUP BY i.id)
 SELECT seq, coalesce(exact, CASE WHEN n = 1 THEN lone END) AS id FROM m WHERE exact IS NOT NULL OR n = 1""")
def _(d: Data) -> DataFrame:
    named = _named(d)
    return jn.match_natural_key(named.withColumnRenamed("id", "seq"), _known(named))


@query("match_external_id", f"WITH {_NAMED}, o AS (SELECT wid, min(id) AS id FROM known WHERE wid IS NOT NULL GROUP BY wid) SELECT n.id AS seq, o.id FROM named n JOIN o ON o.wid = n.wid")
def _(d: Data) -> DataFrame:
    named = _named(d)
    return jn.match_external_id(named.withColumnRenamed("id", "seq"), _known(named))


@query("upsert_films", f"""WITH {_NAMED}, dated AS (SELECT * REPLACE (coalesce(year, 1999) AS year) FROM named),
 old AS (SELECT min(id) AS id, key, year, min(title) AS title FROM dated WHERE p_type IN ('SMALL', 'LARGE', 'PROMO') GROUP BY key, year),
 g AS (SELECT key, year, min(id) AS first_seq, arg_max(p_type, id) AS director, arg_max(p_size, id) AS runtime_minutes, max(CASE WHEN p_size > 25 THEN p_name END) AS synopsis,
   arg_min(title, id) AS title FROM dated GROUP BY key, year),
 fresh AS (SELECT g.*, row_number() OVER (ORDER BY first_seq) + (SELECT max(id) FROM old) AS id FROM g WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.key = g.key AND old.year = g.year))
 SELECT old.id, old.title, g.key AS title_normalized, g.year, g.director, g.runtime_minutes, g.synopsis FROM old JOIN g ON g.key = old.key AND g.year = old.year
 UNION ALL SELECT id, title, key, year, director, runtime_minutes, synopsis FROM fresh""")
def _(d: Data) -> DataFrame:
    named = _named(d).withColumn("year", F.coalesce("year", F.lit(1999)))
    kept = named.filter(F.col("p_type").isin("SMALL", "LARGE", "PROMO"))
    state = conform(kept.groupBy("title_normalized", "year").agg(F.min("id").alias("id"), F.min("title").alias("title")), FILMS)
    return up.upsert_films(state, _records(named), _now())[0].select("id", "title", "title_normalized", "year", "director", "runtime_minutes", "synopsis")


def _records(named: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return named.select(
        F.col("id").alias("seq"), "title", nothing.alias("original_title"), "year", F.col("p_size").alias("runtime_minutes"), nothing.alias("genres"),
        F.col("p_type").alias("director"), nothing.alias("poster_url"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("synopsis"), nothing.alias("wikidata_id"),
    )


@query("upsert_films_two_signals")
def _(d: Data) -> DataFrame:
    # Unknown years and external ids make the outcome depend on the order of the records: this is
    # checked record by record in the tests.
    named = _named(d)
    state = conform(_known(named), FILMS)
    records, _ = up.resolve_identities(state, named.select(F.col("id").alias("seq"), "title_normalized", "year", "wikidata_id"))
    return records


# One part, one case: what is stored as (place, key, year, external id), what arrives likewise, and in the SQL what must follow.
_STORED = [[(0, "k", 2000, False)], [(0, "k", None, False)], [(1, "o", 2000, True)], [(0, "k", 2000, False), (1, "o", 1999, True)], [], [(0, "k", 1990, False), (1, "k", 1991, False)], []]
_ARRIVING = [[(0, "k", 2000, True)], [(0, "k", 2001, False)], [(0, "k", 2002, True)], [(0, "k", 2000, True)], [(0, "k", 2003, True)], [(0, "k", None, False)], [(0, "k", None, False), (1, "k", 2004, False)]]


def _case_rows(d: Data, cases: list[list[tuple]]) -> DataFrame:
    part = F.col("p_partkey")

    def row(place: int, key: str, year: int | None, external: bool) -> Column:
        return F.struct(
            (part * 2 + place).alias("at"), F.concat(F.lit(key), part.cast("string")).alias("title_normalized"), F.lit(year).cast("int").alias("year"),
            F.when(F.lit(external), F.concat(F.lit("Q"), part.cast("string"))).alias("wikidata_id"),
        )

    chosen = F.lit(None)
    for n, rows in enumerate(cases):
        if rows:
            chosen = F.when(part % 7 == n, F.array(*[row(*r) for r in rows])).otherwise(chosen)
    return d.table("part").select(F.explode(chosen).alias("r")).select("r.*")


@query("upsert_case_table", """WITH p AS (SELECT p_partkey AS p, p_partkey % 7 AS c, p_partkey * 2 AS s FROM part)
 SELECT s AS seq, CASE WHEN c IN (0, 1, 3) THEN 'row ' || s WHEN c = 2 THEN 'row ' || (s + 1) ELSE 'new ' || s END AS target, CASE WHEN c = 2 THEN 'o' ELSE 'k' END || p AS title_normalized,
 CASE WHEN c IN (0, 2, 3) THEN '2000' WHEN c = 1 THEN '2001' WHEN c = 4 THEN '2003' ELSE '?' END AS year FROM p UNION ALL SELECT s + 1, 'new ' || s, 'k' || p, '2004' FROM p WHERE c = 6""")
def _(d: Data) -> DataFrame:
    """Year adopted, external id adopted, row reused, ids in conflict, new, several open years, and a year that a later record brings."""
    records, _ = up.resolve_identities(_case_rows(d, _STORED).withColumnRenamed("at", "id"), _case_rows(d, _ARRIVING).withColumnRenamed("at", "seq"))
    target = F.coalesce(F.concat(F.lit("row "), "target_id"), F.concat(F.lit("new "), "target_seq"))
    return records.select("seq", target.alias("target"), "title_normalized", F.coalesce(F.col("year").cast("string"), F.lit("?")).alias("year"))


@query("upsert_cinemas", f"""WITH {sql.CINEMAS}, new AS (SELECT slug, upper(name) AS name, city, lat FROM cinemas WHERE lat < 3000 UNION ALL SELECT 'n' || n_nationkey, n_name, 'x', 1.0 FROM nation)
 SELECT slug, name, city, lat FROM new UNION ALL SELECT slug, name, city, lat FROM cinemas WHERE NOT lat < 3000""")
def _(d: Data) -> DataFrame:
    poor = d.cinemas.filter("lat < 3000")
    first = poor.withColumns({"name": F.lit("stale"), "seq": F.lit(1)})
    again = poor.withColumns({"name": F.upper("name"), "seq": F.lit(2)})
    new = d.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("slug"), F.col("n_name").alias("name"), F.lit("x").alias("city"), F.lit(1.0).alias("lat"), F.lit(3).alias("seq"))
    incoming = first.unionByName(again).unionByName(new, allowMissingColumns=True)
    return jn.upsert_by_key(d.cinemas, incoming).select("slug", "name", "city", "lat")


_SLOTS = """m AS (SELECT film_id, cinema_slug, date, min(id) AS id, string_agg(DISTINCT clock, ',' ORDER BY clock) AS times, CASE WHEN count(DISTINCT screen) = 1 THEN min(screen) END AS screen,
 max(scraped_on) AS scraped_on FROM showings {0} GROUP BY film_id, cinema_slug, date)"""


@query("upsert_showings", f"""{sql.STORE}, {_SLOTS.format("WHERE screen = 'O'").replace('m AS', 'old AS', 1)}, {_SLOTS.format("WHERE language <> 'N'").replace('m AS', 'new AS', 1)}
 SELECT coalesce(o.film_id, n.film_id) AS film_id, coalesce(o.cinema_slug, n.cinema_slug) AS cinema_slug, CAST(coalesce(o.date, n.date) AS VARCHAR) AS date, CAST(o.id AS VARCHAR) AS id,
 coalesce(n.times, o.times) AS times, CASE WHEN n.film_id IS NULL THEN o.screen ELSE n.screen END AS screen, CAST(coalesce(o.scraped_on, DATE '{NOW}') AS VARCHAR) AS scraped
 FROM old o FULL OUTER JOIN new n ON n.film_id = o.film_id AND n.cinema_slug = o.cinema_slug AND n.date = o.date""")
def _(d: Data) -> DataFrame:
    def slots(rows: DataFrame) -> DataFrame:
        merged = gr.merge_showings_per_key(rows.withColumns({"source_url": F.lit(None).cast("string"), "showing_seq": F.col("id")}), *jn.SLOT)
        stamps = rows.groupBy(*jn.SLOT).agg(F.max("scraped_at").alias("scraped_at"))
        return merged.join(stamps, jn.SLOT).withColumnRenamed("showing_seq", "id")

    state = conform(slots(d.showings.filter("screen = 'O'")), SHOWINGS)
    done = jn.upsert_showings(state, slots(d.showings.filter("language <> 'N'")), _now())
    return done.select("film_id", "cinema_slug", F.col("date").cast("string").alias("date"), F.col("id").cast("string").alias("id"), F.array_join("times", ",").alias("times"), "screen", F.to_date("scraped_at").cast("string").alias("scraped"))


@query("resolve_keys", f"""{sql.STORE} SELECT (SELECT count(*) FROM showings s JOIN films f ON f.id = s.film_id AND f.year IS NOT NULL) AS resolved,
 (SELECT count(*) FROM showings s WHERE s.film_id NOT IN (SELECT id FROM films WHERE year IS NOT NULL)) AS orphans""")
def _(d: Data) -> DataFrame:
    lookup = d.films.filter("year is not null").select(F.col("id").cast("string").alias("json_key"), F.col("id").alias("film_id"))
    rows = d.showings.select(F.col("film_id").cast("string").alias("json_key"), "id")
    resolved, orphans = jn.resolve_key(rows, lookup, "json_key", "film_id")
    return gr.table_counts(resolved=resolved, orphans=orphans)


_FILM_KEEP = "keep AS (SELECT DISTINCT title_normalized, year FROM films WHERE genres IN ('SMALL', 'PROMO') AND runtime_minutes <> 7)"


@query("reconcile_films", f"""{sql.STORE}, {_FILM_KEEP}, k AS (SELECT f.*, EXISTS (SELECT 1 FROM keep WHERE keep.title_normalized = f.title_normalized AND keep.year IS NOT DISTINCT FROM f.year) AS kept FROM films f)
 SELECT id, CASE WHEN NOT kept AND removed_at IS NULL THEN 'archived' WHEN kept AND removed_at IS NOT NULL THEN 'reactivated' END AS action,
 CAST(CASE WHEN kept THEN NULL ELSE coalesce(removed_at, DATE '{NOW}') END AS VARCHAR) AS removed FROM k""")
def _(d: Data) -> DataFrame:
    keep = d.films.filter("genres in ('SMALL', 'PROMO') and runtime_minutes <> 7").select("title_normalized", "year")
    done = jn.reconcile_rows(d.films, keep, ["title_normalized", "year"], _now())
    return done.select("id", "action", F.to_date("removed_at").cast("string").alias("removed"))


_WINDOW = "date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
_GUARD = f"""{sql.STORE}, listed AS (SELECT slug FROM cinemas WHERE lat > 0), keep AS (SELECT DISTINCT film_id, cinema_slug, date FROM showings WHERE {_WINDOW} AND language = 'R'),
 e AS (SELECT cinema_slug, count(*) AS existing FROM showings WHERE {_WINDOW} AND removed_at IS NULL AND cinema_slug IN (SELECT slug FROM listed) GROUP BY cinema_slug),
 i AS (SELECT cinema_slug, count(*) AS imported FROM keep GROUP BY cinema_slug),
 skipped AS (SELECT cinema_slug, existing, coalesce(imported, 0) AS imported FROM e LEFT JOIN i USING (cinema_slug) WHERE coalesce(imported, 0) < 0.4 * existing)"""


def _guarded(d: Data):
    inside = F.col("date").between(F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    keep = d.showings.filter(inside & (F.col("language") == "R"))
    window = [F.lit(x).cast("date") for x in ("1998-01-01", "1998-12-31")]
    return jn.reconcile_showings(d.showings, keep, d.cinemas.filter("lat > 0"), *window, 0.4, _now())


@query("reconcile_showings", f"""{_GUARD}, t AS (SELECT s.*, EXISTS (SELECT 1 FROM keep k WHERE k.film_id = s.film_id AND k.cinema_slug = s.cinema_slug AND k.date = s.date) AS kept,
 {_WINDOW} AND cinema_slug IN (SELECT slug FROM listed) AND cinema_slug NOT IN (SELECT cinema_slug FROM skipped) AS open FROM showings s)
 SELECT cinema_slug, CASE WHEN open AND NOT kept AND removed_at IS NULL THEN 'archived' WHEN open AND kept AND removed_at IS NOT NULL THEN 'reactivated' END AS action, count(*) AS showings
 FROM t GROUP BY ALL""")
def _(d: Data) -> DataFrame:
    return _guarded(d)[0].groupBy("cinema_slug", "action").agg(F.count("*").alias("showings"))


@query("skipped_sources", f"{_GUARD} SELECT cinema_slug, existing, imported FROM skipped")
def _(d: Data) -> DataFrame:
    return _guarded(d)[1].select("cinema_slug", "existing", "imported")


def _snapshot(d: Data, films: DataFrame, showings: DataFrame) -> ld.Snapshot:
    nothing = F.lit(None).cast("string")
    films = films.select(
        F.col("id").alias("seq"), F.col("id").cast("string").alias("id"), "title", nothing.alias("original_title"), F.coalesce("year", F.lit(1999)).alias("year"),
        F.concat(F.col("p_size").cast("string"), F.lit(" min")).alias("duration"), nothing.alias("runtime_minutes"), F.array("p_type").alias("genres"), nothing.alias("director"),
        nothing.alias("poster"), nothing.alias("poster_url"), F.col("p_name").alias("synopsis"), nothing.alias("description"), nothing.alias("wikidata_id"),
    )
    showings = showings.select(
        F.col("id").alias("seq"), F.col("film_id").cast("string").alias("film_id"), "cinema_slug", F.col("date").cast("string").alias("date"), "times", "screen",
        nothing.alias("source_url"), "buy_url", "language",
    )
    return ld.Snapshot(d.cinemas.withColumn("seq", F.lit(1)), films, showings, "1998-01-01", "1998-12-31")


@query("load_two_snapshots", f"""{sql.STORE}, {_NAMED}, f AS (SELECT id, key, coalesce(year, 1999) AS year, p_size FROM named), owner AS (SELECT f.id, min(f.id) OVER (PARTITION BY key, year) AS film, f.p_size FROM f),
 slots AS (SELECT DISTINCT o.film, s.cinema_slug, s.date, bool_or(s.language <> 'N' AND o.p_size < 40) AS again FROM showings s JOIN owner o ON o.id = s.film_id GROUP BY ALL),
 w AS (SELECT cinema_slug, count(*) FILTER ({_WINDOW}) AS existing, count(*) FILTER (again) AS imported FROM slots GROUP BY cinema_slug)
 SELECT (SELECT count(*) FROM cinemas) AS cinemas, (SELECT count(*) FROM named WHERE p_size < 40) AS films, (SELECT count(*) FROM slots WHERE again) AS showings,
 (SELECT count(*) FROM showings s JOIN owner o ON o.id = s.film_id WHERE s.language <> 'N' AND o.p_size >= 40) AS orphans,
 (SELECT count(DISTINCT film) FROM owner WHERE film NOT IN (SELECT film FROM owner WHERE p_size < 40)) AS archived_films,
 (SELECT count(*) FROM slots JOIN w USING (cinema_slug) WHERE {_WINDOW} AND NOT again AND imported >= 4 * existing) AS archived_showings,
 (SELECT count(*) FROM w WHERE existing > 0 AND imported < 4 * existing) AS skipped_cinemas""")
def _(d: Data) -> DataFrame:
    named = _named(d)
    empty = ld.Store(*[d.spark.createDataFrame([], ddl) for ddl in (CINEMAS, FILMS, SHOWINGS)])
    first = ld.load_snapshot(empty, _snapshot(d, named, d.showings), _now())
    second = ld.load_snapshot(first.store, _snapshot(d, named.filter("p_size < 40"), d.showings.filter("language <> 'N'")), _now(), min_ratio=4.0)
    return second.report.select("cinemas", "films", "showings", "orphans", "archived_films", "archived_showings", "skipped_cinemas")


@query("load_by_months", f"""{sql.STORE}, {_NAMED}, f AS (SELECT id, key, coalesce(year, 1999) AS year, p_size FROM named), owner AS (SELECT f.id, min(f.id) OVER (PARTITION BY key, year) AS film, f.p_size FROM f),
 slots AS (SELECT o.film, s.cinema_slug, s.date, bool_or(s.language <> 'N' AND o.p_size < 40 AND {_WINDOW}) AS again FROM showings s JOIN owner o ON o.id = s.film_id GROUP BY ALL),
 w AS (SELECT cinema_slug, count(*) FILTER ({_WINDOW}) AS existing, count(*) FILTER (again) AS imported FROM slots GROUP BY cinema_slug)
 SELECT strftime(date, '%Y-%m') AS month, count(*) AS showings, count(*) FILTER ({_WINDOW} AND NOT again AND imported >= 0.3 * existing) AS archived, bool_or({_WINDOW}) AS written
 FROM slots JOIN w USING (cinema_slug) GROUP BY 1""")
def _(d: Data) -> DataFrame:
    """Two loads into a versioned store: the second writes the months of its window again and names those of the first."""
    named, root = _named(d), f"{checkpoint_root(d.spark)}/playbill/{uuid.uuid4().hex}"
    first, _ = ld.load_version(d.spark, root, _snapshot(d, named, d.showings), _now(), ld.MONTH)
    inside = d.showings.filter("language <> 'N' AND date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
    second, _ = ld.load_version(d.spark, root, _snapshot(d, named.filter("p_size < 40"), inside), _now(), min_ratio=0.3)
    old, new = (v.tables["showings"].folders for v in (first, second))
    written = F.col("month").isin([k for k in new if new[k] != old.get(k)])
    showings = ld.read_store(d.spark, root, second).showings.withColumn("month", ld.day_key(F.col("date"), ld.MONTH))
    return showings.groupBy("month").agg(F.count("*").alias("showings"), F.count_if(F.col("removed_at").isNotNull()).alias("archived")).withColumn("written", written)


@query("identity_conflicts", f"""WITH {_NAMED}, o AS (SELECT wid, max(id) AS b FROM named WHERE wid IS NOT NULL GROUP BY wid)
 SELECT n.id AS a, o.b, n.id || ':' || o.b AS pair FROM named n JOIN o ON o.wid = n.wid AND o.b <> n.id""")
def _(d: Data) -> DataFrame:
    named = _named(d)
    records = named.select(F.col("id").cast("string").alias("json_key"), "wikidata_id")
    return ld.identity_conflicts(records, named, named.select(F.col("id").cast("string").alias("json_key"), "id"))


@query("duplicate_titles", f"""{sql.STORE}, t AS (SELECT title_normalized, min(id) AS a FROM films WHERE removed_at IS NULL AND year IS NULL GROUP BY title_normalized)
 SELECT t.a || ':' || f.id AS pair FROM films f JOIN t USING (title_normalized) WHERE f.removed_at IS NULL AND f.year IS NULL AND f.id > t.a""")
def _(d: Data) -> DataFrame:
    return ld.duplicate_titles(d.films).select("pair")


@query("shared_external_ids", f"""{sql.STORE}, t AS (SELECT wikidata_id, min(id) AS a FROM films WHERE wikidata_id IS NOT NULL GROUP BY wikidata_id)
 SELECT t.a || ':' || f.id AS pair FROM films f JOIN t USING (wikidata_id) WHERE f.id > t.a""")
def _(d: Data) -> DataFrame:
    return ld.shared_external_ids(d.films).select("pair")


@query("last_wins", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def _(d: Data) -> DataFrame:
    rows = d.table("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return jn.last_wins(rows, "o_custkey", seq="o_orderkey")


@query("assign_ids", "SELECT o_orderkey, 100 + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders")
def _(d: Data) -> DataFrame:
    return rk.assign_ids(d.table("orders").select("o_orderkey"), "o_orderkey", 100)


# ---- choosing survivors ---------------------------------------------------------------

_MEMBERS = """c AS (SELECT film_id, count(*) AS showing_count FROM showings GROUP BY film_id),
 rated AS (SELECT f.*, coalesce(c.showing_count, 0) AS showing_count FROM films f LEFT JOIN c ON c.film_id = f.id),
 ranked AS (SELECT *, title_normalized AS grp, row_number() OVER (PARTITION BY title_normalized ORDER BY showing_count DESC, year IS NULL, wikidata_id IS NULL,
   CAST(poster_url IS NOT NULL AS INT) + CAST(synopsis IS NOT NULL AS INT) + CAST(director IS NOT NULL AS INT) DESC, id) AS rn FROM rated),
 members AS (SELECT *, first_value(id) OVER (PARTITION BY grp ORDER BY rn) AS survivor_id FROM ranked)"""


def _members(d: Data) -> DataFrame:
    counts = gr.showing_counts(d.showings).withColumnRenamed("film_id", "id")
    rated = d.films.join(counts, "id", "left").withColumn("showing_count", F.coalesce("showing_count", F.lit(0)))
    grouped = rated.withColumn("group", F.col("title_normalized"))
    return grouped.join(rk.pick_survivor(grouped), "group")


@query("survivors", f"{sql.STORE}, {_MEMBERS} SELECT grp AS \"group\", min(survivor_id) AS survivor_id, count(*) AS members FROM members GROUP BY grp")
def _(d: Data) -> DataFrame:
    return _members(d).groupBy("group", "survivor_id").agg(F.count("*").alias("members"))


@query("slot_collisions", f"""{sql.STORE}, {_MEMBERS}, s AS (SELECT s.*, m.grp, m.survivor_id, row_number() OVER (PARTITION BY m.grp, s.cinema_slug, s.date
 ORDER BY s.scraped_on DESC, s.film_id <> m.survivor_id, s.film_id, s.id) AS rn FROM showings s JOIN members m ON m.id = s.film_id)
 SELECT id, film_id, CASE WHEN rn > 1 THEN 'discard' WHEN film_id <> survivor_id THEN 'move' ELSE 'keep' END AS outcome FROM s""")
def _(d: Data) -> DataFrame:
    seats = d.showings.join(_members(d).select(F.col("id").alias("film_id"), "group", "survivor_id"), "film_id")
    return rk.resolve_slot_collisions(seats).select("id", "film_id", "outcome")


_FILLS = " UNION ALL ".join(
    f"""SELECT grp, survivor_id, '{c}' AS field, max(CASE WHEN id = survivor_id THEN CAST({c} AS VARCHAR) END) AS current,
 arg_min(CAST({c} AS VARCHAR), id) FILTER (id <> survivor_id AND {c} IS NOT NULL) AS other, count(DISTINCT {c}) FILTER (id <> survivor_id) AS kinds,
 max(CAST({c} AS VARCHAR)) FILTER (id <> survivor_id) AS high, min(CAST({c} AS VARCHAR)) FILTER (id <> survivor_id) AS low FROM members GROUP BY grp, survivor_id"""
    for c in rk.FILL_FIELDS
)


@query("fills", f"""{sql.STORE}, {_MEMBERS}, x AS ({_FILLS}) SELECT grp AS "group", field, current, CASE WHEN current IS NULL THEN other END AS adopted,
 CASE WHEN current IS NULL THEN kinds > 1 ELSE low <> current OR high <> current END AS conflict FROM x WHERE other IS NOT NULL""")
def _(d: Data) -> DataFrame:
    return rk.plan_fills(_members(d)).select("group", "field", "current", "adopted", "conflict")


# ---- duplicate maintenance -------------------------------------------------------------

_PLAN = f"""{sql.STORE}, {_MEMBERS}, n AS (SELECT *, count(*) OVER (PARTITION BY title_normalized, year) AS same, count(*) FILTER (year IS NULL) OVER (PARTITION BY title_normalized) AS unknown
 FROM rated), y AS (SELECT title_normalized, count(DISTINCT year) AS years FROM rated GROUP BY title_normalized),
 k AS (SELECT n.*, y.years, n.unknown > 0 AND y.years = 1 AS adopts FROM n JOIN y USING (title_normalized)),
 kg AS (SELECT id, 'key:' || title_normalized || ':' || CASE WHEN adopts THEN 'any' ELSE coalesce(CAST(year AS VARCHAR), 'none') END AS grp,
   CASE WHEN adopts THEN 'same key, unknown year adopted' ELSE 'same key and year' END AS rule,
   CASE WHEN NOT adopts AND year IS NULL AND years > 1 THEN 'unknown year with several known years' END AS doubt FROM k WHERE adopts OR same > 1),
 rest AS (SELECT * FROM rated WHERE id NOT IN (SELECT id FROM kg)),
 xg AS (SELECT id, 'external:' || wikidata_id AS grp, 'same external id' AS rule, CAST(NULL AS VARCHAR) AS doubt FROM rest
   WHERE wikidata_id IN (SELECT wikidata_id FROM rest WHERE wikidata_id IS NOT NULL GROUP BY wikidata_id HAVING count(*) > 1)),
 claimed AS (SELECT * FROM kg UNION ALL SELECT * FROM xg), pm AS (SELECT r.*, c.grp, c.rule, c.doubt FROM rated r JOIN claimed c USING (id)),
 judged AS (SELECT grp, coalesce(max(doubt), CASE WHEN min(wikidata_id) <> max(wikidata_id) THEN 'external id in conflict: ' || min(wikidata_id) || ', ' || max(wikidata_id) END,
   CASE WHEN min(year) <> max(year) THEN 'year in conflict: ' || min(year) || ', ' || max(year) END) AS block_reason FROM pm GROUP BY grp),
 planned AS (SELECT pm.*, j.block_reason, first_value(pm.id) OVER (PARTITION BY pm.grp ORDER BY showing_count DESC, year IS NULL, wikidata_id IS NULL,
   CAST(poster_url IS NOT NULL AS INT) + CAST(synopsis IS NOT NULL AS INT) + CAST(director IS NOT NULL AS INT) DESC, pm.id) AS survivor_id FROM pm JOIN judged j USING (grp)),
 merged AS (SELECT * FROM planned WHERE block_reason IS NULL),
 seats AS (SELECT s.*, m.grp, m.survivor_id, row_number() OVER (PARTITION BY m.grp, s.cinema_slug, s.date ORDER BY s.scraped_on DESC, s.film_id <> m.survivor_id, s.film_id, s.id) AS rn
   FROM showings s JOIN merged m ON m.id = s.film_id)"""


@query("dedup_members", f"{_PLAN} SELECT id, grp AS \"group\", rule, block_reason, survivor_id FROM planned")
def _(d: Data) -> DataFrame:
    return dd.build_plan(d.films, d.showings).members.select("id", "group", "rule", "block_reason", "survivor_id")


@query("dedup_summary", f"""{_PLAN} SELECT (SELECT count(DISTINCT grp) FROM merged) AS groups, (SELECT count(*) FROM merged) AS rows_to_merge,
 (SELECT count(*) FROM merged WHERE id <> survivor_id) AS rows_removed, (SELECT count(*) FROM seats WHERE rn = 1 AND film_id <> survivor_id) AS moved,
 (SELECT count(*) FROM seats WHERE rn > 1) AS discarded""")
def _(d: Data) -> DataFrame:
    return dd.report(dd.build_plan(d.films, d.showings))["summary"]


@query("dedup_moves", f"{_PLAN} SELECT id, survivor_id FROM seats WHERE rn = 1 AND film_id <> survivor_id")
def _(d: Data) -> DataFrame:
    return dd.report(dd.build_plan(d.films, d.showings))["moves"].select("id", "survivor_id")


@query("dedup_discards", f"{_PLAN} SELECT id FROM seats WHERE rn > 1")
def _(d: Data) -> DataFrame:
    return dd.report(dd.build_plan(d.films, d.showings))["discards"].select("id")


@query("dedup_apply", f"""{_PLAN}, mine AS (SELECT survivor_id AS id, arg_min(director, id) FILTER (id <> survivor_id AND director IS NOT NULL) AS director,
 arg_min(year, id) FILTER (id <> survivor_id AND year IS NOT NULL) AS year FROM merged GROUP BY survivor_id),
 after AS (SELECT coalesce(CASE WHEN rn = 1 THEN q.survivor_id END, s.film_id) AS film_id FROM showings s LEFT JOIN seats q ON q.id = s.id AND q.film_id = s.film_id AND q.cinema_slug = s.cinema_slug
   WHERE q.rn IS NULL OR q.rn = 1)
 SELECT r.id, coalesce(r.year, m.year) AS year, coalesce(r.director, m.director) AS director, (SELECT count(*) FROM after a WHERE a.film_id = r.id) AS showings
 FROM rated r LEFT JOIN mine m ON m.id = r.id WHERE r.id NOT IN (SELECT id FROM merged WHERE id <> survivor_id)""")
def _(d: Data) -> DataFrame:
    films, showings = dd.apply_plan(dd.build_plan(d.films, d.showings))
    counts = gr.showing_counts(showings).select(F.col("film_id").alias("id"), F.col("showing_count").alias("showings"))
    return films.select("id", "year", "director").join(counts, "id", "left").withColumn("showings", F.coalesce("showings", F.lit(0)))


@query("stale_keys", f"""{_PLAN}, adopted AS (SELECT survivor_id AS id, arg_min(year, id) FILTER (id <> survivor_id AND year IS NOT NULL) AS new_year FROM merged GROUP BY survivor_id),
 final AS (SELECT r.id, r.title_normalized AS new_key, coalesce(r.year, a.new_year) AS y FROM rated r LEFT JOIN adopted a ON a.id = r.id WHERE r.id NOT IN (SELECT id FROM merged WHERE id <> survivor_id))
 SELECT id, new_key, count(*) OVER (PARTITION BY new_key, y) > 1 AS frozen FROM final""")
def _(d: Data) -> DataFrame:
    # Stored keys of another release: every one is out of date.
    films = d.films.withColumn("title_normalized", F.upper("title_normalized"))
    return dd.build_plan(films, d.showings).keys.select("id", "new_key", "frozen")


@query("merge_candidates", f"""{sql.STORE}, r AS (SELECT title_normalized AS key, min(id) AS id FROM films GROUP BY 1)
 SELECT a.id AS first_id, b.id AS second_id, CASE WHEN levenshtein(a.key, b.key) <= 2 THEN 'distance ' || levenshtein(a.key, b.key) ELSE 'word suffix' END AS reason
 FROM r a JOIN r b ON a.key < b.key WHERE levenshtein(a.key, b.key) <= 2 OR starts_with(b.key, a.key || ' ')""")
def _(d: Data) -> DataFrame:
    return sm.candidate_pairs(d.films.select("id", F.col("title_normalized").alias("key"))).select("first_id", "second_id", "reason")


@query("suffix_candidates", """WITH r AS (SELECT key, min(id) AS id FROM (SELECT lower(p_name) AS key, p_partkey AS id FROM part UNION ALL SELECT lower(p_name || ' ' || p_type), p_partkey FROM part) GROUP BY key)
 SELECT a.key AS first_key, b.key AS second_key FROM r a JOIN r b ON starts_with(b.key, a.key || ' ') AND levenshtein(a.key, b.key) > 2""")
def _(d: Data) -> DataFrame:
    part = d.table("part")
    keys = part.select(F.col("p_partkey").alias("id"), F.explode(F.array(F.lower("p_name"), F.lower(F.concat_ws(" ", "p_name", "p_type")))).alias("key"))
    return sm.candidate_pairs(keys).filter("reason = 'word suffix'").select("first_key", "second_key")


@query("validate_pairs", """SELECT (SELECT count(*) FROM orders WHERE o_orderkey <> o_custkey AND o_orderstatus <> 'P') AS good, (SELECT count(*) FROM orders WHERE o_orderkey = o_custkey OR o_orderstatus = 'P') AS rejected""")
def _(d: Data) -> DataFrame:
    pair = F.when(F.col("o_orderstatus") == "P", F.concat_ws("-", "o_orderkey", "o_custkey")).otherwise(F.concat_ws(":", "o_orderkey", "o_custkey"))
    raw = d.table("orders").select(pair.alias("pair"))
    good, rejected = dd.validate_pairs(raw)
    return gr.table_counts(good=good, rejected=rejected)


@query("cluster_pairs", """WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, 1000000 + s_nationkey AS b FROM supplier WHERE s_acctbal > 2000), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node""")
def _(d: Data) -> DataFrame:
    pairs = d.table("supplier").filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("a"), (F.col("s_nationkey") + 1000000).cast("bigint").alias("b"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    return cc.cluster_pairs(pairs, nodes)[0]


# ---- life cycle ------------------------------------------------------------------------

TODAY = "1998-04-01"
_RUNS = """c AS (SELECT c_custkey AS id, c_mktsegment || ' x' || c_custkey || 'x' AS title, c_acctbal AS bal, c_nationkey AS nation FROM customer),
 o AS (SELECT o_custkey AS id, o_orderpriority AS slug, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS t FROM orders),
 old_show AS (SELECT * FROM o WHERE d BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'), new_show AS (SELECT * FROM o WHERE d BETWEEN DATE '1998-03-28' AND DATE '1998-06-30'),
 prev AS (SELECT *, CASE WHEN nation < 6 THEN 'rimosso' ELSE 'in_programmazione' END AS status, CASE WHEN nation < 3 THEN DATE '1998-03-25' WHEN nation < 6 THEN DATE '1998-03-01' END AS removed
   FROM c WHERE bal < 7000), new AS (SELECT * FROM c WHERE bal > 2000),
 oldsig AS (SELECT id, string_agg(slug || d || t, ',' ORDER BY slug, d, t) AS s, max(d) AS last FROM (SELECT id, slug, d, string_agg(DISTINCT t, '-' ORDER BY t) AS t FROM old_show GROUP BY ALL) GROUP BY id),
 newsig AS (SELECT id, string_agg(slug || d || t, ',' ORDER BY slug, d, t) AS s FROM (SELECT id, slug, d, string_agg(DISTINCT t, '-' ORDER BY t) AS t FROM new_show GROUP BY ALL) GROUP BY id),
 seen AS (SELECT n.id, 'in_programmazione' AS status, CASE WHEN p.id IS NULL THEN 'added' WHEN a.s IS DISTINCT FROM b.s THEN 'updated' WHEN p.removed IS NULL THEN 'added' ELSE 'removed' END AS last_action,
   CASE WHEN p.id IS NULL THEN 1 ELSE 1 + CAST(p.removed IS NOT NULL AS INT) + CAST(a.s IS DISTINCT FROM b.s AS INT) END AS events,
   CASE WHEN p.id IS NOT NULL THEN 'img' END AS poster FROM new n LEFT JOIN prev p USING (id) LEFT JOIN oldsig a USING (id) LEFT JOIN newsig b USING (id)),
 gone AS (SELECT p.*, a.last, CASE WHEN p.status = 'rimosso' AND DATE '1998-04-01' - p.removed > 14 THEN 'forget' WHEN p.status = 'rimosso' THEN 'still'
   WHEN a.last IS NULL OR DATE '1998-04-01' - a.last > 7 THEN 'remove' ELSE 'grace' END AS fate FROM prev p LEFT JOIN oldsig a USING (id) WHERE p.id NOT IN (SELECT id FROM new)),
 kept AS (SELECT id, CASE WHEN fate = 'grace' THEN 'in_programmazione' ELSE 'rimosso' END AS status, 'removed' AS last_action, 2 AS events, 'img' AS poster FROM gone WHERE fate <> 'forget'),
 state AS (SELECT * FROM seen UNION ALL SELECT * FROM kept)"""


def _lifecycle(d: Data) -> tuple[DataFrame, DataFrame]:
    customers = d.table("customer").select(
        F.col("c_custkey").alias("arrival_seq"), F.concat(F.col("c_mktsegment"), F.lit(" x"), "c_custkey", F.lit("x")).alias("title"), "c_acctbal", "c_nationkey"
    )
    films = customers.withColumns({"title_normalized": F.col("title"), "status": F.lit(lc.ACTIVE)})
    gone = F.col("c_nationkey") < 6
    removed = F.when(F.col("c_nationkey") < 3, "1998-03-25").otherwise("1998-03-01")
    event = lambda date, action: F.struct(date.alias("date"), F.lit(action).alias("action"))
    added = event(F.lit("1998-01-01"), "added")
    history = F.when(gone, F.array(added, event(removed, "removed"))).otherwise(F.array(added))
    prev = films.filter("c_acctbal < 7000").withColumns({"status": F.when(gone, lc.REMOVED).otherwise(lc.ACTIVE), "history": history, "poster": F.lit("img")})
    shows = d.table("orders").select(
        F.col("o_custkey").alias("arrival_seq"), F.col("o_orderkey").alias("showing_seq"), F.lit("c").alias("cinema"), F.col("o_orderpriority").alias("cinema_slug"),
        F.to_date("o_orderdate").cast("string").alias("date"), F.array("o_orderstatus").alias("times"),
    )
    before, now = shows.filter("date between '1998-01-01' and '1998-03-31'"), shows.filter("date between '1998-03-28' and '1998-06-30'")
    new = films.filter("c_acctbal > 2000")
    return lc.merge_lifecycle(new, _of(now, new), prev, _of(before, prev), TODAY)


def _of(shows: DataFrame, films: DataFrame) -> DataFrame:
    return shows.join(films.select("arrival_seq"), "arrival_seq", "left_semi")


@query("lifecycle", f"WITH {_RUNS} SELECT c.title, state.status, last_action, events, poster FROM state JOIN c USING (id)")
def _(d: Data) -> DataFrame:
    films, _ = _lifecycle(d)
    return films.select("title", "status", F.element_at("history", -1)["action"].alias("last_action"), F.size("history").alias("events"), "poster")


@query("lifecycle_published", f"""WITH {_RUNS} SELECT c.title, count(*) AS showings FROM c JOIN new USING (id) JOIN new_show s USING (id) GROUP BY c.title""")
def _(d: Data) -> DataFrame:
    films, showings = lc.published(*_lifecycle(d))
    return films.select("arrival_seq", "title").join(showings, "arrival_seq").groupBy("title").agg(F.count("*").alias("showings"))


@query("changed_showings", """WITH o AS (SELECT o_custkey, o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s FROM orders),
 a AS (SELECT o_custkey, string_agg(p || d || s, ',' ORDER BY p, d, s) AS sig FROM o WHERE s <> 'P' GROUP BY 1), b AS (SELECT o_custkey, string_agg(p || d || s, ',' ORDER BY p, d, s) AS sig FROM o WHERE s <> 'F' GROUP BY 1)
 SELECT o_custkey FROM a FULL OUTER JOIN b USING (o_custkey) WHERE a.sig IS DISTINCT FROM b.sig""")
def _(d: Data) -> DataFrame:
    shows = d.table("orders").select("o_custkey", F.col("o_orderpriority").alias("cinema_slug"), F.to_date("o_orderdate").alias("date"), F.array("o_orderstatus").alias("times"), "o_orderstatus")
    return lc.changed_keys(shows.filter("o_orderstatus <> 'P'"), shows.filter("o_orderstatus <> 'F'"), "o_custkey")


@query("history_of_days", """WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) AS d FROM orders),
 days AS (SELECT unnest([DATE '1995-01-31', DATE '1996-01-31', DATE '1997-01-31']) AS day),
 s AS (SELECT day, o_orderpriority, CASE WHEN d > day - 365 AND o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS status FROM o, days WHERE d <= day AND (o_orderkey % 5 <> 0 OR d > day - 365))
 SELECT CAST(day AS VARCHAR) AS day, o_orderpriority, status, count(*) AS orders FROM s GROUP BY ALL""")
def _(d: Data) -> DataFrame:
    # A table as it is on four days: orders come, change their status after a year, and some go. The first two days are folded later.
    root = f"{checkpoint_root(d.spark)}/playbill/{uuid.uuid4().hex}"
    orders = d.table("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.to_date("o_orderdate").alias("d"))
    days = ("1995-01-31", "1996-01-31", "1997-01-31", "1998-01-31")
    for day in days:
        new = F.col("d") > F.date_sub(F.lit(day).cast("date"), 365)
        there = orders.filter((F.col("d") <= F.lit(day).cast("date")) & ((F.col("o_orderkey") % 5 != 0) | new))
        hs.record_day(there.withColumn("status", F.when(new & (F.col("o_orderstatus") == "O"), "P").otherwise(F.col("o_orderstatus"))), day, root)
    hs.compact(d.spark, root, days[1])
    past = [hs.as_of(d.spark, root, day).select(F.lit(day).alias("day"), "o_orderpriority", "status") for day in days[:3]]
    return reduce(DataFrame.unionByName, past).groupBy("day", "o_orderpriority", "status").agg(F.count("*").alias("orders"))
