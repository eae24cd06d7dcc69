"""Queries of entity resolution, enrichment and data quality."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from playbill.catalog import sql
from playbill.catalog.bindings import Data
from playbill.catalog.registry import Registry
from playbill.functions import text as tx
from playbill.operators import components as cc, fuse as fz, quality as qa, similarity as sm
from playbill.plans import key_index as ki
from playbill.schema import FILM_RECORD, conform
from playbill.session import checkpoint_root

registry = Registry()
query = registry.query

_KEYS = f"""t AS (SELECT page_id AS seq, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, {sql.title_key("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS key FROM pages),
 k AS (SELECT key, min(seq) AS first, max(seq) AS last FROM t WHERE key <> '' GROUP BY key),
 near AS (SELECT a.first AS a, b.first AS b FROM k a JOIN k b ON a.key <> b.key AND NOT {sql.sequel('a.key', 'b.key')}
   AND (contains(b.key, a.key) OR (a.first < b.last AND abs(length(a.key) - length(b.key)) <= greatest(2, length(a.key) // 4) AND levenshtein(a.key, b.key) <= greatest(2, length(a.key) // 4)))),
 e AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM near UNION SELECT k.first, t.seq FROM t JOIN k USING (key) WHERE t.seq <> k.first)"""
_COMPONENTS = f"""WITH RECURSIVE {_KEYS}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node), l AS (SELECT node, min(root) AS root FROM r GROUP BY node)"""


@query("similar_titles", f"WITH {_KEYS} SELECT a, b FROM e")
def _(d: Data) -> DataFrame:
    edges = sm.similarity_self_join(d.page_titles, "title", "arrival_seq")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query("similar_over_nights", f"""WITH {_KEYS} SELECT 'near' AS reason, a.key AS a, b.key AS b FROM k a JOIN k b ON a.key <> b.key
 AND abs(length(a.key) - length(b.key)) <= greatest(2, length(a.key) // 4) AND levenshtein(a.key, b.key) <= greatest(2, length(a.key) // 4)
 UNION ALL SELECT 'inside', a.key, b.key FROM k a JOIN k b ON a.key <> b.key AND contains(b.key, a.key)""")
def _(d: Data) -> DataFrame:
    """Keys of every second page on one night and of all pages on the next, which probes the index with those it does not know."""
    root = f"{checkpoint_root(d.spark)}/playbill/{uuid.uuid4().hex}"
    keys = d.page_titles.select(tx.title_key(F.col("title")).alias("key"), "arrival_seq")
    first = ki.add_keys(keys.filter("arrival_seq % 2 = 0"), root)
    return first.unionByName(ki.add_keys(keys, root))


@query("title_components", f"{_COMPONENTS} SELECT node, root FROM l")
def _(d: Data) -> DataFrame:
    return cc.connected_components(sm.similarity_self_join(d.page_titles, "title", "arrival_seq"))


@query("component_sizes", f"{_COMPONENTS} SELECT root, count(*) AS members FROM l GROUP BY root")
def _(d: Data) -> DataFrame:
    return cc.component_sizes(cc.connected_components(sm.similarity_self_join(d.page_titles, "title", "arrival_seq")))


def _page_films(d: Data) -> DataFrame:
    host = F.regexp_extract("url", r"://([^/]+)", 1)
    facts = d.table("pages").select(F.col("page_id").alias("arrival_seq"), host.alias("source_slug"), F.col("url").alias("poster"), "html")
    films = d.page_titles.join(facts, "arrival_seq").withColumns(
        {"title_normalized": F.col("title"), "status": F.lit("in_programmazione"), "year": F.when(F.col("arrival_seq") % 3 == 0, F.col("arrival_seq").cast("int")), "description": F.col("html")}
    )
    return conform(films, FILM_RECORD)


@query("fused_titles", f"""{_COMPONENTS}, g AS (SELECT t.seq, coalesce(l.root, t.seq) AS root, t.title, p.html, p.url FROM t LEFT JOIN l ON l.node = t.seq JOIN pages p ON p.page_id = t.seq)
 SELECT root AS arrival_seq, coalesce(arg_min(title, seq) FILTER (title <> '' AND NOT (title = upper(title) AND title <> lower(title))), arg_min(title, seq) FILTER (title <> ''), '') AS title,
 arg_min(url, seq) AS poster, min(seq) FILTER (seq % 3 = 0) AS year, md5(arg_max(html, length(html) * CAST(100000000 AS BIGINT) - seq)) AS digest FROM g GROUP BY root""")
def _(d: Data) -> DataFrame:
    fused, _ = fz.fuse_by_title(_page_films(d), aliases=[("no such title", "at all")])
    return fused.select("arrival_seq", "title", "poster", "year", F.md5("description").alias("digest"))


def _store_films(d: Data) -> DataFrame:
    films = d.films.select(
        F.lit("store").alias("source_slug"), F.col("id").alias("arrival_seq"), "title", "title_normalized", F.col("poster_url").alias("poster"), F.col("synopsis").alias("description"),
        F.array("genres").alias("genres"), F.lit("in_programmazione").alias("status"), "director", F.concat(F.col("runtime_minutes").cast("string"), F.lit(" min")).alias("duration"),
        "original_title", "year", "wikidata_id", "removed_at",
    )
    return conform(films, FILM_RECORD)


@query("fuse_by_external_id", f"""{sql.STORE}, g AS (SELECT *, CASE WHEN wikidata_id IS NULL THEN id ELSE min(id) OVER (PARTITION BY wikidata_id) END AS root FROM films)
 SELECT root AS arrival_seq, arg_min(title, id) AS title, arg_min(poster_url, id) FILTER (poster_url IS NOT NULL) AS poster, arg_min(director, id) FILTER (director IS NOT NULL) AS director,
 arg_min(original_title, id) FILTER (original_title IS NOT NULL) AS original_title, arg_min(title_normalized, id) AS title_normalized, arg_min(year, id) FILTER (year IS NOT NULL) AS year FROM g GROUP BY root""")
def _(d: Data) -> DataFrame:
    fused, _ = fz.fuse_by_external_id(_store_films(d), aliases=[("no such title", "at all")])
    return fused.select("arrival_seq", "title", "poster", "director", "original_title", "title_normalized", "year")


@query("rekeyed_showings", f"""{sql.STORE}, g AS (SELECT id, CASE WHEN wikidata_id IS NULL THEN id ELSE min(id) OVER (PARTITION BY wikidata_id) END AS root FROM films)
 SELECT g.root AS arrival_seq, count(*) AS showings FROM showings s JOIN g ON g.id = s.film_id GROUP BY g.root""")
def _(d: Data) -> DataFrame:
    labels = fz.external_id_labels(_store_films(d))
    moved = fz.rekey_showings(d.showings.select(F.col("film_id").alias("arrival_seq"), "date"), labels)
    return moved.groupBy("arrival_seq").agg(F.count("*").alias("showings"))


# ---- enrichment -----------------------------------------------------------------------

_DIMENSION = "dim AS (SELECT lower(p_name) AS k, min(p_partkey) AS pick, count(*) AS n FROM part WHERE p_retailprice < 990 GROUP BY 1)"


def _dimension(d: Data) -> DataFrame:
    named = d.table("part").filter("p_retailprice < 990").groupBy(fz.lookup_key(F.col("p_name")).alias("lookup_key")).agg(F.min("p_partkey").alias("pick"))
    text = lambda prefix: F.concat(F.lit(prefix), F.col("pick").cast("string"))
    found = ~F.col("lookup_key").startswith("red")
    return named.select(
        "lookup_key", found.alias("found"), text("img").alias("poster"), text("about ").alias("description"), text("dir ").alias("director"), text("90 min ").alias("duration"),
        F.lit(None).cast("string").alias("original_title"), text("Q").alias("wikidata_id"), F.lit(2000).alias("year"),
    )


def _plain_films(d: Data) -> DataFrame:
    """Films whose title carries a format label, so that only the normalised title is known."""
    name = d.table("part").select(F.col("p_partkey").alias("arrival_seq"), F.concat(F.col("p_name"), F.lit(" - 3D")).alias("title"))
    films = _store_films(d).drop("title").join(name, "arrival_seq").withColumn("title_normalized", tx.normalize_title(F.col("title")))
    return conform(films, FILM_RECORD)


@query("enrich_films", f"""{sql.STORE}, {_DIMENSION}, x AS (SELECT f.*, d.pick FROM films f JOIN part p ON p.p_partkey = f.id LEFT JOIN dim d ON d.k = lower(p.p_name) AND NOT starts_with(d.k, 'red')
 AND NOT (poster_url IS NOT NULL AND synopsis IS NOT NULL AND director IS NOT NULL))
 SELECT id AS arrival_seq, coalesce(poster_url, 'img' || pick) AS poster, coalesce(synopsis, 'about ' || pick) AS description, coalesce(director, 'dir ' || pick) AS director,
 coalesce(wikidata_id, 'Q' || pick) AS wikidata_id, coalesce(year, CASE WHEN pick IS NOT NULL THEN 2000 END) AS year FROM x""")
def _(d: Data) -> DataFrame:
    return fz.enrich(_plain_films(d), _dimension(d)).select("arrival_seq", "poster", "description", "director", "wikidata_id", "year")


@query("enrichment_worklist", f"""{sql.STORE}, w AS (SELECT DISTINCT lower(p_name) AS k FROM part JOIN films ON id = p_partkey WHERE p_name NOT LIKE 'blue%' AND (poster_url IS NULL OR synopsis IS NULL OR director IS NULL))
 SELECT k AS lookup_key FROM w""")
def _(d: Data) -> DataFrame:
    known = _dimension(d).filter(F.col("lookup_key").startswith("blue"))
    return fz.enrichment_worklist(_plain_films(d), known).select("lookup_key")


# ---- quality --------------------------------------------------------------------------


def _judged_films(d: Data) -> DataFrame:
    size = F.col("p_size")
    films = d.table("part").select(
        F.col("p_partkey").alias("arrival_seq"), F.when(size > 2, F.col("p_name")).alias("title"), F.when(size != 5, F.col("p_name")).otherwise("").alias("title_normalized"),
        F.when(size > 45, "rimosso").when(size == 9, "?").otherwise("in_programmazione").alias("status"), F.when(F.col("p_retailprice") > 920, "img").alias("poster"),
        F.when(size > 25, F.col("p_name")).alias("description"), F.when(size > 10, F.array("p_type")).alias("genres"), F.when(size > 3, F.col("p_brand")).alias("director"),
        F.when(size > 30, F.lit("1 min")).alias("duration"),
    )
    return conform(films, FILM_RECORD)


def _judged_showings(d: Data) -> DataFrame:
    rows = d.showings.filter("language <> 'A' or screen <> 'F'")
    bad = F.col("language") == "R"
    return rows.select(
        F.col("film_id").alias("arrival_seq"), F.when(F.col("screen") == "F", "").otherwise(F.col("cinema_slug")).alias("cinema_slug"), F.when(bad & (F.col("screen") == "O"), None).otherwise("c").alias("cinema"),
        F.when(bad, F.date_format("date", "dd/MM/yyyy")).otherwise(F.col("date").cast("string")).alias("date"),
        F.when(F.col("language") == "N", F.array().cast("array<string>")).when(bad, F.array(F.lit("8:30"), F.element_at("times", 1))).otherwise(F.col("times")).alias("times"),
    )


_JUDGED = f"""{sql.STORE}, jf AS (SELECT p_partkey AS id, CASE WHEN p_size > 2 THEN p_name END AS title, CASE WHEN p_size <> 5 THEN p_name ELSE '' END AS key,
 CASE WHEN p_size > 45 THEN 'rimosso' WHEN p_size = 9 THEN '?' ELSE 'in_programmazione' END AS status, CASE WHEN p_retailprice > 920 THEN 'img' END AS poster, p_size, p_type FROM part),
 js AS (SELECT film_id AS id, language, screen FROM showings WHERE language <> 'A' OR screen <> 'F'),
 found AS (SELECT 'error' AS level, 'no title' AS rule, id FROM jf WHERE title IS NULL UNION ALL SELECT 'warning', 'no key', id FROM jf WHERE key = ''
 UNION ALL SELECT 'warning', 'unknown status', id FROM jf WHERE status = '?' UNION ALL SELECT 'warning', 'active without poster', id FROM jf WHERE status = 'in_programmazione' AND poster IS NULL
 UNION ALL SELECT 'error', 'active without showings', id FROM jf WHERE status = 'in_programmazione' AND id NOT IN (SELECT id FROM js)
 UNION ALL SELECT 'error', 'bad date', id FROM js WHERE language = 'R' UNION ALL SELECT 'warning', 'no times', id FROM js WHERE language = 'N'
 UNION ALL SELECT 'error', 'no location name', id FROM js WHERE language = 'R' AND screen = 'O' UNION ALL SELECT 'warning', 'no location slug', id FROM js WHERE screen = 'F'
 UNION ALL SELECT 'error', 'bad time', id FROM js WHERE language = 'R')"""


@query("validate_films", f"{_JUDGED} SELECT level, rule, CAST(id AS VARCHAR) AS entity, count(*) AS findings FROM found GROUP BY ALL")
def _(d: Data) -> DataFrame:
    found = qa.validate_films(_judged_films(d), _judged_showings(d))
    return found.groupBy("level", "rule", "entity").agg(F.count("*").alias("findings"))


@query("verdict", f"{_JUDGED} SELECT count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings, count(*) FILTER (level = 'error') > 0 AS failed FROM found")
def _(d: Data) -> DataFrame:
    return qa.verdict(qa.validate_films(_judged_films(d), _judged_showings(d)))


@query("validate_cinemas", f"""{sql.STORE} SELECT 'warning' AS level, 'no coordinates' AS rule, slug AS entity FROM cinemas WHERE lat = 0 OR lon = 0
 UNION ALL SELECT 'warning', 'no website', slug FROM cinemas WHERE website IS NULL UNION ALL SELECT 'warning', 'no place url', slug FROM cinemas WHERE maps_place_url IS NULL
 UNION ALL SELECT 'error', 'bad place url', slug FROM cinemas WHERE maps_place_url = 'http://elsewhere'""")
def _(d: Data) -> DataFrame:
    return qa.validate_cinemas(d.cinemas).select("level", "rule", "entity")


@query("field_coverage", f"""{_JUDGED}, c AS (SELECT count(*) AS total, count(poster) AS poster, count(*) FILTER (p_size > 25) AS description, count(*) FILTER (p_size > 3) AS director,
 count(*) FILTER (p_size > 30) AS duration, count(*) FILTER (p_size > 10) AS genres, count(*) FILTER (id IN (SELECT id FROM js)) AS showings,
 count(*) FILTER (status = 'in_programmazione') AS status_active, count(*) FILTER (status = 'rimosso') AS status_removed FROM jf),
 l AS (UNPIVOT c ON poster, description, director, duration, genres, showings, status_active, status_removed INTO NAME field VALUE films) SELECT field, films, total, 100 * films // total AS percent FROM l""")
def _(d: Data) -> DataFrame:
    return qa.field_coverage(_judged_films(d), _judged_showings(d))


@query("label_coverage", """SELECT source, count(*) AS documents, count(quality) AS labelled, count(*) FILTER (quality IS NULL) AS missing, count(*) FILTER (toxic = 1) AS toxic
 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def _(d: Data) -> DataFrame:
    documents = d.table("documents").join(d.table("labels"), "doc_id", "left")
    found = qa.findings(
        documents, F.col("source"),
        [("info", "document", F.lit(True), F.lit(None)), ("info", "labelled", F.col("quality").isNotNull(), F.lit(None)), ("warning", "missing", F.col("quality").isNull(), F.lit(None)), ("error", "toxic", F.col("toxic") == 1, F.lit(None))],
    )
    count = lambda rule, name: F.count_if(F.col("rule") == rule).alias(name)
    return found.groupBy(F.col("entity").alias("source")).agg(count("document", "documents"), count("labelled", "labelled"), count("missing", "missing"), count("toxic", "toxic"))
