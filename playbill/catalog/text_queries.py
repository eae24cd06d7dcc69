"""Queries of the scalar functions, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playbill.catalog import sql
from playbill.catalog.bindings import Data
from playbill.catalog.registry import Registry
from playbill.functions import text as tx, values as vl
from playbill.operators import fuse as fz, similarity as sm

registry = Registry()
query = registry.query

_TITLES = r"""titles AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)"""
# Titles dressed up the way sources dress them.
_DRESSED = """dressed AS (SELECT p_partkey AS id, CASE p_size % 8 WHEN 0 THEN '  The ' || p_name || ' - 3D' WHEN 1 THEN upper(p_name) || ' (2024)' WHEN 2 THEN p_name || ' – IMAX - VO'
 WHEN 3 THEN 'STAR WARS: ' || p_name || ' and ' || p_type WHEN 4 THEN p_name || ' 4K (RIED. 1999) C.A.' WHEN 5 THEN p_name || ' ' || p_size WHEN 6 THEN 'L’' || p_name || '!'
 ELSE p_name || ' ' || p_type END AS title FROM part)"""


def _dressed(d: Data) -> DataFrame:
    name, kind = F.col("p_name"), F.col("p_size") % 8
    forms = [
        F.concat(F.lit("  The "), name, F.lit(" - 3D")), F.concat(F.upper(name), F.lit(" (2024)")), F.concat(name, F.lit(" – IMAX - VO")),
        F.concat(F.lit("STAR WARS: "), name, F.lit(" and "), "p_type"), F.concat(name, F.lit(" 4K (RIED. 1999) C.A.")), F.concat_ws(" ", name, F.col("p_size").cast("string")),
        F.concat(F.lit("L’"), name, F.lit("!")),
    ]
    title = F.concat_ws(" ", name, "p_type")
    for n, form in enumerate(forms):
        title = F.when(kind == n, form).otherwise(title)
    return d.table("part").select(F.col("p_partkey").alias("id"), title.alias("title"))


@query("normalize_titles", f"WITH {_DRESSED} SELECT id, {sql.normalize_title('title')} AS normalized, {sql.title_key('title')} AS key FROM dressed")
def _(d: Data) -> DataFrame:
    return _dressed(d).select("id", tx.normalize_title(F.col("title")).alias("normalized"), tx.title_key(F.col("title")).alias("key"))


@query("page_title_keys", f"WITH {_TITLES} SELECT page_id, {sql.title_key('title')} AS key FROM titles")
def _(d: Data) -> DataFrame:
    return d.page_titles.select(F.col("arrival_seq").alias("page_id"), tx.title_key(F.col("title")).alias("key"))


@query("store_keys", f"""WITH {_TITLES} SELECT page_id, {sql.store_key('title')} AS key FROM titles""")
def _(d: Data) -> DataFrame:
    return d.page_titles.select(F.col("arrival_seq").alias("page_id"), tx.store_key(F.col("title")).alias("key"))


@query("titles_match", f"WITH {_DRESSED} SELECT a.id, {sql.title_key('a.title')} = {sql.title_key('p_name')} AS same FROM dressed a JOIN part ON p_partkey = a.id")
def _(d: Data) -> DataFrame:
    plain = d.table("part").select(F.col("p_partkey").alias("id"), "p_name")
    return _dressed(d).join(plain, "id").select("id", tx.titles_match(F.col("title"), F.col("p_name")).alias("same"))


_PAIRS = f"""WITH k AS (SELECT c_custkey AS id, lower(c_mktsegment) || (c_custkey % 5) AS a, lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS b FROM customer)"""


@query("fuzzy_match_keys", f"""{_PAIRS} SELECT id, {sql.sequel('a', 'b')} AS sequel, levenshtein(a, b) AS distance,
 (a = b) OR (NOT {sql.sequel('a', 'b')} AND (contains(a, b) OR contains(b, a) OR levenshtein(a, b) <= greatest(2, length(a) // 4))) AS fuzzy FROM k""")
def _(d: Data) -> DataFrame:
    segment = F.lower("c_mktsegment")
    number = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_nationkey").cast("string"))
    keys = d.table("customer").select(
        F.col("c_custkey").alias("id"), F.concat(segment, (F.col("c_custkey") % 5).cast("string")).alias("a"), F.concat(segment, number).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    return keys.select("id", tx.is_numbered_sequel(a, b).alias("sequel"), tx.edit_distance(a, b).alias("distance"), tx.fuzzy_keys(a, b).alias("fuzzy"))


@query("canonical_titles", f"""{sql.STORE} SELECT id, CASE WHEN title_normalized IN ('red bolt small', 'red rod large') THEN 'Red Rod (large)' ELSE title END AS canonical_title FROM films""")
def _(d: Data) -> DataFrame:
    aliases = sm.alias_table(d.spark, [("RED BOLT small", "Red Rod (large)"), ("blue gear", "nothing")])
    return sm.canonical_title(d.films, aliases).select("id", "canonical_title")


_CUT = "(regexp_matches(text, '(\\.{3}|…)\\s*$'))"


@query("truncated_texts", f"SELECT doc_id, {_CUT} AS truncated FROM documents")
def _(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", tx.is_truncated(F.col("text")).alias("truncated"))


@query("fullest_text_per_source", f"""SELECT source, lang, arg_max(doc_id, CAST(CASE WHEN {_CUT} THEN 0 ELSE 1 END AS HUGEINT) * 1000000000000000000000 + length(text) * CAST(1000000000 AS HUGEINT) - doc_id) AS doc_id,
 count(*) AS documents FROM documents WHERE text <> '' GROUP BY source, lang""")
def _(d: Data) -> DataFrame:
    documents = d.table("documents")
    best = documents.groupBy("source", "lang").agg(tx.fullest(F.col("text"), F.col("doc_id")).alias("text"), F.count_if(F.col("text") != "").alias("documents"))
    # The first document that carries the chosen text.
    named = documents.select("source", "lang", "text", "doc_id").join(best, ["source", "lang", "text"])
    return named.groupBy("source", "lang", "documents").agg(F.min("doc_id").alias("doc_id"))


@query("pick_fuller_pairs", f"""WITH p AS (SELECT a.doc_id, a.text AS a, b.text AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
 SELECT doc_id, md5(CASE WHEN a = '' THEN b WHEN b = '' THEN a WHEN {_CUT.replace('text', 'a')} <> {_CUT.replace('text', 'b')} THEN CASE WHEN {_CUT.replace('text', 'a')} THEN b ELSE a END
 WHEN length(a) >= length(b) THEN a ELSE b END) AS digest FROM p""")
def _(d: Data) -> DataFrame:
    documents = d.table("documents")
    pairs = documents.select("doc_id", F.col("text").alias("a")).join(documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b")), "doc_id")
    return pairs.select("doc_id", F.md5(tx.pick_fuller(F.col("a"), F.col("b"))).alias("digest"))


@query("strip_html_pages", r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(html_unescape, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g'), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')) AS digest
 FROM (SELECT page_id, html AS html_unescape FROM pages)""")
def _(d: Data) -> DataFrame:
    return d.table("pages").select("page_id", F.md5(tx.strip_html(F.col("html"))).alias("digest"))


@query("decode_code_units", r"""SELECT p_partkey, p_name || ' & "' || p_type || '"' AS text FROM part""")
def _(d: Data) -> DataFrame:
    coded = F.concat("p_name", F.lit(" \\u0026 &quot;"), "p_type", F.lit("&#34;"))
    return d.table("part").select("p_partkey", tx.decode_entities(coded, code_units=True).alias("text"))


@query("clean_directors", "SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_name END AS director FROM customer")
def _(d: Data) -> DataFrame:
    raw = F.when(F.col("c_nationkey") % 4 == 0, F.lit(" ( ) ")).otherwise(F.concat(F.lit(" ("), "c_name", F.lit(") ")))
    return d.table("customer").select("c_custkey", tx.clean_director(raw).alias("director"))


@query("durations", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS INT) || ' min' WHEN 2 THEN (60 + CAST(l_quantity AS INT)) || ' min'
 WHEN 3 THEN (121 + CAST(l_quantity AS INT)) || ' min' WHEN 4 THEN CAST(l_quantity AS INT) * 60 || ' min' ELSE NULL END AS spoken,
 CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber > 4 THEN 'x' ELSE (60 * l_linenumber + CAST(l_quantity AS INT)) || ' min' END AS iso FROM lineitem""")
def _(d: Data) -> DataFrame:
    line, n = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    spoken = (
        F.when(line == 1, F.concat(n, F.lit(" minuti"))).when(line == 2, F.concat(F.lit("1h "), n, F.lit("m")))
        .when(line == 3, F.concat(F.lit("2:"), F.lpad(n, 2, "0"), F.lit(":30"))).when(line == 4, F.concat(n, F.lit("h"))).otherwise("boh")
    )
    iso = F.when(line == 7, F.lit("PTM")).when(line > 4, F.lit("x")).otherwise(F.concat(F.lit("PT"), line.cast("string"), F.lit("H"), n, F.lit("M")))
    return d.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", vl.normalize_duration(spoken).alias("spoken"), vl.iso_duration(iso).alias("iso"))


@query("minutes_and_years", """SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS price, year(o_orderdate) AS year FROM orders""")
def _(d: Data) -> DataFrame:
    price = F.concat(F.lit("about "), F.format_string("%.0f", F.rint("o_totalprice")), F.lit(" eur 7"))
    stamp = F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return d.table("orders").select("o_orderkey", vl.parse_minutes(price).cast("bigint").alias("price"), vl.parse_year(stamp).alias("year"))


@query("start_stamps", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, strftime(ts, '%H:%M') AS time, CAST(CAST(ts + INTERVAL 1 HOUR AS DATE) AS VARCHAR) AS local_day FROM events")
def _(d: Data) -> DataFrame:
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:30"))
    return d.table("events").select(
        "event_id", vl.start_date(stamp).alias("date"), vl.start_time(stamp).alias("time"), vl.local_date(F.col("ts")).cast("string").alias("local_day")
    )


@query("run_windows", """SELECT o_orderkey, CAST(d AS VARCHAR) AS day FROM (SELECT o_orderkey, unnest(generate_series(o_orderdate, o_orderdate + INTERVAL 7 DAY, INTERVAL 1 DAY))::DATE AS d FROM orders)""")
def _(d: Data) -> DataFrame:
    compact = vl.compact_date(F.date_format("o_orderdate", "yyyyMMdd")).cast("date")
    days = d.table("orders").select("o_orderkey", F.explode(vl.window_dates(compact)).alias("day"))
    return days.select("o_orderkey", F.col("day").cast("string").alias("day"))


@query("absolute_urls", r"""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/img/' || page_id || '.jpg' AS rooted,
 regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || 'next' AS relative,
 regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/up' AS parent, regexp_extract(url, '^([a-z]+):', 1) || '://cdn.org/x' AS scheme FROM pages""")
def _(d: Data) -> DataFrame:
    base = F.col("url")
    image = F.concat(F.lit("/img/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    return d.table("pages").select(
        "page_id", vl.absolute_url(image, base).alias("rooted"), vl.absolute_url(F.lit("./next"), base).alias("relative"),
        vl.absolute_url(F.lit("../../../up"), base).alias("parent"), vl.absolute_url(F.lit("//cdn.org/x"), base).alias("scheme"),
    )


@query("image_urls", "SELECT page_id, url AS image FROM pages")
def _(d: Data) -> DataFrame:
    wrapped = F.concat(F.lit("https://h.org/_next/image?w=64&url="), F.url_encode("url"), F.lit("&q=75"))
    return d.table("pages").select("page_id", vl.clean_image_url(F.when(F.col("page_id") % 2 == 0, wrapped).otherwise(F.col("url"))).alias("image"))


@query("map_urls", f"""{sql.STORE} SELECT slug, coalesce(maps_place_url, 'https://www.google.com/maps/search/?api=1&query=' || lat || ',' || lon) AS url FROM cinemas""")
def _(d: Data) -> DataFrame:
    return d.cinemas.select("slug", vl.maps_url(F.col("maps_place_url"), F.col("lat"), F.col("lon")).alias("url"))


@query("genre_lists", "SELECT p_partkey, p_type || ',' || p_brand || ',' || p_name AS genres, 3 AS n FROM part")
def _(d: Data) -> DataFrame:
    text = F.concat_ws(" ,", "p_type", F.concat_ws(" / ", "p_brand", "p_name"), F.lit(" "))
    items = vl.csv_to_genres(vl.genres_to_csv(vl.split_genres(text)))
    return d.table("part").select("p_partkey", joined_list(items).alias("genres"), F.size(items).alias("n"))


def joined_list(items: Column) -> Column:
    return F.array_join(items, ",")


@query("object_genres", "SELECT p_partkey, p_type || ',' || p_brand AS objects, p_name AS text FROM part")
def _(d: Data) -> DataFrame:
    objects = F.to_json(F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.col("p_brand").alias("name"))))
    read = lambda c: joined_list(vl.variant_genres(F.try_parse_json(c)))
    return d.table("part").select("p_partkey", read(objects).alias("objects"), read(F.concat(F.lit('"'), "p_name", F.lit('"'))).alias("text"))


@query("times_codec", f"{sql.STORE} SELECT id, '[\"' || clock || '\"]' AS json, clock AS times FROM showings")
def _(d: Data) -> DataFrame:
    coded = d.showings.select("id", vl.times_to_json(F.col("times")).alias("json"))
    return coded.select("id", "json", F.array_join(vl.times_from_json(F.col("json")), ",").alias("times"))


@query("event_props", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def _(d: Data) -> DataFrame:
    return d.table("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("showing_signatures", f"{sql.STORE} SELECT id, cinema_slug || ':' || CAST(date AS VARCHAR) || ':' || clock AS signature FROM showings")
def _(d: Data) -> DataFrame:
    return d.showings.select("id", vl.showing_signature(F.col("cinema_slug"), F.col("date"), F.col("times")).alias("signature"))


@query("history_dates", """SELECT o_custkey, CAST(min(d) FILTER (a = 'added') AS VARCHAR) AS first_seen, CAST(max(d) FILTER (a <> 'removed') AS VARCHAR) AS last_seen,
 CAST(max(d) FILTER (a = 'removed') AS VARCHAR) AS last_removal FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d,
 CASE o_orderstatus WHEN 'O' THEN 'added' WHEN 'F' THEN 'updated' ELSE 'removed' END AS a FROM orders) GROUP BY o_custkey""")
def _(d: Data) -> DataFrame:
    action = F.when(F.col("o_orderstatus") == "O", "added").when(F.col("o_orderstatus") == "F", "updated").otherwise("removed")
    events = d.table("orders").select("o_custkey", F.struct(F.to_date("o_orderdate").cast("string").alias("date"), action.alias("action")).alias("event"))
    history = events.groupBy("o_custkey").agg(F.array_sort(F.collect_list("event")).alias("history"))
    h = F.col("history")
    # Without any sighting the first one is null, and so is the last.
    return history.select("o_custkey", vl.first_seen(h).alias("first_seen"), vl.last_seen(h).alias("last_seen"), vl.last_removal(h).alias("last_removal"))


@query("drop_empty_fields", "SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN '{}' ELSE '{\"name\":\"' || c_name || '\",\"list\":[\"' || c_mktsegment || '\"]}' END AS json FROM customer")
def _(d: Data) -> DataFrame:
    gone = F.col("c_nationkey") < 12
    item = F.struct(
        vl.drop_empty(F.when(gone, F.lit("")).otherwise(F.col("c_name"))).alias("name"),
        vl.drop_empty_list(F.when(gone, F.array().cast("array<string>")).otherwise(F.array("c_mktsegment"))).alias("list"),
    )
    return d.table("customer").select("c_custkey", F.to_json(item).alias("json"))


@query("master_titles", """SELECT p_brand, coalesce(arg_min(t, p_partkey) FILTER (t <> upper(t)), arg_min(t, p_partkey)) AS title FROM
 (SELECT p_brand, p_partkey, CASE WHEN p_size < 45 THEN upper(p_name) ELSE p_name END AS t FROM part) GROUP BY p_brand""")
def _(d: Data) -> DataFrame:
    title = F.when(F.col("p_size") < 45, F.upper("p_name")).otherwise(F.col("p_name"))
    return d.table("part").select("p_brand", "p_partkey", title.alias("t")).groupBy("p_brand").agg(fz.master_title(F.col("t"), F.col("p_partkey")).alias("title"))
