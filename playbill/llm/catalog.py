"""The operators as queries over the given tables, with SQL where SQL can express the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from playbill.llm import chunked_bpe, language, line_dedup, near_dups, packing, periodic, projection_trees, repair, sketches, token_counts, token_files, top_k, wrappers
from playbill.llm.tables import read, texts
from playbill.session import checkpoint_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable) -> Callable:
    QUERIES[function.__name__] = function
    return function


@query
def op1_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = sketches.edited_sketches(read(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketches.as_text("hashes").alias("fingerprint"), sketches.as_text("edited_hashes").alias("edited_fingerprint"),
        sketches.likeness("hashes", "edited_hashes").alias("near_edited"), sketches.likeness("hashes", "next_hashes").alias("near_next"),
    )


@query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k.top_k(read(spark, folder, "embeddings"))


ORACLES["op3_exact_top_k"] = """
WITH given AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM given q JOIN given c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20"""


@query
def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return chunked_bpe.encoded(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


@query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    held = docs.withColumn("held_out", ~language.train_fold())
    return language.identified(held, language.train(docs), "held_out")


@query
def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/playbill/{uuid.uuid4().hex}"
    token_files.write(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_files.index(token_files.read(spark, path))


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.token_counts(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.main_texts(read(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.dedup_lines(texts(read(spark, folder, "documents")))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES["op9_line_dedup"] = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.holder AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dups.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = read(spark, folder, "conversations")
    report, repaired = repair.repair(repair.damaged(given))
    ids = given.select("conv_id").distinct()
    report, digests = (df.withColumnRenamed("conv_id", name) for df, name in ((report, "found"), (repair.digests(repaired), "hashed")))
    named = ids.join(report, F.col("conv_id").eqNullSafe(F.col("found")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("hashed")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return named.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query
def op12_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return projection_trees.nearest(read(spark, folder, "embeddings"))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.runs(periodic.with_loops(read(spark, folder, "documents"))).withColumn("longest", periodic.longest())
    spans = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("(1000 * longest.length) div -longest.period").alias("exponent_milli"), F.sha2(spans, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
