"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, and the least hash of all, so that a
short text has one too. Its size follows the text, which keeps estimates of containment sound between a page and
a book. Sketches of parts merge into the sketch of the whole: unite them, and keep what is below the threshold
and the least. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from playbill.llm.tables import ascii_lower, partitions, texts
from playbill.session import materialise

WORDS = 5
#: One in so many hashes is kept.
SCALE = 4
BLANKS = r"[\x20\x09-\x0D]+"
NO_ID = -(2**63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kept(hashes: Column, scale: int) -> Column:
    below = F.lit(-(2**63) + 2**64 // scale)
    least = F.array_compact(F.array(F.array_min(hashes)))
    return F.sort_array(F.array_union(F.filter(hashes, lambda h: h < below), least))


def sketch(text: str | Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """The sketch of a text as a sorted array of hashes; A-Z are lowered, white space only separates.

    A text of fewer words is one shingle; null, empty and blank texts have the empty sketch.
    """
    text = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BLANKS), lambda w: w != "")
    each = F.transform(parts, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        last = F.size(h) - words
        run = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(last >= 0, run).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _let(_let(each, shingles), lambda h: _kept(h, scale))


def merged(a: str | Column, b: str | Column, scale: int = SCALE) -> Column:
    """The sketch of two texts together, from their sketches."""
    return _let(F.array_union(a, b), lambda h: _kept(h, scale))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: str | Column, b: str | Column) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(hashes: str | Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def next_keys(keys: DataFrame) -> DataFrame:
    """``keys`` (distinct ``key``, other columns) with ``next_key``, the next greater one, or the least after the last.

    Ranges are numbered once and written, as another run of a range partitioning may cut elsewhere; one row for
    each range then tells where the next one begins.
    """
    ranged = keys.repartitionByRange(partitions(keys.sparkSession), "key").withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged)
    firsts = ranged.groupBy("_part").agg(F.min("key").alias("_first"))
    order = Window.orderBy("_part")
    starts = firsts.select("_part", F.coalesce(F.lead("_first").over(order), F.min("_first").over(Window.partitionBy())).alias("_beyond"))
    within = ranged.withColumn("_lead", F.lead("key").over(Window.partitionBy("_part").orderBy("key")))
    return within.join(starts, "_part").withColumn("next_key", F.coalesce("_lead", "_beyond")).drop("_part", "_lead", "_beyond")


def edited_sketches(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Each text, its edited text (the last quarter replaced by the start of the next document's) and the sketches.

    (doc_id, n_chars, edited, hashes, edited_hashes, next_hashes). Texts move twice by doc_id at most, through one
    exchange that both joins read; what goes to the document before is a quarter of a text and a sketch. Null ids
    count as the least. Rows that share a doc_id all get the same next document; of rows that share the next
    doc_id, the one with the least hash of its text is taken.
    """
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text")
    lengths = rows.groupBy("key").agg(F.max(F.length("text")).alias("chars"))
    asks = next_keys(lengths).select(F.col("key").alias("asker"), F.col("next_key").alias("key"), F.floor(F.col("chars") / 4).cast("int").alias("want"))
    answers = rows.join(asks, "key").select(
        "asker", F.struct(F.xxhash64("text").alias("version"), F.expr("substring(text, 1, want)").alias("start"), sketch("text", words, scale).alias("hashes")).alias("next")
    )
    answers = answers.groupBy(F.col("asker").alias("key")).agg(F.min("next").alias("next"))
    joined = rows.join(answers, "key").withColumn("n_chars", F.length("text"))
    edited = F.expr("concat(substring(text, 1, n_chars - n_chars div 4), substring(next.start, 1, cast(n_chars div 4 as int)))")
    both = joined.select("key", "n_chars", "text", edited.alias("edited"), F.col("next.hashes").alias("next_hashes"))
    return both.select(
        F.expr(f"nullif(key, {NO_ID + 1} - 1)").alias("doc_id"), F.col("n_chars").cast("long"), "edited",
        sketch("text", words, scale).alias("hashes"), sketch("edited", words, scale).alias("edited_hashes"), "next_hashes",
    )
