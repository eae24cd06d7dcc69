"""Line dedup: lines that several documents share stay in one of them.

The rows of lines hold no text: a 128-bit hash of the line's key, the document and the position. They are dealt out
by ranges of (hash, document), so that a line found in a third of all documents fills many partitions. Plain aggregates
then take the place of a sorted pass: one row for each hash and document, and per hash how many documents there are and
which comes first. Spark drops the positions and the order within partitions, which these do not need. The operator's
result is a bitmap per document, 64 lines to a word, which names only words in which a line goes; texts are cut by
joining those bitmaps to the documents once. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playbill.llm.tables import ascii_lower, partitions
from playbill.session import materialise

#: The white space that is stripped at both ends of a line.
BLANK = " \t\n\x0b\x0c\r"


def _lines(text: str | Column) -> Column:
    return F.split(text, "\n", -1)


def _versioned(docs: DataFrame) -> DataFrame:
    """Rows may share a doc_id: a row is known by it and by a hash of its text."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("version", F.xxhash64("text"))


def line_rows(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(h1, h2, doc_id, version, pos) of every line whose key has ``min_chars`` code points or more."""
    lines = _versioned(docs).select("doc_id", "version", F.posexplode(_lines("text")).alias("pos", "line"))
    keyed = lines.select("doc_id", "version", "pos", ascii_lower(F.btrim("line", F.lit(BLANK))).alias("key"))
    hashes = [F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")]
    return keyed.filter(F.length("key") >= min_chars).select(*hashes, "doc_id", "version", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, version, words): for documents that lose lines, the keep bits of the words that are not all ones.

    A line goes if its key (blanks stripped, A-Z lowered) has ``min_chars`` code points or more, occurs in
    ``min_docs`` documents or more and this is not the one with the largest doc_id. Several occurrences in one
    document count once and share its fate. Rows with the same doc_id are one document; a null doc_id comes last
    and is one document as well. Null and empty texts have one short line, which stays.
    """
    # Written first: dealing by ranges reads its input twice, and so does what follows.
    rows = materialise(line_rows(docs, min_chars))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")
    once = dealt.groupBy("h1", "h2", F.col("doc_id").alias("holder")).agg(F.min("pos").alias("pos"))
    shared = once.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("holder").alias("first")).filter(F.col("docs") >= min_docs)
    # As a table of known size, and one whose join partitions can be split where a line is frequent.
    gone = rows.join(materialise(shared), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = gone.groupBy("doc_id", "version", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("gone"))
    pairs = F.collect_list(F.struct("word", F.bitwise_not("gone").alias("keep")))
    return words.groupBy("doc_id", "version").agg(F.map_from_entries(pairs).alias("words"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with their kept lines as text, and n_lines and n_dropped. Other columns stay as they are.

    Columns of ``docs`` that are called n_lines or n_dropped give way to the new ones.
    """
    # As an array up to the last word that is named, so that a line finds its word in one step.
    dense = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("words"))), lambda w: F.coalesce(F.element_at("words", w), F.lit(-1).cast("long")))
    cut = bitmaps.select(F.col("doc_id").alias("cut_doc"), F.col("version").alias("cut_version"), dense.alias("keep"))
    others = [F.col(c).alias(f"given_{k}") for k, c in enumerate(docs.columns)]
    given = _versioned(docs.select("doc_id", "text", *others))
    joined = given.join(cut, F.col("doc_id").eqNullSafe(F.col("cut_doc")) & (F.col("version") == F.col("cut_version")), "left")
    word = lambda i: F.coalesce(F.get("keep", (i / 64).cast("int")), F.lit(-1).cast("long"))
    kept = F.filter("lines", lambda line, i: F.getbit(word(i), i % 64) == 1)
    out = joined.withColumn("lines", _lines("text")).withColumn("left", F.when(F.col("keep").isNull(), F.col("lines")).otherwise(kept))
    text = F.array_join("left", "\n").alias("text")
    columns = [text if c == "text" else F.col(f"given_{k}").alias(c) for k, c in enumerate(docs.columns) if c not in ("n_lines", "n_dropped")]
    return out.select(*columns, F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The documents without the lines that :func:`keep_bitmaps` takes away."""
    return apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs))
