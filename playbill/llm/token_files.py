"""Token ids in ORC files.

Ids are arrays of integers, which ORC stores in run-length encoded streams by stripe, with an index of row groups.
Documents lie in ascending order of their id, so the statistics of stripes and row groups rule out most of a file
for a range of ids, and a Bloom filter on the id rules out row groups for single ones. Stripes are what tasks read in
parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from playbill.llm.encoders import word_bpe
from playbill.llm.tables import map_rows, partitions, texts
from playbill.session import materialise

END_ID = 1
#: Settings of the writer: bytes of a stripe, rows of a row group, share of wrong answers of the Bloom filter.
ORC = {"orc.compress": "zstd", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): the ids of each whole text and the end id; a null text is empty."""
    end = end_id.to_bytes(4, "little")

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = word_bpe(tokenizer).encode
        found = [of(t) + end for t in batch.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
        ids = pa.array(np.frombuffer(b"".join(found), np.int32))
        return pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=["doc_id", "ids"])

    return map_rows(docs.select("doc_id", "text"), encode, "doc_id long, ids array<int>")


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """ORC files under ``path``, in ascending doc_id order within files and from file to file; null ids come first.

    Rows that share a doc_id lie next to each other, ordered by text. Texts move once, before they are encoded.
    """
    given = texts(docs)
    ordered = given.repartitionByRange(partitions(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    encoded(ordered, tokenizer, end_id).write.mode("errorifexists").options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of the files. Filters on doc_id reach the indexes and Bloom filters."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def index(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of files that :func:`write` made; ``start`` counts the ids before.

    Ids are summed up per file first; a row for each file then tells where it starts, and only figures are moved.
    """

    def figures(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:], strict=False)]
        sizes = pa.array(np.diff(at))
        return pa.record_batch([batch.column(0), sizes, pa.array(crc, pa.int64()), batch.column(2), batch.column(3)], names=["doc_id", "n_tokens", "ids_crc32", "file", "row"])

    # Files are named by their place in the order; a row's number tells rows apart that share a doc_id.
    named = files.select("doc_id", "ids", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("file"), F.monotonically_increasing_id().alias("row"))
    # A table, as both the sums per file and the rows come from it.
    return located(materialise(map_rows(named, figures, "doc_id long, n_tokens long, ids_crc32 long, file int, row long")))


def located(rows: DataFrame) -> DataFrame:
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    within = Window.partitionBy("file").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    started = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(files, "file")
    return started.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
