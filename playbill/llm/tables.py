"""What the operators share: reading the given tables, and small row helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a batch that crosses to Python. Documents may be long, so batches hold few of them.
BATCH_ROWS = "512"


def small_batches(spark: SparkSession) -> None:
    """Batches for rows with texts. Joins are planned as these operators were measured, with Spark's own threshold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the given tables, whole."""
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text of every row, a null text as the empty one; ``more`` names further columns to keep."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def map_rows(df: DataFrame, function, schema: str, **options) -> DataFrame:
    """mapInArrow with a function from one record batch to lists by column."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema, **options)


def ascii_lower(text: str | Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
