"""Every past day of a table, stored as the rows that came and went.

A day adds two parts: the rows that were not there the day before (``opened``), and names of the rows that are there no more
(``closed``). A table that hardly changes hardly grows, and no night writes it whole. Rows are told apart by all their columns;
a row that occurs several times is stored once with its number. Compaction turns rows that have gone into closed intervals,
in folders by the month in which they went.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from playbill.session import materialise
from playbill.sources import manifest as mf

BASE = "base"
NAME = ["sig", "copies", "valid_from"]
CLOSED = "sig binary, copies bigint, valid_from date, valid_to date"


def _signed(table: DataFrame) -> DataFrame:
    """(sig, row, copies) of the distinct rows of a table."""
    row = F.struct(*[F.col(c) for c in table.columns])
    sig = F.unhex(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256))
    return table.select(sig.alias("sig"), row.alias("row")).groupBy("sig").agg(F.any_value("row").alias("row"), F.count("*").alias("copies"))


def _closed(spark: SparkSession, root: str, version: mf.Manifest, until: str) -> DataFrame:
    part = version.tables.get("closed")
    return mf.read(spark, root, part, [k for k in part.folders if k <= until]) if part else spark.createDataFrame([], CLOSED)


def _rows(spark: SparkSession, root: str, version: mf.Manifest, day: str) -> DataFrame:
    """(row, sig, copies, valid_from) of the rows there on a day: parts up to it, and gone rows that had not gone yet."""
    opened = version.tables["opened"]
    came = mf.read(spark, root, opened, [k for k in opened.folders if k == BASE or k <= day]).filter(F.col("valid_from") <= F.lit(day).cast("date"))
    here = came.join(_closed(spark, root, version, day).select(*NAME), NAME, "left_anti")
    past = version.tables.get("past")
    if past is None:
        return here
    still = mf.read(spark, root, past, [k for k in past.folders if k >= day[:7]])
    inside = (F.col("valid_from") <= F.lit(day).cast("date")) & (F.col("valid_to") > F.lit(day).cast("date"))
    return here.unionByName(still.filter(inside).drop("valid_to"))


def record_day(table: DataFrame, day: str, root: str) -> mf.Manifest:
    """Add a table as it is on a day (``YYYY-MM-DD``). The last recorded day can be recorded again; an earlier one is a ValueError.

    A table with other columns than before is a ValueError too. Of two writers one gets
    :class:`~playbill.sources.manifest.VersionTaken`.
    """
    spark = table.sparkSession
    base = mf.latest(spark, root) or mf.FIRST
    last = base.marks.get("last", "")
    if day < last or day <= base.marks.get("compacted", ""):
        raise ValueError(f"{day} is before {last}, the last day of {root}, or compacted")
    now = materialise(_signed(table))
    opening, closing = now, spark.createDataFrame([], CLOSED)
    tables = dict(base.tables)
    for name in ("opened", "closed"):  # a day that is recorded again counts as not recorded
        if name in tables:
            tables[name] = mf.Part(tables[name].schema, {k: f for k, f in tables[name].folders.items() if k != day})
    before = mf.Manifest(base.version, tables, base.marks)
    if "opened" in tables:
        if _row_type(tables["opened"].schema) != _row_type(now.schema.json()):
            raise ValueError(f"the columns of {root} have changed: begin a new history")
        there = materialise(_rows(spark, root, before, day))
        opening = now.join(there.select("sig", "copies"), ["sig", "copies"], "left_anti")
        closing = there.join(now.select("sig", "copies"), ["sig", "copies"], "left_anti").select(*NAME, F.lit(day).cast("date").alias("valid_to"))
    opened = mf.write(opening.withColumn("valid_from", F.lit(day).cast("date")).select("row", *NAME), root, "opened", F.lit(day))
    closed = mf.write(closing, root, "closed", F.lit(day))
    return mf.commit(spark, root, before.next(last=day).with_parts("opened", opened, [day]).with_parts("closed", closed, [day]))


def _row_type(schema: str) -> str:
    return mf.schema_of(schema)["row"].dataType.simpleString()


def as_of(spark: SparkSession, root: str, day: str) -> DataFrame:
    """The table as it was on a day; a day without a record is as the last one before it. Before the first day it is empty."""
    version = mf.latest(spark, root)
    if version is None:
        raise ValueError(f"{root} holds no history")
    rows = _rows(spark, root, version, day)
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def compact(spark: SparkSession, root: str, until: str) -> mf.Manifest:
    """Fold the days up to one, which is recorded, into intervals: rows that have gone by then, and one part of those still there."""
    base = mf.latest(spark, root)
    if base is None or until > base.marks["last"]:
        raise ValueError(f"{until} is after the last day of {root}")
    opened, closed = base.tables["opened"], base.tables["closed"]
    folded = [k for k in opened.folders if k == BASE or k <= until]
    came = mf.read(spark, root, opened, folded)
    gone = _closed(spark, root, base, until)
    stay = mf.write(came.join(gone.select(*NAME), NAME, "left_anti"), root, "opened")
    went = came.join(gone, NAME).select("row", *NAME, "valid_to")
    past = mf.write(went, root, "past", F.concat_ws("_", F.date_format("valid_to", "yyyy-MM"), F.lit(until)))
    made = base.next(compacted=until).with_parts("past", past, [])
    made = made.with_parts("opened", mf.Part(opened.schema, {BASE: stay.folders[""]}), folded)
    return mf.commit(spark, root, made.with_parts("closed", mf.Part(closed.schema, {}), [k for k in closed.folders if k <= until]))
