"""Session settings and lineage control shared by every job."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Settings the jobs rely on. AQE splits skewed shuffle partitions, coalesces small ones and
# turns a sort-merge join into a broadcast only after it has measured the smaller side.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    # Estimates follow the size of files, which says nothing of rows after an explode, of texts that a projection
    # makes or of columns that compress well: beyond reference lists, only what was measured goes through the driver.
    "spark.sql.autoBroadcastJoinThreshold": "64KB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Keep every core busy on small but costly inputs; large ones still aim at the advisory size.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # The JVM never compiles methods above 8000 bytes: long text and payload expressions are faster
    # as split projections than fused into one such method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Jobs with large rows ask for smaller batches; every job starts from the usual size.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session, ship the package to its workers, and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no common folder."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if getattr(context, "_shipped", None) == str(package):
        return
    archive = Path(tempfile.mkdtemp(prefix="playbill-")) / "playbill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._shipped = str(package)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the one the cluster names, never a machine-local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        local = tempfile.mkdtemp(prefix="playbill-ckpt-")
        spark.conf.set("spark.checkpoint.dir", local)
        return local
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


@contextmanager
def groups_of_sorted_rows(spark: SparkSession) -> Iterator[None]:
    """Let Spark aggregate rows that are sorted by their group as they come, without a hash table and its own sort."""
    key = "spark.sql.execution.replaceHashWithSortAgg"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, *metrics: Column) -> DataFrame | tuple[DataFrame, dict]:
    """Cut the lineage by writing a table and reading it back.

    A table survives the loss of executors, and unlike an RDD checkpoint its size is known to
    the planner, so later joins choose broadcast or shuffle from a measured size. With aggregate
    ``metrics`` their values are observed during the write and returned as well.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/playbill/{uuid.uuid4().hex}"
    watch = Observation()
    source = df.observe(watch, *metrics) if metrics else df
    source.write.mode("errorifexists").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.folder = path
    return (table, watch.get) if metrics else table


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote and that nothing will read any more.

    Spark deletes shuffle files when the driver's memory of them is collected, which a small plan may not cause for long: ask for it.
    """
    for table in tables:
        spark = table.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.folder)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()
