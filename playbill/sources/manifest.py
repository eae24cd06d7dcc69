"""Versioned tables: parts in folders of their own, and one manifest for each version that names them.

A version is a small JSON file under ``_manifests``. It maps every table to its parts, a folder for each partition
key (a day, a month, or the whole table), so a version that changes a few days names the folders of all others
again without reading them. Folders have unique names and are never written twice. A version exists once its
manifest does, which is created only if no other writer has created it; of two writers one is told so. Data of a
writer that failed is never named.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

KEY = "_key"


class VersionTaken(ValueError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Part:
    """A table of one version: its schema, and the folder of every partition key."""

    schema: str
    folders: dict[str, str]


@dataclass(frozen=True)
class Manifest:
    """What one version consists of. ``marks`` are small facts that belong to it, such as the last id given."""

    version: int
    tables: dict[str, Part]
    marks: dict[str, str | int] = field(default_factory=dict)

    def with_parts(self, name: str, new: Part, replaced: Iterable[str]) -> Manifest:
        """The same version with some keys of a table replaced; a replaced key that has no rows any more goes."""
        old = self.tables[name].folders if name in self.tables else {}
        gone = set(replaced)
        folders = {k: f for k, f in old.items() if k not in gone} | new.folders
        return Manifest(self.version, self.tables | {name: Part(new.schema, dict(sorted(folders.items())))}, self.marks)

    def next(self, **marks: str | int) -> Manifest:
        """The version after this one, as yet with the same parts."""
        return Manifest(self.version + 1, dict(self.tables), self.marks | marks)


FIRST = Manifest(0, {})


def _path(spark: SparkSession, name: str) -> tuple:
    """A path of whatever file system holds it, and that file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _children(spark: SparkSession, folder: str) -> list[str]:
    path, system = _path(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def _file(root: str, version: int) -> str:
    return f"{root}/_manifests/{version:012d}.json"


def _parse(text: str) -> Manifest:
    given = json.loads(text)
    return Manifest(given["version"], {n: Part(t["schema"], t["folders"]) for n, t in given["tables"].items()}, given["marks"])


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Version numbers in use, a version that a writer may still be committing included."""
    return [int(n.removesuffix(".json")) for n in _children(spark, f"{root}/_manifests") if n.endswith(".json") and not n.startswith((".", "_"))]


def latest(spark: SparkSession, root: str) -> Manifest | None:
    """The newest complete version; None before the first."""
    for version in reversed(numbers(spark, root)):
        try:
            return load(spark, root, version)
        except ValueError:  # created, but not (yet) written to its end
            continue
    return None


def load(spark: SparkSession, root: str, version: int) -> Manifest:
    """One version; an incomplete one is a ValueError."""
    return _parse("".join(r[0] for r in spark.read.text(_file(root, version), wholetext=True).collect()))


def commit(spark: SparkSession, root: str, manifest: Manifest) -> Manifest:
    """Make a version exist, if none of its number does; otherwise :class:`VersionTaken` and nothing changes."""
    content = {"version": manifest.version, "tables": {n: {"schema": p.schema, "folders": p.folders} for n, p in manifest.tables.items()}, "marks": manifest.marks}
    path, system = _path(spark, _file(root, manifest.version))
    try:
        out = system.create(path, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            raise VersionTaken(f"version {manifest.version} of {root} is taken") from error
        raise
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    return manifest


def write(table: DataFrame, root: str, name: str, key: Column | None = None, order: Iterable[str] = ()) -> Part:
    """Write rows into a new folder, by partition key if one is given, then in some order within files. No version names it yet."""
    spark, folder = table.sparkSession, f"{name}/{uuid.uuid4().hex}"
    if key is None:
        table.write.mode("errorifexists").parquet(f"{root}/{folder}")
        return Part(table.schema.json(), {"": folder})
    # Rebalanced by size: few files for small partitions, several for large ones. The columns stay in the files.
    keyed = table.withColumn(KEY, key.cast("string")).hint("rebalance", KEY)
    if order:
        keyed = keyed.sortWithinPartitions(KEY, *order)
    keyed.write.mode("errorifexists").partitionBy(KEY).parquet(f"{root}/{folder}")
    found = [n for n in _children(spark, f"{root}/{folder}") if n.startswith(f"{KEY}=")]
    return Part(table.schema.json(), {n.removeprefix(f"{KEY}="): f"{folder}/{n}" for n in found})


def schema_of(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))


def read(spark: SparkSession, root: str, part: Part, keys: Iterable[str] | None = None) -> DataFrame:
    """The rows of a table, or those of some partition keys; other folders are neither listed nor opened."""
    schema = schema_of(part.schema)
    wanted = part.folders if keys is None else {k: part.folders[k] for k in keys if k in part.folders}
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{root}/{f}" for f in wanted.values()))


def amend(spark: SparkSession, root: str, change, attempts: int = 20) -> Manifest:
    """Commit ``change(latest or FIRST)`` as the next version, starting again from a newer one if another writer comes first.

    For changes that do not depend on what other writers change, such as the log of a day. What they write stays written.
    """
    for _ in range(attempts):
        base = latest(spark, root) or FIRST
        try:
            number = max([base.version, *numbers(spark, root)]) + 1
            made = change(base)
            return commit(spark, root, Manifest(number, made.tables, made.marks))
        except VersionTaken:
            continue
    raise VersionTaken(f"{root}: {attempts} attempts")


def vacuum(spark: SparkSession, root: str, keep: int) -> int:
    """Delete folders that none of the last ``keep`` versions names, and the manifests before those; how many folders went.

    Not while a writer is at work: folders that it has written are not named yet.
    """
    found = numbers(spark, root)
    known = [load(spark, root, v) for v in found]
    named = {"/".join(f.split("/")[:2]) for m in known[-keep:] for p in m.tables.values() for f in p.folders.values()}
    gone = 0
    for name in sorted({n for m in known for n in m.tables}):
        for folder in _children(spark, f"{root}/{name}"):
            if f"{name}/{folder}" not in named:
                path, system = _path(spark, f"{root}/{name}/{folder}")
                gone += bool(system.delete(path, True))
    for version in found[:-keep]:
        path, system = _path(spark, _file(root, version))
        system.delete(path, False)
    return gone
