"""An index of the three-character pieces of film keys, for searches inside titles.

Pieces lie in one folder for each first character and update, in order within files. A search opens the folders of its
rarest pieces, and ``contains`` verifies what they give. An update adds the pieces of new and changed keys only; pieces of a key that a
film no longer has are harmless, for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playbill.session import materialise
from playbill.sources import manifest as mf

WIDTH = 3
#: Pieces of a search that are read, the rarest first.
READ = 2
#: Up to this many candidates are looked up by a filter that the film files are pruned by; more are joined.
LOOKED_UP = 1000


def _pieces(key: Column) -> Column:
    """Distinct pieces that start at each character; the last ones end in spaces, which no search ends in."""
    padded = F.concat(key, F.lit(" " * (WIDTH - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key)), lambda at: F.substring(padded, at, F.lit(WIDTH))))


def update_index(films: DataFrame, root: str) -> mf.Manifest:
    """Bring the index up to the films (``id``, ``title_normalized``) and return its new version. Empty and null keys match no search."""
    spark = films.sparkSession
    base = mf.latest(spark, root) or mf.FIRST
    keys = films.select("id", F.col("title_normalized").alias("key")).filter("key <> ''").distinct()
    if "keys" in base.tables:
        keys = keys.join(mf.read(spark, root, base.tables["keys"]), ["id", "key"], "left_anti")
    version = base.next()
    new = mf.write(keys, root, "keys")
    added = mf.read(spark, root, new)
    pieces = materialise(added.select(F.explode(_pieces(F.col("key"))).alias("piece"), "id"))
    counts = pieces.groupBy("piece").agg(F.count("*").alias("films"))
    folder = F.concat_ws("-", F.ascii("piece").cast("string"), F.lit(f"{version.version:06d}"))
    version = version.with_parts("keys", mf.Part(new.schema, {f"{version.version:06d}": new.folders[""]}), [])
    version = version.with_parts("pieces", mf.write(pieces, root, "pieces", folder, ["piece", "id"]), [])
    version = version.with_parts("counts", mf.write(counts, root, "counts", folder, ["piece"]), [])
    return mf.commit(spark, root, version)


def _of(spark: SparkSession, root: str, version: mf.Manifest, name: str, pieces: list[str]) -> DataFrame:
    """Rows of a table that can hold some pieces, from the folders of their first characters."""
    first = {str(ord(p[0])) for p in pieces}
    return mf.read(spark, root, version.tables[name], [k for k in version.tables[name].folders if k.split("-")[0] in first])


def candidates(spark: SparkSession, root: str, needle: str) -> DataFrame:
    """(id): films whose key may contain the needle, every film whose key does among them. No needle matches nothing."""
    version = mf.latest(spark, root)
    nothing = spark.createDataFrame([], "id bigint")
    if version is None or not needle:
        return nothing
    if len(needle) < WIDTH:
        return _of(spark, root, version, "pieces", [needle]).filter(F.startswith("piece", F.lit(needle))).select("id").distinct()
    pieces = sorted({needle[at : at + WIDTH] for at in range(len(needle) - WIDTH + 1)})
    known = _of(spark, root, version, "counts", pieces).filter(F.col("piece").isin(pieces)).groupBy("piece").agg(F.sum("films").alias("films"))
    found = {r.piece: r.films for r in known.collect()}
    if len(found) < len(pieces):
        return nothing
    rarest = sorted(pieces, key=lambda p: (found[p], p))[:READ]
    rows = _of(spark, root, version, "pieces", rarest).filter(F.col("piece").isin(rarest)).distinct()
    return rows.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("id")


def only_candidates(films: DataFrame, root: str, needle: str) -> DataFrame:
    """The films among the candidates of a search."""
    found = candidates(films.sparkSession, root, needle)
    first = [r.id for r in found.limit(LOOKED_UP + 1).collect()]
    if len(first) <= LOOKED_UP:
        return films.filter(F.col("id").isin(first))
    return films.join(found, "id", "left_semi")
