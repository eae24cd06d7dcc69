"""Choices of one row out of a group, as aggregates rather than window sorts.

A window over a group sorts the whole group in one task; ``min`` and ``max_by`` of a struct give
the same row from map-side partials, whatever the size of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from playbill.session import materialise

FILL_FIELDS = (
    "original_title", "year", "runtime_minutes", "genres", "director", "poster_url", "synopsis", "wikidata_id",
)
RANKED_METADATA = ("poster_url", "synopsis", "director")


def survivor_rank() -> Column:
    """Ascending order in which members of a merge group would survive: most showings, known
    year, known external id, most metadata, lowest id."""
    known = sum((F.col(c).isNotNull().cast("int") for c in RANKED_METADATA), F.lit(0))
    return F.struct(
        (-F.col("showing_count")).alias("fewer"),
        F.col("year").isNull().alias("no_year"),
        F.col("wikidata_id").isNull().alias("no_id"),
        (-known).alias("less"),
        F.col("id").alias("id"),
    )


def pick_survivor(members: DataFrame, group: str = "group") -> DataFrame:
    """(group, survivor_id) of members with their ``showing_count``."""
    return members.groupBy(group).agg(F.min(survivor_rank())["id"].alias("survivor_id"))


def resolve_slot_collisions(showings: DataFrame) -> DataFrame:
    """Outcome of each showing when the films of a group become one.

    Per group, location and date the newest ``scraped_at`` stays; on a tie the survivor's, then
    that of the lower film id, then the lower showing id. Adds ``outcome`` (keep, move, discard)
    and ``kept_id``. Needs ``group`` and ``survivor_id``.
    """
    slot = ["group", "cinema_slug", "date"]
    theirs = (F.col("film_id") != F.col("survivor_id")).cast("int")
    order = F.struct(F.col("scraped_at"), -theirs, -F.col("film_id"), -F.col("id"))
    winners = materialise(showings.groupBy(*slot).agg(F.max_by("id", order).alias("kept_id")))
    joined = showings.join(winners, slot)
    won = F.col("id") == F.col("kept_id")
    outcome = F.when(~won, "discard").when(theirs == 1, "move").otherwise("keep")
    return joined.withColumn("outcome", outcome)


def plan_fills(members: DataFrame) -> DataFrame:
    """What each survivor adopts: one row per (group, field) with the value adopted from the
    first loser that has one, or the values in conflict. Needs ``group`` and ``survivor_id``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in FILL_FIELDS])
    long = members.select("group", "survivor_id", "id", F.explode(pairs).alias("p")).select("group", "survivor_id", "id", "p.*")
    mine = F.col("id") == F.col("survivor_id")
    theirs = F.when(~mine & F.col("value").isNotNull(), F.col("value"))
    folded = long.groupBy("group", "survivor_id", "field").agg(
        F.max(F.when(mine, F.col("value"))).alias("current"),
        F.min_by(theirs, F.when(theirs.isNotNull(), F.col("id"))).alias("first_other"),
        F.min(theirs).alias("low"),
        F.max(theirs).alias("high"),
    ).filter("first_other is not null")
    adopted = F.when(F.col("current").isNull(), F.col("first_other"))
    # Two distinct values are enough to know there is a conflict.
    differs = F.when(F.col("current").isNull(), F.col("low") != F.col("high")).otherwise(
        (F.col("low") != F.col("current")) | (F.col("high") != F.col("current"))
    )
    return folded.select("group", "survivor_id", "field", "current", adopted.alias("adopted"), differs.alias("conflict"))


def fill_conflicts(members: DataFrame, fills: DataFrame) -> DataFrame:
    """The losing values behind each conflict of :func:`plan_fills`, one row each."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in FILL_FIELDS])
    long = members.select("group", "id", F.explode(pairs).alias("p")).select("group", "id", "p.*")
    clash = fills.filter("conflict").select("group", "survivor_id", "field", F.coalesce("current", "adopted").alias("kept"))
    return long.join(clash, ["group", "field"]).filter("id <> survivor_id and value is not null and value <> kept")


def assign_ids(rows: DataFrame, seq: str, start: Column | int = 0, name: str = "id", keep_seq: bool = True) -> DataFrame:
    """Consecutive ids from ``start + 1`` in the order of a unique ``seq``, which need not be kept.

    Rows are range-partitioned and numbered inside each partition as they are written, so they are shuffled once;
    only one count per partition is summed up globally.
    """
    placed = rows.repartitionByRange(seq).sortWithinPartitions(seq).withColumn("_at", F.monotonically_increasing_id())
    # The partition in the upper bits, the place inside it in the lower 33.
    spread = materialise(placed if keep_seq else placed.drop(seq)).withColumn("_part", F.shiftright("_at", 33))
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition of the job.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = spread.join(F.broadcast(offsets), "_part")
    base = start if isinstance(start, Column) else F.lit(start)
    place = F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + 1
    return numbered.withColumn(name, (base + F.col("_before") + place).cast("bigint")).drop("_part", "_at", "_before")
