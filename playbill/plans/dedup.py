"""Duplicate maintenance of the store: plan first, apply only on request.

A plan is a set of tables computed from the store; building it writes nothing to the store. Rules
apply in order of certainty, and a film claimed by one rule is out of reach for the next:

1. pairs approved by hand (transitively);
2. same recomputed key and year, where unknown years adopt the only known one;
3. same external id.

Groups whose members disagree on external id or year are left undecided.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from playbill.functions import text as tx
from playbill.operators import ranking as rk
from playbill.operators.components import connected_components
from playbill.operators.grouping import showing_counts
from playbill.operators.similarity import candidate_pairs
from playbill.session import materialise

BY_HAND = "approved by hand"
KEY_AND_YEAR = "same key and year"
KEY_NULL_YEAR = "same key, unknown year adopted"
EXTERNAL_ID = "same external id"


def validate_pairs(raw: DataFrame, column: str = "pair") -> tuple[DataFrame, DataFrame]:
    """(pairs, rejected) of texts ``A:B``: two different whole numbers each."""
    parts = F.split(column, ":")
    # Digits only: a sign or a decimal point is not an id.
    number = lambda i: F.when(F.trim(parts[i]).rlike(r"^\d+$"), F.trim(parts[i]).try_cast("bigint"))
    read = raw.select(column, F.when(F.size(parts) == 2, number(0)).alias("a"), F.when(F.size(parts) == 2, number(1)).alias("b"))
    good = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    return read.filter(good).select("a", "b"), read.filter(~F.coalesce(good, F.lit(False))).select(column)


@dataclass(frozen=True)
class DedupPlan:
    """Tables of a plan.

    members: (group, rule, block_reason, survivor_id, …film columns); undecided groups have a
    reason and no effect. slots: showings of merged films with their outcome. fills: adopted and
    conflicting fields. keys: (id, old_key, new_key, frozen). candidates: lookalikes no rule took.
    """

    films: DataFrame
    showings: DataFrame
    members: DataFrame
    slots: DataFrame
    fills: DataFrame
    keys: DataFrame
    candidates: DataFrame

    @property
    def merged(self) -> DataFrame:
        return self.members.filter("block_reason is null")

    @property
    def undecided(self) -> DataFrame:
        return self.members.filter("block_reason is not null")

    @property
    def losers(self) -> DataFrame:
        return self.merged.filter("id <> survivor_id").select("id", "survivor_id")


def _manual_groups(films: DataFrame, pairs: DataFrame) -> DataFrame:
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    unknown = named.join(films.select("id"), "id", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"approved pairs name unknown films: {[r.id for r in unknown]}")
    labels = connected_components(pairs)
    return labels.select(F.col("node").alias("id"), F.concat(F.lit("hand:"), F.col("root")).alias("group"), F.lit(BY_HAND).alias("rule"), F.lit(None).cast("string").alias("doubt"))


def _key_groups(films: DataFrame) -> DataFrame:
    """Members of groups by recomputed key; only sizes and distinct years travel per key."""
    years = materialise(films.groupBy("new_key", "year").agg(F.count("*").alias("n")))
    shape = years.groupBy("new_key").agg(
        F.count("year").alias("known_years"),
        F.min("year").alias("only_year"),
        F.coalesce(F.sum(F.when(F.col("year").isNull(), F.col("n"))), F.lit(0)).alias("unknown"),
    )
    rows = films.select("id", "new_key", "year").alias("f").join(
        years.alias("y"), (F.col("f.new_key") == F.col("y.new_key")) & F.col("f.year").eqNullSafe(F.col("y.year"))
    ).select("f.*", "n").join(materialise(shape), "new_key")
    adopts = (F.col("unknown") > 0) & (F.col("known_years") == 1)
    year_text = F.coalesce(F.col("year").cast("string"), F.lit("none"))
    grouped = rows.filter(adopts | (F.col("n") > 1))
    doubt = F.when(~adopts & F.col("year").isNull() & (F.col("known_years") > 1), F.lit("unknown year with several known years"))
    return grouped.select(
        "id",
        F.concat(F.lit("key:"), F.col("new_key"), F.lit(":"), F.when(adopts, F.lit("any")).otherwise(year_text)).alias("group"),
        F.when(adopts, KEY_NULL_YEAR).otherwise(KEY_AND_YEAR).alias("rule"),
        doubt.alias("doubt"),
    )


def _external_groups(films: DataFrame) -> DataFrame:
    shared = films.filter("wikidata_id <> ''").groupBy("wikidata_id").agg(F.count("*").alias("n")).filter("n > 1")
    rows = films.join(shared.select("wikidata_id"), "wikidata_id", "left_semi")
    return rows.select("id", F.concat(F.lit("external:"), F.col("wikidata_id")).alias("group"), F.lit(EXTERNAL_ID).alias("rule"), F.lit(None).cast("string").alias("doubt"))


def _conflict() -> Column:
    """Aggregate: why the members of a group cannot be one film, or null."""
    external = F.nullif(F.col("wikidata_id"), F.lit(""))
    clash = lambda c, name: F.when(F.min(c) != F.max(c), F.concat(F.lit(f"{name} in conflict: "), F.min(c).cast("string"), F.lit(", "), F.max(c).cast("string")))
    return F.coalesce(F.max("doubt"), clash(external, "external id"), clash(F.col("year"), "year"))


def build_plan(films: DataFrame, showings: DataFrame, approved: DataFrame | None = None) -> DedupPlan:
    """Plan the merges of a store; ``approved`` is a table of pairs (a, b)."""
    counts = showing_counts(showings).withColumnRenamed("film_id", "id")
    rated = films.join(counts, "id", "left").withColumn("showing_count", F.coalesce("showing_count", F.lit(0)))
    rated = materialise(rated.withColumn("new_key", tx.store_key(F.col("title"))))

    claims = []
    left = rated
    if approved is not None:
        claims.append(materialise(_manual_groups(rated, approved)))
        left = left.join(claims[-1].select("id"), "id", "left_anti")
    claims.append(materialise(_key_groups(left)))
    # Undecided groups keep their claim on their members.
    left = left.join(claims[-1].select("id"), "id", "left_anti")
    claims.append(_external_groups(left))
    claimed = claims[0]
    for more in claims[1:]:
        claimed = claimed.unionByName(more)

    members = rated.join(claimed, "id")
    judged = members.groupBy("group").agg(
        F.when(F.first("rule") != BY_HAND, _conflict()).alias("block_reason"), F.min(rk.survivor_rank())["id"].alias("survivor_id")
    )
    members = materialise(members.drop("doubt").join(materialise(judged), "group"))
    merged = members.filter("block_reason is null")

    seats = showings.join(merged.select(F.col("id").alias("film_id"), "group", "survivor_id"), "film_id")
    slots = materialise(rk.resolve_slot_collisions(seats))
    fills = materialise(rk.plan_fills(merged))
    keys = _plan_keys(rated, merged, fills)
    candidates = candidate_pairs(rated.select("id", F.col("new_key").alias("key")), members.select("id", "group"))
    return DedupPlan(films, showings, members, slots, fills, keys, candidates)


def _plan_keys(rated: DataFrame, merged: DataFrame, fills: DataFrame) -> DataFrame:
    """Survivors whose stored key is out of date; those that would collide stay frozen."""
    losers = merged.filter("id <> survivor_id").select("id")
    adopted = fills.filter("field = 'year' and adopted is not null").select(F.col("survivor_id").alias("id"), F.col("adopted").cast("int").alias("new_year"))
    final = rated.join(losers, "id", "left_anti").join(adopted, "id", "left")
    final = final.select("id", "title", F.col("title_normalized").alias("old_key"), "new_key", F.coalesce("new_year", "year").alias("final_year"))
    taken = final.groupBy("new_key", "final_year").agg(F.count("*").alias("n")).filter("n > 1").drop("n").withColumn("frozen", F.lit(True))
    stale = final.filter("new_key <> old_key").alias("s")
    joined = stale.join(taken.alias("t"), (F.col("s.new_key") == F.col("t.new_key")) & F.col("s.final_year").eqNullSafe(F.col("t.final_year")), "left")
    return joined.select("s.id", "s.title", "s.old_key", "s.new_key", F.coalesce("t.frozen", F.lit(False)).alias("frozen"))


def apply_plan(plan: DedupPlan) -> tuple[DataFrame, DataFrame]:
    """(films, showings) after the plan: all of it or, if a write fails, nothing."""
    adopted = plan.fills.filter("adopted is not null").groupBy(F.col("survivor_id").alias("id"))
    adopted = adopted.agg(F.map_from_entries(F.collect_list(F.struct("field", "adopted"))).alias("_adopted"))
    keys = plan.keys.filter("not frozen").select("id", F.col("new_key").alias("_key"))
    films = plan.films.join(plan.losers.select("id"), "id", "left_anti").join(adopted, "id", "left").join(keys, "id", "left")
    kinds = {f.name: f.dataType for f in plan.films.schema.fields}
    values = {c: F.coalesce(c, F.try_element_at("_adopted", F.lit(c)).cast(kinds[c])) for c in rk.FILL_FIELDS}
    values["title_normalized"] = F.coalesce("_key", "title_normalized")
    films = films.withColumns(values).select(*plan.films.columns)

    moved = plan.slots.select("id", "outcome", F.col("survivor_id").alias("_to"))
    showings = plan.showings.join(moved, "id", "left").filter("outcome is null or outcome <> 'discard'")
    showings = showings.withColumn("film_id", F.when(F.col("outcome") == "move", F.col("_to")).otherwise(F.col("film_id")))
    return films, showings.select(*plan.showings.columns)


def report(plan: DedupPlan) -> dict[str, DataFrame]:
    """The plan as report tables."""
    merged, slots = plan.merged, plan.slots
    per_group = slots.groupBy("group").agg(
        F.count_if(F.col("outcome") == "move").alias("moved"), F.count_if(F.col("outcome") == "discard").alias("discarded")
    )
    shape = plan.members.groupBy("group", "rule", "survivor_id", "block_reason").agg(F.count("*").alias("members"))
    groups = shape.join(per_group, "group", "left").fillna(0, ["moved", "discarded"])
    kept = plan.showings.select(F.col("id").alias("kept_id"), F.col("times").alias("kept_times"), F.col("scraped_at").alias("kept_scraped_at"))
    discards = slots.filter("outcome = 'discard'").join(kept, "kept_id")
    totals = merged.agg(F.count_distinct("group").alias("groups"), F.count("*").alias("rows_to_merge"), F.count_if(F.col("id") != F.col("survivor_id")).alias("rows_removed"))
    moves = slots.agg(F.count_if(F.col("outcome") == "move").alias("moved"), F.count_if(F.col("outcome") == "discard").alias("discarded"))
    return {
        "groups": groups,
        "moves": slots.filter("outcome = 'move'"),
        "discards": discards,
        "conflicts": rk.fill_conflicts(merged, plan.fills),
        "keys": plan.keys,
        "candidates": plan.candidates,
        "summary": totals.withColumns({c: moves.select(c).scalar() for c in ("moved", "discarded")}),
    }
