"""Connected components as an iterative DataFrame job.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014): the number of edges never grows, and each step is one aggregation and one join
on the node. Every step writes its result, once, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playbill.session import materialise


def _attach_least(edges: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Edges (u, v) with the least node ``m`` among u and its neighbours."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _attach_least(both, both).filter("v > u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Edges point from the larger node u to the smaller one v. Both kinds come from one pass over the join.
    joined = _attach_least(edges, edges)
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return joined.select(ends.alias("e")).select("e.*").filter("u <> v").distinct()


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes of an edge list with the least node of their component: (node, root).

    Node ids are any ordered values; with arrival numbers the root is the earliest member. Steps alternate until one
    round changes nothing, which takes about the logarithm of the number of nodes. Only a fingerprint of the edge
    set reaches the driver.
    """
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, seen = materialise(edges, *_fingerprint())
    while True:
        large = materialise(_large_star(edges))
        edges, now = materialise(_small_star(large), *_fingerprint())
        # A round that changes nothing leaves stars: every member points at its root.
        if now == seen:
            return _labels(edges)
        seen = now


def _fingerprint() -> list[Column]:
    """An edge set as its count and two independent hash sums, observed while it is written."""
    sums = [F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(20,0)")).alias(f"h{k}") for k in (1, 2)]
    return [F.count("*").alias("n"), *sums]


def _labels(stars: DataFrame) -> DataFrame:
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return members.unionByName(roots)


def component_sizes(labels: DataFrame) -> DataFrame:
    """Members per component, to watch for giant ones."""
    return labels.groupBy("root").agg(F.count("*").alias("members"))


def cluster_pairs(pairs: DataFrame, known: DataFrame, known_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """Clusters of approved pairs, and the ids in them that do not exist.

    A non-empty second frame means the approval list is wrong; the caller decides to stop.
    """
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    unknown = named.join(known.select(F.col(known_id).alias("id")), "id", "left_anti")
    return connected_components(pairs), unknown
