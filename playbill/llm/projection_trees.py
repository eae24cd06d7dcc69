"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Every tree halves the vectors again and again at the median of a random direction, one for each level of a tree. The
medians come from a bounded sample; every vector is then sent to its leaf of every tree. A query goes down all trees with
one priority queue: the branches not taken wait in it with the squared distance to the cuts on their way, and
the nearest leaf of any tree comes next. How many leaves a query visits is measured, not set: some queries meet all
vectors first, and the leaves are counted that hold the wanted share of their true neighbours. Leaves are dealt to tasks in
cells of bounded size, and vectors of visited leaves are ranked by their exact inner products.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from playbill.llm.tables import map_rows
from playbill.session import materialise

K = 20
TREES = 4
#: Vectors of a leaf that the trees aim at, and leaves of a tree at most: beyond that, leaves grow.
LEAF, LEAVES = 256, 1024
#: The sample that trees, cells and floors are made from: so many vectors at most, and so many bytes.
SAMPLE, SAMPLE_BYTES = 1 << 14, 1 << 25
#: Bytes of vectors that a task holds at once, and queries it answers at once.
CELL_BYTES, TOGETHER = 1 << 23, 64
#: Queries that are measured, and the share of their true neighbours that the leaves visited must hold.
MEASURED, RECALL = 256, 0.95
#: More than the rounding of an inner product, by which bounds are relaxed; exact scores decide.
SLACK = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) whose vector can be searched: none is null, empty or zero or has a null, NaN or infinite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kind = vectors.schema["embedding"].dataType.elementType
    own = vectors.select("vec_id", F.col("embedding").cast("array<float>" if isinstance(kind, FloatType) else "array<double>").alias("embedding"))
    found = own.filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return found.filter(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))


class Forest:
    """Trees over vectors of one length. Nodes are numbered as in a heap, leaves from left to right."""

    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, seed: int = 1):
        self.total, self.sample = total, sample.astype(np.float64)
        want = min(LEAVES, -(-total // LEAF), max(1, len(sample) // 8))
        self.depth = max(0, int(np.ceil(np.log2(want)))) if want > 1 else 0
        rng, dims = np.random.default_rng(seed), sample.shape[1]
        # Directions of one tree are at right angles as far as they can be, so that squared distances to cuts add up.
        made = [np.linalg.qr(rng.normal(size=(dims, dims if k + dims <= self.depth else self.depth - k)))[0].T for _ in range(trees) for k in range(0, self.depth, dims)]
        self.directions = np.concatenate(made) if made else np.zeros((0, dims))
        self.cuts = np.zeros((trees, 1 << self.depth))
        self.trees, self.leaves = trees, 1 << self.depth
        projected = self.project(self.sample)
        for t in range(trees):
            node = np.ones(len(sample), np.int64)
            for level in range(self.depth):
                for n in range(1 << level, 2 << level):
                    own = projected[node == n, t, level]
                    self.cuts[t, n] = np.median(own) if len(own) else self.cuts[t, n >> 1]
                node = 2 * node + (projected[:, t, level] > self.cuts[t, node])
        self.codes = self.leaf(self.sample)

    def deal(self, counts: np.ndarray) -> None:
        """Put leaves that follow each other into cells that hold about as many vectors as a task may.

        ``counts`` are the vectors of each leaf of each tree. A leaf that is too large for one task has several parts.
        """
        self.counts = counts
        per = max(1, CELL_BYTES // (8 * self.sample.shape[1]))
        self.cell = np.zeros((self.trees, self.leaves), np.int64)
        parts: list[int] = []
        for t in range(self.trees):
            held = per
            for leaf in range(self.leaves):
                if held + counts[t, leaf] > per:
                    parts.append(1)
                    held = 0
                held += int(counts[t, leaf])
                self.cell[t, leaf] = len(parts) - 1
                parts[-1] = max(1, -(-held // per))
        self.parts = np.array(parts)
        self.first = np.concatenate([[0], np.cumsum(self.parts)])

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.directions.T).reshape(len(vectors), self.trees, self.depth)

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        projected, trees = self.project(vectors), np.arange(self.trees)
        node = np.ones((len(vectors), self.trees), np.int64)
        for level in range(self.depth):
            node = 2 * node + (projected[:, :, level] > self.cuts[trees, node])
        return node - self.leaves

    def visits(self, vector: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order in which a query meets them, over all trees."""
        projected = self.project(vector[None])[0].tolist()
        queue = [(0.0, t, 1) for t in range(self.trees)]
        while queue:
            away, t, node = heapq.heappop(queue)
            while node < self.leaves:
                margin = projected[t][node.bit_length() - 1] - self.cuts[t, node]
                other, node = (2 * node, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node)
                heapq.heappush(queue, (away + margin * margin, t, other))
            yield t, node - self.leaves

    def chosen(self, vector: np.ndarray, leaves: int, least: int) -> np.ndarray:
        """Which leaves a query visits, by tree: as many as ``leaves``, or more until they hold ``least`` vectors."""
        met, held = np.zeros((self.trees, self.leaves), bool), np.zeros(self.trees, np.int64)
        for visit, (t, leaf) in enumerate(self.visits(vector)):
            if visit >= leaves and held.max() >= least:
                break
            met[t, leaf] = True
            held[t] += self.counts[t, leaf]
        return met

    def floor(self, vector: np.ndarray, met: np.ndarray, k: int) -> float:
        """What the k-th best of the sample's vectors in the leaves visited scores: a bound for the k-th best of all in them."""
        own = met[np.arange(self.trees), self.codes].any(axis=1)
        scores = self.sample[own] @ vector
        if len(scores) < k:
            return -np.inf
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        return float(least - SLACK * (1 + abs(least)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) of the vectors of a batch."""
    sizes = column.value_lengths().to_numpy()
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        yield int(dims), at, _matrix(column.take(pa.array(at)), int(dims))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, in double precision, in the same order of sums for equal rows."""
    return np.ascontiguousarray(a * b, np.float64).sum(axis=1)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest and what is as large as the last of them but for rounding."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    return np.flatnonzero(scores >= least - SLACK * (1 + abs(least)))


def fitted(distinct: DataFrame) -> dict[int, Forest]:
    """A forest for each length of vectors, from a bounded sample of them."""
    sizes = {r["dims"]: r["n"] for r in distinct.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).collect()}
    out = {}
    for dims, total in sorted(sizes.items()):
        size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
        every = -(-total // size)
        drawn = distinct.filter((F.size("embedding") == dims) & (F.pmod(F.xxhash64(F.lit(1), "embedding"), F.lit(every)) == 0))
        # Chance may draw a few more; the order is by the same hash, so that a seed decides all.
        rows = drawn.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(2 * size).toArrow()
        column = rows.column("embedding").combine_chunks()
        sample = _matrix(column, dims) if len(column) else np.zeros((0, dims))
        out[dims] = Forest(sample, total)
    for dims, forest in out.items():
        forest.deal(_counted(distinct.filter(F.size("embedding") == dims), forest))
    return out


def _counted(distinct: DataFrame, forest: Forest) -> np.ndarray:
    """Vectors in each leaf of each tree."""

    def codes(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = forest.leaf(_matrix(batch.column(0), forest.sample.shape[1]).astype(np.float64)) + forest.leaves * np.arange(forest.trees)
        codes, n = np.unique(found, return_counts=True)
        return pa.record_batch([pa.array(codes), pa.array(n)], names=["code", "n"])

    counts = np.zeros(forest.trees * forest.leaves, np.int64)
    for r in map_rows(distinct.select("embedding"), codes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[r["code"]] = r["n"]
    return counts.reshape(forest.trees, forest.leaves)


def measured(distinct: DataFrame, asked: DataFrame, forests: dict[int, Forest], k: int, queries: int = MEASURED, recall: float = RECALL) -> dict[int, int]:
    """Leaves that a query visits, by length of its vector: as many as hold ``recall`` of the true neighbours of some queries.

    These queries are compared with all vectors; the driver gets their k best and those vectors' leaves.
    """
    out = {}
    for dims, forest in forests.items():
        # The queries that come first by a hash; TakeOrdered keeps as many rows as are asked for.
        rows = asked.filter(F.size("embedding") == dims).orderBy(F.xxhash64(F.lit(2), "embedding"), "node").limit(queries).select("node", "embedding").toArrow()
        if not len(rows):
            continue
        ids, vectors = rows.column("node").to_numpy(), _matrix(rows.column("embedding").combine_chunks(), dims).astype(np.float64)

        def scan(batch: pa.RecordBatch, dims=dims, ids=ids, vectors=vectors, forest=forest) -> pa.RecordBatch:
            node, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dims).astype(np.float64)
            leaves, found = forest.leaf(x), []
            for q, own, scores in zip(range(len(ids)), ids, vectors @ x.T, strict=True):
                at = _best(np.where(node == own, -np.inf, scores), k)
                found.append((np.full(len(at), q), at, scores[at]))
            q, at, score = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.record_batch([pa.array(q), pa.array(score), pa.array(leaves[at].tolist(), pa.list_(pa.int64()))], names=["q", "score", "leaves"])

        given = distinct.filter(F.size("embedding") == dims).select("node", "embedding")
        scored = map_rows(given, scan, "q long, score double, leaves array<long>")
        top = Window.partitionBy("q").orderBy(F.desc("score"))
        best = scored.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).select("q", "leaves").collect()
        wanted: dict[int, list] = {}
        for r in best:
            wanted.setdefault(r["q"], []).append({(t, leaf) for t, leaf in enumerate(r["leaves"])})
        # At which visit each true neighbour is met.
        met = []
        for q, neighbours in wanted.items():
            left = list(range(len(neighbours)))
            for visit, leaf in enumerate(forest.visits(vectors[q]), 1):
                met += [visit for i in left if leaf in neighbours[i]]
                left = [i for i in left if leaf not in neighbours[i]]
                if not left:
                    break
        met.sort()
        out[dims] = met[min(len(met) - 1, int(np.ceil(recall * len(met))))] if met else 1
    return out


def _points(distinct: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """Every vector with its leaf in every tree, in the task that holds that leaf."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            for dims, at, x in _by_length(batch.column(1)):
                forest = forests[dims]
                leaves = forest.leaf(x.astype(np.float64))
                for t in range(forest.trees):
                    cell = forest.cell[t, leaves[:, t]]
                    part = node[at] % forest.parts[cell]
                    data = pa.array([v.tobytes() for v in x], pa.binary())
                    yield pa.record_batch([pa.array(np.full(len(at), dims)), pa.array(forest.first[cell] + part), pa.array(leaves[:, t]), pa.array(node[at]), data], names=["dims", "task", "leaf", "node", "data"])

    return distinct.select("node", "embedding").mapInArrow(run, "dims long, task long, leaf long, node long, data binary")


def _visitors(asked: DataFrame, forests: dict[int, Forest], leaves: dict[int, int], k: int) -> DataFrame:
    """Every query with the leaves it visits, in each task that holds some of them, and a floor for its scores."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            for dims, at, x in _by_length(batch.column(1)):
                forest, wide = forests[dims], x.astype(np.float64)
                rows = []
                for i, v, data in zip(node[at], wide, x, strict=True):
                    met = forest.chosen(v, leaves[dims], k + 1)
                    floor, cells = forest.floor(v, met, k + 1), {}
                    for t, leaf in np.argwhere(met).tolist():
                        cells.setdefault(int(forest.cell[t, leaf]), []).append(leaf)
                    rows += [(dims, int(forest.first[c]) + part, int(i), data.tobytes(), floor, own) for c, own in cells.items() for part in range(int(forest.parts[c]))]
                names = ["dims", "task", "node", "data", "floor", "visits"]
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return asked.select("node", "embedding").mapInArrow(run, "dims long, task long, node long, data binary, floor double, visits array<long>")


def _answers(batches: Iterable[pa.RecordBatch], kind: str, k: int) -> Iterator[pa.RecordBatch]:
    """(query, node, score) of rows sorted by (dims, task, kind): a task's vectors by leaf, then its queries."""
    at, held, points = None, [], None
    for batch in batches:
        dims, task, asks = (batch.column(c).to_numpy() for c in (0, 1, 2))
        change = (np.diff(dims) != 0) | (np.diff(task) != 0) | (np.diff(asks) != 0)
        for part in np.split(np.arange(len(task)), np.flatnonzero(change) + 1):
            own = batch.slice(part[0], len(part))
            if (dims[part[0]], task[part[0]]) != at:
                at, held, points = (dims[part[0]], task[part[0]]), [], None
            data = np.frombuffer(b"".join(own.column(5).to_pylist()), kind).reshape(len(part), -1)
            if asks[part[0]] == 0:
                held.append((own.column(3).to_numpy(), own.column(4).to_numpy(), data))
                continue
            if not held:
                continue
            points = points or tuple(np.concatenate(c) for c in zip(*held, strict=True))
            leaf, node, x = points
            floors, visits = own.column(6).to_numpy(), own.column(7).to_pylist()
            for a in range(0, len(part), TOGETHER):
                q = data[a : a + TOGETHER].astype(np.float64)
                who: dict[int, list[int]] = {}
                for i, some in enumerate(visits[a : a + TOGETHER]):
                    for one in some:
                        who.setdefault(one, []).append(i)
                scores = np.full((len(q), len(node)), -np.inf)
                for one, asking in who.items():
                    lo, hi = np.searchsorted(leaf, [one, one + 1])
                    if lo < hi:
                        scores[asking, lo:hi] = q[asking] @ x[lo:hi].astype(np.float64).T
                found = []
                for i in range(len(q)):
                    met = np.flatnonzero(scores[i] >= max(floors[a + i], -np.finfo(float).max))
                    met = met[_best(scores[i][met], k + 1)]
                    found.append((np.full(len(met), i), met))
                i, met = (np.concatenate(c) for c in zip(*found, strict=True))
                if len(met):
                    ids = own.column(4).to_numpy()[a + i]
                    yield pa.record_batch([pa.array(ids), pa.array(node[met]), pa.array(_exact(q[i], x[met].astype(np.float64)))], names=["query", "node", "score"])


def nearest(vectors: DataFrame, every: int = 20, k: int = K, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every``, the ``k`` vectors of largest inner product found.

    A query finds every row but those of its own vec_id; ties go to the smaller vec_id. Vectors that are null, empty or zero
    or have null or non-finite components, and rows without vec_id, take no part. Only vectors of the query's length
    are compared. Equal vectors are searched once, whatever their number: they are one node with its k + 1 least
    vec_ids, which is all that any query can report of them. Rows that repeat a vec_id are all candidates and a query
    for each; a pair of ids is reported once, with its best score. Other columns of ``vectors`` take no part.
    """
    given = usable(vectors).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(3), "embedding")})
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    # A limit on ranks is applied before the shuffle as well, so that a frequent vector sends few rows.
    few = given.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    firsts = few.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    distinct = materialise(firsts.withColumn("node", F.monotonically_increasing_id()))
    members = given.filter(F.col("vec_id") % every == 0).select("vec_id", "h1", "h2").distinct()
    members = materialise(members.join(distinct.select("h1", "h2", "node"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")))
    asked = materialise(distinct.select("node", "embedding").join(members.select(F.col("query").alias("node")).distinct(), "node", "left_semi"))
    forests = fitted(distinct)
    leaves = measured(distinct, asked, forests, k, recall=recall)
    return _ranked(_met(distinct, asked, forests, leaves, k), distinct, members, k)


def _met(distinct: DataFrame, asked: DataFrame, forests: dict[int, Forest], leaves: dict[int, int], k: int) -> DataFrame:
    """(query, node, score): for each query, what its leaves hold that may be among its k + 1 best."""
    kind = "<f4" if isinstance(distinct.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    points = _points(distinct, forests).select("dims", "task", F.lit(0).alias("asks"), "leaf", "node", "data", F.lit(None).cast("double").alias("floor"), F.lit(None).cast("array<long>").alias("visits"))
    visitors = _visitors(asked, forests, leaves, k).select("dims", "task", F.lit(1).alias("asks"), F.lit(0).cast("long").alias("leaf"), "node", "data", "floor", "visits")
    tasks = sum(int(f.first[-1]) for f in forests.values())
    rows = points.unionByName(visitors).repartition(max(1, tasks), "dims", "task").sortWithinPartitions("dims", "task", "asks", "leaf")
    found = rows.mapInArrow(lambda batches: _answers(batches, kind, k), "query long, node long, score double")
    return materialise(found.groupBy("query", "node").agg(F.max("score").alias("score")))


def _ranked(met: DataFrame, distinct: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The k best of every member of a query, without its own vec_id."""
    ids = distinct.select("node", F.explode("ids").alias("vec_id"))
    named = met.join(ids, "node").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = named.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1).drop("rank")
    each = members.join(top, "query").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
