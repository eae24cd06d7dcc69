"""SimHash near-duplicates with vantage-point trees.

Documents become 64-bit fingerprints, and equal fingerprints one point. A tree of vantage points, made from a
bounded sample, cuts the points into shards by Hamming distance: at each node, the points within the node's
radius and those beyond it. A point lives in one shard. By the triangle inequality its partners within ``bits``
can only be in shards that its own distances reach within ``bits`` of each cut, so it visits those as well (of
two shards, only the later one). Each shard goes on with a tree of its own, down to small leaves that are
compared outright. Shards return a spanning forest of their links instead of all pairs: no link between different
components is lost, and a large group of near copies stays linear in what it emits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from playbill.llm.tables import map_rows, partitions, texts
from playbill.operators.components import connected_components
from playbill.session import materialise

BITS = 3
SEED = 42
#: Points of a shard that the tree aims at, and visitors that one task takes to a shard.
SHARD = 8192
VISITORS = 16 * SHARD
#: The sample that the tree is made from: so many for each shard, and so many at most. Beyond that, shards grow.
PER_SHARD, SAMPLE = 32, 1 << 17
#: Points that are compared outright, and fingerprint pairs compared at once.
LEAF, BLOCK = 128, 1 << 21
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: str, words: int) -> int:
    """Bit k is set if it is set in over half the hashes of the word shingles; 0 without words. As a signed long."""
    parts = text.encode().translate(LOWER).split()  # bytes split at \x20 and \x09-\x0D
    if not parts:
        return 0
    digest = xxhash.xxh64_digest
    shingles = [b" ".join(parts)] if len(parts) <= words else map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False))
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 4096):  # a long text in pieces
        total += np.unpackbits(hashes[a : a + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each row's text, a null text being empty."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [simhash(t, words) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return map_rows(texts(docs), of, "doc_id long, fp long")


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _cut(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point among the points and the radius that halves them best; None if none separates them."""
    best = None
    for v in points[:: max(1, len(points) // 4)][:4]:
        d = _distance(points, v)
        inside = np.cumsum(np.bincount(d, minlength=65))
        radius = int(np.argmin(np.abs(inside - len(points) / 2)))
        size = int(inside[radius])
        if 0 < size < len(points):
            score = abs(size - len(points) / 2) + np.count_nonzero(np.abs(d - radius) <= BITS)
            if best is None or score < best[0]:
                best = (score, v, radius)
    return best and best[1:]


class Tree:
    """Nodes as (vantage, radius, inner, outer); a child under 0 is shard -1 - child."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[tuple[np.uint64, int, int, int]] = []
        self.shards = 0
        self.root = self._grow(sample, shards)

    def _grow(self, sample: np.ndarray, shards: int) -> int:
        cut = _cut(sample) if shards > 1 and len(sample) > 1 else None
        if cut is None:
            self.shards += 1
            return -self.shards
        at = len(self.nodes)
        self.nodes.append(())
        inside = _distance(sample, cut[0]) <= cut[1]
        self.nodes[at] = (*cut, self._grow(sample[inside], shards - shards // 2), self._grow(sample[~inside], shards // 2))
        return at

    def route(self, points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, shard, whether it lives there) for each shard that a point lives in or must visit."""
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            at, index, home = todo.pop()
            if not len(index):
                continue
            if at < 0:
                found.append((index, -1 - at, home))
                continue
            vantage, radius, inner, outer = self.nodes[at]
            d = _distance(points[index], vantage)
            inside = d <= radius
            near, far = d <= radius + bits, d > radius - bits
            todo += [(inner, index[near], (home & inside)[near]), (outer, index[far], (home & ~inside)[far])]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        index = np.concatenate([f[0] for f in found])
        shard = np.concatenate([np.full(len(f[0]), f[1]) for f in found])
        home = np.concatenate([f[2] for f in found])
        of = np.empty(len(points), shard.dtype)
        of[index[home]] = shard[home]
        # Of two shards that a pair spans, the point of the earlier one visits the later one.
        wanted = home | (shard > of[index])
        return index[wanted], shard[wanted], home[wanted]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) with the components that the links a-b have."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


class Links:
    """Links found so far, thinned to a forest now and then."""

    def __init__(self):
        self.a, self.b, self.count = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.count += len(a)
            if self.count > 1 << 20:
                self.thin()
                self.count = 0

    def thin(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b = [a], [b]
        return a, b


def compare(points: np.ndarray, queries: np.ndarray, bits: int, found: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Tell ``found`` the places (of queries, of points) of all pairs within ``bits``, by a tree over the points."""
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        cut = _cut(points[p]) if len(p) > LEAF else None
        if cut is None:
            step = max(1, BLOCK // len(p))
            for k in range(0, len(q), step):
                some = q[k : k + step]
                at, of = np.nonzero(np.bitwise_count(queries[some][:, None] ^ points[p][None, :]) <= bits)
                if len(at):
                    found(some[at], p[of])
            continue
        vantage, radius = cut
        d, inside = _distance(queries[q], vantage), _distance(points[p], vantage) <= radius
        todo += [(p[inside], q[d <= radius + bits]), (p[~inside], q[d > radius - bits])]


class Shards:
    """A tree of shards made from a sample, and how rows are dealt to the tasks that work on them."""

    def __init__(self, sample: np.ndarray, number: int, bits: int):
        self.tree, self.bits = Tree(sample, number), bits
        # Visitors that the sample speaks for are divided among several tasks, each with the shard's points.
        visits = np.bincount(self.tree.route(sample, bits)[1], minlength=self.tree.shards)
        share = visits * (number * SHARD / max(1, len(sample)))
        self.tasks = np.maximum(1, np.ceil(share / VISITORS)).astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.tasks)])

    def deal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the point, task, kind): kind 0 for points of a shard, in all its tasks; kind 1 for queries, in one."""
        index, shard, home = self.tree.route(points, self.bits)
        copies = self.tasks[shard[home]]
        own = np.repeat(index[home], copies)
        copy = np.arange(len(own)) - np.repeat(np.cumsum(copies) - copies, copies)
        pick = (points[index] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % self.tasks[shard].astype(np.uint64)
        task = np.concatenate([np.repeat(self.base[shard[home]], copies) + copy, self.base[shard] + pick.astype(np.int64)])
        kind = np.concatenate([np.zeros(len(own), np.int8), np.ones(len(index), np.int8)])
        return np.concatenate([own, index]), task, kind


def sharded(batches: Iterable[pa.RecordBatch], work: Callable[[list[np.ndarray], list[np.ndarray], Links], None]) -> Iterator[pa.RecordBatch]:
    """Links by task. Rows come as (task, kind, columns...), sorted by both: a task's points, then its queries."""
    at, points, held, links = None, [], None, Links()

    def flush() -> Iterator[pa.RecordBatch]:
        a, b = links.thin()
        if len(a):
            yield pa.record_batch([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])

    for batch in batches:
        task, kind, *columns = (c.to_numpy() for c in batch.columns)
        for part in np.split(np.arange(len(task)), np.flatnonzero((np.diff(task) != 0) | (np.diff(kind) != 0)) + 1):
            if not len(part):
                continue
            if task[part[0]] != at:
                yield from flush()
                at, points, held, links = task[part[0]], [], None, Links()
            own = [c[part] for c in columns]
            if kind[part[0]] == 0:
                points.append(own)
            elif points:
                held = held or [np.concatenate(c) for c in zip(*points, strict=True)]
                work(held, own, links)
    yield from flush()


def drawn(values: DataFrame, number: int) -> np.ndarray:
    """A bounded sample of distinct ``fp`` for a tree of so many shards."""
    size = min(SAMPLE, PER_SHARD * number) if number > 1 else 0
    sample = values.orderBy(F.xxhash64("fp"), "fp").limit(size).collect() if size else []
    return np.array([r["fp"] for r in sample], np.int64).view(np.uint64)


def links_of(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """A spanning forest (a, b) of the links within ``bits`` among distinct ``fp``; ``distinct`` is read three times."""
    number = max(1, -(-distinct.count() // SHARD))
    shards = Shards(drawn(distinct, number), number, bits)

    def routed(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column(0).to_numpy()
        index, task, kind = shards.deal(values.view(np.uint64))
        return pa.record_batch([pa.array(task), pa.array(kind), pa.array(values[index])], names=["task", "kind", "fp"])

    def work(points: list[np.ndarray], queries: list[np.ndarray], links: Links) -> None:
        p, q = points[0].view(np.uint64), queries[0].view(np.uint64)

        def found(at: np.ndarray, of: np.ndarray) -> None:
            differ = q[at] != p[of]
            links.add(queries[0][at[differ]], points[0][of[differ]])

        compare(p, q, bits, found)

    rows = map_rows(distinct.select("fp"), routed, "task long, kind byte, fp long")
    return by_task(rows, int(shards.base[-1])).mapInArrow(lambda batches: sharded(batches, work), "a long, b long")


def by_task(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(max(1, min(tasks, partitions(rows.sparkSession))), "task").sortWithinPartitions("task", "kind")


def components(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp): the least doc_id reachable over links, its own included.

    Equal fingerprints are linked, and so are those that differ in ``bits`` or fewer. Repeated rows stay; a null
    doc_id is linked like any other, and names a component only if all its doc_ids are null.
    """
    prints = materialise(prints)
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # Many fingerprints to a batch: they are eight bytes each.
    spark = prints.sparkSession
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    links = materialise(links_of(distinct.select("fp"), bits))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    roots = connected_components(links).withColumnRenamed("node", "fp")
    known = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = materialise(known)
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    return components(fingerprints(docs, words), bits)
