"""Exact top-k inner products by branch and bound over columns.

Vectors are packed into blocks, one row for each, with dimensions as rows of a matrix, so that a run of dimensions
lies together. Every block of queries meets every block of vectors once, in a task of its own. There, products are
summed up one run of dimensions after the other, for some queries together; what the dimensions to come can add at most is known from the
remaining masses of both sides (Cauchy-Schwarz), and vectors that cannot reach the k-th best score any more
drop out, the others moving together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from playbill.llm.tables import map_rows, partitions
from playbill.session import materialise

K = 20
#: Factor that makes components integers.
FACTOR = 64
#: Rows in a block, and dimensions summed up between two looks at the bounds.
VECTORS, QUERIES, RUN = 16384, 1024, 16
#: Up to here doubles hold every integer, so sums of products are exact.
EXACT = 2.0**53
#: The same for single precision, which is twice as fast.
EXACT_SINGLE = 2.0**24
#: Queries whose runs are summed up together, and the share of vectors alive below which each goes on alone.
TILE, SPARSE = 64, 0.1


def blocks(vectors: DataFrame, rows: int, number: int) -> DataFrame:
    """(block, dims, kind, ids, data): ``vectors`` (vec_id, embedding) as integer matrices of dims x up to ``rows`` values.

    Null vectors and those with null, NaN or infinite components are left out, and so are empty ones. Vectors of
    different length never share a block. Components beyond the range of a long take its ends.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        part, made = None, 0

        def emit(dims: int) -> pa.RecordBatch:
            nonlocal made
            ids, data = zip(*held.pop(dims), strict=True)
            made += 1
            matrix = np.ascontiguousarray(np.concatenate(data).T)
            # The narrowest integers that hold the values.
            kind = next(t for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= matrix.min() and matrix.max() <= np.iinfo(t).max)
            row = [part * (1 << 32) + made, dims, kind, np.concatenate(ids).tobytes(), matrix.astype(kind).tobytes()]
            return pa.record_batch([pa.array([v]) for v in row], names=["block", "dims", "kind", "ids", "data"])

        for batch in batches:
            part = batch.column(2)[0].as_py() if part is None else part
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            gaps = flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            bad = np.concatenate([[0], np.cumsum(gaps | ~np.isfinite(values))])
            good = (sizes > 0) & (bad[starts[1:]] == bad[starts[:-1]])
            ids = batch.column(0).to_numpy()
            for dims in np.unique(sizes[good]):
                pick = np.flatnonzero(good & (sizes == dims))
                with np.errstate(over="ignore"):
                    whole = np.floor(values[starts[pick][:, None] + np.arange(dims)] * FACTOR)
                whole = np.clip(whole, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
                for a in range(0, len(pick), rows):
                    n = sum(len(i) for i, _ in held.get(int(dims), []))
                    if n and n + len(pick[a : a + rows]) > rows:
                        yield emit(int(dims))
                    held.setdefault(int(dims), []).append((ids[pick[a : a + rows]], whole[a : a + rows]))
        for dims in list(held):
            yield emit(dims)

    given = vectors.filter("vec_id IS NOT NULL").select("vec_id", "embedding")
    # Numbered by partition: blocks of different tasks never share a number.
    dealt = given.repartition(number).withColumn("part", F.spark_partition_id().cast("long"))
    return dealt.mapInArrow(pack, "block long, dims long, kind string, ids binary, data binary")


def search(queries: tuple[np.ndarray, np.ndarray], vectors: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of each query's k best vectors of a block, and all that tie with the last.

    Both sides are (ids, integers as dims x rows). A query never finds its own id.
    """
    (qids, q), (ids, x) = queries, vectors
    dims = len(x)
    largest = float(np.abs(x.astype(np.float64)).max()) * float(np.abs(q.astype(np.float64)).max()) * dims
    if largest >= EXACT:  # integer sums, which wrap as longs do
        found = [(np.full(len(ids), i), ids, (x * q[:, [c]]).sum(axis=0)) for c, i in enumerate(qids)]
        best = [_top(*f, k) for f in found]
        return tuple(np.concatenate(c) for c in zip(*best, strict=True))
    kind = np.float32 if largest < EXACT_SINGLE else np.float64
    want = k + len(ids) - len(np.unique(ids))  # rows that repeat an id may take places that count once
    # Runs with the largest mass come first, which tightens the bounds early.
    mass = x.astype(np.float64)
    order = np.argsort(-np.einsum("ij,ij->i", mass, mass), kind="stable")
    cuts = [*range(0, dims, RUN), dims]
    # A little above, as masses and their products are rounded.
    rest = lambda m: np.stack([np.sqrt(np.einsum("ij,ij->j", m[a:], m[a:])) for a in cuts[1:]]) * (1 + 1e-5)
    q_rest, x_rest = rest(q[order].astype(np.float64)).astype(kind), rest(mass[order]).astype(kind)
    q, x = q[order].astype(kind), x[order].astype(kind)
    out = []
    for start in range(0, len(qids), TILE):
        tile = slice(start, start + TILE)
        out += _tile(qids[tile], q[:, tile], q_rest[:, tile], ids, x, x_rest, cuts, want, k)
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _tile(qids: np.ndarray, q: np.ndarray, q_rest: np.ndarray, ids: np.ndarray, x: np.ndarray, x_rest: np.ndarray, cuts: list[int], want: int, k: int) -> list[tuple]:
    """The best of each of a few queries: runs are summed up for all of them together while most vectors are alive, then for each alone."""
    score = q[: cuts[1]].T @ x[: cuts[1]]
    alive = ids[None, :] != qids[:, None]
    score[~alive] = -np.inf
    floor = np.full(len(qids), -np.inf, x.dtype)
    many = np.flatnonzero(alive.sum(axis=1) > want)
    place, step, left = np.arange(len(ids)), 1, len(cuts) - 1
    while step < left:
        reach = q_rest[step - 1][:, None] * x_rest[step - 1][None, place]
        if step == 1 and len(many):  # the exact scores of the most promising vectors are a floor for the k-th best
            seeds = np.argpartition(score[many] + x.dtype.type(0.5) * reach[many], len(ids) - want, axis=1)[:, -want:]
            floor[many] = np.einsum("dqs,dq->qs", x[:, seeds], q[:, many]).min(axis=1)
        reach += score
        alive &= reach >= floor[:, None]
        if alive.mean() < SPARSE:
            break
        column = alive.any(axis=0)
        if column.mean() < 0.5:  # no query of the tile wants the others
            place, score, alive = place[column], score[:, column], alive[:, column]
        a, b = cuts[step], cuts[step + 1]
        score += q[a:b].T @ (x[a:b] if len(place) == len(ids) else x[a:b, place])
        step += 1
    if step == left:  # all scores are exact
        if len(many) and len(place) > want:
            floor[many] = np.partition(score[many], len(place) - want, axis=1)[:, len(place) - want]
        alive &= score >= floor[:, None]
    out = []
    for c, own in enumerate(qids):
        mine = np.flatnonzero(alive[c])
        own_score, mine = score[c, mine], place[mine]
        for at in range(step, left):
            a, b = cuts[at], cuts[at + 1]
            own_score = own_score + q[a:b, c] @ x[a:b, mine]
            if at + 1 < left:
                keep = own_score + q_rest[at, c] * x_rest[at, mine] >= floor[c]
                mine, own_score = mine[keep], own_score[keep]
        if len(mine) > want:
            keep = own_score >= np.partition(own_score, len(mine) - want)[len(mine) - want]
            mine, own_score = mine[keep], own_score[keep]
        if len(mine):
            out.append(_top(np.full(len(mine), own), ids[mine], own_score.astype(np.int64), k))
    return out


def _top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    other = ids != query
    query, ids, score = query[other], ids[other], score[other]
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((-score, ids))
        first = order[np.append(True, np.diff(ids[order]) != 0)]
        query, ids, score = query[first], ids[first], score[first]
    best = np.lexsort((ids, -score))[:k]
    return query[best], ids[best], score[best]


def top_k(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every``, its k best other vectors.

    Scores are inner products of floor(64 * component); ties go to the smaller vec_id. Only vectors of the query's
    length are compared. Rows that repeat a vec_id are all candidates, and a query for each; none finds its own id,
    and each pair of ids is reported once, with its best score. A null vec_id takes no part.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding")
    asked = vectors.filter(F.col("vec_id") % every == 0)
    n, m = vectors.count(), asked.count()
    # As many blocks as the sizes ask for, and enough pairs of blocks to keep all tasks busy.
    v_blocks, q_blocks = max(1, -(-n // VECTORS)), max(1, -(-m // QUERIES))
    v_blocks = max(v_blocks, min(partitions(spark) // q_blocks, -(-n // 2048)))
    packed = ["block", "kind", "ids", "data"]
    left = materialise(blocks(asked, QUERIES, q_blocks).select(F.struct(*packed).alias("q"), "dims"))
    right = materialise(blocks(vectors, VECTORS, v_blocks).select(F.struct(*packed).alias("v"), "dims"))
    # A pair of blocks is a row of megabytes.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    return merge(pairs(left, right, q_blocks, v_blocks), k)


def pairs(left: DataFrame, right: DataFrame, q_blocks: int, v_blocks: int) -> DataFrame:
    """Every query block with every vector block of its length: both are copied to the cells of a grid and joined there."""
    row, column = F.pmod(F.xxhash64("q.block"), F.lit(q_blocks)), F.pmod(F.xxhash64("v.block"), F.lit(v_blocks))
    left = left.select("q", "dims", row.alias("row"), F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("column"))
    right = right.select("v", "dims", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("row"), column.cast("int").alias("column"))
    left, right = left.withColumn("row", F.col("row").cast("int")), right
    return left.join(right.hint("merge"), ["row", "column", "dims"])


def merge(cells: DataFrame, k: int) -> DataFrame:
    """The best of all cells."""
    rows = cells.select("dims", *[F.col(f"{side}.{name}").alias(side + name) for side in "qv" for name in ("ids", "kind", "data")])

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for r in batch.to_pylist():
            q, v = ((np.frombuffer(r[s + "ids"], np.int64), np.frombuffer(r[s + "data"], r[s + "kind"]).reshape(r["dims"], -1).astype(np.int64)) for s in "qv")
            parts.append(search(q, v, k))
        columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
        return pa.record_batch(columns, names=["query_id", "vec_id", "score"])

    scored = map_rows(rows, found, "query_id long, vec_id long, score long")
    once = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
