"""The forest against brute force: recall, exact scores, ties and awkward vectors."""

import numpy as np
import pytest

import brute
from playbill.llm import projection_trees as trees
from playbill.llm.catalog import QUERIES


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def found(df):
    out: dict[int, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_and_scores(spark, monkeypatch, clustered):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(trees, "CELL_BYTES", 1 << 17)  # several cells, and parts of a large leaf
    vectors = rng.normal(size=(6000, 24))
    if clustered:
        vectors += 3 * rng.normal(size=(40, 24))[rng.integers(0, 40, 6000)]
    vectors = (vectors * rng.uniform(0.5, 2, (6000, 1))).astype(np.float32)
    ids = rng.permutation(20000)[:6000]
    got = found(trees.nearest(frame(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, vectors, strict=True)])))
    want = brute.nearest(ids, vectors.astype(float))
    assert recall(got, want) >= 0.9
    at = {int(i): v.astype(float) for i, v in zip(ids, vectors, strict=True)}
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0])) and all(abs(s - at[q] @ at[v]) < 1e-9 for v, s in rows)


def test_many_copies_of_one_vector(spark):
    """A third of all rows are the same vector; every one of them that asks gets the least ids but its own."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 8)).astype(np.float32)
    vectors[500:1000] = vectors[500] * 3
    ids = rng.permutation(1500)
    got = found(trees.nearest(frame(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, vectors, strict=True)])))
    want = brute.nearest(ids, vectors.astype(float))
    assert recall(got, want) >= 0.9
    for i in ids[500:1000]:
        if i % 20 == 0:
            assert [v for v, _ in got[int(i)]] == [v for v, _ in want[int(i)]]


def test_awkward_vectors(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], None), (3, [-1.0, 0.5], 1), (40, [1.0, 2.0, 3.0], 1), (41, [1.0, 0.0, 0.0], 1)]
    rows += [(60, None, 1), (61, [], 1), (62, [0.0, 0.0], 1), (63, [float("nan"), 1.0], 1), (64, [float("inf"), 1.0], 1), (65, [None, 1.0], 1), (None, [9.0, 9.0], 1), (20, [0.0, 2.0], 2), (80, [0.0, -0.0], 1), (100, [5.0], 1)]
    frame(spark, rows, "double").selectExpr("*", "1 AS node", "2 AS rank", "0 AS h1", "'x' AS ids").repartition(2).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = found(QUERIES["op12_nearest_vectors"](spark, str(tmp_path)))
    assert got == {0: [(1, 1.0), (2, 1.0), (20, 0.0), (3, -1.0)], 20: [(1, 2.0), (2, 2.0), (3, 1.0), (0, 0.0)], 40: [(41, 1.0)]}


def test_an_empty_table_and_no_queries(spark):
    assert trees.nearest(frame(spark, [])).collect() == []
    assert trees.nearest(frame(spark, [(1, [1.0], 0), (2, [2.0], 0)])).collect() == []
    assert trees.nearest(frame(spark, [(0, None, 0)])).collect() == []
