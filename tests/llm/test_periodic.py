"""Runs of repeated words against brute force."""

import random

import brute
import numpy as np
import pytest

from playbill.llm import periodic
from playbill.llm.catalog import QUERIES
from samples import SCHEMA, awkward, prose

NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("least", [1, 4, 7, 12])
def test_runs_of_random_words(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 8)):
            words = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(0, 80))]
            if words and rng.random() < 0.6:
                a = rng.randrange(len(words))
                p = rng.randint(1, max(1, (len(words) - a) // 2))
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts.append(words)
        text, *found = periodic.runs_of([np.array(t, np.int64) for t in texts], least)
        for k, words in enumerate(texts):
            assert list(zip(*(x[text == k].tolist() for x in found), strict=True)) == brute.spans(words, least)


def test_one_word_again_and_again():
    """A list that grows at one end stays quick."""
    text, start, length, period = periodic.runs_of([np.zeros(200_000, np.int64), np.arange(5)])
    assert (text.tolist(), start.tolist(), length.tolist(), period.tolist()) == ([0], [0], [200_000], [1])


def documents():
    rng = random.Random(9)
    rows = awkward()
    rows += [(1000 + k, prose(rng, rng.randint(0, 300))) for k in range(150)]
    rows += [(2000, "so " * 40 + "it goes"), (2001, prose(rng, 12) * 5), (2002, "a b " * 6), (2003, "a b " * 5)]
    rows += [(2004, " ".join(["x y z"] * 9) + "\t" + " ".join(["z y x"] * 9)), (2005, "la " * 3000), (2006, " \n\t ")]
    return rows


def test_query(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame([(d, t, None, "s", 0) for d, t in rows], SCHEMA).selectExpr("*", "'x' AS runs", "'y' AS words", "1 AS n", "2 AS p")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    want = brute.periodic(rows)
    assert got == want
    assert sum(v[0] > 0 for v in want.values()) > 20


def test_blocks_of_documents(spark, table, monkeypatch):
    """A text longer than a block is whole, and blocks change nothing."""
    rows = documents()[:60] + [(5000, "a b c " * 200)]
    found = lambda: sorted(map(str, periodic.runs(table(rows)).collect()))
    want = found()
    monkeypatch.setattr(periodic, "BLOCK", 50)
    assert found() == want


def test_repeated_rows_null_ids_and_an_empty_table(spark, table):
    loop = "one two three " * 8
    got = periodic.runs(table([(None, loop), (None, loop), (4, None), (4, loop)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], len(r["runs"]), r["text"]) for r in got) == [(0, 24, 1, "one two three")] * 2 + [(4, 0, 0, ""), (4, 24, 1, "one two three")]
    assert periodic.runs(periodic.with_loops(spark.createDataFrame([], SCHEMA))).collect() == []
