"""Keys that tolerate many edits, in blocks, against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from playbill.operators import near_keys as nk, similarity as sm


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def made(rng, number, syllables, longest):
    """Keys of a few syllables, and copies with up to a third of their letters edited."""
    found = {"".join(rng.choices(syllables, k=rng.randint(2, longest))) for _ in range(number)}
    for word in sorted(found):
        letters = list(word)
        for _ in range(rng.randint(1, len(word) // 3 + 1)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice("aeth"), rng.choice(syllables)])
        found.add("".join(letters) or "a")
    return sorted(found)


@pytest.mark.parametrize("syllables, longest", [(["th", "an", "er", "re", "on", "is"], 26), (["é日", "a", "😀", "ß"], 40), (["film", "0", "1"], 12)])
@pytest.mark.parametrize("way", ["bitmaps", "segments", "chosen"])
def test_blocks_equal_brute_force(monkeypatch, syllables, longest, way):
    if way != "chosen":
        monkeypatch.setattr(nk, "PAIR_NS", 0 if way == "bitmaps" else 10**9)
    monkeypatch.setattr(nk, "HELD", 7)
    keys = made(random.Random(longest), 60, syllables, longest)
    tolerated = {n: max(2, n // 4) for n in range(12, 200)}
    near = {frozenset(p) for p in itertools.combinations(keys, 2) if distance(*p) <= max(tolerated.get(len(k), -1) for k in p)}
    assert len(near) > 20
    for parts in ([(keys, None)], [(keys[::2], keys[1::2]), (keys[::2], None), (keys[1::2], None)]):
        told = [frozenset(p) for one, two in parts for a, b in nk.candidates(one, two, tolerated) for p in zip(a, b)]
        assert near <= set(told) and all(len(p) == 2 for p in told)


def test_titles_of_one_language(spark, monkeypatch):
    """Keys whose segments thousands share are cut into no slots, and every pair of them is found, however they are dealt."""
    monkeypatch.setattr(nk, "LEAST_KEYS", 9)
    keys = made(random.Random(3), 45, ["th", "an", "er", "re", "on", "is"], 30)
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    long = frame.filter(F.length("key") >= 12)
    assert sm.first_rows(long).count() == 0
    assert {tuple(r) for r in sm.near_pairs(frame).collect()} == {(a, b) for a, b in itertools.permutations(keys, 2) if distance(a, b) <= max(2, len(a) // 4)}
    few = lambda n: F.lit(3)
    assert {tuple(r) for r in sm.near_pairs(frame, budget=few).collect()} == {(a, b) for a, b in itertools.permutations(keys, 2) if distance(a, b) <= 3}


def test_strips():
    """Few lengths share a strip, many keys of one length are dealt into parts, old and new keys apart."""
    counts = [(True, n, 10) for n in range(12, 20)] + [(True, 30, 3 * nk.LEAST_KEYS), (True, 31, 5), (False, 12, 4), (True, nk.LETTERS + 1, 1)]
    assert nk._strips(counts) == [(False, 12, 12, 1), (True, 12, 19, 1), (True, 30, 30, 3), (True, 31, 31, 1), (True, nk.LETTERS + 1, nk.LETTERS + 1, 1)]


def test_widths_nobody_looks_up_are_not_cut(spark):
    keys = spark.createDataFrame([("a" * 33,), ("a" * 33 + "b",), ("c" * 40,)], "key string")
    assert {tuple(r) for r in sm.containment_pairs(keys).collect()} == {("a" * 33, "a" * 33 + "b")}
    assert sm.window_rows(keys, widths=[32]).count() == 1 + 2 + 1
