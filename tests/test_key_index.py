"""Short keys and the kept index against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from playbill.operators import similarity as sm
from playbill.plans import key_index as ki
from playbill.sources import manifest as mf


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def made(rng, number, letters="abcde", longest=16):
    found = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(number)}
    for word in list(found)[: number // 3]:  # near and longer ones
        at = rng.randrange(len(word) + 1)
        found |= {word[:at] + rng.choice(letters) + word[at:], word[:at] + word[at + 1 :] or "a", word + rng.choice(letters) * 3}
    return sorted(found)


def frame(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def near(keys, of=None):
    return {(a, b) for a, b in itertools.permutations(keys, 2) if (of is None or a in of or b in of) and distance(a, b) <= max(2, len(a) // 4)}


def inside(keys, of=None):
    return {(a, b) for a, b in itertools.permutations(keys, 2) if (of is None or a in of or b in of) and a in b}


@pytest.mark.parametrize("letters", ["ab", "abcdefghij", "é日a😀"])
def test_pairs_of_short_keys(spark, letters):
    keys = made(random.Random(len(letters)), 60, letters)
    assert {tuple(r) for r in sm.near_pairs(frame(spark, keys)).collect()} == near(keys)
    one = {(a, b) for a, b in itertools.permutations(keys, 2) if distance(a, b) <= 1}
    assert {tuple(r) for r in sm.near_pairs(frame(spark, keys), budget=lambda n: F.lit(1)).collect()} == one


def test_candidates_of_keys_of_one_length(spark):
    """Ten times the keys of one length have no more than some twenty times the candidates, not a hundred times."""
    rng, met = random.Random(8), []
    for number in (600, 6000):
        keys = frame(spark, {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(number)})
        first, second = sm.first_rows(keys), sm.second_rows(keys, keys.select(F.length("key").alias("n")).distinct())
        met.append(first.join(second, "slot").filter("a <> b").select("a", "b").distinct().count())
    assert met[1] < 6000 and met[1] <= 100 + 20 * max(met[0], 1)


def test_nights(spark, tmp_path):
    """Three nights give what one comparison of all keys gives; a key that comes again adds nothing."""
    root, rng = str(tmp_path / "index"), random.Random(5)
    keys = made(rng, 90)
    rng.shuffle(keys)
    nights = [keys[:80], keys[70:110] + [""], keys[100:]]
    seen, found = set(), set()
    for number, night in enumerate(nights, 1):
        new = set(night) - seen - {""}
        seen |= new
        got = {tuple(r) for r in ki.add_keys(frame(spark, night + night[:3]), root).collect()}
        assert got == {("near", *p) for p in near(seen, new)} | {("inside", *p) for p in inside(seen, new)}
        found |= got
        # Only the new keys were cut: the parts of earlier nights are named again as they were.
        version = mf.latest(spark, root)
        assert version.version == number and all(list(p.folders) == [f"{k:06d}" for k in range(1, number + 1)] for p in version.tables.values())
        for name in ("first", "second", "needles", "windows"):
            own = mf.read(spark, root, version.tables[name], [f"{number:06d}"])
            assert {r[0] for r in own.select(own.columns[0]).distinct().collect()} <= new
    assert found == {("near", *p) for p in near(keys)} | {("inside", *p) for p in inside(keys)}
    assert ki.add_keys(frame(spark, keys), root).count() == 0


def test_an_empty_night(spark, tmp_path):
    root = str(tmp_path / "index")
    assert ki.add_keys(frame(spark, []), root).count() == 0
    assert {tuple(r) for r in ki.add_keys(frame(spark, ["dune", "dunes", None]), root).collect()} == {("near", "dune", "dunes"), ("near", "dunes", "dune"), ("inside", "dune", "dunes")}
