"""The search index against a scan, and the stored days of a table against full copies."""

import random
from pathlib import Path

import pytest

from playbill.plans import history as hs, search_index as si
from playbill.plans.listing import Listing
from playbill.schema import FILMS, conform
from playbill.sources import manifest as mf

TITLES = ["", "a", "ab", "Blue Bolt", "bolt blue", "Città d'arte", "日本 映画", "Dune", "Dune 2", "x" * 300, "Dune", "aaa", "aaab", "😀 ok"]


def films(spark, titles):
    rows = [(n, t) for n, t in enumerate(titles)]
    table = spark.createDataFrame(rows, "id long, title string").selectExpr("*", "lower(title) AS title_normalized")
    return conform(table, FILMS)


def test_indexed_search_equals_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(si, "LOOKED_UP", 2)
    root = str(tmp_path / "index")
    # The second version renames a film and adds some; the first name must no longer be found.
    si.update_index(films(spark, ["old name", *TITLES[1:6], None]), root)
    table = films(spark, TITLES).cache()
    si.update_index(table, root)
    plain, indexed = Listing(table, table, table), Listing(table, table, table, index=root)
    for text in ["du", "dune", "DUNE 2", "ab", "aaa", "aa", "blue", "e bo", "old name", "日本", "xxxx", "no such", "'", "!!", "ok", "citta"]:
        assert [r.id for r in indexed.search(text).collect()] == [r.id for r in plain.search(text).collect()], text


def test_a_search_opens_the_folders_of_its_rarest_pieces(spark, tmp_path):
    root = str(tmp_path / "index")
    version = si.update_index(films(spark, TITLES), root)
    assert len(version.tables["pieces"].folders) > 8
    read = si._of(spark, root, version, "pieces", ["dun", "une"]).inputFiles()
    assert {Path(f).parent.name for f in read} == {f"_key={ord(c)}-000001" for c in "du"}
    assert si.candidates(spark, str(tmp_path / "none"), "dune").count() == 0


def changed(rng, rows):
    kept = [r for r in rows if rng.random() < 0.85]
    edited = [(k, rng.choice("xyz"), [None, v]) if rng.random() < 0.1 else (k, v, w) for k, v, w in kept]
    return edited + [(rng.randrange(40), rng.choice(["x", None]), rng.choice([[], None, ["q"]])) for _ in range(6)]


DDL = "k int, v string, w array<string>"


def held(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


@pytest.mark.parametrize("seed", range(2))
def test_any_past_day_equals_its_full_copy(spark, tmp_path, seed):
    rng, root, rows, copies = random.Random(seed), str(tmp_path / "h"), [(n % 50, None, ["a"]) for n in range(60)], {}
    days = [f"2026-{m:02d}-{d:02d}" for m in (8, 9, 10) for d in (3, 17, 28)]

    def check():
        for day, copy in copies.items():
            assert held(hs.as_of(spark, root, day)) == held(spark.createDataFrame(copy, DDL)), day

    for n, day in enumerate(days):
        if n == 4:  # a day that is recorded twice
            hs.record_day(spark.createDataFrame(changed(rng, rows), DDL), day, root)
        rows = changed(rng, rows) if n != 6 else []
        copies[day] = rows
        hs.record_day(spark.createDataFrame(rows, DDL), day, root)
        if n in (3, 7):
            hs.compact(spark, root, days[n - 1])
    check()
    hs.compact(spark, root, days[-1])
    check()
    copies = {"2026-08-04": copies[days[0]], "2026-07-01": [], "2027-01-01": copies[days[-1]]}
    check()
    with pytest.raises(ValueError):
        hs.record_day(spark.createDataFrame(rows, DDL), days[2], root)
    with pytest.raises(ValueError):
        hs.record_day(spark.createDataFrame([(1,)], "other int"), "2027-01-02", root)


def test_days_without_changes_add_no_rows(spark, tmp_path):
    root = str(tmp_path / "h")
    table = spark.range(1000).selectExpr("cast(id AS int) AS k", "'v' AS v", "array('a') AS w")
    for day in ("2026-01-01", "2026-01-02", "2026-01-03"):
        version = hs.record_day(table, day, root)
    assert list(version.tables["opened"].folders) == ["2026-01-01"] and not version.tables["closed"].folders
    version = hs.record_day(table.filter("k <> 7"), "2026-01-04", root)
    assert mf.read(spark, root, version.tables["closed"]).count() == 1
    assert hs.as_of(spark, root, "2026-01-03").count() == 1000 and hs.as_of(spark, root, "2026-01-04").count() == 999
