"""Versioned stores: what a load reads and writes, and writers that meet or fail."""

from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_store import counters, now, show, snapshot, table

from playbill.plans import load as ld
from playbill.sources import manifest as mf, tables as tb

FIRST = date(2026, 6, 20)
DAYS = [(FIRST + timedelta(n)).isoformat() for n in range(110)]  # 2026-06-20 to 2026-10-07; the window is 2026-09-25 to 2026-10-02
FILMS = [{"title": "Dune"}, {"title": "Alien"}]


def history(spark, root):
    """A store of 110 days, two films a day."""
    shows = [show(f["title"], d, "20:00") for d in DAYS for f in FILMS]
    return ld.load_version(spark, root, snapshot(spark, FILMS, shows), now())[0]


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_a_load_touches_the_days_of_its_window_only(spark, tmp_path):
    root = str(tmp_path / "store")
    first = history(spark, root)
    assert list(first.tables["showings"].folders) == DAYS and first.marks == {"last_showing": 220, "grain": ld.DAY}
    before = files(root)
    # Alien is no longer shown in the window; a new day after it and a correction before it are listed.
    again = [show("Dune", d, "18:00") for d in DAYS if "2026-09-25" <= d <= "2026-10-02"] + [show("Dune", "2026-10-20", "21:00"), show("Alien", "2026-07-01", "22:00")]
    given = snapshot(spark, FILMS, again)
    keys = ld.touched_keys(given)
    assert keys == ["2026-07-01", *[d for d in DAYS if "2026-09-25" <= d <= "2026-10-02"], "2026-10-20"]
    slice_ = ld.read_store(spark, root, first, keys).showings
    assert len(slice_.inputFiles()) >= 9 and all(any(f"_key={k}/" in f for k in keys) for f in slice_.inputFiles())
    second, result = ld.load_version(spark, root, given, now())

    assert (counters(result)["showings"], counters(result)["archived_showings"]) == (10, 8)
    old, new = (v.tables["showings"].folders for v in (first, second))
    assert {k for k in new if new[k] != old.get(k)} == set(keys)
    after = files(root)
    assert before.items() <= after.items()  # nothing that was there has changed
    assert {f.split("_key=")[1][:10] for f in after.keys() - before.keys() if f.startswith("showings/")} == set(keys)
    # The same as a load of everything.
    whole = ld.load_snapshot(ld.read_store(spark, root, first), given, now()).store.showings
    loaded = ld.read_store(spark, root, second).showings
    assert table(loaded, *loaded.columns) == table(whole, *whole.columns)
    assert second.marks["last_showing"] == 221 and loaded.agg(F.max("id")).first()[0] == 221
    # The version before can still be read, and so can one day of it.
    assert table(ld.read_store(spark, root, mf.load(spark, root, 1), ["2026-09-25"]).showings, "film_id", "times", "removed_at") == [(1, ["20:00"], None), (2, ["20:00"], None)]
    assert table(tb.read_table(spark, root, "showings", 2, ["2026-09-25"]), "film_id", "times") == [(1, ["18:00"]), (2, ["20:00"])]


def test_a_store_by_months_and_an_empty_snapshot(spark, tmp_path):
    root = str(tmp_path / "store")
    first, _ = ld.load_version(spark, root, snapshot(spark, FILMS, [show("Dune", d, "20:00") for d in DAYS]), now(), ld.MONTH)
    assert list(first.tables["showings"].folders) == ["2026-06", "2026-07", "2026-08", "2026-09", "2026-10"]
    second, result = ld.load_version(spark, root, snapshot(spark, FILMS[:1], []), now())  # keeps the grain; the guard skips the source
    assert second.marks["grain"] == ld.MONTH and result.skipped_cinemas.count() == 1
    changed = {k for k, f in second.tables["showings"].folders.items() if first.tables["showings"].folders[k] != f}
    assert changed == {"2026-09", "2026-10"}
    assert ld.read_store(spark, root, second).showings.filter("removed_at is null").count() == len(DAYS)


def test_two_writers_of_one_version(spark, tmp_path):
    """Both start from version 1: the one that commits second is told so, and its rows are never seen."""
    root = str(tmp_path / "store")
    base = history(spark, root)
    part = [mf.write(spark.createDataFrame([(n,)], "n int"), root, "note", None) for n in (1, 2)]
    one, two = (base.next().with_parts("note", p, [""]) for p in part)
    mf.commit(spark, root, one)
    with pytest.raises(mf.VersionTaken):
        mf.commit(spark, root, two)
    assert [r.n for r in tb.read_table(spark, root, "note").collect()] == [1] and mf.latest(spark, root).version == 2
    # A change that does not depend on the other goes in after it.
    mf.amend(spark, root, lambda m: m.next().with_parts("other", part[1], [""]))
    last = mf.latest(spark, root)
    assert last.version == 3 and set(last.tables) == {"cinemas", "films", "showings", "note", "other"}


def test_a_crash_between_the_writes(spark, tmp_path):
    """Tables that no manifest names, and a manifest that was not written to its end, change nothing."""
    root = str(tmp_path / "store")
    base = history(spark, root)
    mf.write(spark.createDataFrame([(9,)], "n int"), root, "note", None)
    Path(root, "_manifests", f"{2:012d}.json").write_text('{"version": 2, "tab')
    assert mf.latest(spark, root) == base and mf.numbers(spark, root) == [1, 2]
    made = mf.amend(spark, root, lambda m: m.next(seen="yes"))
    assert made.version == 3 and mf.latest(spark, root).marks["seen"] == "yes"


def test_the_log_of_two_days_at_once(spark, tmp_path, monkeypatch):
    """Another day's log is committed while this one is written: both days are kept, errors and status together."""
    path, real = str(tmp_path / "log"), mf.commit
    error = lambda url: spark.createDataFrame([("c", "t", "E", "scrape", url, None)], "cinema string, timestamp string, exception string, phase string, url string, detail string")
    tb.replace_errors_for_day(error("x"), "2026-09-24", path)

    def slow(session, root, manifest):
        monkeypatch.setattr(mf, "commit", real)
        tb.replace_errors_for_day(error("y"), "2026-09-25", path)
        return real(session, root, manifest)

    monkeypatch.setattr(mf, "commit", slow)
    tb.replace_errors_for_day(error("z").limit(0), "2026-09-24", path)
    assert [(r.url, str(r.day)) for r in tb.read_errors(spark, path).collect()] == [("y", "2026-09-25")]
    assert [str(x) for x in tb.error_summary(spark, path).first()] == ["2026-09-24", "2026-09-25"]

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(mf, "commit", broken)
    with pytest.raises(OSError):
        tb.replace_errors_for_day(error("w"), "2026-09-25", path)
    monkeypatch.setattr(mf, "commit", real)
    assert [r.url for r in tb.read_errors(spark, path).collect()] == ["y"]


def test_vacuum_keeps_what_the_last_versions_name(spark, tmp_path):
    root = str(tmp_path / "store")
    for n in range(4):
        table_ = spark.createDataFrame([(d, n) for d in "ab"], "day string, n int")
        mf.amend(spark, root, lambda m, n=n, t=table_: m.next().with_parts("t", mf.write(t.filter(F.col("day") == "ab"[n % 2]), root, "t", F.col("day")), ["ab"[n % 2]]))
    tb.replace_errors_for_day(spark.createDataFrame([("c", "t", "E", "p", "u", None)], "cinema string, timestamp string, exception string, phase string, url string, detail string"), "2026-09-24", f"{root}/log")
    assert mf.vacuum(spark, root, 2) == 1 and mf.numbers(spark, root) == [3, 4]
    assert sorted(map(tuple, tb.read_table(spark, root, "t", 3).collect())) == [("a", 2), ("b", 1)]
    assert sorted(map(tuple, tb.read_table(spark, root, "t").collect())) == [("a", 2), ("b", 3)]
    assert tb.read_errors(spark, f"{root}/log").count() == 1
