"""Life cycle, published tables, logs and the nightly run over several days."""

import json

import pytest
from pyspark.sql import functions as F

from playbill.operators import lifecycle as lc, quality as qa
from playbill.plans import load as ld, nightly as ny
from playbill.schema import CINEMAS, FILMS, PAYLOADS, SHOWINGS
from playbill.sources import adapters as ad, tables as tb


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def films(spark, items):
    names = ["arrival_seq", "title", "title_normalized", "status", "poster", "description", "history"]
    ddl = "arrival_seq long, title string, title_normalized string, status string, poster string, description string, history array<struct<date:string,action:string>>"
    full = [{"arrival_seq": n, "title_normalized": i["title"], **i} for n, i in enumerate(items)]
    return spark.createDataFrame([tuple(f.get(c) for c in names) for f in full], ddl)


def showings(spark, items):
    full = [(n, k, "C", slug, date, list(times)) for k, (n, slug, date, *times) in enumerate(items)]
    return spark.createDataFrame(full, "arrival_seq long, showing_seq long, cinema string, cinema_slug string, date string, times array<string>")


def test_lifecycle_rules(spark):
    past = [("2026-06-01", "added")]
    prev = films(
        spark,
        [
            {"title": "Same", "history": past, "status": lc.ACTIVE}, {"title": "Changed", "history": past, "status": lc.ACTIVE, "poster": "old", "description": "whole text"},
            {"title": "Grace", "history": past, "status": lc.ACTIVE}, {"title": "Late", "history": past, "status": lc.ACTIVE}, {"title": "Undated", "history": past, "status": lc.ACTIVE},
            {"title": "Gone", "history": [*past, ("2026-06-05", "removed")], "status": lc.REMOVED}, {"title": "Forgotten", "history": [*past, ("2026-05-20", "removed")], "status": lc.REMOVED},
            {"title": "Told", "history": [*past, ("2026-06-09", "removed")], "status": lc.ACTIVE},
        ],
    )
    before = showings(spark, [(0, "c", "2026-06-10", "18:00"), (1, "c", "2026-06-10", "18:00"), (2, "c", "2026-06-09", "18:00"), (3, "c", "2026-05-30", "18:00"), (7, "c", "2026-06-08", "1")])
    new = films(spark, [{"title": "SAME"}, {"title": "Changed", "description": "cut..."}, {"title": "New"}])
    now = showings(spark, [(0, "c", "2026-06-10", "18:00"), (1, "c", "2026-06-10", "18:00", "20:30"), (2, "c", "2026-06-10", "21:00")])
    state, shows = lc.merge_lifecycle(new, now, prev, before, "2026-06-10")
    got = {r.title: (r.status, [h.action for h in r.history]) for r in state.collect()}
    assert got == {
        "SAME": (lc.ACTIVE, ["added"]), "Changed": (lc.ACTIVE, ["added", "updated"]), "New": (lc.ACTIVE, ["added"]), "Grace": (lc.ACTIVE, ["added", "removed"]),
        "Late": (lc.REMOVED, ["added", "removed"]), "Undated": (lc.REMOVED, ["added", "removed"]), "Gone": (lc.REMOVED, ["added", "removed"]), "Told": (lc.ACTIVE, ["added", "removed"]),
    }
    assert rows(state.filter("title = 'Changed'"), "poster", "description") == [("old", "whole text")]
    assert rows(lc.published(state, shows)[0], "title") == [("Changed",), ("New",), ("SAME",)]
    assert state.select("arrival_seq").distinct().count() == 8
    assert qa.verdict(qa.validate_films(*lc.published(state, shows))).first().failed is False


def payload(spark, *titles_and_days):
    body = {"result": [{"filmTitle": t, "synopsisShort": "s", "showingGroups": [{"date": d, "sessions": [{"startTime": f"{d}T20:00:00"}]} for d in days]} for t, *days in titles_and_days]}
    return spark.createDataFrame([(0, "s", "u", None, None, json.dumps(body))], PAYLOADS).withColumn("run_date", F.lit("2026-09-25").cast("date"))


def source(spark, slug, *titles_and_days):
    return ad.session_api(payload(spark, *titles_and_days), slug.upper(), slug, "https://h.it", "https://h.it/c")


def test_two_runs_end_to_end(spark, tmp_path):
    state, out = f"{tmp_path}/state", f"{tmp_path}/out"
    dimension = spark.createDataFrame(
        [("duna", True, "poster", None, "Villeneuve", None, None, "Q1", 2021), ("dune", True, None, None, None, None, None, "Q1", 2021)],
        "lookup_key string, found boolean, poster string, description string, director string, duration string, original_title string, wikidata_id string, year int",
    )
    cinemas = tb.export_cinemas(spark, {"a": {"name": "A", "lat": 1.0, "lon": 2.0}, "b": {"name": "B"}})
    for version, (day, a) in enumerate([("2026-09-25", [("DUNE", "2026-09-25"), ("Alien", "2026-09-26")]), ("2026-09-26", [("DUNE", "2026-09-26")])], 1):
        sources = {"a": source(spark, "a", *a), "b": source(spark, "b", ("Dune – 3D", "2026-09-26"), ("Duna", "2026-09-27"))}
        result = ny.run_nightly(sources, *ny.previous_state(spark, state), dimension, day)
        ny.publish_run(result, cinemas, ny.run_window(day), state, out, version, day)
    # Duna is a typo of Dune; Alien is in grace, hence in the state but not published.
    snapshot = tb.read_snapshot(spark, out)
    assert rows(snapshot.films, "title", "director", "wikidata_id", "first_seen", "last_seen") == [("Dune – 3D", None, "Q1", "2026-09-25", "2026-09-26")]
    assert rows(snapshot.showings, "cinema_slug", "date", "times") == [("a", "2026-09-26", ["20:00"]), ("b", "2026-09-26", ["20:00"]), ("b", "2026-09-27", ["20:00"])]
    assert (snapshot.date_from, snapshot.date_to) == ("2026-09-26", "2026-10-03")
    assert rows(ny.previous_state(spark, state)[0], "title", "status")[0] == ("Alien", lc.ACTIVE)
    assert spark.read.parquet(f"{state}/history").select("run_date").distinct().count() == 2
    now, before = ny.past_state(spark, state, "2026-09-26"), ny.past_state(spark, state, "2026-09-25")
    assert rows(now[0], "title", "history") == rows(ny.previous_state(spark, state)[0], "title", "history") != rows(before[0], "title", "history")
    assert rows(now[1], "cinema_slug", "date", "times") == rows(ny.previous_state(spark, state)[1], "cinema_slug", "date", "times")
    empty = ld.Store(*[spark.createDataFrame([], ddl) for ddl in (CINEMAS, FILMS, SHOWINGS)])
    loaded = ld.load_snapshot(empty, snapshot, F.lit("2026-09-26").cast("timestamp"))
    assert rows(loaded.store.films, "title_normalized", "year") == [("dune 3d", 2021)] and loaded.store.showings.count() == 3


def test_failed_source_uses_its_last_good_rows(spark, tmp_path):
    current = spark.createDataFrame([("a", 1)], "source_slug string, n int")
    attempts = spark.createDataFrame([("a", 1, False, 0, 1), ("b", 1, True, 1, 0), ("b", 2, True, 1, 0), ("c", 1, False, 1, 0), ("d", 1, False, 0, 0), ("e", 1, True, 1, 0), ("e", 2, False, 0, 0)], "source_slug string, attempt int, raised boolean, errors int, rows int")
    cache = spark.createDataFrame([(s, 9) for s in "abcde"], "source_slug string, n int")
    failed = tb.failed_sources(attempts)
    assert rows(failed, "source_slug") == [("b",), ("c",)] and rows(tb.failed_sources(attempts, compat=True), "source_slug") == [("b",)]
    assert rows(tb.last_known_good(current, cache, failed), "source_slug", "n") == [("a", 1), ("b", 9), ("c", 9)]
    path = f"{tmp_path}/cache"
    tb.refresh_cache(cache, failed.limit(0), path)
    tb.refresh_cache(current, failed, path)
    assert rows(spark.read.parquet(path), "source_slug", "n")[:2] == [("a", 1), ("b", 9)]


def test_versions_and_windows(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "x int")
    root = f"{tmp_path}/t"
    assert tb.latest_version(spark, root) is None and tb.read_previous(spark, root, "t", "x int, y string").count() == 0
    tb.publish({"t": one}, root, 1)
    one.write.parquet(f"{root}/t/version=2")  # written, never committed
    assert tb.latest_version(spark, root) == 1 and rows(tb.read_previous(spark, root, "t", "x int, y string"), "x", "y") == [(1, None)]
    with pytest.raises(ValueError):
        tb.publish({"t": one}, root, 1)
    assert tb.parse_window("2026-09-25", "2026-10-02") == ("2026-09-25", "2026-10-02")
    for bad in ((None, "2026-10-02"), ("x", "2026-10-02"), ("2026-10-02", "2026-09-25")):
        with pytest.raises(ValueError):
            tb.parse_window(*bad)


def test_envelopes_and_json_lines(spark, tmp_path):
    with pytest.raises(Exception):
        tb.read_envelopes(spark, str(tmp_path))
    envelopes = {
        "cinemas": {"cinemas": [{"slug": "a", "name": "A"}]}, "films": {"films": [{"id": "Dune", "title": "Dune", "year": 2021, "genres": ["g"]}]},
        "showings": {"date_from": "2026-09-25", "date_to": "2026-10-02", "showings": [{"film_id": "Dune", "cinema_slug": "a", "date": "2026-09-25", "times": ["20:00"]}]},
    }
    for name, body in envelopes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"generated_at": "now", **body}, indent=2))
    snapshot = tb.read_envelopes(spark, str(tmp_path))
    assert rows(snapshot.films, "seq", "title", "year", "genres") == [(0, "Dune", 2021, ["g"])] and rows(snapshot.showings, "times") == [(["20:00"],)]
    tb.write_json_lines(snapshot.films, f"{tmp_path}/lines", "films")
    assert rows(tb.read_json_lines(spark, f"{tmp_path}/lines", "films"), "title", "genres") == [("Dune", ["g"])]


def test_error_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    error = lambda day, url: spark.createDataFrame([("c", f"{day}T01:00:00", "E", "scrape", url, None)], "cinema string, timestamp string, exception string, phase string, url string, detail string")
    tb.replace_errors_for_day(error("2026-09-25", "x").limit(0), "2026-09-25", path)
    assert tb.read_errors(spark, path).count() == 0
    tb.replace_errors_for_day(error("2026-09-25", "x"), "2026-09-25", path)
    tb.replace_errors_for_day(error("2026-09-25", "y"), "2026-09-25", path)
    tb.replace_errors_for_day(error("2026-09-26", "z"), "2026-09-26", path)
    assert rows(tb.read_errors(spark, path), "url") == [("y",), ("z",)]
    tb.replace_errors_for_day(error("2026-09-26", "z").limit(0), "2026-09-26", path)
    assert rows(tb.read_errors(spark, path), "url") == [("y",)]
    assert [str(x) for x in tb.error_summary(spark, path).first()] == ["2026-09-26", "2026-09-25"]


def test_cinema_rules(spark):
    frame = spark.createDataFrame(
        [("a", "A", 1.0, 2.0, "w", "https://www.google.com/maps/place/x"), (None, "B", None, 2.0, None, None), ("c", "C", 1.0, 1.0, "w", "https://maps/search")],
        "slug string, name string, lat double, lon double, website string, maps_place_url string",
    )
    assert rows(qa.validate_cinemas(frame), "level", "rule", "entity") == [
        ("error", "bad place url", "c"), ("error", "no slug", "B"), ("warning", "no coordinates", "B"), ("warning", "no place url", "B"), ("warning", "no website", "B"),
    ]
    assert rows(qa.validate_cinemas(frame.limit(0)), "rule") == [("no locations",)]
