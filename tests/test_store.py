"""Snapshot loads, identity, reconciliation and duplicate maintenance on the store tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from playbill import session
from playbill.operators import grouping as gr, joins as jn, ranking as rk, upsert as up
from playbill.operators.upsert import resolve_identities
from playbill.plans import dedup as dd, load as ld
from playbill.schema import CINEMAS, FILMS, SHOWINGS, conform

FROM, TO = "2026-09-25", "2026-10-02"
def now():
    return F.lit("2026-09-25 03:00:00").cast("timestamp")

FILM_DDL = "seq long, id string, title string, original_title string, year int, duration string, runtime_minutes string, genres array<string>, director string, poster string, poster_url string, synopsis string, description string, wikidata_id string"
SHOW_DDL = "seq long, film_id string, cinema_slug string, date string, times array<string>, screen string, source_url string, buy_url string, language string"


def rows(spark, items, ddl):
    names = [p.split()[0] for p in ddl.split(", ")]
    full = [{"seq": i, **item} for i, item in enumerate(items)]
    return spark.createDataFrame([tuple(f.get(n) for n in names) for f in full], ddl)


def snapshot(spark, films, showings, cinemas=("c1",)):
    places = rows(spark, [{"slug": s, "name": s.upper(), "lat": 1.0, "lon": 2.0} for s in cinemas], "seq long, " + CINEMAS)
    return ld.Snapshot(places, rows(spark, films, FILM_DDL), rows(spark, showings, SHOW_DDL), FROM, TO)


def empty(spark):
    return ld.Store(*[spark.createDataFrame([], ddl) for ddl in (CINEMAS, FILMS, SHOWINGS)])


def show(film, date, *times, slug="c1", **more):
    return {"film_id": film, "cinema_slug": slug, "date": date, "times": list(times), **more}


def counters(result):
    return {k: v for k, v in result.report.first().asDict().items() if v}


def load(spark, store, films, showings, **more):
    return ld.load_snapshot(store, snapshot(spark, films, showings, more.pop("cinemas", ("c1",))), now(), **more)


def table(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def test_load_archive_reactivate_idempotent(spark):
    both = [{"title": "Dune", "duration": "155 min", "genres": ["a", "b"], "poster": "p"}, {"title": "Alien", "description": "d"}]
    week = [
        show("Dune", "2026-09-25", "20:00", screen="1"), show("Dune", "2026-09-25", "18:00", screen="2", source_url="u"),
        show("Alien", "2026-09-26", "21:00", screen="1"), show("Alien", "2026-09-20", "21:00"), show("Ghost", "2026-09-26", "10:00"),
    ]
    first = load(spark, empty(spark), both, week)
    assert counters(first) == {"cinemas": 1, "films": 2, "showings": 3, "orphans": 1}
    assert table(first.store.films, "id", "title_normalized", "runtime_minutes", "genres") == [(1, "dune", 155, "a,b"), (2, "alien", None, None)]
    assert table(first.store.showings, "id", "film_id", "times", "screen", "buy_url")[0] == (1, 1, ["18:00", "20:00"], None, "u")
    assert table(first.store.cinemas, "region") == [("Umbria",)]

    again = load(spark, first.store, both, week)
    assert {k: v for k, v in counters(again).items() if "archived" in k or "reactivated" in k or "conflict" in k} == {}
    assert table(again.store.films, *first.store.films.columns) == table(first.store.films, *first.store.films.columns)
    assert table(again.store.showings, *first.store.showings.columns) == table(first.store.showings, *first.store.showings.columns)

    # Alien leaves: archived with its showing inside the window; the one outside is history.
    fewer = load(spark, first.store, both[:1], week[:2], min_ratio=0.5)
    assert (counters(fewer)["archived_films"], counters(fewer)["archived_showings"]) == (1, 1)
    assert table(fewer.store.showings.filter("removed_at is not null"), "film_id", "date")[0][0] == 2
    assert fewer.store.showings.filter("removed_at is null and date < '2026-09-25'").count() == 1
    back = load(spark, fewer.store, [both[0], {**both[1], "director": "Scott"}], week)
    assert (counters(back)["reactivated_films"], counters(back)["reactivated_showings"]) == (1, 1)
    assert table(back.store.films.filter("id = 2"), "director", "removed_at", "synopsis") == [("Scott", None, "d")]


def test_guard_skips_a_broken_source(spark):
    days = [f"2026-09-{d}" for d in (25, 26, 27, 28)]
    first = load(spark, empty(spark), [{"title": "Dune"}], [show("Dune", d, "20:00") for d in days])
    broken = load(spark, first.store, [{"title": "Dune"}], [show("Dune", days[0], "20:00")], min_ratio=0.5)
    assert [r.cinema_slug for r in broken.skipped_cinemas.collect()] == ["c1"]
    assert broken.store.showings.filter("removed_at is not null").count() == 0
    loose = load(spark, first.store, [{"title": "Dune"}], [show("Dune", days[0], "20:00")], min_ratio=0.2)
    assert counters(loose)["archived_showings"] == 3


def test_identity_reuse_and_conflict(spark):
    first = load(spark, empty(spark), [{"title": "Cars – 20esimo anniversario", "year": 2006, "wikidata_id": "Q328"}], [])
    reuse = load(spark, first.store, [{"title": "CARS 20 ANNIVERSARIO", "wikidata_id": "Q328", "director": "Lasseter"}], [])
    assert table(reuse.store.films, "id", "title_normalized", "year", "director", "removed_at") == [(1, "cars 20esimo anniversario", 2006, "Lasseter", None)]

    two = load(spark, empty(spark), [{"title": "A", "wikidata_id": "Q1"}, {"title": "B"}], [])
    clash = load(spark, two.store, [{"title": "A"}, {"title": "B", "wikidata_id": "Q1", "director": "x"}], [])
    assert table(clash.store.films, "id", "wikidata_id", "director") == [(1, "Q1", None), (2, None, "x")]
    assert table(clash.identity_conflicts, "pair") == [("2:1",)]
    assert clash.shared_external_ids.count() == 0


def test_bad_records_are_rejected_not_fatal(spark):
    result = load(spark, empty(spark), [{"title": ""}, {"title": "Ok"}], [show("Ok", "2026-13-01", "20:00"), show("Ok", "2026-09-25", "20:00")])
    assert table(result.rejected, "reason") == [("film without title",), ("showing without date or location",)]
    assert result.store.showings.count() == 1


def sequential(state, batch):
    """The identity rule one record at a time: what every route of the upsert must equal."""
    rows_, out = [dict(zip(("id", "key", "year", "ext"), s)) for s in state], []
    for seq, key, year, ext in batch:
        same = [r for r in rows_ if r["key"] == key]
        mine = next((r for r in same if r["year"] == year), None)
        if mine is None:
            open_rows = [r for r in same if r["year"] is None or year is None]
            mine = open_rows[0] if len(open_rows) == 1 else None
        owner = next((r for r in rows_ if ext is not None and r["ext"] == ext), None)
        if mine is None and owner is not None:
            mine = owner
        elif mine is None:
            mine = {"id": ("new", seq), "key": key, "year": year, "ext": ext}
            rows_.append(mine)
        elif owner is None or owner is mine:
            mine["ext"] = ext if ext is not None else mine["ext"]
            mine["year"] = mine["year"] if mine["year"] is not None else year
        out.append((seq, mine["id"], mine["key"], mine["year"]))
    return out, rows_


@pytest.mark.parametrize("seed", range(3))
def test_upsert_routes_equal_the_sequential_rule(spark, seed):
    import random

    rnd = random.Random(seed)
    keys = [f"k{n}" for n in range(14)]
    year = lambda: rnd.choice([None, 1990, 2000])
    state, used = [], set()
    for n in range(12):
        s = (n + 1, rnd.choice(keys), year(), rnd.choice([None, f"Q{n}"]))
        if (s[1], s[2]) not in used:
            used.add((s[1], s[2]))
            state.append(s)
    batch = [(n, rnd.choice(keys), year(), rnd.choice([None, None, f"Q{rnd.randint(0, 15)}"])) for n in range(60)]
    want, final = sequential(state, batch)
    ddl = "title_normalized string, year int, wikidata_id string"
    records, changed = resolve_identities(spark.createDataFrame(state, "id long, " + ddl), spark.createDataFrame(batch, "seq long, " + ddl))
    got = sorted(
        (r.seq, r.target_id if r.target_id is not None else ("new", r.target_seq), r.title_normalized, r.year) for r in records.collect()
    )
    assert got == want
    before = {s[0]: s for s in state}
    touched = {(r["id"], r["key"], r["year"], r["ext"]) for r in final if before.get(r["id"]) != (r["id"], r["key"], r["year"], r["ext"])}
    moved = {(r.target_id if r.target_id is not None else ("new", r.target_seq), r.title_normalized, r.year, r.wikidata_id) for r in changed.collect()}
    assert touched <= moved and {m[0] for m in moved} >= {t[0] for t in touched}


@pytest.mark.parametrize("seed", range(2))
def test_settled_records_follow_the_sequential_rule(spark, seed, monkeypatch):
    """Two hundred small worlds at once, in blocks of a few arrival numbers: keys and ids of a world touch no other."""
    import random

    monkeypatch.setattr(up, "BLOCK", 5)
    rnd, state, batch, want, final = random.Random(seed), [], [], [], []
    for world in range(200):
        keys, ids = [f"w{world}k{n}" for n in range(rnd.choice((1, 1, 2, 3)))], [f"w{world}Q{n}" for n in range(rnd.choice((1, 1, 2, 4)))]
        year = lambda: rnd.choice([None, 1990, 2000, 2010])
        ext = lambda: rnd.choice([None, None, *ids])
        own = [(world * 10 + n, rnd.choice(keys), year(), ext()) for n in range(rnd.randrange(4))]
        # Stored rows never share an external id.
        own = [r for n, r in enumerate(own) if r[3] is None or r[3] not in {o[3] for o in own[:n]}]
        mine = [(world * 100 + n, rnd.choice(keys), year(), ext()) for n in range(rnd.randrange(1, 25))]
        got, rows_ = sequential(own, mine)
        state, batch, want, final = state + own, batch + mine, want + got, final + rows_
    ddl = "title_normalized string, year int, wikidata_id string"
    records, changed = resolve_identities(spark.createDataFrame(state, "id long, " + ddl), spark.createDataFrame(batch, "seq long, " + ddl))
    got = sorted((r.seq, r.target_id if r.target_id is not None else ("new", r.target_seq), r.title_normalized, r.year) for r in records.collect())
    assert got == sorted(want)
    before = {s[0]: s for s in state}
    touched = {(r["id"], r["key"], r["year"], r["ext"]) for r in final if before.get(r["id"]) != (r["id"], r["key"], r["year"], r["ext"])}
    moved = {(r.target_id if r.target_id is not None else ("new", r.target_seq), r.title_normalized, r.year, r.wikidata_id) for r in changed.collect()}
    assert touched <= moved and {m[0] for m in moved} >= {t[0] for t in touched}


def test_a_large_mixed_group_leaves_little_to_fold(spark):
    """One film with a million records, with and without year and id: no more than its forms are read in sequence."""
    n = 1_000_000
    seq, none = F.col("id").alias("seq"), F.lit(None)
    year = F.when(F.col("id") % 3 > 0, 1950 + F.floor(F.col("id") / 40_000) + F.col("id") % 5).cast("int").alias("year")
    ext = F.when(F.col("id") % 2 == 0, F.lit("Q1")).otherwise(none).alias("wikidata_id")
    batch = spark.range(n).select(seq, F.lit("film").alias("title_normalized"), year, ext, none.cast("long").alias("exact_id"), none.cast("long").alias("owner_id"))
    stored = spark.createDataFrame([], "id long, title_normalized string, year int, wikidata_id string")
    judged = up.settle(batch, stored)
    counts = judged.agg(F.count("*"), F.sum(F.col("settled").cast("int"))).first()
    assert counts[0] == n and n - counts[1] < 400


def store_films(spark, items):
    return conform(rows(spark, [{"title_normalized": i["title"].lower(), **i} for i in items], "id long, title string, title_normalized string, year int, director string, wikidata_id string, poster_url string"), FILMS)


def store_showings(spark, items):
    full = [(n, f, slug, d, [t], datetime(2026, 9, run)) for n, (f, slug, d, t, run) in enumerate(items, 1)]
    frame = spark.createDataFrame(full, "id long, film_id long, cinema_slug string, date string, times array<string>, scraped_at timestamp")
    return conform(frame, SHOWINGS)


def test_dedup_plan_and_apply(spark):
    films = store_films(
        spark,
        [
            {"id": 1, "title": "Odissea", "title_normalized": "odissea!"},
            {"id": 2, "title": "ODISSEA", "year": 2026, "wikidata_id": "Q1", "director": "Nolan"},
            {"id": 3, "title": "Dune", "wikidata_id": "Q2"},
            {"id": 4, "title": "Dune", "wikidata_id": "Q3"},
            {"id": 5, "title": "Cars", "year": 2006, "wikidata_id": "Q9"},
            {"id": 6, "title": "Motori ruggenti", "wikidata_id": "Q9", "poster_url": "p"},
            {"id": 7, "title": "Il Padrino"},
            {"id": 8, "title": "Il Padrino 2"},
        ],
    )
    showings = store_showings(
        spark,
        [(1, "c", "2026-09-25", "18:00", 20), (1, "c", "2026-09-26", "18:00", 20), (1, "c", "2026-09-27", "18:00", 20),
         (2, "c", "2026-09-25", "21:00", 22), (2, "d", "2026-09-25", "21:00", 22), (6, "c", "2026-09-25", "10:00", 20)],
    )
    plan = dd.build_plan(films, showings)
    groups = {(r.rule, r.survivor_id, r.id) for r in plan.merged.collect()}
    assert groups == {(dd.KEY_NULL_YEAR, 1, 1), (dd.KEY_NULL_YEAR, 1, 2), (dd.EXTERNAL_ID, 6, 5), (dd.EXTERNAL_ID, 6, 6)}
    assert {r.id for r in plan.undecided.collect()} == {3, 4}
    assert table(plan.candidates, "first_id", "second_id", "reason") == [(7, 8, "distance 2")]
    assert table(plan.keys, "id", "new_key", "frozen") == [(1, "odissea", False)]
    summary = dd.report(plan)["summary"].first().asDict()
    assert summary == {"groups": 2, "rows_to_merge": 4, "rows_removed": 2, "moved": 2, "discarded": 1}

    new_films, new_showings = dd.apply_plan(plan)
    assert table(new_films.filter("id = 1"), "title_normalized", "year", "director", "wikidata_id") == [("odissea", 2026, "Nolan", "Q1")]
    assert table(new_films.filter("id = 6"), "year", "poster_url") == [(2006, "p")]
    assert sorted(r.id for r in new_films.collect()) == [1, 3, 4, 6, 7, 8]
    assert table(new_showings.filter("film_id = 1"), "cinema_slug", "date", "times")[0][2] == ["21:00"]
    assert new_showings.count() == 5
    second = dd.build_plan(new_films, new_showings)
    assert second.merged.count() == 0 and second.keys.count() == 0


def test_approved_pairs(spark):
    good, bad = dd.validate_pairs(spark.createDataFrame([("1:2",), ("2: 3",), ("4:4",), ("x:1",), ("1",), ("1:2:3",)], "pair string"))
    assert table(good, "a", "b") == [(1, 2), (2, 3)] and bad.count() == 4
    films = store_films(spark, [{"id": n, "title": t} for n, t in enumerate("ABCD", 1)])
    plan = dd.build_plan(films, spark.createDataFrame([], SHOWINGS), good)
    assert {(r.rule, r.survivor_id, r.id) for r in plan.merged.collect()} == {(dd.BY_HAND, 1, n) for n in (1, 2, 3)}
    with pytest.raises(ValueError):
        dd.build_plan(films, spark.createDataFrame([], SHOWINGS), spark.createDataFrame([(1, 99)], "a long, b long"))


def test_unknown_year_with_several_known_years_is_undecided(spark):
    films = store_films(spark, [{"id": n, "title": "Omonimo", "year": y} for n, y in enumerate([1990, 2000, None, None, 1990], 1)])
    plan = dd.build_plan(films, spark.createDataFrame([], SHOWINGS))
    assert {r.id for r in plan.merged.collect()} == {1, 5}
    assert {r.id for r in plan.undecided.collect()} == {3, 4}


def test_ids_are_numbered_where_they_are_sorted(spark):
    """Over several partitions, with the sequence kept or not; rows are not shuffled again to be numbered."""
    given = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000 * 3).alias("seq"), F.col("id").alias("v"))
    for keep in (True, False):
        numbered = rk.assign_ids(given, "seq", 100, keep_seq=keep)
        assert numbered.columns == (["seq", "v", "id"] if keep else ["v", "id"])
        assert sorted((r.v, r.id) for r in numbered.collect()) == [(v, 101 + v * 7919 % 5000) for v in range(5000)]
        assert numbered._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1  # over one row per partition
    assert rk.assign_ids(given.limit(0), "seq").count() == 0


def test_a_load_writes_its_showings_twice(spark, monkeypatch):
    """Once as upserted, once in the order of their ids, and a third time only those that it archives."""
    written = []

    def counting(df, *metrics):
        done = session.materialise(df, *metrics)
        if {"cinema_slug", "date"} <= set(df.columns):
            written.append((done[0] if metrics else done).count())
        return done

    for module in (ld, rk):
        monkeypatch.setattr(module, "materialise", counting)
    week = [show("Dune", f"2026-09-{25 + n}", "20:00") for n in range(5)]
    first = load(spark, empty(spark), [{"title": "Dune"}], week)
    assert first.store.showings.count() == 5 and written == [5, 5, 0]
    written.clear()
    second = load(spark, first.store, [{"title": "Dune"}], [*week[:4], show("Dune", "2026-10-01", "20:00")])
    assert counters(second) == {"cinemas": 1, "films": 1, "showings": 5, "archived_showings": 1} and written == [6, 1, 1]
    assert table(second.store.showings, "id", "date", "removed_at")[-2:] == [(5, date(2026, 9, 29), datetime(2026, 9, 25, 3)), (6, date(2026, 10, 1), None)]


def test_slots_are_grouped_and_joined_in_one_exchange(spark):
    """Sorted once: neither a hash table of groups nor a second shuffle of the snapshot."""
    state = spark.createDataFrame([], SHOWINGS)
    raw = rows(spark, [show(1, "2026-09-25", "20:00"), show(1, "2026-09-25", "18:00")], SHOW_DDL).withColumns({"film_id": F.col("film_id").cast("bigint"), "date": F.col("date").cast("date")})
    with session.groups_of_sorted_rows(spark):
        merged = gr.merge_showings_per_key(raw.repartition(*jn.SLOT).sortWithinPartitions(*jn.SLOT), *jn.SLOT, seq="seq")
        done = jn.upsert_showings(state, merged, now(), "seq")
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in done.select("times", "seq", "listing").collect()] == [(["18:00", "20:00"], 0, 1)]
    assert plan.count("Exchange hashpartitioning") == 2 and "ObjectHashAggregate" not in plan
    assert spark.conf.get("spark.sql.execution.replaceHashWithSortAgg") == "false"


def test_a_load_over_odd_rows_of_the_store(spark):
    """Two rows of one slot count as one listed slot; rows without a location, a date or an id that nothing lists do not move."""
    films = conform(spark.createDataFrame([(1, "Dune", "dune")], "id long, title string, title_normalized string"), FILMS)
    day, gone = date(2026, 9, 26), datetime(2026, 1, 1)
    stored = [(1, 1, "c1", day, None), (2, 1, "c1", day, gone), (3, 1, None, day, None), (4, 1, "c1", None, None), (5, 1, "c1", date(2026, 9, 27), None), (None, 1, "c1", date(2026, 9, 28), None), (None, 1, "c1", date(2026, 9, 29), gone)]
    showings = conform(spark.createDataFrame(stored, "id long, film_id long, cinema_slug string, date date, removed_at timestamp"), SHOWINGS)
    store = ld.Store(spark.createDataFrame([], CINEMAS), films, showings)
    listed = [show("Dune", "2026-09-26", "20:00"), show("Dune", "2026-09-29", "21:00")]
    # Two slots listed against three active rows (1, 5 and none of the others), a ratio of 2 to 2 after row 2 was archived before.
    result = load(spark, store, [{"title": "Dune"}], listed, min_ratio=1.0)
    assert counters(result) == {"cinemas": 1, "films": 1, "showings": 2, "archived_showings": 1, "reactivated_showings": 2}
    stamp = datetime(2026, 9, 25, 3)
    assert table(result.store.showings, "id", "cinema_slug", "date", "removed_at") == sorted(
        [(1, "c1", day, None), (2, "c1", day, None), (3, None, day, None), (4, "c1", None, None), (5, "c1", date(2026, 9, 27), stamp), (6, "c1", date(2026, 9, 29), None)], key=str
    )
    skipped = load(spark, store, [{"title": "Dune"}], listed, min_ratio=1.5)
    assert table(skipped.skipped_cinemas, "cinema_slug", "existing", "imported") == [("c1", 2, 2)]
    assert counters(skipped) == {"cinemas": 1, "films": 1, "showings": 2, "skipped_cinemas": 1}
