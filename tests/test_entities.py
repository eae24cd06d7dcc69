"""Similarity join, components, fusing and enrichment."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from playbill.functions import text as tx
from playbill.operators import components as cc, fuse as fz, grouping as gr, similarity as sm
from playbill.schema import FILM_RECORD, conform


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        following = [i]
        for j, y in enumerate(b, 1):
            following.append(min(following[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = following
    return row[-1]


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(11)
    drawn = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 13))) for _ in range(250)}
    return sorted(drawn | {"abcdefghijklmnopqrstuvwxyz"[:n] for n in range(1, 27)})


def test_containment_equals_brute_force(spark, words):
    keys = spark.createDataFrame([(w,) for w in words], "key string")
    got = {(r.needle, r.hay) for r in sm.containment_pairs(keys).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and a in b}
    longer = {(r.needle, r.hay) for r in sm.containment_pairs(keys, min_length=3).collect()}
    assert longer == {(a, b) for a, b in got if len(a) >= 3}


def test_near_pairs_equal_brute_force(spark, words):
    keys = spark.createDataFrame([(w,) for w in words + [""]], "key string")
    got = {(r.a, r.b) for r in sm.near_pairs(keys).collect()}
    everything = words + [""]
    assert got == {(a, b) for a in everything for b in everything if a != b and distance(a, b) <= max(2, len(a) // 4)}


def test_similarity_plans_have_no_all_pairs_join(spark, words):
    keys = spark.createDataFrame([(w,) for w in words], "key string")
    for frame in (sm.containment_pairs(keys), sm.near_pairs(keys)):
        plan = frame._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_components_equal_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(1, 400), rnd.randint(1, 400)) for _ in range(220)]
    edges += [(7, n) for n in range(500, 560)] + [(n, n + 1) for n in range(600, 630)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in cc.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == find(n) for n in list(parent))


def films(spark, rows):
    """(title, extra fields) in arrival order."""
    full = [
        {"source_slug": f"s{i}", "arrival_seq": i, "title": r[0], "title_normalized": r[0], "genres": [], **(r[1] if len(r) > 1 else {})}
        for i, r in enumerate(rows)
    ]
    ddl = FILM_RECORD
    names = [part.split()[0] for part in ddl.split(", ")]
    frame = spark.createDataFrame([tuple(f.get(n) for n in names) for f in full], ddl)
    return frame.withColumn("title_normalized", tx.normalize_title(F.col("title_normalized")))


TITLES = [
    "CARS - MOTORI RUGGENTI - 20MO ANNIVERSARIO", "Cars – 20esimo anniversario", "Cars - Motori Ruggenti", "Oppenheimer", "Openheimer",
    "Barbie", "Amori e incantesimi", "Amori e incantesimi 2", "Dune", "Dune Part Two", "DUNE", "Alien", "Alein", "",
]


def reference_groups(titles):
    """The rule applied to all pairs, in plain Python on given keys."""

    def same(a, b):
        if a == b:
            return True
        if a and b and a.rstrip("0123456789") == b.rstrip("0123456789"):
            return False
        return a in b or b in a or distance(a, b) <= max(2, len(a) // 4)

    root = list(range(len(titles)))
    aliases = {"carsmotoriruggenti20moanniversario": "cars20esimoanniversario"}
    for i, j in itertools.combinations(range(len(titles)), 2):
        a, b = titles[i], titles[j]
        ca, cb = aliases.get(a, a), aliases.get(b, b)
        if a and b and (ca == cb or same(a, b) or same(ca, cb)):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    return root


def test_title_resolution_equals_all_pairs(spark, apply):
    rnd = random.Random(2)
    for trial in range(2):
        order = TITLES[:]
        rnd.shuffle(order)
        frame = films(spark, [(t,) for t in order])
        _, labels = fz.fuse_by_title(frame)
        got = {r.node: r.root for r in labels.collect()}
        keys = apply(tx.title_key(tx.normalize_title(F.col("x"))), [(t,) for t in order], "x string")
        assert [got.get(i, i) for i in range(len(order))] == reference_groups(keys), (trial, order)


def test_fuse_keeps_first_values_and_best_title(spark):
    rows = [
        ("AMORI & INCANTESIMI", {"description": "taglio...", "wikidata_id": "Q1"}),
        ("Amori & incantesimi", {"description": "intera", "director": "Rossi", "genres": ["g"], "year": 2001}),
        ("AMORI & INCANTESIMI", {"description": "più lunga ma...", "director": "Verdi", "poster": "p"}),
        ("Solo", {}),
    ]
    fused, labels = fz.fuse_by_title(films(spark, rows))
    got = {r.arrival_seq: r for r in fused.collect()}
    assert sorted(got) == [0, 3]
    assert (got[0].title, got[0].description, got[0].director, got[0].poster, got[0].genres, got[0].year, got[0].wikidata_id) == (
        "Amori & incantesimi", "intera", "Rossi", "p", ["g"], 2001, "Q1",
    )
    moved = fz.rekey_showings(spark.createDataFrame([(1, "x"), (3, "y")], "arrival_seq long, cinema_slug string"), labels)
    assert {(r.arrival_seq, r.cinema_slug) for r in moved.collect()} == {(0, "x"), (3, "y")}


def test_fuse_by_external_id_is_idempotent(spark):
    rows = [("A", {"wikidata_id": "Q1"}), ("b", {"wikidata_id": "Q1"}), ("C", {"wikidata_id": "Q2"}), ("D", {}), ("E", {})]
    once, _ = fz.fuse_by_external_id(films(spark, rows))
    assert sorted((r.arrival_seq, r.title) for r in once.collect()) == [(0, "b"), (2, "C"), (3, "D"), (4, "E")]
    again, _ = fz.fuse_by_external_id(conform(once, FILM_RECORD))
    assert sorted(map(tuple, again.select("arrival_seq", "title", "wikidata_id").collect()), key=str) == sorted(
        map(tuple, once.select("arrival_seq", "title", "wikidata_id").collect()), key=str
    )


def test_enrichment_fills_only_empty_fields(spark):
    frame = films(spark, [("Dune (2021)", {"director": "mine"}), ("Done", {"poster": "p", "description": "d", "director": "x", "duration": "1 min"}), ("Unknown", {}), ("Never", {})])
    dimension = spark.createDataFrame(
        [("dune", True, "wp", "wd", "wdir", "10 min", None, "Q5", 2021), ("done", True, "no", "no", "no", "no", "no", "Q9", 1), ("unknown", False) + (None,) * 7],
        "lookup_key string, found boolean, poster string, description string, director string, duration string, original_title string, wikidata_id string, year int",
    )
    got = {r.title: r for r in fz.enrich(frame, dimension).collect()}
    dune = got["Dune (2021)"]
    assert (dune.poster, dune.description, dune.director, dune.year, dune.wikidata_id) == ("wp", "wd", "mine", 2021, "Q5")
    assert got["Done"].wikidata_id is None and got["Unknown"].poster is None
    assert [r.title for r in fz.enrichment_worklist(frame, dimension).collect()] == ["Never"]


def test_candidates(spark):
    rows = [(1, "il padrino"), (2, "il padrino 2"), (3, "x"), (4, "x al cinema"), (5, "altro film"), (6, "x"), (7, "odissea"), (8, "odisea")]
    frame = spark.createDataFrame(rows, "id long, key string")
    grouped = spark.createDataFrame([(7, "g"), (8, "g")], "id long, group string")
    got = {(r.first_id, r.second_id, r.reason) for r in sm.candidate_pairs(frame, grouped).collect()}
    assert got == {(1, 2, "distance 2"), (3, 4, "word suffix")}


def test_cluster_pairs_reports_unknown_ids(spark):
    known = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    labels, unknown = cc.cluster_pairs(spark.createDataFrame([(1, 2), (2, 3), (3, 9)], "a long, b long"), known)
    assert {(r.node, r.root) for r in labels.collect()} == {(1, 1), (2, 1), (3, 1), (9, 1)}
    assert [r.id for r in unknown.collect()] == [9]
    assert {(r.root, r.members) for r in cc.component_sizes(labels).collect()} == {(1, 4)}


def test_consolidation(spark):
    ddl = "f long, showing_seq long, cinema string, cinema_slug string, date string, times array<string>, screen string, source_url string, language string, session_attributes array<string>"
    rows = [
        (1, 0, "C", "c", "2026-01-01", ["20:00", ""], None, None, None, []),
        (1, 1, "C", "c", "2026-01-01", ["18:00", "20:00"], "", "u", None, None),
        (1, 2, "C", "c", "2026-01-01", ["21:00"], "1", "v", "it", ["3D", "VO"]),
        (1, 3, "C", "c", "2026-01-01", ["22:00"], "1", "w", "it", ["VO", "3D"]),
    ]
    got = sorted(gr.consolidate_showings(spark.createDataFrame(rows, ddl), "f").collect(), key=lambda r: r.showing_seq)
    assert [(r.times, r.screen, r.source_url, r.session_attributes) for r in got] == [
        (["18:00", "20:00"], None, "u", []), (["21:00", "22:00"], "1", "v", ["3D", "VO"]),
    ]
