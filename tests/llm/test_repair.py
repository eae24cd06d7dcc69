"""Conversation repair against a search over all edits."""

import random

import brute
import pytest

from playbill.llm import repair
from playbill.llm.catalog import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def made(rng: random.Random, number: int) -> list[tuple]:
    rows = []
    for conv in range(number):
        turn = rng.randint(-2, 3)
        for _ in range(rng.randint(1, 8)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "u", "automaton"])
            text = rng.choice(["Yes.", "No!", "why", "Well. ", "…", "", " \n", None, "a.\tb", f"{rng.randint(0, 9)}?"])
            rows.append((conv, turn, role, text))
            turn += rng.choice([1, 1, 1, 2, 5])
    return rows


def query(spark, path, rows, *more):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", *more).repartition(3).write.parquet(str(path / "conversations.parquet"))
    return QUERIES["op11_conversation_repair"](spark, str(path))


def test_query(spark, tmp_path):
    rows = made(random.Random(2), 400)
    rows += [(1000, None, "user", "Hm."), (1001, None, None, None), (1001, 3, "assistant", "x."), (None, 1, "user", "A."), (None, 2, "assistant", "B.")]
    rows += [(c, t, "user" if t % 2 else "assistant", f"{t}.") for c in (2000, 2001) for t in range(1, 41)]
    got = query(spark, tmp_path, rows, "'x' AS signs", "1 AS chunk", "2 AS place", "'k' AS copy", "0 AS h1").collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r["conv_id"]: tuple(r[c] for c in NAMES) for r in got} == brute.conversations(rows)


def test_a_long_conversation_in_chunks(spark, tmp_path, monkeypatch):
    """Chunks are cut after so many turns wherever they are; the audit goes on across them."""
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"{t}.", f"{t}.", f"{t}", "again."])) for t in range(300)]
    rows += [(8, t, "user", "Same.") for t in range(60)]
    want = brute.conversations(rows)
    monkeypatch.setattr(repair, "CHUNK", 7)
    found = repair.chunks(repair.damaged(spark.createDataFrame(rows, SCHEMA))).collect()
    assert max(len(r["signs"]) for r in found) < 15 < len(found)
    got = query(spark, tmp_path, rows).collect()
    assert {r["conv_id"]: tuple(r[c] for c in NAMES) for r in got} == want


def test_rows_of_one_turn_and_repeated_rows(spark):
    """Equal rows of a turn are one turn and its duplicates; others follow in an order that does not depend on that of the rows."""
    rows = [(1, 5, "user", "Hello."), (1, 5, "user", "Hello."), (1, 5, "user", "Hello."), (1, 6, "assistant", "Oh."), (1, 7, "user", "Hello."), (2, 1, "user", "P."), (2, 1, "user", "Q."), (2, 2, "assistant", "R.")]
    report, turns = (df.collect() for df in repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert {r["conv_id"]: (r["gaps"], r["duplicate"], r["cost"], r["audit"]) for r in report} == {1: (0, 3, 9, "KDDKD"), 2: (0, 0, 2, "KIKK")}
    own = sorted((r["place"], r["edit"], r["role"], r["text"], r["turn"]) for r in turns if r["conv_id"] == 1)
    assert own == [(0, "K", "user", "Hello.", 5), (1, "K", "assistant", "Oh.", 6)]
    again = [df.collect() for df in repair.repair(spark.createDataFrame(rows[::-1], SCHEMA))]
    assert sorted(map(str, again[0])) == sorted(map(str, report)) and sorted(map(str, again[1])) == sorted(map(str, turns))


@pytest.mark.parametrize("seed", range(3))
def test_nodes_are_shared_and_right(seed):
    """A path of nodes that serves signature after signature gives what a search over all edits gives."""
    rng, nodes = random.Random(seed), repair.Nodes()
    roles, texts = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}, ["{}.", "{}", "", "same."]
    found = {"".join(rng.choice(repair.SIGNS) for _ in range(rng.randint(0, 7))) for _ in range(300)}
    for signs in sorted(found, key=lambda s: s[::-1]):
        rows = []
        for k, sign in enumerate(signs):
            role, fault = divmod(repair.SIGNS.index(sign), 4)
            rows.append((k, roles[repair.ROLES[role]], texts[fault].format(k)))
        if any(repair.SIGNS.index(s) % 4 == 3 for s in signs):
            rows = [r for r, s in zip(rows, signs, strict=True) if repair.SIGNS.index(s) % 4 != 3]
            signs = "".join(s for s in signs if repair.SIGNS.index(s) % 4 != 3)
        read = "".join(repair.DELETED if repair.SIGNS.index(s) % 4 > 1 else s for s in signs)
        nodes.read(read)
        want = brute.repaired(rows)
        assert (nodes.cost[-1][repair.START], "".join(e for e, _ in nodes.audit())) == want[5:7]


def test_an_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []).collect() == []
