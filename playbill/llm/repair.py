"""Conversation structure repair over a suffix-shared automaton.

A conversation is the signature of its turns, one sign for each: the role's initial and the turn's first fault. A cheapest
repair makes the roles read ``(s?(ua)+)?``. What is left to pay depends on the signs still to come and on the state of
that grammar only, so signatures are read from the end: those that end alike share their nodes, and each node knows,
for every state, the cost to go and the first letter of the best audit, which leads on to the next node. Signatures are
dealt to tasks by ranges of their reversal, so conversations that end alike follow each other and one path of nodes
serves them all; a signature that a third of all conversations have is spread over several ranges.

Turns are put in order by ranges of (conversation, turn) as well, and pass as chunks. Of a conversation only its signature, a byte
for each turn, is ever in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from playbill.llm.tables import partitions
from playbill.session import materialise

#: Signs of a turn: a letter for the role's initial (s, u, a, other) and fault (none, truncated, blank, duplicate).
ROLES, FAULTS = "suao", ("none", "truncated", "blank", "duplicate")
SIGNS = "ABCDEFGHIJKLMNOP"
#: What the automaton reads: blank and duplicate turns go, whatever their role.
DELETED = "Z"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 2, 3, 2, 1
#: States of the grammar: at the start, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or rerouted turn leads, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: Turns of a chunk, and rows handed back at once.
CHUNK = 4096
BLANK = r"[\x20\x09-\x0D]"


def _plain(name: str) -> Column:
    return F.coalesce(name, F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults, as the CRC-32 of ``conv_id:turn`` modulo 20 says.

    0 drops a row, 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats the row, 4 makes its role user. Nulls count as one space.
    """
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select("conv_id", "turn", _plain("role").alias("role"), _plain("text").alias("text"), (F.crc32(named.cast("binary")) % 20).alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter("code <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _rows(turns: DataFrame) -> DataFrame:
    """Turns with 128 bits that stand for role and text."""
    rows = turns.select("conv_id", "turn", _plain("role").alias("role"), _plain("text").alias("text"))
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")})


def _sign(fault: Column) -> Column:
    initial = F.position(F.substring("role", 1, 1), F.lit("sua"))
    role = F.when((F.length("role") > 0) & (initial > 0), initial - 1).otherwise(3)
    return role * 4 + fault


def chunks(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, signs, turns, h1, h2): the turns of each conversation in order, in chunks that follow each other by number.

    Turns follow by ``turn``, a null one first; within one turn by hashes of role and text. Equal rows of a
    turn are one entry with as many signs, of which all but the first are duplicates.
    """
    whole = F.regexp_replace("text", BLANK, "")
    fault = F.when(F.length(whole) == 0, 2).when(~F.right(whole, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    slim = _rows(turns).select("conv_id", "turn", "h1", "h2", _sign(fault).alias("sign"))
    once = materialise(slim.groupBy("conv_id", "turn", "h1", "h2").agg(F.count("*").alias("copies"), F.first("sign").alias("sign")))
    # The first turn that says this; as an aggregate and a join, so that a frequent text does not fill one task.
    first = once.groupBy("conv_id", "h1", "h2").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("of"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first.turn").alias("first"))
    met = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    again = ~F.col("turn").eqNullSafe(F.col("first")) & (F.col("sign") % 4 != 2)
    marked = once.join(first, met).select("conv_id", "turn", "h1", "h2", "copies", F.when(again, F.col("sign") - F.col("sign") % 4 + 3).otherwise(F.col("sign")).alias("sign"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")]
    dealt = materialise(marked).repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        number = None

        def emit() -> pa.RecordBatch:
            nonlocal number, held
            signs = "".join(SIGNS[s] + SIGNS[s if s % 4 == 2 else s - s % 4 + 3] * (n - 1) for *_, n, s, _ in held)
            row = [held[0][0], number, signs, [r[1] for r in held for _ in range(r[4])], [r[2] for r in held for _ in range(r[4])], [r[3] for r in held for _ in range(r[4])]]
            number, held = number + 1, []
            longs = pa.list_(pa.int64())
            types = [pa.int64(), pa.int64(), pa.string(), longs, longs, longs]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["conv_id", "chunk", "signs", "turns", "h1", "h2"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number = row[6] << 40 if number is None else number
                if held and (row[0] != held[0][0] or len(held) == CHUNK):
                    yield emit()
                held.append(list(row))
        if held:
            yield emit()

    rows = dealt.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "h1", "h2", F.col("copies").cast("int").alias("copies"), "sign", F.spark_partition_id().cast("long").alias("part"))
    return materialise(rows.mapInArrow(cut, "conv_id long, chunk long, signs string, turns array<long>, h1 array<long>, h2 array<long>"))


class Nodes:
    """The path of nodes of one signature from its end: node k stands for its last k signs."""

    def __init__(self) -> None:
        self.signs: list[str] = []
        #: By node and state: the cost to go, and the letter of the best audit's first edit.
        self.cost: list[tuple[int, ...]] = [(0, 2 * COST_INSERT, COST_INSERT, 0)]
        self.letter: list[str] = ["." + INSERT + INSERT + "."]

    def read(self, signs: str) -> None:
        """Go to the nodes of a signature, given as the automaton reads it; those of a common end stay."""
        back = signs[::-1]
        same = 0
        for a, b in zip(self.signs, back, strict=False):
            if a != b:
                break
            same += 1
        del self.signs[same:], self.cost[same + 1 :], self.letter[same + 1 :]
        for sign in back[same:]:
            self.add(sign)

    def add(self, sign: str) -> None:
        after, found = self.cost[-1], []
        for state in range(4):
            options = [(after[state] + COST_DELETE, DELETE)]
            if sign != DELETED:
                role, fault = divmod(SIGNS.index(sign), 4)
                more = COST_TRUNCATED if fault == 1 else 0
                to = kept(ROLES[role], state)
                if to is not None:
                    options.append((after[to] + more, KEEP))
                options.append((after[NEXT[state]] + COST_REROLE + more, REROLE))
            found.append(options)
        least = [min(c for c, _ in o) for o in found]
        least[USER], least[ASSISTANT] = min(least[USER], COST_INSERT + least[ASSISTANT]), min(least[ASSISTANT], COST_INSERT + least[USER])
        for state in (START, SYSTEM):
            least[state] = min(least[state], COST_INSERT + least[USER])
        # Each edit leads to one state, so the least letter begins the least audit.
        for state, options in enumerate(found):
            options.append((COST_INSERT + least[NEXT[state]], INSERT))
        self.signs.append(sign)
        self.cost.append(tuple(least))
        self.letter.append("".join(min(x for c, x in o if c == least[state]) for state, o in enumerate(found)))

    def audit(self) -> Iterator[tuple[str, int]]:
        """The best audit of the signature: each edit with the state before it."""
        at, state = len(self.signs), START
        while True:
            edit = self.letter[at][state]
            if edit == ".":
                return
            yield edit, state
            if edit == KEEP:
                state = kept(ROLES[SIGNS.index(self.signs[at - 1]) // 4], state)
            elif edit != DELETE:
                state = NEXT[state]
            at -= edit != INSERT


def kept(role: str, state: int) -> int | None:
    """The state after a turn of this role that stays as it is; None if it cannot."""
    if role == "s":
        return SYSTEM if state == START else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


def read_signs(signs: str | Column) -> Column:
    """A signature as the automaton reads it."""
    gone = "".join(SIGNS[4 * r + f] for r in range(4) for f in (2, 3))
    return F.translate(signs, gone, DELETED * len(gone))


def audits(found: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit, parts) of each conversation of ``chunks``.

    ``parts`` are (chunk, edits, state, place) by chunk: its share of the audit, the state before it and how many turns of the
    repaired conversation come before it. Of the audits of least cost this is the least in ASCII order.
    """
    pieces = F.array_sort(F.collect_list(F.struct("chunk", "signs")))
    whole = found.groupBy("conv_id").agg(pieces.alias("pieces")).withColumn("signs", F.array_join("pieces.signs", ""))
    read = materialise(whole.withColumn("read", read_signs("signs")))
    back = [F.reverse("read"), F.col("conv_id")]
    dealt = read.repartitionByRange(partitions(found.sparkSession), *back).sortWithinPartitions(*back)
    legal = {"su", "ua", "au"}
    part = pa.list_(pa.struct([("chunk", pa.int64()), ("edits", pa.string()), ("state", pa.int64()), ("place", pa.int64())]))
    types = [pa.int64()] * 6 + [pa.string(), part]
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "parts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = Nodes()
        for batch in batches:
            rows = []
            for conv, pieces, signs, read in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodes.read(read)
                roles = [ROLES[SIGNS.index(s) // 4] for s in signs]
                faults = [sum(signs.count(SIGNS[4 * r + f]) for r in range(4)) for f in range(4)]
                illegal = sum(a + b not in legal for a, b in zip(roles, roles[1:], strict=False))
                steps, parts, place = nodes.audit(), [], 0
                edit = next(steps, None)
                for k, piece in enumerate(pieces):
                    left, own, first, begin = len(piece["signs"]), [], edit[1] if edit else START, place
                    while edit and (left or k == len(pieces) - 1):
                        own.append(edit[0])
                        left -= edit[0] != INSERT
                        place += edit[0] != DELETE
                        edit = next(steps, None)
                    parts.append({"chunk": piece["chunk"], "edits": "".join(own), "state": first, "place": begin})
                rows.append((conv, faults[2], faults[3], faults[1], illegal, nodes.cost[-1][START], "".join(p["edits"] for p in parts), parts))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    out = dealt.select("conv_id", "pieces", "signs", "read").mapInArrow(
        run, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<chunk:long,edits:string,state:long,place:long>>"
    )
    return materialise(out)


def edited(found: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, turn, h1, h2): the turns of the repaired conversations; a null role stays as it was."""
    own = found.join(audited.select(F.explode("parts").alias("p")).select("p.*"), "chunk")
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["conv_id", "place", "edit", "role", "turn", "h1", "h2"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for conv, signs, turns, h1, h2, edits, state, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = 0
                for edit in edits:
                    if edit != DELETE:
                        was = (None, None, None) if edit == INSERT else (turns[at], h1[at], h2[at])
                        rows.append((conv, place, edit, None if edit == KEEP else ROLE[state], *was))
                        state = kept(ROLES[SIGNS.index(signs[at]) // 4], state) if edit == KEEP else NEXT[state]
                        place += 1
                    at += edit != INSERT
                if len(rows) >= CHUNK:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    given = own.select("conv_id", "signs", "turns", "h1", "h2", "edits", "state", "place")
    return given.mapInArrow(run, "conv_id long, place long, edit string, role string, turn long, h1 long, h2 long")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each conversation needs, and the repaired turns.

    The first frame is (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conv_id of ``turns``, null
    ones being one conversation. A turn's first fault counts: blank (nothing but white space), duplicate (role and text
    said before), truncated (last sign none of ``.!?``). Keeping a turn is free, a new role costs 2, deleting 3, which blank and duplicate
    turns need, inserting an empty user or assistant turn 2, and a truncated turn that stays 1. ``audit`` spells the edits
    K, R, D and I of the cheapest repair, the least in ASCII order among equals. ``illegal`` counts neighbours whose role initials are not su, ua or au,
    ``gaps`` the missing numbers between the least and the largest turn.

    The second frame is (conv_id, place, edit, role, text, turn), numbered from 0; inserted turns have no text and a null ``turn``. Null roles and
    texts count as one space. Turns come in order of ``turn``, null first; rows of the same turn by a hash of role and text. Other columns of
    ``turns`` take no part.
    """
    found = chunks(turns)
    audited = audits(found)
    spans = turns.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("n"))
    spans = spans.select("conv_id", F.coalesce(F.expr("high - low + 1 - n"), F.lit(0)).cast("long").alias("gaps"))
    report = audited.drop("parts").join(spans.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    new = edited(found, audited)
    said = _rows(turns).groupBy("conv_id", "h1", "h2").agg(F.first("role").alias("was"), F.first("text").alias("text"))
    said = said.select(F.col("conv_id").alias("of"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "was", "text")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    columns = ["conv_id", "place", "edit", F.coalesce("role", "was").alias("role"), "text", "turn"]
    stay = new.filter(F.col("edit") != INSERT).join(said, same).select(*columns)
    return report, stay.unionByName(new.filter(F.col("edit") == INSERT).withColumns({"was": F.lit(None).cast("string"), "text": F.lit("")}).select(*columns))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256): the digest of each repaired conversation's ``role:text`` lines.

    A digest is made line by line by one task, which keeps nothing but the running state.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, None
        done: list[tuple[int | None, str]] = []
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if running is None or conv != at:
                    if running:
                        done.append((at, running.hexdigest()))
                    at, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            yield pa.record_batch([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], names=["conv_id", "sha256"])
            done = []
        if running:
            yield pa.record_batch([pa.array([at], pa.int64()), pa.array([running.hexdigest()])], names=["conv_id", "sha256"])

    dealt = repaired.select("conv_id", "place", "role", "text").repartition(partitions(repaired.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, sha256 string")
