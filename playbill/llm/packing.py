"""Best-fit packing of token sequences after Martello-Toth reduction.

How pieces go together depends only on how many there are of each length, and lengths end at the capacity. So the
plan is made from a histogram of at most ``capacity`` rows. First the reduction: for each length, from the longest,
a bin that provably dominates every other bin with a piece of that length is fixed, as often as the counts allow.
What is left is packed best-fit, longest first. The plan is a list of slots, each a run of equal pieces going to
consecutive sequences; documents find their slots by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from playbill.llm.encoders import byte_bpe
from playbill.llm.tables import map_rows, partitions, texts
from playbill.session import materialise

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Documents as token pieces: ids, then the end id; longer ones are cut, the first piece taking what is left over.

    A null text is empty, so it is one piece with the end id. Repeated rows are packed as often as they occur.
    """
    end = end_id.to_bytes(4, "little")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = byte_bpe(tokenizer).encode
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text) + end
            n = len(ids) // 4
            first = n % capacity or capacity
            bounds = [0, *range(first, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                part = ids[4 * a : 4 * b]
                rows.append((doc, k, a, b - a, zlib.crc32(part), part))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 if with_ids else 5]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names[: len(kinds)])

    return map_rows(texts(docs), cut, PIECES + ", ids binary" * with_ids)


class Plan:
    """Slots for pieces by length: (length, first rank, number, first sequence, offset)."""

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity, self.left = capacity, {w: n for w, n in counts.items() if n}
        self.taken = dict.fromkeys(self.left, 0)
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0

    def put(self, length: int, number: int, sequence: int, offset: int) -> None:
        self.slots.append((length, self.taken[length], number, sequence, offset))
        self.taken[length] += number
        self.left[length] -= number
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: tuple[int, ...], times: int) -> None:
        """So many sequences with just these pieces."""
        at = 0
        for w in lengths:
            self.put(w, times, self.sequences, at)
            at += w
        self.sequences += times
        self.fixed += times * len(lengths)

    def reduce(self) -> None:
        """Fix bins that dominate, from the longest piece on."""
        sizes = sorted(self.left)
        for w in reversed(sizes):
            while w in self.left:
                bin_ = self._dominating(w, sizes)
                if bin_ is None:
                    break
                self.fix(bin_, min(self.left[x] // bin_.count(x) for x in set(bin_)))
                sizes = [x for x in sizes if x in self.left]

    def _dominating(self, w: int, sizes: list[int]) -> tuple[int, ...] | None:
        """The pieces of a bin that dominates all bins with w, if up to three pieces settle it; sizes ascend."""
        room, n = self.capacity - w, self.left
        number = lambda x: n.get(x, 0) - (x == w)  # noqa: E731  beside this piece
        least = [x for x in sizes[:4] for _ in range(min(3, number(x)))][:3]
        if not least or least[0] > room:
            return (w,)
        at = bisect_right(sizes, room) - 1
        while number(sizes[at]) < 1:
            at -= 1
        best = sizes[at]
        # At most one more fits, or two fill the bin: no other choice can do better.
        if best == room or len(least) < 2 or least[0] + least[1] > room:
            return (w, best)
        if len(least) > 2 and sum(least) <= room:
            return None
        # Two more fit at most: compare the best one with the best two.
        pair, low, high = (0, 0), 0, at
        while low <= high:
            a, b = sizes[low], sizes[high]
            if number(b) < 1 or a + b > room:
                high -= 1
            elif number(a) < 1 + (a == b):
                low += 1
            else:
                pair = max(pair, (b, a), key=sum)
                low += 1
        if best >= sum(pair):
            return (w, best)
        # {w, b, a} dominates all pairs {c, d} with c <= b if at most one piece beside b can beat a.
        b, a = pair
        between = [x for x in sizes[bisect_right(sizes, a) : at + 1] for _ in range(min(2, number(x) - (x == b))) if x > a][:2]
        if b == best and (len(between) < 2 or sum(between) > room):
            return (w, b, a)
        return None

    def best_fit(self) -> None:
        """The rest, longest first, each piece to the fullest sequence with room for it."""
        open_: list[tuple[int, int, int]] = []  # (room, first sequence, number), by room
        for w in sorted(self.left, reverse=True):
            while w in self.left:
                at = bisect_right(open_, (w, -1, 0))
                if at < len(open_):
                    room, first, number = open_.pop(at)
                else:
                    per = self.capacity // w
                    room, first, number = self.capacity, self.sequences, -(-self.left[w] // per)
                    self.sequences += number
                each = room // w
                full, rest = min(self.left[w] // each, number), 0
                if full < number:
                    rest = min(self.left[w] - full * each, each)
                # Runs of sequences with `each`, then one with `rest`, then those that stay as they were.
                for run, start, filled in ((full, first, each), (min(rest, 1), first + full, rest)):
                    for k in range(filled if run else 0):
                        self.put(w, run, start, self.capacity - room + k * w)
                    if run and room > filled * w:
                        insort(open_, (room - filled * w, start, run))
                if number > full + min(rest, 1):
                    insort(open_, (room, first + full + min(rest, 1), number - full - min(rest, 1)))


def plan(capacity: int, counts: dict[int, int]) -> Plan:
    """Reduced, then best-fit. Bounded by the capacity, however many pieces there are."""
    made = Plan(capacity, counts)
    made.reduce()
    made.best_fit()
    return made


def ranked(items: DataFrame) -> DataFrame:
    """``items`` with ``rank``, from 0 within each length.

    Numbers are given within (length, salt) and moved by the counts of the salts before, so that a length that
    many copies share is spread over all partitions.
    """
    salts = partitions(items.sparkSession)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    row = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    numbered = salted.withColumn("row", row).join(offsets, ["length", "salt"])
    return numbered.withColumn("rank", F.col("row") - 1 + F.col("before")).drop("row", "before", "salt")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (doc_id, piece, length, ...) with sequence_id and offset. ``items`` is read three times: pass a table."""
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = np.array(sorted(plan(capacity, counts).slots), dtype=np.int64).reshape(-1, 5)
    step = np.int64(1 << 44)
    keys = slots[:, 0] * step + slots[:, 1]
    order = ranked(items)
    at_length, at_rank = order.columns.index("length"), order.columns.index("rank")

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy()
        slot = slots[np.searchsorted(keys, length * step + rank, side="right") - 1]
        found = [pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])]
        kept = [k for k in range(batch.num_columns) if k != at_rank]
        return pa.record_batch([*(batch.column(k) for k in kept), *found], names=[*(batch.schema.names[k] for k in kept), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in order.schema if f.name != "rank")
    return map_rows(order, place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its place: texts are encoded once, and only figures are shuffled."""
    return pack(materialise(pieces(docs, tokenizer, capacity, end_id)), capacity)
