"""Keys within many edits of each other, a block of keys against a block.

Where a key tolerates so many edits that the segments between them have a few letters, what keys share selects little: in
titles of one language half of all pairs have such a segment in common. Keys are therefore dealt into strips by length,
strips within reach of each other meet once, and a strip against a strip is told in vectors, by what costs least:

* bitmaps of letters by halves of the key. An edit changes two (letter, half) counts at most, or one and what it moves over the
  middle; over both halves of keys that differ by ``d`` edits the counts differ by 2 d, and by 1 if their lengths are odd and even;
* segments, where few keys share one: the first key in (edits + 1) segments, looked up where they can have moved to.

What is left is told by bitmaps of pairs of letters (4 d), then by the longest common subsequence, which is shorter than the
longer key by ``d`` at most, with one bit for each letter (Hyyrö, "Bit-parallel LCS-length computation revisited", 2004).
Each of these keeps every pair within the edits, and Spark's distance decides in the end. Nothing is capped, and a task holds
two strips of at most ``KEYS`` keys and ``LETTERS`` letters, or one key if it is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from playbill.functions import text as tx
from playbill.session import discard, materialise

#: Strips of all keys, about; keys and letters of a strip, at least and at most.
STRIPS, LEAST_KEYS, KEYS, LETTERS = 16, 1 << 13, 1 << 17, 1 << 22
#: Bits of the bitmaps of letters and of pairs of letters.
LETTER_BITS, PAIR_BITS = 256, 384
#: Rows and columns compared at once; candidates held before they are told further.
ROWS, COLUMNS, HELD = 16, 4096, 1 << 16
#: Nanoseconds of a compared pair, of a candidate by segments and of a looked up segment, to choose between them; of so many keys.
PAIR_NS, CANDIDATE_NS, LOOKUP_NS, ASKED = 5, 80, 250, 256
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _counted(codes: np.ndarray) -> np.ndarray:
    """The codes of each row with how often they were there before, in any order."""
    codes = np.sort(codes, axis=1)
    at = np.arange(codes.shape[1])
    new = np.ones(codes.shape, bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    return codes * _MIX[0] + (at - first).astype(np.uint64)


class _Keys:
    """Keys of one length."""

    def __init__(self, keys: list[str], length: int) -> None:
        self.keys, self.length = keys, length
        self.codes = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32).reshape(len(keys), length)

    def __len__(self) -> int:
        return len(self.keys)

    def _bitmaps(self, letters: int, bits: int) -> np.ndarray:
        """A bit of a key is set if an odd number of its (letters, times they were there, half) falls on it."""
        found = np.zeros((len(self), bits // 64), np.uint64)
        if self.length < letters:
            return found
        step = max(1, (1 << 20) // max(bits, self.length))
        for k in range(0, len(self), step):
            codes = self.codes[k : k + step].astype(np.uint64)
            runs = codes[:, : self.length - letters + 1]
            for j in range(1, letters):
                runs = (runs << np.uint64(21)) + codes[:, j : self.length - letters + 1 + j]
            half = self.length // 2
            items = np.concatenate([_counted(runs[:, :half]) * np.uint64(2), _counted(runs[:, half:]) * np.uint64(2) + np.uint64(1)], axis=1)
            items = items * _MIX[0]
            items = ((items ^ (items >> np.uint64(29))) * _MIX[1]) >> np.uint64(32)
            places = ((items * np.uint64(bits)) >> np.uint64(32)).astype(np.int64) + np.arange(len(codes))[:, None] * bits
            odd = np.bincount(places.ravel(), minlength=len(codes) * bits) & 1
            found[k : k + step] = np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1).view(np.uint64)
        return found

    @cached_property
    def letters(self) -> np.ndarray:
        return self._bitmaps(1, LETTER_BITS)

    @cached_property
    def columns(self) -> np.ndarray:
        return np.ascontiguousarray(self.letters.T)

    @cached_property
    def pairs(self) -> np.ndarray:
        return self._bitmaps(2, PAIR_BITS)

    @cached_property
    def places(self) -> np.ndarray:
        """For each of 64 classes of letters the places where keys have one, as bits."""
        found = np.zeros((64, len(self)), np.uint64)
        every = np.arange(len(self))
        for p in range(self.length):
            found[self.codes[:, p] % 64, every] |= np.uint64(1 << p)
        return found

    def segment(self, start: int, size: int, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hashes of the letters from a place on."""
        found = np.zeros(len(self.codes[some]), np.uint64)
        for p in range(start, start + size):
            found = (found + self.codes[some, p]) * _MIX[0]
            found ^= found >> np.uint64(29)
        return found


def _by_length(keys: list[str]) -> list[_Keys]:
    groups: dict[int, list[str]] = {}
    for key in keys:
        groups.setdefault(len(key), []).append(key)
    return [_Keys(groups[n], n) for n in sorted(groups)]


def _segments(length: int, edits: int) -> list[tuple[int, int, int]]:
    """(number, start, size) of an even cut into ``edits`` + 1 parts, longer parts last."""
    base, more = divmod(length, edits + 1)
    cut, start = [], 0
    for i in range(edits + 1):
        size = base + (i > edits - more)
        cut.append((i, start, size))
        start += size
    return cut


def _moved(length: int, other: int, edits: int, segment: tuple[int, int, int]) -> range:
    """Where segment i can have moved to in a key of another length (multi-match-aware)."""
    i, start, size = segment
    gap = other - length
    return range(max(start - i, start + gap - (edits - i), 0), min(start + i, start + gap + (edits - i), other - size) + 1)


def _by_segments(x: _Keys, y: _Keys, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]] | None:
    """Numbers of keys that share a segment where it can be; none if comparing all costs less."""
    if x.length <= edits:
        return None
    asked = np.unique(np.linspace(0, len(y) - 1, min(ASKED, len(y))).astype(np.int64))
    cut = []
    met = lookups = 0
    for segment in _segments(x.length, edits):
        codes = x.segment(segment[1], segment[2])
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        cut.append((segment, codes, order))
        for p in _moved(x.length, y.length, edits, segment):
            looked = y.segment(p, segment[2], asked)
            met += int((np.searchsorted(codes, looked, "right") - np.searchsorted(codes, looked)).sum())
            lookups += 1
        if met * len(y) / len(asked) * CANDIDATE_NS + lookups * len(y) * LOOKUP_NS > len(x) * len(y) * PAIR_NS:
            return None
    return _looked_up(x, y, edits, cut)


def _looked_up(x: _Keys, y: _Keys, edits: int, cut: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for segment, codes, order in cut:
        for p in _moved(x.length, y.length, edits, segment):
            looked = y.segment(p, segment[2])
            first = np.searchsorted(codes, looked)
            count = np.searchsorted(codes, looked, "right") - first
            those = np.flatnonzero(count)
            # As many at once as are held, or those of one key.
            ends = np.cumsum(count[those])
            at = 0
            while at < len(those):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
                part = those[at:stop]
                n = count[part]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield order[within + np.repeat(first[part], n)], np.repeat(part, n)
                at = stop


def _by_bitmaps(x: _Keys, y: _Keys, bound: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of keys whose bitmaps of letters differ in few enough bits, all compared."""
    a, b = x.columns, y.columns
    kind = np.uint8 if x.length + y.length < 256 else np.uint16
    bits, count, total = np.empty((ROWS, COLUMNS), np.uint64), np.empty((ROWS, COLUMNS), np.uint8), np.empty((ROWS, COLUMNS), kind)
    for i in range(0, len(x), ROWS):
        rows = min(ROWS, len(x) - i)
        for j in range(i // COLUMNS * COLUMNS if same else 0, len(y), COLUMNS):
            width = min(COLUMNS, len(y) - j)
            differ, ones, apart = bits[:rows, :width], count[:rows, :width], total[:rows, :width]
            apart[:] = 0
            for w in range(len(a)):
                np.bitwise_xor(a[w, i : i + rows, None], b[w, None, j : j + width], out=differ)
                np.bitwise_count(differ, out=ones)
                apart += ones
            found = np.flatnonzero((apart <= bound).ravel())
            yield i + found // width, j + found % width


def _common(x: _Keys, y: _Keys, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of classes of letters, of pairs; ``x`` has 64 letters at most."""
    state = np.full(len(one), ~np.uint64(0))
    classes = y.codes[two] % 64
    for p in range(y.length):
        met = state & x.places[classes[:, p], one]
        state = (state + met) | (state - met)
    low = np.uint64((1 << x.length) - 1)
    return np.bitwise_count(~state & low)


def _told(x: _Keys, y: _Keys, one: np.ndarray, two: np.ndarray, edits: int, odd: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the candidates that pairs of letters and the longest common subsequence allow."""
    keep = np.bitwise_count(x.pairs[one] ^ y.pairs[two]).sum(axis=1, dtype=np.int32) <= 4 * edits + odd
    one, two = one[keep], two[keep]
    if x.length <= 64:
        keep = _common(x, y, one, two) >= max(x.length, y.length) - edits
    elif y.length <= 64:
        keep = _common(y, x, two, one) >= max(x.length, y.length) - edits
    else:
        return one, two
    return one[keep], two[keep]


def _meet(x: _Keys, y: _Keys, edits: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of keys that may be within so many edits, a few too many; of the ``same`` keys each pair once."""
    odd = (x.length + y.length) & 1
    bound = 2 * edits + odd
    found = _by_segments(x, y, edits)
    by_bitmaps = found is None
    held, size = [], 0
    for one, two in _by_bitmaps(x, y, bound, same) if by_bitmaps else found:
        if same:
            keep = one < two
            one, two = one[keep], two[keep]
        if not by_bitmaps:
            keep = np.bitwise_count(x.letters[one] ^ y.letters[two]).sum(axis=1, dtype=np.int32) <= bound
            one, two = one[keep], two[keep]
        held.append((one, two))
        size += len(one)
        if size >= HELD:
            yield _told(x, y, *(np.concatenate(c) for c in zip(*held)), edits, odd)
            held, size = [], 0
    if held:
        yield _told(x, y, *(np.concatenate(c) for c in zip(*held)), edits, odd)


def candidates(one: list[str], two: list[str] | None, tolerated: dict[int, int]) -> Iterator[tuple[list[str], list[str]]]:
    """Pairs of keys of two strips, or of one, that may be within what either tolerates by its length; each once."""
    first = _by_length(one)
    second = first if two is None else _by_length(two)
    for k, x in enumerate(first):
        for y in second[k:] if two is None else second:
            edits = max(tolerated.get(x.length, -1), tolerated.get(y.length, -1))
            if edits < abs(x.length - y.length):
                continue
            for a, b in _meet(x, y, edits, x is y):
                if len(a):
                    yield [x.keys[i] for i in a.tolist()], [y.keys[i] for i in b.tolist()]


def _strips(counts: list[tuple[bool, int, int]]) -> list[tuple[bool, int, int, int]]:
    """(new, least length, greatest length, parts) of strips; a length with too many keys is dealt into parts of its own."""
    most = min(KEYS, max(LEAST_KEYS, sum(n for _, _, n in counts) // STRIPS))
    strips: list[tuple[bool, int, int, int]] = []
    keys = letters = 0
    for new, length, number in sorted(counts):
        parts = max(-(-number // most), -(-number * length // LETTERS))
        fits = strips and strips[-1][0] == new and strips[-1][3] == parts == 1 and keys + number <= most and letters + number * length <= LETTERS
        if fits:
            strips[-1] = (new, strips[-1][1], length, 1)
            keys, letters = keys + number, letters + number * length
        else:
            strips.append((new, length, length, min(parts, number)))
            keys, letters = number, number * length
    return strips


def near_in_blocks(new: DataFrame, old: DataFrame | None, budget, dense) -> DataFrame:
    """(a, b): ordered pairs of different keys, at least one of them new, with distance(a, b) <= budget(length of a), for
    lengths of ``a`` that are ``dense``. Keys are distinct, and none is both new and old."""
    spark = new.sparkSession
    n = F.length("key")
    rows = new.select("key", F.lit(True).alias("new"))
    if old is not None:
        rows = rows.unionByName(old.select("key", F.lit(False).alias("new")))
    counts = rows.groupBy("new", n.alias("n")).agg(F.count("*").alias("keys"))
    # As many rows as there are lengths.
    counts = counts.select("new", "n", "keys", F.when(dense(F.col("n"), budget), budget(F.col("n"))).alias("t")).collect()
    tolerated = {r["n"]: r["t"] for r in counts if r["t"] is not None}
    strips = _strips([(r["new"], r["n"], r["keys"]) for r in counts])

    reach, dealt, part_of = [], [], []
    for number, (fresh, low, high, parts) in enumerate(strips):
        reached = [(m - t, m + t) for m, t in tolerated.items() if low <= m <= high]
        reach.append((min((r[0] for r in reached), default=1), max((r[1] for r in reached), default=0)))
        dealt += [(r["new"], r["n"], number, parts) for r in counts if r["new"] == fresh and low <= r["n"] <= high]
        part_of += [(number, part) for part in range(parts)]
    meets = lambda s, o: reach[s][0] <= strips[o][2] and strips[o][1] <= reach[s][1]
    met = [
        (*x, *y) for k, x in enumerate(part_of) for y in part_of[k:]
        if (strips[x[0]][0] or strips[y[0]][0]) and (meets(x[0], y[0]) or meets(y[0], x[0]))
    ]
    if not met:
        return spark.createDataFrame([], "a string, b string")

    deal = spark.createDataFrame(dealt, "new boolean, n int, strip int, parts int")
    placed = rows.withColumn("n", n).join(deal, ["new", "n"]).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    held = materialise(placed.groupBy("strip", "part").agg(F.collect_list("key").alias("keys")))
    ends = [held.select(F.col("strip").alias(f"{c}_strip"), F.col("part").alias(f"{c}_part"), F.col("keys").alias(f"{c}_keys")) for c in "xy"]
    pairs = spark.createDataFrame(met, "x_strip int, x_part int, y_strip int, y_part int")
    # A strip that meets itself is sent once.
    itself = (F.col("x_strip") == F.col("y_strip")) & (F.col("x_part") == F.col("y_part"))
    both = pairs.join(ends[0], ["x_strip", "x_part"]).join(ends[1], ["y_strip", "y_part"]).select("x_keys", F.when(~itself, F.col("y_keys")).alias("y_keys"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1)):
                for a, b in candidates(one.as_py(), two.as_py(), tolerated):
                    yield pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["x", "y"])

    likely = both.repartition(min(len(met), 512)).mapInArrow(told, "x string, y string")
    ways = F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"))))
    ordered = likely.select(ways.alias("p")).select("p.*")
    allowed: Column = F.length("a")
    near = dense(allowed, budget) & (F.col("a") != F.col("b")) & tx.within_distance(F.col("a"), F.col("b"), budget(allowed))
    # A row is two strips: one of them at a time.
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        found = materialise(ordered.filter(near).distinct())
    finally:
        spark.conf.set(key, before)
    discard(held)
    return found
