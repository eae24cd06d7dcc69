"""Runs in the words of documents: stretches that repeat with a period, found as maximal pairs.

The suffixes of a document that share their first words with another are ranked by doubling, many documents at once,
and neighbours in that order give the LCP-intervals. These are walked from the bottom up. An interval holds the places
where its words occur, in order, each known by the word to its left, its class. When two intervals become one, their
places are paired across with the nearest of the other: two places of different classes cannot be extended to
the left, and as they come from different children of their interval, not to the right either. A pair whose distance is
no more than the words it shares is a run already, of that period; nothing is extended. Two places that are no
neighbours never give a run's smallest period, so a merge asks only for the nearest ones, and the smaller list goes
into the larger.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from playbill.llm.tables import texts

#: Words of the shortest run. A run shares at least half its words with itself, one period on.
LEAST = 12
#: Words that are ranked together, about; a longer document is ranked alone.
BLOCK = 1 << 18


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1]


def _after(values: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([values[k:], np.zeros(min(k, len(values)), values.dtype)])


class Suffixes:
    """Suffixes that share ``known`` words or more with another of their document: in order, with the words shared.

    ``words`` are the numbers of the words, each document followed by a number that occurs nowhere else, which ends all comparisons.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray, known: int):
        n = np.int64(len(words) + 1)
        # Ranks of stretches of 1, 2, 4 ... words, then of ``known`` words within a document.
        self.short = [(1, _dense(words))]
        while 2 * self.short[-1][0] <= known:
            k, rank = self.short[-1]
            self.short.append((2 * k, _dense(rank * n + _after(rank, k))))
        length, rank = self.short[-1]
        for k, other in reversed(self.short):
            if length + k <= known:
                rank, length = _dense(rank * n + _after(other, length)), length + k
        rank = _dense(owner * n + rank)
        sizes = np.bincount(rank)
        self.places = np.flatnonzero(sizes[rank] > 1)
        self.group = rank
        # From here on a rank is the number of suffixes before, so that those told apart already keep theirs.
        rank = (np.cumsum(sizes) - sizes)[rank]
        self.levels, active, k = [(known, rank)], self.places, known
        while len(active):
            rank = rank.copy()
            key = rank[active] * n + rank[active + k]
            active, key = (x[np.argsort(key, kind="stable")] for x in (active, key))
            old, at = key // n, np.arange(len(key))
            first = np.append(True, key[1:] != key[:-1])
            begin = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
            rank[active] = old + np.maximum.accumulate(np.where(first, at, 0)) - begin
            active, k = active[~(first & np.append(first[1:], True))], 2 * k
            self.levels.append((k, rank))
        self.places = self.places[np.argsort(rank[self.places], kind="stable")]

    def shared(self) -> np.ndarray:
        """Words that each suffix shares with the one before it; 0 where fewer than known."""
        a, b = self.places[:-1], self.places[1:]
        same = self.group[a] == self.group[b]
        a, b = a[same], b[same]
        length = np.zeros(len(a), np.int64)
        for k, rank in [*reversed(self.levels), *reversed(self.short)]:
            length += np.where(rank[a + length] == rank[b + length], k, 0)
        out = np.zeros(len(self.places), np.int64)
        out[1:][same] = length
        return out


def maximal_pairs(places: Iterable[int], shared: Iterable[int], classes: list[int], least: int) -> list[tuple[int, int, int]]:
    """(place, distance, words shared) of maximal pairs that are runs of ``least`` words or more, not all of smallest period."""
    found: list[tuple[int, int, int]] = []
    lists: list[list[int]] = []
    links: list[int] = []

    def join(words: int) -> None:
        small, large = lists.pop(), lists[-1]
        if len(small) > len(large):
            small, large = large, small
        near = max(1, least - words)
        for x in small:
            at = bisect(large, x)
            for a, b in ((large[at - 1], x) if at else (x, x), (x, large[at]) if at < len(large) else (x, x)):
                if near <= b - a <= words and classes[a] != classes[b]:
                    found.append((a, b - a, words))
        if len(small) * 16 < len(large):
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
        lists[-1] = large

    for place, words in zip(places, shared, strict=True):
        while links and links[-1] > words:
            join(links.pop())
        if words:
            lists.append([place])
            links.append(words)
        else:
            lists = [[place]]
    while links:
        join(links.pop())
    return found


def runs_of(words: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, in order, of texts given as numbers of words from 0."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    line = np.empty(int(sizes.sum()), np.int64)
    inside = np.ones(len(line), bool)
    inside[ends - 1] = False
    line[inside] = np.concatenate([*words, np.empty(0, np.int64)])
    line[ends - 1] = len(line) + 1 + line[inside].max(initial=0) + np.arange(len(words))
    suffixes = Suffixes(line, owner, max(1, -(-least // 2)))
    classes = np.concatenate([[-1], line[:-1]])
    pairs = maximal_pairs(suffixes.places.tolist(), suffixes.shared().tolist(), classes.tolist() if len(suffixes.places) else [], least)
    place, distance, length = np.array(pairs, np.int64).reshape(-1, 3).T
    length = length + distance
    # A multiple of a period makes a pair of the same stretch: the smallest is the run's.
    order = np.lexsort((distance, length, place))
    place, distance, length = place[order], distance[order], length[order]
    first = np.append(True, (np.diff(place) != 0) | (np.diff(length) != 0))[: len(place)]
    place, distance, length = place[first], distance[first], length[first]
    order = np.lexsort((distance, length, place))
    place, distance, length = place[order], distance[order], length[order]
    text = owner[place]
    return text, place - (ends - sizes)[text], length, distance


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, text) of each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``runs`` lists (start, length, period) of every run of ``least`` words or more and two
    periods, by start, length and period; ``text`` has the words that are in no run after that run's first period, joined by
    a blank. A null text is empty; texts without words have no runs and an empty text. Every row stands for itself,
    so rows with the same or a null doc_id stay, and other columns of ``docs`` take no part. A text is read whole however long.
    """

    def block(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        numbers = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for _, words in held]
        text, start, length, period = runs_of(numbers, least)
        cuts = np.searchsorted(text, np.arange(len(held) + 1))
        kept = []
        for k, (_, words) in enumerate(held):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, start[a:b] + period[a:b], 1)
                np.add.at(change, start[a:b] + length[a:b], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
            kept.append(b" ".join(words).decode())
        found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found)
        ids = pa.array([i for i, _ in held], pa.int64())
        return pa.record_batch([ids, pa.array([len(w) for _, w in held], pa.int64()), lists, pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "text"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.encode().split()  # bytes split at \x20 and \x09-\x0D
                if held and size + len(words) > BLOCK:
                    yield block(held)
                    held, size = [], 0
                held.append((doc, words))
                size += len(words)
            if held:
                yield block(held)

    given = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text): about every tenth document goes round in a loop from some word on, as its doc_id says.

    With h the CRC-32 of the decimal doc_id and g = h div 10, the documents of h % 10 = 0 repeat the p words from word
    a = g % n on, where p = 1 + (n - a) div (3 + g % 8). A null doc_id loops nowhere. Other texts stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = texts(docs).withColumn("words", F.when(h % 10 == 0, words)).withColumn("g", F.floor(h / 10).cast("long"))
    some = some.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    looped = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, get(words, cast(a + (i - a) % p as int)))), ' ')")
    return some.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(looped).alias("text"))


def longest() -> Column:
    """The run of greatest length of ``runs``, the first and then that of the smallest period among equals; null without runs."""
    return F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
