"""BPE encoding and decoding that encodes shared chunks once.

Texts are cut where a rolling hash of the last 32 bytes says so, hence at the same places wherever a passage occurs.
A chunk that occurs more than once is encoded by one of its documents and lent to the others; the rest is encoded
where it is. Words may be cut in two, so a chunk's ids are only kept between its first and its last space, where
no token can reach across; what lies around a join is encoded again as one piece, over as many chunks as it takes
to find a space on either side. The ids are then exactly those of the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from playbill.llm.encoders import word_bpe
from playbill.llm.tables import map_rows, texts
from playbill.session import materialise

#: A hash in so many ends a chunk, but none ends one of fewer bytes.
MEAN, LEAST = 1024, 256
WINDOW = 32
#: Documents that one copy of a shared chunk serves, about.
BORROWERS = 1000
#: Rows that are Python objects at once: what a text has borrowed or lends may be many times its own size.
HELD = 64
NO_ID = -(2**63)
GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=4).digest() for b in range(256)), "<u4")


def cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of chunks in a text's bytes, the text's end last."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:  # sums over windows of twice the size, each byte's number moved up by its distance
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint32(step)
        h, step = wider, 2 * step
    ends = np.flatnonzero(h < np.uint32(2**32 // MEAN)) + 1
    ends = ends[(ends >= WINDOW) & (ends < len(data))]
    ends = ends[(data[ends] & 0xC0) != 0x80]  # not within a character
    kept, last = [], 0
    at = np.searchsorted(ends, LEAST)
    while at < len(ends):
        last = int(ends[at])
        kept.append(last)
        at = np.searchsorted(ends, last + LEAST)
    return np.array([*kept, len(data)] if len(data) else [], np.int64)


def chunks(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of each chunk; an empty text has none."""
    ends = cut_points(np.frombuffer(data, np.uint8)).tolist()
    return list(zip([0, *ends], ends, strict=False))


def split(chunk: str) -> tuple[str, str, str] | None:
    """What lies before the first space, up to the last, and after; None without a space."""
    first = min((k for k in (chunk.find(" "), chunk.find("\n")) if k >= 0), default=-1)
    if first < 0:
        return None
    last = max(chunk.rfind(" "), chunk.rfind("\n"))
    return chunk[:first], chunk[first:last], chunk[last:]


def _packed(docs: DataFrame) -> DataFrame:
    """(key, version, data): texts compressed, as they are going to be shuffled."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        compress = zstandard.ZstdCompressor(level=1).compress
        data = [compress(t.encode()) for t in batch.column(2).to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["key", "version", "data"])

    return map_rows(_keyed(docs), pack, "key long, version long, data binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("version"), "text")


def _held(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, few of them as Python objects at a time."""
    for at in range(0, batch.num_rows, HELD):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, HELD).columns), strict=True)


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(key, version, pos, h1, h2, start, size) of every chunk of every row."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, hashes = [], []
        for key, version, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode()
            for pos, (a, b) in enumerate(chunks(data)):
                rows.append((key, version, pos, a, b - a))
                hashes.append(hashlib.blake2b(data[a:b], digest_size=16).digest())
        table = np.array(rows, np.int64).reshape(-1, 5)
        h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(c) for c in (table[:, 0], table[:, 1], table[:, 2].astype(np.int32), h[:, 0], h[:, 1], table[:, 3], table[:, 4])], names=["key", "version", "pos", "h1", "h2", "start", "size"])

    return map_rows(_keyed(docs), cut, "key long, version long, pos int, h1 long, h2 long, start long, size long")


def shared_chunks(cuts: DataFrame) -> DataFrame:
    """(h1, h2, n, at) of every chunk that occurs more than once: how often, and the least place it has."""
    place = F.struct("key", "version", "start", "size")
    return cuts.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("at")).filter("n > 1")


def _copies(n: str) -> Column:
    """Of how many copies of a loan each serves at most about :data:`BORROWERS`."""
    return F.ceil(F.col(n) / BORROWERS).cast("int")


def lent(packed: DataFrame, shared: DataFrame, tokenizer: str) -> DataFrame:
    """(h1, h2, copy, head, ids, tail) of every shared chunk, encoded by the least of its documents."""
    chunk = F.struct("h1", "h2", "n", F.col("at.start").alias("start"), F.col("at.size").alias("size"))
    owned = shared.groupBy("at.key", "at.version").agg(F.collect_list(chunk).alias("owned"))
    owners = packed.join(owned, ["key", "version"]).select("data", "owned")

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, unpack, pack = word_bpe(tokenizer).encode, zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        found: dict[tuple[int, int], tuple] = {}
        for data, owned in _held(batch):
            text = unpack(data)
            for c in owned:
                chunk = text[c["start"] : c["start"] + c["size"]].decode()
                head, middle, tail = split(chunk) or (chunk, None, "")
                found[c["h1"], c["h2"]] = (c["n"], head, None if middle is None else pack(of(middle)), tail)
        columns = [[k[0] for k in found], [k[1] for k in found], *([v[i] for v in found.values()] for i in range(4))]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["h1", "h2", "n", "head", "ids", "tail"])

    made = map_rows(owners, encode, "h1 long, h2 long, n long, head string, ids binary, tail string")
    copied = made.select("h1", "h2", F.explode(F.sequence(F.lit(0), _copies("n") - 1)).alias("copy"), "head", "ids", "tail")
    # Rows that repeat a document would lend its chunks twice.
    return copied.dropDuplicates(["h1", "h2", "copy"])


def encoded(docs: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row's whole text, ids as little-endian unsigned 32-bit integers.

    With ``digests``: SHA-256 of the ids and of the decoded text instead (ids_sha256, decoded_sha256). A null text is
    empty; rows may repeat.
    """
    # The filter is one that a join adds on one side; with it both joins read the same exchange of texts.
    packed = _packed(docs).filter("key IS NOT NULL AND version IS NOT NULL")
    cuts = materialise(chunk_rows(docs))
    # Both are tables, so that a frequent chunk's partition can be split where it meets its count.
    shared = materialise(shared_chunks(cuts))
    asks = cuts.select("h1", "h2", "key", "version", "pos").join(shared.select("h1", "h2", "n"), ["h1", "h2"])
    asks = asks.withColumn("copy", F.pmod(F.xxhash64("key", "version"), _copies("n")).cast("int")).drop("n")
    loans = asks.join(lent(packed, shared, tokenizer), ["h1", "h2", "copy"])
    # A row that repeats asks twice for the same.
    borrowed = loans.groupBy("key", "version").agg(F.collect_set(F.struct("pos", "head", "ids", "tail")).alias("loans"))
    joined = packed.join(borrowed, ["key", "version"], "left").select("key", "data", "loans")

    def stitch(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, unpack = word_bpe(tokenizer), zstandard.ZstdDecompressor().decompress
        of = bpe.encode
        rows = []
        for key, data, loans in _held(batch):
            text = unpack(data)
            if loans:
                known = {x["pos"]: x for x in loans}
                ids, open_ = [], ""
                for pos, (a, b) in enumerate(chunks(text)):
                    loan = known.get(pos)
                    if loan is None:
                        open_ += text[a:b].decode()
                    elif loan["ids"] is None:
                        open_ += loan["head"]
                    else:
                        ids += of(open_ + loan["head"]), unpack(loan["ids"])
                        open_ = loan["tail"]
                found = b"".join([*ids, of(open_)])
            else:
                found = of(text.decode())
            kept = (hashlib.sha256(found).hexdigest(), hashlib.sha256(bpe.decode(found).encode()).hexdigest()) if digests else (found,)
            rows.append((None if key == NO_ID else key, len(found) // 4, *kept))
        kinds = [pa.int64(), pa.int64(), *([pa.string()] * 2 if digests else [pa.binary()])]
        names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids"])]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_rows(joined, stitch, "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary"))


def decoded(ids: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of rows with ``ids`` as :func:`encoded` gives them; null ids decode to the empty text."""

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = word_bpe(tokenizer).decode
        return pa.record_batch([batch.column(0), pa.array([of(b or b"") for b in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_rows(ids.select("doc_id", "ids"), decode, "doc_id long, text string")
