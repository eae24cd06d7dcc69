"""Token counts from distinct pre-tokens, without ids.

The vocabulary's pieces hold a space only at their start, so a text's pieces are those of its pre-tokens, each a
run of spaces with what follows. Documents are taken in blocks. A block lists its distinct pre-tokens once, and
each document's frequencies as numbers into that list. The lists of all blocks meet by pre-token, where each
distinct one is counted once; the counts go back to their blocks, and a document's tokens are the sum of
frequency times count. A word that every document holds costs one row for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, functions as F

from playbill.llm.tables import partitions, texts
from playbill.session import materialise

#: Characters of text in a block, if no single document has more.
BLOCK_CHARS = 1 << 24
SPACE, MARK = " ", "▁"
RUNS = re.compile(" +[^ ]*")
IRREGULAR = re.compile("^ |  | $")


@cache
def model(path: str) -> sentencepiece.SentencePieceProcessor:
    found = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = [p for p in map(found.id_to_piece, range(found.get_piece_size())) if MARK in p.lstrip(MARK)]
    if inner or found.encode("a  b", out_type=str) != [MARK + "a", MARK, MARK + "b"]:
        raise ValueError("this model's pieces reach across spaces, or it changes them")
    return found


def pre_tokens(text: str) -> list[str]:
    """A text's pre-tokens, each without its first space; the model puts one before a text itself."""
    text = text.replace(MARK, SPACE)
    if not text:
        return []
    if not IRREGULAR.search(text):
        return text.split(SPACE)
    return [run[1:] for run in RUNS.findall(SPACE + text)]


def _packed(values: np.ndarray) -> bytes:
    """Compressed byte by byte: first the lowest bytes of all values, last the highest, which are mostly zero."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def blocks(docs: DataFrame) -> DataFrame:
    """(block, words, doc, ...): a block's distinct pre-tokens, and its documents with their frequencies.

    Packed are doc_id, n_bytes and the number of distinct pre-tokens of each document, then the steps between their
    places in ``words``, which ascend, and their frequencies. Null ids are marked.
    """
    names = ["doc", "null", "bytes", "n", "at", "times"]

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = 0, None
        places: dict[str, int] = {}
        held: dict[str, list] = {name: [] for name in names}
        chars = 0

        def emit() -> pa.RecordBatch:
            nonlocal number, chars
            data = [_packed(np.array(held[name], np.int64)) for name in names[:4]] + [_packed(np.concatenate(held[name]).astype(np.int32)) for name in names[4:]]
            row = pa.record_batch([pa.array([part * (1 << 32) + number], pa.int64()), pa.array([list(places)], pa.list_(pa.string())), *(pa.array([d], pa.binary()) for d in data)], names=["block", "words", *names])
            number, chars = number + 1, 0
            places.clear()
            for v in held.values():
                v.clear()
            return row

        for batch in batches:
            for doc, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = own if part is None else part
                words = pre_tokens(text)
                index = np.array([places.setdefault(w, len(places)) for w in words], np.int64)
                at, times = np.unique(index, return_counts=True)
                steps = np.diff(at, prepend=0)
                for name, value in zip(names, (doc or 0, doc is None, len(text.encode()), len(at), steps, times), strict=True):
                    held[name].append(value)
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield emit()
        if held["n"]:
            yield emit()

    given = texts(docs).withColumn("part", F.spark_partition_id().cast("long"))
    return given.mapInArrow(build, "block long, words array<string>, doc binary, null binary, bytes binary, n binary, at binary, times binary")


def count_pieces(words: DataFrame, path: str) -> DataFrame:
    """(block, places, pieces): the counts for rows (block, place, word), packed by block.

    Rows of a word lie together, so each distinct word is counted once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model(path).encode
        last, count = None, 0
        for batch in batches:
            column = batch.column(2).dictionary_encode()
            # Sorted rows: the dictionary's order is that of the words.
            distinct = column.dictionary.to_pylist()
            found = np.array([len(p) or 1 for p in encode(distinct, num_threads=1)], np.int32)
            if distinct and distinct[0] == last:
                found[0] = count
            last, count = distinct[-1], found[-1]
            pieces = found[column.indices.to_numpy()]
            block, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            groups = np.split(order, cuts)
            rows = [[int(block[g[0]]) for g in groups], [_packed(place[g].astype(np.int32)) for g in groups], [_packed(pieces[g]) for g in groups]]
            yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=["block", "places", "pieces"])

    spark = words.sparkSession
    dealt = words.select("block", "place", "word").repartition(partitions(spark), "word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "block long, places binary, pieces binary")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; a null text is empty, and an empty one has no tokens."""
    spark = docs.sparkSession
    codec = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    made = materialise(blocks(docs))
    spark.conf.set("spark.sql.parquet.compression.codec", codec)
    words = made.select("block", F.posexplode("words").alias("place", "word"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(1 << 18))
    counted = materialise(count_pieces(words, path))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def add_up(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        size = 1 + max((int(_unpacked(p.as_py(), "i4").max(initial=0)) for p in right["places"]), default=0)
        pieces = np.zeros(size, np.int64)
        for places, counts in zip(right["places"], right["pieces"], strict=True):
            pieces[_unpacked(places.as_py(), "i4")] = _unpacked(counts.as_py(), "i4")
        columns = []
        for row in left.to_pylist():
            doc, null, n_bytes, n = (_unpacked(row[name], "i8") for name in ("doc", "null", "bytes", "n"))
            steps, times = (_unpacked(row[name], "i4") for name in ("at", "times"))
            ends = np.cumsum(n)
            places = np.cumsum(steps, dtype=np.int64)
            places -= np.repeat(np.append(0, places)[ends - n], n)  # steps start anew in each document
            total = np.concatenate([[0], np.cumsum(pieces[places] * times)])
            columns.append((pa.array(doc, mask=null.astype(bool)), pa.array(n_bytes), pa.array(total[ends] - total[ends - n])))
        return pa.table([pa.chunked_array(c, pa.int64()) for c in zip(*columns, strict=True)] if columns else [pa.array([], pa.int64())] * 3, names=["doc_id", "n_bytes", "n_tokens"])

    sides = made.drop("words").groupBy("block").cogroup(counted.groupBy("block"))
    return sides.applyInArrow(add_up, "doc_id long, n_bytes long, n_tokens long")
