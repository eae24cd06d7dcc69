"""The operators on documents against their plain versions, on awkward rows, an empty table and repeated rows."""

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from playbill.llm import chunked_bpe, line_dedup, near_dups, packing, sketches, token_counts, token_files

BYTE, WORD, PIECE = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def sketch_columns(docs):
    found = sketches.edited_sketches(docs)
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("sha"), sketches.as_text("hashes").alias("a"), sketches.as_text("edited_hashes").alias("b"),
        sketches.likeness("hashes", "edited_hashes").alias("x"), sketches.likeness("hashes", "next_hashes").alias("y"),
    )


def test_sketches(table, rows):
    assert by_id(sketch_columns(table(rows, clash=True)), "n_chars", "sha", "a", "b", "x", "y") == brute.fingerprints(rows)


def test_sketches_of_one_document_and_of_repeated_rows(table):
    one = by_id(sketch_columns(table([(5, "a b c d e f g h")])), "n_chars", "sha", "a", "b", "x", "y")
    assert one == brute.fingerprints([(5, "a b c d e f g h")])
    twice = sketch_columns(table([(1, "x y z"), (1, "x y z"), (None, "later"), (None, None)])).collect()
    assert len(twice) == 4 and sorted(r["doc_id"] or 0 for r in twice) == [0, 0, 1, 1]


def test_sketches_merge(spark):
    a, b = "a b c d e f g h i j k l m n", "q r s t u v w x y z"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(sketches.sketch("a").alias("a"), sketches.sketch("b").alias("b"))
    got = row.select(sketches.merged("a", "b").alias("m"), sketches.containment("a", sketches.merged("a", "b")).alias("c"), sketches.containment(F.array().cast("array<bigint>"), "a").alias("e")).first()
    both = brute.sketch(a) | brute.sketch(b)
    assert set(got["m"]) == {h for h in both if h < -(2**63) + 2**62} | {min(both)}
    assert 0 < got["c"] <= 1 and got["e"] == 1.0


def test_line_dedup(table, rows):
    got = by_id(line_dedup.dedup_lines(table(rows, clash=True)), "n_lines", "n_dropped", "text", "version")
    assert {d: g[:3] for d, g in got.items()} == brute.kept_lines(rows)
    assert {g[3] for g in got.values()} == {"version"}


def test_line_dedup_of_repeated_rows_and_null_ids(table):
    line = "a line that is long enough to count"
    docs = [(1, f"{line}\nx"), (2, line), (3, f"y\n{line}\n{line}"), (3, line), (None, line)]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(table(docs)).collect())
    assert got == [(0, ""), (1, "x"), (2, ""), (3, line), (3, f"y\n{line}\n{line}")]


def test_long_documents_lose_the_right_lines(table):
    lines = [f"line number {k} of a long document" if k % 3 else f"own {k}" for k in range(700)]
    docs = [(k, "\n".join(lines[k:])) for k in range(4)]
    assert by_id(line_dedup.dedup_lines(table(docs)), "n_lines", "n_dropped", "text") == brute.kept_lines(docs)


def places(packed):
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_sequence)


def test_packing(table, rows):
    got = packing.pack_documents(table(rows, clash=True), BYTE).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == brute.pieces(rows)
    least = -(-sum(r["length"] for r in got) // 2048)
    assert least <= places(got) <= least + 1


def test_packing_repeated_rows(table):
    got = packing.pack_documents(table([(1, "a b c")] * 5 + [(None, None)] * 2), BYTE).collect()
    assert len(got) == 7 and places(got) == 1


def test_round_trip(table, rows):
    got = by_id(chunked_bpe.encoded(table(rows, clash=True), WORD, digests=True), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == brute.round_trip(rows)


def test_shared_chunks_are_cut_alike_and_rows_repeat(table):
    passage = " ".join(f"word{k}" for k in range(3000))
    docs = [(1, passage), (2, "before " + passage), (3, passage + " after" * 50), (3, passage), (4, "é" * 9000), (5, "x" + "é" * 9000), (None, passage), (6, passage), (6, passage)]
    got = chunked_bpe.encoded(table(docs), WORD, digests=True).collect()
    want = sorted((d or 0, *brute.round_trip([(d, t)])[d]) for d, t in docs)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    cut = chunked_bpe.chunk_rows(table(docs[:3])).groupBy("h1", "h2").count()
    assert cut.filter("count = 3").count() > 5


def test_decoding(table):
    ids = chunked_bpe.encoded(table([(1, "Hello, World"), (2, None)]), WORD)
    assert by_id(chunked_bpe.decoded(ids, WORD), "text") == {1: ("hello</w> ,</w> world</w>",), 2: ("",)}


def test_token_files(table, rows, spark, tmp_path):
    token_files.write(table(rows, clash=True), WORD, str(tmp_path / "ids"))
    files = token_files.read(spark, str(tmp_path / "ids"))
    assert by_id(token_files.index(files), "start", "n_tokens", "ids_crc32") == brute.token_files(rows)
    assert files.filter("doc_id = 4").count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4)]" in files.filter("doc_id = 4")._jdf.queryExecution().toString()


def test_token_files_with_repeated_and_null_ids(table, spark, tmp_path):
    token_files.write(table([(2, "b"), (1, "a"), (2, "b"), (None, "c c"), (None, None)]), WORD, str(tmp_path / "ids"))
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in token_files.index(token_files.read(spark, str(tmp_path / "ids"))).collect())
    assert [g[2] for g in got] == [None, None, 1, 2, 2] and [g[0] for g in got] == [0, *[sum(g[1] for g in got[:k]) for k in range(1, 5)]]


def test_token_counts(table, rows):
    got = by_id(token_counts.token_counts(table(rows, clash=True), PIECE), "n_bytes", "n_tokens")
    assert got == {d: v[:2] for d, v in brute.token_counts(rows).items()}
    repeated = [(1, " a  b "), (1, " a  b "), (None, "x")]
    again = token_counts.token_counts(table(repeated), PIECE).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in again) == sorted((d or 0, brute.token_counts([(d, t)])[d][1]) for d, t in repeated)


def test_near_duplicates(table, rows):
    prints = {d: brute.simhash(t or "") for d, t in rows}
    got = near_dups.near_duplicates(table(rows, clash=True))
    assert by_id(got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("h"), "component_id"), "h", "component_id") == {d: (f"{prints[d]:016x}", c) for d, c in brute.groups(prints).items()}


@pytest.mark.parametrize("job", [
    lambda d, s, p: line_dedup.dedup_lines(d), lambda d, s, p: sketch_columns(d), lambda d, s, p: packing.pack_documents(d, BYTE), lambda d, s, p: chunked_bpe.encoded(d, WORD, digests=True),
    lambda d, s, p: token_counts.token_counts(d, PIECE), lambda d, s, p: near_dups.near_duplicates(d), lambda d, s, p: (token_files.write(d, WORD, p), token_files.index(token_files.read(s, p)))[1],
])
def test_an_empty_table_gives_an_empty_result(job, table, spark, tmp_path):
    empty = table([(1, "x")]).filter("doc_id > 1")
    assert job(empty, spark, str(tmp_path / "ids")).count() == 0
