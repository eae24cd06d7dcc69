"""What bounds memory and time: words that are not kept, rows held a few at a time, candidates, and pages that all count."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playbill.llm import chunked_bpe, encoders, token_files, top_k, wrappers

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_encoding_keeps_no_words():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=9)) + rng.choice(["", ".", ",", "'s", "?!"]) for _ in range(2000)) for _ in range(20)]
    encoder, plain = encoders.WordBpe(WORD), Tokenizer.from_file(WORD)
    encoder.encode(texts[0])
    tracemalloc.start()
    for text in texts:
        encoder.encode(text)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1 << 20
    for text in [texts[1], "a.b, c,, ..", "x\ty  z\n", "O'Neil's 1234 é Ünï don't.", "ß SS ÿ¡ ¿que?", "", " ", "."]:
        assert encoder.encode(text) == encoders.ids_bytes(plain.encode(text, add_special_tokens=False).ids)


def test_rows_are_held_a_few_at_a_time():
    batch = pa.record_batch([pa.array(range(150)), pa.array([[{"a": k}] for k in range(150)])], names=["k", "v"])
    assert list(chunked_bpe._held(batch)) == [(k, [{"a": k}]) for k in range(150)]


def test_files_are_read_once_for_their_index(spark, table, tmp_path):
    token_files.write(table([(k, f"some text {k}") for k in range(20)]), WORD, str(tmp_path / "ids"))
    index = token_files.index(token_files.read(spark, str(tmp_path / "ids")))
    assert "MapInArrow" not in index._jdf.queryExecution().toString()
    assert sum(r["n_tokens"] for r in index.collect()) == max(r["start"] + r["n_tokens"] for r in index.collect())


def test_few_candidates_are_ranked(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(-40, 41, (64, 3000))
    ids, seen, ranked = np.arange(3000), [], top_k._top
    monkeypatch.setattr(top_k, "_top", lambda q, i, s, k: (seen.append(len(i)), ranked(q, i, s, k))[1])
    q, v, s = top_k.search((ids[:150], x[:, :150]), (ids, x), 20)
    full = x[:, :150].T @ x
    for c in range(150):
        want = sorted(((-full[c, j], j) for j in range(3000) if j != c))[:20]
        assert [(-a, b) for a, b in zip(s[q == c], v[q == c], strict=True)] == want
    assert max(seen) < 100


def test_all_pages_of_a_host_count(spark):
    """Eight pages that are first by hash and say the same, and sixty that show where the text lies."""
    post = lambda k: f"<body><div>Site</div><div><section><p>Text {k}</p><p>{f'more {k} ' * 9}</p></section></div></body>"
    bare = lambda k: f"<body><div>Site</div><div><section id='s{k}'><p>Soon</p></section></div></body>"
    made = spark.createDataFrame([(kind(k), kind is bare) for kind in (post, bare) for k in range(400)], "html string, bare boolean")
    ordered = made.orderBy(F.xxhash64("html"), "html").collect()
    last = [n for n, r in enumerate(ordered) if r["bare"]][7]
    html = [r["html"] for n, r in enumerate(ordered) if n <= last and r["bare"]] + [r["html"] for n, r in enumerate(ordered) if n > last and not r["bare"]][:60]
    given = spark.createDataFrame([(k, f"https://a.example/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string").repartition(3)
    assert len(html) == 68
    assert all("Site" not in r["text"] for r in wrappers.main_texts(given).collect())


def test_alignment_of_long_pages_is_linear():
    page = lambda s, n: "<body>" + "".join(f"<div><p>a{j} {s}</p>{'<ul><li>x</ul>' if j * s % 7 == 3 else ''}</div>" for j in range(n)) + "</body>"
    steps = []
    for n in (500, 1000):
        count = [0]
        given = wrappers._flat

        def flat(node, count=count, given=given):
            count[0] += 1
            return given(node)

        wrappers._flat = flat
        try:
            wrappers.infer([page(s, n) for s in (1, 2, 3)])
        finally:
            wrappers._flat = given
        steps.append(count[0])
    assert steps[1] < 2.6 * steps[0]
