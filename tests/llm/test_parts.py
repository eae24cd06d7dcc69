"""Parts of the operators that need no tables, and those that do not work on documents."""

import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest

from playbill.llm import language, near_dups, packing, top_k, wrappers
from playbill.llm.encoders import byte_bpe, word_bpe


@pytest.mark.parametrize(("make", "name"), [(byte_bpe, "byte_bpe_50k.json"), (word_bpe, "word_bpe_49k.json")])
def test_encoders_give_the_library_s_ids(make, name):
    rng = random.Random(1)
    exact, mine = brute.tokenizer(name), make(public_tokenizers.path(name))
    signs = "abcdeéñß'012 \n\t.,-_|<>ÀZ²İ日"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += [w.removesuffix("</w>") for w in rng.sample(sorted(exact.get_vocab()), 4000)] + ["<|endoftext|>x", "it's I'LL", "a\n  b \n c", "\xa0 \x85 \x1f"]
    want = exact.encode_batch(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, want, strict=True) if mine.encode(t) != brute.le(w.ids)] == []


def best(capacity, items):
    """The least number of bins, by trying everything."""
    found = [len(items)]

    def go(k, bins):
        if len(bins) >= found[0]:
            return
        if k == len(items):
            found[0] = len(bins)
            return
        for room in {b for b in bins if b >= items[k]}:
            at = bins.index(room)
            go(k + 1, [*bins[:at], room - items[k], *bins[at + 1 :]])
        go(k + 1, [*bins, capacity - items[k]])

    go(0, [])
    return found[0]


def test_reduction_keeps_an_optimal_packing_within_reach():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([10, 20, 30])
        items = sorted((max(1, int(capacity * rng.uniform(0.1, 0.8))) for _ in range(rng.randint(1, 9))), reverse=True)
        reduced = packing.Plan(capacity, dict(Counter(items)))
        reduced.reduce()
        rest = sorted((w for w, n in reduced.left.items() for _ in range(n)), reverse=True)
        assert reduced.sequences + (best(capacity, rest) if rest else 0) == best(capacity, items)
        whole = packing.plan(capacity, dict(Counter(items)))
        spans = {}
        for length, _, number, sequence, offset in whole.slots:
            for k in range(number):
                spans.setdefault(sequence + k, []).append((offset, length))
        assert sorted(spans) == list(range(whole.sequences))
        for s in spans.values():
            assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))]
        assert Counter(n for s in spans.values() for _, n in s) == Counter(items)


def test_shards_find_every_link():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 1500).astype(np.uint64)
    near = base[:30].repeat(40) ^ (np.uint64(1) << rng.integers(0, 63, 1200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 1200).astype(np.uint64))
    points = np.unique(np.concatenate([base, near, np.arange(200, dtype=np.uint64)]))
    want = {(int(points[j]), int(p)) for i, p in enumerate(points) for j in np.flatnonzero(np.bitwise_count(points[:i] ^ p) <= 3)}
    for number in (1, 6):
        shards = near_dups.Shards(points[::9], number, 3)
        shards.tasks[:] = 2
        shards.base = np.concatenate([[0], np.cumsum(shards.tasks)])
        index, task, kind = shards.deal(points)
        got = set()
        for t in np.unique(task):
            p, q = (points[index[(task == t) & (kind == k)]] for k in (0, 1))
            near_dups.compare(p, q, 3, lambda a, b: got.update((int(min(x, y)), int(max(x, y))) for x, y in zip(q[a], p[b], strict=True) if x != y))  # noqa: B023
        assert got == want


def test_forests_keep_components():
    a, b = np.array([5, 6, 9, 1, 20]), np.array([6, 7, 7, 2, 21])
    assert sorted(zip(*(x.tolist() for x in near_dups.forest(a, b)), strict=True)) == [(2, 1), (6, 5), (7, 5), (9, 5), (21, 20)]


def brute_top(rows, k=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, []).append([int(np.floor(64 * float(x))) for x in v])
    out = []
    for i in sorted(good):
        if i % 20 == 0:
            scores = {j: max(sum(a * b for a, b in zip(x, y, strict=True)) for x in good[i] for y in good[j] if len(x) == len(y)) for j in good if j != i and any(len(x) == len(y) for x in good[i] for y in good[j])}
            out += [(i, r + 1, j, scores[j]) for r, j in enumerate(sorted(scores, key=lambda j: (-scores[j], j))[:k])]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in np.float32(rng.normal(size=8))]) for k in range(150)]
    rows += [(200, rows[7][1]), (201, rows[7][1]), (220, None), (240, []), (260, [1.0, None] + [0.0] * 6), (280, [float("nan")] * 8), (300, [1.0, 2.0]), (301, [3.0, -1.0]), (None, rows[1][1]), (20, rows[20][1])]
    given = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    got = sorted(tuple(r) for r in top_k.top_k(given).collect())
    assert got == sorted(brute_top(rows))
    assert top_k.top_k(given.filter("vec_id < 0")).count() == 0


def test_top_k_of_large_components():
    rng = np.random.default_rng(4)
    x = rng.integers(-(2**40), 2**40, (6, 50))
    q, v, s = top_k.search((np.array([0]), x[:, :1]), (np.arange(50), x), 5)
    full = (x * x[:, [0]]).sum(axis=0)
    assert v.tolist() == [k for k in np.argsort(-full) if k][:5] and s.tolist() == full[v].tolist()


SPEECH = {"xx": "ka lo mi ren tu sha ve", "yy": "ung ein sch icht ber ver", "zz": "ción mente ado ñar os"}


def test_language(table, spark):
    from samples import prose

    rng = random.Random(8)
    rows = [(k, prose(rng, rng.randint(3, 60), SPEECH[lang]), lang) for k, lang in enumerate(rng.choices(list(SPEECH), k=240))]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 !!", "yy"), (1003, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'a' AS score", "'b' AS lang_pred")
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.identified(docs, model).collect()}
    assert len(got) == len(rows) and model.languages == sorted(SPEECH)
    held = {r["doc_id"] for r in docs.filter(~language.train_fold()).collect()}
    right = [got[d]["lang_pred"] == lang for d, _, lang in rows if d in held and d < 1000]
    assert len(right) > 40 and sum(right) >= 0.95 * len(right)
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1003]["lang_pred"] == rows[0][2]


def test_language_without_labels(table):
    docs = table([(1, "some text"), (2, None)])
    got = language.identified(docs, language.train(docs)).collect()
    assert {r["lang_pred"] for r in got} == {"und"}
    assert language.identified(docs.filter("doc_id > 5"), language.train(docs.filter("doc_id > 5"))).count() == 0


PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a>Home</a></li><li><a>%s</a></li></ul></nav><div class='ad'>Buy %s</div><article><h1>%s</h1>%s</article><footer>&copy; %s</footer></body></html>"


def pages(n):
    return [PAGE % (k, k, f"Title {k} &amp; more", "".join(f"<p>Text  {k}\n{j}<b>x</b>" for j in range(k % 4 + 1)), k) for k in range(n)]


def test_wrappers_find_slots_repeats_and_the_article():
    wrapper = wrappers.infer(pages(6))
    kinds = {n.kind for n in wrapper}
    assert "+" in kinds or any("+" in {p.kind for p in n.parts} for n in wrapper if n.kind == "?")
    assert wrappers.main_path(wrapper) == ["html", "body", "article"]
    assert wrappers.extract(pages(2)[1], ["html", "body", "article"]) == "Title 1 & more\nText 1 0x\nText 1 1x"


def test_pages_without_an_article():
    make = lambda t: f"<body><header>Site</header><div id='menu'>Go</div><div class='post'><h2>{t}</h2><p>One {t}<br>two<ul><li>a<li>b</ul><form>Mail</form></div><div class='comments'><p>Nice</p></div></body>"
    path = wrappers.main_path(wrappers.infer([make("x"), make("yy")]))
    assert wrappers.extract(make("z"), path) == "z\nOne z two\na\nb"


def test_main_texts(spark):
    rows = [(k, f"https://a.example/{k}", p) for k, p in enumerate(pages(30))] + [(50, None, pages(1)[0]), (51, "http://b.example", None), (52, "http://b.example", ""), (53, "http://b.example", "<p>unclosed <b>tag"), (0, "https://a.example/0", pages(1)[0])]
    given = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'p' AS path", "'h' AS host", "'t' AS text").repartition(3)
    got = sorted((r["page_id"], r["text"]) for r in wrappers.main_texts(given).collect())
    want = [(k, brute.article(p)) for k, _, p in rows if k < 51] + [(51, ""), (52, ""), (53, "unclosed tag")]
    assert got == sorted(want)
    assert wrappers.main_texts(given.filter("page_id > 99")).count() == 0
