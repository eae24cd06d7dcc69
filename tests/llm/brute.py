"""Plain versions of the operators, over rows in memory, that the Spark jobs are held against."""

from __future__ import annotations

import functools
import hashlib
import html
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
import xxhash
from tokenizers import Tokenizer

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tokenizer(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


def le(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def spark_hash(value: int | str, seed: int = 42) -> int:
    data = value.encode() if isinstance(value, str) else (value & (2**64 - 1)).to_bytes(8, "little")
    found = xxhash.xxh64_intdigest(data, seed)
    return found - 2**64 if found >= 2**63 else found


def sketch(text: str, words: int = 5, scale: int = 4) -> set[int]:
    h = [spark_hash(w) for w in WORD.findall(text.translate(LOWER))]
    runs = [h[k : k + words] for k in range(len(h) - words + 1)] or ([h] if h else [])
    found = set()
    for run in runs:
        seed = 42
        for x in run:
            seed = spark_hash(x, seed & (2**64 - 1))
        found.add(seed)
    return {x for x in found if x < -(2**63) + 2**64 // scale} | ({min(found)} if found else set())


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def fingerprints(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    docs = sorted((d, t or "") for d, t in docs)
    out = {}
    for k, (doc, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, other, then = sketch(text), sketch(edited), sketch(after)
        show = lambda s: "".join(f"{x & (2**64 - 1):016x}" for x in sorted(s))
        out[doc] = (len(text), sha(edited), show(own), show(other), jaccard(own, other), jaccard(own, then))
    return out


def pieces(docs: list[tuple[int, str | None]], capacity: int = 2048) -> dict[tuple[int, int], tuple]:
    tok, out = tokenizer("byte_bpe_50k.json"), {}
    for doc, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[doc, k] = (a, b - a, zlib.crc32(le(ids[a:b])))
    return out


def round_trip(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    tok = tokenizer("word_bpe_49k.json")
    found = {d: tok.encode(t or "", add_special_tokens=False).ids for d, t in docs}
    return {d: (len(i), hashlib.sha256(le(i)).hexdigest(), sha(tok.decode(i, skip_special_tokens=False))) for d, i in found.items()}


def token_files(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    tok, out, at = tokenizer("word_bpe_49k.json"), {}, 0
    for doc, text in sorted((d, t or "") for d, t in docs):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        out[doc] = (at, len(ids), zlib.crc32(le(ids)))
        at += len(ids)
    return out


def token_counts(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {d: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t in docs}


def simhash(text: str, words: int = 3) -> int:
    w = WORD.findall(text.translate(LOWER))
    runs = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(prints: dict[int, int], bits: int = 3) -> dict[int, int]:
    """The least id of each id's component."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(values[: a + 1] ^ values[a]) <= bits):
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    return {i: ids[find(k)] for k, i in enumerate(ids)}


def kept_lines(docs: list[tuple[int, str | None]], chars: int = 20, shared: int = 3) -> dict[int, tuple]:
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or len(holders[key(x)]) < shared or max(holders[key(x)]) == doc]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def article(page: str) -> str:
    """The text of the given pages' one article element."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if x)


def spans(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by trying every period."""
    found: dict[tuple[int, int], int] = {}
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            length = end - at + period
            if end > at and length >= max(least, 2 * period):
                found.setdefault((at, length), period)
            at = max(end, at + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def periodic(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    out = {}
    for doc, text in docs:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if doc is not None and h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = spans(words)
        gone = {i for s, length, p in found for i in range(s + p, s + length)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        one = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        out[doc] = (len(found), *one, sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def repaired(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and lines of one conversation's (turn, role, text), in order."""
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "ok" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    first = [r[:1] for _, r, _ in rows]
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(at: int, last: str, room: int) -> tuple[int, str, tuple]:
        """All ways, with at most ``room`` turns inserted here."""
        ways = [(0, "", ())] if at == len(rows) and last in ("", "a") else []

        def way(cost: int, edit: str, line: tuple, *to) -> None:
            c, audit, lines = best(*to)
            ways.append((c + cost, edit + audit, line + lines))

        role = follow[last]
        if room:
            way(2, "I", (f"{name[role]}:",), at, role, room - 1)
        if at < len(rows):
            way(3, "D", (), at + 1, last, 3)
            if kinds[at] in ("ok", "truncated"):
                more, text = int(kinds[at] == "truncated"), rows[at][2]
                if first[at] == role or (first[at] == "s" and not last):
                    way(more, "K", (f"{rows[at][1]}:{text}",), at + 1, first[at], 3)
                way(2 + more, "R", (f"{name[role]}:{text}",), at + 1, role, 3)
        return min(ways, default=(10**9, "", ()))

    for at in reversed(range(len(rows) + 1)):  # from the end, as long conversations go deep
        best(at, "a", 3)
    cost, audit, lines = best(0, "", 3)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False)), cost, audit, lines,
    )


def conversations(rows: list[tuple]) -> dict[int | None, tuple]:
    by: dict[int | None, list] = {r[0]: [] for r in rows}
    for conv, *turn in damaged(rows):
        by[conv].append(tuple(turn))
    found = {c: repaired(sorted(t, key=lambda r: (r[0] is not None, r[0] or 0))) for c, t in by.items()}
    return {c: (*v[:7], sha("\n".join(v[7]))) for c, v in found.items()}


def nearest(ids: np.ndarray, vectors: np.ndarray, every: int = 20, k: int = 20) -> dict[int, list[tuple[int, float]]]:
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        others = np.flatnonzero(ids != ids[i])
        scores = (vectors[others] * vectors[i]).sum(axis=1)
        best = np.lexsort((ids[others], -scores))[:k]
        out[int(ids[i])] = [(int(ids[others][b]), float(scores[b])) for b in best]
    return out
