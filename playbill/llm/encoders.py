"""Fast, exact encoders for two kinds of public BPE vocabularies.

Both give the ids that the ``tokenizers`` library gives for the same file. Their speed comes from ``tiktoken``, with merge
ranks read from the same file, and for byte-level vocabularies from a cache of encoded words.
What that path does not cover with certainty (special strings, characters whose Unicode class or case may
differ between libraries, control characters) is encoded by ``tokenizers`` itself, text by text.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Words of one generation of a cache; there are two, so a worker's memory stays bounded and frequent words stay.
CACHE_WORDS = 400_000
#: Latin letters and their marks have the same classes and lower cases everywhere.
UNSURE = re.compile(r"[^\t\n\r\x20-\x7e\xa1-įı-ɏ]|<\|")
END = "</w>"


def ids_bytes(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Words(dict):
    """Encoded words; a word not seen yet is encoded when it is asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.encode(word)
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


def sure(text: str) -> bool:
    """Whether the fast path covers a text."""
    try:
        text.encode("latin-1")
        if "<|" not in text and text.replace("\n", " ").isprintable():
            return True
    except UnicodeEncodeError:
        pass
    return not UNSURE.search(text)


class ByteBpe:
    """Byte-level BPE with spaces kept (``byte_bpe_*``)."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        to_byte = byte_of()
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in token): k for token, k in model["model"]["vocab"].items() if token not in special}
        # The fixed pattern of this pre-tokenizer.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.words = _Words(lambda word: ids_bytes(self.fast.encode_ordinary(word)))
        self.mixed_space = re.compile(r"\s ")

    def encode(self, text: str) -> bytes:
        if not sure(text):
            return ids_bytes(self.exact.encode(text, add_special_tokens=False).ids)
        if self.mixed_space.search(text):
            return ids_bytes(self.fast.encode_ordinary(text))
        # A space after anything but white space always starts a word.
        return b"".join(map(self.words.__getitem__, text.replace(" ", "\0 ").split("\0"))) if text else b""


class WordBpe:
    """Lower-casing BPE with word ends and without white space (``word_bpe_*``)."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        to_byte, vocab = byte_of(), model["model"]["vocab"]
        # tiktoken knows no word end, so a zero byte stands for it. Its merge with the last byte comes first.
        end = "\0"
        of_byte = {b: c for c, b in to_byte.items()}
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(1, 256)}
        id_of = {b: vocab[of_byte[b]] for b in range(256)} | {256 + b: vocab[of_byte[b] + END] for b in range(1, 256)}
        for k, pair in enumerate(model["model"]["merges"]):
            token = "".join(pair) if isinstance(pair, list) else pair.replace(" ", "")
            stem = token.removesuffix(END)
            ranks[bytes(to_byte[c] for c in stem) + (b"\0" if stem != token else b"")] = 512 + k
            id_of[512 + k] = vocab[token]
        self.id_of = np.zeros(max(id_of) + 1, "<u4")
        self.id_of[list(id_of)] = list(id_of.values())
        # The fixed pattern of this pre-tokenizer.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.fast = tiktoken.Encoding("word-bpe", pat_str=rf"[^{end}]+{end}", mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.tokens = {k: t for t, k in self.exact.get_vocab(with_added_tokens=True).items()}

    def encode(self, text: str) -> bytes:
        """All words at once; most are letters with or without a stop."""
        if not sure(text):
            return ids_bytes(self.exact.encode(text, add_special_tokens=False).ids)
        parts = [w if w.isalpha() else f"{w[:-1]}\0{w[-1]}" if w[-1] in ".," and w[:-1].isalpha() else "\0".join(self.pattern.findall(w)) for w in text.lower().split()]
        return self.id_of[self.fast.encode_ordinary("\0".join([*parts, ""]))].tobytes() if parts else b""

    def decode(self, ids: bytes) -> str:
        """The file names no decoder, so the library joins tokens with spaces."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


@cache
def byte_bpe(path: str) -> ByteBpe:
    """One encoder per worker process and file."""
    return ByteBpe(path)


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
