"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become hashed counts of letter runs of one to three characters. Document frequencies come from all training
documents. The weights are fitted by follow-the-regularised-leader with elastic-net penalties, which leaves most of
them at zero, on a bounded sample of the labelled rows; a part of that sample that the weights have not seen sets
the temperature that makes the scores probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from playbill.llm.tables import map_rows, texts

#: Bits of a feature's number, and the longest n-gram.
FEATURE_BITS, ORDERS = 15, 3
#: Labelled documents that the weights are fitted on: the documented bound of the sample, shared by all languages.
SAMPLE = 4096
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
UNKNOWN = "und"


class _Letters:
    """Which code points are letters; made once per worker, when it is first asked for."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.table[points]


def features(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(feature numbers, counts) of a text; None without letters. Runs of anything else count as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _Letters.of(points)
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    marks = np.concatenate([[32], np.where(letter, points, 32)[keep], [32]]).astype(np.uint32)
    if marks[-2] == 32:
        marks = marks[:-1]
    found, h = [], np.zeros(len(marks), np.uint32)
    for order in range(1, ORDERS + 1):
        h = (h[: len(marks) - order + 1] * np.uint32(0x9E3779B1)) ^ (marks[order - 1 :] * np.uint32(0x85EBCA77) + np.uint32(order))
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
        found.append(mixed >> np.uint32(32 - FEATURE_BITS))
    every = np.concatenate(found)
    if len(every) < 2000:
        return np.unique(every, return_counts=True)
    counts = np.bincount(every, minlength=1 << FEATURE_BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF of length one."""
        x = np.log1p(counts) * self.idf[at]
        return (x / (math.sqrt(float(x @ x)) or 1.0)).astype(np.float32)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text) if text and self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*found) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, p[best]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train_fold(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document may be learned from: the checksum of its id, mod 4, is not 2. A null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 != 2


def statistics(rows: DataFrame) -> tuple[int, np.ndarray]:
    """How many of all texts have letters, and how many hold each feature: summed up per task, then by feature."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << FEATURE_BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = features(text)
                if found is not None:
                    seen[found[0]] += 1
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], names=["feature", "docs"])

    # One row for each feature of the fixed number comes back.
    sums = rows.select("text").mapInArrow(count, "feature long, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).toPandas()
    found = np.zeros(1 << FEATURE_BITS)
    inner = sums["feature"] >= 0
    found[sums["feature"][inner]] = sums["docs"][inner]
    return int(sums["docs"][~inner].sum()), found


def sample(rows: DataFrame, size: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, features, counts) of at most ``size`` rows, as even over languages as there are rows.

    Rows are drawn by a hash of id and text: the same ones whatever the partitioning.
    """
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, size / len(counts) / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") < share * (1 << 30)).orderBy("draw", "doc_id").limit(size)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(lang, f) for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (f := features(text)) is not None]
        columns = [[x[0] for x in found], [x[1][0].astype(np.int32).tobytes() for x in found], [x[1][1].astype(np.int32).tobytes() for x in found]]
        return pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["lang", "at", "counts"])

    got = map_rows(drawn.select("lang", "text"), of, "lang string, at binary, counts binary").collect()
    return [(r["lang"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in got]


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """Weights by FTRL-proximal on four of five rows, the temperature on the fifth."""
    languages = sorted({r[0] for r in rows})
    width = len(languages)
    model = Model(languages, idf, np.zeros((1 << FEATURE_BITS, width), np.float32), np.zeros(width, np.float32))
    if width < 2:
        return model
    target = {lang: k for k, lang in enumerate(languages)}
    data = [(target[lang], at, model.vector(at, n)) for lang, at, n in rows]
    learn, check = [d for k, d in enumerate(data) if k % 5], [d for k, d in enumerate(data) if not k % 5]
    z, n = np.zeros((2, (1 << FEATURE_BITS) + 1, width))
    last = np.array([1 << FEATURE_BITS])  # the bias
    rng = np.random.default_rng(7)

    def weights(at: np.ndarray) -> np.ndarray:
        held = z[at]
        w = -(held - np.sign(held) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(held) > L1, w, 0.0)

    for _ in range(EPOCHS):
        for k in rng.permutation(len(learn)):
            y, at, x = learn[k]
            at, x = np.concatenate([at, last]), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            more = np.sqrt(n[at] + g * g) - np.sqrt(n[at])
            z[at] += g - more / ALPHA * w
            n[at] += g * g
    every = weights(np.arange((1 << FEATURE_BITS) + 1))
    model.weights, model.bias = every[:-1].astype(np.float32), every[-1].astype(np.float32)
    logits = np.array([x @ model.weights[at] + model.bias for _, at, x in check])
    truth = np.array([y for y, _, _ in check])

    def loss(t: float) -> float:
        scaled = logits / t
        top = scaled.max(axis=1)
        return float(np.mean(top + np.log(np.exp(scaled - top[:, None]).sum(axis=1)) - scaled[np.arange(len(truth)), truth]))

    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss)) if len(check) else 1.0
    return model


def train(docs: DataFrame, size: int = SAMPLE) -> Model:
    """A model from the documents of the training fold that have a language."""
    rows = texts(docs, "lang").filter(train_fold() & F.col("lang").isNotNull())
    total, seen = statistics(rows)
    return fit(sample(rows, size), np.log((1 + total) / (1 + seen)) + 1)


def identified(docs: DataFrame, model: Model, *more: str, keep_text: bool = False) -> DataFrame:
    """(lang_pred, score) beside doc_id and the columns ``more``; ``und`` with score 0 without letters or languages.

    With ``keep_text`` the text comes along, null where it was.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by features and languages
    kept = docs.select("doc_id", *more, "text")
    names = kept.columns[:-1]

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column(len(names)).to_pylist()]
        columns = [*batch.columns[: len(names) + keep_text], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        return pa.record_batch(columns, names=[*names, *["text"] * keep_text, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(names) + keep_text])
    return map_rows(kept, of, f"{schema}, lang_pred string, score double")
