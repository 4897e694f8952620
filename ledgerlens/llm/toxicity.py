"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its words, their stems (the first letters of longer words, so that
forms not seen in training count), word pairs and pairs with one or two words between, hashed to 2^BITS buckets. FTRL-proximal keeps for each coordinate a sum of gradients z
and of their squares n; its learning rate falls with n, and L1 keeps a weight at exactly zero
until |z| passes it. So the model that is broadcast is only the few weights that are not zero.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS = 22
#: Labelled rows that are learned from, those with the least hash of doc_id: the one bound on what the driver holds.
SAMPLE = 8000
EDGE = 0.3
WORD = re.compile(r"[^\W_]+")
SPLIT = re.compile(r"[\W_]")
#: Characters whose words are hashed at a time, so that a very long text needs no more memory than that.
SPAN = 1 << 18
REACH = 3  # words back that a gram can begin
STEMS = range(4, 9)  # letters of a stem


def _mix(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.uint32)


def _pairs(words: np.ndarray, gap: int) -> np.ndarray:
    return _mix(words[: -gap or None] * np.uint64(2 * gap + 1) * np.uint64(0xC2B2AE3D27D4EB4F) + words[gap:]) if len(words) > gap else np.zeros(0, np.uint32)


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Parts of about SPAN characters that cut no word; a word of more than that is one part."""
    cuts = [0]
    while cuts[-1] < len(text):
        end = SPLIT.search(text, min(cuts[-1] + SPAN, len(text)))
        cuts.append(end.start() + 1 if end else len(text))
    return pairwise(cuts)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's grams, repeats included, in parts."""
    text = text.lower()
    before = np.zeros(0, np.uint64)
    for a, b in spans(text):
        found = WORD.findall(text, a, b)
        new = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in found], np.uint64)
        stems = {w[:k] for w in set(found) for k in STEMS if len(w) > k}
        yield _mix(np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in stems], np.uint64) + np.uint64(1 << 41))
        words = np.concatenate([before, new])
        yield _mix(new + np.uint64(1 << 40))
        for gap in range(1, REACH + 1):
            yield _pairs(words[max(0, len(before) - gap) :], gap)
        before = words[-REACH:]


def present(text: str) -> np.ndarray:
    """The distinct buckets, ascending."""
    out = np.zeros(0, np.uint32)
    for part in grams(text):
        out = np.union1d(out, part)
    return out


class Ftrl:
    """Per-coordinate FTRL-proximal over binary features; coordinate 2^BITS is the bias, which L1 leaves alone."""

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 5.0, l2: float = 1.0, bits: int = BITS):
        self.alpha, self.beta, self.l2, self.size = alpha, beta, l2, 1 << bits
        self.l1 = l1
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.size, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, buckets: np.ndarray, label: int) -> None:
        at = np.append(buckets.astype(np.int64), self.size)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Buckets whose weight is not zero, their weights, and the bias."""
        at = np.flatnonzero(np.abs(self.z[: self.size]) > self.l1)
        return at.astype(np.uint32), self.weights(at), float(self.weights(np.array([self.size]))[0])


def train(rows: list[tuple[np.ndarray, int]], epochs: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    model = Ftrl()
    for _ in range(epochs):
        for buckets, label in rows:
            model.learn(buckets, label)
    return model.sparse()


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            found = present(b.column(2)[k].as_py())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(1).slice(k, 1), pa.array([found.tobytes()], pa.binary())], ["doc_id", "label", "buckets"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """docs(doc_id, text), labels(doc_id, label) -> the sparse model. Texts are hashed by the executors;
    the driver gets buckets of at most ``sample`` documents. Of labels that differ the greater holds, of texts
    that share a doc_id the least is read."""
    ready = labels.filter("doc_id is not null and label is not null").filter(~is_held_out(F.col("doc_id")))
    chosen = ready.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    got = texts.select("doc_id", "label", F.coalesce("text", F.lit(""))).mapInArrow(_features, "doc_id long, label int, buckets binary").withColumn("draw", F.xxhash64("doc_id")).collect()
    got.sort(key=lambda r: (r["draw"], r["doc_id"]))
    return train([(np.frombuffer(r["buckets"], np.uint32), int(r["label"] > 0)) for r in got])


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, edge: float = EDGE) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 if score >= edge).

    labels(doc_id, label) with label 1 for toxic; rows whose crc32(doc_id as text) mod 4 is 2 are held out and
    never learned from. Null text counts as empty: it has no features and its score is the bias's. A null
    doc_id is not held out and not learned from; rows that repeat a doc_id are each scored. Without labels
    all scores are 0.5. Texts of any length are hashed in parts. Other columns are ignored; an empty table
    gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    model = docs.sparkSession.sparkContext.broadcast(learn(rows, marks, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight, bias = model.value
        dense = np.zeros(1 << BITS)
        dense[at] = weight
        for b in batches:
            score = []
            for t in b.column(2):
                hits = np.zeros(0, np.uint32)
                for part in grams(t.as_py() or ""):
                    hits = np.union1d(hits, part[dense[part] != 0])
                score.append(float(1 / (1 + np.exp(-np.clip(bias + dense[hits].sum(), -35, 35)))))
            arrays = [b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array([int(s >= edge) for s in score], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
