"""Document quality from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each whole text. Expectation
maximisation over the counts of all vote patterns (at most 3^labellers of them) estimates, for
either class, how often each labeller votes each way, and the posterior of each pattern. It starts
from the majority of votes and knows no rate beforehand, so a labeller that is no better than
chance loses its say. The posteriors of a bounded sample then train a logistic scorer on hashed
words and character patterns, which decides for every text, also where the labellers abstain.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import Scratch

BUCKETS = 4096  # for character patterns, and as many for words
WORD = 0.3
SAMPLE = 3000
KINDS = np.full(256, 9, np.uint8)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".", ",;:'\"-()?", "!", "|")):
    KINDS[list(_chars.encode())] = _k
for _k, _chars in enumerate(("%#&*$@~^=<>\\{}[]_", "+/`")):
    KINDS[list(_chars.encode())] = 10 + _k
KINDS[128:] = 12
MARKS = frozenset("%#&*$@~^=<>\\{}[]_+`|!")


class Text:
    """Counts that labellers and features share."""

    def __init__(self, text: str | None):
        data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        self.kinds = KINDS[data]
        self.count = np.bincount(self.kinds, minlength=16)
        words = (text or "").split()
        self.n, self.words = len(words), words
        self.repeat = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, self.n - 1)
        self.distinct = len(set(words)) / max(1, self.n)

    def votes(self) -> list[int]:
        """One vote a labeller: 1 good, -1 bad, 0 abstain."""
        c, n, size = self.count, max(1, self.n), max(1, len(self.kinds))
        letters = max(1, int(c[0] + c[1] + c[12]))
        bad = lambda x, edge: -1 if x > edge else 0
        lone = sum(not (w.isalnum() or any(map(str.isalnum, w))) for w in self.words) / n
        edged = sum(w[-1] in MARKS or w[0] in MARKS for w in self.words) / n
        span = size / n
        run = max(sum(1 for _ in same) for _, same in itertools.groupby(self.words)) if self.repeat * n > 2 else 0
        pairs = len(set(itertools.pairwise(self.words))) / max(1, self.n - 1)
        return [
            bad(c[1] / letters, 0.4),
            bad(c[7] / n, 0.25),
            bad(c[8] / n, 0.15),
            bad(c[10] / size, 0.05),
            bad(self.repeat, 0.2) if self.n > 4 else 0,
            bad(0.25, self.distinct) if self.n > 40 else 0,
            bad(0.4, int(c[0] + c[12]) / size),
            0 if self.n else -1,
            bad(lone, 0.08),
            bad(edged, 0.15),
            bad(abs(span - 8), 6),
            int(0.02 < c[5] / n < 0.3 and pairs > 0.8) if self.n > 20 else 0,
            bad(run, 3),
            bad(0.55, pairs) if self.n > 20 else 0,
        ]

    def features(self) -> np.ndarray:
        """Hashed words, at WORD of unit length, after hashed 4-grams of character kinds, of unit length, and the text's rates."""
        out = np.zeros(BUCKETS, np.float32)
        said = np.bincount([zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS for w in self.words], minlength=BUCKETS) if self.n else out
        k = self.kinds.astype(np.uint32)
        if len(k) > 3:
            code = (k[:-3] << 12) | (k[1:-2] << 8) | (k[2:-1] << 4) | k[3:]
            out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
            out = np.sqrt(out / len(code))
        for i, x in enumerate((self.repeat, self.distinct, self.count[1] / max(1, len(k)), self.count[10] / max(1, len(k)))):
            for j, edge in enumerate((0.02, 0.1, 0.3, 0.6)):
                out[(i * 977 + j * 131 + 7) % BUCKETS] += 0.5 * (x > edge)
        return np.concatenate([out, (WORD * np.sqrt(said / max(1, self.n))).astype(np.float32)])


def estimate(patterns: dict[str, int], rounds: int = 300) -> tuple[dict[str, float], np.ndarray]:
    """(posterior of good for each vote pattern such as '+0-', how often each labeller votes bad, abstains
    and votes good on bad and on good documents), by expectation maximisation."""
    if not patterns:
        return {}, np.zeros((0, 2, 3))
    names = sorted(patterns)
    weight = np.array([patterns[p] for p in names], float)
    vote = np.array([["-0+".index(c) for c in p] for p in names])
    good = 1 / (1 + np.exp(-((vote == 2).sum(1) - (vote == 0).sum(1)).astype(float)))
    for _ in range(rounds):
        prior = (good @ weight + 1) / (weight.sum() + 2)
        score = np.full(len(names), np.log(prior / (1 - prior)))
        rates = np.ones((vote.shape[1], 2, 3))
        for j, table in enumerate(rates):
            np.add.at(table[1], vote[:, j], good * weight)
            np.add.at(table[0], vote[:, j], (1 - good) * weight)
            table /= table.sum(1, keepdims=True)
            score += np.log(table[1] / table[0])[vote[:, j]]
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        moved = np.abs(new - good).max()
        good = new
        if moved < 1e-6:
            break
    return dict(zip(names, good.tolist(), strict=True)), rates


def train(x: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on soft labels, classes weighted alike."""
    w, b = np.zeros(x.shape[1]), 0.0
    x = np.ascontiguousarray(x, np.float32)  # not copied where it is so already
    share = np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98)
    weight = y * 0.5 / share + (1 - y) * 0.5 / (1 - share)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1 if len(y) else 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        d = weight * (p - y) / len(y)
        g = np.append(d.astype(np.float32) @ x + 1e-4 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pattern = ["".join("-0+"[v + 1] for v in Text(t.as_py()).votes()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pattern, pa.string())], ["doc_id", "pattern"])


def score_quality(docs: DataFrame, columns: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """Per row: the given columns of docs, doc_id, pattern, posterior (of its votes), score, keep.

    score is the scorer's probability of good and keep is score >= 0.5. Null, empty or blank text
    is scored 0. The scorer is trained on at most ``sample`` rows, those with the least hash of
    doc_id; the labellers' accuracies come from all rows. Repeated rows are each scored; columns
    named like a result are not passed on; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    made = ("pattern", "posterior", "score", "keep", "text", "doc_id")
    extra = [c for c in columns if c not in made]
    rows = docs.select(*extra, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    votes = scratch.save(rows.select("doc_id", "text").mapInArrow(_votes, "doc_id long, pattern string"), "votes")
    posterior, _ = estimate({r["pattern"]: r["count"] for r in votes.groupBy("pattern").count().collect()})
    ids = [r[0] for r in votes.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    picked = rows.filter(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min("text").alias("text")).select("text")
    key = lambda t: "".join("-0+"[v + 1] for v in t.votes())
    x, y = np.zeros((len(ids), 2 * BUCKETS), np.float32), np.zeros(len(ids))
    n = 0
    for r in picked.toLocalIterator() if ids else ():  # one row of features at a time; the texts are not kept
        text = Text(r[0])
        x[n], y[n] = text.features(), posterior.get(key(text), 0.5)
        n += 1
    model = spark.sparkContext.broadcast((*train(x[:n], y[:n]), posterior))
    del x
    schema = StructType(list(rows.schema.fields))
    for name, kind in (("pattern", "string"), ("posterior", "double"), ("score", "double"), ("keep", "boolean")):
        schema = schema.add(name, kind)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, known = model.value
        for b in batches:
            pattern, score = [], []
            for t in b.column(len(extra) + 1):
                text = Text(t.as_py())
                pattern.append(key(text))
                score.append(float(1 / (1 + np.exp(-np.clip(text.features() @ w + bias, -30, 30)))) if text.n else 0.0)
            arrays = [pa.array(pattern, pa.string()), pa.array([known.get(p, 0.5) for p in pattern], pa.float64()), pa.array(score, pa.float64()), pa.array([s >= 0.5 for s in score], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names)

    return rows.mapInArrow(run, schema)
