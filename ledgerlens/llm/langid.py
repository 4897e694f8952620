"""Language identification by prediction by partial matching.

For each language a variable-order tree of byte contexts (orders ORDER down to 0) holds symbol
counts. A text's code length under a language is the sum over its bytes of -log2 of the symbol's
probability in the longest context seen in training, with escape method C: in a context with n
symbols of d kinds an escape costs -log2(d / (n + d)) and a known symbol -log2(count / (n + d));
below order 0 every byte costs 8 bits. Counts are frozen: scoring changes nothing. The shortest
code wins.

The trees are kept flat, as sorted arrays of context-and-symbol codes with one cost for each
language, so a batch of texts is scored by array look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


ORDER = 3


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """Code of the symbol at each place and its `order` bytes of context; data starts with ORDER zero bytes."""
    code = np.zeros(len(data) - ORDER, np.uint32)
    for k in range(order, -1, -1):
        code = (code << np.uint32(8)) | data[ORDER - k : len(data) - k]
    return code


class Model:
    """Frozen statistics of all languages."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        counts = [[] for _ in range(ORDER + 1)]
        for lang in self.langs:
            per = [[] for _ in range(ORDER + 1)]
            for t in texts[lang]:
                data = np.frombuffer(bytes(ORDER) + t.encode("utf-8", "replace"), np.uint8)
                for k in range(ORDER + 1):
                    per[k].append(_codes(data, k))
            for k in range(ORDER + 1):
                counts[k].append(np.unique(np.concatenate(per[k]) if per[k] else np.zeros(0, np.uint32), return_counts=True))
        self.keys, self.costs, self.contexts, self.escapes = [], [], [], []
        n = len(self.langs)
        for k in range(ORDER + 1):
            keys = np.unique(np.concatenate([u for u, _ in counts[k]])) if n else np.zeros(0, np.uint32)
            ctx = np.unique(keys >> np.uint32(8))
            cost, esc = np.full((len(keys), n), np.nan, np.float32), np.zeros((len(ctx), n), np.float32)
            for j, (u, c) in enumerate(counts[k]):
                at = np.searchsorted(ctx, u >> np.uint32(8))
                total, kinds = np.bincount(at, c, len(ctx)), np.bincount(at, minlength=len(ctx))
                with np.errstate(divide="ignore", invalid="ignore"):
                    esc[:, j] = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
                cost[np.searchsorted(keys, u), j] = -np.log2(c / (total + kinds)[at])
            self.keys.append(keys), self.costs.append(cost), self.contexts.append(ctx), self.escapes.append(esc)
        for k in range(1, ORDER + 1):  # a symbol that a language lacks in this context: escape, then the shorter context
            keys = self.keys[k]
            lower = self._cost(k - 1, keys & np.uint32((1 << 8 * k) - 1))
            esc = self.escapes[k][np.searchsorted(self.contexts[k], keys >> np.uint32(8))]
            self.costs[k] = np.where(np.isnan(self.costs[k]), esc + lower, self.costs[k])
        if n:
            self.costs[0] = np.where(np.isnan(self.costs[0]), self.escapes[0][np.zeros(len(self.keys[0]), int)] + 8, self.costs[0])

    def _cost(self, k: int, codes: np.ndarray) -> np.ndarray:
        """Bits of each coded symbol under each language, from order k down."""
        keys = self.keys[k]
        at = np.minimum(np.searchsorted(keys, codes), max(0, len(keys) - 1))
        found = keys[at] == codes
        out = self.costs[k][at]
        if k == 0 and np.isnan(out).any():
            out = np.where(np.isnan(out), self.escapes[0][0] + 8, out)
        if not found.all():
            miss = codes[~found]
            ctx = self.contexts[k]
            c = np.minimum(np.searchsorted(ctx, miss >> np.uint32(8)), len(ctx) - 1)
            esc = np.where((ctx[c] == miss >> np.uint32(8))[:, None], self.escapes[k][c], 0)
            out[~found] = esc + (8 if k == 0 else self._cost(k - 1, miss & np.uint32((1 << 8 * k) - 1)))
        return out

    def bits(self, text: str) -> np.ndarray:
        """Exact code length of the whole text under each language."""
        data = np.frombuffer(bytes(ORDER) + text.encode("utf-8", "replace"), np.uint8)
        total = np.zeros(len(self.langs))
        for at in range(0, len(data) - ORDER, 1 << 16):
            codes, times = np.unique(_codes(data[at : at + (1 << 16) + ORDER], ORDER), return_counts=True)
            total += times @ self._cost(ORDER, codes).astype(np.float64)
        return total

    def predict(self, text: str | None, has_letter: bool) -> tuple[str, float]:
        if not has_letter or not self.langs:
            return "und", 0.0
        bits = self.bits(text)
        best = int(np.argmin(bits))
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def fit(labelled: DataFrame, per_lang: int = 300) -> Model:
    """labelled(doc_id, text, lang). Learns from at most ``per_lang`` rows of each language, those
    with the least hash of doc_id; the bound keeps the trees small, whatever the corpus size."""
    least = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = [r[0] for r in labelled.select("lang", "doc_id").withColumn("k", F.row_number().over(least)).filter(F.col("k") <= per_lang).select("doc_id").distinct().collect()]
    rows = labelled.filter(F.col("doc_id").isin(ids)).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect() if ids else []
    langs = sorted({r["lang"] for r in rows})
    texts = {lang: [r["text"] for r in rows if r["lang"] == lang] for lang in langs}
    return Model(texts)


def identify(docs: DataFrame, per_lang: int = 300) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Learns from rows with non-null text, doc_id and lang whose crc32(doc_id) mod 4 is not 2.
    A null text, or one without a letter, is ``und`` with score 0, as is every text when nothing
    could be learned. Ties go to the language first in order. Repeated rows are each predicted;
    a null doc_id is not held out and not learned from. Other columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held.alias("held_out"))
    ready = rows.filter("not held_out and text is not null and lang is not null and doc_id is not null")
    model = docs.sparkSession.sparkContext.broadcast(fit(ready, per_lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.value.predict(t.as_py(), h.as_py()) for t, h in zip(b.column(2), b.column(3), strict=True)]
            arrays = [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )
