"""Importance resampling of documents towards a target text, by scored arrays and a distributed quickselect.

Each text becomes an array of hashed word-run buckets, written once. The corpus and target counts of the
buckets give each bucket a gain; a document's weight is the sum of gains over its array. A weight and a
keyed Gumbel draw make the score. The k-th best composite key (score descending, doc_id, row) is found by
quickselect: pivots drawn at random among the rows still in question, one aggregation that counts
exactly the rows before, at and after each pivot, and the interval that holds the k-th is kept. Only rows
up to that key are sorted and ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, partitions

BUCKETS = 10_000
SEED = 2024
PIVOTS = 24
#: By byte: A-Z lower-cased, digits, a-z and bytes over 127 as they are, all others a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of text whose words are hashed at a time.
SPAN = 1 << 20


def _spans(data: bytes) -> Iterator[list[bytes]]:
    """The words of folded text in parts that cut none."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SPAN)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def buckets_of(text: bytes | None, runs: int = 1, size: int = BUCKETS) -> np.ndarray:
    """The bucket of each run of 1 to ``runs`` consecutive words, repeats included, and shorter runs first in each part."""
    parts, before = [], []
    for new in _spans((text or b"").translate(FOLD)):
        for n in range(1, runs + 1):
            words = [*before[len(before) - n + 1 :], *new] if n > 1 else new
            parts.append(np.fromiter(map(zlib.crc32, words if n == 1 else map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))), np.uint32))
        before = [*before, *new][-max(1, runs - 1) :]
    return (np.concatenate(parts) % np.uint32(size)).astype(np.int32) if parts else np.zeros(0, np.int32)


def n_words(text: bytes | None) -> int:
    return sum(len(words) for words in _spans((text or b"").translate(FOLD)))


def bucket_arrays(docs: DataFrame, runs: int, size: int) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, held, ids, words, found = 0, 0, b.column(0), [], []
            for k, t in enumerate(b.column(1)):
                text = t.as_py()
                found.append(buckets_of(text, runs, size))
                words.append(len(found[-1]) if runs == 1 else n_words(text))
                held += len(found[-1])
                if held > 1 << 21 or k == b.num_rows - 1:  # texts of any length make batches of bounded size
                    offsets = np.cumsum([0, *map(len, found)])
                    arrays = [ids.slice(at, len(found)), pa.array(words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found)))]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "buckets"])
                    at, held, words, found = k + 1, 0, [], []

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_words long, buckets array<int>")


def bucket_counts(arrays: DataFrame, size: int) -> list[int]:
    """How often each bucket occurs. Every task counts its own rows; the driver gets ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = [0] * size
    for r in arrays.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: list[int], target: list[int]) -> list[int]:
    size = len(corpus)
    s, t = float(sum(corpus) + size), float(sum(target) + size)
    return [math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(corpus, target, strict=True)]


def weigh(arrays: DataFrame, gains: list[int]) -> DataFrame:
    """(doc_id, n_words, buckets) -> (doc_id, n_words, n_features, weight)."""
    shared = arrays.sparkSession.sparkContext.broadcast(np.array(gains, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            lists = b.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[lists.values.to_numpy()[ends[0] : ends[-1]]])])
            ends = ends - ends[0]
            out = [b.column(0), b.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_features", "weight"])

    return arrays.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u keyed by doc_id; a null doc_id is keyed as nothing."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


#: Greater score first, rows without doc_id after the others of their score, smaller ids and rows first.
KEY = ("score", "none", "id", "row")


def _before(a: list[Column], b: list[Column]) -> Column:
    """Whether key a comes before key b."""
    out = a[-1] < b[-1]
    for x, y in zip(reversed(a[1:-1]), reversed(b[1:-1]), strict=True):
        out = (x < y) | ((x == y) & out)
    return (a[0] > b[0]) | ((a[0] == b[0]) & out)


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS) -> list | None:
    """The k-th key (from 1) of keys(score, none, id, row), all distinct, by distributed quickselect; None if k is
    0 or over their number. In each round the driver holds ``pivots`` keys and their counts."""
    cols = [F.col(c) for c in KEY]
    fixed = lambda key: [F.lit(x) for x in key]
    low = high = None  # the keys just before and just after what is in question
    turn = 0
    while k > 0:
        inside = keys
        if low is not None:
            inside = inside.filter(_before(fixed(low), cols))
        if high is not None:
            inside = inside.filter(_before(cols, fixed(high)))
        pivot = [[r[c] for c in KEY] for r in inside.orderBy(F.xxhash64("row", F.lit(turn)), "row").limit(pivots).collect()]
        pivot.sort(key=lambda x: (-x[0], *x[1:]))
        if not pivot:
            return None
        place, same = F.lit(0), F.lit(False)
        for p in pivot:
            place = place + _before(fixed(p), cols).cast("int")
            same = same | ((cols[0] == p[0]) & (cols[-1] == p[-1]))
        counts = {(r["place"], r["same"]): r["count"] for r in inside.select(place.alias("place"), same.alias("same")).groupBy("place", "same").count().collect()}
        seen = 0
        for j, p in enumerate(pivot):  # a key between pivots j - 1 and j is after j of them, and so is pivot j
            between = counts.get((j, False), 0)
            if k <= seen + between:
                low, high = (pivot[j - 1] if j else low), p
                break
            seen += between + counts.get((j, True), 0)
            if k == seen:
                return p
        else:
            low = pivot[-1]
        k -= seen
        turn += 1
    return None


def ranked(winners: DataFrame, scratch: Scratch) -> DataFrame:
    """winners with rank from 1 by key: ranges of keys are sorted apart and counted, one number a range is summed up."""
    order = [F.desc("score"), *KEY[1:]]
    ranges = winners.repartitionByRange(partitions(winners), *order).sortWithinPartitions(*order)
    placed = scratch.save(ranges.withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "winners")
    sizes = placed.groupBy("range").count().withColumn("before", F.sum("count").over(Window.orderBy("range")) - F.col("count"))
    return placed.join(sizes.hint("broadcast"), "range").withColumn("rank", F.col("before") + F.col("place") + 1)  # one row for each range


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, runs: int = 1, size: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_features, weight, score, rank (null if not drawn).

    Of the rows with at least ``least`` words floor(percent * their number / 100) are drawn, those of the
    greatest score, ties to the smaller doc_id. target has column text. Null texts have no words: weight 0, and
    never drawn unless least is 0. A null doc_id is keyed as nothing and comes last among ties; rows that
    repeat a doc_id are each scored, and drawn in an order fixed by one written table. Texts of any length are
    hashed in parts. Other columns are ignored; an empty table gives no rows, and an empty target gives gains
    by the corpus alone.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    arrays = scratch.save(bucket_arrays(rows, runs, size), "arrays")
    goal = bucket_arrays(target.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), runs, size)
    gains = gains_of(bucket_counts(arrays, size), bucket_counts(goal, size))
    scored = weigh(arrays, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    keyed = scored.withColumns({"none": F.col("doc_id").isNull().cast("int"), "id": F.coalesce("doc_id", F.lit(0)), "row": F.monotonically_increasing_id()})
    scored = scratch.save(keyed, "scored")
    scratch.free(arrays)
    able = scored.filter(F.col("n_words") >= least)
    kth = kth_key(able.select(*KEY), able.count() * percent // 100)
    out = ["doc_id", "n_features", "weight", "score"]
    if kth is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least) & ~_before([F.lit(x) for x in kth], [F.col(c) for c in KEY])
    rest = scored.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return rest.union(ranked(scored.filter(drawn), scratch).select(*out, F.col("rank").cast("long")))
