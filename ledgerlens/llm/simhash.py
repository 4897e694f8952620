"""SimHash near-duplicate groups by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints at distance 2 or less
either agree to within one bit on the low segment or agree exactly on the high one, so a ball
of radius 1 is enumerated in the low segment and of radius 0 in the high one; every probe is
looked up in the segment table and the whole distance of each match is verified.

A segment bucket with more than ``cap`` distinct fingerprints is not paired. All fingerprints
that probe such a bucket are linked by the exact midpoint rule instead: two of them are at
distance 2 or less if and only if some 64-bit value lies within one bit of both. Each emits its
65 such values; a value has at most 65 owners, so groups stay bounded and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch
from .components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LOW32 = 0xFFFFFFFF


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the whole text; 0 where it has no word."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        hashes = [digest(join(words), 42)]
    else:
        hashes = [digest(join(words[i : i + shingle]), 42) for i in range(len(words) - shingle + 1)]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = np.ascontiguousarray(h[at : at + 65536]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segments(fps: DataFrame, balls: tuple[list[int], list[int]]) -> DataFrame:
    """A row (seg, key, fp) for each value of each segment's ball."""
    def ball(seg: int, value: Column, masks: list[int]) -> Column:
        return F.array(*[F.struct(F.lit(seg).alias("seg"), value.bitwiseXOR(F.lit(m).cast("long")).alias("key")) for m in masks])

    low, high = F.col("fp").bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned("fp", 32)
    parts = [ball(0, low, balls[0]), ball(1, high, balls[1])]
    return fps.select("fp", F.explode(F.concat(*parts)).alias("x")).select("x.seg", "x.key", "fp")


def links(fps: DataFrame, scratch: Scratch, cap: int = 64) -> DataFrame:
    """fps: distinct fp. Edges (a, b), a < b, whose components equal those of all pairs within 2 bits."""
    ball1 = [0] + [1 << i for i in range(32)]
    homes = _segments(fps, ([0], [0]))
    probes = _segments(fps, (ball1, [0]))
    hot = scratch.save(homes.groupBy("seg", "key").count().filter(F.col("count") > cap).select("seg", "key"), "hot")
    any_hot = not hot.isEmpty()
    cold = homes.join(hot, ["seg", "key"], "left_anti") if any_hot else homes
    pairs = (
        probes.join(cold.select("seg", "key", F.col("fp").alias("other")).hint("merge"), ["seg", "key"])
        .filter((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2))
        .select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    )
    if any_hot:
        members = probes.join(hot, ["seg", "key"], "left_semi").select("fp").distinct()
        flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)])
        owners = members.select("fp", F.explode(flips).alias("m")).groupBy(F.col("fp").bitwiseXOR(F.col("m")).alias("mid")).agg(F.collect_set("fp").alias("own"))
        hubs = owners.filter(F.size("own") > 1).select(F.array_min("own").alias("a"), F.explode("own").alias("b")).filter("a <> b")
        pairs = pairs.union(hubs)
    return pairs.distinct()


def near_groups(docs: DataFrame, shingle: int = 3, cap: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs: documents whose fingerprints are linked, at
    2 differing bits or fewer, directly or through others, share the smallest doc_id.

    Null or empty text: fingerprint zero, linked like any other. Rows that repeat a doc_id are
    each returned; a null doc_id never names a component unless all of its rows are null.
    Other columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, shingle), "fp")
    reps = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    edges = scratch.save(links(reps.select("fp"), scratch, cap), "edges")
    if edges.isEmpty():
        return rows.join(reps.hint("merge"), "fp").select("doc_id", "fp", F.col("rep").alias("component_id"))
    roots = components(edges, scratch)
    linked = reps.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    linked = scratch.save(linked, "linked")
    least = scratch.save(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = scratch.save(linked.join(least.hint("merge"), "root").select("fp", "component_id"), "named")
    return rows.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")
