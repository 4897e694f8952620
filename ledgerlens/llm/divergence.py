"""How far the sources of a language are apart in their words, by sparse merges of pairs.

Terms are counted by (lang, source); a language keeps those of enough documents and numbers them. Each source's
counts become arrays of (term id, count) sorted by id, cut into blocks of about BLOCK terms so that none grows
with the vocabulary. A task for each unordered pair of sources and block co-groups the two arrays: a galloping
intersection finds the terms that both have, and those, the one-sided ones and the ones that neither has
are priced in turn. The distance counts for both directions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

LEAST_DOCS = 30
UNIT = 1_000_000_000
SMOOTH = 5
TOP = 50
BLOCK = 1 << 16
#: By byte: A-Z lower-cased, a-z and bytes over 127 as they are, all others a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of text whose terms are counted at a time, and terms that a task holds before it hands them on.
SPAN, HELD = 1 << 20, 200_000


def term_counts(text: bytes | None) -> Counter:
    data, at, out = (text or b"").translate(FOLD), 0, Counter()
    while at < len(data):
        end = data.find(b" ", at + SPAN)
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> sums over some rows: (lang, source, term, n, docs)."""
    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def out() -> pa.RecordBatch:
        rows = [(*key, term, n, docs[term]) for key, (total, docs) in held.items() for term, n in total.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["lang", "source", "term", "n", "docs"])

    size = 0
    for b in batches:
        for lang, source, text in zip(*(b.column(k) for k in range(3)), strict=True):
            found = term_counts(text.as_py())
            total, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            size -= len(total)
            total.update(found)
            docs.update(found.keys())
            size += len(total)
            if size > HELD:
                yield out()
                size = 0
    yield out()


def kept_terms(rows: DataFrame, least: int) -> DataFrame:
    """rows(lang, source, text) -> (lang, source, term, id, first, n, lang_n), a row for each kept term and source that
    has it; first is 1 in one row of each term. Sums by (lang, term, source) and by (lang, term) share one shuffle."""
    counted = rows.select(*[F.col(c).cast("binary").alias(c) for c in ("lang", "source", "text")]).mapInArrow(_counted, "lang binary, source binary, term binary, n long, docs long")
    named = counted.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "n", "docs").repartition("lang", "term")
    sums = named.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("own", F.monotonically_increasing_id())
    w = Window.partitionBy("lang", "term")
    whole = sums.withColumns({"in_docs": F.sum("docs").over(w), "lang_n": F.sum("n").over(w), "id": F.min("own").over(w)})
    return whole.filter(F.col("in_docs") >= least).select("lang", "source", "term", "id", (F.col("own") == F.col("id")).cast("long").alias("first"), "n", "lang_n")


def priced(count: str, total: str, terms: str) -> Column:
    """p = 1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)) of columns, exact."""
    return F.expr(f"1 + (cast({count} + {SMOOTH} as decimal(20,0)) * {UNIT}) div cast({total} + {SMOOTH} * {terms} as decimal(20,0))")


def prices(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same of an array: long division by three digits of 1000, so that no product leaves 64 bits."""
    over = total + SMOOTH * terms
    rest, out = count + SMOOTH, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // over, rest % over
    return out + 1


def gallop(few: np.ndarray, many: np.ndarray, stride: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places in few and in many of the ids that both sorted arrays have. From where the last ids were found
    steps double until they pass the next ids; these are searched for in that stretch alone."""
    at, mine, theirs = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(few), stride):
        part = few[k : k + stride]
        step = stride
        while at + step < len(many) and many[at + step] < part[-1]:
            step *= 2
        stretch = many[at : at + step + 1]
        found = np.searchsorted(stretch, part)
        hit = np.flatnonzero((found < len(stretch)) & (stretch[np.minimum(found, len(stretch) - 1)] == part)) if len(stretch) else np.zeros(0, np.int64)
        mine.append(hit + k), theirs.append(found[hit] + at)
        at += int(found[0])
    return np.concatenate(mine), np.concatenate(theirs)


def merged(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], terms: int) -> tuple[int, int]:
    """(ids, counts, total) of two sources -> the sum of |p - q| over terms that either has, and their number."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (pa_, qa), (zero_a, zero_b) = (prices(x[1], x[2], terms) for x in (a, b)), (prices(np.zeros(1, np.int64), x[2], terms)[0] for x in (a, b))
    i, j = gallop(a[0], b[0])
    alone_a, alone_b = np.ones(len(a[0]), bool), np.ones(len(b[0]), bool)
    alone_a[i] = alone_b[j] = False
    value = np.abs(pa_[i] - qa[j]).sum() + np.abs(pa_[alone_a] - zero_b).sum() + np.abs(qa[alone_b] - zero_a).sum()
    return int(value), len(a[0]) + len(b[0]) - len(i)


PART = "lang string, a string, b string, value long, either long"


def _pair(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The task of one pair and block; a side without terms there has no row."""
    side = lambda t: (t["ids"][0].values.to_numpy(), t["counts"][0].values.to_numpy()) if len(t) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    some = left if len(left) else right
    total_a, total_b, terms = (some[c][0].as_py() for c in ("total_a", "total_b", "terms"))
    value, either = merged((*side(left), total_a), (*side(right), total_b), terms)
    lang, a, b = (k.as_py() for k in key[:3])
    return pa.table({"lang": [lang], "a": [a], "b": [b], "value": pa.array([value], pa.int64()), "either": pa.array([either], pa.int64())})


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """docs(text, lang, source) -> (lang, source, part, item, value, rank), as the contract of source audits states.

    Part ``pair``: each other source of the lang and the sum of |p - q| over all kept terms; part ``term``: the
    ``top`` terms that the source has over its language's price. Null text, lang and source count as ''.
    A source without terms is priced by the smoothing alone; a lang without kept terms has value 0 in every pair
    and no terms, one with a single source has no pairs. Rows that repeat count again. Terms are parted at a million
    bytes at most, so a very long text needs no more memory. Ranks break ties by item in UTF-8 order. Other
    columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    table = scratch.save(kept_terms(rows, least), "terms")
    langs = table.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_total"))
    totals = table.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = scratch.save(groups.na.fill(0, ["total", "terms", "lang_total"]), "groups")  # a row for each source
    blocks = -(-(groups.agg(F.max("terms")).first()[0] or 1) // block)

    arrays = table.groupBy("lang", "source", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("x"))
    arrays = scratch.save(arrays.select("lang", "source", "block", F.col("x.id").alias("ids"), F.col("x.n").alias("counts")), "arrays")
    one, other = (groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), *more) for s, more in (("a", ("terms",)), ("b", ())))
    pairs = one.join(other, "lang").filter("a < b")
    sides = [arrays.withColumnRenamed("source", s).join(pairs, ["lang", s]) for s in ("a", "b")]
    left, right = (side.toDF(*side.columns).groupBy("lang", "a", "b", "block") for side in sides)
    parts = left.cogroup(right).applyInArrow(_pair, PART).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("either").alias("either"))
    apart = pairs.filter("terms > 0").join(parts, ["lang", "a", "b"], "left").withColumn("zero", F.lit(0)).na.fill(0, ["value", "either"])
    both_absent = F.abs(priced("zero", "total_a", "terms") - priced("zero", "total_b", "terms")) * (F.col("terms") - F.col("either"))
    apart = apart.select("lang", "a", "b", (F.col("value") + both_absent).alias("value")).union(pairs.filter("terms = 0").select("lang", "a", "b", F.lit(0).cast("long")))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    apart = apart.select("lang", "value", ways).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")

    over = table.join(groups, ["lang", "source"]).withColumn("value", priced("n", "total", "terms") - priced("lang_n", "lang_total", "terms")).filter("value > 0")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return apart.withColumn("rank", best).union(over.withColumn("rank", best).filter(F.col("rank") <= top))
