"""Exact duplicates by deterministic block naming, in DataFrame operations only.

The normalised text is cut into fixed-size blocks; the distinct blocks are sorted and get
integer names; adjacent names are paired and the sorted distinct pairs are named again, until
one name is left for each document. A document's identity is (levels, name): equal if and only
if the texts are equal, with no hash to collide.

Naming is preceded by a lossless pruning step: a text whose (length, xxhash64) occurs once has
no equal, so only texts that share a digest are named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import WS, Scratch, partitions


def squeeze(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), WS, F.coalesce(text.cast("string"), F.lit("")))


def _named(scratch: Scratch, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with integer names by their rank in the order of (hash, keys). The hash is the
    range key, so that what the driver samples to find the ranges are numbers, not blocks of text."""
    distinct = rows.select(*keys).distinct().withColumn("at", F.xxhash64(*keys))
    ranked = distinct.repartitionByRange(partitions(distinct, 200_000), "at").sortWithinPartitions("at", *keys)
    return scratch.save(ranked.select(*keys, F.monotonically_increasing_id().alias("name")), "names")


KEY = ["rid", "m", "h"]


def identities(texts: DataFrame, scratch: Scratch, block: int = 4096) -> DataFrame:
    """texts(rid, m, h, norm) -> (rid, m, h, level, name); equal texts share (level, name)."""
    last = F.greatest(F.lit(0), F.floor((F.length("norm") - 1) / block)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.substring(F.col("norm"), i * block + 1, F.lit(block)).alias("block"))
    )
    blocks = scratch.save(texts.select(*KEY, last.alias("last"), F.explode(cut).alias("x")).select(*KEY, "last", "x.i", "x.block"), "blocks")
    names = _named(scratch, blocks, ["block"])
    rows = scratch.save(blocks.join(names.hint("merge"), "block").select(*KEY, "last", "i", "name"), "level")
    scratch.free(blocks)
    done, level = [], 0
    scratch.free(names)
    while True:
        done.append(rows.filter("last = 0").select(*KEY, F.lit(level).alias("level"), "name"))
        rest = rows.filter("last > 0")
        if rest.isEmpty():
            return reduce(DataFrame.union, done).distinct()
        side = lambda bit: F.max(F.when(F.col("i") % 2 == bit, F.col("name")))
        pairs = scratch.save(
            rest.groupBy(*KEY, F.shiftright("last", 1).alias("last"), F.shiftright("i", 1).alias("j")).agg(side(0).alias("l"), F.coalesce(side(1), F.lit(-1)).alias("r")), "pairs"
        )
        names = _named(scratch, pairs, ["l", "r"])
        rows = scratch.save(pairs.join(names.hint("merge"), ["l", "r"]).select(*KEY, "last", F.col("j").alias("i"), "name"), "level")
        level += 1


def exact_groups(docs: DataFrame, block: int = 4096, row: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the most code points in the original stays, then the
    smallest doc_id. Null text counts as empty, and all empty texts are one group. Rows that
    repeat a doc_id each count in group_size and get the same answer; a null doc_id comes after
    all others. Where ``row`` names a column with a number of each row's own, it is returned too and
    breaks ties of doc_id, so that exactly one row of a group is kept. Other columns are ignored;
    an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "blocks")
    doc_id = F.col("doc_id").cast("long")
    rid = F.col(row).cast("long") if row else F.coalesce(doc_id, F.lit(-(1 << 63)))
    base = (
        docs.select(doc_id.alias("doc_id"), rid.alias("rid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .withColumn("norm", squeeze(F.col("text")))
        .select("*", F.length("norm").alias("m"), F.xxhash64("norm").alias("h"))
    )
    facts = scratch.save(base.select("doc_id", *KEY, F.length("text").alias("n"), F.sha2("norm", 256).alias("text_sha256")), "facts")
    shared = scratch.save(facts.groupBy("m", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("m", "h"), "shared")
    hits = scratch.save(facts.join(shared.hint("merge"), ["m", "h"], "left_semi"), "hits")
    ids = identities(base.select(*KEY, "norm").join(hits.select(*KEY).hint("merge"), KEY, "left_semi"), scratch, block)
    members = scratch.save(hits.join(ids.hint("merge"), KEY), "members")
    scratch.free(hits)
    back = [F.bitwise_not("doc_id").alias("back"), *([F.bitwise_not("rid").alias("last")] if row else [])]
    best = scratch.save(
        members.groupBy("level", "name")
        .agg(F.max(F.struct("n", *back)).alias("top"), F.count(F.lit(1)).alias("group_size"))
        .select("level", "name", F.bitwise_not("top.back").alias("keep_id"), F.bitwise_not("top.last" if row else "top.back").alias("keep_row"), "group_size"),
        "best",
    )
    own = F.col("rid" if row else "doc_id")
    extra = [F.col("rid").alias(row)] if row else []
    grouped = members.join(best.hint("merge"), ["level", "name"]).select("doc_id", "keep_id", "group_size", own.eqNullSafe(F.col("keep_row")).alias("kept"), "text_sha256", *extra)
    alone = facts.join(shared.hint("merge"), ["m", "h"], "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", *extra
    )
    return alone.union(grouped)
