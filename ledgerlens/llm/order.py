"""Neighbours in a global order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, partitions

PREFIX = 64  # characters of the text that part rows of one doc_id into ranges


def with_ghosts(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """docs(doc_id, text) with columns bucket and ghost, and the written tables that it reads, to be freed after use. A bucket is a range of the order by doc_id descending,
    null last, then text. Each also gets a copy, marked as ghost, of the first row of the bucket after it, so
    that lead() within a bucket sees the next row of the whole order; the last bucket's ghost is the very first row.

    Rows are range-partitioned and written once; the only thing that is gathered in one task is the list
    of bucket numbers. Rows that share a doc_id are parted by how their texts begin.
    """
    ranged = docs.repartitionByRange(partitions(docs), F.desc_nulls_last("doc_id"), F.substring("text", 1, PREFIX))
    placed = scratch.save(ranged.withColumns({"bucket": F.spark_partition_id(), "ghost": F.lit(0)}), "ranges")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "text")  # not x falls as x rises
    heads = scratch.save(placed.groupBy("bucket").agg(F.min(key).alias("x")).select("bucket", F.bitwise_not("x.down").alias("doc_id"), "x.text"), "heads")
    numbers = heads.select("bucket")
    after = F.lead("bucket").over(Window.orderBy("bucket"))
    least = numbers.agg(F.min("bucket").alias("least"))
    own = numbers.select(F.col("bucket").alias("own"), after.alias("after")).crossJoin(F.broadcast(least)).select("own", F.coalesce("after", "least").alias("bucket"))  # one row
    ghosts = heads.join(own, "bucket").select("doc_id", "text", F.col("own").alias("bucket"), F.lit(1).alias("ghost"))
    return placed.union(ghosts), [placed, heads]
