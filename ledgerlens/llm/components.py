"""Connected components of an edge table, with nothing gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges sorted by (b, a): the first a of each b is linked to b and to the other a of that b."""
    b0 = a0 = None
    for batch in batches:
        a, b = (batch.column(j).to_numpy() for j in (0, 1))
        if not len(a):
            continue
        fresh = np.concatenate([[b[0] != b0], b[1:] != b[:-1]])
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), -1))
        first = np.where(at >= 0, a[at], a0 if a0 is not None else 0)
        b0, a0 = b[-1], first[-1]
        left, right = first, np.where(fresh, b, a)
        keep = left != right
        yield pa.RecordBatch.from_arrays([pa.array(left[keep]), pa.array(right[keep])], ["a", "b"])


def contract(edges: DataFrame, scratch: Scratch, passes: int = 3) -> DataFrame:
    """Edges (a, b), a < b, with the same components and mostly far fewer of them: in each pass a node
    keeps its smallest neighbour and hands its other smaller ones on to that. Nothing is gathered;
    a task streams over its sorted edges."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(passes):
        stars = edges.repartition(n, "b").sortWithinPartitions("b", "a").mapInArrow(_stars, "a long, b long")
        edges = scratch.save(stars.distinct(), "stars")
    return edges


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a, b) -> (node, root), root being the smallest node reachable.

    Each round a node takes the smallest label among its neighbours' and then the label of
    that label (a shortcut), until nothing changes. Both sides of every join are written
    tables, so a node with very many links is a skewed join that Spark splits at run time.
    Empty edges give an empty table; self-loops and repeated edges are harmless.
    """
    both = scratch.save(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(),
        "links",
    )
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        hooked = scratch.save(labels.join(near.hint("merge"), "node").select("node", "root", F.least("root", "near").alias("to")), "hooked")
        up = hooked.select(F.col("node").alias("to"), F.col("to").alias("top"))
        nxt = scratch.save(hooked.join(up.hint("merge"), "to").select("node", F.least("to", "top").alias("root"), (F.least("to", "top") < F.col("root")).alias("moved")), "labels")
        done = nxt.filter("moved").isEmpty()
        scratch.free(labels)
        scratch.free(hooked)
        labels = nxt.select("node", "root")
        labels._scratch_path = nxt._scratch_path
        if done:
            scratch.free(both)
            return labels
