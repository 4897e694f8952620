"""How rows are dealt out to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(key: str, *tables: DataFrame, each: int = 250_000) -> list[DataFrame]:
    """Tables by key in tasks of about ``each`` rows of them all, whatever their number. Spark joins small partitions to tasks by
    their compressed bytes, and narrow rows take tens of times as much once they are sorted or put in a hash table.
    Tables that all cores hold at once stay as they are."""
    n = -(-sum(t.count() for t in tables) // each)
    return [t.repartition(n, key) if n > t.sparkSession.sparkContext.defaultParallelism else t for t in tables]
