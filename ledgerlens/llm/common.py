"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

WS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. A local session that names none gets a temporary one; a cluster has to name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def partitions(rows: DataFrame, each: int = 20_000) -> int:
    """As many partitions as the session asks for, and more where they would hold over ``each`` rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 23, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``rows`` rows whose texts in that column have about ``size`` bytes; a longer text is alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = min(max(at + 1, int(np.searchsorted(ends, before + size, "right"))), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def joined(parts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts lie one after the other in an array, with these sizes. (Those named by which in that order, where each of them ends)."""
    long = sizes[which]
    ends = np.cumsum(long, dtype=np.int64)
    at = np.repeat(((np.cumsum(sizes, dtype=np.int64) - sizes)[which] - ends + long).astype(np.int32), long)
    at += np.arange(len(at), dtype=np.int32)
    return parts[at], ends


class Scratch:
    """Tables written to the shared folder to cut lineage; free() deletes one that is used up."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{label}"

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.path(label)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def free(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


class Recent:
    """A bounded memory of results in two generations: when the young one is full it becomes the
    old one, so what is asked for often stays. Holds at most twice ``size`` entries."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def many(self, keys: list) -> list:
        """What get() gives for each of the keys."""
        got, old = list(map(self.young.get, keys)), self.old
        for i, k in enumerate(keys):
            if got[i] is None and k in old:
                got[i] = self.get(k)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value
