"""Sinks for foreachBatch that a replay does not change, and readers that see whole batches only.

A store is a folder: data/batch=N holds what batch N wrote and commits/batch=N its record, which is
written last. A batch that failed half way has no record and is not read; when it runs again, it overwrites
its own folder, so that nothing is doubled. Batches are numbered by the stream's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.operators.client import EVENT, as_snapshot, document_state

COMMIT = "rows long, keys long, digest long"


class ResultStore:
    """Results by key, the latest of which counts: greatest version, then greatest batch. gone names a boolean column; a key
    whose latest row has it true is deleted until it is written again."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, version: str, gone: str | None = None):
        self.spark, self.path, self.schema, self.key, self.version, self.gone = spark, path.rstrip("/"), schema, key, version, gone

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Rows of one batch, then their record: how many rows and keys, and a digest of the keys.
        A batch that has its record is left as it is."""
        if batch_id in self.batches():
            return
        data = f"{self.path}/data/batch={batch_id}"
        latest(batch, self.key, F.col(self.version)).write.mode("overwrite").parquet(data)
        written = self.spark.read.schema(self.schema).parquet(data)
        record = written.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(self.key).alias("keys"), F.coalesce(F.bit_xor(F.xxhash64(self.key)), F.lit(0)).alias("digest"))
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch_id}")

    def commits(self) -> DataFrame:
        """(batch, rows, keys, digest) of whole batches."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [s.getPath().toString() for s in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(path) else []
        if not done:
            return self.spark.createDataFrame([], f"{COMMIT}, batch long").select("batch", *[c.split()[0] for c in COMMIT.split(", ")])
        return self.spark.read.schema(f"{COMMIT}, batch long").option("basePath", f"{self.path}/commits").parquet(*done).select("batch", "rows", "keys", "digest")

    def batches(self) -> list[int]:
        """Numbers of whole batches, ascending."""
        return sorted(r["batch"] for r in self.commits().select("batch").collect())

    def rows(self, above: int = -1, upto: int | None = None) -> DataFrame:
        """Rows of whole batches, with the batch that wrote each."""
        paths = [f"{self.path}/data/batch={b}" for b in self.batches() if b > above and (upto is None or b <= upto)]
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, batch long")
        return self.spark.read.schema(f"{self.schema}, batch long").option("basePath", f"{self.path}/data").parquet(*paths)

    def read(self) -> DataFrame:
        """The rows that count now; a reader that asks for one key gets it by a filter on it."""
        rows = latest(self.rows(), self.key, F.struct(self.version, "batch")).drop("batch")
        return rows.filter(~F.coalesce(self.gone, F.lit(False))).drop(self.gone) if self.gone else rows


def latest(rows: DataFrame, key: str, order) -> DataFrame:
    """One row for each key, that of the greatest order; sums up before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("x")).select("x.*")


class EventLog:
    """Events of jobs with snapshots, so that a reader starts at any time without loss: it gets the state as of
    a whole batch, then the batches after it in order. A job's events come in order over the batches, as a
    server sends them, and may come again."""

    def __init__(self, spark: SparkSession, path: str, every: int = 8):
        self.spark, self.every = spark, every
        self.log = ResultStore(spark, f"{path.rstrip('/')}/log", EVENT, "id", "seq")
        self.snapshots = ResultStore(spark, f"{path.rstrip('/')}/snapshots", EVENT, "id", "seq")
        for store in (self.log, self.snapshots):
            store.schema = f"{EVENT}, id string"

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Appends a batch of events; after every so many batches the state up to there is written too."""
        self.log.write(batch.withColumn("id", F.concat_ws(":", "job", "seq")), batch_id)
        if batch_id % self.every == self.every - 1 and batch_id not in self.snapshots.batches():
            events = self.events(upto=batch_id)
            last = events.groupBy("job").agg(F.max("seq").alias("at"))
            docs = as_snapshot(document_state(events).join(last, "job"), F.col("at"))
            status = events.groupBy("job").agg(F.max("seq").alias("seq"), F.max_by("status", F.when(F.col("event") == "job_status", F.col("seq"))).alias("status"))
            jobs = status.select("job", "seq", F.lit("job_status").alias("event"), F.lit(None).cast("long").alias("doc"), "status", *[F.lit(None).cast(t).alias(c) for c, t in (("done", "int"), ("total", "int"), ("outcomes", "array<string>"), ("error", "string"))])
            self.snapshots.write(docs.union(jobs.filter("status is not null")).withColumn("id", F.concat_ws(":", "job", F.coalesce(F.col("doc").cast("string"), F.lit("job")))), batch_id)

    def open(self, upto: int | None = None) -> tuple[DataFrame, DataFrame, int]:
        """(snapshot events, events after them, the batch of the snapshot or -1). upto: as a reader that
        opened the log after that batch would have got it, the rest following as deltas."""
        at = max((b for b in self.snapshots.batches() if upto is None or b <= upto), default=-1)
        return self.snapshots.rows(at - 1, at).drop("batch", "id"), self.log.rows(above=at).drop("id"), at

    def events(self, upto: int | None = None) -> DataFrame:
        """What a reader folds: the newest snapshot and all that came after it."""
        snapshot, deltas, _ = self.open(upto)
        if upto is not None:
            deltas = deltas.filter(F.col("batch") <= upto)
        return snapshot.union(deltas.drop("batch"))
