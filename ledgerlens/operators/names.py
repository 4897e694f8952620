"""File names without clashes inside a job, given out in order."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local session that names none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def candidate(name: Column, id_: Column, k: Column) -> Column:
    """The k-th name that a file would take: its own, then with six characters of its id, then also with a number."""
    suffix = F.regexp_extract(name, r"\.[^./\\]*$", 0)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    tail = F.concat(F.lit("-"), F.substring(id_, 1, 6))
    number = F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise("")
    return F.when(k == 0, name).otherwise(F.concat(stem, tail, number, suffix))


def claim_names(files: DataFrame, by: str, order: str, name: str, id_: str, rounds: int = 1000) -> DataFrame:
    """files with column claimed: in order of ``order`` within ``by`` each file takes the first of its candidates
    that no earlier file has, also where a name with a suffix is another file's own.

    Files propose and the earliest keeps a name; who loses moves on to its next candidate. As all names prefer
    the earlier file, this ends with what giving names out one by one would give. Files with the same candidates
    (same name and id head) move as one queue, so a round settles a whole queue and rounds follow chains of
    different names, not their number. order is distinct within by; a null name or id counts as ''. Each round is
    checkpointed; nothing but the number of losers comes to the driver. Rounds over the limit are an error.
    """
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = files.select(F.col(by).alias("by"), F.col(order).alias("pos"), clean(name).alias("name"), clean(id_).alias("id"), F.lit(0).alias("k"))
    queue = Window.partitionBy("by", "name", F.substring("id", 1, 6)).orderBy("pos")
    place = F.row_number().over(queue)
    moved = lambda df: df.withColumn("place", place).withColumn("k", F.col("place") + F.max(F.col("k") - F.col("place")).over(queue)).drop("place")
    rows = cut(moved(rows).withColumn("claimed", candidate(F.col("name"), F.col("id"), F.col("k"))))
    for _ in range(rounds):
        first = F.min("pos").over(Window.partitionBy("by", "claimed"))
        lost = cut(rows.withColumn("lost", (first < F.col("pos")).cast("int")))
        if lost.filter("lost = 1").isEmpty():
            key = lambda a, b: a.eqNullSafe(b)
            given = rows.select(F.col("by").alias("_by"), F.col("pos").alias("_pos"), "claimed")
            return files.join(given, key(files[by], given._by) & (files[order] == given._pos)).select(*files.columns, "claimed")
        rows = cut(moved(lost.withColumn("k", F.col("k") + F.col("lost")).drop("lost")).withColumn("claimed", candidate(F.col("name"), F.col("id"), F.col("k"))))
    raise RuntimeError(f"names still clash after {rounds} rounds")
