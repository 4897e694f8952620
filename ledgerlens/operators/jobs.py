"""State of extraction jobs from their events, for batch tables and for streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .tasks import dealt

RUNNABLE = ("queued", "running")
STOPPED = "已中断"  # fixed value: the error of a document that was cancelled


def job_state(events: DataFrame, job: str) -> DataFrame:
    """events(job, ts, event_id, status) -> the latest status of each job; the larger event_id decides at one ts."""
    at = F.struct("ts", "event_id")
    return events.groupBy(job).agg(F.max_by("status", at).alias("status"), F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("n_events"))


def queue_next(events: DataFrame, job: str) -> DataFrame:
    """The one runnable job whose first event is the oldest; no row if none is runnable."""
    first = events.groupBy(job).agg(F.min(F.struct("ts", "event_id")).alias("made"), F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return first.filter(F.col("status").isin(*RUNNABLE)).orderBy("made").limit(1).select(job, "status")


def progress(events: DataFrame, job: str) -> DataFrame:
    """Finished and all steps of each job."""
    return events.groupBy(job).agg(F.count_if(F.col("status") == "done").alias("done"), F.count(F.lit(1)).alias("total"))


def neighbours(events: DataFrame, job: str) -> DataFrame:
    """Each finished step with the finished one before and after it."""
    w = Window.partitionBy(job).orderBy("ts", "event_id")
    done = events.filter(F.col("status") == "done")
    return done.select(job, "event_id", F.lag("event_id").over(w).alias("prev_id"), F.lead("event_id").over(w).alias("next_id"))


def open_document(docs: DataFrame, by: str) -> DataFrame:
    """docs(by, pos, id, status) -> shown: the first document done, else the first; next: the first not finished."""
    waits = F.col("status").isin(*RUNNABLE)
    shown = F.min_by("id", F.struct(F.coalesce(F.col("status") != "done", F.lit(True)), F.col("pos")))
    return docs.groupBy(by).agg(shown.alias("shown"), F.min_by("id", F.when(waits, F.col("pos"))).alias("next"))


def cancel(jobs: DataFrame, docs: DataFrame, asked: DataFrame, job: str) -> tuple[DataFrame, DataFrame]:
    """jobs(job, status, cancel_requested) and docs(job, status, error, ...) after the jobs in asked were cancelled.

    A queued job is cancelled at once with its queued documents. Any other only carries the request, which a
    running one obeys at its next document. A job asked for twice counts once, one not in jobs not at all.
    """
    jobs, docs, asked = dealt(job, jobs, docs, asked.select(job))
    named = jobs.join(asked.distinct().withColumn("asked", F.lit(True)), job, "left")
    at_once = F.coalesce("asked", F.lit(False)) & (F.col("status") == "queued")
    ended = named.filter(at_once).select(job).distinct().withColumn("ended", F.lit(True))
    wanted = F.coalesce("asked", "cancel_requested", F.lit(False))
    now = named.withColumns({"cancel_requested": wanted, "status": F.when(at_once, "cancelled").otherwise(F.col("status"))}).drop("asked")
    hit = F.coalesce("ended", F.lit(False)) & (F.col("status") == "queued")
    left = docs.join(ended, job, "left").withColumns({"error": F.when(hit, STOPPED).otherwise(F.col("error")), "status": F.when(hit, "cancelled").otherwise(F.col("status"))})
    return now, left.drop("ended")


def recover(jobs: DataFrame, docs: DataFrame, job: str) -> tuple[DataFrame, DataFrame]:
    """jobs(job, status, cancel_requested, ...) and docs(job, status, done, total, ...) after a restart.

    Running jobs that nobody cancelled queue again, and so do their running documents, from their first page.
    Documents that ended stay as they are, so that no work is done twice.
    """
    jobs, docs = dealt(job, jobs, docs)
    again = (F.col("status") == "running") & ~F.coalesce("cancel_requested", F.lit(False))
    broken = jobs.filter(again).select(job).distinct().withColumn("broken", F.lit(True))
    hit = F.coalesce("broken", F.lit(False)) & (F.col("status") == "running")
    fresh = {c: F.when(hit, 0).otherwise(F.col(c)) for c in ("done", "total")}
    left = docs.join(broken, job, "left").withColumns(fresh | {"status": F.when(hit, "queued").otherwise(F.col("status"))})
    return jobs.withColumn("status", F.when(again, "queued").otherwise(F.col("status"))), left.drop("broken")
