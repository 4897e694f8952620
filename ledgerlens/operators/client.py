"""What a client shows of extraction jobs, folded from the events that the server sends, in one pass over all of them.

Events are rows (job, seq, event, doc, status, done, total, outcomes, error); seq numbers a job's events from 1.

| event | meaning for the document (doc null: for the job) |
|---|---|
| snapshot | all of the document's state, as it was at seq |
| doc_started | running again from its first page, without outcomes or error |
| stream | running without error, done of total pages |
| page_done | the same, and its outcomes are appended |
| doc_done, doc_error | ended; an error keeps the progress |
| job_status | the job's status; when it is cancelled, queued and running documents are too |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .jobs import RUNNABLE, STOPPED

EVENT = "job long, seq long, event string, doc long, status string, done int, total int, outcomes array<string>, error string"
STATE = "job long, doc long, status string, done int, total int, outcomes array<string>, error string"
#: The status that an event gives a document.
BECOMES = {"doc_started": "running", "stream": "running", "page_done": "running", "doc_done": "done", "doc_error": "error"}


def _last(value: Column, *events: str) -> Column:
    """The value at the latest of these events; a snapshot holds all that came up to its seq."""
    return F.max_by(value, F.when(F.col("event").isin(*events), F.struct("seq", F.col("event") == "snapshot")))


def document_state(events: DataFrame) -> DataFrame:
    """The state of each document of each job: (job, doc, status, done, total, outcomes, error).

    The order in which rows come does not matter, nor does a row that comes twice, but a snapshot hides what it did not know. One aggregation by document,
    combined before its shuffle, and a join with the jobs that were cancelled; a document's outcomes are
    gathered in one row, so they are bounded by its pages. An event without doc is the job's alone.
    """
    became = F.lit(None).cast("string")
    for event, status in BECOMES.items():
        became = F.when(F.col("event") == event, status).otherwise(became)
    became = F.when(F.col("event") == "snapshot", F.col("status")).otherwise(became)
    part = F.when(F.col("event").isin("snapshot", "page_done"), F.struct("seq", (F.col("event") == "snapshot").alias("whole"), F.coalesce("outcomes", F.array().cast("array<string>")).alias("outcomes")))
    error = F.when(F.col("event").isin("snapshot", "doc_error"), F.col("error"))
    shown = F.struct(F.when(F.col("event") == "doc_started", 0).otherwise(F.col("done")).alias("done"), F.when(F.col("event") == "doc_started", 0).otherwise(F.col("total")).alias("total"), (F.col("event") == "doc_done").alias("all"))
    docs = events.filter("doc is not null").groupBy("job", "doc").agg(
        F.coalesce(_last(F.col("seq"), "snapshot", "doc_started"), F.lit(0)).alias("start"),
        F.collect_set(part).alias("parts"),
        _last(F.struct("seq", became.alias("status"), error.alias("error")), "snapshot", *BECOMES).alias("last"),
        _last(shown, "snapshot", "doc_started", "stream", "page_done", "doc_done").alias("shown"),
    )
    ended = events.filter("event = 'job_status' and status = 'cancelled'").groupBy("job").agg(F.max("seq").alias("ended"))
    outcomes = F.flatten(F.transform(F.array_sort(F.filter("parts", lambda x: (x["seq"] > F.col("start")) | (x["whole"] & (x["seq"] == F.col("start"))))), lambda x: x["outcomes"]))
    full = docs.join(ended, "job", "left").withColumn("outcomes", outcomes)
    hit = F.col("last.status").isin(*RUNNABLE) & F.coalesce(F.col("ended") > F.col("last.seq"), F.lit(False))
    pages = lambda c: F.when(F.col("shown.all"), F.size("outcomes")).otherwise(F.coalesce(F.col(f"shown.{c}"), F.lit(0))).cast("int").alias(c)
    return full.select(
        "job", "doc", F.when(hit, "cancelled").otherwise(F.col("last.status")).alias("status"), pages("done"), pages("total"), "outcomes",
        F.when(hit, STOPPED).otherwise(F.col("last.error")).alias("error"),
    )


def job_view(events: DataFrame) -> DataFrame:
    """(job, status, documents, ended, pages): each job's latest status and how far its documents are."""
    told = events.groupBy("job").agg(_last(F.col("status"), "job_status").alias("status"))
    docs = document_state(events).groupBy("job").agg(F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("status").isin(*RUNNABLE)).alias("ended"), F.sum("done").alias("pages"))
    counted = told.join(docs, "job", "left")
    return counted.na.fill(0, ["documents", "ended", "pages"])


def as_snapshot(state: DataFrame, seq: Column) -> DataFrame:
    """A state as snapshot events at seq, from which a reader can go on."""
    return state.select("job", seq.cast("long").alias("seq"), F.lit("snapshot").alias("event"), "doc", "status", "done", "total", "outcomes", "error")
