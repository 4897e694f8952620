"""Cancelling and recovery of jobs, and texts shown to the user."""

from pyspark.sql import functions as F

from ledgerlens.functions import text as t
from ledgerlens.operators import jobs as j, pages, templates

JOBS = "job int, status string, cancel_requested boolean"
DOCS = "job int, doc int, status string, error string, done int, total int"


def plain(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def test_cancel_ends_only_what_has_not_begun(spark):
    jobs = spark.createDataFrame([(1, "queued", None), (2, "running", False), (3, "done", False), (4, "queued", True)], JOBS)
    docs = spark.createDataFrame([(1, 1, "queued", "", 0, 2), (1, 2, "done", "", 2, 2), (2, 1, "running", "", 1, 2), (2, 2, "queued", "", 0, 2), (4, 1, "queued", "", 0, 1), (9, 1, "queued", "", 0, 1)], DOCS)
    asked = spark.createDataFrame([(1,), (1,), (2,), (8,)], "job int")
    now, left = j.cancel(jobs, docs, asked, "job")
    assert plain(now, "job", "status", "cancel_requested") == [(1, "cancelled", True), (2, "running", True), (3, "done", False), (4, "queued", True)]
    assert plain(left, "job", "doc", "status", "error") == [
        (1, 1, "cancelled", j.STOPPED), (1, 2, "done", ""), (2, 1, "running", ""), (2, 2, "queued", ""), (4, 1, "queued", ""), (9, 1, "queued", ""),
    ]


def test_recovery_keeps_finished_documents(spark):
    jobs = spark.createDataFrame([(1, "running", None), (2, "running", True), (3, "queued", False)], JOBS)
    docs = spark.createDataFrame([(1, 1, "running", "", 1, 4), (1, 2, "done", "", 4, 4), (2, 1, "running", "", 1, 4), (3, 1, "queued", "", 0, 0)], DOCS)
    now, left = j.recover(jobs, docs, "job")
    assert plain(now, "job", "status") == [(1, "queued"), (2, "running"), (3, "queued")]
    assert plain(left, "job", "doc", "status", "done", "total") == [(1, 1, "queued", 0, 0), (1, 2, "done", 4, 4), (2, 1, "running", 1, 4), (3, 1, "queued", 0, 0)]
    empty = j.recover(jobs.limit(0), docs.limit(0), "job")
    assert not empty[0].collect() and not empty[1].collect()


def test_shown_texts(spark):
    times = spark.createDataFrame([(0,), (999,), (1000,), (59_990,), (60_000,), (3_723_450,), (None,)], "ms long").select(t.duration(F.col("ms")))
    assert [r[0] for r in times.collect()] == ["0ms", "999ms", "1.00s", "59.99s", "1m 0.00s", "62m 3.45s", None]
    amounts = spark.createDataFrame([(0.125,), (-2.375,), (1234567.0,), (1.005,)], "x double").select(t.amount_text(F.col("x")))
    assert [r[0] for r in amounts.collect()] == ["0.13", "-2.38", "1,234,567.00", "1.01"]
    rates = spark.createDataFrame([(1, 16), (0, 0), (3, 3)], "c int, n int").select(t.percentage(F.col("c"), F.col("n")))
    assert [r[0] for r in rates.collect()] == ["6.3%", "—", "100.0%"]
    line = spark.createDataFrame([("a\nb  c\td" + "x" * 40,)], "x string").select(t.one_line(F.col("x")))
    assert line.first()[0] == "a b  c\td" + "x" * 22


def test_templates_in_order(spark):
    pairs = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "a"), (1, 4, None), (1, 0, "c")], "g int, pos int, template_id string")
    assert templates.templates_in_order(pairs, "g", "pos").first()["template_ids"] == ["c", "a", "b", None]


def test_cancel_bounds_the_rows_of_a_task(spark):
    n = 2_200_000
    docs = spark.range(n).selectExpr("id % 1000000 AS job", "'queued' AS status", "'' AS error")
    jobs = spark.range(1_000_000).selectExpr("id AS job", "'queued' AS status", "false AS cancel_requested")
    now, left = j.cancel(jobs, docs, jobs.filter("job % 2 = 0").select("job"), "job")
    assert left.rdd.getNumPartitions() >= 3_700_000 // 250_000
    assert left.filter("status = 'cancelled'").count() == n // 2 and now.count() == 1_000_000


def test_pages_fold_in_two_orders(spark):
    entries = spark.createDataFrame([(1, 1, "", False, True), (1, 2, "", False, True), (1, 3, "A", True, True), (1, 4, "", False, True), (1, 5, "a ", True, True), (1, 6, "", True, False)], "doc int, pos int, no string, has_header boolean, has_lines boolean")
    out = pages.fold_pages(entries, "doc")
    assert plain(out, "pos", "created", "inv_id") == [(1, True, 1), (2, False, 1), (3, True, 3), (4, False, 3), (5, False, 3), (6, True, 6)]
    assert out._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("+- Sort [") <= 2
