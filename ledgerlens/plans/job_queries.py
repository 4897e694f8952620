"""Queries of cancelling and recovery of jobs, shown amounts and times, and template order (q19c to q51c)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.functions import text as t
from ledgerlens.operators import jobs as j, templates
from . import bridge as b
from .report_queries import query

JOB = "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END"
DOC = "CASE l_linenumber % 3 WHEN 1 THEN 'queued' WHEN 2 THEN 'running' ELSE 'done' END"
TABLES = f"""j AS (SELECT o_orderkey AS job, {JOB} AS status, o_custkey % 4 = 0 AS cancelled, o_custkey % 3 = 0 AS asked FROM orders),
    d AS (SELECT l_orderkey AS job, l_linenumber AS doc, {DOC} AS status, l_suppkey % 7 AS done FROM lineitem)"""


def jobs_and_docs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    jobs = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.expr(JOB).alias("status"), (F.col("o_custkey") % 4 == 0).alias("cancel_requested"))
    line = b.read(spark, d, "lineitem")
    done = F.col("l_suppkey") % 7
    docs = line.select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("doc"), F.expr(DOC).alias("status"), F.lit("").alias("error"), done.alias("done"), F.lit(7).alias("total"))
    return jobs, docs


@query(
    f"""WITH {TABLES} SELECT d.job, doc, asked OR cancelled AS cancel_requested, CASE WHEN asked AND j.status = 'queued' THEN 'cancelled' ELSE j.status END AS job_status,
    CASE WHEN asked AND j.status = 'queued' AND d.status = 'queued' THEN 'cancelled' ELSE d.status END AS status,
    CASE WHEN asked AND j.status = 'queued' AND d.status = 'queued' THEN '已中断' ELSE '' END AS error FROM d JOIN j ON d.job = j.job"""
)
def q41b_cancel_jobs(spark: SparkSession, d: str) -> DataFrame:
    asked = b.read(spark, d, "orders").filter("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("job"))
    jobs, docs = j.cancel(*jobs_and_docs(spark, d), asked, "job")
    return docs.join(jobs.withColumnRenamed("status", "job_status"), "job").select("job", "doc", "cancel_requested", "job_status", "status", "error")


@query(
    f"""WITH {TABLES}, k AS (SELECT job, status, status = 'running' AND NOT cancelled AS again FROM j)
    SELECT d.job, doc, CASE WHEN again THEN 'queued' ELSE k.status END AS job_status, CASE WHEN again AND d.status = 'running' THEN 'queued' ELSE d.status END AS status,
    CASE WHEN again AND d.status = 'running' THEN 0 ELSE done END AS done, CASE WHEN again AND d.status = 'running' THEN 0 ELSE 7 END AS total FROM d JOIN k ON d.job = k.job"""
)
def q41c_recover_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs, docs = j.recover(*jobs_and_docs(spark, d), "job")
    return docs.join(jobs.select("job", F.col("status").alias("job_status")), "job").select("job", "doc", "job_status", "status", "done", "total")


@query(
    """SELECT o_orderkey, format('{:,.2f}', round((o_totalprice / 8)::DECIMAL(18, 6), 2)::DOUBLE) AS amount,
    CASE WHEN o_orderkey % 9 = 0 THEN '—' ELSE format('{:.1f}%', (o_custkey % 201) / 200 * 100) END AS rate FROM orders"""
)
def q19c_amount_text(spark: SparkSession, d: str) -> DataFrame:
    total = F.when(F.col("o_orderkey") % 9 == 0, 0).otherwise(200)
    amount = t.amount_text(F.col("o_totalprice").cast("double") / 8)
    return b.read(spark, d, "orders").select("o_orderkey", amount.alias("amount"), t.percentage(F.col("o_custkey") % 201, total).alias("rate"))


@query(
    """WITH f AS (SELECT o_custkey, o_orderpriority AS template_id, min(o_orderkey) AS first_key FROM orders GROUP BY ALL)
    SELECT o_custkey, string_agg(template_id, '|' ORDER BY first_key) AS template_ids FROM f GROUP BY 1"""
)
def q20b_template_order(spark: SparkSession, d: str) -> DataFrame:
    pairs = b.read(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("template_id"))
    return templates.templates_in_order(pairs, "o_custkey", "o_orderkey").select("o_custkey", F.array_join("template_ids", "|").alias("template_ids"))


@query(
    """WITH m AS (SELECT doc_id, text, n_chars::BIGINT * n_chars * 10 AS ms FROM documents)
    SELECT doc_id, substring(replace(text, chr(10), ' '), 1, 30) AS preview, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN format('{:.2f}s', ms / 1000)
    ELSE (ms // 60000) || 'm ' || format('{:.2f}s', (ms % 60000) / 1000) END AS took FROM m"""
)
def q51c_preview(spark: SparkSession, d: str) -> DataFrame:
    ms = F.col("n_chars").cast("long") * F.col("n_chars") * 10
    return b.read(spark, d, "documents").select("doc_id", t.one_line(F.col("text")).alias("preview"), t.duration(ms).alias("took"))
