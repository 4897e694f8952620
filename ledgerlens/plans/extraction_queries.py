"""Queries of page fold, votes, totals, labelling batches, jobs and names (q24 to q48)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerlens.functions import text as t, values as v
from ledgerlens.operators import jobs as j, pages as p
from ledgerlens.operators.documents import annotated
from ledgerlens.operators.tasks import dealt
from . import bridge as b, oracle as o
from .report_queries import PATHS, query

POS = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {b.LINE_ORDER})"
NUMBER = "case when l_linenumber % 3 = 0 then '' else concat('inv ', cast(l_suppkey % 3 as string)) end"
ENTRIES = f"e AS (SELECT l_orderkey, {POS} AS pos, upper(replace({o.duck(NUMBER)}, ' ', '')) AS no, l_quantity > 25 AS hv, l_linenumber % 2 = 1 AS ls, l_partkey % 3 AS weight FROM lineitem)"


def entries(spark: SparkSession, d: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*b.LINE_ORDER.split(", ")))
    (li,) = dealt("l_orderkey", b.read(spark, d, "lineitem"))
    return li.select("l_orderkey", pos.alias("pos"), F.expr(NUMBER).alias("no"), (F.col("l_quantity") > 25).alias("has_header"), (F.col("l_linenumber") % 2 == 1).alias("has_lines"), (F.col("l_partkey") % 3).alias("weight"))


@query(
    f"""WITH {ENTRIES}, f AS (SELECT *, min(pos) OVER (PARTITION BY l_orderkey, no) AS first_pos FROM e),
    g AS (SELECT *, CASE WHEN no <> '' THEN pos = first_pos ELSE hv END AS base FROM f),
    h AS (SELECT *, no = '' AND NOT hv AND ls AND NOT coalesce(bool_or(base) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS loose FROM g),
    i AS (SELECT *, base OR (loose AND row_number() OVER (PARTITION BY l_orderkey, loose ORDER BY pos) = 1) AS created FROM h)
    SELECT l_orderkey, pos::INT AS pos, created, (CASE WHEN no <> '' THEN first_pos ELSE max(CASE WHEN created THEN pos END) OVER (PARTITION BY l_orderkey ORDER BY pos) END)::INT AS inv_id FROM i"""
)
def q24_page_fold(spark: SparkSession, d: str) -> DataFrame:
    return p.fold_pages(entries(spark, d), "l_orderkey").select("l_orderkey", "pos", "created", "inv_id")


@query(
    f"""WITH {ENTRIES}, c AS (SELECT l_orderkey, no, sum(greatest(1, weight))::BIGINT AS votes, min(pos) AS first_pos FROM e WHERE no <> '' GROUP BY ALL)
    SELECT l_orderkey, no AS winner, votes FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, first_pos) = 1"""
)
def q26_majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return p.majority_number(entries(spark, d), "l_orderkey")


@query(
    f"""WITH {ENTRIES}, h AS (SELECT e.l_orderkey, e.pos, no, CASE WHEN hv THEN concat('F', weight) ELSE '' END AS terms, CASE WHEN ls THEN '' ELSE cast(e.pos AS VARCHAR) END AS packages FROM e),
    c AS (SELECT l_orderkey, no, sum(greatest(1, weight)) AS votes, min(pos) AS first_pos FROM e WHERE no <> '' GROUP BY ALL),
    w AS (SELECT l_orderkey, no AS winner, first_pos FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, first_pos) = 1),
    o AS (SELECT h.*, winner, coalesce(h.pos = coalesce(first_pos, 1), false) AS base FROM h LEFT JOIN w USING (l_orderkey))
    SELECT l_orderkey, coalesce(max(CASE WHEN winner IS NOT NULL THEN concat(lower(substr(winner, 1, 3)), ' ', substr(winner, 4)) END), '') AS invoice_no,
      coalesce(arg_min(terms, CASE WHEN base THEN 0 ELSE pos END) FILTER (terms <> ''), '') AS terms, coalesce(arg_min(packages, CASE WHEN base THEN 0 ELSE pos END) FILTER (packages <> ''), '') AS packages,
      string_agg(pos::VARCHAR, ',' ORDER BY CASE WHEN base THEN 0 ELSE pos END) AS lines FROM o GROUP BY 1"""
)
def q27_majority_merge(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d)
    header = {"invoice_no": F.col("no"), "terms": F.when(F.col("has_header"), F.concat(F.lit("F"), F.col("weight").cast("string"))).otherwise(""), "packages": F.when(F.col("has_lines"), "").otherwise(F.col("pos").cast("string"))}
    invoices = e.select("l_orderkey", "pos", F.create_map(*[x for k, c in header.items() for x in (F.lit(k), c)]).alias("header"), F.array(F.create_map(F.lit("line"), F.col("pos").cast("string"))).alias("sublist"))
    merged = p.merge_by_majority(invoices, p.majority_number(e, "l_orderkey"), "l_orderkey", "invoice_no")
    lines = F.array_join(F.transform("sublist", lambda x: x["line"]), ",").alias("lines")
    return merged.select("l_orderkey", *[F.coalesce(F.col("header")[k], F.lit("")).alias(k) for k in header], lines)


@query(
    """WITH n AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n, count(l_orderkey) > 0 AS has FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 3 GROUP BY 1)
    SELECT o_custkey, n AS invoices, CASE WHEN has THEN CASE WHEN n > 1 THEN 'multi_invoice_with_sublist' ELSE 'invoice_with_sublist' END WHEN n > 1 THEN 'multi_invoice' ELSE 'single' END AS structure FROM n"""
)
def q29_structure_type(spark: SparkSession, d: str) -> DataFrame:
    lines = b.read(spark, d, "lineitem").filter("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("has")).distinct()
    n = b.read(spark, d, "orders").select("o_custkey", "o_orderkey").join(lines, "o_orderkey", "left").groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("invoices"), F.coalesce(F.bool_or("has"), F.lit(False)).alias("has"))
    return n.select("o_custkey", "invoices", p.structure_type(F.col("invoices"), F.col("has")).alias("structure"))


MARKED = "SELECT d.doc_id, source, CASE quality WHEN 1 THEN 'target' WHEN 0 THEN 'non_target' END AS category, coalesce(quality = 0 OR quality = 1 AND (lang IS NOT NULL OR (d.doc_id % 4 >= 2 AND d.doc_id % 5 = 0)), false) AS annotated FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
STRUCTURE = "element_at(array('single', 'multi_invoice', 'invoice_with_sublist', 'multi_invoice_with_sublist'), cast(doc_id % 4 as int) + 1)"


def marked(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = b.read(spark, d, "documents"), b.read(spark, d, "labels").select("doc_id", "quality")
    category = F.when(F.col("quality") == 1, "target").when(F.col("quality") == 0, "non_target")
    values = F.create_map(F.lit("fh1"), F.coalesce("lang", F.lit(" ")))  # a language, or blank, under any structure
    rows = F.array(F.create_map(F.lit("fc1"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise("")))
    done = annotated(category, F.expr(STRUCTURE), values, values, rows, F.array(F.struct(values.alias("header"), rows.alias("rows"))))
    return docs.select("doc_id", "source", "lang").join(labels, "doc_id", "left").select("doc_id", "source", category.alias("category"), done.alias("annotated"))


@query(
    f"""SELECT source, count(*) AS total, count(*) FILTER (category = 'target') AS target, count(*) FILTER (category = 'non_target') AS non_target,
    count(*) FILTER (category IS NULL) AS unclassified, count(*) FILTER (annotated) AS annotated FROM ({MARKED}) GROUP BY 1"""
)
def q31_batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return p.batch_summary(marked(spark, d), "source")


@query(f"SELECT doc_id FROM ({MARKED}) WHERE category IS NULL")
def q32_category_filter(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).filter(F.col("category").isNull()).select("doc_id")


HEAD = f"case when o_orderkey % 7 = 0 then null else {b.money(b.TOTAL)} end"


@query(
    f"""WITH s AS (SELECT l_orderkey, sum(cast(round({o.amount(o.duck(b.ANSWER_LINE['charges_in_hkd']))} * 100) AS BIGINT))::BIGINT AS cents FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(cents, 0) / 100.0::DOUBLE AS line_total, abs(coalesce(cents, 0) / 100.0::DOUBLE - try_cast(({o.duck(HEAD)}) AS DOUBLE)) < 0.005 AS balanced FROM orders LEFT JOIN s ON l_orderkey = o_orderkey"""
)
def q33_reconcile_totals(spark: SparkSession, d: str) -> DataFrame:
    heads = b.read(spark, d, "orders").select("o_orderkey", F.expr(HEAD).try_cast("double").alias("total"))
    lines = b.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), v.parse_amount(F.expr(b.ANSWER_LINE["charges_in_hkd"])).alias("amount"))
    return p.reconcile(heads, lines, "o_orderkey").select("o_orderkey", "line_total", "balanced")


STATUS = "case event_id % 4 when 0 then 'queued' when 1 then 'running' when 2 then 'done' else 'failed' end"
EVENTS = f"v AS (SELECT user_id, ts, event_id, {STATUS} AS status FROM events)"


def job_events(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "events").select("user_id", "ts", "event_id", F.expr(STATUS).alias("status"))


@query(f"WITH {EVENTS}, l AS (SELECT user_id, arg_max(status, (ts, event_id)) AS status, min((ts, event_id)) AS made FROM v GROUP BY 1) SELECT user_id, status FROM l WHERE status IN ('queued', 'running') ORDER BY made LIMIT 1")
def q40_queue_next(spark: SparkSession, d: str) -> DataFrame:
    return j.queue_next(job_events(spark, d), "user_id")


@query(f"WITH {EVENTS} SELECT user_id, arg_max(status, (ts, event_id)) AS status, count(*) AS n_events FROM v GROUP BY 1")
def q41_job_state(spark: SparkSession, d: str) -> DataFrame:
    return j.job_state(job_events(spark, d), "user_id").select("user_id", "status", "n_events")


@query(f"WITH {EVENTS} SELECT user_id, count(*) FILTER (status = 'done') AS done, count(*) AS total FROM v GROUP BY 1")
def q42_progress(spark: SparkSession, d: str) -> DataFrame:
    return j.progress(job_events(spark, d), "user_id")


@query(f"WITH {EVENTS} SELECT user_id, event_id, lag(event_id) OVER w AS prev_id, lead(event_id) OVER w AS next_id FROM v WHERE status = 'done' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q43_prev_next(spark: SparkSession, d: str) -> DataFrame:
    return j.neighbours(job_events(spark, d), "user_id")


CONFIDENCE = "case doc_id % 5 when 0 then null when 1 then cast(1.7 as double) when 2 then cast(-0.2 as double) else cast(doc_id % 100 as double) / 100 end"


@query(f"WITH c AS (SELECT doc_id, quality, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce({CONFIDENCE}, 0.5::DOUBLE))) AS confidence FROM labels) SELECT doc_id, confidence, quality <> 1 AND confidence >= 0.8 AS skip FROM c")
def q47_classify_skip(spark: SparkSession, d: str) -> DataFrame:
    out = b.read(spark, d, "labels").withColumn("confidence", p.confidence(F.expr(CONFIDENCE)))
    return out.select("doc_id", "confidence", p.skips(F.col("quality") == 1, F.col("confidence"), 0.8).alias("skip"))


_FILE = PATHS.replace("\\\\", "\\")


@query(
    f"""SELECT c_custkey, CASE WHEN regexp_matches({_FILE}, '(?i)\\.pdf$') THEN regexp_replace({_FILE}, '(?i)\\.pdf$', '.json') ELSE concat({_FILE}, '.json') END AS export_name,
    substr(regexp_replace({_FILE}, '[^0-9A-Za-z_一-龥-]+', '_', 'g'), 1, 40) AS safe_name FROM customer"""
)
def q48_export_names(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "customer").select("c_custkey", t.export_name(F.expr(PATHS)).alias("export_name"), t.safe_name(F.expr(PATHS)).alias("safe_name"))
