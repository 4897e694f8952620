"""Queries of value rules and of the accuracy report (q01 to q20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.functions import values as v
from ledgerlens.operators.accuracy import pair_documents, unmatched_answers, unmatched_results
from ledgerlens.operators.templates import FIELDS, TEMPLATES, infer_template, template_fields
from . import bridge as b, oracle as o

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return keep


MESSY = "case p_partkey % 5 when 0 then concat(' ', p_name, ' － x / y ') when 1 then concat(p_name, '，', p_brand) when 2 then concat(p_brand, ' — ', p_name) when 3 then concat('　', p_name, '/ ', p_type) else p_type end"


@query(f"SELECT p_partkey, {o.norm(MESSY)} AS norm FROM part UNION ALL SELECT doc_id, {o.norm('text')} FROM documents WHERE text IS NOT NULL")
def q01_norm_text(spark: SparkSession, d: str) -> DataFrame:
    part = b.read(spark, d, "part").select("p_partkey", v.norm_text(F.expr(MESSY)).alias("norm"))
    return part.union(b.read(spark, d, "documents").filter("text is not null").select("doc_id", v.norm_text(F.col("text"))))


PATHS = "case c_custkey % 4 when 0 then concat('a/b/', c_name, '.PDF.json') when 1 then concat('a\\\\', c_name, '.pdf') when 2 then concat(c_name, '.json.pdf') else concat(' ', c_name, ' ') end"


@query("SELECT c_custkey, " + o.match_key(PATHS.replace("\\\\", "\\")) + " AS match_key FROM customer")
def q02_match_key(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "customer").select("c_custkey", v.match_key(F.expr(PATHS)).alias("match_key"))


PRICES = f"case o_orderkey % 5 when 0 then concat('HKD ', {b.grouped_money(b.TOTAL)}) when 1 then concat('INV-', cast(o_orderkey as string)) when 2 then concat({b.money(b.TOTAL)}, '.1') when 3 then 'n/a' else concat('--', {b.money(b.TOTAL)}) end"


@query(f"SELECT o_orderkey, {o.amount(o.duck(PRICES))} AS amount FROM orders")
def q03_parse_amount(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "orders").select("o_orderkey", v.parse_amount(F.expr(PRICES)).alias("amount"))


LINE_A, LINE_R = b.ANSWER_LINE["charges_in_hkd"], b.RESULT_LINE["charges_in_hkd"]


@query(f"SELECT l_linenumber, count(*) AS n, sum(CASE WHEN abs({o.amount(o.duck(LINE_A))} - {o.amount(o.duck(LINE_R))}) < 0.005 THEN 1 ELSE 0 END)::BIGINT AS same FROM lineitem GROUP BY 1")
def q04_amount_match(spark: SparkSession, d: str) -> DataFrame:
    same = v.amounts_match(v.parse_amount(F.expr(LINE_A)), v.parse_amount(F.expr(LINE_R)))
    return b.read(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same"))


QTY = "concat(cast(cast(l_quantity as bigint) as string), '.50')"
QA = f"concat({QTY}, ' KG')"
QR = f"case l_partkey % 4 when 0 then concat({QTY}, '0kg') when 1 then {QTY} when 2 then concat({QTY}, ' LB') else 'none' end"


@query(f"SELECT l_partkey % 4 AS form, count(*) AS n, sum(CASE WHEN {o.measures_equal(o.duck(QA), o.duck(QR))} THEN 1 ELSE 0 END)::BIGINT AS same FROM lineitem GROUP BY 1")
def q05_measure_equal(spark: SparkSession, d: str) -> DataFrame:
    same = v.field_equal(F.lit("measure"), F.expr(QA), F.expr(QR))
    return b.read(spark, d, "lineitem").groupBy((F.col("l_partkey") % 4).alias("form")).agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same"))


DATES = f"case when o_orderkey % 9 = 0 then '30 Feb 2025' when o_orderkey % 9 = 1 then '01/13/25' when o_orderkey % 9 = 2 then concat({b.DAY}, '-', {b.MON}, '-', substr({b.YEAR}, 3)) else {b.FORMS} end"


@query(f"WITH t AS (SELECT o_orderkey, {o.norm(o.duck(DATES))} AS x FROM orders) SELECT o_orderkey, {o.date('x')} AS iso FROM t")
def q06_parse_date(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "orders").select("o_orderkey", v.parse_date(F.expr(DATES)).alias("iso"))


_KEYS = list(b.ANSWER_INV)


@query(
    "WITH t AS (SELECT o_orderkey, f.field_key, " + o.norm("CASE f.field_key " + " ".join(f"WHEN '{k}' THEN {o.duck(e)}" for k, e in b.ANSWER_INV.items()) + " END") + " AS ne, "
    + o.norm("CASE f.field_key " + " ".join(f"WHEN '{k}' THEN {o.duck(e)}" for k, e in b.RESULT_INV.items()) + " END")
    + f" AS na FROM orders CROSS JOIN (VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k in _KEYS)}) AS f(field_key)) SELECT o_orderkey, field_key, {o.equal('field_key', 'ne', 'na')} AS equal FROM t"
)
def q07_field_equal(spark: SparkSession, d: str) -> DataFrame:
    one = lambda k: F.struct(F.lit(k).alias("field_key"), v.field_equal(v.field_class(F.lit(k)), F.expr(b.ANSWER_INV[k]), F.expr(b.RESULT_INV[k])).alias("equal"))
    return b.read(spark, d, "orders").select("o_orderkey", F.explode(F.array(*map(one, _KEYS))).alias("x")).select("o_orderkey", "x.field_key", "x.equal")


_FIELD_ROWS = ", ".join(f"('{t}', '{s}', '{i}', '{k}')" for t, s, i, k, _ in FIELDS)


#: Field keys made of a part's type and, by its size, of what gives a field its class.
KEY = "lower(concat(case p_size % 8 when 0 then 'gross_weight_' when 1 then 'vol_' when 2 then 'netweight_' else '' end, replace(p_type, ' ', '_'), case p_size % 8 when 3 then '_Date' when 4 then '_total' else '' end))"
KEYS = f"case p_size % 8 when 5 then 'total' when 6 then 'weight' else {KEY} end"


@query(
    f"""SELECT p_partkey, {KEYS} AS field_key, CASE WHEN {KEYS} IN ('total', 'charges_in_hkd', 'total_hkd') THEN 'amount'
    WHEN {KEYS} IN ('weight', 'volume') OR regexp_matches({KEYS}, '^(gross_|net_|chargeable_)?(weight|volume|wt|vol)(_|$)', 'i') THEN 'measure' WHEN {KEYS} ILIKE '%date%' THEN 'date' ELSE 'text' END AS field_class FROM part"""
)
def q08_field_class(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "part").select("p_partkey", F.expr(KEYS).alias("field_key")).withColumn("field_class", v.field_class(F.col("field_key")))


@query(f"WITH {o.DOCS} SELECT match_key, a_doc, r_doc FROM pairs")
def q09_pair_docs(spark: SparkSession, d: str) -> DataFrame:
    return pair_documents(b.side(spark, d, False).docs, b.side(spark, d, True).docs).select("match_key", "a_doc", "r_doc")


@query(f"WITH {o.DOCS} SELECT file_name FROM a_docs WHERE match_key NOT IN (SELECT match_key FROM r_docs)")
def q10_unmatched_answers(spark: SparkSession, d: str) -> DataFrame:
    return unmatched_answers(b.side(spark, d, False).docs, b.side(spark, d, True).docs).select("file_name")


@query(f"WITH {o.DOCS} SELECT file_name FROM r_docs WHERE match_key NOT IN (SELECT match_key FROM a_docs)")
def q11_unmatched_results(spark: SparkSession, d: str) -> DataFrame:
    return unmatched_results(b.side(spark, d, False).docs, b.side(spark, d, True).docs).select("file_name")


@query(f"WITH {o.INVOICES} SELECT a_doc, inv_idx::INT AS inv_idx, a_pos AS a_inv, r_pos AS r_inv FROM inv")
def q12_align_invoices(spark: SparkSession, d: str) -> DataFrame:
    return b.report(spark, d, rows=False).invoices.select("a_doc", "inv_idx", "a_inv", "r_inv")


@query(f"WITH {o.ROWS} SELECT a_doc, inv_idx::INT AS inv_idx, a_row::INT AS a_row, r_row::INT AS r_row FROM rowal")
def q13_align_rows(spark: SparkSession, d: str) -> DataFrame:
    return b.report(spark, d).rows.select("a_doc", "inv_idx", "a_row", "r_row")


@query(f"WITH {o.INVOICES} SELECT a_doc, inv_idx::INT AS inv_idx, field_key, expected, actual, equal FROM hcells")
def q14_field_cells(spark: SparkSession, d: str) -> DataFrame:
    return b.report(spark, d, rows=False).header_cells().select("a_doc", "inv_idx", "field_key", "expected", "actual", "equal")


@query(f"WITH {o.INVOICES} SELECT template_id, field_key, field_pos::INT AS field_pos, count(*) AS total, count(*) FILTER (equal) AS correct FROM hcells GROUP BY ALL")
def q15_header_stats(spark: SparkSession, d: str) -> DataFrame:
    r = b.report(spark, d, rows=False)
    return r.field_stats(r.header_cells()).select("template_id", "field_key", "field_pos", "total", "correct")


@query(f"WITH {o.ROWS} SELECT template_id, field_key, field_pos::INT AS field_pos, count(*) AS total, count(*) FILTER (equal) AS correct FROM scells GROUP BY ALL")
def q16_sublist_stats(spark: SparkSession, d: str) -> DataFrame:
    r = b.report(spark, d)
    return r.field_stats(r.sublist_cells()).select("template_id", "field_key", "field_pos", "total", "correct")


@query(f"WITH {o.ROWS} SELECT a_doc, inv_idx::INT AS inv_idx, row_idx::INT AS row_idx, kind, field_key, expected, actual FROM errors")
def q17_error_details(spark: SparkSession, d: str) -> DataFrame:
    return b.report(spark, d).errors().select("a_doc", "inv_idx", "row_idx", "kind", "field_key", "expected", "actual")


_SUMS = "sum(answer_rows)::BIGINT AS answer_rows, sum(matched_rows)::BIGINT AS matched_rows, sum(missing_rows)::BIGINT AS missing_rows, sum(extra_rows)::BIGINT AS extra_rows"


@query(
    f"""WITH {o.ROWS}, n AS (SELECT a_doc, {_SUMS} FROM invrows GROUP BY 1), bad AS (SELECT DISTINCT a_doc AS bad FROM errors)
    SELECT template_id, count(*) AS doc_total, count(*) FILTER (bad IS NULL) AS all_correct, {", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in ("answer_rows", "matched_rows", "missing_rows", "extra_rows"))}
    FROM pairs LEFT JOIN n ON n.a_doc = pairs.a_doc LEFT JOIN bad ON bad = pairs.a_doc GROUP BY 1"""
)
def q18_template_stats(spark: SparkSession, d: str) -> DataFrame:
    return b.report(spark, d).template_stats()


@query(
    f"""WITH {o.ROWS} SELECT (SELECT count(*) FROM pairs) AS matched_pairs, (SELECT count(*) FROM pairs WHERE a_doc NOT IN (SELECT a_doc FROM errors)) AS doc_all_correct,
    (SELECT count(*) FROM a_docs WHERE match_key NOT IN (SELECT match_key FROM r_docs)) AS unmatched_answers,
    (SELECT count(*) FROM r_docs WHERE match_key NOT IN (SELECT match_key FROM a_docs)) AS unmatched_results"""
)
def q19_report_totals(spark: SparkSession, d: str) -> DataFrame:
    a, r = b.side(spark, d, False).docs, b.side(spark, d, True).docs
    stats = b.report(spark, d).template_stats().agg(F.sum("doc_total").alias("matched_pairs"), F.sum("all_correct").alias("doc_all_correct"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return stats.crossJoin(one(unmatched_answers(a, r), "unmatched_answers")).crossJoin(one(unmatched_results(a, r), "unmatched_results"))  # single rows


_INFER = "CASE o_orderkey % 3 WHEN 0 THEN 'invoice_no,total' WHEN 1 THEN 'packages,weight,terms,description' ELSE 'other' END"


@query(
    f"""WITH k AS (SELECT DISTINCT o_custkey, unnest(string_split({_INFER}, ',')) AS field_key FROM orders),
    f AS (SELECT * FROM (VALUES {_FIELD_ROWS}) AS f(template_id, scope, field_id, field_key)),
    n AS (SELECT template_id, count(*) AS size FROM f GROUP BY 1),
    s AS (SELECT c.o_custkey, n.template_id, size, (SELECT count(*) FROM k JOIN f USING (field_key) WHERE k.o_custkey = c.o_custkey AND f.template_id = n.template_id) AS matched
          FROM (SELECT DISTINCT o_custkey FROM k) c CROSS JOIN n)
    SELECT o_custkey, template_id, matched, size FROM s
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY matched / size DESC, list_position({TEMPLATES!r}, template_id)) = 1"""
)
def q20_infer_template(spark: SparkSession, d: str) -> DataFrame:
    keys = b.read(spark, d, "orders").select("o_custkey", F.explode(F.split(F.expr(_INFER), ",")).alias("field_key"))
    return infer_template(keys, template_fields(spark), "o_custkey")
