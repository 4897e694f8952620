"""Business documents derived from the star-schema tables, as DataFrames and as oracle SQL.

A document is a customer, an invoice an order, a line a lineitem. The result side is the answer
side with integer-modulus damage: documents, invoices and lines dropped, added or changed, and
values written in other forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.functions.values import match_key
from ledgerlens.operators.accuracy import Report, Side, pair_documents
from ledgerlens.operators.templates import template_fields

LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', (month(o_orderdate) - 1) * 3 + 1, 3)"
ISO = "concat(cast(year(o_orderdate) as string), '-', lpad(cast(month(o_orderdate) as string), 2, '0'), '-', lpad(cast(day(o_orderdate) as string), 2, '0'))"
DAY, YEAR = "cast(day(o_orderdate) as string)", "cast(year(o_orderdate) as string)"
FORMS = f"""case o_orderkey % 4 when 0 then concat({DAY}, ' ', {MON}, ' ', {YEAR})
  when 1 then concat(lpad({DAY}, 2, '0'), '/', lpad(cast(month(o_orderdate) as string), 2, '0'), '/', {YEAR})
  when 2 then concat({YEAR}, '年', cast(month(o_orderdate) as string), '月', {DAY}, '日')
  else concat({MON}, ' ', {DAY}, ', ', {YEAR}) end"""
CENTS = "cast(round({x} * 100) as bigint)"


def money(cents: str) -> str:
    return f"concat(cast(cast(floor(({cents}) / 100) as bigint) as string), '.', lpad(cast(({cents}) % 100 as string), 2, '0'))"


def grouped_money(cents: str) -> str:
    whole = f"cast(floor(({cents}) / 100) as bigint)"
    return f"case when {whole} >= 1000 then concat(cast(cast(floor({whole} / 1000) as bigint) as string), ',', lpad(cast({whole} % 1000 as string), 3, '0'), '.', lpad(cast(({cents}) % 100 as string), 2, '0')) else {money(cents)} end"


TOTAL = CENTS.format(x="o_totalprice")
CHARGE = CENTS.format(x="l_extendedprice")
NO = "concat('INV-', lpad(cast(o_orderkey as string), 8, '0'))"

# Each text is valid for both engines once `string` is a type name; used by DataFrames through expr().
ANSWER_DOC = {"file_name": "concat(c_name, '.pdf')"}
RESULT_DOC = {"file_name": "case when c_custkey % 19 = 0 then concat('X-', c_name, '.json') else concat('out/', c_name, '.PDF.json') end"}
RESULT_KEEP = "c_custkey % 17 <> 0"
ANSWER_INV = {"invoice_no": NO, "invoice_date": ISO, "total_hkd": f"concat('HKD ', {money(TOTAL)})", "terms": "o_orderpriority", "packages": "cast(o_orderkey % 90 as string)"}
RESULT_INV = {
    "invoice_no": f"case when o_orderkey % 11 = 0 then concat('Z', substr({NO}, 2)) when o_orderkey % 9 = 0 then concat(substr({NO}, 1, 8), ' ', substr({NO}, 9)) when o_orderkey % 5 = 0 then concat(' ', replace(lower({NO}), '-', ' － ')) else {NO} end",
    "invoice_date": FORMS,
    "total_hkd": grouped_money(f"{TOTAL} + (case when o_orderkey % 23 = 0 then 1 else 0 end)"),
    "terms": "case when o_orderkey % 3 = 0 then lower(replace(o_orderpriority, '-', ' － ')) else o_orderpriority end",
    "packages": "case when o_orderkey % 31 = 0 then '' else cast(o_orderkey % 90 as string) end",
}
RESULT_INV_KEEP = "o_orderkey % 13 <> 0"
ANSWER_LINE = {"description": "concat('PART / ', cast(l_partkey as string))", "charges_in_hkd": money(CHARGE)}
RESULT_LINE = {
    "description": "case when l_partkey % 37 = 0 then '' else concat('part/', cast(l_partkey as string)) end",
    "charges_in_hkd": grouped_money(f"{CHARGE} + (case when l_partkey % 10 = 0 then 100 else 0 end)"),
}
#: Documents by customer: three fifths name their columns as waybills do. Some results and some answers say their template, one in 25
#: says one that is not known; the others leave it to be inferred from the fields that they hold.
WAYBILL = "c_custkey % 5 < 3"
RESULT_TEMPLATE = "case when c_custkey % 25 = 8 then 'old' when c_custkey % 5 = 0 then 'air_waybill' when c_custkey % 5 = 3 then 'freight_invoice' end"
ANSWER_TEMPLATE = "case when c_custkey % 5 = 1 then 'air_waybill_dhl' end"
RESULT_LINE_KEEP = "(l_orderkey + l_linenumber) % 7 <> 0"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _map(values: dict[str, str]):
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.expr(e) for e in values.values()]))


def side(spark: SparkSession, sf_dir: str, result: bool) -> Side:
    """One side. Orders, customers and lines are joined in the same way for both, with what a side drops left out
    only afterwards, so that one shuffle of each table serves both."""
    c, o, li = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    doc, inv, line = (RESULT_DOC, RESULT_INV, RESULT_LINE) if result else (ANSWER_DOC, ANSWER_INV, ANSWER_LINE)
    docs = c.filter(RESULT_KEEP) if result else c
    docs = docs.select(F.col("c_custkey").alias("doc_pos"), F.expr(doc["file_name"]).alias("file_name"), F.expr(RESULT_TEMPLATE if result else ANSWER_TEMPLATE).alias("template_id"))
    docs = docs.withColumn("match_key", match_key(F.col("file_name")))

    texts = [F.expr(e).alias(f"{p}{k}") for p, of in (("a", ANSWER_LINE), ("r", RESULT_LINE)) for k, e in enumerate(of.values())]
    lines = li.select("l_orderkey", F.struct(*LINE_ORDER.split(", "), *texts).alias("x")).groupBy("l_orderkey").agg(F.collect_list("x").alias("lines"))
    orders = o.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority").join(c.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    held = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("lines", F.sort_array("lines"))
    if result:
        kept = RESULT_LINE_KEEP.replace("l_linenumber", "x.l_linenumber")
        held = held.withColumn("lines", F.expr(f"filter(lines, x -> {kept})"))
    said = "r" if result else "a"
    cells = lambda x, names: F.create_map(*[y for k, n in enumerate(names) for y in (F.lit(n), x[f"{said}{k}"])])
    rows = lambda names: F.transform("lines", lambda x, i: F.struct((i + 1).alias("row_pos"), cells(x, names).alias("cells")))
    plain, named = rows(list(line)), rows(["air_waybill_number", "total"])
    sublist = F.when(F.size("lines") > 0, F.when(F.expr(WAYBILL), named).otherwise(plain))
    key = match_key(F.expr(doc["file_name"]))
    one = lambda pos, header, sublist: F.struct(pos.alias("inv_pos"), header.alias("header"), sublist.alias("sublist"))
    itself = one(F.col("o_orderkey"), _map(inv), sublist)
    copies = F.array(itself)
    if result:  # some invoices come twice, under another number and without rows
        other = _map({"invoice_no": "'ADDED000001'"} | {k: v for k, v in inv.items() if k != "invoice_no"})
        again = one(F.col("o_orderkey") + 1_000_000_000, other, F.lit(None).cast("array<struct<row_pos int, cells map<string, string>>>"))
        keep = F.expr(f"({RESULT_KEEP}) and ({RESULT_INV_KEEP})")
        copies = F.when(keep, F.when(F.col("o_orderkey") % 29 == 0, F.array(itself, again)).otherwise(copies))
    return Side(docs, held.select(key.alias("match_key"), F.col("o_custkey").alias("doc_pos"), F.explode(copies).alias("x")).select("match_key", "doc_pos", "x.*"))


def report(spark: SparkSession, sf_dir: str, rows: bool = True) -> Report:
    """The report of both sides. Without ``rows`` the invoices carry their headers and the field keys of their rows only,
    as templates are still inferred from these."""
    a, r = side(spark, sf_dir, False), side(spark, sf_dir, True)
    if not rows:
        keys = F.array_distinct(F.flatten(F.transform("sublist", lambda x: F.map_keys(x["cells"]))))
        a, r = (Side(s.docs, s.invoices.withColumn("held", keys).withColumn("sublist", F.lit(None).cast(s.invoices.schema["sublist"].dataType))) for s in (a, r))
    return Report(pair_documents(a.docs, r.docs), a, r, template_fields(spark))
