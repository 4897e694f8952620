"""Template dimension: which fields a document layout has. A few dozen rows, safe to broadcast."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.functions.values import field_class, let

# Fixed values that results depend on: template, scope, id, key, label.
FIELDS = [
    ("air_waybill", "header", "h1", "invoice_no", "发票号码"),
    ("air_waybill", "header", "h2", "invoice_date", "发票日期"),
    ("air_waybill", "sublist", "c1", "air_waybill_number", "空中运输单编号（Air Waybill Number）"),
    ("air_waybill", "sublist", "c2", "total", "收费（Total）"),
    ("air_waybill_dhl", "header", "dh1", "invoice_no", "发票号码"),
    ("air_waybill_dhl", "header", "dh2", "invoice_date", "发票日期"),
    ("air_waybill_dhl", "sublist", "dc1", "air_waybill_number", "空中运输单编号（Air Waybill Number）"),
    ("air_waybill_dhl", "sublist", "dc2", "total", "收费（Total）"),
    ("freight_invoice", "header", "fh1", "invoice_no", "发票号"),
    ("freight_invoice", "header", "fh2", "invoice_date", "发票日期"),
    ("freight_invoice", "header", "fh3", "packages", "包裹（packages）"),
    ("freight_invoice", "header", "fh4", "volume", "体积（volume）"),
    ("freight_invoice", "header", "fh5", "weight", "重量（weight）"),
    ("freight_invoice", "header", "fh6", "terms", "条款（terms）"),
    ("freight_invoice", "header", "fh7", "incoterm", "国贸条规（incoterm）"),
    ("freight_invoice", "header", "fh8", "supplier", "供应商（supplier）"),
    ("freight_invoice", "header", "fh9", "vessel_voyage_imo", "船舶航行国际海事组织（劳埃德）（VESSEL VOYAGE IMO(LLOYDS)）"),
    ("freight_invoice", "header", "fh10", "house_bill_of_lading", "提单（HOUSE BILL OF LADING）"),
    ("freight_invoice", "header", "fh11", "total_hkd", "合计（TOTAL_HKD）"),
    ("freight_invoice", "sublist", "fc1", "description", "描述（DESCRIPTION）"),
    ("freight_invoice", "sublist", "fc2", "charges_in_hkd", "收费（CHARGES IN HKD）"),
]
TEMPLATES = ["air_waybill", "air_waybill_dhl", "freight_invoice"]
REQUIRED = {"air_waybill": ["air_waybill_number"], "air_waybill_dhl": ["air_waybill_number"], "freight_invoice": ["description"]}
INVOICE_NO = re.compile("invoice.*(no|number)|发票号", re.IGNORECASE)  # over key and label
HEADER_TOTAL_KEYS = ["total_hkd", "total", "grand_total"]
LINE_AMOUNT_KEYS = ["charges_in_hkd", "total", "charges", "amount", "fee"]


def template_fields(spark: SparkSession) -> DataFrame:
    """(template_id, template_pos, scope, pos, field_id, field_key, label, required, field_class)."""
    rows, at = [], {}
    for t, scope, fid, key, label in FIELDS:
        at[t, scope] = at.get((t, scope), 0) + 1
        rows.append((t, TEMPLATES.index(t) + 1, scope, at[t, scope], fid, key, label, key in REQUIRED[t] and scope == "sublist"))
    df = spark.createDataFrame(rows, "template_id string, template_pos int, scope string, pos int, field_id string, field_key string, label string, required boolean")
    return df.withColumn("field_class", field_class(F.col("field_key")))


def templates_as_row(fields: DataFrame) -> DataFrame:
    """One row with the column templates, the templates' ids, places and field keys."""
    each = fields.groupBy("template_id", "template_pos").agg(F.collect_list("field_key").alias("keys"))
    return each.agg(F.collect_list(F.struct("template_id", "template_pos", "keys")).alias("templates"))


def best_template(held: Column, templates: Column) -> Column:
    """The id of infer_template for a document whose distinct field keys are an array."""
    matched = lambda t, v: F.size(F.filter(t["keys"], lambda k: F.array_contains(v["held"], k)))
    score = lambda t, v: F.struct((matched(t, v) / F.size(t["keys"])).alias("share"), (-t["template_pos"]).alias("pos"), t["template_id"].alias("template_id"))
    return F.array_max(let(F.struct(held.alias("held"), templates.alias("of")), lambda v: F.transform(v["of"], lambda t: score(t, v))))["template_id"]


def invoice_no_key(template: str) -> str:
    """Header field that holds the invoice number: by name or label, else the first."""
    header = [f for f in FIELDS if f[0] == template and f[1] == "header"]
    found = [f[3] for f in header if INVOICE_NO.search(f"{f[3]} {f[4]}")]
    return (found or [header[0][3]])[0]


def row_key(template: str) -> str:
    columns = [f[3] for f in FIELDS if f[0] == template and f[1] == "sublist"]
    return (REQUIRED.get(template) or columns)[0]


def infer_template(keys: DataFrame, fields: DataFrame, doc: str) -> DataFrame:
    """keys(doc, field_key) -> (doc, template_id, matched, size): most of a template's fields found,
    the template first in order on a tie. Documents with no known key get the first template."""
    sizes = F.broadcast(fields.groupBy("template_id", "template_pos").agg(F.count(F.lit(1)).alias("size")))
    of = F.broadcast(fields.groupBy("field_key").agg(F.collect_list("template_id").alias("of")))
    held = keys.distinct().join(of, "field_key", "left").groupBy(doc).agg(F.flatten(F.collect_list("of")).alias("of"))
    matched = F.size(F.filter("of", lambda t: t == F.col("template_id"))).cast("long")
    scored = held.crossJoin(sizes).withColumn("matched", matched)  # three rows a document
    best = F.max_by(F.struct("template_id", "matched", "size"), F.struct(F.col("matched") / F.col("size"), -F.col("template_pos")))
    return scored.groupBy(doc).agg(best.alias("b")).select(doc, "b.template_id", "b.matched", "b.size")


def templates_in_order(pairs: DataFrame, by: str, pos: str) -> DataFrame:
    """pairs(by, pos, template_id) -> (by, template_ids): the distinct templates as they first appear; null is one of them."""
    first = pairs.groupBy(by, "template_id").agg(F.min(pos).alias("at"))
    each = F.array_sort(F.collect_list(F.struct("at", "template_id")))
    return first.groupBy(by).agg(F.transform(each, lambda x: x["template_id"]).alias("template_ids"))
