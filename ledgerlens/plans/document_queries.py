"""Queries of documents, requests, replies and OCR blocks (q19b to q58b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.functions import requests as r
from ledgerlens.operators import documents as dc, jobs as j
from ledgerlens.operators.templates import FIELDS
from . import bridge as b, oracle as o
from .extraction_queries import EVENTS, job_events
from .report_queries import query


def fields(template: str, scope: str) -> Column:
    return F.array(*[F.struct(F.lit(f[2]).alias("field_id"), F.lit(f[3]).alias("field_key")) for f in FIELDS if f[:2] == (template, scope)])


def cells(**values) -> Column:
    return F.create_map(*[x for k, c in values.items() for x in (F.lit(k), c)])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_custkey % 201 >= 199 THEN 'rate-good' WHEN o_custkey % 201 >= 180 THEN 'rate-warn' ELSE 'rate-bad' END AS class FROM orders")
def q19b_rate_class(spark: SparkSession, d: str) -> DataFrame:
    total = F.when(F.col("o_orderkey") % 9 == 0, 0).otherwise(200)
    return b.read(spark, d, "orders").select("o_orderkey", r.rate_class(F.col("o_custkey") % 201, total).alias("class"))


@query(f"WITH {EVENTS} SELECT user_id, arg_min(event_id, (CASE WHEN status = 'done' THEN 0 ELSE 1 END, event_id)) AS shown, min(event_id) FILTER (status IN ('queued', 'running')) AS next FROM v GROUP BY 1")
def q43b_open_document(spark: SparkSession, d: str) -> DataFrame:
    docs = job_events(spark, d).select("user_id", F.col("event_id").alias("pos"), F.col("event_id").alias("id"), "status")
    return j.open_document(docs, "user_id")


REPLIES = ['{"is_target": null}', 'ok ```json\n{"invoices": []}``` end', '{"invoices": {}}', '{"is_target": true, "confidence": 0.5}', '{"is_target": true, "confidence": "1"}', '{"system_prompt": "a", "user_prompt": "b"}', '{"classification_hints": []}', '{"system_prompt": "a"', "[1]"]
COMPLETE = {"extract": (0, 1, 3, 4), "classify": (3,), "optimize": (5, 6)}
PROFILES = " UNION ALL ".join(f"SELECT '{p}' AS profile, {list(ok)} AS ok" for p, ok in COMPLETE.items())


@query(f"SELECT c_custkey, profile, list_contains(ok, (c_custkey % 9)::INT) AS complete FROM customer, ({PROFILES})")
def q46b_complete_replies(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("c_custkey") % 9).cast("int") + 1)
    each = [F.struct(F.lit(p).alias("profile"), r.complete_reply(text, p).alias("complete")) for p in COMPLETE]
    return b.read(spark, d, "customer").select("c_custkey", F.inline(F.array(*each)))


IMAGE = "case p_partkey % 3 when 0 then concat(p_name, '.PDF') when 1 then '.pdf' else p_name end"


@query(
    """SELECT p_partkey, concat(CASE p_partkey % 3 WHEN 1 THEN 'document' ELSE p_name END, '-model-input-p', p_size, '-', p_partkey % 100, 'x7.jpg') AS image,
    least(2.5::DOUBLE, 1600::DOUBLE / greatest(p_size * 100, p_partkey % 1000 + 1)) AS scale FROM part"""
)
def q48b_page_image(spark: SparkSession, d: str) -> DataFrame:
    name = r.page_image_name(F.expr(IMAGE), F.col("p_size"), F.col("p_partkey") % 100, F.lit(7))
    return b.read(spark, d, "part").select("p_partkey", name.alias("image"), r.page_scale(F.col("p_size") * 100, F.col("p_partkey") % 1000 + 1).alias("scale"))


SAMPLES = [("a.txt", b"%PDF-1.7"), ("B.PDF", b"PK"), ("a", b"\xff\xd8\xff\xe0"), ("x.jpeg", b""), ("p", b"\x89PNG\r\n\x1a\n."), ("w", b"RIFF1234WEBP"), ("w", b"RIFF1234WAVE"), ("a.webp.gz", b"\x1f\x8b")]


@query("SELECT page_id, ['pdf', 'pdf', 'jpg', 'jpg', 'png', 'webp', NULL, NULL][page_id % 8 + 1] AS kind, CASE page_id % 8 WHEN 1 THEN 'pdf' ELSE 'image' END AS media FROM pages")
def q49b_sample_type(spark: SparkSession, d: str) -> DataFrame:
    samples = F.array(*[F.struct(F.lit(n).alias("name"), F.unhex(F.lit(head.hex())).alias("head")) for n, head in SAMPLES])
    one = b.read(spark, d, "pages").select("page_id", F.element_at(samples, (F.col("page_id") % 8).cast("int") + 1).alias("s"))
    return one.select("page_id", r.sample_type(F.col("s.name"), F.col("s.head")).alias("kind"), r.media_type(F.lit(None).cast("string"), F.col("s.name")).alias("media"))


OCR = """case doc_id % 4 when 0 then '{"parsing_res_list": []}'
  when 1 then concat('{"parsing_res_list": [null, {"content": " T', doc_id, ' ", "label": "title", "bbox": [1, 2, 3, 4]}]}')
  when 2 then '{"parsing_res_list": [{"block_content": "B", "bbox": [1, 2, 3, 4, 5, 6, 7, 8]}, {"text": "解析失败: x", "block_label": "foot"}]}'
  else '{"parsing_res_list": [{"content": "", "text": "N", "bbox": [[1, 2, 9], [3, 4], [5, 6], [7, 8], [9, 9]]}, {"label": "image"}]}' end"""
SHAPES = """element_at(array('[1, 2]', '{"results": [1]}', '{"data": [{}, {}, 3], "image": "x"}', '{"results": 1}'), cast(doc_id % 4 as int) + 1)"""


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN 1 ELSE 2 END::INT AS blocks, 1::INT AS shown,
    CASE doc_id % 4 WHEN 0 THEN '[未提取到有效文本]' WHEN 1 THEN concat('T', doc_id) WHEN 2 THEN concat('B', chr(10), chr(10), '解析失败: x') ELSE 'N' END AS extracted_text,
    CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'title' WHEN 2 THEN 'text,foot' ELSE 'text,image' END AS layout,
    CASE doc_id % 4 WHEN 0 THEN '0,0,0,0,0,0,0,0' WHEN 1 THEN '1,2,3,2,3,4,1,4' ELSE '1,2,3,4,5,6,7,8' END AS box,
    CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 END::INT AS results FROM documents"""
)
def q51b_ocr_blocks(spark: SparkSession, d: str) -> DataFrame:
    page = r.ocr_page(F.try_parse_json(F.expr(OCR)))
    got = b.read(spark, d, "documents").select("doc_id", page.alias("p"), F.array_size(r.ocr_results(F.expr(SHAPES))).alias("results"))
    box = F.array_join(F.transform(F.flatten(F.element_at("p.blocks", 1)["box"]), lambda x: x.cast("int").cast("string")), ",")
    layout = F.array_join(F.transform("p.blocks", lambda x: x["layout_type"]), ",")
    return got.select("doc_id", F.size("p.blocks").alias("blocks"), F.size(r.shown_blocks(F.col("p.blocks"))).alias("shown"), "p.extracted_text", layout.alias("layout"), box.alias("box"), "results")


KINDS = "case o_orderkey % 5 when 0 then 'single' when 1 then 'multi_invoice' when 2 then 'invoice_with_sublist' when 3 then 'multi_invoice_with_sublist' end"
CATEGORY = "case o_orderkey % 3 when 0 then 'target' when 1 then 'non_target' end"
HEADER_KEYS = ["invoice_no", "invoice_date", "packages", "volume", "weight", "terms", "incoterm", "supplier", "vessel_voyage_imo", "house_bill_of_lading", "total_hkd"]
_head = lambda **kv: "{" + ", ".join(f"'{k}': {kv.get(k, chr(39) * 2)}" for k in HEADER_KEYS) + "}"
_BASE = f"'fileName': concat('O', o_orderkey, '.pdf'), 'fileSize': o_custkey, 'category': {CATEGORY}, 'structureType': {KINDS}, 'note': o_orderstatus, 'updatedAt': concat('v', o_custkey)"
_OWN, _ENTRY, _NONE = _head(invoice_no=o.duck(b.NO), incoterm="o_orderstatus"), _head(invoice_no="'A'"), _head()


@query(
    f"""WITH s AS (SELECT l_orderkey, list({{'description': concat('P', l_partkey), 'charges_in_hkd': cast(cast(l_quantity AS BIGINT) AS VARCHAR)}} ORDER BY {b.LINE_ORDER}) AS ls FROM lineitem GROUP BY 1),
    t AS (SELECT o.*, coalesce(ls, []) AS ls FROM orders o LEFT JOIN s ON l_orderkey = o_orderkey)
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN to_json({{{_BASE}, 'invoices': [{_ENTRY}, {_NONE}]}})::VARCHAR
      WHEN 2 THEN to_json({{{_BASE}, 'invoice': {_OWN}, 'sublist': ls}})::VARCHAR
      WHEN 3 THEN to_json({{{_BASE}, 'invoicesWithSublist': [{{'invoice': {_ENTRY}, 'sublist': ls}}, {{'invoice': {_NONE}, 'sublist': []}}]}})::VARCHAR
      ELSE to_json({{{_BASE}, 'fields': {_OWN}}})::VARCHAR END AS payload FROM t"""
)
def q52_export_payload(spark: SparkSession, d: str) -> DataFrame:
    line = F.struct(*b.LINE_ORDER.split(", "))
    row = lambda x: cells(fc1=F.concat(F.lit("P"), x["l_partkey"].cast("string")), fc2=x["l_quantity"].cast("bigint").cast("string"))
    lines = b.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(line)), row).alias("ls"))
    rows = F.coalesce("ls", dc.empty(f"array<{dc.CELLS}>"))
    own = cells(fh1=F.expr(b.NO), fh7=F.col("o_orderstatus"))
    entry = lambda header, ls: F.struct(header.alias("header"), ls.alias("rows"))
    docs = b.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(lines, "o_orderkey", "left").select(
        "o_orderkey", F.concat(F.lit("O"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file_name"), F.col("o_custkey").alias("file_size"), F.expr(CATEGORY).alias("category"), F.expr(KINDS).alias("structure_type"),
        F.col("o_orderstatus").alias("note"), F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("updated_at"), own.alias("field_values"), own.alias("invoice_header"), rows.alias("sublist_rows"),
        F.array(entry(cells(fh1=F.lit("A")), rows), entry(dc.empty(dc.CELLS), F.lit(None).cast(f"array<{dc.CELLS}>"))).alias("invoice_entries"),
    )
    return docs.select("o_orderkey", dc.export_json(fields("freight_invoice", "header"), fields("freight_invoice", "sublist")).alias("payload"))


@query(
    """SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'single' WHEN quality = 1 THEN 'multi_invoice_with_sublist' ELSE 'multi_invoice' END AS structure_type, (lang IS NOT NULL)::INT AS filled,
    1::INT AS entries, CASE WHEN quality = 1 THEN CASE WHEN d.doc_id % 4 = 1 THEN 2 ELSE 1 END WHEN d.doc_id % 4 = 1 THEN 2 END::INT AS entry_rows, CASE d.doc_id % 3 WHEN 2 THEN 2 ELSE 1 END::INT AS sub_rows FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def q53_migrate_batch(spark: SparkSession, d: str) -> DataFrame:
    rows, two = f"array<{dc.CELLS}>", F.array(cells(fc1=F.lit("a")), cells(fc1=F.lit("b")))
    entries = F.array(F.struct(cells(fh1=F.lit("n")).alias("header"), F.when(F.col("doc_id") % 4 == 1, two).alias("rows")))
    stored = b.read(spark, d, "documents").select("doc_id", "lang").join(b.read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id", F.when(F.col("quality") == 1, "multi_invoice_with_sublist").when(F.col("quality").isNotNull(), "multi_invoice").alias("structure_type"),
        F.when(F.col("lang").isNotNull(), cells(fh1=F.col("lang"))).alias("field_values"), F.lit(None).cast(dc.CELLS).alias("invoice_header"),
        F.when(F.col("doc_id") % 3 == 2, two).when(F.col("doc_id") % 3 == 0, dc.empty(rows)).alias("sublist_rows"), F.when(F.col("doc_id") % 2 == 1, entries).alias("invoice_entries"),
    )
    first = F.element_at("invoice_entries", 1)["rows"]
    return dc.migrate(stored).select("doc_id", "structure_type", dc.filled_count(F.col("field_values")).alias("filled"), F.size("invoice_entries").alias("entries"), F.array_size(first).alias("entry_rows"), F.size("sublist_rows").alias("sub_rows"))


@query(
    """SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN 'air_waybill' ELSE n_name END AS layout_template_id,
    CASE n_nationkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'old' ELSE 'invoice_no,invoice_date' END AS header, 'air_waybill_number,total' AS sublist FROM nation"""
)
def q53b_migrate_fields(spark: SparkSession, d: str) -> DataFrame:
    one = lambda key: F.array(F.struct(F.lit("x").alias("field_id"), F.lit(key).alias("field_key")))
    k, head, columns = F.col("n_nationkey"), fields("air_waybill", "header"), fields("air_waybill", "sublist")
    stored = b.read(spark, d, "nation").select(
        "n_nationkey", F.when(k % 2 == 1, F.col("n_name")).alias("layout_template_id"), F.when(k % 3 == 0, one("own")).alias("header_fields"),
        F.when(k % 3 < 2, one("old")).alias("predefined_fields"), F.when(k < 0, columns).alias("sublist_columns"),
    )
    keys = lambda c: F.array_join(F.transform(c, lambda f: f["field_key"]), ",")
    return dc.migrate_batch(stored, head, columns).select("n_nationkey", "layout_template_id", keys("header_fields").alias("header"), keys("sublist_columns").alias("sublist"))


@query(f"SELECT o_orderkey, 11::INT AS fields, {o.duck(b.NO)} AS fh1, '' AS fh2, o_orderstatus AS fh11, {o.duck(b.NO)} AS invoice_no, 10::INT AS kept FROM orders")
def q56_field_rename(spark: SparkSession, d: str) -> DataFrame:
    own = fields("freight_invoice", "header")
    by_id = dc.rename(cells(invoice_no=F.expr(b.NO), total_hkd=F.col("o_orderstatus"), other=F.lit("x")), own, "field_key", "field_id")
    out = b.read(spark, d, "orders").select("o_orderkey", by_id.alias("m"))
    out = out.withColumn("back", dc.rename(F.col("m"), own, "field_id", "field_key"))
    return out.select("o_orderkey", F.size("m").alias("fields"), *[F.col("m")[f].alias(f) for f in ("fh1", "fh2", "fh11")], F.col("back")["invoice_no"].alias("invoice_no"), F.size(dc.without_field(F.col("m"), F.lit("fh3"))).alias("kept"))


BODIES = """case p_partkey % 6 when 0 then concat('{"options": {"num_predict": ', p_size, '}}') when 1 then concat('{"options": {"num_predict": ', p_size * 100, ', "temperature": null, "num_ctx": "big"}}')
  when 2 then '{"options": {"num_predict": "900", "repeat_penalty": 1.5}}' when 3 then '{"options": [1]}' when 4 then '{}' else '{"options": {"temperature": 0.25, "num_ctx": 2048, "num_predict": 600.5}}' end"""


@query(
    """WITH n AS (SELECT p_partkey, p_partkey % 6 AS k, CASE p_partkey % 6 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 100::DOUBLE WHEN 5 THEN 600.5::DOUBLE END AS np FROM part),
    c AS (SELECT *, CASE k WHEN 1 THEN 'null' WHEN 5 THEN '0.25' END AS t, CASE k WHEN 2 THEN '1.5' END AS r, CASE k WHEN 5 THEN '2048' WHEN 1 THEN '"big"' ELSE '4096' END AS x FROM n)
    SELECT p_partkey, 'extract' AS profile, CASE WHEN np >= 1024 THEN np ELSE 4096.0::DOUBLE END AS num_predict, CASE k WHEN 5 THEN x ELSE '8192' END AS num_ctx, coalesce(t, '0') AS temperature, coalesce(r, '1.12') AS repeat_penalty FROM c
    UNION ALL SELECT p_partkey, 'classify', greatest(coalesce(np, 256.0::DOUBLE), 256.0::DOUBLE), x, coalesce(t, '0'), r FROM c
    UNION ALL SELECT p_partkey, 'optimize', least(greatest(coalesce(np, 512.0::DOUBLE), 256.0::DOUBLE), 768.0::DOUBLE), x, coalesce(t, '0.1'), coalesce(r, '1.15') FROM c"""
)
def q58_request_options(spark: SparkSession, d: str) -> DataFrame:
    bodies = b.read(spark, d, "part").select("p_partkey", F.try_parse_json(F.expr(BODIES)).alias("v"))
    each = [F.struct(F.lit(p).alias("profile"), r.request_options(F.col("v"), p).alias("o")) for p in r.PREDICT]
    return bodies.select("p_partkey", F.inline(F.array(*each))).select("p_partkey", "profile", "o.*")


TEXTS = [" ", "{", "[1]", '{"model": " ", "messages": [1]}', '{"model": "m", "messages": []}', '{"model": 5, "messages": [1]}', '{"model": "m", "messages": [{"role": "user"},]}']


@query("SELECT c_custkey, ['empty', 'syntax', 'not_object', 'no_model', 'no_messages', 'no_model', NULL][c_custkey % 7 + 1] AS problem, [NULL, 'syntax', 'not_object', NULL, NULL, NULL, NULL][c_custkey % 7 + 1] AS as_options FROM customer")
def q58b_request_problem(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("c_custkey") % 7).cast("int") + 1)
    return b.read(spark, d, "customer").select("c_custkey", r.request_problem(text).alias("problem"), r.options_problem(text).alias("as_options"))
