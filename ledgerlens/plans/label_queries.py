"""Queries of shapes, labelling batches, examples, uploads and requests (q21 to q60)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerlens.functions import text as t, values as v
from ledgerlens.operators import labels as lb, pages as p
from ledgerlens.operators.templates import FIELDS, template_fields
from ledgerlens.sources.exports import read_exports
from . import bridge as b, oracle as o
from .extraction_queries import ENTRIES, entries
from .report_queries import query

NO = b.NO
SHAPES = f"""case o_orderkey % 6 when 0 then concat('{{"fileName":" ", "fields":{{"invoice_no":"', {NO}, '","n":12.5,"x":{{"y":1}},"z":null}}}}')
  when 1 then concat('{{"fileName":" a.pdf ","invoices":[{{"invoice_no":"', {NO}, '"}},{{"invoice_no":"B"}}]}}')
  when 2 then concat('{{"invoice":{{"invoice_no":"', {NO}, '"}},"sublist":[{{"total":1}},{{"total":true}},3],"fields":{{"invoice_no":"no"}}}}')
  when 3 then concat('{{"documents":[{{"invoicesWithSublist":[{{"invoice":{{"invoice_no":"', {NO}, '"}},"sublist":[{{}}]}}]}},{{"extraction":{{"layoutTemplateId":"air_waybill"}}}}]}}')
  when 4 then '[1]' else '{{"fileName":' end"""


def _shapes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return read_exports(b.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.expr(SHAPES).alias("text")))


@query(
    f"""SELECT cast(o_orderkey AS VARCHAR) AS path, 0 AS doc_pos, CASE o_orderkey % 6 WHEN 1 THEN 'a.pdf' ELSE cast(o_orderkey AS VARCHAR) END AS file_name, NULL::VARCHAR AS template_id,
    CASE o_orderkey % 6 WHEN 1 THEN 2 ELSE 1 END AS n_invoices, {NO} AS invoice_no, CASE o_orderkey % 6 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 0 END AS n_rows,
    CASE o_orderkey % 6 WHEN 0 THEN '12.5,,' ELSE '' END AS extras FROM orders WHERE o_orderkey % 6 < 4
    UNION ALL SELECT cast(o_orderkey AS VARCHAR), 1, cast(o_orderkey AS VARCHAR), 'air_waybill', 0, NULL, NULL, '' FROM orders WHERE o_orderkey % 6 = 3""".replace("as string", "AS VARCHAR")
)
def q21_normalize_shapes(spark: SparkSession, d: str) -> DataFrame:
    first = F.get("invoices", F.lit(0))
    extras = F.concat_ws(",", *[F.try_element_at(first["header"], F.lit(k)) for k in "nxz"])
    return _shapes(spark, d)[0].select("path", "doc_pos", "file_name", "template_id", F.size("invoices").alias("n_invoices"), F.try_element_at(first["header"], F.lit("invoice_no")).alias("invoice_no"), F.when(first.isNotNull(), F.size(first["sublist"])).alias("n_rows"), extras.alias("extras"))


@query("SELECT cast(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderkey % 6 >= 4")
def q21b_parse_errors(spark: SparkSession, d: str) -> DataFrame:
    return _shapes(spark, d)[1]


CELLS = {"description": "case l_partkey % 4 when 0 then '' when 1 then ' ' else 'x' end", "charges_in_hkd": "case l_partkey % 3 when 0 then '' else '1' end"}


@query(
    f"""WITH r AS (SELECT l_orderkey, l_partkey % 2 = 0 AS listed, {CELLS['description']} AS a, {CELLS['charges_in_hkd']} AS c FROM lineitem)
    SELECT l_orderkey, count(*) FILTER ((trim(a) <> '' OR c <> '') AND (NOT listed OR trim(a) <> '')) AS valid_rows, count(*) AS all_rows FROM r GROUP BY 1"""
)
def q22_valid_rows(spark: SparkSession, d: str) -> DataFrame:
    columns = F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("description"), F.lit("charges_in_hkd"))).otherwise(F.array(F.lit("charges_in_hkd")))
    cells = F.create_map(*[x for k, e in CELLS.items() for x in (F.lit(k), F.expr(e))])
    ok = p.valid_row(cells, F.array_intersect(columns, F.array(F.lit("description"))))
    return b.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(ok).alias("valid_rows"), F.count(F.lit(1)).alias("all_rows"))


@query(
    """WITH q AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN 'error' WHEN l_partkey % 5 = 0 OR l_quantity < 5 OR l_suppkey % 7 = 0 THEN 'skipped' ELSE 'target' END AS outcome FROM lineitem)
    SELECT l_orderkey, outcome, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS pages FROM q GROUP BY ALL"""
)
def q23_page_outcomes(spark: SparkSession, d: str) -> DataFrame:
    outcome = p.page_outcome(F.col("l_partkey") % 11 == 0, F.col("l_partkey") % 5 != 0, F.col("l_quantity") >= 5, F.col("l_suppkey") % 7 != 0)
    pages = F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",")
    return b.read(spark, d, "lineitem").groupBy("l_orderkey", outcome.alias("outcome")).agg(pages.alias("pages"))


@query(
    f"""WITH {ENTRIES}, f AS (SELECT *, min(pos) OVER (PARTITION BY l_orderkey, no) AS first_pos FROM e),
    g AS (SELECT *, CASE WHEN no <> '' THEN pos = first_pos ELSE hv END AS base FROM f),
    h AS (SELECT *, no = '' AND NOT hv AND ls AND NOT coalesce(bool_or(base) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS loose FROM g),
    i AS (SELECT *, base OR (loose AND row_number() OVER (PARTITION BY l_orderkey, loose ORDER BY pos) = 1) AS created FROM h),
    k AS (SELECT l_orderkey, pos, ls, (CASE WHEN no <> '' THEN first_pos ELSE max(CASE WHEN created THEN pos END) OVER (PARTITION BY l_orderkey ORDER BY pos) END)::INT AS inv_id FROM i)
    SELECT l_orderkey, inv_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS line_pages FROM k WHERE ls AND inv_id IS NOT NULL GROUP BY ALL"""
)
def q25_page_fold_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = p.fold_pages(entries(spark, d), "l_orderkey").filter("has_lines and inv_id is not null")
    return lines.groupBy("l_orderkey", "inv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda x: x.cast("string")), ",").alias("line_pages"))


@query(f"WITH {ENTRIES}, c AS (SELECT l_orderkey, no, sum(greatest(1, weight))::BIGINT AS votes FROM e GROUP BY ALL) SELECT l_orderkey, no, votes FROM c WHERE no <> ''")
def q28_estimated_votes(spark: SparkSession, d: str) -> DataFrame:
    return p.estimated_votes(entries(spark, d), "l_orderkey")


NUMBERS = f"case o_orderkey % 3 when 0 then concat('INVOICE  ', {NO}) when 1 then {NO} else substr({NO}, 3) end"


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 2 = 0 ELSE o_orderkey % 8 >= 5 AND length(regexp_replace({o.duck(NUMBERS)}, '(?i)^INVOICE\\s+', '')) = 11 END AS valid FROM orders"""
)
def q30_freight_valid(spark: SparkSession, d: str) -> DataFrame:
    ok = p.freight_valid(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 8).cast("int"), F.expr(NUMBERS), F.col("o_orderkey") % 2 == 0)
    return b.read(spark, d, "orders").select("o_orderkey", ok.alias("valid"))


#: Every brand as a template whose fields are its parts; a field's key is an amount's by the part's size, else its name.
_AMOUNT_KEY = "case p_size % 9 when 0 then 'grand_total' when 1 then 'fee' when 2 then 'total' when 3 then 'charges' when 4 then 'amount' else p_name end"
_AMOUNT_LABEL = "concat(p_type, case p_size % 9 when 5 then ' Total' when 6 then ' charges DESCRIPTION' else '' end)"


@query(
    f"""WITH f AS (SELECT p_brand AS template_id, CASE WHEN p_retailprice < 1000 THEN 'header' ELSE 'sublist' END AS scope, p_partkey AS pos, concat('f', p_partkey) AS field_id, {_AMOUNT_KEY} AS field_key, {_AMOUNT_LABEL} AS label FROM part),
    r AS (SELECT *, CASE scope WHEN 'header' THEN list_position(['total_hkd', 'total', 'grand_total'], field_key) ELSE list_position(['charges_in_hkd', 'total', 'charges', 'amount', 'fee'], field_key) END AS rank FROM f UNION ALL SELECT *, 99 FROM f WHERE regexp_matches(label, 'total', 'i'))
    SELECT template_id, scope, field_id FROM r WHERE rank > 0 QUALIFY row_number() OVER (PARTITION BY template_id, scope ORDER BY rank, pos) = 1"""
)
def q34_amount_column(spark: SparkSession, d: str) -> DataFrame:
    scope = F.when(F.col("p_retailprice") < 1000, "header").otherwise("sublist")
    parts = b.read(spark, d, "part").select(F.col("p_brand").alias("template_id"), scope.alias("scope"), F.col("p_partkey").alias("pos"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("field_id"), F.expr(_AMOUNT_KEY).alias("field_key"), F.expr(_AMOUNT_LABEL).alias("label"))
    return lb.amount_fields(parts)


@query(
    """SELECT o_orderkey AS doc, 'dh1' AS field_id, concat('N', o_orderkey) AS value FROM orders
    UNION ALL SELECT o_orderkey, 'dh2', CASE o_orderkey % 3 WHEN 1 THEN 'd' ELSE 'e' END FROM orders WHERE o_orderkey % 3 > 0"""
)
def q35_template_remap(spark: SparkSession, d: str) -> DataFrame:
    when = F.when(F.col("o_orderkey") % 3 == 0, "  ").when(F.col("o_orderkey") % 3 == 1, "d").otherwise("e")
    one = lambda i, x: F.struct(F.lit(i).alias("field_id"), x.alias("value"))
    cells = F.array(one("fh1", F.concat(F.lit("N"), F.col("o_orderkey").cast("string"))), one("fh2", when), one("fh3", F.lit("9")))
    values = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(cells).alias("x")).select("doc", "x.*")
    dim = template_fields(spark)
    return lb.remap(values, dim.filter("template_id = 'freight_invoice'"), dim.filter("template_id = 'air_waybill_dhl'"))


@query(
    """WITH a AS (SELECT c_name, c_custkey AS pos FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_name, -c_custkey AS pos FROM customer WHERE c_custkey % 2 = 0)
    SELECT c_name, CASE WHEN n.pos IS NULL THEN 'kept' WHEN a.pos IS NULL THEN 'added' ELSE 'replaced' END AS origin, coalesce(n.pos, a.pos) AS pos, CASE WHEN n.pos IS NULL THEN 'old' ELSE 'new' END AS value
    FROM n FULL JOIN a USING (c_name)"""
)
def q36_upsert_uploads(spark: SparkSession, d: str) -> DataFrame:
    c = b.read(spark, d, "customer")
    old = c.filter("c_custkey % 3 <> 0").select("c_name", F.col("c_custkey").alias("pos"), F.lit("old").alias("value"))
    new = c.filter("c_custkey % 2 = 0").select("c_name", (-F.col("c_custkey")).alias("pos"), F.lit("new").alias("value"))
    return lb.upsert(old, new, "c_name")


@query("SELECT c_custkey, c_name, n_name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC) AS place FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name LIKE '%A%' QUALIFY place <= 100")
def q37_examples_join(spark: SparkSession, d: str) -> DataFrame:
    nations = b.read(spark, d, "nation").filter(F.contains("n_name", F.lit("A"))).select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = b.read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").join(nations, "c_nationkey")
    top = rows.orderBy(F.desc("c_acctbal"), F.desc("c_custkey")).limit(100)  # a top-k report
    return top.groupBy().agg(F.sort_array(F.collect_list(F.struct("c_acctbal", "c_custkey", "c_name", "n_name")), asc=False).alias("x")).select(F.posexplode("x").alias("i", "x")).select("x.c_custkey", "x.c_name", "x.n_name", (F.col("i") + 1).cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS place FROM orders QUALIFY place <= 4")
def q38_examples_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = b.read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return lb.latest_examples(rows, "o_custkey").select("o_custkey", F.col("id").alias("o_orderkey"), "place")


@query("SELECT n_regionkey, string_agg(x, '|' ORDER BY x) AS revision FROM (SELECT n_regionkey, concat(n_nationkey, ':', n_name) AS x FROM nation) GROUP BY 1")
def q39_revision(spark: SparkSession, d: str) -> DataFrame:
    return lb.revision(b.read(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("id"), F.col("n_name").alias("stamp")), "n_regionkey")


@query("SELECT conv_id, arg_min(text, turn) FILTER (role = 'system') AS system, arg_max(text, turn) FILTER (role = 'user') AS \"user\" FROM conversations GROUP BY 1")
def q44_chat_sanitize(spark: SparkSession, d: str) -> DataFrame:
    role = lambda r, x: F.when(F.col("role") == r, F.col(x))
    c = b.read(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.min_by("text", role("system", "turn")).alias("system"), F.max_by("text", role("user", "turn")).alias("user"))


@query("SELECT conv_id, concat(string_agg(text, '' ORDER BY turn), '!') AS content FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY 1")
def q45_chunk_fold(spark: SparkSession, d: str) -> DataFrame:
    c = b.read(spark, d, "conversations").filter("text is not null and text <> ''")
    chunks = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("x")))), lambda s: s["x"])
    whole = lambda x: F.concat(F.array_join(x, ""), F.lit("!"))  # noqa: E731  the last chunk repeats all before it
    return c.groupBy("conv_id").agg(chunks.alias("x")).select("conv_id", t.fold_chunks(F.concat("x", F.array(whole(F.col("x"))))).alias("content"))


REPLY = """case c_custkey % 5 when 0 then concat('Sure: ```json\\n{"is_target": true, "n": ', cast(c_custkey as string), '}\\n``` done') when 1 then concat('text {"is_target": false, "n": ', cast(c_custkey as string), ',} end')
  when 2 then concat('{"n": ', cast(c_custkey as string), '}') when 3 then 'no json' else '{"is_target": tru' end"""


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN c_custkey END AS n, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS is_target FROM customer")
def q46_extract_json(spark: SparkSession, d: str) -> DataFrame:
    reply = t.lenient_json(t.json_part(F.expr(REPLY)))
    out = b.read(spark, d, "customer").select("c_custkey", reply.alias("v"))
    return out.select("c_custkey", F.try_variant_get("v", "$.n", "bigint").alias("n"), F.try_variant_get("v", "$.is_target", "boolean").alias("is_target"))


@query(
    """WITH f AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, coalesce(n_chars, 0) * 9000 * (doc_id % 7) AS size FROM documents)
    SELECT doc_id, CASE WHEN place > 50 THEN 'too_many_files' WHEN doc_id % 5 = 0 THEN 'not_pdf_name' WHEN size = 0 THEN 'empty' WHEN size > 41943040 THEN 'too_large' WHEN doc_id % 11 = 0 THEN 'not_pdf_content' END AS problem FROM f"""
)
def q49_upload_validation(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    name = F.when(F.col("doc_id") % 5 == 0, "a.png").otherwise("A.PDF")
    head = F.when(F.col("doc_id") % 11 == 0, "PK").otherwise("%PDF-1.7")
    rows = b.read(spark, d, "documents").select("doc_id", place.alias("place"), (F.coalesce("n_chars", F.lit(0)) * 9000 * (F.col("doc_id") % 7)).alias("size"), name.alias("name"), head.alias("head"))
    return rows.select("doc_id", lb.upload_problem(F.col("name"), F.col("size"), F.col("head"), F.col("place")).alias("problem"))


@query("SELECT p_partkey, least(p_size, p_partkey % 10)::DOUBLE AS x, 2.0::DOUBLE AS y, (greatest(p_size, p_partkey % 10) - least(p_size, p_partkey % 10))::DOUBLE AS w, 3.0::DOUBLE AS h FROM part")
def q50_box_rect(spark: SparkSession, d: str) -> DataFrame:
    x1, x2 = F.col("p_size").cast("double"), (F.col("p_partkey") % 10).cast("double")
    box = F.array(*[F.array(x, F.lit(y)) for x, y in ((x1, 2.0), (x2, 2.0), (x2, 5.0), (x1, 5.0))])
    rect = t.box_rect(box)
    return b.read(spark, d, "part").select("p_partkey", rect.alias("r")).select("p_partkey", "r.*")


@query("SELECT source, count(*) FILTER (lang IS NOT NULL) AS success, count(*) FILTER (lang IS NULL) AS failed, coalesce(sum(n_chars) FILTER (lang IS NOT NULL), 0)::BIGINT AS blocks FROM documents GROUP BY 1")
def q51_ocr_batch_stats(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("lang").isNotNull()
    return b.read(spark, d, "documents").groupBy("source").agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("n_chars"))), F.lit(0)).alias("blocks"))


@query("SELECT lower(trim(c_name)) AS username, count(*) AS users, min(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def q54_user_lookup(spark: SparkSession, d: str) -> DataFrame:
    shown = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.upper("c_name"))).otherwise(F.col("c_name"))
    return b.read(spark, d, "customer").groupBy(F.lower(v.trim_ws(shown)).alias("username")).agg(F.count(F.lit(1)).alias("users"), F.min("c_custkey").alias("c_custkey"))


@query("SELECT source, count(*) FILTER (quality = 1) AS adopted, count(*) FILTER (quality = 0) AS rejected FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def q55_review_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = b.read(spark, d, "documents").select("doc_id", "source").join(b.read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("adopted"), F.count_if(F.col("quality") == 0).alias("rejected"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS result, CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN 'checked' ELSE 'first' END AS note FROM labels")
def q57_patch_result(spark: SparkSession, d: str) -> DataFrame:
    payload, note = F.when(F.col("doc_id") % 3 == 0, "new"), F.when(F.col("doc_id") % 2 == 0, "checked")
    return b.read(spark, d, "labels").select("doc_id", lb.patched(F.lit("old"), F.lit("first"), payload, note).alias("x")).select("doc_id", "x.*")


_LABELS = "CASE toxic WHEN 1 THEN 'unknown' WHEN 0 THEN CASE quality WHEN 1 THEN '单发票' ELSE '发票+子清单' END END"


@query(f"SELECT doc_id, {_LABELS} AS label FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL")
def q59_labels_text(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("toxic") == 1, "other").when(F.col("quality") == 1, "single").otherwise("invoice_with_sublist")
    return b.read(spark, d, "labels").filter("toxic is not null and quality is not null").select("doc_id", t.lookup(t.STRUCTURE_LABELS, key, "unknown").alias("label"))


ENTRY = "case page_id % 5 when 0 then concat('__MACOSX/', cast(page_id as string), '.json') when 1 then concat('a/.', cast(page_id as string), '.json') when 2 then concat('b/', cast(page_id as string), '.JSON') when 3 then concat('x/__MACOSX/', cast(page_id as string), '.json') else concat('c.d/', cast(page_id as string), '.json') end"


@query(f"SELECT page_id, {o.duck(ENTRY)} AS path FROM pages WHERE page_id % 5 IN (2, 4)")
def q60_zip_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = b.read(spark, d, "pages").select("page_id", F.expr(ENTRY).alias("path"))
    return rows.filter(lb.is_json_entry(F.col("path")))
