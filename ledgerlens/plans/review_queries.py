"""Queries of typed replies, the review view, structure switches, prompts, edits and examples (q66 to q72)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerlens.functions import text as t
from ledgerlens.operators import documents as dc, edits as ed, prompts as pr, review as rv
from ledgerlens.operators.templates import FIELDS
from . import bridge as b, oracle as o
from .document_queries import fields
from .report_queries import query

TEMPLATE = "freight_invoice"


def both_fields() -> tuple[Column, Column]:
    return fields(TEMPLATE, "header"), fields(TEMPLATE, "sublist")


def both_keys() -> tuple[Column, Column]:
    header, columns = (F.array(*[F.lit(f[3]) for f in FIELDS if f[:2] == (TEMPLATE, s)]) for s in ("header", "sublist"))
    return header, columns


def orders_with_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its header and lines as maps by field key, lines in order."""
    line = b.read(spark, d, "lineitem")
    texts = [F.expr(e).alias(k) for k, e in b.ANSWER_LINE.items()]
    rows = line.select(F.col("l_orderkey").alias("o_orderkey"), F.struct(*b.LINE_ORDER.split(", "), *texts).alias("x")).groupBy("o_orderkey")
    cells = lambda x: F.create_map(*[y for k in b.ANSWER_LINE for y in (F.lit(k), x[k])])
    lines = rows.agg(F.sort_array(F.collect_list("x")).alias("x")).select("o_orderkey", F.transform("x", cells).alias("rows"))
    head = b.read(spark, d, "orders").select("o_orderkey", "o_custkey", b._map(b.ANSWER_INV).alias("header"))
    return head.join(lines, "o_orderkey", "left").withColumn("rows", F.coalesce("rows", dc.empty(f"array<{dc.CELLS}>")))


#: What is wrong with an order's reply: nothing, prose and a fence, commas, cut off at two thirds, members of other kinds.
_LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + b.LINE_ORDER + ") AS pos FROM lineitem)"


@query(
    f"""WITH {_LINES}, n AS (SELECT l_orderkey, count(*) AS n, min(o) FILTER (pos = 1) AS first, sum(charge) AS charges FROM (SELECT l_orderkey, pos, {o.duck(b.ANSWER_LINE["description"])} AS o, {b.CENTS.format(x="l_extendedprice")} AS charge FROM lines) GROUP BY 1),
    r AS (SELECT *, o_orderkey % 5 AS form, {o.duck(b.ANSWER_INV["invoice_no"])} AS no, {o.duck(b.ANSWER_INV["invoice_date"])} AS day FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
    SELECT o_orderkey, form <> 3 AND o_totalprice >= 150000 AS is_target, CASE form WHEN 3 THEN 0 WHEN 4 THEN 3 ELSE 1 END AS n_invoices, CASE WHEN form <> 3 THEN no END AS invoice_no, CASE form WHEN 3 THEN NULL WHEN 4 THEN '' ELSE day END AS invoice_date,
    CASE WHEN form <> 3 THEN coalesce(n, 0) ELSE 0 END::INT AS n_rows, CASE WHEN form <> 3 THEN first END AS first, CASE WHEN form = 4 THEN coalesce(n, 0) ELSE 0 END::INT AS orphans,
    (CASE form WHEN 3 THEN 0 WHEN 4 THEN 2 ELSE 1 END * coalesce(charges, 0))::BIGINT AS cents FROM r"""
)
def q66_typed_replies(spark: SparkSession, d: str) -> DataFrame:
    form = F.col("o_orderkey") % 5
    orders = b.read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    base = orders_with_lines(spark, d).join(orders, "o_orderkey")
    target = F.when(form % 2 == 0, F.concat(F.lit('"'), (F.col("o_totalprice") >= 150000).cast("string"), F.lit('"'))).otherwise((F.col("o_totalprice") >= 150000).cast("string"))
    rows = F.to_json(F.transform("rows", lambda m: m))
    with_empty = F.concat(F.lit("[{}, 7, "), F.substring(rows, F.lit(2), F.length(rows) - 1))
    rows = F.when(F.size("rows") > 0, with_empty).otherwise("[{}, 7]")
    header = F.to_json(F.transform_values("header", lambda k, x: F.concat(F.lit(" "), x, F.lit(" "))))
    header = F.when(form == 4, F.to_json(F.map_filter("header", lambda k, _: k != "invoice_date"))).otherwise(header)
    invoice = F.concat(F.lit('{"header": '), header, F.lit(', "sublist": '), rows, F.lit("}"))
    more = F.when(form == 4, F.concat(F.lit(', 5, {"header": [1], "sublist": {}}], "orphan_sublist": '), rows)).otherwise('], "orphan_sublist": "none"')
    whole = F.concat(F.lit('{"is_target": '), target, F.lit(', "invoices": ['), invoice, more, F.lit("}"))
    damaged = (
        F.when(form == 1, F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n``` done")))
        .when(form == 2, F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit(", }")))
        .when(form == 3, F.substring(whole, F.lit(1), (F.length(whole) * 2 / 3).cast("int")))
        .otherwise(whole)
    )
    replies = base.select("o_orderkey", t.lenient_json(t.json_part(damaged)).alias("v"))
    out = rv.typed_replies(replies, "v", *both_keys())
    first = F.get("invoices", F.lit(0))
    every = F.concat(F.flatten(F.transform("invoices", lambda x: x["sublist"])), F.col("orphan_sublist"))
    cents = F.aggregate(every, F.lit(0).cast("long"), lambda acc, m: acc + F.replace(m["charges_in_hkd"], F.lit("."), F.lit("")).cast("long"))
    return out.select(
        "o_orderkey", "is_target", F.size("invoices").alias("n_invoices"), first["header"]["invoice_no"].alias("invoice_no"), first["header"]["invoice_date"].alias("invoice_date"),
        F.coalesce(F.size(first["sublist"]), F.lit(0)).alias("n_rows"), F.get(first["sublist"], F.lit(0))["description"].alias("first"), F.size("orphan_sublist").alias("orphans"), cents.alias("cents"),
    )


STRUCTURES = ("single", "multi_invoice", "invoice_with_sublist", "multi_invoice_with_sublist")


def stored_documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as stored documents, each in one of the four structures; two invoices where the customer's number is odd."""
    base = orders_with_lines(spark, d)
    structure = F.element_at(F.array(*map(F.lit, STRUCTURES)), (F.col("o_orderkey") % 4).cast("int") + 1)
    header, columns = both_fields()
    rows = dc.rename_rows(F.col("rows"), columns, "field_key", "field_id")
    base = base.select("o_orderkey", "o_custkey", dc.rename(F.col("header"), header, "field_key", "field_id").alias("head"), rows.alias("rows"))
    head, rows = F.col("head"), F.col("rows")
    entry = lambda h, r: F.struct(h.alias("header"), r.alias("rows"))
    second = F.transform_values(head, lambda k, v: F.when(k == "fh1", F.concat(v, F.lit("B"))).otherwise(v))
    entries = F.when(F.col("o_custkey") % 2 == 1, F.array(entry(head, rows), entry(second, F.slice(rows, 1, 1)))).otherwise(F.array(entry(head, rows)))
    said = [F.lit(None).cast(k).alias(c) for c, k in (("file_size", "long"), ("category", "string"), ("note", "string"), ("updated_at", "string"))]
    return base.select("o_orderkey", F.lit("a.pdf").alias("file_name"), *said, structure.alias("structure_type"), head.alias("field_values"), head.alias("invoice_header"), rows.alias("sublist_rows"), entries.alias("invoice_entries"))


_DOC = f"""WITH {_LINES}, n AS (SELECT l_orderkey, count(*) AS n, min(x) FILTER (pos = 1) AS first FROM (SELECT l_orderkey, pos, {o.duck(b.ANSWER_LINE["description"])} AS x FROM lines) GROUP BY 1),
    r AS (SELECT *, o_orderkey % 4 AS form, o_custkey % 2 = 1 AS two, {o.duck(b.ANSWER_INV["invoice_no"])} AS no, coalesce(n, 0) AS rows FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)"""


@query(
    _DOC
    + """ SELECT o_orderkey, CASE form WHEN 0 THEN 'single' WHEN 1 THEN CASE WHEN two THEN 'multi_invoice' ELSE 'single' END WHEN 2 THEN 'invoice_with_sublist' ELSE 'multi_invoice_with_sublist' END AS structure_type,
    no AS field_no, o_orderpriority AS terms, CASE WHEN form < 2 THEN 1 ELSE greatest(rows, 1) END::INT AS n_rows, CASE WHEN form >= 2 THEN first END AS first,
    CASE WHEN form IN (1, 3) AND two THEN 2 ELSE 1 END AS n_entries, CASE WHEN form IN (1, 3) AND two THEN no || 'B' ELSE no END AS last_no,
    CASE WHEN form < 2 THEN 1 WHEN form = 3 AND two THEN 1 ELSE greatest(rows, 1) END::INT AS last_rows FROM r"""
)
def q67_review_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents exported as JSON by structure and read back for review."""
    saved = stored_documents(spark, d).select("o_orderkey", F.try_parse_json(dc.export_json(*both_fields())).alias("v"))
    out = rv.review_of_exports(saved, "v", *both_fields())
    last = F.element_at("invoice_entries", -1)
    return out.select(
        "o_orderkey", "structure_type", F.col("field_values")["fh1"].alias("field_no"), F.col("invoice_header")["fh6"].alias("terms"), F.size("sublist_rows").alias("n_rows"),
        F.try_element_at(F.get("sublist_rows", F.lit(0)), F.lit("fc1")).alias("first"), F.size("invoice_entries").alias("n_entries"), last["header"]["fh1"].alias("last_no"), F.size(last["rows"]).alias("last_rows"),
    )


@query(
    _DOC
    + """, p AS (SELECT *, (o_orderkey // 4) % 4 AS target, o_custkey % 3 = 0 AS bare FROM r)
    SELECT o_orderkey, CASE target WHEN 0 THEN 'single' WHEN 1 THEN 'multi_invoice' WHEN 2 THEN 'invoice_with_sublist' ELSE 'multi_invoice_with_sublist' END AS structure_type,
    CASE WHEN bare AND target <> 2 THEN NULL ELSE no END AS header_no, CASE WHEN target = 2 THEN CASE WHEN bare THEN 1 ELSE greatest(rows, 1) END WHEN bare THEN 0 ELSE rows END::INT AS n_rows,
    CASE WHEN NOT bare THEN CASE WHEN two THEN 2 ELSE 1 END WHEN target IN (1, 3) THEN 1 ELSE 0 END AS n_entries,
    CASE WHEN NOT bare THEN no WHEN target = 3 THEN 'default' END AS entry_no, CASE WHEN NOT bare AND (target <> 3 OR rows > 0) THEN rows WHEN target = 3 THEN 2 ELSE -1 END::INT AS entry_rows FROM p"""
)
def q67b_structure_switch(spark: SparkSession, d: str) -> DataFrame:
    """Each document switched to a structure of its own; every third has neither header, rows nor entries."""
    customers = b.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    bare = F.col("o_custkey") % 3 == 0
    cells, listed = dc.empty(dc.CELLS), dc.empty(f"array<{dc.CELLS}>")
    docs = stored_documents(spark, d).join(customers, "o_orderkey").withColumns({
        "invoice_header": F.when(bare, cells).otherwise(F.col("invoice_header")), "sublist_rows": F.when(bare, listed).otherwise(F.col("sublist_rows")), "invoice_entries": F.when(bare, dc.empty(dc.ENTRIES)).otherwise(F.col("invoice_entries")),
    })
    to = F.element_at(F.array(*map(F.lit, STRUCTURES)), (F.floor(F.col("o_orderkey") / 4) % 4).cast("int") + 1)
    default = F.create_map(F.lit("fh1"), F.lit("default"))
    row = F.create_map(F.lit("fc1"), F.lit("line"))
    out = rv.switch_structure(docs, to, default, F.array(row, row))
    first = F.get("invoice_entries", F.lit(0))
    return out.select(
        "o_orderkey", "structure_type", F.try_element_at("invoice_header", F.lit("fh1")).alias("header_no"), F.size("sublist_rows").alias("n_rows"), F.size("invoice_entries").alias("n_entries"),
        F.try_element_at(first["header"], F.lit("fh1")).alias("entry_no"), F.coalesce(F.size(first["rows"]), F.lit(-1)).alias("entry_rows"),
    )


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_TOP, _MID = (x.split(m) for x, m in ((pr.PROMPT_TOP, "{header}"), (pr.PROMPT_COLUMNS, "{columns}")))
_FIELDS = "f AS (SELECT p_brand, CASE WHEN p_size <= 25 OR p_brand LIKE '%5' THEN 'header' ELSE 'sublist' END AS scope, p_partkey AS pos, p_name AS field_key, p_type AS label FROM part)"


def part_fields(spark: SparkSession, d: str) -> DataFrame:
    scope = F.when((F.col("p_size") <= 25) | F.col("p_brand").endswith("5"), "header").otherwise("sublist")
    return b.read(spark, d, "part").select("p_brand", scope.alias("scope"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("field_key"), F.col("p_type").alias("label"))


@query(
    f"""WITH {_FIELDS}, g AS (SELECT p_brand, coalesce(string_agg('- ' || field_key || '：' || label, chr(10) ORDER BY pos) FILTER (scope = 'header'), '') AS h, string_agg('- ' || field_key || '：' || label, chr(10) ORDER BY pos) FILTER (scope = 'sublist') AS c FROM f GROUP BY 1)
    SELECT p_brand, concat({_text(_TOP[0])}, h, CASE WHEN c IS NOT NULL THEN concat({_text(_MID[0])}, c) ELSE '' END, {_text(pr.PROMPT_SHAPE)}, CASE WHEN c IS NOT NULL THEN {_text(pr.PROMPT_ROWS)} ELSE {_text(pr.PROMPT_NO_ROWS)} END, {_text(pr.PROMPT_END)}) AS prompt FROM g"""
)
def q68_page_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Every brand as a template whose fields are its parts."""
    return pr.page_prompts(part_fields(spark, d), "p_brand")


@query(
    f"""WITH g AS (SELECT p_brand, string_agg('- ' || p_name, chr(10) ORDER BY p_partkey) FILTER (p_size > 45) AS rules, string_agg('- ' || p_type, chr(10) ORDER BY p_partkey) FILTER (p_size < 5) AS hints FROM part GROUP BY ALL)
    SELECT p_brand, concat_ws(chr(10), {_text(pr.RULES_TITLE)} || chr(10) || rules, {_text(pr.HINTS_TITLE)} || chr(10) || hints, CASE WHEN rules IS NULL AND hints IS NULL THEN {_text(pr.NO_RULES)} END) AS block FROM g"""
)
def q68b_hint_block(spark: SparkSession, d: str) -> DataFrame:
    listed = lambda test, c: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("p_partkey", c)))), lambda x: x[c])
    rows = b.read(spark, d, "part").groupBy("p_brand").agg(listed(F.col("p_size") > 45, "p_name").alias("rules"), listed(F.col("p_size") < 5, "p_type").alias("hints"))
    return rows.select("p_brand", pr.hint_block(F.col("rules"), F.col("hints")).alias("block"))


@query(
    """WITH t AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'system') AS old_s, arg_max(text, turn) FILTER (role = 'user') AS old_u, arg_min(text, turn) FILTER (role = 'assistant') AS new_s, count(*) AS turns FROM conversations GROUP BY 1)
    SELECT conv_id, CASE WHEN turns % 4 = 1 OR new_s IS NULL THEN false ELSE true END AS changed, CASE WHEN turns % 4 = 1 OR new_s IS NULL THEN old_s ELSE new_s END AS system,
    CASE WHEN turns % 4 = 1 OR new_s IS NULL THEN NULL ELSE concat('read ', old_u) END AS "user" FROM t WHERE old_u IS NOT NULL"""
)
def q69_apply_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Whole conversations as requests; the first assistant text becomes the system prompt, an optimiser's reply carries both."""
    c = b.read(spark, d, "conversations")
    role = lambda r: F.when(F.col("role") == r, F.col("turn"))
    chats = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"), F.min_by("text", role("assistant")).alias("new_s"), F.max_by("text", role("user")).alias("old_u"),
        F.min_by("text", role("system")).alias("old_s"), F.count(F.lit(1)).alias("turns"),
    )
    sent = F.to_json(F.struct(F.lit("m").alias("model"), F.transform("messages", lambda m: m.dropFields("turn")).alias("messages")))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("new_s").alias("system_prompt"), F.array(F.lit("a"), F.lit(" ")).alias("classification_hints"))), F.lit("\n```"))
    rows = chats.filter("old_u is not null").select("conv_id", "old_s", sent.alias("request"), pr.optimised(reply).alias("x"), F.when(F.col("turns") % 4 == 1, " ").otherwise(F.concat(F.lit("read "), F.col("old_u"))).alias("u"))
    out = pr.apply_prompts(rows.select("conv_id", "old_s", "request", F.col("x.system_prompt").alias("s"), "u"), "request", "s", "u")
    changed = F.col("body") != F.col("request")
    v = F.try_parse_json("body")
    at = lambda path: F.when(changed, F.try_variant_get(v, path, "string"))
    return out.select("conv_id", changed.alias("changed"), F.coalesce(at("$.messages[0].content"), "old_s").alias("system"), at("$.messages[1].content").alias("user"))


@query(
    f"""WITH {_LINES}, x AS (SELECT *, l_returnflag = 'R' AS gone, l_linestatus = 'O' AS more, l_returnflag || l_partkey AS said FROM lines),
    own AS (SELECT l_orderkey, coalesce(string_agg(pos || '=' || said, ',' ORDER BY pos) FILTER (NOT gone), '') AS a, coalesce(string_agg((100 + pos) || '=', ',' ORDER BY pos) FILTER (more), '') AS b, max(said) FILTER (pos = 1) AS head FROM x GROUP BY 1)
    SELECT l_orderkey AS o_orderkey, concat_ws(',', nullif(a, ''), nullif(b, '')) AS rows, head AS field, nullif(b, '') AS entry_rows FROM own"""
)
def q70_edits(spark: SparkSession, d: str) -> DataFrame:
    """Each line edits its order's document: its row is set twice and removed if it was returned; open lines add rows to the
    document and to its entry, the first line sets the entry's field and another entry is added and removed."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*b.LINE_ORDER.split(", "))).cast("long")
    line = b.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), place.alias("pos"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("said"), "l_returnflag", "l_linestatus")
    cells = dc.empty(dc.CELLS)
    row = F.struct(F.col("pos").alias("id"), cells.alias("cells"))
    entry = F.array(F.struct(F.lit(1).cast("long").alias("id"), cells.alias("header"), F.array().cast(f"array<{ed.ROW}>").alias("rows")))
    docs = line.groupBy("o_orderkey").agg(F.sort_array(F.collect_list("pos")).alias("ids")).select("o_orderkey", F.transform("ids", lambda i: F.struct(i.alias("id"), cells.alias("cells"))).alias("rows"), entry.alias("entries"))
    no = F.lit(None).cast("long")

    def edit(seq: Column, op: str, entry: Column, row: Column, field: str, value: Column, when: Column) -> Column:
        return F.when(when, F.struct(seq.cast("long").alias("seq"), F.lit(op).alias("op"), entry.cast("long").alias("entry"), row.cast("long").alias("row"), F.lit(field).alias("field"), value.alias("value")))

    pos, said, always = F.col("pos"), F.col("said"), F.lit(True)
    at = lambda k: pos * 10 + k
    returned, open_ = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    made = F.array(
        edit(at(0), "set_cell", no, pos, "fc1", F.lit("old"), always), edit(at(1), "set_cell", no, pos, "fc1", said, always), edit(at(2), "remove_row", no, pos, "", said, returned),
        edit(at(3), "add_row", no, pos + 100, "", said, open_), edit(at(4), "add_row", F.lit(1), pos + 100, "", said, open_), edit(at(5), "set_field", F.lit(1), no, "fh1", said, pos == 1),
        edit(at(6), "add_entry", F.lit(2), no, "", said, pos == 1), edit(at(7), "remove_entry", F.lit(2), no, "", said, pos == 1), edit(at(8), "set_cell", F.lit(9), pos, "fc1", said, always),
    )
    edits = line.select("o_orderkey", F.explode(F.array_compact(made)).alias("e")).select("o_orderkey", "e.*")
    out = ed.apply_edits(docs, edits, "o_orderkey")
    shown = lambda rows: F.array_join(F.transform(rows, lambda r: F.concat(r["id"].cast("string"), F.lit("="), F.coalesce(F.try_element_at(r["cells"], F.lit("fc1")), F.lit("")))), ",")
    first = F.get("entries", F.lit(0))
    return out.select("o_orderkey", shown(F.col("rows")).alias("rows"), F.when(F.size("entries") == 1, first["header"]["fh1"]).alias("field"), F.nullif(shown(first["rows"]), F.lit("")).alias("entry_rows"))


@query(
    """SELECT doc_id, CASE WHEN source = 'src7' THEN 'layout' WHEN toxic IS NULL THEN 'category' WHEN quality = 0 AND n_chars % 2 = 0 THEN 'syntax' WHEN quality = 0 THEN 'not_object' WHEN toxic = 1 AND n_chars % 3 = 0 THEN 'no_answer'
    WHEN n_chars > 9000 THEN 'too_large' WHEN n_chars % 5 = 0 THEN 'type' END AS problem FROM documents LEFT JOIN labels USING (doc_id)"""
)
def q71_example_checks(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as examples: their source is the layout, their text the answer; a size of 2912.5 bytes a character, so that 9000 of them are just within 25 MB."""
    rows = b.read(spark, d, "documents").join(b.read(spark, d, "labels"), "doc_id", "left")
    layout = F.when(F.col("source") == "src7", "src 7").otherwise(F.col("source"))
    category = F.when(F.col("toxic") == 1, "target").when(F.col("toxic") == 0, "non_target")
    text = F.to_json(F.struct("text"))
    answer = F.when((F.col("quality") == 0) & (F.col("n_chars") % 2 == 0), F.substring(text, F.lit(1), F.length(text) - 1)).when(F.col("quality") == 0, F.concat(F.lit("["), text, F.lit("]"))).when((F.col("toxic") == 1) & (F.col("n_chars") % 3 == 0), "{}").otherwise(text)
    name = F.when(F.col("n_chars") % 5 == 0, "a.txt").otherwise("a.PDF")
    return rows.select("doc_id", ed.example_problem(layout, category, name, answer, F.col("text").cast("binary"), (F.col("n_chars") * 5825 / 2).cast("long")).alias("problem"))


@query(
    """WITH c AS (SELECT doc_id, quality, toxic, n_chars / 10000 AS part FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, CASE WHEN quality IS NULL THEN true ELSE toxic = 1 END AS is_target, CASE WHEN quality IS NULL THEN 0 WHEN quality = 0 THEN 0.5 ELSE least(1, part) END::DOUBLE AS confidence,
    CASE WHEN quality IS NULL THEN '预判结果无法解析，已安全回退到高清抽取' WHEN toxic = 1 THEN '模型未提供判定理由' ELSE text END AS reason FROM c JOIN documents USING (doc_id)"""
)
def q72_classification(spark: SparkSession, d: str) -> DataFrame:
    """Labels as a classifier's replies that carry whole texts; documents without labels have replies that are cut off."""
    rows = b.read(spark, d, "documents").join(b.read(spark, d, "labels"), "doc_id", "left")
    confidence = F.when(F.col("quality") == 0, F.lit('"high"')).otherwise((F.col("n_chars") / 10000).cast("string"))
    target = F.when(F.col("toxic") == 1, '"true"').otherwise("false")
    reason = F.when(F.col("toxic") == 1, "7").otherwise(F.get(F.split(F.to_json(F.struct(F.col("text").alias("x"))), r'^\{"x":|\}$'), F.lit(1)))
    whole = F.concat(F.lit('Answer: {"is_target": '), target, F.lit(', "confidence": '), confidence, F.lit(', "reason": '), reason, F.lit("} ok"))
    reply = F.when(F.col("quality").isNotNull(), whole).otherwise(F.concat(F.lit('{"is_target": '), F.col("text")))
    return rows.select("doc_id", ed.classification(reply).alias("x")).select("doc_id", "x.*")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_custkey % 2 = 0 ELSE false END AS cancel_requested, coalesce(shown, '') AS documents FROM orders LEFT JOIN
    (SELECT l_orderkey, string_agg(concat(l_linenumber, ':', l_returnflag, ':', CASE WHEN l_linestatus = 'F' THEN l_suppkey ELSE 0 END, ':', CASE WHEN l_returnflag = 'N' THEN 'false' ELSE 'true' END), ',' ORDER BY l_linenumber, l_returnflag, CASE WHEN l_linestatus = 'F' THEN l_suppkey ELSE 0 END) AS shown FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def q73_public_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs and their lines as documents, as the server shows them."""
    jobs = b.read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") % 2 == 0).alias("cancel_requested"))
    path = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("results/"), F.col("l_partkey").cast("string")))
    docs = b.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("status"), F.when(F.col("l_linestatus") == "F", F.col("l_suppkey")).alias("done"),
        F.lit(None).cast("long").alias("total"), F.lit(None).cast("array<string>").alias("page_outcomes"), F.lit(None).cast("string").alias("note"), path.alias("result_path"),
    )
    one = lambda x: F.concat_ws(":", x["pos"].cast("string"), x["status"], x["progress"]["done"].cast("string"), x["has_result"].cast("string"))
    return ed.public_jobs(jobs, docs, "o_orderkey").select("o_orderkey", "cancel_requested", F.array_join(F.transform("documents", one), ",").alias("documents"))
