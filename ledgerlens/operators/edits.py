"""Templates' defaults, new documents, ordered edits by id, checks of examples and what the public sees of stored rows.

Entries and rows have ids here: entries array<struct<id, header map, rows array<struct<id, cells map>>>>, rows
array<struct<id, cells map>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.requests import is_kind, kind, sample_type
from ledgerlens.functions.text import json_part

from .documents import CELLS, empty

ROW = f"struct<id:bigint,cells:{CELLS}>"
ENTRY = f"struct<id:bigint,header:{CELLS},rows:array<{ROW}>>"
LAYOUT_ID = r"\A[A-Za-z0-9_-]{1,64}\z"  # fixed values that results depend on
NO_REASON, UNREADABLE = "模型未提供判定理由", "预判结果无法解析，已安全回退到高清抽取"


def default_cells(defaults: Column, fields: Column) -> Column:
    """A template's defaults by field key -> by field id; blank ones and keys that are no field go."""
    value = lambda f: F.try_element_at(defaults, f["field_key"])
    kept = F.filter(fields, lambda f: F.coalesce(value(f) != "", F.lit(False)))
    return F.map_from_entries(F.transform(kept, lambda f: F.struct(f["field_id"], value(f))))


def default_rows(defaults: Column, columns: Column) -> Column:
    """Default rows by column id, or one empty row where the template has none."""
    some = F.coalesce(F.size(defaults) > 0, F.lit(False))
    return F.when(some, F.transform(defaults, lambda row: default_cells(row, columns))).otherwise(F.array(empty(CELLS)))


def with_defaults(docs: DataFrame, header: Column, rows: Column) -> DataFrame:
    """Documents under a template's defaults, by field id. They replace all rows, and every entry's header; an
    invoice with rows keeps what its header has beside them. Other structures stay as they are."""
    many, one = F.col("structure_type") == "multi_invoice_with_sublist", F.col("structure_type") == "invoice_with_sublist"
    entries = F.transform("invoice_entries", lambda e: F.struct(header.alias("header"), rows.alias("rows")))
    merged = F.map_concat(F.map_filter("invoice_header", lambda k, _: ~F.map_contains_key(header, k)), header)
    return docs.withColumns({
        "invoice_entries": F.when(many, entries).otherwise(F.col("invoice_entries")),
        "invoice_header": F.when(one, merged).otherwise(F.col("invoice_header")),
        "sublist_rows": F.when(one, rows).otherwise(F.col("sublist_rows")),
    })


def new_documents(files: DataFrame, header: Column, rows: Column) -> DataFrame:
    """files(file_name, file_size, ...) -> with the parts of a document that nobody has labelled yet."""
    blank = F.array(F.struct(empty(CELLS).alias("header"), F.lit(None).cast(f"array<{CELLS}>").alias("rows")))
    none = F.lit(None).cast("string")
    return files.withColumns({
        "category": none, "structure_type": F.lit("single"), "field_values": empty(CELLS), "invoice_entries": blank,
        "invoice_header": header, "sublist_rows": rows, "note": F.lit(""), "updated_at": none,
    })


def _put(cells: Column, field: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(cells, lambda k, _: k != field), F.create_map(field, value))


def _rows_after(rows: Column, e: Column) -> Column:
    """Rows after one edit of theirs."""
    changed = F.transform(rows, lambda r: F.when(r["id"] == e["row"], F.struct(r["id"].alias("id"), _put(r["cells"], e["field"], e["value"]).alias("cells"))).otherwise(r))
    added = F.concat(rows, F.array(F.struct(e["row"].alias("id"), empty(CELLS).alias("cells"))))
    return F.when(e["op"] == "set_cell", changed).when(e["op"] == "add_row", added).when(e["op"] == "remove_row", F.filter(rows, lambda r: r["id"] != e["row"])).otherwise(rows)


def apply_edits(docs: DataFrame, edits: DataFrame, doc: str) -> DataFrame:
    """docs(doc, rows, entries, ...) after edits(doc, seq, op, entry, row, field, value), each document's in order of seq.

    op is add_entry, remove_entry, set_field (of an entry), add_row, remove_row or set_cell; the last three are of an
    entry where it is given, else of the document's own rows. An edit of an id that is not there changes nothing; a
    document without edits stays. A document's edits are folded in one row, as an editor holds them."""
    one = F.struct("seq", "op", "entry", "row", "field", "value")
    listed = edits.groupBy(doc).agg(F.array_sort(F.collect_list(one)).alias("edits"))
    some_rows = lambda r: F.coalesce(r, F.array().cast(f"array<{ROW}>"))

    def entry_after(x: Column, e: Column) -> Column:
        header = F.when(e["op"] == "set_field", _put(x["header"], e["field"], e["value"])).otherwise(x["header"])
        return F.struct(x["id"].alias("id"), header.alias("header"), _rows_after(some_rows(x["rows"]), e).alias("rows"))

    def step(acc: Column, e: Column) -> Column:
        of_entry = F.transform(acc["entries"], lambda x: F.when(x["id"] == e["entry"], entry_after(x, e)).otherwise(x))
        blank = F.struct(e["entry"].alias("id"), empty(CELLS).alias("header"), F.array().cast(f"array<{ROW}>").alias("rows"))
        entries = (
            F.when(e["op"] == "add_entry", F.concat(acc["entries"], F.array(blank)))
            .when(e["op"] == "remove_entry", F.filter(acc["entries"], lambda x: x["id"] != e["entry"]))
            .when(e["entry"].isNotNull(), of_entry).otherwise(acc["entries"])
        )
        return F.struct(entries.alias("entries"), F.when(e["entry"].isNull(), _rows_after(acc["rows"], e)).otherwise(acc["rows"]).alias("rows"))

    start = F.struct(F.coalesce("entries", F.array()).cast(f"array<{ENTRY}>").alias("entries"), some_rows(F.col("rows")).cast(f"array<{ROW}>").alias("rows"))
    folded = docs.join(listed, doc, "left").withColumn("after", F.aggregate(F.coalesce("edits", F.array()), start, step))
    return folded.select(*[F.col(f"after.{c}").alias(c) if c in ("rows", "entries") else F.col(c) for c in docs.columns])


def example_problem(layout: Column, category: Column, name: Column, answer: Column, head: Column, size: Column, mb: int = 25) -> Column:
    """Why an example is refused, in the order of the checks; null if it is taken. head: the sample's first bytes."""
    v = F.try_parse_json(answer)
    return (
        F.when(~F.coalesce(layout.rlike(LAYOUT_ID), F.lit(False)), "layout").when(~F.coalesce(category.isin("target", "non_target"), F.lit(False)), "category")
        .when(F.coalesce(name, F.lit("")) == "", "no_file").when(v.isNull(), "syntax").when(kind(v) != "object", "not_object")
        .when((category == "target") & (F.to_json(v) == "{}"), "no_answer").when(size > mb * 1024 * 1024, "too_large").when(sample_type(name, head).isNull(), "type")
    )


def public_examples(examples: DataFrame) -> DataFrame:
    """Stored examples as they are shown: without their path, with the kind of file and the address of the sample."""
    media = F.when(F.lower("file_name").endswith(".pdf"), "pdf").otherwise("image")
    return examples.drop("pdf_path").withColumns({"media_type": media, "pdf_url": F.concat(F.lit("/api/label/examples/"), F.col("id").cast("string"), F.lit("/pdf"))})


def public_jobs(jobs: DataFrame, docs: DataFrame, job: str) -> DataFrame:
    """jobs(job, status, cancel_requested, ...) with their documents as they are shown: docs(job, pos, ..., done, total,
    page_outcomes, note, result_path) in order, without the path but whether there is a result, and with empty values
    for what is not known yet. A job without documents has an empty list."""
    progress = F.struct(F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("total", F.lit(0)).alias("total")).alias("progress")
    outcomes = F.coalesce("page_outcomes", F.array().cast("array<string>")).alias("page_outcomes")
    told = [c for c in docs.columns if c not in (job, "pos", "done", "total", "page_outcomes", "note", "result_path")]
    has = (F.coalesce("result_path", F.lit("")) != "").alias("has_result")
    shown = F.struct("pos", *told, progress, outcomes, has, F.coalesce("note", F.lit("")).alias("note"))
    kind = docs.select(shown.alias("x")).schema["x"].dataType.simpleString()
    listed = docs.groupBy(job).agg(F.array_sort(F.collect_list(shown)).alias("documents"))
    out = jobs.withColumn("cancel_requested", F.coalesce("cancel_requested", F.lit(False))).join(listed, job, "left")
    return out.withColumn("documents", F.coalesce("documents", F.array().cast(f"array<{kind}>")))


def classification(reply: Column) -> Column:
    """A classifier's reply -> struct(is_target, confidence, reason): confidence within 0 and 1, 0.5 where it is no number. A
    reply that cannot be read is a target with confidence 0, so that no page is lost."""
    v = F.try_parse_json(json_part(reply))
    said = F.try_variant_get(v, "$.confidence", "double")
    confidence = F.when(is_kind(v, "$.confidence", "number"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), said))).otherwise(0.5)
    target = F.coalesce(F.try_variant_get(v, "$.is_target", "string") == "true", F.lit(False)) & (is_kind(v, "$.is_target", "boolean") | is_kind(v, "$.is_target", "string"))
    reason = F.when(is_kind(v, "$.reason", "string"), F.try_variant_get(v, "$.reason", "string")).otherwise(NO_REASON)
    bad = F.coalesce(kind(v) != "object", F.lit(True))
    return F.struct(F.when(bad, True).otherwise(target).alias("is_target"), F.when(bad, 0.0).otherwise(confidence).alias("confidence"), F.when(bad, UNREADABLE).otherwise(reason).alias("reason"))


def first_pages(pages: DataFrame, doc: str, page: str, limit: int | None) -> DataFrame:
    """The pages of each document that a reader with a page limit gets; all of them without one. Pages are numbered from 0."""
    return pages if limit is None else pages.filter(F.col(page) < limit)


def data_url(encoded: Column, mime: Column) -> Column:
    """A base64 image as an address that carries it; null for no image, JPEG where the kind is not known."""
    return F.when(F.coalesce(encoded, F.lit("")) != "", F.concat(F.lit("data:"), F.coalesce(mime, F.lit("image/jpeg")), F.lit(";base64,"), encoded))
