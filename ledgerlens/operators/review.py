"""Review view of an extraction: typed replies, saved exports read back, and the switch between the four structures.

Columns are those of labelled documents: field_values and invoice_header (maps by field id), sublist_rows (array of
such maps), invoice_entries (array of structs header, rows). Field lists are arrays of structs field_id, field_key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.requests import is_kind, kind, part
from ledgerlens.functions.values import let, trim_ws
from ledgerlens.sources.exports import items, record, records, scalar_text

from .documents import CELLS, empty, has_values, rename, rename_rows

INVOICES = f"array<struct<header:{CELLS},sublist:array<{CELLS}>>>"


def _records(v: Column, path: str) -> Column:
    """The objects of an array that have a member, each as map of variants; no array gives none."""
    found = F.filter(F.coalesce(items(v, path), F.array().cast("array<variant>")), lambda x: F.coalesce(kind(x) == "object", F.lit(False)))
    return F.filter(F.transform(found, lambda x: F.try_variant_get(x, "$", "map<string,variant>")), lambda m: F.map_contains_key(m, F.lit("")) | (F.size(m) > 0))


def kept_keys(members: Column, keys: Column) -> Column:
    """A map of variants -> map of texts with exactly these keys, trimmed; what is missing, null, an object or an array is ''."""
    value = lambda k: trim_ws(F.coalesce(scalar_text(F.try_element_at(members, k)), F.lit("")))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, value(k))))


def typed_replies(replies: DataFrame, v: str, header_keys: Column, column_keys: Column) -> DataFrame:
    """replies with is_target, invoices and orphan_sublist of the model's answer, a variant in column v.

    Whatever the answer is, the result has its whole type: is_target only for true or "true"; an invoice for each
    element of invoices, also one that is no object, with every header key; rows that are empty or no objects go,
    others have every column key; header and columns without any value stay as empty texts. A null answer gives
    false and two empty arrays.
    """
    x = F.col(v)
    target = F.coalesce(F.try_variant_get(x, "$.is_target", "string") == "true", F.lit(False)) & (is_kind(x, "$.is_target", "boolean") | is_kind(x, "$.is_target", "string"))
    none = F.create_map().cast("map<string,variant>")
    rows = lambda y, path: F.transform(_records(y, path), lambda m: kept_keys(m, column_keys))
    header = lambda y: kept_keys(F.coalesce(F.try_variant_get(y, "$.header", "map<string,variant>"), none), header_keys)
    listed = F.coalesce(items(x, "$.invoices"), F.array().cast("array<variant>"))
    invoices = F.transform(listed, lambda y: F.struct(header(y).alias("header"), rows(y, "$.sublist").alias("sublist")))
    return replies.withColumns({"is_target": target, "invoices": invoices, "orphan_sublist": rows(x, "$.orphan_sublist")})


def saved_invoices(v: Column) -> Column:
    """A saved export, a variant -> struct(structure_type, invoices); null where it has none of the four shapes. The first
    that it has decides, a list of invoices is single when it has at most one."""
    rows = lambda x, path: F.coalesce(records(x, path), empty(f"array<{CELLS}>"))
    one = lambda header, lines: F.struct(header.alias("header"), lines.alias("sublist"))
    out = lambda name, invoices: F.struct(name.alias("structure_type"), invoices.cast(INVOICES).alias("invoices"))
    has = lambda p: part(v, p).isNotNull()
    bare = empty(f"array<{CELLS}>")
    found = F.struct(items(v, "$.invoicesWithSublist").alias("with_rows"), items(v, "$.invoices").alias("plain"))
    return let(found, lambda p: (
        F.when(p["with_rows"].isNotNull(), out(F.lit("multi_invoice_with_sublist"), F.transform(p["with_rows"], lambda x: one(record(x, "$.invoice"), rows(x, "$.sublist")))))
        .when(has("$.invoice") | has("$.sublist"), out(F.lit("invoice_with_sublist"), F.array(one(record(v, "$.invoice"), rows(v, "$.sublist")))))
        .when(p["plain"].isNotNull(), out(F.when(F.size(p["plain"]) > 1, "multi_invoice").otherwise("single"), F.transform(records(v, "$.invoices"), lambda h: one(h, bare))))
        .when(has("$.fields"), out(F.lit("single"), F.array(one(record(v, "$.fields"), bare))))
    ))


def review_view(docs: DataFrame, invoices: str, header_fields: Column, columns: Column) -> DataFrame:
    """docs with an array of (header, sublist) by field key -> field_values, invoice_header, sublist_rows and
    invoice_entries by field id, so that every structure can be shown. Each field is there, '' where it has no value;
    where there is no row an empty one stands, and an empty entry without rows where there is no invoice."""
    one_row = F.array(empty(CELLS))
    shown = lambda rows: F.when(F.size(rows) > 0, rename_rows(rows, columns, "field_key", "field_id")).otherwise(one_row)
    entries = F.transform(invoices, lambda x: F.struct(rename(x["header"], header_fields, "field_key", "field_id").alias("header"), shown(x["sublist"]).alias("rows")))
    blank = F.array(F.struct(empty(CELLS).alias("header"), F.lit(None).cast(f"array<{CELLS}>").alias("rows")))
    some = F.size(F.coalesce(F.col(invoices), F.array().cast(INVOICES))) > 0
    there = F.get(invoices, F.lit(0)).isNotNull()

    def parts(e: Column) -> Column:
        header, rows = F.when(there, e[0]["header"]).otherwise(empty(CELLS)), F.when(there, e[0]["rows"]).otherwise(one_row)
        return F.struct(header.alias("field_values"), header.alias("invoice_header"), rows.alias("sublist_rows"), e.alias("invoice_entries"))

    kept = [c for c in docs.columns if c not in ("field_values", "invoice_header", "sublist_rows", "invoice_entries")]
    return docs.select(*kept, F.inline(F.array(let(F.when(some, entries).otherwise(blank), parts))))


def review_of_exports(saved: DataFrame, v: str, header_fields: Column, columns: Column) -> DataFrame:
    """Saved exports, variants in column v -> their review data with structure_type; those without a known shape go. A
    text is read once: a filter of what is found would have it read again for each of its conditions."""
    opened = saved.select(*saved.columns, F.inline(F.filter(F.array(saved_invoices(F.col(v))), lambda x: x.isNotNull())))
    return review_view(opened, "invoices", header_fields, columns).drop("invoices")


def switch_structure(docs: DataFrame, to: Column, default_header: Column, default_rows: Column) -> DataFrame:
    """Documents under another structure, with what that one needs filled in and all else kept.

    Several invoices get an entry where there is none. With rows, entries without header or without a filled row
    get the template's defaults. An invoice with rows takes its empty header from the single fields, and one empty
    row where it has none."""
    with_rows = to == "multi_invoice_with_sublist"
    entry = lambda header, rows: F.array(F.struct(header.alias("header"), rows.alias("rows")))
    none = F.size(F.coalesce("invoice_entries", F.array())) <= 0
    entries = F.when(none & with_rows, entry(default_header, default_rows)).when(none, entry(empty(CELLS), F.lit(None).cast(f"array<{CELLS}>"))).otherwise(F.col("invoice_entries"))
    filled = lambda rows: F.coalesce(F.exists(rows, has_values), F.lit(False))
    whole = lambda e: F.struct(F.when(F.size(e["header"]) > 0, e["header"]).otherwise(default_header).alias("header"), F.when(filled(e["rows"]), e["rows"]).otherwise(default_rows).alias("rows"))
    single = to == "invoice_with_sublist"
    return docs.withColumns({
        "structure_type": to,
        "invoice_entries": F.when(with_rows, F.transform(entries, whole)).when(to == "multi_invoice", entries).otherwise(F.col("invoice_entries")),
        "invoice_header": F.when(single & (F.size("invoice_header") <= 0), F.col("field_values")).otherwise(F.col("invoice_header")),
        "sublist_rows": F.when(single & (F.size("sublist_rows") <= 0), F.array(empty(CELLS))).otherwise(F.col("sublist_rows")),
    })
