"""Labelled documents: annotated or not, export by structure, migration of stored ones, ids to keys and back.

A document has category, structure_type, field_values and invoice_header (maps by field id), sublist_rows
(array of such maps) and invoice_entries (array of structs header, rows). Field lists are arrays of structs
field_id, field_key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.values import let, trim_ws

from .templates import TEMPLATES

BASE = ["file_name", "file_size", "category", "structure_type", "note", "updated_at"]
EXPORT_NAMES = ["fileName", "fileSize", "category", "structureType", "note", "updatedAt"]  # fixed values that results depend on
CELLS = "map<string,string>"
ENTRIES = f"array<struct<header:{CELLS},rows:array<{CELLS}>>>"


def empty(kind: str) -> Column:
    return F.create_map().cast(kind) if kind.startswith("map") else F.array().cast(kind)


def filled_count(cells: Column) -> Column:
    """How many values of a map are not blank."""
    return F.coalesce(F.array_size(F.filter(F.map_values(cells), lambda x: F.coalesce(trim_ws(x) != "", F.lit(False)))), F.lit(0))


def has_values(cells: Column) -> Column:
    return F.coalesce(F.exists(F.map_values(cells), lambda x: F.coalesce(trim_ws(x) != "", F.lit(False))), F.lit(False))


def annotated(category: Column, structure: Column, fields: Column, header: Column, rows: Column, entries: Column) -> Column:
    """A document without category is not annotated, a non-target one is; a target one is if its structure holds a value."""
    some = lambda array, test: F.coalesce(F.exists(array, test), F.lit(False))
    return (
        F.when(F.coalesce(category, F.lit("")) == "", False)
        .when(category == "non_target", True)
        .when(structure == "multi_invoice", some(entries, lambda e: has_values(e["header"])))
        .when(structure == "multi_invoice_with_sublist", some(entries, lambda e: has_values(e["header"]) | some(e["rows"], has_values)))
        .when(structure == "invoice_with_sublist", has_values(header) | some(rows, has_values))
        .otherwise(has_values(fields))
    )


def rename(cells: Column, fields: Column, source: str, target: str) -> Column:
    """A map by one name of the fields (field_id or field_key) -> by the other: every field listed, '' where
    it has no value, the last one where two share a name."""
    return let(_named(fields, target), lambda named: _renamed(cells, named, source, target))


def rename_rows(rows: Column, fields: Column, source: str, target: str) -> Column:
    """rename for each map of an array; the fields' names are told apart once for all of them."""
    return let(_named(fields, target), lambda named: F.transform(rows, lambda m: _renamed(m, named, source, target)))


def _named(fields: Column, target: str) -> Column:
    """The fields without those whose name under target a later one has; nothing is to be done where all names differ."""
    names = F.array_distinct(fields[target])
    last = F.transform(names, lambda name: F.element_at(F.filter(fields, lambda f: f[target] == name), -1))
    return F.when(F.size(names) == F.size(fields), fields).otherwise(last)


def _renamed(cells: Column, named: Column, source: str, target: str) -> Column:
    return F.map_from_arrays(named[target], F.transform(named, lambda f: F.coalesce(F.try_element_at(cells, f[source]), F.lit(""))))


def export_json(header_fields: Column, columns: Column) -> Column:
    """JSON of a document as its structure asks, values under field keys, nulls of the document itself kept."""
    head = lambda m: rename(m, header_fields, "field_id", "field_key")
    listed = lambda rows: rename_rows(F.coalesce(rows, empty(f"array<{CELLS}>")), columns, "field_id", "field_key")
    entry = lambda e: F.struct(head(e["header"]).alias("invoice"), listed(e["rows"]).alias("sublist"))
    base = [F.col(c).alias(name) for c, name in zip(BASE, EXPORT_NAMES)]
    text = lambda *parts: F.to_json(F.struct(*base, *parts), {"ignoreNullFields": "false"})
    kind = F.col("structure_type")
    return (
        F.when(kind == "multi_invoice", text(rename_rows(F.transform("invoice_entries", lambda e: e["header"]), header_fields, "field_id", "field_key").alias("invoices")))
        .when(kind == "multi_invoice_with_sublist", text(F.transform("invoice_entries", entry).alias("invoicesWithSublist")))
        .when(kind == "invoice_with_sublist", text(head(F.col("invoice_header")).alias("invoice"), listed(F.col("sublist_rows")).alias("sublist")))
        .otherwise(text(head(F.col("field_values")).alias("fields")))
    )


def migrate(stored: DataFrame) -> DataFrame:
    """Stored documents, any part of which may be null -> whole ones: single structure, empty maps, one empty
    row or entry where there is none; entries with rows get an empty row too."""
    one_row = F.array(empty(CELLS))
    rows_or_one = lambda r: F.when(F.size(F.coalesce(r, empty(f"array<{CELLS}>"))) > 0, r).otherwise(one_row)
    entries = F.col("invoice_entries")
    blank = F.array(F.struct(empty(CELLS).alias("header"), F.lit(None).cast(f"array<{CELLS}>").alias("rows")))
    entries = F.when(F.size(F.coalesce(entries, empty(ENTRIES))) > 0, entries).otherwise(blank)
    with_rows = F.transform(entries, lambda e: F.struct(e["header"].alias("header"), rows_or_one(e["rows"]).alias("rows")))
    return stored.withColumns({
        "structure_type": F.coalesce("structure_type", F.lit("single")),
        "field_values": F.coalesce("field_values", empty(CELLS)),
        "invoice_header": F.coalesce("invoice_header", empty(CELLS)),
        "sublist_rows": rows_or_one(F.col("sublist_rows")),
        "invoice_entries": F.when(F.col("structure_type") == "multi_invoice_with_sublist", with_rows).otherwise(entries),
    })


def migrate_batch(stored: DataFrame, default_header: Column, default_columns: Column) -> DataFrame:
    """Stored batches (layout_template_id, header_fields, predefined_fields, sublist_columns) with the older
    name of the header fields honoured and defaults for what is null."""
    return stored.withColumns({
        "layout_template_id": F.coalesce("layout_template_id", F.lit(TEMPLATES[0])),
        "header_fields": F.coalesce("header_fields", "predefined_fields", default_header),
        "sublist_columns": F.coalesce("sublist_columns", default_columns),
    }).drop("predefined_fields")


def without_field(cells: Column, field_id: Column) -> Column:
    return F.map_filter(cells, lambda k, _: k != field_id)
