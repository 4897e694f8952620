"""Labelling batches, examples and templates as joins, windows and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions.values import trim_ws

from .templates import HEADER_TOTAL_KEYS, LINE_AMOUNT_KEYS


def amount_fields(fields: DataFrame) -> DataFrame:
    """fields(template_id, scope, pos, field_id, field_key, label) -> the one that holds the amount, for
    each template and scope that has one: by key in order of preference, else by label, first wins."""
    rank = F.lit(None).cast("int")
    for scope, keys in (("header", HEADER_TOTAL_KEYS), ("sublist", LINE_AMOUNT_KEYS)):
        at = F.array_position(F.array(*map(F.lit, keys)), F.lower("field_key")).cast("int")
        rank = F.when((F.col("scope") == scope) & (at > 0), at).otherwise(rank)
    label = F.when(F.col("scope") == "header", F.col("label").rlike("(?i)合计|total")).otherwise(F.col("label").rlike("(?i)收费|合计|charges|total") & ~F.col("label").rlike("(?i)description|描述"))
    ranked = fields.withColumn("rank", F.coalesce(rank, F.when(label, 99))).filter("rank is not null")
    return ranked.groupBy("template_id", "scope").agg(F.min_by("field_id", F.struct("rank", "pos")).alias("field_id"))


def remap(values: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """values(doc, field_id, value) under the old template's ids -> under the new one's, by key.
    Blank values and keys that the new template lacks go. old and new are template dimensions."""
    by_key = old.select("field_id", "field_key").join(new.select(F.col("field_id").alias("new_id"), "field_key"), "field_key").select("field_id", "new_id")
    return values.filter(trim_ws(F.col("value")) != "").join(by_key, "field_id").select("doc", F.col("new_id").alias("field_id"), "value")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and new (key, pos, value) -> the new rows in their order, then the old ones not named again.
    origin says where a row comes from: added, replaced or kept."""
    both = new.withColumnRenamed("pos", "n").withColumnRenamed("value", "nv").join(old.withColumnRenamed("pos", "o").withColumnRenamed("value", "ov"), key, "full_outer")
    origin = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "added").otherwise("replaced")
    return both.select(key, origin.alias("origin"), F.coalesce("n", "o").alias("pos"), F.coalesce("nv", "ov").alias("value"))


def latest_examples(examples: DataFrame, by: str, k: int = 4) -> DataFrame:
    """The k latest examples of each group with their place; the larger id first at one time."""
    w = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("id"))
    return examples.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def revision(examples: DataFrame, by: str) -> DataFrame:
    """examples(by, id, stamp) -> one text that changes when any example does: sorted id:stamp, joined by |."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", F.col("id").cast("string"), "stamp")))
    return examples.groupBy(by).agg(F.array_join(parts, "|").alias("revision"))


def upload_problem(name: Column, size: Column, head: Column, place: Column, files: int = 50, mb: int = 40) -> Column:
    """Why an uploaded file is refused, in the order of the checks; null if it is taken."""
    return (
        F.when(place > files, "too_many_files")
        .when(~F.lower(name).endswith(".pdf"), "not_pdf_name")
        .when(size == 0, "empty")
        .when(size > mb * 1024 * 1024, "too_large")
        .when(~head.startswith("%PDF"), "not_pdf_content")
    )


def patched(result: Column, note: Column, payload: Column, new_note: Column) -> Column:
    """A payload replaces the result; without one only the note is set."""
    return F.when(payload.isNotNull(), F.struct(payload.alias("result"), note.alias("note"))).otherwise(F.struct(result.alias("result"), F.coalesce(new_note, note).alias("note")))


def is_json_entry(path: Column) -> Column:
    """Archive members that are read: .json files outside any resource-fork folder, no dot-files."""
    base = F.regexp_extract(path, r"[^/]*$", 0)
    return F.lower(path).endswith(".json") & ~F.contains(path, F.lit("__MACOSX/")) & ~base.startswith(".")
