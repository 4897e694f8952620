"""Export JSON texts to documents and invoices; texts that cannot be read are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.functions.values import let, trim_ws


def number_text(d: Column) -> Column:
    """A number as JSON tools print it: no trailing zeros, and an exponent from 1e21 up and under 1e-6 only."""
    said, size = d.cast("string"), F.abs(d)
    short = lambda x: F.regexp_replace(x, r"(\.\d*?)0+(?=$|E)", "$1")
    bare = lambda x: F.regexp_replace(short(x), r"\.(?=$|E)", "")
    power = F.regexp_replace(F.regexp_replace(bare(said), "E(?=\\d)", "e+"), "E-", "e-")
    return F.when(~F.contains(said, F.lit("E")), bare(said)).when((size >= 1e21) | (size < 1e-6), power).when(size >= 1, bare(d.cast("decimal(38,17)").cast("string"))).otherwise(bare(F.format_string("%.24f", d)))


def scalar_text(v: Column) -> Column:
    """Text of a JSON scalar; objects, arrays and null give the empty text."""
    text = F.try_variant_get(v, "$", "string")

    def of_kind(kind: Column) -> Column:
        number = F.when(kind == "DOUBLE", number_text(F.try_variant_get(v, "$", "double"))).otherwise(text)
        return F.when(kind == "STRING", text).when(kind.rlike("^(OBJECT|ARRAY|VOID)"), "").otherwise(F.coalesce(number, F.lit("")))

    return let(F.schema_of_variant(v), of_kind)


def record(v: Column, path: str = "$") -> Column:
    """An object as map of texts; anything else as the empty map."""
    none = F.expr("cast(map() as map<string,string>)")
    each = F.coalesce(F.transform_values(F.try_variant_get(v, path, "map<string,variant>"), lambda _, x: scalar_text(x)), none)
    texts = lambda: F.coalesce(_filled(F.try_variant_get(v, path, "map<string,string>")), none)
    return F.when(_plain(F.try_variant_get(v, path, "variant"), "OBJECT<"), texts()).otherwise(each)


def records(v: Column, path: str) -> Column:
    """The members of an array, each as record gives it; null where there is no array."""
    none = F.expr("cast(map() as map<string,string>)")
    texts = F.transform(F.try_variant_get(v, path, "array<map<string,string>>"), lambda m: F.coalesce(_filled(m), none))
    return F.when(_plain(F.try_variant_get(v, path, "variant"), "ARRAY<OBJECT<"), texts).otherwise(F.transform(items(v, path), lambda y: record(y)))


def _filled(texts: Column) -> Column:
    return F.transform_values(texts, lambda _, x: F.coalesce(x, F.lit("")))


def _plain(v: Column, start: str) -> Column:
    """Whether all members are read as scalar_text reads them by a cast to texts: none is a double, an object or an array,
    nor of several kinds."""
    other = lambda kind: F.contains(kind, F.lit(": DOUBLE")) | F.contains(kind, F.lit(": OBJECT")) | F.contains(kind, F.lit(": ARRAY")) | F.contains(kind, F.lit(": VARIANT"))
    return let(F.schema_of_variant(v), lambda kind: F.coalesce(F.startswith(kind, F.lit(start)) & ~other(kind), F.lit(False)))


def items(v: Column, path: str) -> Column:
    """Members of an array, null where there is none."""
    return F.try_variant_get(v, path, "array<variant>")


def _invoice(header: Column, rows: Column) -> Column:
    return F.struct(header.alias("header"), rows.alias("sublist"))


def write_exports(docs: DataFrame, path: str) -> None:
    """docs(job, file_name, text) as one file for each document, found by its job and name: path/job=J/file_name=N/. Names
    are distinct within a job. A job's documents go to several tasks; what is written again replaces what was there."""
    docs.select("job", "file_name", "text").repartition("job", "file_name").write.partitionBy("job", "file_name").option("lineSep", "\x00").mode("overwrite").text(path)


def written_exports(spark: SparkSession, path: str) -> DataFrame:
    """(job, file_name, text) of the files of write_exports, texts whole."""
    return spark.read.schema("text string, job string, file_name string").text(path, wholetext=True).select("job", "file_name", F.regexp_replace("text", "\\x00$", "").alias("text"))


def read_exports(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts(path, text) -> (documents, errors). A text is one document or has several under
    ``documents``, where what is not an object does not count. documents: path, doc_pos, file_name (the path where it is blank or no text), template_id (only
    if a text), invoices, an array of (header, sublist) from the first of four shapes that the document
    has. errors: path of each text that is not a JSON object."""
    is_object = lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))
    parsed = texts.select("path", F.try_parse_json("text").alias("v"))
    good = is_object(F.col("v"))
    docs = parsed.filter(good).select("path", F.posexplode(F.coalesce(F.filter(items(F.col("v"), "$.documents"), is_object), F.array("v"))).alias("doc_pos", "v"))
    none = F.expr("cast(array() as array<map<string,string>>)")
    v, records = F.col("v"), lambda x, p: F.coalesce(F.transform(items(x, p), lambda y: record(y)), none)
    has = lambda p: F.try_variant_get(v, p, "variant").isNotNull()
    invoices = (
        F.when(items(v, "$.invoicesWithSublist").isNotNull(), F.transform(items(v, "$.invoicesWithSublist"), lambda x: _invoice(record(x, "$.invoice"), records(x, "$.sublist"))))
        .when(has("$.invoice") | has("$.sublist"), F.array(_invoice(record(v, "$.invoice"), records(v, "$.sublist"))))
        .when(items(v, "$.invoices").isNotNull(), F.transform(items(v, "$.invoices"), lambda x: _invoice(record(x), none)))
        .when(has("$.fields"), F.array(_invoice(record(v, "$.fields"), none)))
        .otherwise(F.expr("cast(array() as array<struct<header: map<string,string>, sublist: array<map<string,string>>>>)"))
    )
    text_at = lambda p: F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", F.try_variant_get(v, p, "string"))
    name = F.coalesce(F.nullif(trim_ws(F.coalesce(text_at("$.fileName"), F.lit(""))), F.lit("")), "path")
    out = docs.select("path", "doc_pos", name.alias("file_name"), text_at("$.extraction.layoutTemplateId").alias("template_id"), invoices.alias("invoices"))
    return out, parsed.filter(~good).select("path")
