"""Canonical exact document fingerprints, in DataFrame and SQL functions only.

Canonical text: Unicode NFC, lower case, each run of Unicode white space one space, trimmed.
The fingerprint is a 128-bit digest made of two xxhash64 values of the canonical text. Texts in
one bucket are compared byte by byte; should different texts ever share a bucket, its members'
fingerprints are extended by the SHA-256 of the canonical text, so that equal fingerprints mean
equal canonical texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch
from .order import with_ghosts

SALT = "\u0001"


def canonical(text: Column) -> Column:
    """NFC (by the ICU library that Spark ships), lower case, white space folded and trimmed."""
    nfc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.trim(F.regexp_replace(F.lower(nfc), r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    """32 hex digits."""
    half = lambda c: F.lpad(F.hex(F.xxhash64(c)), 16, "0")
    return F.lower(F.concat(half(canon), half(F.concat(F.lit(SALT), canon))))


def fingerprints_with_edit(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars/3) code points replaced by the first as many (or
    all) of the next document in descending doc_id order; after the last comes the first. An
    exact digest has no grades: a likeness is 1.0 where canonical texts are equal, else 0.0.

    Null or empty text: the fingerprint of the empty text. A single document is its own next.
    Rows that repeat a doc_id follow each other in text order; rows whose doc_id is null come after
    all others, likewise. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "prints")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed, used = with_ghosts(base, scratch)
    w = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = (
        placed.select("doc_id", "bucket", "ghost", "text", F.length("text").cast("long").alias("n_chars"))
        .withColumn("after", F.coalesce(F.lead("text").over(w), F.col("text")))
        .filter("ghost = 0")
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("after", F.lit(1), cut)))
    )
    hashed = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("e"), canonical(F.col("after")).alias("a")
    ).select(
        "doc_id", "n_chars", "edited_sha256", wide_hash(F.col("c")).alias("h"), wide_hash(F.col("e")).alias("eh"), F.sha2("c", 256).alias("s"), F.sha2("e", 256).alias("es"),
        (F.col("c") == F.col("e")).cast("double").alias("near_edited"), (F.col("c") == F.col("a")).cast("double").alias("near_next"),
    )
    hashed = scratch.save(hashed, "hashed")
    for t in used:
        scratch.free(t)
    mixed = clashes(base, hashed.select("h"), scratch)
    if mixed.isEmpty():
        return hashed.select("doc_id", "n_chars", "edited_sha256", F.col("h").alias("fingerprint"), F.col("eh").alias("edited_fingerprint"), "near_edited", "near_next")
    x = hashed.join(mixed.withColumn("x", F.lit(True)), "h", "left").join(mixed.select(F.col("h").alias("eh"), F.lit(True).alias("ex")), "eh", "left")
    name = lambda h, s, f: F.when(F.col(f), F.concat(h, F.lit("-"), s)).otherwise(F.col(h))
    return x.select("doc_id", "n_chars", "edited_sha256", name("h", "s", "x").alias("fingerprint"), name("eh", "es", "ex").alias("edited_fingerprint"), "near_edited", "near_next")


def clashes(base: DataFrame, prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Buckets whose members differ in a byte: (h). Only texts of buckets with several members are
    compared, by the least and greatest text of each bucket, combined before the shuffle."""
    several = scratch.save(prints.groupBy("h").count().filter("count > 1").select("h"), "several")
    salts = 32  # a bucket with very many members is dealt to as many tasks
    texts = base.select("doc_id", canonical(F.col("text")).alias("c")).select("c", wide_hash(F.col("c")).alias("h"), F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(salts)).alias("salt"))
    several = several.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    checked = texts.join(several.hint("merge"), ["h", "salt"], "left_semi").groupBy("h", "salt").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    checked = checked.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return scratch.save(checked.filter("lo <> hi").select("h"), "clash")
