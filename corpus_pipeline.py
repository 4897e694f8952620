"""Corpus pipeline over documents: quality, exact and near duplicates, mixing, SentencePiece."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.llm.block_dedup import exact_groups
from ledgerlens.llm.common import Scratch
from ledgerlens.llm.mixing import copies, mix
from ledgerlens.llm.queries import TARGETS, labelled_domains, tokenizer_file
from ledgerlens.llm.sentencepieces import encode_pieces
from ledgerlens.llm.simhash_wide import similar_groups
from ledgerlens.llm.weak_quality import score_quality


def safe_names(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with names that clash with no operator's, but for doc_id and text; and what names them back."""
    names = [c if c in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, list[Column], Scratch]:
    """A written copy under safe names in which each row has a number of its own, as doc_id may repeat or be null."""
    scratch = Scratch(spark, "rows")
    docs, back = safe_names(docs)
    return scratch.save(docs.withColumn("row", F.monotonically_increasing_id()), "numbered"), back, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer rejects go, null, empty and blank texts among them; each row is judged by its text alone."""
    docs, back = safe_names(docs)
    return score_quality(docs, tuple(docs.columns)).filter("keep").select(*back)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows equal but for white space one stays: the longest, then the smallest doc_id (null last), then any.
    Rows that share a doc_id and differ in text are apart; a null text counts as empty."""
    docs, back, _ = numbered(spark, docs)
    gone = exact_groups(docs, row="row").filter("not kept").select("row")
    return docs.join(gone.hint("merge"), "row", "left_anti").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked at 0.8 or more in five-word shingles the smallest doc_id stays (null last, then any).
    Rows that share a doc_id are apart; rows without a word are one group."""
    docs, back, scratch = numbered(spark, docs)
    groups = similar_groups(docs.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    members = scratch.save(groups.join(docs.select("row", F.col("doc_id").cast("long").alias("doc_id")).hint("merge"), "row"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    stay = members.groupBy("component_id").agg(first.alias("x")).select("x.row")
    gone = members.join(stay.hint("merge"), "row", "left_anti").select("row")
    return docs.join(gone.hint("merge"), "row", "left_anti").select(*back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat by their rates; a rate is never under 1, so none is lost to the mix, and has
    no ceiling, so that rare domains meet their targets too. Rows that share a doc_id have one rate;
    a row without doc_id stays once."""
    labelled = labelled_domains(docs, spark, sf_dir)
    docs, back = safe_names(docs)
    rates = mix(docs, labelled, TARGETS, low=1.0, high=math.inf, budget=None).select("doc_id", copies(F.col("rate"), F.col("doc_id")).alias("times"))
    rates = Scratch(spark, "times").save(rates, "times")
    turns = F.explode(F.sequence(F.lit(1), F.coalesce(F.col("times"), F.lit(1))))
    return docs.join(rates.hint("merge"), "doc_id", "left").withColumn("turn", turns).select(*back)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids and the text decoded from these; copies of one differ in
    their ids. A null text is empty and has no ids. Columns named ids or decoded give way to the made ones."""
    names = docs.columns
    docs, back = safe_names(docs)
    out = encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"), columns=tuple(docs.columns), turns=True)
    made = ("ids", "decoded")
    return out.select(*[c for c, name in zip(back, names, strict=True) if name.lower() not in made], *made)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", pieces),
]
#: Trained models, Hamming links and hashed draws are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{k}")
    return docs
