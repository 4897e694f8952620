"""Ordered page entries to invoices, votes on their numbers, totals; all as windows and aggregations by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions.values import amounts_match, freight_no, norm_invoice_no, trim_ws


def fold_pages(entries: DataFrame, doc: str) -> DataFrame:
    """entries(doc, pos, no, has_header, has_lines) with inv_id, the pos of the entry that opened its
    invoice, and created. A number opens an invoice where it first comes; without one, an entry with
    header values does; else the entry goes to the last opened, and lines before any open one."""
    ordered = Window.partitionBy(doc).orderBy("pos")
    no = norm_invoice_no(F.coalesce("no", F.lit("")))
    out = entries.withColumn("nkey", no).withColumn("first_pos", F.min("pos").over(Window.partitionBy(doc, "nkey")))
    out = out.withColumn("base", F.when(F.col("nkey") != "", F.col("pos") == F.col("first_pos")).otherwise(F.col("has_header")))
    before = F.coalesce(F.max("base").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    out = out.withColumn("loose", (F.col("nkey") == "") & ~F.col("has_header") & F.col("has_lines") & ~before)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one order serves all windows but a number's first place
    anon = F.col("loose") & (F.count_if("loose").over(upto) == 1)
    out = out.withColumn("created", F.col("base") | anon)
    last = F.last(F.when(F.col("created"), F.col("pos")), ignorenulls=True).over(upto)
    return out.withColumn("inv_id", F.when(F.col("nkey") != "", F.col("first_pos")).otherwise(last)).drop("first_pos", "base", "loose")


def majority_number(entries: DataFrame, doc: str) -> DataFrame:
    """entries(doc, pos, no, weight) -> (doc, winner, votes): most votes, the first seen on a tie; a vote weighs 1 at least."""
    votes = entries.withColumn("no", norm_invoice_no(F.coalesce("no", F.lit("")))).filter("no <> ''").groupBy(doc, "no")
    votes = votes.agg(F.sum(F.greatest(F.lit(1), F.coalesce("weight", F.lit(1)))).alias("votes"), F.min("pos").alias("first_pos"))
    best = F.max_by(F.struct("no", "votes"), F.struct(F.col("votes"), -F.col("first_pos")))
    return votes.groupBy(doc).agg(best.alias("b")).select(doc, F.col("b.no").alias("winner"), "b.votes")


def reconcile(headers: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """headers(key, total), lines(key, amount) -> line_total and balanced, which is null without a total."""
    sums = lines.groupBy(key).agg(F.sum(F.round(F.col("amount") * 100).cast("long")).alias("cents"))
    out = headers.join(sums, key, "left").withColumn("line_total", F.coalesce("cents", F.lit(0)) / 100.0)
    return out.withColumn("balanced", amounts_match(F.col("line_total"), F.col("total"))).drop("cents")


def structure_type(invoices: Column, has_lines: Column, template: Column | None = None) -> Column:
    """By the number of invoices and whether any has lines; air waybills are one invoice with lines in any case."""
    waybill = F.coalesce(template.isin("air_waybill", "air_waybill_dhl"), F.lit(False)) if template is not None else F.lit(False)
    return F.when(waybill, "invoice_with_sublist").when(has_lines, F.when(invoices > 1, "multi_invoice_with_sublist").otherwise("invoice_with_sublist")).otherwise(F.when(invoices > 1, "multi_invoice").otherwise("single"))


def confidence(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.5))))


def skips(is_target: Column, c: Column, threshold: float) -> Column:
    return ~is_target & (c >= threshold)


def batch_summary(docs: DataFrame, by: str) -> DataFrame:
    """docs(by, category, annotated) -> total, target, non_target, unclassified, annotated."""
    n = lambda c: F.count_if(F.col("category") == c)
    made = [F.count(F.lit(1)).alias("total"), n("target").alias("target"), n("non_target").alias("non_target"), F.count_if(F.col("category").isNull()).alias("unclassified"), F.count_if("annotated").alias("annotated")]
    return docs.groupBy(by).agg(*made)


def estimated_votes(entries: DataFrame, doc: str) -> DataFrame:
    """entries(doc, no, weight) -> (doc, no, votes): each number's votes, 1 at least for each entry."""
    numbered = entries.withColumn("no", norm_invoice_no(F.coalesce("no", F.lit("")))).filter("no <> ''")
    return numbered.groupBy(doc, "no").agg(F.sum(F.greatest(F.lit(1), F.coalesce("weight", F.lit(1)))).alias("votes"))


def valid_row(cells: Column, required: Column) -> Column:
    """A line counts if some cell is filled and no required one is blank."""
    filled = lambda x: F.coalesce(trim_ws(x) != "", F.lit(False))
    return F.exists(F.map_values(cells), filled) & F.forall(required, lambda k: filled(F.try_element_at(cells, k)))


def page_outcome(failed: Column, target: Column, has_content: Column, valid: Column) -> Column:
    return F.when(failed, "error").when(~target | ~has_content | ~valid, "skipped").otherwise("target")


def freight_valid(has_header: Column, filled: Column, number: Column, has_lines: Column) -> Column:
    """Without a header lines are needed; with one, 5 filled fields and a number of 11 characters."""
    return F.when(~has_header, has_lines).otherwise((filled >= 5) & (F.length(freight_no(number)) == 11))


def merge_by_majority(invoices: DataFrame, winners: DataFrame, doc: str, no_key: str) -> DataFrame:
    """invoices(doc, pos, header, sublist), winners(doc, winner) -> one invoice for each document (header, sublist).

    The first invoice with the winning number is the base, else the first of all. Blank header values of
    the base are filled from the others in order, but for the number; lines follow the base's in order.
    The number is the base's own text where it is the winning one, else the winner.
    """
    number = lambda h: F.coalesce(F.try_element_at(h, F.lit(no_key)), F.lit(""))
    rows = invoices.join(winners.select(doc, "winner"), doc, "left").withColumn("agrees", F.coalesce(norm_invoice_no(number(F.col("header"))) == F.col("winner"), F.lit(False)))
    listed = F.array_sort(F.collect_list(F.struct("pos", "agrees", "header", "sublist")), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    out = rows.groupBy(doc).agg(F.first("winner").alias("winner"), listed.alias("all"))
    base = F.coalesce(F.array_min(F.transform(F.filter("all", lambda x: x["agrees"]), lambda x: x["pos"])), F.element_at("all", 1)["pos"])
    out = out.withColumn("base", base).withColumn("own", F.filter("all", lambda x: x["pos"] == F.col("base"))[0]).withColumn("others", F.filter("all", lambda x: x["pos"] != F.col("base")))
    filled = lambda a, x: F.when(F.coalesce(a, F.lit("")) != "", a).when(F.coalesce(x, F.lit("")) != "", x).otherwise(a)
    fold = lambda acc, x: F.map_filter(F.map_zip_with(acc, F.map_filter(x["header"], lambda k, _: k != no_key), lambda k, a, v: filled(a, v)), lambda k, v: v.isNotNull())
    header = F.aggregate("others", F.col("own.header"), fold)
    said = F.when(F.col("own.agrees"), number(F.col("own.header"))).otherwise(F.coalesce("winner", F.lit("")))
    named = F.when(said != "", F.map_concat(F.map_filter(header, lambda k, _: k != no_key), F.create_map(F.lit(no_key), said))).otherwise(header)
    return out.select(doc, named.alias("header"), F.concat(F.col("own.sublist"), F.flatten(F.transform("others", lambda x: x["sublist"]))).alias("sublist"))
