"""Accuracy report: pair documents, align invoices and rows, compare fields, aggregate.

Input tables, for each side:
  docs(doc_pos, file_name, match_key, template_id)
  invoices(match_key, doc_pos, inv_pos, header MAP<STRING,STRING>, sublist ARRAY<STRUCT<row_pos, cells MAP<STRING,STRING>>>)

invoices may have a column held, the distinct field keys of an invoice's rows, where the rows themselves are left out.

An invoice carries its rows, as in the documents themselves, and a document its invoices: each side is grouped by
document once and the two meet in one row a pair. Finding the template, aligning invoices and rows, comparing fields and
summing up by document then need no other shuffle. So a document is the unit of work: as the text that
it is read from, it has to fit a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions.values import field_equal, let, norm_text

from .align import align
from .templates import TEMPLATES, best_template, invoice_no_key, row_key, templates_as_row

DOC = ["a_doc", "match_key"]  # the number first, as sorts compare it faster
COUNTS = ("answer_rows", "matched_rows", "missing_rows", "extra_rows")


@dataclass
class Side:
    docs: DataFrame
    invoices: DataFrame


@dataclass
class Line:
    """What a document, an aligned invoice or an aligned row says, as columns of the aligned invoice that it is part of."""

    kind: Column
    row_idx: Column
    a_pos: Column
    r_pos: Column
    a_body: Column
    r_body: Column
    extra: Column  # rows without an answer, of an invoice

    def places(self) -> list[Column]:
        return [self.kind.alias("kind"), self.row_idx.alias("row_idx"), self.a_pos.cast("long").alias("a_pos"), self.r_pos.cast("long").alias("r_pos"), self.extra.alias("extra")]


def pair_documents(answers: DataFrame, results: DataFrame) -> DataFrame:
    """Every answer with the first result of its key: (match_key, a_doc, r_doc, template ids)."""
    first = Window.partitionBy("match_key").orderBy("doc_pos")
    once = results.withColumn("n", F.row_number().over(first)).filter("n = 1")
    r = once.select("match_key", F.col("doc_pos").alias("r_doc"), F.col("template_id").alias("r_template"))
    a = answers.select("match_key", F.col("doc_pos").alias("a_doc"), "file_name", F.col("template_id").alias("a_template"))
    return a.join(r, "match_key")


def unmatched_answers(answers: DataFrame, results: DataFrame) -> DataFrame:
    return answers.join(results.select("match_key").distinct(), "match_key", "left_anti")


def unmatched_results(answers: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose key no answer has; a second result of a matched key is not reported."""
    return results.join(answers.select("match_key").distinct(), "match_key", "left_anti")


def by_template(template: Column, value) -> Column:
    out = None
    for t in TEMPLATES:
        out = F.when(template == t, value(t)) if out is None else out.when(template == t, value(t))
    return out.otherwise(value(TEMPLATES[0]))


def paired_documents(pairs: DataFrame, answers: Side, results: Side) -> DataFrame:
    """pairs with a_inv and r_inv, both sides' invoices as arrays; empty for a document without invoices."""

    def grouped(side: Side, doc: str, name: str) -> DataFrame:
        one = F.struct(*[c for c in ("inv_pos", "header", "sublist", "held") if c in side.invoices.columns])
        return side.invoices.select(F.col("doc_pos").alias(doc), "match_key", one.alias("x")).groupBy(doc, "match_key").agg(F.collect_list("x").alias(name))

    out = pairs.join(grouped(answers, "a_doc", "a_inv"), DOC, "left").join(grouped(results, "r_doc", "r_inv"), ["r_doc", "match_key"], "left")
    return out.withColumns({c: F.coalesce(c, F.array()) for c in ("a_inv", "r_inv")})


def templated(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Paired documents with template_id, the result's or else the answer's or else the one whose fields the two hold
    most of, and fields_from, the template whose fields it uses."""

    def held(side: str) -> Column:
        rows = lambda i: i["held"] if "held" in docs.schema[side].dataType.elementType.names else F.flatten(F.transform(i["sublist"], lambda x: F.map_keys(x["cells"])))
        return F.flatten(F.transform(side, lambda i: F.array_distinct(F.concat(F.map_keys(i["header"]), F.coalesce(rows(i), F.array())))))

    found = best_template(F.array_distinct(F.concat(held("a_inv"), held("r_inv"))), F.col("templates"))
    template = F.coalesce("r_template", "a_template", found, F.lit(TEMPLATES[0]))
    known = F.exists("templates", lambda t: t["template_id"] == F.col("template_id"))
    out = docs.crossJoin(F.broadcast(templates_as_row(fields))).withColumn("template_id", template)  # one row
    return out.withColumn("fields_from", F.when(known, F.col("template_id")).otherwise(TEMPLATES[0])).drop("templates")


def with_templates(pairs: DataFrame, answers: Side, results: Side, fields: DataFrame) -> DataFrame:
    """pairs with template_id and fields_from."""
    return templated(paired_documents(pairs, answers, results), fields).drop("a_inv", "r_inv")


class Report:
    """The report's tables, each a lazy DataFrame. Where pairs has no columns template_id and fields_from, templates
    are found from the documents' own rows.

    invoices: aligned invoices with inv_idx, the answer's first in their order. lines: a row for each document (kind
    doc), aligned invoice (kind invoice, bodies are headers) and aligned row (kind row, bodies are cells). judged: lines
    once for each field of their scope. All else is filters and sums of judged, so each input is read once."""

    def __init__(self, pairs: DataFrame, answers: Side, results: Side, fields: DataFrame):
        docs = paired_documents(pairs, answers, results)
        docs = docs if "template_id" in pairs.columns else templated(docs, fields)
        self.pairs, self.fields = docs.drop("a_inv", "r_inv"), fields
        carry = ("template_id", "fields_from")
        key = lambda cells, of: let(F.try_element_at(cells, by_template(F.col("fields_from"), lambda t: F.lit(of(t)))), lambda x: F.lower(norm_text(x)))
        numbered = lambda side: (F.transform(side, lambda i: key(i["header"], invoice_no_key)), F.transform(side, lambda i: i["inv_pos"].cast("long")))
        body = lambda side, at: F.get(F.col(side), at)
        one = lambda p, k: F.struct(
            F.lit("invoice").alias("kind"), (k + 1).alias("inv_idx"), p["a_pos"].alias("a_inv"), p["r_pos"].alias("r_inv"), body("a_inv", p["a_at"]).alias("a_body"), body("r_inv", p["r_at"]).alias("r_body"),
        )
        no_body = lambda side: F.lit(None).cast(docs.schema[side].dataType.elementType)
        itself = F.struct(F.lit("doc").alias("kind"), F.lit(1).alias("inv_idx"), F.lit(0).cast("long").alias("a_inv"), F.lit(None).cast("long").alias("r_inv"), no_body("a_inv").alias("a_body"), no_body("r_inv").alias("r_body"))
        found = docs.select(*DOC, *carry, "a_inv", "r_inv", align(*numbered("a_inv"), *numbered("r_inv")).alias("al"))
        members = F.concat(F.array(itself), F.transform("al", one))
        aligned = found.select(*DOC, *carry, F.explode(members).alias("x")).select(*DOC, *carry, "x.*")
        self.invoices = aligned.filter("kind = 'invoice'").select(*DOC, *carry, "inv_idx", "a_inv", "r_inv", F.col("a_body.header").alias("a_header"), F.col("r_body.header").alias("r_header"))

        listed = lambda x, kind: F.coalesce(x, F.array().cast(f"array<{kind}>"))
        rows = lambda side: (listed(F.transform(f"{side}.sublist", lambda x: key(x["cells"], row_key)), "string"), listed(F.transform(f"{side}.sublist", lambda x: x["row_pos"].cast("long")), "bigint"))
        placed = aligned.withColumn("al", align(*rows("a_body"), *rows("r_body")))
        there = lambda c: F.when(F.col(c).isNotNull(), 0)
        cells = lambda side, at: F.get(F.col(f"{side}.sublist"), at)["cells"]
        self.placed = placed
        self.head = Line(F.col("kind"), F.lit(1), there("a_inv"), there("r_inv"), F.col("a_body.header"), F.col("r_body.header"), F.size(F.filter("al", lambda p: p["alone"])))
        self.row = lambda p, k: Line(F.lit("row"), k + 1, p["a_pos"], p["r_pos"], cells("a_body", p["a_at"]), cells("r_body", p["r_at"]), F.lit(0))
        whole = lambda x: F.struct(*x.places(), x.a_body.alias("a_body"), x.r_body.alias("r_body"))
        self.lines = self._explode(placed, F.concat(F.array(whole(self.head)), F.transform("al", lambda p, k: whole(self.row(p, k)))))
        matched = "kind = 'row' and a_inv is not null and r_inv is not null and a_pos is not null"
        self.rows = self.lines.filter(matched).withColumnsRenamed({"a_pos": "a_row", "r_pos": "r_row"})

    def _explode(self, placed: DataFrame, lines: Column) -> DataFrame:
        cols = [*DOC, "inv_idx", "template_id", "fields_from", "a_inv", "r_inv"]
        return placed.select(*cols, F.explode(lines).alias("x")).select(*cols, "x.*")

    def judged(self, named: bool = False) -> DataFrame:
        """lines, without bodies, once for each field of their scope, with expected, actual and equal; field is null, once, for what has
        no answer or no field. at numbers a line's fields from 0; lone names what is missing or extra as a whole. With ``named``
        also own_key, the key that names a line as a whole, and its values a_own and r_own."""
        listed = lambda scope: F.array_sort(F.collect_list(F.when(F.col("scope") == scope, F.struct("pos", "field_key", "field_class", "label"))))
        fields = F.broadcast(self.fields.groupBy(F.col("template_id").alias("fields_from")).agg(listed("header").alias("header"), listed("sublist").alias("columns")))
        own = lambda of: by_template(F.col("fields_from"), lambda t: F.lit(of(t)))
        value = lambda m, key: F.coalesce(F.try_element_at(m, key), F.lit(""))
        no_field = F.lit(None).cast("struct<pos: int, field_key: string, field_class: string, label: string>")

        def cells(x: Line, scope: Column, own_key: Column) -> Column:
            names = [own_key.alias("own_key"), value(x.a_body, own_key).alias("a_own"), value(x.r_body, own_key).alias("r_own")] if named else []
            cell = lambda at, f, expected, actual: F.struct(*x.places(), *names, at.alias("at"), f.alias("field"), expected.alias("expected"), actual.alias("actual"))
            none = F.lit(None).cast("string")
            each = F.transform(scope, lambda f, i: cell(i, f, value(x.a_body, f["field_key"]), value(x.r_body, f["field_key"])))
            return F.when(x.a_pos.isNotNull() & (F.size(scope) > 0), each).otherwise(F.array(cell(F.lit(0), no_field, none, none)))

        scope = F.when(F.col("kind") == "invoice", F.col("header"))
        rows = F.transform("al", lambda p, k: cells(self.row(p, k), F.col("columns"), own(row_key)))
        out = self._explode(self.placed.join(fields, "fields_from"), F.flatten(F.concat(F.array(cells(self.head, scope, own(invoice_no_key))), rows)))
        kind = F.col("kind")
        paired = F.col("a_inv").isNotNull() & F.col("r_inv").isNotNull()
        lone = (
            F.when((kind == "invoice") & F.col("r_pos").isNull(), "missing_invoice").when((kind == "invoice") & F.col("a_pos").isNull(), "extra_invoice")
            .when((kind == "row") & paired & F.col("r_pos").isNull(), "missing_row")
        )
        equal = F.when(F.col("field").isNotNull(), F.col("r_pos").isNotNull() & field_equal(F.col("field.field_class"), F.col("expected"), F.col("actual")))
        return out.withColumns({"lone": lone, "equal": equal})

    def _cells(self, kind: str) -> DataFrame:
        cols = ["template_id", *DOC, "inv_idx", "row_idx", F.lit("header" if kind == "invoice" else "sublist").alias("scope"), F.col("field.pos").alias("field_pos"), "field.field_key", "field.label", "expected", "actual", "equal"]
        return self.judged().filter((F.col("kind") == kind) & F.col("field").isNotNull()).select(*cols)

    def header_cells(self) -> DataFrame:
        """Each header field of each answer invoice; of a missing invoice all are wrong."""
        return self._cells("invoice").drop("row_idx")

    def sublist_cells(self) -> DataFrame:
        """Each column of each answer row; of a missing row or invoice all are wrong."""
        return self._cells("row")

    def field_stats(self, cells: DataFrame) -> DataFrame:
        return cells.groupBy("template_id", "scope", "field_pos", "field_key").agg(F.count(F.lit(1)).alias("total"), F.count_if("equal").alias("correct")).filter("total > 0")

    def _counts(self, once: Column) -> list[Column]:
        """Answer, matched, missing and extra rows of a group of lines, each line counted where ``once`` holds."""
        a, r = F.col("a_pos").isNotNull(), F.col("r_pos").isNotNull()
        tests = (a, a & r, ~r, ~a)
        return [F.count_if(once & (F.col("kind") == "row") & test).alias(name) for name, test in zip(COUNTS, tests, strict=True)]

    def invoice_rows(self) -> DataFrame:
        """Per aligned invoice: answer, matched, missing and extra rows."""
        return self.lines.filter("kind <> 'doc'").groupBy(*DOC, "inv_idx", "template_id", "a_inv", "r_inv").agg(*self._counts(F.lit(True)))

    def errors(self) -> DataFrame:
        """(template_id, match_key, a_doc, inv_idx, row_idx, kind, field_key, label, expected, actual). What
        is missing or extra as a whole is named by its invoice number or the key column of its row."""
        line_key = by_template(F.col("fields_from"), lambda t: F.lit(row_key(t)))
        head, none = F.col("kind") == "invoice", F.lit("")
        said = lambda kind, key, label, expected, actual: F.struct(kind.alias("error"), key.alias("key"), label.alias("name"), expected.alias("want"), actual.alias("got"))
        whole = said(F.col("lone"), F.col("own_key"), F.when(head, "发票").otherwise("明细行"), F.col("a_own"), F.when(head, F.col("r_own")).otherwise(none))
        field = said(F.lit("field_mismatch"), F.col("field.field_key"), F.col("field.label"), F.col("expected"), F.col("actual"))
        more = said(F.lit("extra_row"), line_key, F.lit("明细行"), none, F.concat(F.lit("多出 "), F.col("extra").cast("string"), F.lit(" 行")))
        first, paired = F.col("at") == 0, F.col("a_inv").isNotNull() & F.col("r_inv").isNotNull()
        own = F.when(F.col("lone").isNotNull(), F.when(first, whole)).when(paired & ~F.col("equal"), field)
        found = F.array_compact(F.array(own, F.when(first & paired & (F.col("extra") > 0), more)))
        row_idx = F.when((F.col("kind") == "row"), F.col("row_idx")).alias("row_idx")
        out = self.judged(named=True).select("template_id", *DOC, "inv_idx", row_idx, F.explode(found).alias("e"))
        return out.select("template_id", *DOC, "inv_idx", "row_idx", F.col("e.error").alias("kind"), F.col("e.key").alias("field_key"), F.col("e.name").alias("label"), F.col("e.want").alias("expected"), F.col("e.got").alias("actual"))

    def template_stats(self) -> DataFrame:
        """Documents, those without any error, and row counts by template: one sum by document, one over these."""
        first, paired = F.col("at") == 0, F.col("a_inv").isNotNull() & F.col("r_inv").isNotNull()
        wrong = F.col("lone").isNotNull() | (paired & (~F.coalesce("equal", F.lit(True)) | (F.col("extra") > 0)))
        docs = self.judged().groupBy(*DOC, "template_id").agg(F.max(wrong).alias("wrong"), *self._counts(first))
        sums = [F.sum(c).alias(c) for c in COUNTS]
        return docs.groupBy("template_id").agg(F.count(F.lit(1)).alias("doc_total"), F.count_if(~F.col("wrong")).alias("all_correct"), *sums)
