"""Names, labels and model-output text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .values import WS, let, trim_ws

# Fixed values that results depend on.
STRUCTURE_LABELS = {"single": "单发票", "multi_invoice": "多发票", "invoice_with_sublist": "发票+子清单", "multi_invoice_with_sublist": "多发票+子清单"}
ERROR_LABELS = {"field_mismatch": "字段不一致", "missing_row": "漏识别明细行", "extra_row": "多识别明细行", "missing_invoice": "漏识别发票", "extra_invoice": "多识别发票"}


def lookup(labels: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), key), F.lit(default))


def export_name(file_name: Column) -> Column:
    pdf = r"(?i)\.pdf$"
    return F.when(file_name.rlike(pdf), F.regexp_replace(file_name, pdf, ".json")).otherwise(F.concat(file_name, F.lit(".json")))


def safe_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"[^0-9A-Za-z_一-龥-]+", "_"), 1, 40)


def json_part(text: Column) -> Column:
    """Text inside the first code fence, else all of it, from the first { to the last }."""
    fence = r"(?si)```(?:json)?\s*(.*?)```"

    def braces(inner: Column) -> Column:
        at = F.struct(F.instr(inner, "{").alias("first"), (F.length(inner) - F.instr(F.reverse(inner), "}") + 1).alias("last"))
        some = lambda x: F.when(x["last"] > x["first"], F.substring(inner, x["first"], x["last"] - x["first"] + 1)).otherwise(inner)
        return F.when(F.contains(inner, F.lit("{")) & F.contains(inner, F.lit("}")), let(at, some)).otherwise(inner)

    return let(text, lambda x: let(trim_ws(F.when(x.rlike(fence), F.regexp_extract(x, fence, 1)).otherwise(x)), braces))


def lenient_json(text: Column, passes: int = 1) -> Column:
    """Variant of the text, with trailing commas dropped where it does not parse as it is."""


    def parsed(x: Column, left: int) -> Column:
        v = F.try_parse_json(x)
        return F.coalesce(v, let(F.regexp_replace(x, r",\s*([}\]])", "$1"), lambda y: parsed(y, left - 1))) if left else v

    return let(text, lambda x: parsed(x, passes))


def fold_chunks(chunks: Column) -> Column:
    """Deltas joined in order; a chunk that starts with all that came before replaces it."""
    return F.aggregate(chunks, F.lit("").cast("string"), lambda acc, x: F.when((acc != "") & F.startswith(x, acc), x).otherwise(F.concat(acc, x)))


def one_line(text: Column, size: int = 30) -> Column:
    """The first characters of the text with a blank for each line feed; other white space stays."""
    return F.substring(F.translate(text, "\n", " "), 1, size)


def duration(ms: Column) -> Column:
    """12ms, 3.25s or 2m 3.25s."""
    seconds = lambda x: F.format_string("%.2fs", x.cast("double") / 1000)
    minutes = F.floor(ms / 60_000).cast("string")
    return (
        F.when(ms < 1000, F.concat(F.bround(ms, 0).cast("long").cast("string"), F.lit("ms")))
        .when(ms < 60_000, seconds(ms))
        .otherwise(F.concat(minutes, F.lit("m "), seconds(F.pmod(ms, F.lit(60_000)))))
    )


def amount_text(value: Column) -> Column:
    """1,234.50: two decimals, halves away from zero."""
    return F.format_number(F.round(value, 2), 2)


def percentage(correct: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit("—")).otherwise(F.format_string("%.1f%%", (correct / total * 100).cast("double")))


def box_rect(box: Column) -> Column:
    """Bounds (x, y, w, h) of a polygon given as an array of points."""
    axis = lambda i: F.transform(box, lambda q: q[i])
    low, high = [F.array_min(axis(i)) for i in (0, 1)], [F.array_max(axis(i)) for i in (0, 1)]
    return F.struct(low[0].alias("x"), low[1].alias("y"), (high[0] - low[0]).alias("w"), (high[1] - low[1]).alias("h"))
