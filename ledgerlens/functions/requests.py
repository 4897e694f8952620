"""Model requests and replies as variants: validation, option floors, completeness, OCR blocks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import json_part, lenient_json
from .values import let, trim_ws

# Fixed values that results depend on: floor, ceiling, value without one, and defaults by profile.
PREDICT = {"extract": (1024, None, 4096), "classify": (256, None, 256), "optimize": (256, 768, 512)}
CONTEXT = {"extract": 8192, "classify": 4096, "optimize": 4096}
TEMPERATURE = {"extract": "0", "classify": "0", "optimize": "0.1"}
PENALTY = {"extract": "1.12", "classify": None, "optimize": "1.15"}
FAILED_BLOCK = "解析失败"
NO_BLOCKS = ("未提取到有效文本块", "[未提取到有效文本]")


def part(v: Column, path: str) -> Column:
    """A member as a variant: null if it is not there, a variant null if it is JSON's null."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """object, array, number, string, boolean or void; null for what is not there."""
    named = lambda name: (
        F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), "number")
        .otherwise(F.lower(name))
    )
    return let(F.schema_of_variant(v), named)


def is_kind(v: Column, path: str, want: str) -> Column:
    return F.coalesce(kind(part(v, path)) == want, F.lit(False))


def request_problem(text: Column, passes: int = 1) -> Column:
    """Why a request is refused: empty, syntax, not_object, no_model, no_messages; null if it is taken."""
    v = lenient_json(trim_ws(text), passes)
    model = trim_ws(F.when(is_kind(v, "$.model", "string"), F.try_variant_get(v, "$.model", "string")).otherwise(""))
    return (
        F.when(trim_ws(F.coalesce(text, F.lit(""))) == "", "empty")
        .when(v.isNull(), "syntax")
        .when(kind(v) != "object", "not_object")
        .when(model == "", "no_model")
        .when(~is_kind(v, "$.messages", "array") | part(v, "$.messages[0]").isNull(), "no_messages")
    )


def options_problem(text: Column, passes: int = 1) -> Column:
    """Why an option text is refused: syntax or not_object; null if it is taken, as a blank one is."""
    v = lenient_json(trim_ws(text), passes)
    return F.when(trim_ws(F.coalesce(text, F.lit(""))) == "", None).when(v.isNull(), "syntax").when(kind(v) != "object", "not_object")


def request_options(body: Column, profile: str) -> Column:
    """Options (num_predict, num_ctx, temperature, repeat_penalty) of a request body, a variant, as they are
    sent: given ones kept, defaults for the rest, num_predict within its bounds. Values but num_predict are JSON text."""
    low, high, default = PREDICT[profile]
    given = F.when(is_kind(body, "$.options.num_predict", "number"), F.try_variant_get(body, "$.options.num_predict", "double"))
    if profile == "extract":
        predict = F.when(given >= low, given).otherwise(float(default))
    else:
        predict = F.greatest(F.coalesce(given, F.lit(float(default))), F.lit(float(low)))
    if high:
        predict = F.least(predict, F.lit(float(high)))
    text = lambda path: F.to_json(part(body, path))
    context = text("$.options.num_ctx")
    if profile == "extract":
        context = F.when(is_kind(body, "$.options.num_ctx", "number"), context)
    return F.struct(
        predict.alias("num_predict"),
        F.coalesce(context, F.lit(str(CONTEXT[profile]))).alias("num_ctx"),
        F.coalesce(text("$.options.temperature"), F.lit(TEMPERATURE[profile])).alias("temperature"),
        F.coalesce(text("$.options.repeat_penalty"), F.lit(PENALTY[profile])).alias("repeat_penalty"),
    )


def complete_reply(text: Column, profile: str) -> Column:
    """Whether a streamed reply already holds the whole JSON object that the profile asks for."""

    def ok(v: Column) -> Column:
        there = part(v, "$.is_target").isNotNull()
        string = lambda p: is_kind(v, p, "string")
        return v.isNotNull() & {
            "extract": lambda: there | is_kind(v, "$.invoices", "array"),
            "classify": lambda: there & is_kind(v, "$.confidence", "number"),
            "optimize": lambda: is_kind(v, "$.classification_hints", "array") | string("$.classification_system_prompt") | (string("$.system_prompt") & string("$.user_prompt")),
        }[profile]()

    whole = lambda found: F.when(F.startswith(found, F.lit("{")), let(F.try_parse_json(found), ok))
    return F.coalesce(let(json_part(trim_ws(text)), whole), F.lit(False))


def ocr_results(text: Column) -> Column:
    """OCR results, an array of variants, from a bare array, {results} or {data}; null for other shapes."""
    v = F.try_parse_json(text)
    listed = lambda p: F.when(is_kind(v, p, "array"), F.try_variant_get(v, p, "array<variant>"))
    return F.coalesce(listed("$"), listed("$.results"), listed("$.data"))


def quad(bbox: Column) -> Column:
    """Four points of a variant: nested points (the first four), eight numbers, or two corners; else zeros."""
    flat = F.try_variant_get(bbox, "$", "array<double>")
    point = lambda i, j: F.array(F.get(flat, F.lit(i)), F.get(flat, F.lit(j)))
    pairs = lambda *ij: F.array(*[point(i, j) for i, j in ij])
    nested = F.transform(F.slice(F.try_variant_get(bbox, "$", "array<array<double>>"), 1, 4), lambda p: F.slice(p, 1, 2))
    zeros = F.array(*[F.array(F.lit(0.0), F.lit(0.0))] * 4)
    out = F.when(is_kind(bbox, "$[0]", "array"), nested).when(F.size(flat) >= 8, pairs((0, 1), (2, 3), (4, 5), (6, 7))).when(F.size(flat) >= 4, pairs((0, 1), (2, 1), (2, 3), (0, 3)))
    return F.coalesce(out, zeros)


def ocr_page(page: Column) -> Column:
    """One page of layout output, a variant, -> struct(blocks, extracted_text): contents and labels under any of
    their names, trimmed; a placeholder where the page has no block."""
    items = F.coalesce(F.try_variant_get(page, "$.parsing_res_list", "array<variant>"), F.array().cast("array<variant>"))
    items = F.filter(items, lambda x: F.coalesce(kind(x) != "void", F.lit(False)))
    string = lambda x, p: F.nullif(F.try_variant_get(x, p, "string"), F.lit(""))
    content = lambda x: trim_ws(F.coalesce(string(x, "$.content"), string(x, "$.block_content"), string(x, "$.text"), F.lit("")))
    label = lambda x: trim_ws(F.coalesce(string(x, "$.label"), F.try_variant_get(x, "$.block_label", "string"), F.lit("text")))
    block = lambda x: F.struct(content(x).alias("text"), label(x).alias("layout_type"), quad(part(x, "$.bbox")).alias("box"))
    blocks = F.transform(items, block)
    none = F.array(F.struct(F.lit(NO_BLOCKS[0]).alias("text"), F.lit(None).cast("string").alias("layout_type"), quad(F.lit(None).cast("variant")).alias("box")))
    text = F.array_join(F.filter(F.transform(blocks, lambda x: x["text"]), lambda t: t != ""), "\n\n")
    found = F.size(blocks) > 0
    return F.struct(F.when(found, blocks).otherwise(none).alias("blocks"), F.when(found, text).otherwise(NO_BLOCKS[1]).alias("extracted_text"))


def shown_blocks(blocks: Column) -> Column:
    """Blocks with a text that is no failure notice."""
    return F.filter(blocks, lambda x: F.coalesce((x["text"] != "") & ~F.startswith(x["text"], F.lit(FAILED_BLOCK)), F.lit(False)))


def rate_class(correct: Column, total: Column) -> Column:
    rate = F.try_divide(correct, total)
    return F.when(total <= 0, "").when(rate >= 0.995, "rate-good").when(rate >= 0.9, "rate-warn").otherwise("rate-bad")


def sample_type(name: Column, head: Column) -> Column:
    """pdf, jpg, png or webp by the first bytes (binary) or the suffix, in this order; null for other files."""
    starts = lambda *bytes_: F.coalesce(F.startswith(F.hex(head), F.lit(bytes(bytes_).hex().upper())), F.lit(False))
    ends = lambda *suffixes: F.lower(name).rlike(r"\.(" + "|".join(suffixes) + r")\z")
    webp = starts(*b"RIFF") & (F.hex(F.substring(head, 9, 4)) == b"WEBP".hex().upper())
    return (
        F.when(starts(*b"%PDF") | ends("pdf"), "pdf")
        .when(starts(0xFF, 0xD8, 0xFF) | ends("jpg", "jpeg"), "jpg")
        .when(starts(0x89, *b"PNG\r\n", 0x1A, 0x0A) | ends("png"), "png")
        .when(webp | ends("webp"), "webp")
    )


def media_type(stored: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(stored, F.lit("")), F.when(F.lower(name).endswith(".pdf"), "pdf").otherwise("image"))


def page_image_name(file_name: Column, page: Column, width: Column, height: Column) -> Column:
    base = F.coalesce(F.nullif(F.regexp_replace(file_name, r"(?i)\.pdf\z", ""), F.lit("")), F.lit("document"))
    return F.format_string("%s-model-input-p%d-%dx%d.jpg", base, page, width, height)


def page_scale(width: Column, height: Column, longest: int = 1600) -> Column:
    return F.least(F.lit(2.5), longest / F.greatest(width, height))


def model_missing(model: Column, models: Column) -> Column:
    """Whether a chosen model is not among the models there are, with or without its latest tag."""
    listed = F.array_contains(models, model) | F.array_contains(models, F.concat(model, F.lit(":latest")))
    return (F.size(models) > 0) & (model != "") & ~listed
