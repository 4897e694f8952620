"""Prompts assembled from field lists and rules, and the replies of a prompt optimiser applied to requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.replies import OBJECT, _with, kept_messages, request_json
from ledgerlens.functions.requests import is_kind
from ledgerlens.functions.text import json_part
from ledgerlens.functions.values import trim_ws

# Fixed values that results depend on: the lines of a page prompt in order. {header} and {columns} stand for field lists.
PROMPT_TOP = """这是一份单证 PDF 中的一页。请先判断该页是否包含下述目标字段，再按要求抽取。

发票头字段（header，每张发票一组）：
{header}"""
PROMPT_COLUMNS = """

子清单明细列（sublist，一行对应一条明细）：
{columns}"""
PROMPT_SHAPE = """

请严格按以下 JSON 结构输出：
{
  "is_target": true 或 false，该页是否包含上述目标字段。封面、合同条款、报关随附资料、空白页等无关页填 false,
  "invoices": [该页上出现发票头的每张发票一个对象：
    {"header": {字段key: "字符串值"（未出现的字段省略）}"""
PROMPT_ROWS = """,
     "sublist": [{列key: "字符串值"}, ...]（该发票在本页的明细行，没有则为空数组）}],
  "orphan_sublist": [{列key: "字符串值"}, ...]（该页只有明细行、发票头出现在之前页时放这里，否则为空数组）"""
PROMPT_NO_ROWS = """}],
  "orphan_sublist": []"""
PROMPT_END = """
}

注意：
- is_target 为 false 时，invoices 与 orphan_sublist 都输出空数组
- 金额只保留数字、小数点与负号；日期、编号保持原文
- 表格明细逐行抽取，不要合并、不要遗漏行
- 只输出 JSON 本身
- 图片中未出现的字段在 JSON 中省略或填空字符串，不要编造"""
RULES_TITLE, HINTS_TITLE, NO_RULES = "【版式判定规则（必须遵守）】", "【样例优化补充特征】", "- 根据目标字段标题、版式和单证类型判断"


def field_lines(fields: Column) -> Column:
    """One line a field: its key and its label."""
    return F.array_join(F.transform(fields, lambda f: F.concat(F.lit("- "), f["field_key"], F.lit("："), f["label"])), "\n")


def _listed(scope: str) -> Column:
    """A template's fields of that scope in order; fields of one place by key."""
    one = F.when(F.col("scope") == scope, F.struct("pos", "field_key", "label"))
    return F.array_sort(F.collect_list(one))


def page_prompts(fields: DataFrame, by: str = "template_id") -> DataFrame:
    """fields(by, scope, pos, field_key, label) -> (by, prompt): the page prompt of each template, from its header
    fields and, where it has any, the columns of its rows. A template's fields meet in one row, which is what a prompt holds."""
    lists = fields.groupBy(by).agg(_listed("header").alias("header"), _listed("sublist").alias("columns"))
    rows = F.size("columns") > 0
    part = lambda text, mark, listed: F.concat(F.lit(text.split(mark)[0]), field_lines(listed), F.lit(text.split(mark)[1]))
    prompt = F.concat(
        part(PROMPT_TOP, "{header}", F.col("header")), F.when(rows, part(PROMPT_COLUMNS, "{columns}", F.col("columns"))).otherwise(""),
        F.lit(PROMPT_SHAPE), F.when(rows, F.lit(PROMPT_ROWS)).otherwise(PROMPT_NO_ROWS), F.lit(PROMPT_END),
    )
    return lists.select(by, prompt.alias("prompt"))


def hint_block(rules: Column, hints: Column) -> Column:
    """Rules and learned hints of a page classifier as titled lists; a general rule where there are neither."""
    lines = lambda items: F.transform(items, lambda x: F.concat(F.lit("- "), x))
    some = lambda items: F.coalesce(F.size(items) > 0, F.lit(False))
    none = F.array().cast("array<string>")
    first = F.when(some(rules), F.concat(F.array(F.lit(RULES_TITLE)), lines(rules))).otherwise(none)
    second = F.when(some(hints), F.concat(F.array(F.lit(HINTS_TITLE)), lines(hints))).when(~some(rules), F.array(F.lit(NO_RULES))).otherwise(none)
    return F.array_join(F.concat(first, second), "\n")


def template_json(fields: DataFrame, by: str = "template_id") -> DataFrame:
    """(by, description): a template's fields as JSON, for a prompt that asks about the template."""
    one = lambda scope: F.transform(_listed(scope), lambda f: F.struct(f["field_key"].alias("key"), f["label"].alias("label")))
    return fields.groupBy(by).agg(one("header").alias("h"), one("sublist").alias("c")).select(by, F.to_json(F.struct(F.col(by).alias("id"), F.col("h").alias("headerFields"), F.col("c").alias("sublistColumns"))).alias("description"))


def optimised(reply: Column) -> Column:
    """An optimiser's reply -> struct(hints, system_prompt, model, problem): hints that are texts and not blank, the prompt
    under either of its names, trimmed. problem is syntax for a reply without JSON object, empty for one with neither."""
    v = F.try_parse_json(json_part(trim_ws(reply)))
    text = lambda name: F.when(is_kind(v, f"$.{name}", "string"), trim_ws(F.try_variant_get(v, f"$.{name}", "string")))
    listed = F.coalesce(F.try_variant_get(v, "$.classification_hints", "array<variant>"), F.array().cast("array<variant>"))
    hints = F.transform(F.filter(listed, lambda x: is_kind(x, "$", "string")), lambda x: F.try_variant_get(x, "$", "string"))
    hints = F.filter(hints, lambda x: trim_ws(x) != "")
    prompt = F.coalesce(text("classification_system_prompt"), text("system_prompt"))
    model = F.nullif(text("classification_model"), F.lit(""))
    problem = F.when(F.try_variant_get(v, "$", OBJECT).isNull(), "syntax").when((F.size(hints) == 0) & (F.coalesce(prompt, F.lit("")) == ""), "empty")
    return F.struct(hints.alias("hints"), prompt.alias("system_prompt"), model.alias("model"), problem.alias("problem"))


def apply_prompts(rows: DataFrame, request: str, system: str, user: str) -> DataFrame:
    """rows with body: the configured request, JSON text in column request, with its messages' contents replaced by the
    new prompts, a system message put first where there is none. A blank prompt on either side leaves the request as it is;
    a request that is no object with a user message has no body."""
    said = lambda c: F.parse_json(F.get(F.split(F.to_json(F.struct(c.alias("x"))), r'^\{"x":|\}$'), F.lit(1)))
    df = rows.select(F.struct(*rows.columns).alias("rows"), F.col(request).alias("text"), F.col(system).alias("s"), F.col(user).alias("u"), request_json(F.col(request)).alias("v"))
    df = df.withColumns({"members": F.try_variant_get("v", "$", OBJECT), "kept": kept_messages(F.try_variant_get("v", "$.messages", "array<variant>"))})
    role = lambda m: F.try_variant_get(m, "$.role", "string")
    first = lambda r: F.get(F.filter("kept", lambda m: F.coalesce(role(m) == r, F.lit(False))), F.lit(0))
    df = df.withColumns({"old_s": first("system"), "old_u": first("user")})
    new = lambda old, r, c: _with(F.coalesce(F.try_variant_get(old, "$", OBJECT), F.create_map().cast(OBJECT)), role=said(F.lit(r)), content=said(F.col(c)))
    df = df.withColumn("messages", F.array(new(F.col("old_s"), "system", "s"), new(F.col("old_u"), "user", "u")))
    blank = (trim_ws(F.coalesce("s", F.lit(""))) == "") | (trim_ws(F.coalesce("u", F.lit(""))) == "")
    body = F.when(blank, F.col("text")).when(F.col("old_u").isNotNull() & F.col("members").isNotNull(), F.to_json(_with(F.col("members"), messages=F.parse_json(F.to_json("messages")))))
    return df.select("rows.*", body.alias("body"))
