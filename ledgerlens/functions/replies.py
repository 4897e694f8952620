"""Streamed model replies and page requests as Column expressions over JSON text; no Python in the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .requests import complete_reply, is_kind, kind, part, request_options
from .text import json_part, lenient_json
from .values import trim_ws

# Fixed value that results depend on.
PAGE_IMAGE = "{{PAGE_IMAGE}}"
#: A JSON string, or what is between two strings.
TOKEN = r'"(?:[^"\\]++|\\.)*+"|[^"]++'


def _joined(before: Column, delta: Column) -> Column:
    """A delta that starts with all that came before replaces it."""
    return F.when((before != "") & F.startswith(delta, before), delta).otherwise(F.concat(before, delta))


def recovered_json(thinking: Column) -> Column:
    """The JSON object inside a text that was meant as reasoning, else null."""
    found = json_part(trim_ws(thinking))
    return F.when(F.startswith(found, F.lit("{")) & F.try_parse_json(found).isNotNull(), found)


def fold_reply(lines: Column, profile: str = "extract") -> Column:
    """Ordered lines of a streamed reply (array<string>) -> struct(content, thinking, error, read).

    Each line is a JSON object with message.content or message.thinking, which go to one channel each. Blank
    and broken lines, and such that are no object, are passed over. A line with an error ends the reply, as does
    content that holds the whole object that the profile asks for; read counts the lines up to there. The fold is
    one pass over the lines; content is only tested for completeness where a line may have closed an object.
    """
    text = "string"
    start = F.struct(F.lit("").cast(text).alias("content"), F.lit("").cast(text).alias("thinking"), F.lit(None).cast(text).alias("error"), F.lit(0).alias("read"), F.lit(False).alias("over"))
    channel = lambda v, c: F.coalesce(F.when(is_kind(v, f"$.message.{c}", "string"), F.try_variant_get(v, f"$.message.{c}", "string")), F.lit(""))

    def told(v: Column) -> Column:
        """The error of a line; null for none, false, zero or an empty text."""
        given = part(v, "$.error")
        said = F.when(kind(given) == "string", F.try_variant_get(v, "$.error", "string")).otherwise(F.to_json(given))
        return F.when(~said.isin("", "null", "false", "0", "{}", "[]"), said)

    def step(acc: Column, line: Column) -> Column:
        chunks = F.transform(F.array(F.try_parse_json(trim_ws(line))), lambda v: F.struct(F.coalesce(kind(v) == "object", F.lit(False)).alias("ok"), channel(v, "content").alias("c"), channel(v, "thinking").alias("t"), told(v).alias("e")))

        def put(x: Column) -> Column:
            content, thinking = _joined(acc["content"], x["c"]), _joined(acc["thinking"], x["t"])
            closes = F.contains(x["c"], F.lit("}")) | F.contains(x["c"], F.lit("`"))
            over = F.when(x["e"].isNotNull(), True).when(closes, complete_reply(content, profile)).otherwise(False)
            bad = x["e"].isNotNull()
            return F.struct(
                F.when(bad, acc["content"]).otherwise(content).alias("content"), F.when(bad, acc["thinking"]).otherwise(thinking).alias("thinking"),
                x["e"].alias("error"), (acc["read"] + 1).alias("read"), over.alias("over"),
            )

        passed = acc.withField("read", acc["read"] + 1)
        return F.when(acc["over"], acc).otherwise(F.get(F.transform(chunks, lambda x: F.when(x["ok"], put(x)).otherwise(passed)), F.lit(0)))

    return F.aggregate(lines, start, step).dropFields("over")


def reply_text(reply: Column) -> Column:
    """A folded reply -> struct(text, problem): its content, or the JSON of its thinking where there is no content.
    problem is error, only_thinking or empty; null where there is a text."""
    blank = lambda c: trim_ws(reply[c]) == ""
    text = F.when(reply["error"].isNull(), F.when(~blank("content"), reply["content"]).otherwise(recovered_json(reply["thinking"])))
    problem = F.when(reply["error"].isNotNull(), "error").when(text.isNull(), F.when(~blank("thinking"), "only_thinking").otherwise("empty"))
    return F.struct(text.alias("text"), problem.alias("problem"))


def replace_leaves(text: Column, mark: str, put: Column) -> Column:
    """JSON text with each string value that is exactly mark, at any depth, replaced by the string put. Keys and
    strings that only hold the mark stay. The text is cut into strings and what is between, so length and depth do not matter."""
    quoted = F.to_json(F.struct(put.alias("x")))
    value = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    is_key = lambda t, i: F.coalesce(F.get(t, i + 1).rlike(r"^\s*:"), F.lit(False))
    swapped = F.transform(F.array(tokens), lambda t: F.array_join(F.transform(t, lambda x, i: F.when((x == f'"{mark}"') & ~is_key(t, i), value).otherwise(x)), ""))
    return F.get(swapped, F.lit(0))


def kept_messages(messages: Column) -> Column:
    """The first system message and the last user message; all of them if there is no user message (array<variant>)."""
    of = lambda role: F.filter(messages, lambda m: F.coalesce(F.try_variant_get(m, "$.role", "string") == role, F.lit(False)))
    return F.when(F.size(of("user")) > 0, F.concat(F.slice(of("system"), 1, 1), F.slice(of("user"), -1, 1))).otherwise(messages)


def _with(members: Column, **new: Column) -> Column:
    """An object, map<string,variant>, with members replaced."""
    rest = F.map_filter(members, lambda k, _: ~k.isin(*new))
    return F.map_concat(rest, F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)]))


def request_json(text: Column) -> Column:
    """Variant of a configured request; commas before a closing bracket are let pass."""
    trimmed = trim_ws(text)
    return F.coalesce(lenient_json(trimmed), F.try_parse_json(F.regexp_replace(trimmed, r"(?:,\s*){1,8}([}\]])", "$1")))


OBJECT, LIST = "map<string,variant>", "array<variant>"


def page_requests(rows: DataFrame, text: str, image: str, profile: str = "extract") -> DataFrame:
    """rows with body and problem: for each the request for one page, from the configured request in column text and
    the page image in column image.

    The body is JSON text with the image in place of every value {{PAGE_IMAGE}}, or at the end of the last message's
    images where there was none. Only the first system and the last user message stay, options are filled up
    and streaming is on. problem is syntax, not_object, no_messages or bad_message, and the body is null then. The steps
    are columns of their own, so that each is computed once and stays small enough to be compiled; they do not
    clash with columns of rows, which are carried in one struct.
    """
    again = lambda x: F.parse_json(F.to_json(x))
    none = lambda kind_: F.array().cast(f"array<{kind_}>")
    member = lambda v, path, kind_: F.try_variant_get(v, path, kind_)
    v, out = F.col("v"), F.col("out")
    df = rows.select(F.struct(*rows.columns).alias("rows"), F.col(image).alias("image"), request_json(F.col(text)).alias("v"))
    df = df.withColumns({"members": member(v, "$", OBJECT), "listed": member(v, "$.messages", LIST), "opts": request_options(v, profile)})
    df = df.withColumn("kept", F.when(F.col("listed").isNotNull(), kept_messages(F.col("listed"))))
    df = df.withColumn("plain", F.to_json(F.when(F.col("kept").isNotNull(), _with(F.col("members"), messages=again(F.col("kept")))).otherwise(F.col("members"))))
    df = df.withColumn("swapped", replace_leaves(F.col("plain"), PAGE_IMAGE, F.col("image"))).withColumn("out", F.try_parse_json("swapped"))
    df = df.withColumns({"all": member(out, "$.messages", LIST), "given": F.coalesce(member(v, "$.options", OBJECT), F.map_from_arrays(none("string"), none("variant")))})
    df = df.withColumn("last", F.get("all", F.size("all") - 1))
    images = F.concat(F.coalesce(member(F.col("last"), "$.images", LIST), none("variant")), F.array(F.parse_json(F.get(F.split(F.to_json(F.struct(F.col("image").alias("x"))), r"^\{\"x\":|\}$"), F.lit(1)))))
    df = df.withColumn("images", F.when(kind(F.col("last")) == "object", images))
    df = df.withColumn("new_last", F.when(F.col("images").isNotNull(), _with(member(F.col("last"), "$", OBJECT), images=again(F.col("images")))))
    found = F.col("swapped") != F.col("plain")
    problem = (
        F.when(v.isNull(), "syntax").when(kind(v) != "object", "not_object").when(found, None)
        .when(F.coalesce(F.size("listed"), F.lit(0)) <= 0, "no_messages").when(F.col("images").isNull(), "bad_message")
    )
    appended = F.concat(F.slice("all", F.lit(1), F.size("all") - 1), F.array(again(F.col("new_last"))))
    df = df.withColumn("problem", problem)
    df = df.withColumn("sent", F.when(F.col("problem").isNull() & F.col("all").isNotNull(), F.when(found, F.col("all")).otherwise(appended)))
    set_ = {k: F.parse_json(F.col(f"opts.{k}").cast("string")) for k in ("num_predict", "num_ctx", "temperature", "repeat_penalty")}
    options = F.map_filter(_with(F.col("given"), **set_), lambda k, _: k != "think")
    whole = _with(member(out, "$", OBJECT), options=again(options), stream=F.parse_json(F.lit("true")), think=F.parse_json(F.lit("false")))
    df = df.withColumn("whole", whole)
    body = F.to_json(F.when(F.col("sent").isNotNull(), _with(F.col("whole"), messages=again(F.col("sent")))).otherwise(F.col("whole")))
    return df.select("rows.*", F.when(F.col("problem").isNull(), body).alias("body"), "problem")
