"""Queries of the client's fold of job events, result stores, streamed replies, page requests, names and SQL functions (q61 to q67)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerlens.functions import replies as r
from ledgerlens.functions.sql import register_functions
from ledgerlens.operators import client, names
from ledgerlens.streaming.sinks import EventLog, ResultStore
from . import bridge as b, oracle as o
from .report_queries import ORACLE, query

K = "cast(get_json_object(props, '$.k') as int)"
#: Each user is a job with five documents; the events' own types and numbers say what happened.
KIND = f"case event_type when 'signup' then 'doc_started' when 'view' then 'stream' when 'click' then 'page_done' when 'purchase' then 'doc_done' when 'error' then case when {K} % 10 = 0 then 'job_status' else 'doc_error' end end"


def job_events(spark: SparkSession, d: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq")
    rows = b.read(spark, d, "events").select(F.col("user_id").alias("job"), seq, F.expr(KIND).alias("event"), F.expr(K).alias("k"), F.col("value").cast("string").alias("shown"))
    paged = F.col("event").isin("stream", "page_done")
    return rows.select(
        "job", "seq", "event", F.when(F.col("event") != "job_status", (F.col("k") % 5).cast("long")).alias("doc"),
        F.when(F.col("event") == "job_status", F.when(F.col("k") % 20 == 0, "cancelled").otherwise("running")).alias("status"),
        F.when(paged, F.floor(F.col("k") / 5)).cast("int").alias("done"), F.when(paged, 20).alias("total"),
        F.when(F.col("event") == "page_done", F.array("shown")).alias("outcomes"), F.when(F.col("event") == "doc_error", F.col("shown")).alias("error"),
    )


_EVENTS = """e AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type, cast(json_extract_string(props, '$.k') AS INT) AS k, cast(value AS VARCHAR) AS shown FROM events),
    c AS (SELECT job, max(seq) AS ended FROM e WHERE event_type = 'error' AND k % 20 = 0 GROUP BY 1),
    x AS (SELECT *, k % 5 AS doc FROM e WHERE NOT (event_type = 'error' AND k % 10 = 0)),
    s AS (SELECT job, doc, max(seq) FILTER (event_type = 'signup') AS began, max(seq) AS last_seq, arg_max(event_type, seq) AS last_type, arg_max(shown, seq) AS last_shown,
        arg_max(CASE event_type WHEN 'signup' THEN 0 ELSE k // 5 END, seq) FILTER (event_type IN ('signup', 'view', 'click', 'purchase')) AS done,
        arg_max(CASE event_type WHEN 'signup' THEN 0 ELSE 20 END, seq) FILTER (event_type IN ('signup', 'view', 'click', 'purchase')) AS total,
        arg_max(event_type, seq) FILTER (event_type IN ('signup', 'view', 'click', 'purchase')) AS done_type FROM x GROUP BY ALL),
    p AS (SELECT x.job, x.doc, count(*) AS pages, string_agg(shown, '|' ORDER BY seq) AS outcomes FROM x JOIN s ON x.job = s.job AND x.doc = s.doc WHERE event_type = 'click' AND seq > coalesce(began, 0) GROUP BY ALL),
    t AS (SELECT s.job, s.doc, CASE WHEN last_type = 'purchase' THEN 'done' WHEN last_type = 'error' THEN 'error' WHEN ended > last_seq THEN 'cancelled' ELSE 'running' END AS status,
        CASE WHEN done_type = 'purchase' THEN coalesce(pages, 0) ELSE coalesce(done, 0) END AS done, CASE WHEN done_type = 'purchase' THEN coalesce(pages, 0) ELSE coalesce(total, 0) END AS total,
        coalesce(outcomes, '') AS outcomes, CASE WHEN last_type = 'error' THEN last_shown WHEN last_type <> 'purchase' AND ended > last_seq THEN '已中断' END AS error
        FROM s LEFT JOIN p ON s.job = p.job AND s.doc = p.doc LEFT JOIN c ON s.job = c.job)"""
_STATE = f"WITH {_EVENTS} SELECT job, doc, status, done::INT AS done, total::INT AS total, outcomes, error FROM t"


def _shown(state: DataFrame) -> DataFrame:
    return state.select("job", "doc", "status", "done", "total", F.array_join("outcomes", "|").alias("outcomes"), "error")


@query(_STATE)
def q61_client_state(spark: SparkSession, d: str) -> DataFrame:
    return _shown(client.document_state(job_events(spark, d)))


@query(
    f"""WITH {_EVENTS}, j AS (SELECT job, arg_max(CASE WHEN k % 20 = 0 THEN 'cancelled' ELSE 'running' END, seq) FILTER (event_type = 'error' AND k % 10 = 0) AS status FROM e GROUP BY 1),
    n AS (SELECT job, count(*) AS documents, count(*) FILTER (status <> 'running') AS ended, sum(done)::BIGINT AS pages FROM t GROUP BY 1)
    SELECT j.job, status, coalesce(documents, 0) AS documents, coalesce(ended, 0) AS ended, coalesce(pages, 0) AS pages FROM j LEFT JOIN n ON j.job = n.job"""
)
def q61b_job_view(spark: SparkSession, d: str) -> DataFrame:
    return client.job_view(job_events(spark, d))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{names.shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query(_STATE)
def q61c_event_log(spark: SparkSession, d: str) -> DataFrame:
    """All events through a log in four batches with a snapshot after the second, as a reader folds it from there."""
    log = EventLog(spark, _folder(spark, "events"), every=2)
    events = names.cut(job_events(spark, d).withColumn("batch", F.least(F.floor(F.col("seq") / 20), F.lit(3))))
    for k in range(4):
        log.write(events.filter(F.col("batch") == k).drop("batch"), k)
    return _shown(client.document_state(log.events(upto=3)))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def q61d_result_store(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user after three batches, one of them written twice."""
    store = ResultStore(spark, _folder(spark, "results"), "user_id long, at struct<ts: timestamp, event_id: long>, event_type string", "user_id", "at")
    rows = b.read(spark, d, "events").select("user_id", F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id").alias("at"), "event_type")
    for k in (0, 1, 1, 2):
        store.write(rows.filter(F.pmod(F.xxhash64("at.event_id"), F.lit(3)) == k), k)
    return store.read().select("user_id", "at.event_id", "event_type")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'error'")
def q61e_user_batches(spark: SparkSession, d: str) -> DataFrame:
    """One labelling batch a user: every event but an error saves it, an error deletes it; batches as they are after all that."""
    schema = "user_id long, at struct<ts: timestamp, event_id: long>, value double, gone boolean"
    store = ResultStore(spark, _folder(spark, "batches"), schema, "user_id", "at", "gone")
    rows = b.read(spark, d, "events").select("user_id", F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id").alias("at"), "value", (F.col("event_type") == "error").alias("gone"))
    for k in range(3):
        store.write(rows.filter(F.pmod(F.xxhash64("at.event_id"), F.lit(3)) == k), k)
    return store.read().select("user_id", "at.event_id", "value")


#: What a turn of a conversation sends: an assistant's text is content, and one whose length divides by 3 is the object that
#: ends the reply; a user's text is reasoning; a system text is a line that cannot be read.
LINE = """case role when 'assistant' then to_json(named_struct('message', named_struct('content', case when length(text) % 3 = 0 then concat('{"is_target": true, "n": ', cast(length(text) as string), '}') else text end)))
    when 'user' then to_json(named_struct('message', named_struct('thinking', text))) else text end"""


@query(
    """WITH m AS (SELECT *, min(turn) FILTER (role = 'assistant' AND length(text) % 3 = 0) OVER (PARTITION BY conv_id) AS stop FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, coalesce(string_agg(CASE WHEN turn = stop THEN '{"is_target": true, "n": ' || length(text) || '}' ELSE text END, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS content,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'user'), '') AS thinking, count(*)::INT AS read FROM m WHERE turn <= coalesce(stop, turn) GROUP BY 1"""
)
def q62_reply_fold(spark: SparkSession, d: str) -> DataFrame:
    turns = b.read(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", F.expr(LINE).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    folded = turns.groupBy("conv_id").agg(lines.alias("lines")).select("conv_id", r.fold_reply(F.col("lines")).alias("r"))
    return folded.select("conv_id", "r.content", "r.thinking", "r.read")


@query(
    """WITH m AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS u, min(turn) FILTER (role = 'system') AS s FROM conversations GROUP BY 1)
    SELECT m.conv_id, concat(cu.text, ' {{PAGE_IMAGE}} "\\') AS "user", cs.text AS system, concat('IMG', m.conv_id) AS image, CASE WHEN length(cu.text) % 2 = 0 THEN 'deep' ELSE 'appended' END AS place
    FROM m JOIN conversations cu ON cu.conv_id = m.conv_id AND cu.turn = u LEFT JOIN conversations cs ON cs.conv_id = m.conv_id AND cs.turn = s"""
)
def q63_page_request(spark: SparkSession, d: str) -> DataFrame:
    """Whole conversations as configured requests. Where a text's length is even the mark is a value inside a nested array."""
    extra = F.when(F.length("text") % 2 == 0, F.array(F.array(F.struct(F.lit("{{PAGE_IMAGE}}").alias("{{PAGE_IMAGE}}")))))
    message = F.struct("turn", "role", F.concat("text", F.when(F.col("role") == "user", ' {{PAGE_IMAGE}} "\\').otherwise("")).alias("content"), extra.alias("parts"))
    chats = b.read(spark, d, "conversations").filter("role <> 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"), F.count_if(F.col("role") == "user").alias("users"))
    # marks in other turns go with their messages; a system text carries none
    clean = F.transform("messages", lambda m: F.when(m["role"] == "system", m.dropFields("turn").withField("parts", F.lit(None).cast(PARTS))).otherwise(m.dropFields("turn")))
    rows = chats.filter("users > 0").select("conv_id", F.concat(F.lit("IMG"), F.col("conv_id").cast("string")).alias("image"), F.to_json(F.struct(F.lit("m").alias("model"), clean.alias("messages"))).alias("request"))
    out = r.page_requests(rows, "request", "image").select("conv_id", "image", F.try_parse_json("body").alias("v"))
    at = lambda path: F.try_variant_get("v", path, "string")
    two = at("$.messages[1].content").isNotNull()
    deep, shown = (F.when(two, at(f"$.messages[1].{p}")).otherwise(at(f"$.messages[0].{p}")) for p in ("parts[0][0]['{{PAGE_IMAGE}}']", "images[0]"))
    return out.select(
        "conv_id", F.when(two, at("$.messages[1].content")).otherwise(at("$.messages[0].content")).alias("user"), F.when(two, at("$.messages[0].content")).alias("system"),
        F.coalesce(deep, shown).alias("image"), F.when(deep.isNotNull() & shown.isNull(), "deep").when(shown.isNotNull() & deep.isNull(), "appended").alias("place"),
    )


PARTS = "array<array<struct<`{{PAGE_IMAGE}}`: string>>>"

#: Names of a brand's parts: some are only the first word of the type, some already have what looks like a suffix.
FILE = "case when p_size % 3 = 0 then concat(split_part(p_type, ' ', 1), '.json') when p_size % 3 = 1 then concat(split_part(p_type, ' ', 1), '-doc-', cast(p_size % 4 as string), 'a.json') else concat(split_part(p_type, ' ', 1), '-doc-', cast(p_size % 4 as string), 'a-2.json') end"
DOC_ID = "concat('doc-', cast(p_partkey % 4 as string), 'a', cast(p_partkey as string))"


@query(
    f"""WITH RECURSIVE f AS (SELECT p_brand, p_partkey, {FILE.replace("as string", "as varchar")} AS name, {DOC_ID.replace("as string", "as varchar")} AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM part),
    c AS (SELECT *, list_prepend(name, list_transform(range(1, 200), lambda k: substr(name, 1, length(name) - 5) || '-' || substr(id, 1, 6) || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.json')) AS names FROM f),
    s AS (SELECT p_brand, p_partkey, pos, names[1] AS claimed, [names[1]] AS used FROM c WHERE pos = 1
      UNION ALL SELECT c.p_brand, c.p_partkey, c.pos, list_filter(c.names, lambda n: NOT list_contains(s.used, n))[1], list_append(s.used, list_filter(c.names, lambda n: NOT list_contains(s.used, n))[1])
      FROM s JOIN c ON c.p_brand = s.p_brand AND c.pos = s.pos + 1)
    SELECT p_partkey, claimed FROM s"""
)
def q64_claim_names(spark: SparkSession, d: str) -> DataFrame:
    files = b.read(spark, d, "part").select("p_brand", "p_partkey", F.expr(FILE).alias("name"), F.expr(DOC_ID).alias("id"))
    return names.claim_names(files, "p_brand", "p_partkey", "name", "id").select("p_partkey", "claimed")


_PAIRS = " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS field_key, {b.ANSWER_INV[k]} AS answer, {b.RESULT_INV[k]} AS actual FROM {{orders}}" for k in b.ANSWER_INV)


@query(ORACLE["q07_field_equal"])
def q65_sql_field_equal(spark: SparkSession, d: str) -> DataFrame:
    register_functions(spark)
    orders = b.read(spark, d, "orders")
    pairs = spark.sql(_PAIRS.replace("FROM {orders}", "FROM {o}"), o=orders)
    return spark.sql("SELECT o_orderkey, field_key, field_equal(field_key, answer, actual) AS equal FROM {pairs}", pairs=pairs)


@query(
    f"""SELECT o_orderkey, {o.amount(o.duck(b.RESULT_INV["total_hkd"]))} AS amount, {o.match_key("o_orderpriority || '/' || o_orderstatus || '.PDF.json'")} AS match_key,
    lower({o.norm(o.duck(b.RESULT_INV["terms"]))}) AS terms, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders"""
)
def q65b_sql_values(spark: SparkSession, d: str) -> DataFrame:
    register_functions(spark)
    text = f"""SELECT o_orderkey, parse_amount({b.RESULT_INV["total_hkd"]}) AS amount, match_key(concat(o_orderpriority, '/', o_orderstatus, '.PDF.json')) AS match_key,
        lower(norm_text({b.RESULT_INV["terms"]})) AS terms, parse_date({b.RESULT_INV["invoice_date"]}) AS iso FROM {{o}}"""
    return spark.sql(text, o=b.read(spark, d, "orders"))
