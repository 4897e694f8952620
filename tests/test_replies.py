"""Streamed replies, page requests, names, SQL functions, review parts and prompts on awkward rows."""

import json
import random

from pyspark.sql import functions as F

from ledgerlens.functions import replies as r, requests as rq, values as v
from ledgerlens.functions.sql import register_functions
from ledgerlens.operators import documents as dc, edits as ed, names, prompts as pr, review as rv


def said(**message):
    return json.dumps({"message": message})


def test_reply_fold(spark):
    lines = [said(thinking='hm {"is_target": true} x'), "", "nope", "3", said(content="a "), said(content="a b"), said(content=' {"is_target": false'), said(content="}"), said(content="late")]
    fenced = [said(content='{ prose ```json\n{"invoices": []}\n'), said(content="```"), said(content="more")]
    cases = [lines, lines[:4], [], ['{"error": "bad"}', *lines], ['{"error": ""}', said(content="x")], [None, said(content=None), said(content=7)], [said(thinking="no json")], fenced]
    got = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, l array<string>").select("k", r.fold_reply(F.col("l")).alias("r"))
    got = got.select("k", "r.*", r.reply_text(F.col("r")).alias("t")).orderBy("k").collect()
    assert [(x["content"], x["read"], x["t"]["problem"]) for x in got] == [
        ('a b {"is_target": false}', 8, None), ("", 4, None), ("", 0, "empty"), ("", 1, "error"), ("x", 2, None), ("", 3, "empty"), ("", 1, "only_thinking"),
        ('{ prose ```json\n{"invoices": []}\n```', 2, None),
    ]
    assert got[1]["t"]["text"] == '{"is_target": true}' and got[3]["error"] == "bad"


def sent(spark, *texts, image='I"M\\n'):
    rows = spark.createDataFrame([(k, t, image, 1, 2) for k, t in enumerate(texts)], "k int, request string, image string, last int, problem_ int")
    got = r.page_requests(rows, "request", "image").orderBy("k").collect()
    return [(json.loads(x["body"]) if x["body"] else None, x["problem"]) for x in got]


def test_page_request(spark):
    deep = '{"model":"m","messages":[{"role":"user","content":"{{PAGE_IMAGE}}","x":[[{"{{PAGE_IMAGE}}":"{{PAGE_IMAGE}}","y":"a \\"{{PAGE_IMAGE}}\\" \\\\"}]]},]}'
    plain = '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"old"},{"role":"user","content":"u","images":["k"]}],"options":{"think":1,"num_predict":256,"top":0.5}}'
    got = sent(spark, deep, plain, "[1]", "{", '{"model":"m"}', '{"messages":[1]}', None, '{"messages":[{"role":"assistant","content":"' + "\\\"" * 20_000 + '{{PAGE_IMAGE}}"}]}')
    image = 'I"M\\n'
    first = got[0][0]["messages"][0]
    assert first["content"] == image and first["x"] == [[{"{{PAGE_IMAGE}}": image, "y": 'a "{{PAGE_IMAGE}}" \\'}]] and "images" not in first
    assert got[0][0]["options"] == {"num_ctx": 8192, "num_predict": 4096, "repeat_penalty": 1.12, "temperature": 0} and got[0][0]["stream"] is True and got[0][0]["think"] is False
    assert got[1][0]["messages"] == [{"role": "system", "content": "s"}, {"role": "user", "content": "u", "images": ["k", image]}] and got[1][0]["options"]["top"] == 0.5 and "think" not in got[1][0]["options"]
    assert [p for _, p in got] == [None, None, "not_object", "syntax", "no_messages", "bad_message", "syntax", None]
    assert got[7][0]["messages"][0]["content"] == '"' * 20_000 + "{{PAGE_IMAGE}}" and got[7][0]["messages"][0]["images"] == [image]


def test_names_as_given_out_one_by_one(spark):
    draw = random.Random(8)
    files = [(g, k, draw.choice(["a.json", "a-id-0.json", "a-id-0-2.json", "a-id-1.json", "b", "", None]), draw.choice(["id-0x", "id-1y", "id", None])) for g in (1, 2, None) for k in range(60)]
    want = {}
    for g in (1, 2, None):
        used = set()
        for _, k, name, id_ in (f for f in files if f[0] == g):
            name, id_ = name or "", id_ or ""
            dot = name.rfind(".")
            stem, suffix = (name[:dot], name[dot:]) if dot >= 0 else (name, "")
            tries = [name, f"{stem}-{id_[:6]}{suffix}", *(f"{stem}-{id_[:6]}-{n}{suffix}" for n in range(2, 200))]
            want[g, k] = next(t for t in tries if t not in used)
            used.add(want[g, k])
    df = spark.createDataFrame(files, "g int, k int, name string, id string").repartition(3)
    got = names.claim_names(df, "g", "k", "name", "id")
    assert {(x["g"], x["k"]): x["claimed"] for x in got.collect()} == want and got.columns == ["g", "k", "name", "id", "claimed"]
    assert not names.claim_names(df.limit(0), "g", "k", "name", "id").collect()


def test_sql_functions_agree_with_columns(spark):
    register_functions(spark)
    texts = [None, "", " a － b ", "HKD 1,500.00", "10.50 KG", "10.5kg", "13 Nov 2025", "13/11/2025", "2025年11月13日", "30 Feb 2025", "01/13/25", "a / b", "a/b", "x　y", "--5", "1.2.3"]
    keys = ["total", "weight", "gross_weight", "invoice_date", "terms"]
    pairs = spark.createDataFrame([(k, a, b) for k in keys for a in texts for b in texts], "k string, a string, b string")
    by_sql = pairs.selectExpr("k", "a", "b", "field_equal(k, a, b) as e", "parse_amount(a) as n", "parse_date(a) as d", "norm_text(a) as t")
    by_col = pairs.select("k", "a", "b", v.field_equal(v.field_class(F.col("k")), F.col("a"), F.col("b")).alias("e"), v.parse_amount(F.col("a")).alias("n"), v.parse_date(F.col("a")).alias("d"), v.norm_text(F.col("a")).alias("t"))
    assert sorted(map(str, by_sql.collect())) == sorted(map(str, by_col.collect()))
    assert "Python" not in by_sql._jdf.queryExecution().executedPlan().toString()


def test_model_is_missing(spark):
    rows = spark.createDataFrame([("a", ["a"]), ("a", ["a:latest"]), ("a", ["b"]), ("", ["b"]), ("a", [])], "m string, have array<string>")
    assert [x[0] for x in rows.select(rq.model_missing(F.col("m"), F.col("have"))).collect()] == [False, False, True, False, False]


HEADER = [("h1", "no"), ("h2", "day")]
COLUMNS = [("c1", "item")]


def fields(pairs):
    return F.array(*[F.struct(F.lit(i).alias("field_id"), F.lit(k).alias("field_key")) for i, k in pairs])


def test_typed_replies_of_any_json(spark):
    texts = ['{"is_target": "true", "invoices": [{"header": {"no": 7, "x": 1, "day": null}, "sublist": [{}, {"item": " a "}, 3, {"z": 1}]}, null, 4]}', '{"invoices": {}}', "[]", None, '{"is_target": 1, "orphan_sublist": [{"item": true}]}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.try_parse_json("t").alias("v"))
    got = rv.typed_replies(df, "v", F.array(F.lit("no"), F.lit("day")), F.array(F.lit("item"))).orderBy("k").collect()
    blank = {"no": "", "day": ""}
    assert [x["is_target"] for x in got] == [True, False, False, False, False]
    assert [(i["header"], i["sublist"]) for i in got[0]["invoices"]] == [({"no": "7", "day": ""}, [{"item": "a"}, {"item": ""}]), (blank, []), (blank, [])]
    assert [x["invoices"] for x in got[1:]] == [[]] * 4 and got[4]["orphan_sublist"] == [{"item": "true"}]


def test_saved_exports_read_back(spark):
    texts = ['{"fields": {"no": 1}}', '{"invoices": []}', '{"invoices": [{"no": "a"}, {"no": "b"}]}', '{"sublist": [{"item": "x"}, 5]}', '{"invoicesWithSublist": [{"invoice": {"no": "q"}}]}', '{"other": 1}', "7"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.try_parse_json("t").alias("v"))
    got = {x["k"]: x for x in rv.review_of_exports(df, "v", fields(HEADER), fields(COLUMNS)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and [got[k]["structure_type"] for k in range(5)] == ["single", "single", "multi_invoice", "invoice_with_sublist", "multi_invoice_with_sublist"]
    assert got[0]["field_values"] == {"h1": "1", "h2": ""} and got[0]["sublist_rows"] == [{}] and got[1]["invoice_entries"][0]["rows"] is None and got[1]["field_values"] == {}
    assert [e["header"]["h1"] for e in got[2]["invoice_entries"]] == ["a", "b"] and got[3]["sublist_rows"] == [{"c1": "x"}, {"c1": ""}] and got[4]["invoice_entries"][0]["rows"] == [{}]


def test_defaults_and_new_documents(spark):
    files = spark.createDataFrame([("a.pdf", 1)], "file_name string, file_size int")
    given, row = F.create_map(F.lit("no"), F.lit("N"), F.lit("day"), F.lit(""), F.lit("zz"), F.lit("1")), F.array(F.create_map(F.lit("item"), F.lit("oil")))
    header, rows = ed.default_cells(given, fields(HEADER)), ed.default_rows(row, fields(COLUMNS))
    new = ed.new_documents(files, header, rows)
    x = new.first()
    assert (x["invoice_header"], x["sublist_rows"], x["structure_type"], x["category"], x["field_values"]) == ({"h1": "N"}, [{"c1": "oil"}], "single", None, {})
    assert new.select(ed.default_rows(F.lit(None).cast(f"array<{dc.CELLS}>"), fields(COLUMNS)).alias("r")).first()["r"] == [{}]
    held = new.withColumns({"invoice_header": F.create_map(F.lit("h1"), F.lit("old"), F.lit("h2"), F.lit("D")), "sublist_rows": dc.empty(f"array<{dc.CELLS}>")})
    seen = {s: ed.with_defaults(held.withColumn("structure_type", F.lit(s)), header, rows).first() for s in ("single", "invoice_with_sublist", "multi_invoice_with_sublist")}
    assert seen["single"]["invoice_header"] == {"h1": "old", "h2": "D"} and seen["invoice_with_sublist"]["invoice_header"] == {"h1": "N", "h2": "D"} and seen["invoice_with_sublist"]["sublist_rows"] == [{"c1": "oil"}]
    assert seen["multi_invoice_with_sublist"]["invoice_entries"][0]["header"] == {"h1": "N"}


def test_public_rows_and_addresses(spark):
    rows = spark.createDataFrame([(7, "A.PDF", "/x"), (8, "b.png", "/y")], "id int, file_name string, pdf_path string")
    assert [tuple(x) for x in ed.public_examples(rows).orderBy("id").collect()] == [(7, "A.PDF", "pdf", "/api/label/examples/7/pdf"), (8, "b.png", "image", "/api/label/examples/8/pdf")]
    urls = spark.createDataFrame([("QQ==", None), ("QQ==", "image/png"), ("", "x"), (None, None)], "e string, m string").select(ed.data_url(F.col("e"), F.col("m")))
    assert [x[0] for x in urls.collect()] == ["data:image/jpeg;base64,QQ==", "data:image/png;base64,QQ==", None, None]
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 5)], "doc int, page int")
    assert ed.first_pages(pages, "doc", "page", 1).count() == 2 and ed.first_pages(pages, "doc", "page", None).count() == 4


def test_optimiser_replies_and_template_text(spark):
    replies = ['ok {"classification_hints": ["a", 1, "  ", null], "system_prompt": " p ", "classification_model": ""} x', '{"classification_hints": []}', "none", None]
    got = spark.createDataFrame([(x,) for x in replies], "t string").select(pr.optimised(F.col("t")).alias("o")).select("o.*").collect()
    assert [tuple(x) for x in got[:2]] == [(["a"], "p", None, None), ([], None, None, "empty")] and [x["problem"] for x in got[2:]] == ["syntax", "syntax"]
    made = spark.createDataFrame([("t", "header", 2, "b", "B"), ("t", "header", 1, "a", 'A"'), ("u", "sublist", 1, "c", "C")], "template_id string, scope string, pos int, field_key string, label string")
    shown = {x["template_id"]: json.loads(x["description"]) for x in pr.template_json(made).collect()}
    assert shown == {"t": {"id": "t", "headerFields": [{"key": "a", "label": 'A"'}, {"key": "b", "label": "B"}], "sublistColumns": []}, "u": {"id": "u", "headerFields": [], "sublistColumns": [{"key": "c", "label": "C"}]}}
    text = {x["template_id"]: x["prompt"] for x in pr.page_prompts(made).collect()}
    assert '- a：A"\n- b：B' in text["t"] and "sublist，一行" not in text["t"] and "- c：C" in text["u"]


def test_example_sizes_at_their_limit(spark, tmp_path):
    """q71: of 9000 characters an example is taken, of 9001 it is too large, as its SQL has it."""
    from ledgerlens.plans import catalogue

    spark.createDataFrame([(i, "x", "en", "src1", n) for i, n in enumerate((8999, 9000, 9001, 9004))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.problem for r in catalogue.QUERIES["q71_example_checks"](spark, str(tmp_path)).collect()}
    assert got == {0: None, 1: "type", 2: "too_large", 3: "too_large"}


def test_saved_exports_are_read_once_and_by_their_kinds(spark):
    texts = ['{"fields": {"no": 1.50, "day": null, "x": {"a": 1}}}', '{"invoice": {"no": true, "day": [1]}, "sublist": [{"item": 2.0}, null, {"item": "a"}, {"item": null}]}', '{"invoices": [{"no": "a"}, {"no": 1e21}, 3]}', '{"invoices": [{"no": "a"}, null]}', '{"invoice": "x", "sublist": {}}', '{"sublist": []}']
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.try_parse_json("t").alias("v"))
    out = rv.review_of_exports(docs, "v", fields(HEADER), fields(COLUMNS + [("c2", "item")]))
    got = [x for x in out.orderBy("k").collect()]
    assert [x["field_values"] for x in got] == [{"h1": "1.5", "h2": ""}, {"h1": "true", "h2": ""}, {"h1": "a", "h2": ""}, {"h1": "a", "h2": ""}, {"h1": "", "h2": ""}, {"h1": "", "h2": ""}]
    assert [[e["header"]["h1"] for e in x["invoice_entries"]] for x in got[2:4]] == [["a", "1e+21", ""], ["a", ""]]
    assert got[1]["sublist_rows"] == [{"c1": x, "c2": x} for x in ("2", "", "a", "")] == got[1]["invoice_entries"][0]["rows"]
    twice = spark.range(1).select(dc.rename(F.create_map(F.lit("h1"), F.lit("a"), F.lit("h3"), F.lit("b")), fields([*HEADER, ("h3", "no")]), "field_id", "field_key").alias("m"))
    assert twice.first()["m"] == {"no": "b", "day": ""} and got[4]["sublist_rows"] == got[5]["sublist_rows"] == [{}]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1  # 11 times before, in a filter of what was found


def test_sql_equality_reads_dates_only_where_they_are_asked_for(spark):
    register_functions(spark)
    pairs = spark.createDataFrame([("invoice_date", "13 Nov 2025", "2025/11/13"), ("weight", "1,0 kg", "10KG")], "k string, a string, b string")
    out = pairs.selectExpr("field_equal(k, a, b) as e", "parse_date(a) as d")
    assert [tuple(x) for x in out.collect()] == [(True, "2025-11-13"), (True, None)]
    plan = pairs.selectExpr("field_equal(k, a, b) as e")._jdf.queryExecution().optimizedPlan()
    steps = [x for x in plan.toString().split("\n") if "Project" in x]
    assert not any("regexp_extract" in x for x in steps[1:])  # before, each text was read as a date and a measure in steps of their own
