"""The report from export texts to statistics, on small documents with expectations worked out by hand."""

import json

from pyspark.sql import functions as F

from ledgerlens.functions.values import match_key
from ledgerlens.operators.accuracy import Report, Side, pair_documents, with_templates
from ledgerlens.operators.labels import amount_fields
from ledgerlens.operators.templates import template_fields
from ledgerlens.sources.exports import read_exports


def side(spark, exports):
    docs, _ = read_exports(spark.createDataFrame([(k, json.dumps(v)) for k, v in exports.items()], "path string, text string"))
    docs = docs.withColumn("match_key", match_key(F.col("file_name"))).withColumn("doc_pos", F.col("doc_pos").cast("long"))
    inv = docs.select("match_key", "doc_pos", F.posexplode("invoices").alias("inv_pos", "i"))
    rows = F.transform("i.sublist", lambda cells, k: F.struct(k.alias("row_pos"), cells.alias("cells")))
    return Side(docs.select("doc_pos", "file_name", "match_key", "template_id"), inv.select("match_key", "doc_pos", "inv_pos", F.col("i.header").alias("header"), rows.alias("sublist")))


def report(spark, answers, results):
    a, r, fields = side(spark, answers), side(spark, results), template_fields(spark)
    return Report(with_templates(pair_documents(a.docs, r.docs), a, r, fields), a, r, fields)


def invoices(*numbers, template=None, **more):
    out = {"invoicesWithSublist": [{"invoice": {"invoice_no": n}, "sublist": []} for n in numbers]} | more
    return out | ({"extraction": {"layoutTemplateId": template}} if template else {})


def test_invoices_pair_by_normalised_number(spark):
    """Dash forms are one, inner blanks are not; the rest pairs by position."""
    got = report(spark, {"x.pdf": invoices("7-4", "B2"), "y.pdf": invoices("P Q", "C")}, {"x.json": invoices("B3", "7－4"), "y.json": invoices("X", "PQ")}).invoices.collect()
    assert sorted((r.match_key, r.a_inv, r.r_inv) for r in got) == [("x", 0, 1), ("x", 1, 0), ("y", 0, 0), ("y", 1, 1)]


def test_errors_name_what_is_missing(spark):
    line = lambda *d: [{"description": x, "charges_in_hkd": "1"} for x in d]
    answer = {"invoicesWithSublist": [{"invoice": {"invoice_no": "N1", "packages": "3"}, "sublist": line("oil", "tax")}, {"invoice": {"invoice_no": "N2"}, "sublist": []}], "extraction": {"layoutTemplateId": "freight_invoice"}}
    more = {"extraction": {"layoutTemplateId": "freight_invoice"}, "invoicesWithSublist": [{"invoice": {"invoice_no": "M1"}, "sublist": line("a")}]}
    result = {"invoicesWithSublist": [{"invoice": {"invoice_no": "n1", "packages": "4"}, "sublist": line("oil")}]}
    extra = {"invoicesWithSublist": [{"invoice": {"invoice_no": "M1"}, "sublist": line("a", "b", "c")}, {"invoice": {"invoice_no": "M9"}, "sublist": []}]}
    r = report(spark, {"x.pdf": answer, "y.pdf": more}, {"x.json": result, "y.json": extra})
    got = {(e.match_key, e.kind, e.field_key, e.label, e.expected, e.actual) for e in r.errors().collect()}
    assert got == {
        ("x", "field_mismatch", "packages", "包裹（packages）", "3", "4"),
        ("x", "missing_row", "description", "明细行", "tax", ""),
        ("x", "missing_invoice", "invoice_no", "发票", "N2", ""),
        ("y", "extra_row", "description", "明细行", "", "多出 2 行"),
        ("y", "extra_invoice", "invoice_no", "发票", "", "M9"),
    }


def test_template_of_result_then_answer_then_fields(spark):
    waybill = {"invoicesWithSublist": [{"invoice": {"invoice_no": "1"}, "sublist": [{"air_waybill_number": "9", "total": "5"}]}]}
    answers = {"a.pdf": waybill, "b.pdf": invoices("1", template="freight_invoice"), "c.pdf": invoices("1", template="freight_invoice"), "d.pdf": invoices("1", template="old")}
    results = {"a.json": waybill, "b.json": invoices("1", template="air_waybill_dhl"), "c.json": invoices("1"), "d.json": invoices("1")}
    got = {p.match_key: (p.template_id, p.fields_from) for p in report(spark, answers, results).pairs.collect()}
    assert got == {"a": ("air_waybill",) * 2, "b": ("air_waybill_dhl",) * 2, "c": ("freight_invoice",) * 2, "d": ("old", "air_waybill")}


def test_amount_columns_by_key(spark):
    made = [("t", "header", k, f"h{k}", key, "x") for k, key in enumerate(["invoice_no", "grand_total"])] + [("t", "sublist", k, f"c{k}", key, "x") for k, key in enumerate(["fee", "name", "amount"])]
    out = amount_fields(spark.createDataFrame(made, "template_id string, scope string, pos int, field_id string, field_key string, label string"))
    assert {(r.scope, r.field_id) for r in out.collect()} == {("header", "h1"), ("sublist", "c2")}


def test_queries_of_pairs_and_headers_carry_no_rows(spark):
    """Pairs read the documents' own table only; reports of headers take no sublist from the written sides."""
    from ledgerlens.plans import catalogue

    d = "/root/testdata/sf0.001"
    scans = lambda name: [x for x in catalogue.QUERIES[name](spark, d)._jdf.queryExecution().sparkPlan().toString().split("\n") if "FileScan" in x]
    pairs, headers = scans("q09_pair_docs"), scans("q12_align_invoices")
    assert pairs and not [x for x in pairs if "l_orderkey" in x or "o_orderkey" in x or "header" in x or "template_id" in x]
    assert headers and not [x for x in headers if "sublist#" in x]


def test_report_reads_the_tables_and_writes_nothing(spark, tmp_path):
    """Templates come from the documents' own rows, so no side is written and read again, and rows align without windows."""
    from ledgerlens.plans import catalogue

    d = "/root/testdata/sf0.001"
    df = catalogue.QUERIES["q18_template_stats"](spark, d)
    assert all(f.startswith(f"file://{d}/") for f in df.inputFiles())
    plan = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    assert len([x for x in plan if " Window " in f" {x.strip(' :+-')} "]) <= 1  # the first result of a key


def test_alignment_equals_matching_one_by_one():
    import random

    import pyarrow as pa

    from ledgerlens.operators.align import align_batch

    def one_by_one(a_key, a_pos, r_key, r_pos):
        a, r = (sorted(range(len(p)), key=p.__getitem__) for p in (a_pos, r_pos))
        pairs, left = [], []
        for i in a:
            j = next((j for j in r if a_key[i] and r_key[j] == a_key[i]), None)
            if j is None:
                left.append(i)
            else:
                r.remove(j)
                pairs.append((i, j))
        pairs += [(left[k] if k < len(left) else None, r[k] if k < len(r) else None) for k in range(max(len(left), len(r)))]
        return sorted(pairs, key=lambda p: (p[0] is None, a_pos[p[0]] if p[0] is not None else r_pos[p[1]]))

    rng = random.Random(3)
    lists = lambda n: ([rng.choice(["a", "b", "c", "", None]) for _ in range(n)], rng.sample(range(50), n))
    for _ in range(100):
        batch = [lists(rng.randint(0, 7)) + lists(rng.randint(0, 7)) for _ in range(rng.randint(0, 8))]
        cols = [pa.array([b[k] for b in batch], pa.list_((pa.string(), pa.int64())[k % 2])) for k in range(4)]
        got = [[(x["a_at"], x["r_at"]) for x in line] for line in align_batch(*cols).to_pylist()]
        assert got == [one_by_one(*b) for b in batch]


def test_orders_with_lines_group_without_windows(spark):
    """Lines get their order where they are grouped, so the table is sorted once, and cells are made after the shuffle."""
    from ledgerlens.plans import catalogue

    plan = catalogue.QUERIES["q67b_structure_switch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "map_entries" not in plan
