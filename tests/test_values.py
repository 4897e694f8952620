"""The tolerant equality table and the parsers, value by value."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text as t, values as v

CASES = [
    ("total", "HKD 1,500.00", "1500.00", True), ("invoice_no", " 4-107-66120 ", "4-107-66120", True), ("invoice_no", "123", "124", False),
    ("terms", "FOB - Free On Board", "fob - free on board", True), ("description", "Customs Entry/Storage Fee", "Customs Entry / Storage Fee", True),
    ("description", "A/B", "A /B", True), ("description", "A, B", "A， B", True), ("incoterm", "FOB - Free On Board", "FOB－Free On Board", True),
    ("incoterm", "FOB—Free On Board", "FOB - Free On Board", True), ("description", "A- B", "A -B", True), ("weight", "10.50 KG", "10.5kg", True),
    ("volume", "1.50CBM", "1.5 CBM", True), ("weight", "10.5 KG", "10.6 KG", False), ("weight", "10.5 KG", "10.5 LB", False),
    ("invoice_date", "13 Nov 2025", "2025-11-13", True), ("invoice_date", "13-Nov-25", "13/11/2025", True), ("invoice_date", "18-Feb-25", "2025年2月18日", True),
    ("invoice_date", "Nov 13, 2025", "13 November 2025", True), ("invoice_date", "13 Nov 2025", "14 Nov 2025", False), ("x", "", "", True),
    ("total", "N/A", "TBD", True), ("total", "", "0", False), ("weight", "10 KG", "10", True), ("invoice_date", "01/13/2025", "2025-01-13", True),
    ("invoice_date", "30 Feb 2025", "2025-03-02", False),
]


def test_field_equal(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, key string, a string, b string, want boolean")
    got = df.withColumn("got", v.field_equal(v.field_class(F.col("key")), F.col("a"), F.col("b")))
    assert [r for r in got.collect() if r["got"] != r["want"]] == []


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (v.parse_amount, "INV-12", -12.0), (v.parse_amount, "1.2.3", 1.2), (v.parse_amount, "--5", 0.0), (v.parse_amount, "", 0.0),
        (v.match_key, "答案/A发票.PDF", "a发票"), (v.match_key, "结果/A发票.json", "a发票"), (v.norm_invoice_no, " szx 7719 ab ", "SZX7719AB"),
        (t.export_name, "A.pdf", "A.json"), (t.json_part, 'so:\n```json\n{"is_target": true}\n```\nend', '{"is_target": true}'),
    ],
)
def test_one_value(spark, make, value, want):
    assert spark.createDataFrame([(value,)], "x string").select(make(F.col("x"))).first()[0] == want


def test_normal_text_and_dates_by_plain_rules(spark):
    """Blanks of all kinds, visible ASCII kept as it is, and every day number of each month."""
    def norm(x):
        for c in "－—–─":
            x = x.replace(c, "-")
        x = "".join(" " if c in v.BLANKS else c for c in x.replace("，", ","))
        return re.sub(" +", " ", re.sub(" *([-/]) *", r"\1", x)).strip(" ")

    rng = random.Random(3)
    made = ["".join(rng.choice("aZ0,./- \t\n\x0b\x85\xa0\u2003\u3000\ufeff－—，年é") for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["INV-001", "part/1"]
    got = spark.createDataFrame([(x,) for x in made], "x string").select("x", v.norm_text(F.col("x")).alias("n")).collect()
    assert [r.n for r in got] == [norm(x) for x in made]
    days = [(y, m, d) for y in (99, 100, 1900, 1999, 2000, 2024) for m in range(14) for d in range(33)]
    dates = spark.createDataFrame(days, "y int, m int, d int").select("y", "m", "d", v.iso_date(F.col("y"), F.col("m"), F.col("d")).alias("iso")).collect()

    def iso(y, m, d):
        try:
            return datetime.date(y, m, d).isoformat() if y >= 100 else None
        except ValueError:
            return None

    assert [r.iso for r in dates] == [iso(*x) for x in days]


def test_a_reply_is_parsed_once_a_profile(spark):
    """A reply was parsed again for each member that the profile asks for."""
    from ledgerlens.functions.requests import complete_reply

    out = spark.range(1).select(*[complete_reply(F.col("id").cast("string"), p).alias(p) for p in ("extract", "classify", "optimize")])
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("parse_json") <= 3
