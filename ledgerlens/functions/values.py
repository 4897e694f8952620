"""Tolerant value functions as Column expressions: text, amounts, measures, dates, equality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed values that results depend on.
AMOUNT_KEYS = ("total", "charges_in_hkd", "total_hkd")
MEASURE_PATTERN = r"(?i)^(gross_|net_|chargeable_)?(weight|volume|wt|vol)(_|$)"
DATE_PATTERN = r"(?i)date"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
TOLERANCE = 0.005

#: White space of Unicode, and the byte order mark.
WS = r"[\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


#: The same but for the blank itself, as characters.
BLANKS = "\t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def norm_text(c: Column) -> Column:
    """Comma and dash forms unified, blanks round dashes and slashes dropped, others collapsed. A text of visible
    ASCII stays as it is."""
    one = F.translate(c, "，－—–─" + BLANKS, ",----" + " " * len(BLANKS))
    one = F.regexp_replace(F.regexp_replace(one, " *([-/]) *", "$1"), " +", " ")
    return F.when(c.rlike("[^!-~]"), F.trim(one)).otherwise(c)


def match_key(file_name: Column) -> Column:
    """Last path part without .json, then without .pdf, trimmed, lower case."""
    base = F.regexp_extract(file_name, r"[^/\\]*$", 0)
    for suffix in (r"(?i)\.json$", r"(?i)\.pdf$"):
        base = F.regexp_replace(base, suffix, "")
    return F.lower(trim_ws(base))


def norm_invoice_no(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, rf"{WS}+", ""))


def freight_no(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, rf"(?i)^INVOICE{WS}+", ""))


def number_prefix(c: Column) -> Column:
    """The longest numeric prefix as double, null if there is none."""
    return F.regexp_extract(c, r"^-?(\d+\.?\d*|\.\d+)", 0).try_cast("double")


def parse_amount(c: Column) -> Column:
    """Digits, points and dashes of the text read as a number; 0 where that fails."""
    return F.coalesce(number_prefix(F.regexp_replace(c, r"[^0-9.\-]+", "")), F.lit(0.0))


def amounts_match(a: Column, b: Column) -> Column:
    return F.abs(a - b) < F.lit(TOLERANCE)


def measure_number(c: Column) -> Column:
    text = trim_ws(c)
    return F.replace(F.regexp_extract(text, r"(?s)^(-?[\d,]*\.?\d+)\s*(.*)$", 1), F.lit(","), F.lit("")).try_cast("double")


def measure_unit(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(trim_ws(c), r"(?s)^(-?[\d,]*\.?\d+)\s*(.*)$", 2), rf"{WS}+", ""))


def expand_year(y: Column) -> Column:
    return F.when(y >= 100, y).when(y < 80, y + 2000).otherwise(y + 1900)


def month_number(token: Column) -> Column:
    """1 to 12 by the first three letters of a month's name, else null."""
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.lower(token), 1, 3)).cast("int")
    return F.when(at > 0, at)


def iso_date(y: Column, m: Column, d: Column) -> Column:
    """yyyy-MM-dd if it is a date of the calendar from year 100 on, else null."""

    def build(p: Column) -> Column:
        text = F.concat_ws("-", *[F.lpad(p[k].cast("string"), n, "0") for k, n in (("y", 4), ("m", 2), ("d", 2))])
        leap = (p["y"] % 4 == 0) & ((p["y"] % 100 != 0) | (p["y"] % 400 == 0))
        last = F.when(p["m"].isin(4, 6, 9, 11), 30).when(p["m"] != 2, 31).when(leap, 29).otherwise(28)
        return F.when(p["y"].between(100, 9999) & p["m"].between(1, 12) & (p["d"] >= 1) & (p["d"] <= last), text)

    return let(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), build)


def parse_date(c: Column) -> Column:
    """Calendar date in five written forms, as yyyy-MM-dd; the first form that fits decides."""
    return normal_date(norm_text(c))


def normal_date(c: Column) -> Column:
    """The same of a text that norm_text has been through."""
    return let(F.trim(F.regexp_replace(F.translate(c, ",", " "), " +", " ")), _date_of)


def _date_of(text: Column) -> Column:
    def parts(pattern: str) -> tuple[Column, list[Column]]:
        return text.rlike(pattern), [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]

    number = lambda x: x.try_cast("int")
    cjk, (a1, a2, a3) = parts(r"^(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日?$")
    ymd, (b1, b2, b3) = parts(r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$")
    dmony, (c1, c2, c3) = parts(r"^(\d{1,2})[/\-. ]([A-Za-z]{3,9})[/\-. ](\d{2,4})$")
    mondy, (d1, d2, d3) = parts(r"^([A-Za-z]{3,9})[/\-. ](\d{1,2})[/\-. ](\d{2,4})$")
    dmy, (e1, e2, e3) = parts(r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$")
    swap = (number(e2) > 12) & (number(e1) <= 12)
    return (
        F.when(cjk, iso_date(number(a1), number(a2), number(a3)))
        .when(ymd, iso_date(number(b1), number(b2), number(b3)))
        .when(dmony, iso_date(expand_year(number(c3)), month_number(c2), number(c1)))
        .when(mondy, iso_date(expand_year(number(d3)), month_number(d1), number(d2)))
        .when(dmy, iso_date(expand_year(number(e3)), F.when(swap, number(e1)).otherwise(number(e2)), F.when(swap, number(e2)).otherwise(number(e1))))
    )


def field_class(key: Column) -> Column:
    return (
        F.when(key.isin(*AMOUNT_KEYS), "amount")
        .when(key.isin("weight", "volume") | key.rlike(MEASURE_PATTERN), "measure")
        .when(key.rlike(DATE_PATTERN), "date")
        .otherwise("text")
    )


def field_equal(kind: Column, answer: Column, actual: Column) -> Column:
    """Whether two values of a field of that class count as equal; two empty ones do."""
    normal = let(F.struct(norm_text(answer).alias("a"), norm_text(actual).alias("b")), lambda v: _equal(kind, v["a"], v["b"]))
    plain = answer.rlike("^[!-~]+$") & actual.rlike("^[!-~]+$")  # norm_text leaves both as they are
    amounts = amounts_match(parse_amount(answer), parse_amount(actual))
    return F.when(F.lower(answer) == F.lower(actual), True).when((kind == "amount") & plain, amounts).otherwise(normal)


def _equal(kind: Column, a: Column, b: Column) -> Column:
    part = lambda c: F.struct(measure_number(c).alias("n"), measure_unit(c).alias("u"))
    units = lambda v: (v["a"]["u"] == "") | (v["b"]["u"] == "") | (v["a"]["u"] == v["b"]["u"])
    measures = let(F.struct(part(a).alias("a"), part(b).alias("b")), lambda v: amounts_match(v["a"]["n"], v["b"]["n"]) & units(v))
    return (
        F.when(F.lower(a) == F.lower(b), True)
        .when((a == "") | (b == ""), False)
        .when(kind == "amount", amounts_match(parse_amount(a), parse_amount(b)))
        .when(kind == "measure", F.coalesce(measures, F.lit(False)))
        .when(kind == "date", F.coalesce(normal_date(a) == normal_date(b), F.lit(False)))
        .otherwise(False)
    )
