"""The value rules as SQL functions of the session, each a SQL expression, so that queries in SQL text can use them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .values import AMOUNT_KEYS, BLANKS, DATE_PATTERN, MEASURE_PATTERN, MONTHS, TOLERANCE, WS



def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(x: str, name: str, body: str) -> str:
    """The body with x computed once under the name. A function used in another's body is computed for every row, as its
    arguments are, whatever branch it stands in; a body that is one text is computed where it is needed."""
    return f"get(transform(array({x}), {name} -> {body}), 0)"


def _norm(x: str) -> str:
    one = f"translate({x}, '，－—–─{BLANKS}', ',----{' ' * len(BLANKS)}')"
    one = f"trim(regexp_replace(regexp_replace({one}, ' *([-/]) *', '$1'), ' +', ' '))"
    return f"case when {x} rlike '[^!-~]' then {one} else {x} end"


def _date_text(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, ',', ' '), ' +', ' '))"


def _amount(x: str) -> str:
    digits = f"regexp_replace({x}, {_quoted(r'[^0-9.\-]+')}, '')"
    return rf"coalesce(try_cast(nullif(regexp_extract({digits}, {_quoted(r'^-?(\d+\.?\d*|\.\d+)')}, 0), '') as double), 0.0D)"


def _month(token: str) -> str:
    return f"nullif(cast(array_position(array({', '.join(repr(m) for m in MONTHS)}), substr(lower({token}), 1, 3)) as int), 0)"


def _year(y: str) -> str:
    return _let(y, "e", "case when e >= 100 then e when e < 80 then e + 2000 else e + 1900 end")


def _iso(y: str, m: str, d: str) -> str:
    last = "case when p.m in (4, 6, 9, 11) then 30 when p.m <> 2 then 31 when p.y % 4 = 0 and (p.y % 100 <> 0 or p.y % 400 = 0) then 29 else 28 end"
    text = "concat_ws('-', lpad(cast(p.y as string), 4, '0'), lpad(cast(p.m as string), 2, '0'), lpad(cast(p.d as string), 2, '0'))"
    return _let(f"named_struct('y', {y}, 'm', {m}, 'd', {d})", "p", f"case when p.y between 100 and 9999 and p.m between 1 and 12 and p.d >= 1 and p.d <= ({last}) then {text} end")


#: name: (parameters, type, body); a body may use functions before it.
FUNCTIONS = {
    "trim_ws": ("x string", "string", f"regexp_replace(x, {_quoted(rf'^{WS}+|{WS}+$')}, '')"),
    "norm_text": ("x string", "string", _norm("x")),
    "match_key": ("x string", "string", rf"lower(trim_ws(regexp_replace(regexp_replace(regexp_extract(x, {_quoted(r'[^/\\]*$')}, 0), {_quoted(r'(?i)\.json$')}, ''), {_quoted(r'(?i)\.pdf$')}, '')))"),
    "number_prefix": ("x string", "double", rf"try_cast(nullif(regexp_extract(x, {_quoted(r'^-?(\d+\.?\d*|\.\d+)')}, 0), '') as double)"),
    "parse_amount": ("x string", "double", _amount("x")),
    "amounts_match": ("a double, b double", "boolean", f"abs(a - b) < {TOLERANCE}D"),
    "measure_number": ("x string", "double", rf"try_cast(nullif(replace(regexp_extract(trim_ws(x), {_quoted(r'(?s)^(-?[\d,]*\.?\d+)\s*(.*)$')}, 1), ',', ''), '') as double)"),
    "measure_unit": ("x string", "string", rf"lower(regexp_replace(regexp_extract(trim_ws(x), {_quoted(r'(?s)^(-?[\d,]*\.?\d+)\s*(.*)$')}, 2), {_quoted(rf'{WS}+')}, ''))"),
    "measures_equal": ("a string, b string", "boolean", "coalesce(amounts_match(measure_number(a), measure_number(b)) and (measure_unit(a) = '' or measure_unit(b) = '' or measure_unit(a) = measure_unit(b)), false)"),
    "expand_year": ("y int", "int", "case when y >= 100 then y when y < 80 then y + 2000 else y + 1900 end"),
    "month_number": ("token string", "int", _month("token")),
    "iso_date": ("y int, m int, d int", "string", "case when y >= 100 and m between 1 and 12 and d between 1 and 31 then date_format(try_to_date(format_string('%04d-%02d-%02d', y, m, d), 'yyyy-MM-dd'), 'yyyy-MM-dd') end"),
    "date_text": ("x string", "string", _date_text("norm_text(x)")),
}


def _date(x: str) -> str:
    """The date of a text in one of five written forms; the first form that fits decides."""
    at = lambda p, i: f"try_cast(regexp_extract({x}, {_quoted(p)}, {i}) as int)"
    word = lambda p, i: _month(f"regexp_extract({x}, {_quoted(p)}, {i})")
    fits = lambda p: f"{x} rlike {_quoted(p)}"
    cjk, ymd = r"^(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日?$", r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"
    dmony, mondy = r"^(\d{1,2})[/\-. ]([A-Za-z]{3,9})[/\-. ](\d{2,4})$", r"^([A-Za-z]{3,9})[/\-. ](\d{1,2})[/\-. ](\d{2,4})$"
    dmy = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$"
    swap = f"{at(dmy, 2)} > 12 and {at(dmy, 1)} <= 12"
    forms = [
        (cjk, _iso(at(cjk, 1), at(cjk, 2), at(cjk, 3))), (ymd, _iso(at(ymd, 1), at(ymd, 2), at(ymd, 3))),
        (dmony, _iso(_year(at(dmony, 3)), word(dmony, 2), at(dmony, 1))), (mondy, _iso(_year(at(mondy, 3)), word(mondy, 1), at(mondy, 2))),
        (dmy, _iso(_year(at(dmy, 3)), f"if({swap}, {at(dmy, 1)}, {at(dmy, 2)})", f"if({swap}, {at(dmy, 2)}, {at(dmy, 1)})")),
    ]
    return "case " + " ".join(f"when {fits(p)} then {iso}" for p, iso in forms) + " end"


def _normal_date(x: str) -> str:
    return _let(_date_text(x), "t", _date("t"))


def _measures_equal(a: str, b: str) -> str:
    pattern, blank = _quoted(r"(?s)^(-?[\d,]*\.?\d+)\s*(.*)$"), _quoted(rf"{WS}+")
    trimmed = lambda x: f"regexp_replace({x}, {_quoted(rf'^{WS}+|{WS}+$')}, '')"
    number = lambda x: f"try_cast(nullif(replace(regexp_extract({trimmed(x)}, {pattern}, 1), ',', ''), '') as double)"
    unit = lambda x: f"lower(regexp_replace(regexp_extract({trimmed(x)}, {pattern}, 2), {blank}, ''))"
    both = f"named_struct('m', {number(a)}, 'n', {number(b)}, 'u', {unit(a)}, 'v', {unit(b)})"
    return f"coalesce({_let(both, 'q', f"abs(q.m - q.n) < {TOLERANCE}D and (q.u = '' or q.v = '' or q.u = q.v)")}, false)"


FUNCTIONS |= {
    "date_of_text": ("x string", "string", _date("x")),
    "parse_date": ("x string", "string", _normal_date(_norm("x"))),
    "field_class": ("k string", "string", f"case when k in {AMOUNT_KEYS} then 'amount' when k in ('weight', 'volume') or k rlike {_quoted(MEASURE_PATTERN)} then 'measure' when k rlike {_quoted(DATE_PATTERN)} then 'date' else 'text' end"),
    "normal_equal": ("kind string, a string, b string", "boolean", f"""case when lower(a) = lower(b) then true when a = '' or b = '' then false
        when kind = 'amount' then abs({_amount("a")} - {_amount("b")}) < {TOLERANCE}D when kind = 'measure' then {_measures_equal("a", "b")}
        when kind = 'date' then coalesce({_normal_date("a")} = {_normal_date("b")}, false) else false end"""),
    "field_equal": ("k string, answer string, actual string", "boolean", "normal_equal(field_class(k), norm_text(answer), norm_text(actual))"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session by name, as temporary functions with a SQL body; they replace those of
    an earlier call. Catalyst inlines them, so a query that uses them runs as its expressions would, without Python."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
