"""Oracle SQL fragments: the value rules as DuckDB expressions and the report as CTEs."""

from __future__ import annotations

from ledgerlens.operators.templates import FIELDS
from . import bridge as b

W = r"[\s\p{Z}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def norm(x: str) -> str:
    for p, put in (("，", ","), ("[－—–─]", "-"), (f"{W}*-{W}*", "-"), (f"{W}+", " "), (f"{W}*/{W}*", "/")):
        x = f"regexp_replace({x}, '{p}', '{put}', 'g')"
    return trim(x)


def match_key(x: str) -> str:
    x = f"regexp_extract({x}, '[^/\\\\]*$')"
    for p in (r"\.json$", r"\.pdf$"):
        x = f"regexp_replace({x}, '{p}', '', 'i')"
    return f"lower({trim(x)})"


def amount(x: str) -> str:
    return rf"coalesce(try_cast(nullif(regexp_extract(regexp_replace({x}, '[^0-9.\-]', '', 'g'), '^-?(\d+\.?\d*|\.\d+)'), '') AS DOUBLE), 0.0)"


def measure(x: str, part: int) -> str:
    got = rf"regexp_extract({trim(x)}, '(?s)^(-?[\d,]*\.?\d+)\s*(.*)$', {part})"
    return f"try_cast(nullif(replace({got}, ',', ''), '') AS DOUBLE)" if part == 1 else f"lower(regexp_replace({got}, '{W}+', '', 'g'))"


def measures_equal(a: str, c: str) -> str:
    units = f"({measure(a, 2)} = '' OR {measure(c, 2)} = '' OR {measure(a, 2)} = {measure(c, 2)})"
    return f"coalesce(abs({measure(a, 1)} - {measure(c, 1)}) < 0.005 AND {units}, false)"


def date(x: str) -> str:
    """yyyy-mm-dd of a normalised text, forms tried in order."""
    t = trim(f"regexp_replace(replace({x}, ',', ' '), '{W}+', ' ', 'g')")
    g = lambda p, i: f"regexp_extract({t}, '{p}', {i})"
    n = lambda p, i: f"try_cast({g(p, i)} AS INT)"
    year = lambda y: f"(CASE WHEN {y} >= 100 THEN {y} WHEN {y} < 80 THEN {y} + 2000 ELSE {y} + 1900 END)"
    mon = lambda m: f"nullif(strpos('jan feb mar apr may jun jul aug sep oct nov dec', substr(lower({m}), 1, 3)) // 4 + 1, CASE WHEN strpos('jan feb mar apr may jun jul aug sep oct nov dec', substr(lower({m}), 1, 3)) = 0 THEN 1 END)"
    iso = lambda y, m, d: f"CASE WHEN {y} >= 100 THEN strftime(try_strptime(printf('%04d-%02d-%02d', {y}, {m}, {d}), '%Y-%m-%d'), '%Y-%m-%d') END"
    cjk = r"^(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日?$"
    ymd = r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"
    dmy_m = r"^(\d{1,2})[/\-. ]([A-Za-z]{3,9})[/\-. ](\d{2,4})$"
    mdy_m = r"^([A-Za-z]{3,9})[/\-. ](\d{1,2})[/\-. ](\d{2,4})$"
    dmy = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$"
    swap = f"({n(dmy, 2)} > 12 AND {n(dmy, 1)} <= 12)"
    is_ = lambda p: f"regexp_matches({t}, '{p}')"
    return f"""CASE WHEN {is_(cjk)} THEN {iso(n(cjk, 1), n(cjk, 2), n(cjk, 3))}
      WHEN {is_(ymd)} THEN {iso(n(ymd, 1), n(ymd, 2), n(ymd, 3))}
      WHEN {is_(dmy_m)} THEN {iso(year(n(dmy_m, 3)), mon(g(dmy_m, 2)), n(dmy_m, 1))}
      WHEN {is_(mdy_m)} THEN {iso(year(n(mdy_m, 3)), mon(g(mdy_m, 1)), n(mdy_m, 2))}
      WHEN {is_(dmy)} THEN {iso(year(n(dmy, 3)), f"CASE WHEN {swap} THEN {n(dmy, 1)} ELSE {n(dmy, 2)} END", f"CASE WHEN {swap} THEN {n(dmy, 2)} ELSE {n(dmy, 1)} END")} END"""


def equal(key: str, a: str, c: str) -> str:
    """a and c are columns that hold normalised texts."""
    return f"""CASE WHEN lower({a}) = lower({c}) THEN true WHEN {a} = '' OR {c} = '' THEN false
      WHEN {key} IN ('total', 'charges_in_hkd', 'total_hkd') THEN abs({amount(a)} - {amount(c)}) < 0.005
      WHEN {key} IN ('weight', 'volume') THEN {measures_equal(a, c)}
      WHEN {key} ILIKE '%date%' THEN coalesce(({date(a)}) = ({date(c)}), false) ELSE false END"""


def duck(x: str) -> str:
    return x.replace(" as string)", " as varchar)")


def _cols(values: dict[str, str]) -> str:
    return ", ".join(f"{duck(e)} AS {k}" for k, e in values.items())


def _fields(scope: str) -> str:
    at: dict[str, int] = {}
    rows = []
    for f in FIELDS:
        if f[1] == scope:
            at[f[0]] = at.get(f[0], 0) + 1
            rows.append(f"('{f[0]}', {at[f[0]]}, '{f[3]}')")
    return f"(VALUES {', '.join(rows)}) AS f(of_template, field_pos, field_key)"


TERMS, COLUMNS = _fields("header"), _fields("sublist")
#: What a document calls the columns of its rows, against what its template asks for.
NAMED = {"description": "description", "charges_in_hkd": "charges_in_hkd", "air_waybill_number": "description", "total": "charges_in_hkd"}


def pick_line(alias: str) -> str:
    return "CASE " + " ".join(f"WHEN f.field_key = '{k}' AND {'' if k not in b.ANSWER_LINE else 'NOT '}waybill THEN {alias}.{c}" for k, c in NAMED.items()) + " ELSE '' END"


def pick(alias: str, keys: dict[str, str]) -> str:
    return "CASE f.field_key " + " ".join(f"WHEN '{k}' THEN {alias}.{k}" for k in keys) + " ELSE '' END"


DOCS = f"""
a_docs AS (SELECT *, {match_key("file_name")} AS match_key FROM (SELECT c_custkey AS doc_pos, {_cols(b.ANSWER_DOC)} FROM customer)),
r_docs AS (SELECT *, {match_key("file_name")} AS match_key FROM (SELECT c_custkey AS doc_pos, {_cols(b.RESULT_DOC)} FROM customer WHERE {b.RESULT_KEEP})),
held AS (SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
pairs0 AS (SELECT a.match_key, a.doc_pos AS a_doc, r.doc_pos AS r_doc, a.file_name, a.doc_pos % 5 < 3 AS waybill, o_custkey IS NOT NULL AS lines FROM a_docs a JOIN
  (SELECT * FROM r_docs QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY doc_pos) = 1) r USING (match_key) LEFT JOIN held ON o_custkey = a.doc_pos),
pairs AS (SELECT *, CASE WHEN a_doc % 25 = 8 THEN 'old' WHEN a_doc % 5 = 1 THEN 'air_waybill_dhl' WHEN a_doc % 5 = 3 OR a_doc % 5 = 4 AND lines THEN 'freight_invoice' ELSE 'air_waybill' END AS template_id,
  CASE WHEN a_doc % 25 = 8 THEN 'air_waybill' WHEN a_doc % 5 = 1 THEN 'air_waybill_dhl' WHEN a_doc % 5 = 3 OR a_doc % 5 = 4 AND lines THEN 'freight_invoice' ELSE 'air_waybill' END AS fields_from FROM pairs0)"""

INVOICES = (
    DOCS
    + f""",
a_inv AS (SELECT a_doc, o_orderkey AS pos, {_cols(b.ANSWER_INV)} FROM orders JOIN pairs ON o_custkey = a_doc),
r_inv0 AS (SELECT a_doc, o_orderkey AS pos, {_cols(b.RESULT_INV)} FROM orders JOIN pairs ON o_custkey = r_doc WHERE {b.RESULT_INV_KEEP}),
r_inv AS (SELECT * FROM r_inv0 UNION ALL SELECT * REPLACE (pos + 1000000000 AS pos, 'ADDED000001' AS invoice_no) FROM r_inv0 WHERE pos % 29 = 0),
ak AS (SELECT a_doc, pos, lower({norm("invoice_no")}) AS nk FROM a_inv),
rk AS (SELECT a_doc, pos, lower({norm("invoice_no")}) AS nk FROM r_inv),
a1 AS (SELECT *, row_number() OVER (PARTITION BY a_doc, nk ORDER BY pos) AS k FROM ak),
r1 AS (SELECT *, row_number() OVER (PARTITION BY a_doc, nk ORDER BY pos) AS k FROM rk),
m1 AS (SELECT a1.a_doc, a1.pos AS a_pos, r1.pos AS r_pos FROM a1 JOIN r1 ON a1.a_doc = r1.a_doc AND a1.nk = r1.nk AND a1.k = r1.k AND a1.nk <> ''),
a2 AS (SELECT a_doc, pos, row_number() OVER (PARTITION BY a_doc ORDER BY pos) AS j FROM ak WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.a_doc = ak.a_doc AND m1.a_pos = ak.pos)),
r2 AS (SELECT a_doc, pos, row_number() OVER (PARTITION BY a_doc ORDER BY pos) AS j FROM rk WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.a_doc = rk.a_doc AND m1.r_pos = rk.pos)),
al AS (SELECT * FROM m1 UNION ALL SELECT coalesce(a2.a_doc, r2.a_doc), a2.pos, r2.pos FROM a2 FULL JOIN r2 ON a2.a_doc = r2.a_doc AND a2.j = r2.j),
inv AS (SELECT *, row_number() OVER (PARTITION BY a_doc ORDER BY a_pos IS NULL, a_pos, r_pos) AS inv_idx FROM al),
hcells0 AS (SELECT template_id, inv.a_doc, inv_idx, field_pos, field_key, {pick("a", b.ANSWER_INV)} AS expected, {pick("r", b.RESULT_INV)} AS actual, r_pos IS NULL AS gone
  FROM inv JOIN a_inv a ON a.a_doc = inv.a_doc AND a.pos = a_pos LEFT JOIN r_inv r ON r.a_doc = inv.a_doc AND r.pos = r_pos JOIN pairs ON pairs.a_doc = inv.a_doc JOIN {TERMS} ON of_template = fields_from),
hnorm AS (SELECT *, {norm("expected")} AS ne, {norm("coalesce(actual, '')")} AS na FROM hcells0),
hcells AS (SELECT template_id, a_doc, inv_idx, field_pos, field_key, expected, CASE WHEN gone THEN '' ELSE actual END AS actual, NOT gone AND ({equal("field_key", "ne", "na")}) AS equal, gone FROM hnorm)"""
)

ROWS = (
    INVOICES
    + f""",
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {b.LINE_ORDER}) AS row_pos FROM lineitem),
rlines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {b.LINE_ORDER}) AS row_pos FROM lineitem WHERE {b.RESULT_LINE_KEEP}),
a_rows AS (SELECT inv.a_doc, inv_idx, row_pos, r_pos IS NULL AS gone, {_cols(b.ANSWER_LINE)} FROM lines JOIN inv ON l_orderkey = a_pos),
r_rows AS (SELECT inv.a_doc, inv_idx, row_pos, a_pos IS NULL AS extra, {_cols(b.RESULT_LINE)} FROM rlines JOIN inv ON l_orderkey = r_pos),
ark AS (SELECT a_doc, inv_idx, row_pos AS pos, CASE WHEN a_doc % 25 = 8 THEN '' ELSE lower({norm("description")}) END AS nk FROM a_rows WHERE NOT gone),
rrk AS (SELECT a_doc, inv_idx, row_pos AS pos, CASE WHEN a_doc % 25 = 8 THEN '' ELSE lower({norm("description")}) END AS nk FROM r_rows WHERE NOT extra),
ar1 AS (SELECT *, row_number() OVER (PARTITION BY a_doc, inv_idx, nk ORDER BY pos) AS k FROM ark),
rr1 AS (SELECT *, row_number() OVER (PARTITION BY a_doc, inv_idx, nk ORDER BY pos) AS k FROM rrk),
rm1 AS (SELECT a.a_doc, a.inv_idx, a.pos AS a_row, r.pos AS r_row FROM ar1 a JOIN rr1 r ON a.a_doc = r.a_doc AND a.inv_idx = r.inv_idx AND a.nk = r.nk AND a.k = r.k AND a.nk <> ''),
ar2 AS (SELECT *, row_number() OVER (PARTITION BY a_doc, inv_idx ORDER BY pos) AS j FROM ark WHERE NOT EXISTS (SELECT 1 FROM rm1 WHERE rm1.a_doc = ark.a_doc AND rm1.inv_idx = ark.inv_idx AND rm1.a_row = ark.pos)),
rr2 AS (SELECT *, row_number() OVER (PARTITION BY a_doc, inv_idx ORDER BY pos) AS j FROM rrk WHERE NOT EXISTS (SELECT 1 FROM rm1 WHERE rm1.a_doc = rrk.a_doc AND rm1.inv_idx = rrk.inv_idx AND rm1.r_row = rrk.pos)),
rowal AS (SELECT * FROM rm1 UNION ALL SELECT a.a_doc, a.inv_idx, a.pos, r.pos FROM ar2 a LEFT JOIN rr2 r ON a.a_doc = r.a_doc AND a.inv_idx = r.inv_idx AND a.j = r.j),
scells0 AS (SELECT template_id, x.a_doc, x.inv_idx, a_row AS row_idx, field_pos, field_key, {pick_line("a")} AS expected, {pick_line("r")} AS actual, r_row IS NULL AS gone
  FROM rowal x JOIN a_rows a ON a.a_doc = x.a_doc AND a.inv_idx = x.inv_idx AND a.row_pos = a_row LEFT JOIN r_rows r ON r.a_doc = x.a_doc AND r.inv_idx = x.inv_idx AND r.row_pos = r_row JOIN pairs ON pairs.a_doc = x.a_doc JOIN {COLUMNS} ON of_template = fields_from
  UNION ALL SELECT template_id, a.a_doc, a.inv_idx, a.row_pos, field_pos, field_key, {pick_line("a")}, '', true FROM a_rows a JOIN pairs ON pairs.a_doc = a.a_doc JOIN {COLUMNS} ON of_template = fields_from WHERE a.gone),
snorm AS (SELECT *, {norm("expected")} AS ne, {norm("coalesce(actual, '')")} AS na FROM scells0),
scells AS (SELECT template_id, a_doc, inv_idx, row_idx, field_pos, field_key, expected, CASE WHEN gone THEN '' ELSE actual END AS actual, NOT gone AND ({equal("field_key", "ne", "na")}) AS equal, gone FROM snorm),
invrows AS (SELECT inv.a_doc, inv.inv_idx, a_pos, r_pos, coalesce(na, 0) AS answer_rows, coalesce(nm, 0) AS matched_rows, coalesce(na, 0) - coalesce(nm, 0) AS missing_rows, coalesce(nr, 0) - coalesce(nm, 0) AS extra_rows FROM inv
  LEFT JOIN (SELECT a_doc, inv_idx, count(*) AS na FROM a_rows GROUP BY ALL) USING (a_doc, inv_idx)
  LEFT JOIN (SELECT a_doc, inv_idx, count(r_row) AS nm FROM rowal GROUP BY ALL) USING (a_doc, inv_idx)
  LEFT JOIN (SELECT a_doc, inv_idx, count(*) AS nr FROM r_rows GROUP BY ALL) USING (a_doc, inv_idx)),
errors AS (SELECT a_doc, inv_idx, NULL AS row_idx, 'field_mismatch' AS kind, field_key, expected, actual FROM hcells WHERE NOT equal AND NOT gone
  UNION ALL SELECT a_doc, inv_idx, row_idx, 'field_mismatch', field_key, expected, actual FROM scells WHERE NOT equal AND NOT gone
  UNION ALL SELECT x.a_doc, x.inv_idx, a_row, 'missing_row', CASE fields_from WHEN 'freight_invoice' THEN 'description' ELSE 'air_waybill_number' END, CASE WHEN template_id = 'old' THEN '' ELSE a.description END, '' FROM rowal x JOIN pairs ON pairs.a_doc = x.a_doc JOIN a_rows a ON a.a_doc = x.a_doc AND a.inv_idx = x.inv_idx AND a.row_pos = a_row WHERE r_row IS NULL
  UNION ALL SELECT a_doc, inv_idx, NULL, 'extra_row', CASE fields_from WHEN 'freight_invoice' THEN 'description' ELSE 'air_waybill_number' END, '', concat('多出 ', extra_rows, ' 行') FROM invrows JOIN pairs USING (a_doc) WHERE a_pos IS NOT NULL AND r_pos IS NOT NULL AND extra_rows > 0
  UNION ALL SELECT inv.a_doc, inv_idx, NULL, 'missing_invoice', 'invoice_no', a.invoice_no, '' FROM inv JOIN a_inv a ON a.a_doc = inv.a_doc AND a.pos = a_pos WHERE r_pos IS NULL
  UNION ALL SELECT inv.a_doc, inv_idx, NULL, 'extra_invoice', 'invoice_no', '', r.invoice_no FROM inv JOIN r_inv r ON r.a_doc = inv.a_doc AND r.pos = r_pos WHERE a_pos IS NULL)"""
)
