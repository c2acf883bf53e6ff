"""Scalar functions over derived columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bank, cells, evidence, labels, periods, text
from .base import C, Catalogue

cat = Catalogue()
QUERIES, ORACLE_SQL = cat.queries, cat.oracles
LINE = "l_orderkey * 8 + l_linenumber"
N = "(l_orderkey * 31 + l_linenumber * 7 + l_partkey)"

AMOUNT = f"CASE {N} % 9 WHEN 0 THEN concat(CAST({N} % 9 + 1 AS STRING), '.', lpad(CAST({N} % 1000 AS STRING), 3, '0'), ',50 EUR') WHEN 1 THEN concat('-', CAST({N} % 5000 AS STRING), ',25') WHEN 2 THEN concat('(', CAST({N} % 700 AS STRING), '.75)') WHEN 3 THEN concat(CAST({N} % 9 + 1 AS STRING), '.250.000') WHEN 4 THEN 'n/a' WHEN 5 THEN concat(CAST({N} % 90 AS STRING), ' €') WHEN 6 THEN '' WHEN 7 THEN concat(CAST({N} % 12 + 1 AS STRING), '.500') ELSE CAST({N} % 100000 AS STRING) END"
DUCK_CLEAN = "trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def duck_amount(x: str) -> str:
    c = f"replace(trim(regexp_replace({DUCK_CLEAN.format(x=x)}, '(?i)(euro|eur|€)', '', 'g')), ' ', '')"
    s = f"trim({c}, '()-+')"
    plain = f"CASE WHEN contains({s}, ',') AND contains({s}, '.') THEN replace(replace({s}, '.', ''), ',', '.') WHEN contains({s}, ',') THEN replace({s}, ',', '.') WHEN length({s}) - length(replace({s}, '.', '')) > 1 OR regexp_matches({s}, '^[^.]*\\.[^.]{{3}}$') THEN replace({s}, '.', '') ELSE {s} END"
    value = f"CASE WHEN regexp_matches({plain}, '^[0-9]*\\.?[0-9]+$') THEN TRY_CAST({plain} AS DECIMAL(18,2)) END"
    return f"CASE WHEN starts_with({c}, '-') OR starts_with({c}, '(') THEN -({value}) ELSE {value} END"


cat.scalar("f09_clean_cell", "lineitem", {"k": LINE, "raw": f"concat('  a', CAST({N} % 50 AS STRING), CASE {N} % 3 WHEN 0 THEN '   b ' WHEN 1 THEN ' ' ELSE '' END)"}, {"clean": lambda: cells.clean_cell(C("raw"))}, {"clean": DUCK_CLEAN.format(x="raw")})
cat.scalar(
    "f10_split_street", "lineitem",
    {"k": LINE, "raw": f"CASE {N} % 4 WHEN 0 THEN concat('Lindenallee ', CAST({N} % 120 + 1 AS STRING)) WHEN 1 THEN concat('Am Tor, ', CAST({N} % 50 + 1 AS STRING), ' b') WHEN 2 THEN 'Marktplatz' ELSE concat('Ringweg ', CAST({N} % 90 + 1 AS STRING), '-', CAST({N} % 90 + 5 AS STRING)) END"},
    {"street": lambda: cells.split_street(C("raw"))["street"], "number": lambda: cells.split_street(C("raw"))["number"], "confidence": lambda: cells.split_street(C("raw"))["confidence"]},
    {"street": "CASE WHEN regexp_matches(raw, '[0-9]') THEN trim(regexp_extract(raw, '^([^0-9]+)', 1), ' ,') ELSE raw END", "number": "replace(regexp_extract(raw, '([0-9].*)$', 1), ' ', '')", "confidence": "CASE WHEN regexp_matches(raw, '[0-9]') THEN 0.95 ELSE 0.6 END::DOUBLE"},
)
cat.scalar(
    "f12_normalize_email", "customer", {"k": "c_custkey", "raw": "CASE c_custkey % 3 WHEN 0 THEN concat(' ', c_name, '@Mail.Example ') WHEN 1 THEN concat('Person', CAST(c_custkey AS STRING), '@HAUS.example') ELSE c_name END"},
    {"value": lambda: cells.normalize_email(C("raw"))["value"], "reason": lambda: cells.normalize_email(C("raw"))["reason"]},
    {"value": "lower(trim(raw))", "reason": "CASE WHEN NOT regexp_matches(lower(trim(raw)), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'unparseable_email' END"},
)
cat.scalar("f14_parse_amount", "lineitem", {"k": LINE, "raw": AMOUNT}, {"value": lambda: cells.parse_amount(C("raw"))["value"], "reason": lambda: cells.parse_amount(C("raw"))["reason"]}, {"value": f"({duck_amount('raw')})", "reason": f"CASE WHEN raw = '' THEN 'empty' WHEN ({duck_amount('raw')}) IS NULL THEN 'unparseable_amount' END"})
cat.scalar("s05_cell_text", "lineitem", {"k": LINE, "q": "l_quantity", "t": "l_tax", "d": "CAST(l_shipdate AS DATE)", "b": "l_quantity > 25"}, {"q": lambda: cells.cell_text(C("q"), "double"), "d": lambda: cells.cell_text(C("d"), "date"), "b": lambda: cells.cell_text(C("b"), "boolean"), "t": lambda: cells.cell_text(C("t"), "double")}, {"q": "CASE WHEN q = floor(q) THEN CAST(CAST(q AS BIGINT) AS VARCHAR) ELSE replace(CAST(q AS VARCHAR), '.', ',') END", "d": "strftime(d, '%d.%m.%Y')", "b": "CASE WHEN b THEN 'ja' ELSE 'nein' END", "t": "CASE WHEN t = floor(t) THEN CAST(CAST(t AS BIGINT) AS VARCHAR) ELSE replace(CAST(t AS VARCHAR), '.', ',') END"})

# ---- text
SHORT = "substr(text, 1, 400)"
DUCK_TR = "translate(replace(replace(replace(replace(replace(replace(replace({x}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss'), '" + text.MARKED + "', '" + text.PLAIN + "')"
DOC = {"k": "doc_id", "x": "text"}
cat.scalar("f30_transliterate", "documents", DOC, {"y": lambda: F.sha2(text.transliterate(C("x")), 256)}, {"y": f"sha256({DUCK_TR.format(x='x')})"})
cat.scalar("f27_norm_name", "documents", DOC, {"y": lambda: F.sha2(text.norm_name(C("x")), 256)}, {"y": f"sha256(trim(regexp_replace(regexp_replace(lower({DUCK_TR.format(x='x')}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')))"})
cat.scalar("f28_norm_header", "documents", DOC, {"y": lambda: F.sha2(text.norm_header(C("x")), 256)}, {"y": "sha256(regexp_replace(translate(replace(lower(x), 'ß', 'ss'), 'äöü" + text.MARKED + "', 'aou" + text.PLAIN + "'), '[^a-z0-9]', '', 'g'))"})
DUCK_NORM = "trim(regexp_replace(replace(replace(replace(replace(translate(lower({x}), 'éèáà–—‐‑\u00a0', 'eeaa---- '), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '\\s+', ' ', 'g'))"
cat.scalar("f50_normalize_text", "documents", DOC, {"y": lambda: F.sha2(text.normalize_text(C("x")), 256)}, {"y": f"sha256({DUCK_NORM.format(x='x')})"})
STREETS = "CASE c_custkey % 5 WHEN 0 THEN 'Karl-Marx-Straße' WHEN 1 THEN 'Lange  Str.' WHEN 2 THEN 'Bergstrasse' WHEN 3 THEN 'Am Markt' ELSE 'Grüner Weg' END"
cat.scalar("f51_normalize_street", "customer", {"k": "c_custkey", "x": STREETS}, {"y": lambda: text.normalize_street(C("x"))}, {"y": "CASE k % 5 WHEN 0 THEN 'karl marxstr' WHEN 1 THEN 'langestr' WHEN 2 THEN 'bergstr' WHEN 3 THEN 'am markt' ELSE 'gruener weg' END"})
cat.scalar("f54_normalize_city", "customer", {"k": "c_custkey", "x": "CASE c_custkey % 4 WHEN 0 THEN 'Frankfurt am Main' WHEN 1 THEN 'Mühlheim an der Ruhr' WHEN 2 THEN 'Baden-Baden' ELSE 'Köln' END"}, {"y": lambda: text.normalize_city(C("x"))}, {"y": "CASE k % 4 WHEN 0 THEN 'frankfurt main' WHEN 1 THEN 'muehlheim ruhr' WHEN 2 THEN 'baden baden' ELSE 'koeln' END"})
cat.scalar("f58_normalize_number", "part", {"k": "p_partkey", "x": "concat(' VS-', CAST(p_partkey AS STRING), ' / ', p_brand)"}, {"y": lambda: text.normalize_number(C("x"))}, {"y": f"regexp_replace({DUCK_NORM.format(x='x')}, '[^a-z0-9]', '', 'g')"})
cat.scalar("f31_clean_text", "part", {"k": "p_partkey", "x": "concat('..', p_name, ' : ', p_type, '?.')"}, {"y": lambda: text.clean_text(C("x"))}, {"y": "trim(trim(trim(regexp_replace(regexp_replace(x, '[\\\\/:*?\"<>|]', '', 'g'), '\\s+', ' ', 'g')), '.'))"})
cat.scalar("f72_search_name", "customer", {"k": "c_custkey", "kind": "CASE c_custkey % 2 WHEN 0 THEN 'person' ELSE 'company' END", "first": "concat('Jörg ', CAST(c_custkey AS STRING))", "last": "'Weiß'", "company": "concat(c_name, '  GmbH')"}, {"y": lambda: text.search_name(C("kind"), C("first"), C("last"), C("company"))}, {"y": f"upper(regexp_replace({DUCK_TR.format(x='CASE k % 2 WHEN 0 THEN concat(last, chr(32), first) ELSE company END')}, '\\s+', ' ', 'g'))"})
cat.scalar("f64_umlaut_variants", "customer", {"k": "c_custkey", "x": "CASE c_custkey % 4 WHEN 0 THEN 'mueller' WHEN 1 THEN 'straße' WHEN 2 THEN 'aeoeue' ELSE 'haus' END"}, {"y": lambda: F.array_join(text.umlaut_variants(C("x")), "|")}, {"y": "CASE k % 4 WHEN 0 THEN 'mueller|müller' WHEN 1 THEN 'strasse|straße' WHEN 2 THEN 'aeoeue|aeoeü|aeöue|äoeue' ELSE 'haus' END"})
cat.scalar("f65_fulltext", "documents", DOC, {"hit": lambda: text.contains_all(F.split(F.lower(C("x")), "[^a-zà-ÿ]+"), F.array(F.array(F.lit("the"), F.lit("der")), F.array(F.lit("and"), F.lit("und"))))}, {"hit": "len(list_intersect(regexp_split_to_array(lower(x), '[^a-zà-ÿ]+'), ['the', 'der'])) > 0 AND len(list_intersect(regexp_split_to_array(lower(x), '[^a-zà-ÿ]+'), ['and', 'und'])) > 0"})
cat.scalar("f66_snippet", "documents", DOC, {"y": lambda: F.sha2(text.snippet(C("x"), ["zwei", "that", "que"]), 256)}, {"y": "sha256((SELECT CASE WHEN p IS NULL THEN replace(substr(x, 1, 140), chr(10), ' ') ELSE concat(CASE WHEN p > 71 THEN '…' ELSE '' END, replace(substr(x, greatest(1, p - 70), least(length(x), p - 1 + 70) - greatest(0, p - 71)), chr(10), ' '), CASE WHEN p - 1 + 70 < length(x) THEN '…' ELSE '' END) END FROM (SELECT list_min(list_filter([instr(lower(x), 'zwei'), instr(lower(x), 'that'), instr(lower(x), 'que')], lambda q: q > 0)) AS p)))"})
cat.scalar("f67_truncate", "documents", DOC, {"y": lambda: F.sha2(text.truncate(C("x"), 1000), 256)}, {"y": "sha256(CASE WHEN length(x) <= 1000 THEN x ELSE concat(regexp_replace(substr(x, 1, 700), '\\s+$', ''), ' [...] ', regexp_replace(right(x, 293), '^\\s+', '')) END)"})
cat.scalar("f69_compress_blank_lines", "documents", {"k": "doc_id", "x": "concat(replace(replace(text, '. ', '.\n\n\n\n'), ', ', ',\n\n'), '\n ')"}, {"y": lambda: text.compress_blank_lines(C("x"))}, {"y": "trim(regexp_replace(x, '\\n{3,}', chr(10) || chr(10), 'g'), concat(' ', chr(10), chr(9)))"})
cat.scalar("f62_f63_email_subject", "conversations", {"k": "concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING))", "x": "concat(CASE turn % 4 WHEN 0 THEN 'AW: WG: ' WHEN 1 THEN '[extern] Re[2]: ' WHEN 2 THEN 'Fwd:' ELSE '' END, text)"}, {"subject": lambda: text.clean_subject(C("x")), "title": lambda: text.email_title(C("x"), ".eml")}, {"subject": "trim(regexp_replace(x, '(?i)^(\\s*(\\[[^\\]]*\\])?\\s*(aw|wg|re|fwd|fw|antw|antwort)\\s*(\\[[0-9]+\\])?\\s*:\\s*)+', ''))", "title": "nullif(concat(rtrim(substr(trim(trim(trim(regexp_replace(regexp_replace(trim(regexp_replace(x, '(?i)^(\\s*(\\[[^\\]]*\\])?\\s*(aw|wg|re|fwd|fw|antw|antwort)\\s*(\\[[0-9]+\\])?\\s*:\\s*)+', '')), '[\\\\/:*?\"<>|]', '', 'g'), '\\s+', ' ', 'g')), '.')), 1, 120)), '.eml'), '.eml')"})
cat.scalar("f76_cap_text", "documents", DOC, {"n": lambda: F.length(F.substring(C("x"), 1, 2000))}, {"n": "least(length(x), 2000)"})
cat.scalar("f77_template", "customer", {"k": "c_custkey", "a": "c_name", "b": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END"}, {"y": lambda: text.filled("{a} / {b}: {a}", {"a": C("a"), "b": C("b")})}, {"y": "concat(a, ' / ', coalesce(b, ''), ': ', a)"})
cat.scalar("s24_alnum_ratio", "documents", DOC, {"y": lambda: F.round(text.alnum_ratio(C("x")), 6)}, {"y": "round(coalesce(length(regexp_replace(regexp_replace(x, '\\s', '', 'g'), '[^\\pL\\pN]', '', 'g')) / nullif(length(regexp_replace(x, '\\s', '', 'g')), 0), 0), 6)"})
# ---- bank data
IBAN = "concat('de', lpad(CAST(98 - 0 AS STRING), 2, '0'), ' ', lpad(CAST(c_custkey * 7919 + 370400440000000000 AS STRING), 18, '0'))"
DUCK_IBAN = "concat(substr(upper(replace(x, ' ', '')), 1, 2), replace(substr(upper(replace(x, ' ', '')), 3), 'O', '0'))"
REST = f"(CAST(concat(substr({DUCK_IBAN}, 5), '1314', substr({DUCK_IBAN}, 3, 2)) AS HUGEINT) % 97 = 1)"
cat.scalar("f02_normalize_iban", "customer", {"k": "c_custkey", "x": "concat('de', lpad(CAST(c_custkey % 97 AS STRING), 2, 'O'), ' ', CAST(c_custkey * 7919 + 370400440000000000 AS STRING))"}, {"y": lambda: bank.normalize_iban(C("x"))}, {"y": DUCK_IBAN})
cat.scalar("f03_mod97", "customer", {"k": "c_custkey", "x": "concat('DE', lpad(CAST(c_custkey % 97 + 2 AS STRING), 2, '0'), CAST((c_custkey - c_custkey % 97) * 7919 + 370400440000000000 AS STRING))"}, {"y": lambda: bank.mod97(C("x"))}, {"y": REST})
cat.scalar("f04_f19_keyed_hash", "customer", {"k": "c_custkey", "x": "c_name"}, {"y": lambda: bank.hmac_sha256(C("x"), b"fixture-key")}, {"y": "sha256(unhex(concat('" + bytes(b ^ 0x5C for b in b"fixture-key".ljust(64, b"\0")).hex() + "', sha256(unhex(concat('" + bytes(b ^ 0x36 for b in b"fixture-key".ljust(64, b"\0")).hex() + "', hex(encode(x))))))))"})
# ---- labels and addresses
NUM = "CAST(k % 40 + 1 AS VARCHAR)"
cat.scalar("f46_unit_variants", "part", {"k": "p_partkey", "n": "CAST(p_partkey % 40 + 1 AS STRING)"}, {"n_variants": lambda: F.size(labels.unit_variants(["WE", "Whg"], C("n"))), "has": lambda: F.array_contains(labels.unit_variants(["WE", "Whg"], C("n")), F.concat(F.lit("WE-0"), C("n")))}, {"n_variants": "CASE WHEN length(n) = 1 THEN 24 ELSE 16 END", "has": "true"})
cat.scalar("f39_normalize_object_number", "part", {"k": "p_partkey", "x": "concat('Obj. 00', CAST(p_partkey AS STRING))"}, {"y": lambda: labels.normalize_object_number(C("x"), 3)}, {"y": "lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INT), '0')"})
cat.scalar("f40_folder_name", "customer", {"k": "c_custkey", "city": "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Köln' END", "street": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Ring' END"}, {"y": lambda: labels.object_folder_name("{number} {city}, {street}", number=C("k"), city=C("city"), street=C("street"))}, {"y": "concat(CAST(k AS VARCHAR), CASE WHEN city = '' THEN '' ELSE ' Köln' END, CASE WHEN street = '' THEN '' ELSE ', Ring' END)"})
cat.scalar("f55_address_variants", "supplier", {"k": "s_suppkey", "n": "CAST(s_suppkey AS STRING)"}, {"y": lambda: F.array_join(labels.address_variants(F.lit("Lange Straße"), C("n"), F.lit("50667"), F.lit("Köln")), "|")}, {"y": "concat('langestr ', n, '|langestr ', n, ' 50667 koeln|langestr ', n, ' koeln')"})
cat.scalar("f52_repair_ocr", "supplier", {"k": "s_suppkey", "x": "CASE s_suppkey % 6 WHEN 0 THEN 'l2' WHEN 1 THEN '1o' WHEN 2 THEN '3l4' WHEN 3 THEN '12b' WHEN 4 THEN 'o8-lo' ELSE 'Ios5' END"}, {"y": lambda: labels.repair_ocr_digits(C("x"))}, {"y": "CASE k % 6 WHEN 0 THEN '12' WHEN 1 THEN '10' WHEN 2 THEN '314' WHEN 3 THEN '12b' WHEN 4 THEN '08-lo' ELSE 'ios5' END"})
PREFIX = {"apartment": "WE", "garage": "TG", "other": "VE"}
cat.scalar("f34_f35_f37_owner_folder", "customer", {"k": "c_custkey", "label": "concat('WE ', CAST(c_custkey % 30 + 1 AS STRING))", "names": "CASE c_custkey % 3 WHEN 0 THEN array('Weiß', 'Abel') WHEN 1 THEN array('Zorn') ELSE array('C', 'B', 'A') END".replace("array(", "array(")}, {"y": lambda: labels.owner_folder_name(C("label"), F.lit("apartment"), C("names"), PREFIX)}, None)
ORACLE_SQL["f34_f35_f37_owner_folder"] = "SELECT c_custkey AS k, concat('WE', lpad(CAST(c_custkey % 30 + 1 AS VARCHAR), 2, '0'), '_', CASE c_custkey % 3 WHEN 0 THEN 'Abel_Weiss' WHEN 1 THEN 'Zorn' ELSE 'A_u_a' END) AS y FROM customer"

# ---- dates and evidence
ODATE = {"k": "o_orderkey", "d": "CAST(o_orderdate AS DATE)", "fy": "CAST(o_custkey % 12 + 1 AS INT)"}
FY = "CASE WHEN fy = 1 OR month(d) >= fy THEN year(d) ELSE year(d) - 1 END"
cat.scalar("f73_fiscal_year", "orders", ODATE, {"y": lambda: periods.fiscal_year(C("d"), C("fy"))}, {"y": FY})
cat.scalar("f74_statement_due", "orders", ODATE, {"y": lambda: periods.statement_due(F.year("d"), C("fy"), 180).cast("string")}, {"y": "CAST(CAST(make_date(year(d) + 1, fy, 1) + INTERVAL 179 DAY AS DATE) AS VARCHAR)"})
cat.scalar("f75_period_years", "orders", ODATE | {"s": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END"}, {"n_years": lambda: F.size(periods.period_years(C("s"), F.date_add("d", 400), C("fy"))["years"]), "plan": lambda: F.element_at(periods.period_years(C("s"), F.date_add("d", 400), C("fy"))["plan_years"], -1), "assumed": lambda: periods.period_years(C("s"), C("d"), C("fy"))["assumed"]}, {"n_years": f"CASE WHEN s IS NULL THEN 4 ELSE ({FY.replace('(d)', '(d + 400)')}) - ({FY}) + 1 END", "plan": f"({FY.replace('(d)', '(d + 400)')}) + CASE WHEN (month(d + 400) - fy + 12) % 12 >= 9 THEN 1 ELSE 0 END", "assumed": "s IS NULL"})
cat.scalar("f71_filing_year", "orders", ODATE | {"py": "CASE WHEN o_orderkey % 3 = 0 THEN 1850 WHEN o_orderkey % 3 = 1 THEN NULL ELSE 2020 END"}, {"y": lambda: periods.filing_year(C("py").cast("int"), F.lit(None).cast("date"), C("d"))}, {"y": "CASE WHEN py = 2020 THEN 2020 WHEN year(d) BETWEEN 1990 AND 2100 THEN year(d) END"})
cat.scalar("a04_business_days", "lineitem", {"k": LINE, "a": "CAST(l_shipdate AS DATE)", "n": "CAST(l_partkey % 40 - 3 AS INT)"}, {"y": lambda: periods.business_days(C("a"), F.date_add("a", F.col("n")))}, {"y": "(SELECT count(*) FROM range(1, greatest(n, 0) + 1) t(i) WHERE isodow(a + CAST(i AS INT)) < 6)"})
cat.scalar("a03_percent", "orders", {"k": "o_orderkey", "p": "o_orderkey % 97", "t": "o_orderkey % 13"}, {"y": lambda: periods.percent(C("p"), C("t")).cast("double")}, {"y": "CASE WHEN t <> 0 THEN CAST(round_even(CAST(p * 100 AS DOUBLE) / t, 2) AS DOUBLE) END"})
cat.scalar("r07_backoff", "events", {"k": "event_id", "n": "CAST(event_id % 9 + 1 AS INT)"}, {"y": lambda: periods.backoff_seconds(C("n"))}, {"y": "least(600, CAST(30 * pow(2, n - 1) AS BIGINT))"})
cat.scalar("f60_noisy_or", "lineitem", {"k": LINE, "a": "l_discount", "b": "l_tax", "c": "CASE WHEN l_linenumber % 3 = 0 THEN -0.05 ELSE 0.4 END"}, {"y": lambda: F.round(evidence.noisy_or(F.array(C("a"), C("b"), C("c").cast("double"))), 9)}, {"y": "round(greatest(0, least(1, 1 - (1 - a) * (1 - b) * CASE WHEN c > 0 THEN 1 - c ELSE 1 END - CASE WHEN c < 0 THEN -c ELSE 0 END)), 9)::DOUBLE"})
cat.scalar("f61_address_weight", "lineitem", {"k": LINE, "role": "CASE l_linenumber % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'neutral' WHEN 2 THEN 'supplier' ELSE 'billing' END", "amb": "l_orderkey % 3 = 0", "pm": "l_partkey % 2 = 0", "cm": "l_suppkey % 2 = 0"}, {"weight": lambda: F.round(evidence.address_weight(C("role"), C("amb"), C("pm"), C("cm"))["weight"], 9), "strong": lambda: evidence.address_weight(C("role"), C("amb"), C("pm"), C("cm"))["strong"]}, {"weight": "round(CASE WHEN role = 'supplier' THEN 0.0 ELSE 1 - (1 - CASE role WHEN 'object' THEN 0.75 WHEN 'neutral' THEN 0.45 ELSE 0.35 END * CASE WHEN amb THEN 0.5 ELSE 1 END) * CASE WHEN pm THEN 0.75 ELSE 1 END * CASE WHEN cm THEN 0.9 ELSE 1 END END, 9)::DOUBLE", "strong": "(role = 'object' OR (role = 'neutral' AND pm AND cm)) AND NOT amb"})
FUSE = {"k": LINE, "rule": "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE concat('0', CAST(l_linenumber % 4 AS STRING)) END", "rc": "CAST(l_discount * 5 + 0.4 AS DOUBLE)", "hard": "l_partkey % 3 = 0", "conflict": "l_partkey % 17 = 0", "top": "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE concat('0', CAST(l_suppkey % 3 + 1 AS STRING)) END", "p": "CAST(l_tax * 12 AS DOUBLE)", "gap": "CAST(l_discount AS DOUBLE)"}
BRANCH = "CASE WHEN conflict THEN 1 WHEN rule IS NULL AND top IS NULL THEN 2 WHEN rule IS NULL THEN 3 WHEN top IS NULL THEN 4 WHEN hard AND top = rule THEN 5 WHEN hard AND p > 0.9 THEN 6 WHEN hard THEN 7 WHEN top = rule THEN 8 ELSE 9 END"
FUSED = lambda f: (lambda: evidence.fuse(C("rule"), C("rc"), C("hard"), C("conflict"), C("top"), C("p"), C("gap"), F.lit(False))[f])
CONF = f"CASE {BRANCH} WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN p * (1 - 0.3 * (1 - gap)) WHEN 4 THEN rc WHEN 5 THEN 1 WHEN 6 THEN 0.74 WHEN 7 THEN rc WHEN 8 THEN least(1, greatest(rc, p) + 0.05) ELSE greatest(0, greatest(rc, p) - 0.15) END"
cat.scalar("e13_fuse_stages", "lineitem", FUSE, {"category": FUSED("category"), "confidence": FUSED("confidence"), "decided_by": FUSED("decided_by")}, {"category": f"CASE {BRANCH} WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN top WHEN 9 THEN CASE WHEN rc >= p THEN rule ELSE top END ELSE rule END", "confidence": f"round({CONF}, 4)::DOUBLE", "decided_by": f"CASE {BRANCH} WHEN 1 THEN 'none' WHEN 2 THEN 'none' WHEN 3 THEN 'stage2' WHEN 9 THEN CASE WHEN rc >= p THEN 'stage1' ELSE 'stage2' END ELSE 'stage1' END"})
cat.scalar("e14_fuse_third", "lineitem", FUSE, {"category": lambda: evidence.fuse_third(C("rule"), C("rc"), C("top"), C("p"))["category"], "overridden": lambda: evidence.fuse_third(C("rule"), C("rc"), C("top"), C("p"))["overridden"]}, {"category": "CASE WHEN top IS NULL THEN rule WHEN rule IS NULL OR rule = top THEN coalesce(rule, top) WHEN p >= 0.85 THEN top ELSE rule END", "overridden": "coalesce(rule <> top AND p >= 0.85, false)"})
cat.scalar("t05_verdict", "lineitem", FUSE, {"y": lambda: evidence.verdict(C("rc"), C("p"), C("hard"))}, {"y": "CASE WHEN rc < 0.3 THEN 'none' WHEN rc < 0.85 THEN 'review' WHEN rc - p < 0.25 THEN 'review' WHEN hard THEN 'review' ELSE 'auto' END"})
cat.scalar("y37_band", "lineitem", FUSE, {"y": lambda: evidence.band(C("rc"))}, {"y": "CASE WHEN rc >= 0.85 THEN 'high' WHEN rc >= 0.6 THEN 'medium' ELSE 'low' END"})
