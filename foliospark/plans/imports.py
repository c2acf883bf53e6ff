"""Cells of imported lists and the masking of account and identity numbers.

The inputs have the shapes that such lists hold, filled with numbers of the tables; each oracle computes its result from
the raw text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bank, cells
from ..operators import pages
from .base import C, Catalogue, spread, table
from .scalars import DUCK_CLEAN, duck_amount

cat = Catalogue()
QUERIES, ORACLE_SQL = cat.queries, cat.oracles


def one_of(key: str, *choices: str) -> str:
    """An expression of both dialects: the choices in turn."""
    return f"CASE ({key}) % {len(choices)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(choices)) + " END"


def digits(n: int, key: str = "c_custkey", factor: int = 7919) -> str:
    return f"lpad(CAST(({key} * {factor}) % {10**n} AS STRING), {n}, '0')"


def parts(make, *names: str) -> dict:
    """Fields of a struct column as output columns."""
    return {n: lambda n=n: make()[n] for n in names}


CLEAN = DUCK_CLEAN.format(x="raw")
KEY = "c_custkey"
LINE = "l_orderkey * 8 + l_linenumber"
STRUCT = ("value", "confidence", "reason")

# ---- cells
cat.scalar(
    "f11_classify_phone",
    "customer",
    {
        "k": KEY,
        "raw": one_of(
            KEY,
            f"concat('+49 151 ', {digits(7)})",
            f"concat('0049 170/', {digits(6)})",
            f"concat('0171-', {digits(7)})",
            f"concat(' 030 / ', {digits(6)}, ' ')",
            f"concat('Tel. 0211 ', {digits(5)})",
            f"concat('0140', {digits(6)})",
            f"concat('0', {digits(2)})",
            "'   '",
            "CAST(NULL AS STRING)",
        ),
    },
    parts(lambda: cells.classify_phone(C("raw")), "kind", "text", "confidence", "reason"),
    {
        "kind": "CASE WHEN length(regexp_replace(coalesce(raw, ''), '[^0-9]', '', 'g')) < 6 THEN NULL WHEN regexp_matches(regexp_replace(raw, '[^0-9+]', '', 'g'), '^(\\+49|0049|0)1[5-7][0-9]') THEN 'mobile' ELSE 'phone' END",
        "text": f"nullif({CLEAN}, '')",
        "confidence": f"CASE WHEN {CLEAN} = '' THEN 0.0 WHEN length(regexp_replace(raw, '[^0-9]', '', 'g')) < 6 THEN 0.4 ELSE 0.9 END::DOUBLE",
        "reason": f"CASE WHEN {CLEAN} = '' THEN 'empty' WHEN length(regexp_replace(raw, '[^0-9]', '', 'g')) < 6 THEN 'unparseable_phone' END",
    },
)

YEAR, MONTH, DAY = (f"CAST({part}(l_shipdate) AS STRING)" for part in ("year", "month", "day"))
MONTH2, DAY2 = (f"lpad({x}, 2, '0')" for x in (MONTH, DAY))
DUCK_DAYS = [
    ("^[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}$", "%d.%m.%Y"),
    ("^[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{2}$", "%d.%m.%y"),
    ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "%Y-%m-%d"),
    ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "%d/%m/%Y"),
    ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "%d-%m-%Y"),
    ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9:]+$", "%Y-%m-%d %H:%M:%S"),
]
DUCK_DAY = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({CLEAN}, '{shape}') THEN try_strptime({CLEAN}, '{fmt}')::DATE END" for shape, fmt in DUCK_DAYS) + ")"
DUCK_MONTH = f"CASE WHEN regexp_matches({CLEAN}, '^(0?[1-9]|1[0-2])/[0-9]{{4}}$') THEN try_strptime('1/' || {CLEAN}, '%d/%m/%Y')::DATE END"
DUCK_YEAR = f"CASE WHEN regexp_matches({CLEAN}, '^[0-9]{{4}}$') THEN make_date(CAST({CLEAN} AS INT), 1, 1) END"
cat.scalar(
    "f13_parse_date",
    "lineitem",
    {
        "k": LINE,
        "raw": one_of(
            "l_orderkey + l_linenumber",
            f"concat({DAY}, '.', {MONTH}, '.', {YEAR})",
            f"concat({DAY2}, '.', {MONTH2}, '.', substr({YEAR}, 3, 2))",
            f"concat({YEAR}, '-', {MONTH2}, '-', {DAY})",
            f"concat({DAY}, '/', {MONTH2}, '/', {YEAR})",
            f"concat({DAY2}, '-', {MONTH}, '-', {YEAR})",
            f"concat({YEAR}, '-', {MONTH2}, '-', {DAY2}, ' 07:05:', lpad(CAST(l_linenumber AS STRING), 2, '0'))",
            f"concat({MONTH}, '/', {YEAR})",
            f"concat('  ', {YEAR}, ' ')",
            f"concat('31.2.', {YEAR})",
            "concat(CAST(l_partkey % 28 + 1 AS STRING), '.1.', CAST(l_partkey % 90 + 10 AS STRING))",
            "'seit langem'",
            "''",
        ),
    },
    parts(lambda: cells.parse_date(C("raw")), *STRUCT) | {"value": lambda: cells.parse_date(C("raw"))["value"].cast("string")},
    {
        "value": f"coalesce({DUCK_DAY}, {DUCK_MONTH}, {DUCK_YEAR})::VARCHAR",
        "confidence": f"CASE WHEN {DUCK_DAY} IS NOT NULL THEN 0.95 WHEN {DUCK_MONTH} IS NOT NULL THEN 0.6 WHEN {DUCK_YEAR} IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE",
        "reason": f"CASE WHEN {DUCK_DAY} IS NOT NULL THEN NULL WHEN {DUCK_MONTH} IS NOT NULL THEN 'day_assumed_first' WHEN {DUCK_YEAR} IS NOT NULL THEN 'year_only' WHEN {CLEAN} = '' THEN 'empty' ELSE 'unparseable_date' END",
    },
)

DUCK_DIGITS = f"regexp_replace({CLEAN}, '[^0-9]', '', 'g')"
FOUR, FIVE = f"regexp_matches({CLEAN}, '^[0-9]{{4}}$')", f"length({DUCK_DIGITS}) = 5"
cat.scalar(
    "f15_parse_postal_code",
    "customer",
    {"k": KEY, "raw": one_of(KEY, digits(4), digits(5), f"concat('D-', {digits(5)})", f"concat('Postfach ', {digits(3)}, ' Nord')", f"concat(' ', {digits(2)}, ' ', {digits(3)})", "' '")},
    parts(lambda: cells.parse_postal_code(C("raw")), *STRUCT),
    {
        "value": f"CASE WHEN {CLEAN} = '' THEN NULL WHEN {FOUR} THEN '0' || {CLEAN} WHEN {FIVE} THEN {DUCK_DIGITS} ELSE substr({CLEAN}, 1, 10) END",
        "confidence": f"CASE WHEN {CLEAN} = '' THEN 0.0 WHEN {FOUR} THEN 0.7 WHEN {FIVE} THEN 0.95 ELSE 0.5 END::DOUBLE",
        "reason": f"CASE WHEN {CLEAN} = '' THEN 'empty' WHEN {FOUR} THEN 'leading_zero_added' WHEN NOT {FIVE} THEN 'postal_code_unusual' END",
    },
)

NAMES = [n for names in cells.COUNTRIES.values() for n in names]
COUNTRY_KEY = f"replace(upper({CLEAN}), '.', '')"
DUCK_COUNTRY = "CASE " + " ".join(f"WHEN {COUNTRY_KEY} IN ({', '.join(repr(n) for n in names)}) THEN '{iso}'" for iso, names in cells.COUNTRIES.items()) + " END"
cat.scalar(
    "f16_country",
    "customer",
    {"k": KEY, "raw": one_of(KEY, *(f"'{n}'" for n in NAMES), "'Deutschland'", "' d. '", "'türkei'", "'Atlantis'", "'u.s.a.'", "''")},
    parts(lambda: cells.country_iso2(C("raw")), *STRUCT),
    {
        "value": DUCK_COUNTRY,
        "confidence": f"CASE WHEN {CLEAN} = '' THEN 0.0 WHEN {DUCK_COUNTRY} IS NULL THEN 0.3 ELSE 0.95 END::DOUBLE",
        "reason": f"CASE WHEN {CLEAN} = '' THEN 'empty' WHEN {DUCK_COUNTRY} IS NULL THEN 'country_unknown' END",
    },
)

PAIR = f"regexp_matches({CLEAN}, '^[0-9.,]+ ?/ ?[0-9.,]+$')"
NUM, DEN, ALONE = (f"({duck_amount(x)})" for x in (f"split_part({CLEAN}, '/', 1)", f"split_part({CLEAN}, '/', 2)", "raw"))
BOTH = f"({PAIR} AND {NUM} IS NOT NULL AND coalesce({DEN}, 0) <> 0)"
cat.scalar(
    "f17_parse_fraction",
    "customer",
    {
        "k": KEY,
        "raw": one_of(KEY, f"concat({digits(3)}, '/10000')", f"concat({digits(3)}, ',5 / 1000')", f"concat({digits(3)}, '/10.000')", f"concat(' ', {digits(2)}, ' ')", f"concat({digits(2)}, '/0')", f"concat('1.', {digits(3)}, ',25 / 1.000')", "'x/y'", "''"),
    },
    parts(lambda: cells.parse_fraction(C("raw")), "numerator", "base", "confidence", "reason"),
    {
        "numerator": f"CASE WHEN {BOTH} THEN {NUM} ELSE {ALONE} END",
        "base": f"CASE WHEN {BOTH} THEN CAST({DEN} AS BIGINT) END",
        "confidence": f"CASE WHEN {BOTH} THEN 0.95 WHEN {ALONE} IS NOT NULL THEN 0.7 ELSE 0.0 END::DOUBLE",
        "reason": f"CASE WHEN {BOTH} THEN NULL WHEN {ALONE} IS NOT NULL THEN 'share_base_missing' WHEN {CLEAN} = '' THEN 'empty' ELSE 'unparseable_fraction' END",
    },
)

YES, NO = "'ja', 'j', 'x', '1', 'true', 'wahr', 'y', 'yes', 'vorhanden', 'erteilt'", "'nein', 'n', '0', 'false', 'falsch', 'no', 'nicht vorhanden', 'kein', 'keine'"
cat.scalar(
    "f18_parse_bool",
    "customer",
    {"k": KEY, "raw": one_of(KEY, *YES.split(", "), *NO.split(", "), "' JA '", "'Nicht  vorhanden'", "'-'", "'vielleicht'", "''")},
    parts(lambda: cells.parse_bool(C("raw")), *STRUCT),
    {
        "value": f"CASE WHEN lower({CLEAN}) IN ({YES}) THEN true WHEN lower({CLEAN}) IN ({NO}) THEN false END",
        "confidence": f"CASE WHEN {CLEAN} = '' THEN 0.0 WHEN lower({CLEAN}) IN ({YES}, {NO}) THEN 0.9 ELSE 0.3 END::DOUBLE",
        "reason": f"CASE WHEN {CLEAN} = '' THEN 'empty' WHEN lower({CLEAN}) NOT IN ({YES}, {NO}) THEN 'unparseable_bool' END",
    },
)

DEPOSITS = {"cash": ["bar", "überweisung"], "guarantee": ["bürgschaft"], "savings": ["sparbuch", "Sparkonto"]}
DUCK_DEPOSIT = f"CASE WHEN regexp_matches(lower({CLEAN}), 'bar|überweisung') THEN 'cash' WHEN contains(lower({CLEAN}), 'bürgschaft') THEN 'guarantee' WHEN regexp_matches(lower({CLEAN}), 'sparbuch|sparkonto') THEN 'savings' END"
cat.scalar(
    "f21_deposit_type",
    "customer",
    {"k": KEY, "raw": one_of(KEY, "'Barkaution'", "'Bankbürgschaft'", "'SPARBUCH'", "'per  Überweisung'", "'Bürgschaft, bar'", f"concat('Sparkonto ', {digits(4)})", "'Pfand'", "' '")},
    parts(lambda: cells.deposit_type(C("raw"), DEPOSITS), *STRUCT),
    {
        "value": f"CASE WHEN {CLEAN} <> '' THEN coalesce({DUCK_DEPOSIT}, 'unknown') END",
        "confidence": f"CASE WHEN {CLEAN} = '' THEN 0.0 WHEN {DUCK_DEPOSIT} IS NULL THEN 0.4 ELSE 0.85 END::DOUBLE",
        "reason": f"CASE WHEN {CLEAN} = '' THEN 'empty' WHEN {DUCK_DEPOSIT} IS NULL THEN 'deposit_type_unknown' END",
    },
)

DUCK_RENT = f"CASE WHEN contains(lower({CLEAN}), 'staffel') THEN 'graduated' WHEN contains(lower({CLEAN}), 'index') THEN 'indexed' WHEN lower({CLEAN}) IN ({NO}) OR contains(lower({CLEAN}), 'keine') THEN 'none' ELSE 'unknown' END"
cat.scalar(
    "f22_rent_adjustment",
    "customer",
    {"k": KEY, "raw": one_of(KEY, "'Staffelmiete'", "'Index (Staffel)'", "'INDEXMIETE'", "'nein'", "'derzeit keine Anpassung'", "'-'", "'nach Lage'", "''")},
    parts(lambda: cells.rent_adjustment(C("raw")), *STRUCT),
    {
        "value": f"CASE WHEN {CLEAN} <> '' THEN {DUCK_RENT} END",
        "confidence": f"CASE WHEN {CLEAN} = '' THEN 0.0 WHEN {DUCK_RENT} = 'unknown' THEN 0.4 WHEN {DUCK_RENT} = 'none' THEN 0.8 ELSE 0.9 END::DOUBLE",
        "reason": f"CASE WHEN {CLEAN} = '' THEN 'empty' WHEN {DUCK_RENT} = 'unknown' THEN 'rent_adjustment_unknown' END",
    },
)

cat.scalar(
    "p12_looks_like_total",
    "part",
    {"k": "p_partkey", "raw": one_of("p_partkey", "';Summe;100'", "'Gesamt:;;'", "';  ; TOTAL '", "';;'", "concat(p_name, ';Summe')", "'Gesamtsumme;1'", "'Zwischensumme;2'")},
    {"total_row": lambda: cells.looks_like_total(F.split(C("raw"), ";"))},
    {"total_row": "coalesce(lower(trim(list_filter(string_split(raw, ';'), lambda c: trim(c) <> '')[1])) IN ('summe', 'gesamt', 'total', 'summe:', 'gesamt:'), false)"},
)

# ---- masking
SENSITIVE = one_of(
    KEY,
    f"concat('Zahlung an DE', {digits(2)}, ' 3704 0044 ', {digits(4)}, ' ', {digits(4, factor=104729)}, ' ', {digits(2, factor=31)}, ' bis morgen')",
    f"concat('IBAN DE', {digits(2)}, '37040044', {digits(10)}, ', BIC: COBADEFFXXX')",
    f"concat('DE', {digits(2)}, ' 37O4 OO44 ', {digits(4)}, ' O13O OO')",
    f"concat('AT61 1904 3002 ', {digits(4)}, ' ', {digits(4, factor=104729)}, ' und mehr')",
    f"concat('XY12 ABCD EFGH; SWIFT-Code COBADEFF und ', {digits(3)})",
    f"concat('BLZ 370 400 44, Konto-Nr. ', {digits(9)}, ' Bankleitzahl: ', {digits(8)})",
    f"concat('kto.-nr.: 123 456 ', {digits(2)}, ' offen; KONTONUMMER ', {digits(8)})",
    f"concat('Personalausweisnummer: L01X', {digits(6)}, ' und Ausweiskopie C01X', {digits(5)})",
    f"concat('Reisepass C01X', {digits(6)}, '. Ausweis-Nr. L01X', {digits(5)})",
    f"concat('Telefon +49 1522 9233185, Rechnung 2025-', {digits(6)}, ', Konto 7')",
    f"concat('HAUSGELD FAELLIG, BIC hausgeld ', {digits(4)})",
    f"concat('AT61 1904 3002 ', {digits(4)}, ' ', {digits(4, factor=104729)}, ' BIC: OPSKATWW')",
    f"concat('BE68 5390 ', {digits(4)}, ' 7034 BIC GKCCBEBB')",
    f"concat('AT6119043002', {digits(8)}, ' BLZ ', {digits(8, factor=104729)})",
    f"concat('LU28 0019 4006 ', {digits(4)}, ' 0000 Konto-Nr. ', {digits(9)}, ' SWIFT BYLADEM1001')",
    f"concat('AB12 CDEF BLZ ', {digits(8)})",
    "CAST(NULL AS STRING)",
)
# The oracle has its own patterns, for the shapes above. It replaces the numbers behind words first; an account may read on into
# such a word, but not into the mark behind it.
DUCK_ACCOUNT = r"\b(?:DE[0-9O]{2}|(?:[A-CE-Z][A-Z]|D[A-DF-Z])[0-9]{2})(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?\b"
DUCK_AFTER = [
    ("BIC", r"(BIC|SWIFT|SWIFT-Code)(:? )[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?"),
    ("BLZ", r"(BLZ|Bankleitzahl)(:? )[0-9]{3} ?[0-9]{3} ?[0-9]{2}"),
    ("KONTONR", r"((?i)konto-nr\.|kontonummer|kto\.-nr\.)(:? )[0-9][0-9 ]{4,14}[0-9]"),
    ("AUSWEISNR", r"(Personalausweisnummer|Ausweiskopie|Reisepass|Ausweis-Nr\.)(:? )[A-Z0-9]{9,10}"),
]


def duck_behind_words(x: str) -> str:
    """``x`` with the numbers behind words replaced."""
    for mark, shape in DUCK_AFTER:
        x = f"regexp_replace({x}, '\\b{shape}\\b', '\\1\\2[{mark}]', 'g')"
    return x


MASK_ORACLE = f"""
    WITH src AS (SELECT c_custkey AS k, {SENSITIVE} AS raw FROM customer),
    found AS (SELECT k, x, regexp_extract(x, '{DUCK_ACCOUNT}') AS account FROM (SELECT k, {duck_behind_words("raw")} AS x FROM src)),
    bared AS (SELECT k, x, account, replace(account, ' ', '') AS b FROM found),
    fixed AS (SELECT k, x, account, substr(b, 1, 2) || replace(substr(b, 3), 'O', '0') AS bare, length(b) BETWEEN 15 AND 34 AS good FROM bared),
    masked AS (
        SELECT k, x, bare, good, CASE WHEN good THEN replace(x, account, '[IBAN_****' || right(bare, 4) || ']') ELSE x END AS shown,
               CASE WHEN good THEN replace(x, account, '[IBAN]') ELSE x END AS hidden
        FROM fixed)
    SELECT k, shown, hidden, len(regexp_extract_all(hidden, '\\[[A-Z]+\\]')) AS hits, CASE WHEN good THEN right(bare, 4) END AS last4,
           CASE WHEN good THEN list_reduce(
               list_prepend(0, list_transform(string_split(substr(bare, 5) || substr(bare, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)),
               lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97) = 1 END AS valid
    FROM masked"""


@cat.query("f01_mask_text", MASK_ORACLE)
def f01_mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = spread(table(spark, sf_dir, "customer").select("c_custkey")).selectExpr("c_custkey AS k", f"{SENSITIVE} AS x")
    both = src.select("k", bank.mask_text(C("x")).alias("full"), bank.mask_text(C("x"), "log")["text"].alias("hidden"))
    account = F.try_element_at(F.filter(C("full.hits"), lambda h: h["kind"] == "iban"), F.lit(1))
    return both.select("k", C("full.text").alias("shown"), "hidden", F.when(C("full").isNotNull(), F.size("full.hits")).alias("hits"), account["last4"].alias("last4"), account["valid"].alias("valid"))


cat.query(
    "f05_contains_sensitive",
    f"WITH m AS ({MASK_ORACLE}) SELECT k, coalesce(hits, 0) > 0 AS y FROM m",
)(lambda spark, sf_dir: table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", f"{SENSITIVE} AS x").select("k", bank.contains_sensitive(C("x")).alias("y")))

cat.query(
    "f20_mask_cell",
    f"WITH m AS ({MASK_ORACLE}) SELECT k, regexp_replace(trim(coalesce(shown, '')), '\\s+', ' ', 'g') AS y FROM m",
)(lambda spark, sf_dir: spread(table(spark, sf_dir, "customer").select("c_custkey")).selectExpr("c_custkey AS k", f"{SENSITIVE} AS x").select("k", bank.mask_cell(F.concat(F.lit("  "), C("x"), F.lit("\t"))).alias("y")))

FILE_NAME = one_of("s_suppkey", "concat('Brief an MEYER und Meyermann ', s_name, '.pdf')", "concat('Vertrag Li ', s_name, ' (Schmidt GmbH).docx')", "concat('c++ Abrechnung.', s_name)", "'ohne Namen.pdf'")
cat.query(
    "f07_mask_file_name",
    f"""
    WITH src AS (SELECT s_suppkey AS k, {FILE_NAME} AS name, s_name AS own FROM supplier)
    SELECT k, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '(?i)' || own, '[NAME]', 'g'), '(?i)schmidt gmbh', '[NAME]', 'g'), '(?i)meyermann', '[NAME]', 'g'), '(?i)meyer', '[NAME]', 'g'), '(?i)c\\+\\+', '[NAME]', 'g') AS y
    FROM src""",
)(lambda spark, sf_dir: table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", f"{FILE_NAME} AS name", "array('Meyer', 'Li', s_name, 'Meyermann', 'Schmidt GmbH', 'c++', null) AS people").select("k", bank.mask_file_name(C("name"), C("people")).alias("y")))

SECRETS = "concat('{\"user\":\"', c_name, '\",\"IBAN\":\"', c_name, '\",\"iban_last4\":\"', CAST(c_custkey AS STRING), '\",\"nested\":{\"api_key\":[1,2],\"list\":[\"BLZ 370 400 44\",7,null,true]},\"Refresh\":null}')"
cat.query(
    "f08_scrub_json",
    """
    SELECT c_custkey AS k, c_name AS "user", '[GESCHWAERZT]' AS account, CAST(c_custkey AS VARCHAR) AS last4, '[GESCHWAERZT]' AS api_key, 'BLZ [BLZ]' AS bank, '7' AS number, '[GESCHWAERZT]' AS refresh
    FROM customer""",
)(
    lambda spark, sf_dir: spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    .select(C("c_custkey").alias("k"), bank.scrub_json(F.expr(SECRETS)).alias("j"))
    .select("k", *(F.get_json_object("j", path).alias(n) for n, path in (("user", "$.user"), ("account", "$.IBAN"), ("last4", "$.iban_last4"), ("api_key", "$.nested.api_key"), ("bank", "$.nested.list[0]"), ("number", "$.nested.list[1]"), ("refresh", "$.Refresh"))))
)

PAGE_ORACLE = f"WITH m AS ({MASK_ORACLE}) SELECT k AS doc, 1 AS page_no, sha256(hidden) AS text_sha256, coalesce(hits, 0) AS hits, coalesce(last4, '') AS accounts FROM m"


@cat.query("y02_masked_pages", PAGE_ORACLE)
def y02_masked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages masked before they are kept, with the record of what was found."""
    src = spread(table(spark, sf_dir, "customer").select("c_custkey")).selectExpr("c_custkey AS doc", "1 AS page_no", f"{SENSITIVE} AS text")
    done = pages.masked(src, "log")
    accounts = F.array_join(F.transform(F.filter("hits", lambda h: h["kind"] == "iban"), lambda h: h["last4"]), ",")
    return done.select("doc", "page_no", F.sha2("text", 256).alias("text_sha256"), C("n_hits").alias("hits"), F.coalesce(accounts, F.lit("")).alias("accounts"))
