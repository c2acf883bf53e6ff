"""Labels of units, folders and houses, names and codes: the SQL reads each from the raw text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, text
from .base import C, Catalogue
from .imports import one_of, parts
from .scalars import DUCK_TR

cat = Catalogue()
QUERIES, ORACLE_SQL = cat.queries, cat.oracles

PART = "p_partkey"
NO = "CAST(p_partkey % 40 + 1 AS STRING)"
LABEL = one_of(
    PART,
    f"concat('WE 0', {NO})",
    f"concat('we.', {NO}, 'a')",
    f"concat('TG ', {NO}, ' - Hof')",
    NO,
    "'Keller'",
    f"concat('Stp-', {NO})",
    f"concat(' WE  00', {NO}, ' b ')",
    f"concat('Whg. Nr. ', {NO}, ' – 2. OG links')",
    f"concat('WE 1/', {NO})",
    "'   '",
    "CAST(NULL AS STRING)",
)
UNIT = r"^\s*([^0-9]*?)[\s.\-]*([0-9]+)\s*([a-zA-Z]?)\s*(?:[-–]\s*(.+?))?\s*$"


def unit_sql(x: str) -> dict[str, str]:
    clean = f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
    good = f"regexp_matches({clean}, '{UNIT}')"
    part = lambda k: f"regexp_extract({clean}, '{UNIT}', {k})"
    number = f"regexp_replace({part(2)}, '^0+([0-9])', '\\1')"
    bare = f"upper(regexp_replace({part(1)}, '[\\s.\\-]', '', 'g'))"
    return {
        "key": f"CASE WHEN {good} THEN {bare} || {number} || upper({part(3)}) ELSE upper(regexp_replace({clean}, '\\s', '', 'g')) END",
        "number": f"CASE WHEN {good} THEN {number} END",
        "suffix": f"CASE WHEN {good} THEN lower({part(3)}) ELSE '' END",
        "rest": f"CASE WHEN {good} THEN nullif({part(4)}, '') END",
        "type": f"CASE WHEN NOT {good} THEN 'other' WHEN {bare} IN ('', 'WE') THEN 'apartment' WHEN {bare} = 'TG' THEN 'garage' ELSE 'other' END",
    }


cat.scalar("f43_f44_parse_unit", "part", {"k": PART, "x": LABEL}, parts(lambda: labels.parse_unit(C("x"), {"WE": "apartment", "TG": "garage"}), "key", "number", "suffix", "rest", "type"), unit_sql("x"))
cat.scalar(
    "f45_same_unit",
    "part",
    {"k": PART, "x": LABEL, "z": one_of("p_size", f"concat('WE ', {NO})", f"concat('WE', {NO}, ' A')", NO)},
    {"y": lambda: labels.same_unit(C("x"), C("z"))},
    {"y": f"({unit_sql('x')['key']}) = ({unit_sql('z')['key']})"},
)
PREFIXES = {"garage": "TG", "other": "VE"}
UNIT_PARTS = unit_sql("x")
cat.scalar(
    "f33_unit_token",
    "part",
    {"k": PART, "x": LABEL},
    {"y": lambda: labels.unit_token(C("x"), F.lit("garage"), PREFIXES)},
    {"y": f"CASE WHEN ({UNIT_PARTS['number']}) IS NOT NULL THEN 'TG' || lpad({UNIT_PARTS['number']}, greatest(2, length({UNIT_PARTS['number']}))::INT, '0') || {UNIT_PARTS['suffix']} ELSE coalesce(nullif(regexp_replace(coalesce(x, ''), '[\\s\\\\/:*?<>|]', '', 'g'), ''), 'TG') END"},
)

NUMBER = r"^\s*([0-9]{2,6})(?:[ _,.\-](.*))?$"
cat.scalar(
    "f38_y12_y22_object_number",
    "part",
    {
        "k": PART,
        "x": one_of(
            PART,
            "concat('0', CAST(p_partkey % 900 + 10 AS STRING), ' ', p_brand)",
            "concat(CAST(p_partkey % 900 + 10 AS STRING), '_ - ', p_brand)",
            "concat(CAST(p_partkey % 900 + 10 AS STRING), 'x')",
            "p_name",
            "concat(' ', CAST(p_partkey % 90 + 10 AS STRING))",
            "'1234567 zu lang'",
            "'7 zu kurz'",
        ),
    },
    {"number": lambda: labels.object_number(C("x"))["number"], "rest": lambda: labels.object_number(C("x"))["rest"]},
    {
        "number": f"CASE WHEN regexp_matches(x, '{NUMBER}') THEN CAST(regexp_extract(x, '{NUMBER}', 1) AS BIGINT) END",
        "rest": f"CASE WHEN regexp_matches(x, '{NUMBER}') THEN trim(regexp_replace(regexp_extract(x, '{NUMBER}', 2), '^[ _,.\\-]+', '')) END",
    },
)

FOLDER = one_of(PART, "'05_Verträge'", "'5 Vertraege'", "'Belege'", "'  05 -  VERTRÄGE'", "'005 Verträge'", "'12'", "concat('05 Verträge ', p_brand)")


def folder_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({DUCK_TR.format(x=f"replace({x}, '_', ' ')")}), '\\s+', ' ', 'g'))"


BARE = "replace(regexp_replace({x}, '^[0-9]{{1,2}}[ .\\-]*', ''), ' ', '')"
cat.scalar(
    "f41_f42_loose_match",
    "part",
    {"k": PART, "a": FOLDER},
    {"norm": lambda: labels.folder_norm(C("a")), "loose": lambda: labels.loose_match(C("a"), F.lit("05 Verträge"))},
    {"norm": folder_sql("a"), "loose": f"{BARE.format(x=folder_sql('a'))} <> '' AND {BARE.format(x=folder_sql('a'))} = 'vertraege'"},
)

SUPP = "CAST(s_suppkey % 90 + 1 AS STRING)"
HOUSE = one_of(
    "s_suppkey",
    SUPP,
    f"concat({SUPP}, ' a')",
    f"concat({SUPP}, ' - ', CAST(s_suppkey % 90 + 5 AS STRING))",
    f"concat({SUPP}, '/', CAST(s_suppkey % 30 AS STRING))",
    "'ohne'",
    f"concat('Nr ', {SUPP})",
    f"concat({SUPP}, 'b-', CAST(s_suppkey % 90 + 9 AS STRING), 'c')",
    "''",
)
HOUSE_SHAPE = "^([0-9]{1,4})\\s?([a-z]?)(?:[-/]([0-9]{1,4})\\s?[a-z]?)?$"
TIDY = "regexp_replace(trim(lower(x)), '\\s*([-/])\\s*', '\\1', 'g')"
GOOD = f"regexp_matches({TIDY}, '{HOUSE_SHAPE}')"
NUM, TO = (f"TRY_CAST(regexp_extract({TIDY}, '{HOUSE_SHAPE}', {k}) AS INT)" for k in (1, 3))
SUFFIX = f"CASE WHEN {GOOD} THEN regexp_extract({TIDY}, '{HOUSE_SHAPE}', 2) ELSE '' END"
cat.scalar(
    "f53_house_number",
    "supplier",
    {"k": "s_suppkey", "x": HOUSE},
    parts(lambda: labels.house_number(C("x")), "num", "suffix", "upto"),
    {"num": f"CASE WHEN {GOOD} THEN {NUM} END", "suffix": SUFFIX, "upto": f"CASE WHEN {GOOD} AND {TO} >= {NUM} THEN {TO} END"},
)
cat.scalar(
    "j16_f49_house_overlap",
    "supplier",
    {"k": "s_suppkey", "x": HOUSE},
    {"y": lambda: labels.house_numbers_overlap(labels.house_number(C("x")), labels.house_number(F.lit("10-40")))},
    {"y": f"coalesce({GOOD} AND {SUFFIX} = '' AND {NUM} <= 40 AND 10 <= CASE WHEN {TO} >= {NUM} THEN {TO} ELSE {NUM} END, false)"},
)

FORMS = ["GmbH & Co. KG", "GmbH", "AG", "KG"]
STRIPPED = "x"
for form in FORMS:
    STRIPPED = f"regexp_replace({STRIPPED}, '(?i)(^|[\\s,;&+]){form.replace('.', '[.]')}([\\s,;&+]|$)', '\\1\\2', 'g')"
cat.scalar(
    "f32_strip_legal_form",
    "customer",
    {"k": "c_custkey", "x": one_of("c_custkey", "'Muster GmbH & Co. KG'", "concat('Haus AG, ', c_mktsegment)", "'GmbH'", "'Agentur Bau'", "concat(c_mktsegment, ' gmbh')", "'KG Bau + AG'")},
    {"y": lambda: labels.strip_legal_form(C("x"), FORMS)},
    {"y": f"coalesce(nullif(trim(regexp_replace(regexp_replace({STRIPPED}, '(^|\\s)[&,;/+]+(\\s|$)', ' ', 'g'), '\\s+', ' ', 'g'), ' ,;&+-'), ''), trim(x))"},
)

cat.scalar(
    "f70_coerce_code",
    "lineitem",
    {"k": "l_orderkey * 8 + l_linenumber", "x": one_of("l_linenumber + l_partkey", "'05'", "'03 Verträge'", "'none'", "' 07-x'", "'035'", "'05_a'", "''")},
    {"y": lambda: text.coerce_code(C("x"), ["03", "05", "07"])},
    {"y": "CASE WHEN trim(x) IN ('03', '05', '07') THEN trim(x) WHEN regexp_extract(trim(x), '^([A-Za-z0-9_]+)', 1) IN ('03', '05', '07') THEN regexp_extract(trim(x), '^([A-Za-z0-9_]+)', 1) END"},
)
cat.scalar(
    "p16_mask_email",
    "customer",
    {"k": "c_custkey", "x": one_of("c_custkey", "c_name", "concat(lower(c_mktsegment), CAST(c_custkey AS STRING), '@mail', CAST(c_custkey % 9 AS STRING), '.example')", "concat('x@', lower(c_mktsegment), '.haus.example')", "'a@b@c.de'", "'x@y'")},
    {"y": lambda: text.mask_email(C("x"))},
    {"y": "CASE WHEN len(string_split(x, '@')) = 2 AND string_split(x, '@')[1] <> '' AND regexp_matches(string_split(x, '@')[2], '^[^.].*[.][^.]+$') THEN x[1] || '***@' || string_split(x, '@')[2][1] || '***.' || string_split(x, '.')[-1] END"},
)


def words_sql(x: str, least: int) -> str:
    norm = f"trim(regexp_replace(regexp_replace(lower({DUCK_TR.format(x=x)}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
    return f"list_filter(string_split({norm}, ' '), lambda w: length(w) >= {least})"


STARTS = "list_transform({x}, lambda w: substr(w, 1, 5))"
cat.scalar(
    "y19_names_match",
    "customer",
    {"k": "c_custkey", "a": "concat('Wohnpark ', c_mktsegment)", "b": one_of("c_custkey", "'WOHNP. Nord'", "'Haus building'", "'xy'", "concat('an der ', c_mktsegment)", "'Haus MACHI-Werk'", "''")},
    {"y": lambda: text.names_match(C("a"), C("b"))},
    {"y": f"list_has_any({words_sql('a', 4)}, {words_sql('b', 4)}) OR list_has_any({STARTS.format(x=words_sql('a', 5))}, {STARTS.format(x=words_sql('b', 5))})"},
)

cat.scalar(
    "s22_looks_like_html",
    "pages",
    {"k": "page_id", "x": one_of("page_id", "html", "concat('<!-- c -->', html)", "concat('text ', html)", "'plain'", "concat('  <!DOCTYPE HTML>', html)", "concat('<?xml version=1?>', repeat(' ', 2040), '<html>')", "''")},
    {"y": lambda: text.looks_like_html(C("x"))},
    {"y": "starts_with(lower(ltrim(x)), '<!doctype html') OR starts_with(lower(ltrim(x)), '<html') OR (starts_with(lower(ltrim(x)), '<?xml') OR starts_with(lower(ltrim(x)), '<!--')) AND contains(substr(lower(ltrim(x)), 1, 2048), '<html')"},
)
