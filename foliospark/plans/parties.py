"""Parties of free-text names; each oracle reads them from the raw text with its own patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import people, text
from ..operators import fuzzy
from .base import C, Catalogue, spread, table
from .imports import one_of

cat = Catalogue()
QUERIES, ORACLE_SQL = cat.queries, cat.oracles

FIRST = one_of("c_custkey", "'Anna'", "'Karl Otto'", "'Ute'", "'Jean-Luc'", "'Zoé'")
SECOND = one_of("c_nationkey", "'Max'", "'Erika'", "'Bernd'", "'Ida Rosa'")
LAST = one_of("c_custkey + c_nationkey", "'Müller'", "'Weber-Klein'", "'Öz'", "'Sander'", "'Großmann'", "'Undine'", "'Bauer'")
OTHER = one_of("c_nationkey", "'Abel'", "'Lang'", "'Übel'")
NAME = one_of(
    "c_custkey",
    f"concat({LAST}, ', ', {FIRST}, ' & ', {SECOND})",
    f"concat({LAST}, ', ', {FIRST}, ' u. ', {SECOND})",
    f"concat({FIRST}, ' und ', {SECOND}, ' ', {LAST})",
    f"concat({LAST}, ', ', {FIRST}, ' / ', {OTHER}, ', ', {SECOND})",
    f"concat({LAST}, ', Dr. ', {FIRST}, '; ', {OTHER}, ', ', {SECOND})",
    f"concat('Frau ', {FIRST}, ' ', {LAST})",
    f"concat('Hr. Dipl.-Kfm. ', {SECOND}, ' ', {LAST})",
    f"concat('  \"', {LAST}, '\" ,')",
    f"concat('Eheleute ', {LAST})",
    f"concat('Ehepaar ', {SECOND}, ' und ', {FIRST}, ' ', {LAST})",
    f"concat({LAST}, ' GbR')",
    f"concat('Wohnbau ', {LAST}, ' eG c/o Verwaltung ', {OTHER})",
    f"concat('Erbengemeinschaft ', {LAST})",
    f"concat('Gemeinschaft ', {OTHER}, ', c/o ', {LAST})",
    f"concat({FIRST}, ' & ', {SECOND})",
    f"concat({FIRST}, ' von der ', {LAST}, ' c/o ', {OTHER}, ' AG')",
    "'   '",
    f"concat('c/o ', {OTHER})",
)
# What the oracle takes off the front of a person's words, and where it parts first names.
FRONT = r"^((?i:herrn?|frau|hr\.|fr\.|dr\.|prof\.|dipl\.-kfm\.)\s+)+"
JOINED = r"(?i)\s*(?:&|\bund\b|\bu\.)\s*"
PERSON_SQL = f"""CASE
    WHEN contains(p, ',') THEN list_transform(regexp_split_to_array(regexp_replace(trim(substr(p, strpos(p, ',') + 1)), '{FRONT}', ''), '{JOINED}'),
        lambda f: {{'last': trim(split_part(p, ',', 1)), 'first': f, 'sure': 0.95}})
    WHEN regexp_matches(bare, '{JOINED}') AND NOT regexp_matches(bare, '{JOINED}\\S+$') THEN list_transform(
        regexp_split_to_array(regexp_replace(bare, '\\s+\\S+$', ''), '{JOINED}'), lambda f: {{'last': regexp_extract(bare, '(\\S+)$', 1), 'first': f, 'sure': 0.75}})
    WHEN regexp_matches(bare, '{JOINED}') THEN list_transform(regexp_split_to_array(bare, '{JOINED}'), lambda f: {{'last': NULL, 'first': f, 'sure': 0.5}})
    WHEN NOT contains(bare, ' ') THEN [{{'last': bare, 'first': NULL, 'sure': 0.7}}]
    ELSE [{{'last': regexp_extract(bare, '(\\S+)$', 1), 'first': regexp_replace(bare, '\\s+\\S+$', ''),
            'sure': CASE len(string_split(bare, ' ')) WHEN 2 THEN 0.9 WHEN 3 THEN 0.7 ELSE 0.5 END}}] END"""
NAMES_ORACLE = f"""
    WITH src AS (SELECT c_custkey AS k, {NAME} AS raw FROM customer),
    t AS (SELECT k, trim(regexp_replace(replace(raw, '"', ''), '\\s+', ' ', 'g'), ' ,;') AS t FROM src),
    c AS (SELECT k, regexp_extract(t, '(?i)\\bc/o\\b\\s*(.+)$', 1) AS who, trim(regexp_replace(t, '(?i),?\\s*\\bc/o\\b.*$', ''), ' ,;') AS name FROM t),
    f AS (SELECT *, regexp_matches(name, '(^|\\s)(Eheleute|Ehepaar)(\\s|$)') AS couple, regexp_matches(name, '(^|\\s)(Erbengemeinschaft|Gemeinschaft)(\\s|$)') AS community,
                 regexp_matches(name, '(^|\\s)(GbR|eG|AG)($|\\s)') AS company FROM c),
    parts AS (SELECT k, unnest(regexp_split_to_array(name, '\\s*[/;]\\s*')) AS p, generate_subscripts(regexp_split_to_array(name, '\\s*[/;]\\s*'), 1) AS place FROM f WHERE NOT couple AND NOT community AND NOT company AND name <> ''),
    people AS (SELECT k, place, {PERSON_SQL} AS who FROM (SELECT *, regexp_replace(p, '{FRONT}', '') AS bare FROM parts)),
    joined AS (SELECT k, flatten(list(who ORDER BY place)) AS who FROM people GROUP BY k),
    a AS (
        SELECT f.*, CASE WHEN couple THEN list_value({{'last': trim(regexp_replace(name, 'Eheleute|Ehepaar', '')), 'first': NULL, 'sure': 0.5}}, {{'last': trim(regexp_replace(name, 'Eheleute|Ehepaar', '')), 'first': NULL, 'sure': 0.5}})
                         ELSE coalesce(joined.who, []) END AS persons
        FROM f LEFT JOIN joined USING (k))
    SELECT k, CASE WHEN community THEN 'community' WHEN company THEN 'legal_entity' ELSE 'natural_person' END AS kind,
           array_to_string(list_transform(persons, lambda x: coalesce(x.last, '') || '|' || coalesce(x.first, '')), ';') AS persons, CASE WHEN community OR company THEN name END AS company,
           CASE WHEN who <> '' THEN 'c/o ' || who END AS care_of,
           CASE WHEN community OR company THEN 0.95 ELSE coalesce(list_min(list_transform(persons, lambda x: x.sure)), 0) END::DOUBLE AS confidence,
           CASE WHEN community OR company OR list_min(list_transform(persons, lambda x: x.sure)) >= 0.9 THEN 'high' WHEN list_min(list_transform(persons, lambda x: x.sure)) >= 0.6 THEN 'medium' ELSE 'low' END AS band
    FROM a"""


@cat.query("f23_f24_f25_names", NAMES_ORACLE)
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parties of free-text names."""
    s = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", f"{NAME} AS raw").select("k", people.split_names(C("raw")).alias("s"))
    person = F.transform("s.persons", lambda p: F.concat(F.coalesce(p["last"], F.lit("")), F.lit("|"), F.coalesce(p["first"], F.lit(""))))
    return s.select("k", "s.kind", F.array_join(person, ";").alias("persons"), "s.company", "s.care_of", "s.confidence", "s.band")


LEGAL = one_of(
    "c_custkey",
    "concat('Bau GmbH, ', c_name)",
    "concat(c_name, ' Agenda Gemeinschaftlich')",
    "concat('Verein ', c_name, ' e.v.')",
    "concat('ERBENGEMEINSCHAFT ', c_name, ' AG')",
    "concat('(', c_name, ' KG)')",
    "concat('Weg am ', c_name)",
    "concat('Stiftungsrat ', c_name)",
    "CAST(NULL AS STRING)",
)
FORMS_SQL = "['Erbengemeinschaft', 'Genossenschaft', 'Gemeinschaft', 'Stiftung', 'Eheleute', 'Ehepaar', 'Familie', 'GmbH', 'e.V.', 'OHG', 'GbR', 'WEG', 'AG', 'KG', 'UG', 'eG']"


@cat.query("f26_legal_form", f"""
    SELECT k, list_filter({FORMS_SQL}, lambda m: regexp_matches(' ' || raw || ' ', '(?i)[^\\pL\\pN_]' || replace(m, '.', '\\.') || '[^\\pL\\pN_]'))[1] AS form
    FROM (SELECT c_custkey AS k, {LEGAL} AS raw FROM customer)""")
def legal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the longest legal form that stands as a whole word."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", f"{LEGAL} AS raw").select("k", people.has_marker(C("raw")).alias("form"))

def word(key: str, letters: int, salt: str) -> str:
    """A word of letters from a key; hardly any two are alike."""
    return f"translate(substr(md5(concat('{salt}', CAST(({key}) AS STRING))), 1, {letters}), '0123456789abcdef', 'aeioulnrstbdghkm')"


def owner_row(key: str) -> dict[str, str]:
    """The columns of an owner from a key; every sixth is a company."""
    natural = f"({key}) % 6 <> 0"
    return {
        "kind": f"CASE WHEN {natural} THEN 'natural_person' ELSE 'legal_entity' END",
        "first_name": f"CASE WHEN {natural} AND ({key}) % 11 <> 0 THEN initcap({word(key, 4, 'f')}) END",
        "last_name": f"CASE WHEN {natural} THEN initcap({word(key, 9, 'l')}) END",
        "company_name": f"CASE WHEN {natural} THEN NULL ELSE concat(initcap({word(key, 9, 'c')}), ' Bau GmbH') END",
        "email": f"CASE WHEN ({key}) % 5 = 0 THEN concat('p', CAST(({key}) AS STRING), '@haus.example') END",
        "postal_code": f"lpad(CAST(({key}) % 97 AS STRING), 5, '4')",
        "street": f"concat('Gasse ', CAST(({key}) % 1009 AS STRING))",
        "iban_hash": f"CASE WHEN ({key}) % 7 = 0 THEN sha2(CAST(({key}) AS STRING), 256) END",
    }


def columns(made: dict[str, str]) -> list[str]:
    return [f"{v} AS {k}" for k, v in made.items()]


@cat.query("j09_j10_owner_match")
def owner_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of a list against all owners; their names are misspelled, cut or exact. No SQL form."""
    owners = spread(table(spark, sf_dir, "customer").select("c_custkey")).selectExpr("c_custkey AS owner_id", *columns(owner_row("c_custkey")), "array(c_custkey % 5000) AS unit_ids", "c_custkey % 2 = 0 AS in_object")
    made = owner_row("s_suppkey * 13")
    typo = lambda c: f"CASE s_suppkey % 3 WHEN 0 THEN {c} WHEN 1 THEN concat(substr({c}, 1, 3), substr({c}, 5)) ELSE concat(substr({c}, 1, 5), 'x', substr({c}, 6)) END"
    made |= {k: typo(made[k]) for k in ("last_name", "company_name")} | {"email": f"CASE WHEN s_suppkey % 4 = 0 THEN {made['email']} END", "street": f"CASE WHEN s_suppkey % 4 = 1 THEN {made['street']} END"}
    persons = spread(table(spark, sf_dir, "supplier").select("s_suppkey")).selectExpr("s_suppkey AS person_id", *columns(made), "CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey * 13 % 5000 END AS unit_id")
    return fuzzy.owner_match(persons, owners).withColumn("score", F.round("score", 6))


@cat.query("j11_party_search")
def party_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suppliers' keys type into the search for parties: beginnings, misspelled names and parts of names. No SQL form."""
    parties = spread(table(spark, sf_dir, "customer").select("c_custkey")).selectExpr("c_custkey AS party_id", *columns(owner_row("c_custkey"))).withColumn("search_name", text.search_name(F.when(C("kind") == "natural_person", "person").otherwise("company"), C("first_name"), C("last_name"), C("company_name")))
    made = owner_row("s_suppkey * 7")
    name = f"coalesce({made['last_name']}, {made['company_name']})"
    typed = one_of("s_suppkey", f"substr({name}, 1, 2)", f"concat(substr({name}, 1, 4), 'x', substr({name}, 5))", f"upper(substr({name}, 3))", name, "''")
    queries = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS query_id", f"{typed} AS text")
    return fuzzy.party_search(parties, queries).withColumn("score", F.round("score", 6))
