"""Addresses of designations and texts, over designations that are built from the tables' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import addresses, designations, leases
from .base import C, Catalogue, spread, table
from .imports import one_of

cat = Catalogue()
QUERIES, ORACLE_SQL = cat.queries, cat.oracles

NO = "CAST(p_partkey % 190 + 1 AS STRING)"
CODE = "lpad(CAST(p_partkey * 37 % 90000 + 10000 AS STRING), 5, '0')"
NAMES = one_of(
    "p_partkey",
    f"concat('Föhrener Straße ', {NO}, ', Auenstadt')",
    f"concat('Neuweiler, Amselgasse ', {NO}, 'a')",
    f"concat('Am Quell ', {NO}, ' ', {CODE}, ' Auenstadt')",
    f"concat('Nordwall ', {NO}, '-', {NO}, ', ', {CODE}, ' Rheinau (Hof)')",
    f"concat('Gerberstraße ', {NO}, ' u. 81, Ziegelhofstraße ', {NO})",
    f"concat('Talheim Kornblumenstraße ', {NO})",
    "concat('Platz des 3. Mai ', p_brand)",
    f"concat('Auer Str. ', {NO}, '+30 & An der Furt 5')",
    "'  '",
)


@cat.query("f47_addresses_in_name")
def f47_addresses_in_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F47 over every designation; no SQL form."""
    found = designations.addresses_in_name(C("name"))
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS k", f"{NAMES} AS name").select("k", found.alias("f")).select("k", C("f.items").alias("items"), C("f.notes").alias("notes"))


@cat.query("f48_addresses_in_lines")
def f48_addresses_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each designation with two more lines; no SQL form."""
    src = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", f"concat({NAMES}, '\n\n Gerberstraße ', {NO}, '\nohne Nummer 1a2b 3') AS text")
    return src.select("k", designations.addresses_in_lines(C("text")).alias("f")).select("k", C("f.items").alias("items"), C("f.bad").alias("bad"))


STREET, TOWN = addresses.ONE_STREET, addresses.ONE_TOWN
cat.query(
    "y20_complete_address",
    f"""
    WITH s AS (SELECT p_partkey AS k, {NAMES} AS name FROM part),
    c AS (SELECT k, trim(regexp_replace(trim(regexp_replace(name, '\\s*\\([^)]*\\)\\s*', ' ', 'g'), ' ,;'), '\\s+', ' ', 'g')) AS c FROM s),
    p AS (SELECT k, c, list_filter(list_transform(string_split(c, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM c),
    w AS (SELECT *, list_filter(p, lambda x: regexp_matches(x, '{STREET}')) AS streets FROM p),
    o AS (SELECT *, streets[1] AS street, CASE WHEN p[1] = streets[1] THEN p[2] ELSE p[1] END AS town FROM w),
    t AS (SELECT *, len(p) = 2 AND len(streets) = 1 AND regexp_matches(town, '{TOWN}') AS two, len(p) = 1 AND regexp_matches(c, '{addresses.ONE_LINE}') AS one FROM o)
    SELECT k,
           CASE WHEN two THEN trim(regexp_extract(street, '{STREET}', 1)) WHEN one THEN trim(regexp_extract(c, '{addresses.ONE_LINE}', 1)) END AS street,
           CASE WHEN two THEN regexp_extract(street, '{STREET}', 2) WHEN one THEN regexp_extract(c, '{addresses.ONE_LINE}', 2) END AS house_number,
           CASE WHEN two THEN regexp_extract(town, '{TOWN}', 1) WHEN one THEN regexp_extract(c, '{addresses.ONE_LINE}', 3) END AS postal_code,
           CASE WHEN two THEN trim(regexp_extract(town, '{TOWN}', 2)) WHEN one THEN trim(regexp_extract(c, '{addresses.ONE_LINE}', 4)) END AS city
    FROM t""",
)(
    lambda spark, sf_dir: table(spark, sf_dir, "part")
    .selectExpr("p_partkey AS k", f"{NAMES} AS name")
    .select("k", addresses.complete_address(C("name")).alias("a"))
    .select("k", "a.street", "a.house_number", "a.postal_code", "a.city")
)


@cat.query("y33_addresses_in_text")
def y33_addresses_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y33 over whole documents with an address in front and one behind; no SQL form."""
    house = "CAST(doc_id % 190 + 1 AS STRING)"
    text = f"concat('WEG Ulmenpark ', {house}, '\n 12321 Rheinau\n', coalesce(text, ''), '\nan die Mühlstr. ', {house}, ', 54321 Auenstadt, Ulmenpark ', {house}, ', 12321 Rheinau.')"
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).selectExpr("doc_id", f"{text} AS text").select("doc_id", addresses.addresses_in_text(C("text")).alias("a"))
    return found.select("doc_id", F.posexplode("a").alias("place", "a")).select("doc_id", "place", "a.street", "a.house_number", "a.postal_code", "a.city", "a.community")


WORDS = [(role, w) for role, ws in addresses.ROLE_WORDS.items() for w in ws]
ROLE_VALUES = ", ".join(f"({k}, '{role}', '{w}')" for k, (role, w) in enumerate(WORDS))
BEFORE = one_of("o_orderkey", "concat('objekt ', o_orderstatus, ' absender')", "concat('die rechnung an ', o_orderpriority)", "'fahrt zu eigentuemerin, mieter '", "''", "concat('nichts ', o_orderstatus)")
AFTER = one_of("o_orderkey + o_custkey", "'tel. www.haus.example telefon 7'", "'auftraggeber, objekt'", "'mieter'", "''")
cat.query(
    "f56_role_hint",
    f"""
    WITH s AS (SELECT o_orderkey AS k, lower({BEFORE}) AS b, {AFTER} AS a FROM orders),
    w AS (SELECT * FROM (VALUES {ROLE_VALUES}) v(n, role, word)),
    f AS (SELECT k, max((length(b) - instr(reverse(b), reverse(word)) - length(word), -n, role, word)) FILTER (contains(b, word)) AS front,
                 max((-instr(a, word), -n, role, word)) FILTER (contains(a, word) AND role IN ('object', 'billing', 'supplier')) AS behind
          FROM s CROSS JOIN w GROUP BY k)
    SELECT k, coalesce(struct_extract(front, 3), struct_extract(behind, 3), 'neutral') AS role, coalesce(struct_extract(front, 4), struct_extract(behind, 4)) AS word FROM f""",
)(
    lambda spark, sf_dir: table(spark, sf_dir, "orders")
    .selectExpr("o_orderkey AS k", f"{BEFORE} AS b", f"{AFTER} AS a")
    .select("k", addresses.role_hint(F.lower("b"), C("a")).alias("r"))
    .select("k", "r.role", "r.word")
)


START = "CAST(o_orderdate AS DATE)"
LEASE = f"""concat('Mietvertrag. Mietbeginn: ', CAST(day({START}) AS STRING), '.', CAST(month({START}) AS STRING), '.', CAST(year({START}) AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN concat(', befristet bis 31.12.', CAST(year({START}) + 3 AS STRING)) ELSE '' END,
 '. Kaltmiete ', CAST(o_custkey % 900 + 100 AS STRING), ',50 EUR; Nebenkosten: ', CAST(o_custkey % 90 + 10 AS STRING), ',- €; ', CASE o_orderkey % 4 WHEN 0 THEN concat('Kaution ', CAST(o_orderkey % 4000 + 10 AS STRING), ',00 Euro') WHEN 1 THEN 'Kaution: zwei Kaltmieten' ELSE 'keine Sicherheit' END)"""
cat.query(
    "e03_lease_terms",
    f"""
    WITH t AS (SELECT o_orderkey AS k, {LEASE} AS text FROM orders),
    a AS (SELECT k, text, CAST(replace(regexp_extract(text, 'Kaltmiete ([0-9]+,50)', 1), ',', '.') AS DECIMAL(18, 2)) AS rent, CAST(replace(nullif(regexp_extract(text, 'Kaution ([0-9]+,00)', 1), ''), ',', '.') AS DECIMAL(18, 2)) AS told FROM t),
    d AS (SELECT *, coalesce(told, CASE WHEN contains(text, 'zwei Kaltmieten') THEN 2 * rent END) AS deposit FROM a)
    SELECT k, try_strptime(regexp_extract(text, 'Mietbeginn: ([0-9.]+[0-9])', 1), '%d.%m.%Y')::DATE::VARCHAR AS start_date, try_strptime(nullif(regexp_extract(text, 'befristet bis ([0-9.]+[0-9])', 1), ''), '%d.%m.%Y')::DATE::VARCHAR AS end_date,
           rent AS base_rent, CAST(regexp_extract(text, 'Nebenkosten: ([0-9]+)', 1) AS DECIMAL(18, 2)) AS utilities, CAST(CASE WHEN deposit <= 3 * rent THEN deposit END AS DECIMAL(18, 2)) AS deposit
    FROM d""",
)(
    lambda spark, sf_dir: table(spark, sf_dir, "orders")
    .selectExpr("o_orderkey AS k", f"{LEASE} AS text")
    .select("k", leases.lease_terms(C("text")).alias("t"))
    .select("k", C("t.start_date").cast("string").alias("start_date"), C("t.end_date").cast("string").alias("end_date"), C("t.base_rent").alias("base_rent"), C("t.utilities_prepayment").alias("utilities"), C("t.deposit_amount").alias("deposit"))
)
