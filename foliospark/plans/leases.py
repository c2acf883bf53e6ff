"""Parties and units of leases in whole documents: each text gets one more part, in the shapes that leases have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lease_parties
from .base import C, Catalogue, table
from .imports import one_of

cat = Catalogue()
QUERIES, ORACLE_SQL = cat.queries, cat.oracles

FIRST = one_of("doc_id", "'Anna'", "'Karl Otto'", "'Ute'", "'Jean-Luc'")
SECOND = one_of("floor(doc_id / 4)", "'Max'", "'Erika'", "'Bernd'")
LAST = one_of("floor(doc_id / 3)", "'Müller'", "'Weber-Klein'", "'Öz'", "'Sander'", "'Groß'")
OTHER = one_of("floor(doc_id / 7)", "'Abel'", "'Lang'", "'Übel'")
OWN = "Hausverwaltung Beispiel GmbH"
PART = one_of(
    "doc_id",
    f"concat('Mieter: ', {FIRST}, ' ', {LAST})",
    f"concat('zwischen', chr(10), '{OWN}, Hafenallee 13, vertreten durch Tim ', {OTHER}, chr(10), '- nachfolgend Vermieter genannt -', chr(10), chr(10), 'und', chr(10), 'Herrn ', {FIRST}, ' ', {LAST}, ' und Frau ', {SECOND}, ' ', {OTHER}, ', wohnhaft Gasse 1', chr(10), '- nachfolgend Mieter genannt -')",
    f"concat('Vermieter: Otto ', {OTHER}, chr(10), '  Mieterin - ', {LAST}, ' Handels GmbH, Weg 1')",
    f"concat('Mieter: Eheleute ', {FIRST}, ' und ', {SECOND}, ' ', {LAST})",
    f"concat('zwischen Frau Vera ', {OTHER}, ' - nachfolgend Vermieterin genannt - und Herrn ', {FIRST}, ' ', {LAST}, ' - im Folgenden „Mieter“ -')",
    f"concat('Vermieter: Frau Ida ', {LAST}, chr(10), 'Mieter: {OWN}', chr(10), 'Mieter: Herrn ', {SECOND}, ' ', {LAST})",
    f"concat('Name des Mieters: ', {FIRST}, ' ', {LAST}, ', ', {SECOND}, ' ', {OTHER})",
    f"concat('Der Mieter ', {FIRST}, ' zahlt.')",
)
#: The part stands on lines of its own; the text in front of it is out of reach.
TEXT = f"concat(coalesce(text, ''), chr(10), chr(10), repeat('. ', 120), chr(10), chr(10), {PART})"
GREETED = "([A-ZÄÖÜ][^\\s,]*(?: [A-ZÄÖÜ][^\\s,]*)*)"
NAMED = "list_transform(list_filter({x}, lambda n: trim(n) <> ''), lambda n: trim(n))"
PARTIES_ORACLE = f"""
    WITH docs AS (SELECT doc_id, {PART.replace("AS STRING", "AS VARCHAR")} AS part FROM documents),
    lines AS (
        SELECT doc_id, part, regexp_extract(part, '(?m)^Vermieter: (.+)$', 1) AS landlord, regexp_extract_all(part, '(?m)^ *(?:Mieter|Mieterin|Name des Mieters)(?: -|:) (.+)$', 1) AS tenants,
               regexp_extract(part, '(?s)zwischen\\s+(.+?)\\s*- nachfolgend Vermieter', 1) AS before_landlord, regexp_extract(part, '(?s)genannt -\\s+und\\s+(.+?)\\s*- (?:nachfolgend|im Folgenden) .?Mieter', 1) AS before_tenant
        FROM docs),
    raw AS (
        SELECT doc_id, 'landlord' AS role, CASE WHEN landlord <> '' THEN landlord ELSE before_landlord END AS who, 0 AS line FROM lines
        UNION ALL SELECT doc_id, 'tenant', CASE WHEN len(tenants) > 0 THEN tenants[i] ELSE before_tenant END, i FROM lines, (SELECT unnest([1, 2]) AS i) WHERE i = 1 OR i <= len(tenants)),
    people AS (
        SELECT doc_id, role, line, CASE
            WHEN regexp_matches(who, 'GmbH') THEN [regexp_extract(who, '^([^,]+)', 1)]
            WHEN regexp_matches(who, '^Eheleute ') THEN list_transform([regexp_extract(who, '^Eheleute (.+) und', 1), regexp_extract(who, ' und (.+) [^ ]+$', 1)], lambda f: f || ' ' || regexp_extract(who, '([^ ]+)$', 1))
            WHEN regexp_matches(who, '^(Herrn|Frau) ') THEN regexp_extract_all(who, '(?:Herrn|Frau) {GREETED}', 1)
            WHEN who <> '' THEN {NAMED.format(x="string_split(who, ',')")} ELSE [] END AS names
        FROM raw),
    split AS (SELECT doc_id, role, line, generate_subscripts(names, 1) AS nth, regexp_replace(unnest(names), ' und$', '') AS name FROM people),
    named AS (SELECT *, regexp_matches(name, 'GmbH') AS firm, CASE WHEN regexp_matches(name, 'GmbH') THEN name ELSE regexp_extract(name, '([^ ]+)$', 1) END AS known FROM split),
    kept AS (
        SELECT * FROM named n WHERE role = 'landlord' OR known <> '{OWN}' AND NOT EXISTS (SELECT 1 FROM named l WHERE l.doc_id = n.doc_id AND l.role = 'landlord' AND l.known = n.known))
    SELECT doc_id, role, row_number() OVER (PARTITION BY doc_id, role ORDER BY line, nth) AS place,
           CASE WHEN role = 'landlord' THEN NULL WHEN firm THEN 'legal_entity' ELSE 'natural_person' END AS kind, CASE WHEN role = 'tenant' AND NOT firm THEN regexp_replace(name, ' [^ ]+$', '') END AS first, known AS name
    FROM kept"""


@cat.query("e05_y36_lease_parties", PARTIES_ORACLE)
def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants and landlords of all documents, several rows a document."""
    found = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{TEXT} AS text").select("doc_id", lease_parties.lease_parties(C("text"), (OWN,)).alias("p"))
    tenants = F.transform("p.tenants", lambda t: F.struct(F.lit("tenant").alias("role"), t["kind"].alias("kind"), t["first"].alias("first"), F.coalesce(t["company"], t["last"]).alias("name")))
    landlords = F.transform("p.landlords", lambda n: F.struct(F.lit("landlord").alias("role"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("first"), n.alias("name")))
    rows = [found.select("doc_id", F.posexplode(a).alias("place", "party")) for a in (tenants, landlords)]
    return rows[0].unionByName(rows[1]).select("doc_id", "party.role", (C("place") + 1).cast("long").alias("place"), "party.kind", "party.first", "party.name")


NO = "CAST(doc_id % 40 + 1 AS STRING)"
UNIT = one_of(
    "doc_id",
    f"concat('Vermietet wird die Wohnung Nr. ', {NO}, ' im 2. OG links.')",
    f"concat('Garage ', {NO}, '. Mietobjekt: Gewerbeeinheit GE ', {NO}, ', Erdgeschoss rechts')",
    f"concat('TG ', {NO}, ' liegt neben dem Haus; Mietsache: Dachgeschoss Links, Gasse ', {NO})",
    f"concat('im ', CAST(doc_id % 9 AS STRING), '. Stock; WE', {NO}, 'b')",
    f"concat('EG mitte, {'. ' * 30} Mietgegenstand Stellplatz', {NO})",
    f"concat('Mietgegenstand {'. ' * 50} EG, UG rechts')",
    "'Erdgeschosswohnung ohne Nummer'",
)
SHORT = "CASE lower({x}) WHEN 'wohnung' THEN 'WE' WHEN 'we' THEN 'WE' WHEN 'ge' THEN 'GE' WHEN 'gewerbeeinheit' THEN 'GE' WHEN 'garage' THEN 'Garage' WHEN 'tg' THEN 'TG' WHEN 'stellplatz' THEN 'Stellplatz' WHEN 'erdgeschoss' THEN 'EG' WHEN 'dachgeschoss' THEN 'DG' ELSE upper({x}) END"
KINDS = [
    r"\b(?:wohnung|we|ge|gewerbeeinheit|garage|tg|stellplatz) ?(?:nr\. ?)?[0-9]{1,4}[a-z]?\b",
    r"\b[0-9]\. (?:og|stock)\b(?: (?:links|rechts|mitte)\b)?",
    r"\b(?:erdgeschoss|dachgeschoss|eg|dg|ug)\b(?: (?:links|rechts|mitte)\b)?",
]
UNIT_ORACLE = f"""
    WITH docs AS (SELECT doc_id, {UNIT.replace("AS STRING", "AS VARCHAR")} AS part FROM documents),
    found AS ({' UNION ALL '.join(f"SELECT doc_id, part, {k} AS kind, unnest(regexp_extract_all(part, '(?i){p}')) AS hit FROM docs" for k, p in enumerate(KINDS))}),
    scored AS (
        SELECT *, strpos(part, hit) AS pos, regexp_matches(substr(part, greatest(1, strpos(part, hit) - 80), least(80, strpos(part, hit) - 1)), '(?i)mietsache|mietobjekt|mietgegenstand|vermietet') AS near FROM found),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY near DESC, kind, pos) AS k FROM scored),
    shown AS (
        SELECT doc_id, CASE kind WHEN 0 THEN {SHORT.format(x="regexp_extract(hit, '^([A-Za-z]+?) ?(?:Nr|[0-9])', 1)")} || ' ' || upper(regexp_extract(hit, '([0-9]+[a-zA-Z]?)$', 1))
                    WHEN 1 THEN substr(hit, 1, 1) || '. OG' || CASE WHEN regexp_matches(hit, '(?i)(links|rechts|mitte)$') THEN ' ' || lower(regexp_extract(hit, '([a-zA-Z]+)$', 1)) ELSE '' END
                    ELSE {SHORT.format(x="regexp_extract(hit, '^([A-Za-z]+)', 1)")} || CASE WHEN contains(hit, ' ') THEN ' ' || lower(regexp_extract(hit, '([a-zA-Z]+)$', 1)) ELSE '' END END AS unit
        FROM best WHERE k = 1)
    SELECT doc_id, unit FROM docs LEFT JOIN shown USING (doc_id)"""


@cat.query("e06_unit_hint", UNIT_ORACLE)
def unit_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit that a lease is about, of all that its text names."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{UNIT} AS part").select("doc_id", lease_parties.unit_hint(C("part")).alias("unit"))
