"""Extraction, matching, rules and classification over the texts of the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import evidence
from ..operators import classifier, fuzzy, mapping, records, rules
from ..sources import formats, tables
from .base import C, Catalogue, spread, table
from .imports import one_of

cat = Catalogue()
QUERIES, ORACLE_SQL = cat.queries, cat.oracles

RULES = [
    {"id": "r1", "priority": 10, "when": {"text": ["\\bthe\\b"], "any_of": [{"filename": ["src[1-5]$"]}, {"text": ["\\bund\\b"]}]}, "then": {"category": "03", "confidence": 0.9, "hard": True}},
    {"id": "r2", "priority": 10, "when": {"text": ["\\bque\\b", "\\bder\\b"]}, "then": {"category": "05", "confidence": 0.8, "hard": True}},
    {"id": "r3", "priority": 5, "when": {"subject": ["an"]}, "then": {"category": "07", "confidence": 0.9, "hard": True}},
]


@cat.query("e09_e10_u04_rules", r"""
    WITH h AS (SELECT doc_id, regexp_matches(text, '(?i)(^|[^\pL\pN_])(the)($|[^\pL\pN_])') AND (regexp_matches(source, '(?i)src[1-5]$') OR regexp_matches(text, '(?i)(^|[^\pL\pN_])(und)($|[^\pL\pN_])')) AS r1, regexp_matches(text, '(?i)(^|[^\pL\pN_])(que|der)($|[^\pL\pN_])') AS r2, regexp_matches(substr(text, 1, 20), '(?i)an') AS r3 FROM documents)
    SELECT doc_id, r1 AND r2 AS conflict, CASE WHEN r1 AND r2 THEN NULL WHEN r1 THEN '03' WHEN r2 THEN '05' WHEN r3 THEN '07' END AS rule_category, CASE WHEN r1 AND r2 THEN NULL WHEN r1 THEN 0.9 WHEN r2 THEN 0.8 WHEN r3 THEN 0.6 END::DOUBLE AS rule_confidence FROM h""")
def rule_stage(spark, sf_dir):
    """Rules as one projection."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 1, 20).alias("subject"), C("source").alias("filename"), F.lit("x").alias("management_type"))
    return rules.evaluate(d, RULES).select("doc_id", "conflict", "rule_category", C("rule_confidence").cast("double").alias("rule_confidence"))


@cat.query("e15_e16_e17_decision", r"""
    WITH d AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT doc_id, CASE WHEN toxic = 1 THEN 'review' WHEN quality IS NULL AND n_chars < 500 THEN 'misc' WHEN quality = 1 THEN 'file' WHEN quality = 0 THEN 'review' ELSE 'stage3' END AS action, substr(concat_ws(':', source, lang, CASE WHEN quality = 1 THEN '05' ELSE '' END), 1, 120) AS batch_key FROM d""")
def decision(spark, sf_dir):
    """The branch table of the final decision and its group key."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    action = records.final_action(C("toxic") == 1, C("quality"), C("n_chars") < 500, C("quality") == 1)
    return d.select("doc_id", action.alias("action"), records.batch_key(C("source"), C("lang"), F.when(C("quality") == 1, "05").otherwise("")).alias("batch_key"))


EVIDENCE = "SELECT l_orderkey AS document_id, l_suppkey % 4 AS object_id, CASE l_linenumber % 3 WHEN 0 THEN 'address' WHEN 1 THEN 'number' ELSE 'folder' END AS kind, CASE WHEN l_linenumber % 3 = 0 THEN l_discount * 8 ELSE l_tax END AS weight, l_linenumber % 3 = 0 AND l_discount > 0.07 AS strong, l_partkey % 5 AS address_key FROM lineitem"


@cat.query("e24_e25_f60_candidates", f"""
    WITH e AS ({EVIDENCE}), a AS (SELECT DISTINCT document_id, object_id FROM e WHERE kind <> 'address' AND weight > 0), s AS (SELECT document_id, address_key, count(DISTINCT object_id) AS n FROM e WHERE kind = 'address' GROUP BY 1, 2),
    r AS (SELECT e.*, row_number() OVER (PARTITION BY e.document_id, e.object_id, kind ORDER BY weight DESC, e.address_key) AS k, CASE WHEN kind = 'address' AND s.n > 1 AND a.object_id IS NULL THEN weight / 2 ELSE weight END AS halved FROM e LEFT JOIN a USING (document_id, object_id) LEFT JOIN s ON s.document_id = e.document_id AND s.address_key = e.address_key),
    u AS (SELECT *, CASE WHEN kind = 'address' AND k > 3 THEN 0 WHEN kind = 'address' AND k > 1 AND weight > 0 THEN 0.05 ELSE halved END AS used FROM r)
    SELECT document_id, object_id, round(1 - product(1 - least(used, 1)), 6) AS score, bool_or(strong) AS strong FROM u GROUP BY 1, 2""")
def candidates(spark, sf_dir):
    """Evidence to candidate scores; address weights change before the fold."""
    e = table(spark, sf_dir, "lineitem").select(
        C("l_orderkey").alias("document_id"), (C("l_suppkey") % 4).alias("object_id"), F.when(C("l_linenumber") % 3 == 0, "address").when(C("l_linenumber") % 3 == 1, "number").otherwise("folder").alias("kind"),
        F.when(C("l_linenumber") % 3 == 0, C("l_discount") * 8).otherwise(C("l_tax")).alias("weight"), ((C("l_linenumber") % 3 == 0) & (C("l_discount") > 0.07)).alias("strong"), (C("l_partkey") % 5).alias("address_key"))
    return rules.score_candidates(e).select("document_id", "object_id", F.round("score", 6).alias("score"), "strong")


@cat.query("e27_cross_check", "SELECT l_orderkey, CASE WHEN bool_or(l_linenumber > 1 AND l_discount > 0.08) THEN 'second_reference' WHEN max(l_discount) = 0 THEN 'no_reference' WHEN NOT bool_or(l_linenumber = 1 AND l_discount >= 0.03) THEN 'weak_reference' ELSE 'clear' END AS kind FROM lineitem GROUP BY 1")
def cross_check(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (C("l_discount") * 10).alias("score"), (C("l_discount") > 0.08).alias("strong"))
    return rules.cross_check(l, "l_orderkey", C("l_linenumber") == 1)


@cat.query("e08_m07_context", "SELECT conv_id, string_agg(role, ',' ORDER BY f) AS roles FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2) GROUP BY 1")
def context(spark, sf_dir):
    """Ids in the order of their first occurrence."""
    return records.in_order_of_appearance(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@cat.query("e07_merge_facts", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END) AS fact FROM orders")
def merge_facts(spark, sf_dir):
    fact = records.merged(F.when(C("o_orderkey") % 2 == 0, C("o_orderstatus")), F.when(C("o_orderkey") % 3 == 0, C("o_orderpriority")))
    return table(spark, sf_dir, "orders").select("o_orderkey", fact.alias("fact"))


LEASE = "concat('Kaltmiete: ', CAST(o_orderkey % 9 + 1 AS VARCHAR), '.', lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0'), ',50 EUR; Kaution ', CAST(o_orderkey % 900 + 100 AS VARCHAR), ',00; Kundennummer: K-', CAST(o_custkey AS VARCHAR), '; vom ', CAST(day(o_orderdate) AS VARCHAR), '.', CAST(month(o_orderdate) AS VARCHAR), '.', CAST(year(o_orderdate) AS VARCHAR))"


def lease_texts(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", LEASE.replace("AS VARCHAR", "AS STRING") + " AS text")


@cat.query("e01_e04_f57_extraction", "SELECT o_orderkey AS k, concat(CAST(o_orderkey % 9 + 1 AS VARCHAR), '.', lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0'), ',50') AS rent, concat(CAST(o_orderkey % 900 + 100 AS VARCHAR), ',00') AS deposit, CASE WHEN o_custkey > 9 THEN 'k' || o_custkey END AS customer, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def extraction(spark, sf_dir):
    """Amounts by label, numbers by context word and dates of a text."""
    t = lease_texts(spark, sf_dir).withColumns({"a": rules.amounts(C("text")), "n": rules.numbers(C("text")), "d": rules.dates(C("text"))})
    pick = lambda label: F.try_element_at(F.filter("a", lambda x: x["label"] == label), F.lit(1))["amount"]
    return t.select("k", pick("kaltmiete").alias("rent"), pick("kaution").alias("deposit"), F.try_element_at("n", F.lit(1))["value"].alias("customer"), F.try_element_at("d", F.lit(1)).cast("string").alias("day"))


@cat.query("f59_keyword_groups", "SELECT doc_id, contains(text, 'the') OR contains(text, 'and') AS en, contains(text, 'und') AS de FROM documents")
def keyword_groups(spark, sf_dir):
    g = rules.keyword_groups(C("text"), {"en": ["the", "and"], "de": ["und"]})
    return table(spark, sf_dir, "documents").select("doc_id", F.map_contains_key(g, "en").alias("en"), F.map_contains_key(g, "de").alias("de"))


@cat.query("j15_e02_gazetteer", r"WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents) SELECT doc_id, n_nationkey, count(*) AS hits FROM w JOIN (SELECT n_nationkey, (['the', 'of', 'der', 'que', 'la'])[n_nationkey % 5 + 1] AS w FROM nation) USING (w) GROUP BY ALL")
def gazetteer(spark, sf_dir):
    """Dictionary words in texts by a join on tokens."""
    n = table(spark, sf_dir, "nation").select(C("n_nationkey").alias("object_id"), F.element_at(F.array(*map(F.lit, ("the", "of", "der", "que", "la"))), C("n_nationkey") % 5 + 1).alias("street_key"), F.lit(1).alias("number"))
    pages = table(spark, sf_dir, "documents").select(C("doc_id").alias("page_id"), F.lower("text").alias("text"))
    return rules.gazetteer_hits(pages, n).groupBy(C("page_id").alias("doc_id"), C("object_id").alias("n_nationkey")).agg(F.count("*").alias("hits"))


FILE_NAME = one_of("page_id", "'a.PDF'", "'b.tmp'", "'c'", "'d.xyz'", "'e.Jpeg'", "'f.docx'", "'g.html'", "'h.eml'", "'i.xls'", "'j.crdownload'", "'k.tar.gz'", "'l.hed'", "'m.Indir'", "'n.herunterladen'")
MEDIA = one_of("page_id", "'application/octet-stream'", "'image/png'", "'text/html'", "'application/pdf'", "'message/rfc822'", "'application/vnd.google-apps.document'")
FILE_TEXT = one_of("page_id", "html", "concat(chr(10), '%PDF-1.7 ', url)", "concat('From: a@b.example', chr(10), 'Subject: ', url, chr(10), chr(10), 'x')", "'plain'")


@cat.query("s18_s19_kinds", f"""
    WITH f AS (SELECT page_id, {FILE_NAME} AS name, {MEDIA} AS mime, {FILE_TEXT} AS body FROM pages),
    x AS (SELECT *, lower(regexp_extract(name, '[.]([^.]+)$', 1)) AS suffix FROM f),
    n AS (SELECT *, CASE WHEN mime = 'application/vnd.google-apps.document' THEN 'google_doc' WHEN suffix = 'pdf' THEN 'pdf'
              WHEN suffix IN ('jpg', 'jpeg', 'png', 'tif', 'tiff', 'gif', 'bmp', 'webp') THEN 'image' WHEN suffix IN ('docx', 'xlsx', 'odt', 'ods', 'csv', 'txt') THEN 'office'
              WHEN suffix IN ('eml', 'msg') THEN 'email' WHEN suffix IN ('html', 'htm') THEN 'html' WHEN suffix IN ('doc', 'xls', 'ppt', 'rtf') THEN 'office_legacy'
              WHEN starts_with(mime, 'image/') THEN 'image' WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime = 'text/html' THEN 'html' WHEN mime = 'message/rfc822' THEN 'email' ELSE 'unsupported' END AS by_name FROM x),
    o AS (SELECT *, by_name = 'unsupported' OR suffix IN ('', 'tmp', 'herunterladen', 'indir', 'hed', 'part', 'crdownload') AS odd FROM n)
    SELECT page_id, odd AS content_checked, CASE WHEN NOT odd THEN by_name WHEN contains(substr(body, 1, 1024), '%PDF') THEN 'pdf' WHEN starts_with(lower(ltrim(body)), '<html') OR starts_with(lower(ltrim(body)), '<!doctype html') THEN 'html'
              WHEN starts_with(body, 'From:') THEN 'email' ELSE 'unsupported' END AS kind FROM o""")
def kinds(spark, sf_dir):
    """The name decides, the content where the name says nothing or is temporary."""
    f = table(spark, sf_dir, "pages").selectExpr("page_id", f"{FILE_NAME} AS name", f"{MEDIA} AS mime", f"{FILE_TEXT} AS body")
    checked = formats.kind_checked(C("name"), C("mime"), C("body").cast("binary"))
    return f.select("page_id", checked.alias("c")).select("page_id", "c.content_checked", "c.kind")


@cat.query("s20_s21_sniff", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'email' WHEN 2 THEN 'png' END AS kind FROM pages")
def sniff(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    b = F.when(C("page_id") % 4 == 0, C("html").cast("binary")).when(C("page_id") % 4 == 1, F.lit("From: a@b.example\nSubject: x\n\nhello").cast("binary")).when(C("page_id") % 4 == 2, F.unhex(F.lit("89504E470D0A1A0A00"))).otherwise(F.lit("plain").cast("binary"))
    return p.select("page_id", formats.kind_by_content(b).alias("kind"))


@cat.query("s23_digital_pages", "SELECT doc_id, CASE WHEN n_chars < 300 THEN 'too_few_chars' WHEN doc_id % 10 < 2 THEN 'garbage_text_layer' WHEN doc_id % 7 = 0 THEN 'full_page_image' ELSE 'text_layer' END AS reason FROM documents")
def digital(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", formats.digital_page(C("n_chars"), (C("doc_id") % 10) / 4, F.when(C("doc_id") % 7 == 0, 0.95).otherwise(0.1), least=300).alias("reason"))


@cat.query("s26_s28_html_text")
def html_text(spark, sf_dir):
    """Text of pages by a tolerant parser; no SQL form."""
    return table(spark, sf_dir, "pages").select("page_id", formats.html_to_text(C("html")).alias("text"))


HEADED = one_of("turn", "concat('Von: Max ', CAST(turn AS STRING), ' <MAX', CAST(turn AS STRING), '@haus.example>', chr(10), 'An: x', chr(10), 'Betreff: Betr ', CAST(conv_id AS STRING), chr(10), chr(10), 'Betreff: other')", "concat('Betreff:  ', role, chr(10), 'Von: ', role, '@Mail.example', chr(10), 'Datum: heute', chr(10))", "concat('Guten Tag', chr(10), chr(10), 'Von: niemand')", "coalesce(text, '')")
HEAD = "regexp_replace(x, '\\n\\s*\\n[\\s\\S]*$', '')"


def headed(name: str) -> str:
    return f"nullif(trim(regexp_extract(array_to_string(string_split({HEAD}, chr(10))[:8], chr(10)), '(?m)^{name}:(.*)$', 1)), '')"


@cat.query("s30_header_block", f"""
    WITH p AS (SELECT conv_id, turn, {HEADED} AS x FROM conversations)
    SELECT conv_id, turn, {headed("Betreff")} AS subject, nullif(trim(regexp_extract({headed("Von")}, '^([^<]*)<', 1)), '') AS from_name,
           lower(nullif(regexp_extract({headed("Von")}, '([^\\s<>]+@[^\\s<>]+)', 1), '')) AS from_address, {headed("Datum")} AS date FROM p""")
def header_block(spark, sf_dir):
    """Fields from the head of a page that begins like a message."""
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{HEADED} AS x")
    h = formats.header_block(C("x"))
    return c.select("conv_id", "turn", h["subject"].alias("subject"), h["from_name"].alias("from_name"), h["from_address"].alias("from_address"), h["date"].alias("date"))


@cat.query("s06_s07_s08_profiles", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'vendor' WHEN 1 THEN 'contacts' ELSE 'generic' END AS profile FROM part")
def profiles(spark, sf_dir):
    """The profile whose headings fit best."""
    header = F.split(F.when(C("p_partkey") % 3 == 0, "Objekt;Einheit;Mieter").when(C("p_partkey") % 3 == 1, "Name;Telefon;E-Mail").otherwise("a;b"), ";")
    best = tables.profile_scores(header, {"contacts": (["name", "telefon", "e-mail"], 2, 0.9), "vendor": (["objekt", "einheit", "mieter", "miete"], 3, 0.95)})
    return table(spark, sf_dir, "part").select("p_partkey", best["name"].alias("profile"))


@cat.query("s16_s17_merge_pages", """
    WITH r AS (SELECT conv_id, turn, unnest([1, 2, 3, 4]) AS k, text, role FROM conversations),
    c AS (SELECT conv_id, turn, CASE k WHEN 1 THEN ['Name', 'Ort'] WHEN 2 THEN [role, coalesce(text, '')] WHEN 3 THEN ['', 'Seite ' || turn] ELSE ['Name', 'Ort'] END AS cells, k FROM r)
    SELECT conv_id, turn, cells[1] AS a, cells[2] AS b FROM c WHERE k IN (2, 4) OR k = 1 AND turn = 0""")
def merge_pages(spark, sf_dir):
    """Heading rows repeated at the start of later pages go, and so do page numbers; the same row further down stays."""
    rows = F.array(F.array(F.lit("Name"), F.lit("Ort")), F.array(C("role"), F.coalesce("text", F.lit(""))), F.array(F.lit(""), F.concat(F.lit("Seite "), C("turn").cast("string"))), F.array(F.lit("Name"), F.lit("Ort")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(rows).alias("row_no", "cells"))
    kept = tables.merge_pages(c.withColumn("page", C("turn") + 1), "conv_id", lead=1)
    return kept.select("conv_id", "turn", C("cells")[0].alias("a"), C("cells")[1].alias("b"))


@cat.query("s13_s15_row_cells", """
    WITH w AS (SELECT event_id // 64 AS page, event_type AS text, event_id * 37 % 900 AS x0, event_id % 13 * 10 + event_id % 3 AS top, value AS conf, event_id % 13 AS line FROM events),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY line) - 1 AS row_no, CASE WHEN x0 + 3 >= 500 THEN 2 WHEN x0 + 3 >= 200 THEN 1 ELSE 0 END AS column_no FROM w)
    SELECT page, row_no, column_no, string_agg(text, ' ' ORDER BY x0, text) AS text, count(*) AS words, ((2 * sum(round(conf * 100)::BIGINT) + 10 * count(conf)) // (20 * count(conf)))::BIGINT / 10 AS conf FROM r GROUP BY 1, 2, 3""")
def row_cells(spark, sf_dir):
    """The words of each page to rows, by their tops, and to cells, by the columns' bounds."""
    left, top = (C("event_id") * 37 % 900).cast("double"), (C("event_id") % 13 * 10 + C("event_id") % 3).cast("double")
    w = table(spark, sf_dir, "events").select(F.floor(C("event_id") / 64).alias("page"), C("event_type").alias("text"), left.alias("x0"), (left + 6).alias("x1"), top.alias("top"), (top + 8).alias("bottom"), C("value").alias("conf"))
    cells = tables.build_cells(tables.row_clusters(w, "page"), F.array(F.lit(200.0), F.lit(500.0)))
    return cells.select("page", "row_no", "column_no", "text", F.size(F.split("text", " ")).alias("words"), "conf")


#: Customers of a nation that one task scores for a supplier at a time.
FUZZY_BLOCK = 2048


@cat.query("j08_j09_j10_j11_fuzzy_join")
def fuzzy_join(spark, sf_dir):
    """J08 and the name score of J09, J10: suppliers to customers of the same nation by name similarity, every pair scored; rows only.

    The tables have no signal for J09 but the shared nation, which counts as the address, and no first names for
    J10. A nation's customers form blocks whose number grows with them; the two best of each block meet at the end.
    """
    s = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("l"), F.lower("s_name").alias("a"), C("s_nationkey").alias("n"))
    c = table(spark, sf_dir, "customer").select(C("c_custkey").alias("r"), F.lower("c_name").alias("b"), C("c_nationkey").alias("n"))
    two = fuzzy.best_two(s, c, "n", fuzzy.WEIGHTS["same_address"], FUZZY_BLOCK).select(C("l").alias("s_suppkey"), C("r").alias("c_custkey"), "score")
    best = [C("score").desc(), "c_custkey"]
    w = Window.partitionBy("s_suppkey").orderBy(*best)
    ranked = two.withColumns({"rank": F.row_number().over(w), "second": F.lead("score").over(w)}).where("rank = 1")
    return ranked.select("s_suppkey", "c_custkey", F.round("score", 6).alias("score"), evidence.verdict(C("score") / 100, C("second") / 100, F.lit(False)).alias("outcome"))


@cat.query("e18_e22_classifier")
def trained_stage(spark, sf_dir):
    """A model trained on labelled documents, applied to all of them; no SQL form."""
    d, l = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), table(spark, sf_dir, "labels")
    text = classifier.input_text(F.array("source"), C("text"))
    samples = d.join(l, "doc_id").select(C("doc_id").alias("id"), text.alias("text"), C("quality").cast("string").alias("label"))
    model = classifier.fitted(classifier.with_weights(samples), 1 << 12)
    return classifier.predict(model, d.select("doc_id", text.alias("text"))).select("doc_id", "top", F.round("p", 6).alias("p"), F.round("gap", 6).alias("gap"))


@cat.query("w07_propose_mapping")
def propose_mapping(spark, sf_dir):
    """Columns to targets, one to one, within each list of ten columns; no SQL form."""
    p = table(spark, sf_dir, "part").select(F.floor(C("p_partkey") / 10).alias("list"), C("p_partkey").alias("column"), C("p_size").alias("z"))
    pairs = p.withColumn("target", F.explode(F.array(C("column"), C("column") + 1))).withColumn("score", (C("column") % 7 + C("z") % 3 + (C("target") % 2) * 0.5).cast("double"))
    return mapping.propose(pairs, "list", "column", "target", "score")


@cat.query("f29_content_scores", "SELECT source, round(avg(CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 1 ELSE 0 END), 6) AS digits, round(avg(CASE WHEN contains(text, '@') THEN 1 ELSE 0 END), 6) AS mail FROM documents GROUP BY 1")
def content_scores(spark, sf_dir):
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return table(spark, sf_dir, "documents").groupBy("source").agg(share(C("text").rlike("[0-9]{4}")).alias("digits"), share(C("text").contains("@")).alias("mail"))


@cat.query("f06_pattern_count", "SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '[0-9]{12,16}')")
def pattern_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count_if(C("text").rlike("[0-9]{12,16}")).alias("n"))


@cat.query("f36_collisions", "SELECT p_partkey, CASE WHEN n = 1 THEN p_brand ELSE p_brand || '_' || n END AS name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def collisions(spark, sf_dir):
    """equal names of one batch get counters in the order of their ids."""
    return records.numbered_names(table(spark, sf_dir, "part"), "p_brand", "p_partkey").select("p_partkey", C("unique_name").alias("name"))
