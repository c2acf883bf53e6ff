"""Aggregations, key figures, completeness, audits and selections over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import periods
from ..operators import checks, pages, records, reports
from .base import C, Catalogue, table

cat = Catalogue()
QUERIES, ORACLE_SQL = cat.queries, cat.oracles
TODAY = "1998-09-01"


@cat.query("a01_a02_key_figures", f"""
    WITH d AS (SELECT l_suppkey AS object_id, count(*) AS documents, CAST(sum(l_quantity) AS BIGINT) AS pages, count(*) FILTER (l_returnflag = 'N') AS filed, count(*) FILTER (l_linenumber = 7) AS misc FROM lineitem GROUP BY 1),
    c AS (SELECT o_custkey % 100 + 1 AS object_id, count(*) FILTER (o_orderstatus = 'O') AS open_cases, median(DATE '{TODAY}' - CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'O') AS median_age, count(*) FILTER (o_orderstatus = 'F') AS resolved, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS confirmed, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cost FROM orders GROUP BY 1)
    SELECT object_id, documents, pages, open_cases, CAST(median_age AS DOUBLE) AS median_age, cost, CAST(CASE WHEN documents > 0 THEN round_even(100.0 * misc / documents, 2) END AS DOUBLE) AS misc_share, CAST(CASE WHEN resolved > 0 THEN round_even(100.0 * confirmed / resolved, 2) END AS DOUBLE) AS hit_rate FROM d LEFT JOIN c USING (object_id)""")
def key_figures(spark, sf_dir):
    docs = table(spark, sf_dir, "lineitem").select(C("l_suppkey").alias("object_id"), F.when(C("l_returnflag") == "N", "filed").otherwise("other").alias("status"), F.when(C("l_linenumber") == 7, "99").otherwise("01").alias("category"), F.lit("stage1").alias("decided_by"), C("l_quantity").cast("long").alias("pages"))
    o = table(spark, sf_dir, "orders").withColumn("object_id", C("o_custkey") % 100 + 1)
    cases = o.select("object_id", F.when(C("o_orderstatus") == "O", "open").otherwise("done").alias("status"), C("o_orderdate").cast("date").alias("created_on"), F.when(C("o_orderstatus") == "F", F.lit(1)).alias("resolved_on"), ((C("o_orderstatus") == "F") & (C("o_orderpriority") == "1-URGENT")).alias("confirmed"))
    costs = o.select("object_id", F.round(C("o_totalprice") * 100).cast("long").alias("cost"))
    k = reports.key_figures(docs, cases, costs, periods.day(TODAY))
    return k.select("object_id", "documents", "pages", "open_cases", C("median_age").cast("double").alias("median_age"), "cost", C("misc_share").cast("double").alias("misc_share"), C("hit_rate").cast("double").alias("hit_rate"))


@cat.query("a05_a31_queue_figures", "SELECT user_id, count(*) FILTER (event_type = 'error') AS open, count(*) FILTER (event_type = 'error' AND ts < TIMESTAMP '2024-01-15') AS older, count(*) FILTER (event_type = 'error' AND value > 50) AS with_candidates FROM events GROUP BY 1")
def queue(spark, sf_dir):
    return records.queue_figures(table(spark, sf_dir, "events"), "user_id", C("event_type") == "error", C("ts"), F.lit("2024-01-15").cast("timestamp"), C("value") > 50)


@cat.query("a06_progress_pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error, count(*) AS total FROM events GROUP BY 1")
def progress(spark, sf_dir):
    return reports.progress(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "view", "error"])


@cat.query("a07_run_figures", "SELECT o_custkey, count(*) AS documents, round(count(*) FILTER (o_orderstatus = 'P') / count(*)::DOUBLE, 6) AS misc, round(count(*) / greatest(0.001, (max(epoch(o_orderdate)) - min(epoch(o_orderdate))) / 60), 6) AS per_minute FROM orders GROUP BY 1")
def run_figures(spark, sf_dir):
    return records.run_figures(table(spark, sf_dir, "orders"), "o_custkey", C("o_orderstatus") == "P", C("o_orderdate"))


@cat.query("a11_lease_ends", "SELECT o_custkey, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS start, CAST(CASE WHEN count(*) = count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) THEN max(CAST(o_orderdate AS DATE)) END AS VARCHAR) AS ends FROM orders GROUP BY 1")
def lease_ends(spark, sf_dir):
    day = C("o_orderdate").cast("date")
    found = records.lease_ends(table(spark, sf_dir, "orders"), "o_custkey", day, F.when(C("o_orderstatus") != "P", day))
    return found.select("o_custkey", C("start").cast("string"), C("ends").cast("string"))


@cat.query("a15_a16_costs", "SELECT o_custkey, o_orderpriority, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cost, count(*) AS calls, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_call FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2")
def costs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(C("o_orderdate") >= F.lit("1996-01-01").cast("timestamp"))
    return records.costs(o, ["o_custkey", "o_orderpriority"], F.round(C("o_totalprice") * 100).cast("long"), C("o_orderdate").cast("date")).withColumn("last_call", C("last_call").cast("string"))


@cat.query("a17_job_report", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total, max(event_id) AS longest, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def job_report(spark, sf_dir):
    return records.job_report(table(spark, sf_dir, "events"), "event_type", "event_id", "user_id")


@cat.query("a18_top_histogram", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 12")
def histogram(spark, sf_dir):
    return records.top_values(table(spark, sf_dir, "documents"), "source", 12)


@cat.query("a19_a20_metrics", "SELECT CAST(CASE WHEN GROUPING(h) = 1 THEN 'all' WHEN h THEN 'holdout' ELSE 'training' END AS VARCHAR) AS part, count(*) AS n, round(count(*) FILTER (quality = 1) / nullif(count(*), 0)::DOUBLE, 4) AS hit_rate, round(count(*) FILTER (toxic = 1) / nullif(count(*) FILTER (quality = 1), 0)::DOUBLE, 4) AS reject_rate FROM (SELECT *, doc_id % 5 = 0 AS h FROM labels) GROUP BY GROUPING SETS ((), (h))")
def metrics(spark, sf_dir):
    """Rates over all rows and over the holdout, by grouping sets."""
    return records.hit_rates(table(spark, sf_dir, "labels"), C("doc_id") % 5 == 0, C("quality") == 1, C("toxic") == 1)


@cat.query("a21_a22_a28_state_summary", "SELECT user_id, count(*) FILTER (event_type IN ('click', 'view')) AS queue, count(*) FILTER (event_type = 'error') AS failed, CAST(min(ts) FILTER (event_type = 'click') AS VARCHAR) AS oldest FROM events GROUP BY 1")
def state_summary(spark, sf_dir):
    found = records.state_summary(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "view"], "error", "click", "ts")
    return found.withColumn("oldest", C("oldest").cast("string"))


@cat.query("a23_class_readiness", "SELECT bool_and(w >= 2) AS ready FROM (SELECT source, sum(CASE WHEN n_chars > 500 THEN 1 ELSE 0.5 END) AS w FROM documents GROUP BY 1)")
def readiness(spark, sf_dir):
    return records.class_readiness(table(spark, sf_dir, "documents"), "source", F.when(C("n_chars") > 500, 1.0).otherwise(0.5), 2)


@cat.query("a24_a25_y34_address_candidates", "WITH g AS (SELECT c_mktsegment AS street, c_nationkey AS plz, count(*) AS n FROM customer GROUP BY 1, 2) SELECT street, min_by(plz, (-n, plz)) AS plz, max(n) AS hits, max(n) >= 2 * coalesce(list_sort(list(n), 'DESC')[2], 0) AS clear FROM g GROUP BY 1")
def address_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(C("c_mktsegment").alias("street"), C("c_nationkey").alias("plz"))
    return records.best_with_margin(c, "street", "plz")


@cat.query("a27_audit_pivot", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY 1")
def audit_pivot(spark, sf_dir):
    return records.pivot_counts(table(spark, sf_dir, "documents"), "source", "lang", ["en", "de", "fr", "es"])


@cat.query("a29_case_counters", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, GROUPING(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))")
def case_counters(spark, sf_dir):
    return records.subtotals(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@cat.query("a30_y28_open_by_type", "SELECT o_orderstatus || '/' || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE o_orderpriority END AS kind, count(*) AS n FROM orders GROUP BY 1")
def open_by_type(spark, sf_dir):
    return records.compound_counts(table(spark, sf_dir, "orders"), C("o_orderstatus"), F.when(C("o_custkey") % 3 != 0, C("o_orderpriority")))


@cat.query("a33_unit_totals", "SELECT p_brand, count(*) AS units, count(*) = 80 AS expected, CAST(sum(p_size) AS BIGINT) AS shares, count(DISTINCT p_type) = 1 AS single_base FROM part GROUP BY 1")
def unit_totals(spark, sf_dir):
    return records.unit_totals(table(spark, sf_dir, "part"), "p_brand", "p_size", "p_type", F.lit(80))


@cat.query("a34_content_hash", "SELECT o_custkey, sha256(string_agg(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), o_orderstatus), chr(10) ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1")
def content_hash(spark, sf_dir):
    return reports.canonical_digest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"])


@cat.query("a35_letter", "SELECT c_nationkey, string_agg('- ' || c_mktsegment || ': ' || n, chr(10) ORDER BY c_mktsegment) AS body, sum(n) > 25 AS attachment FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def letter(spark, sf_dir):
    """Items by category as lines of a letter; long lists become an attachment."""
    return records.letter(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", 25)


@cat.query("a36_top_candidates", "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_quantity DESC, l_linenumber) AS top FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS n FROM lineitem) WHERE n <= 3 GROUP BY 1")
def top_candidates(spark, sf_dir):
    return records.top_of_each(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_linenumber", 3)


@cat.query("k03_k04_csv_lines", "SELECT concat_ws(';', r_name, replace(format('{:.2f}', r_regionkey * 1.5), '.', ','), '') || chr(13) AS value FROM region")
def csv_lines(spark, sf_dir):
    return reports.crlf_lines(table(spark, sf_dir, "region").select("r_name", reports.decimal_text(C("r_regionkey") * 1.5).alias("x"), F.lit(None).cast("string").alias("y")))


@cat.query("k05_k06_run_protocol", "SELECT o_custkey, '[' || string_agg('{\"k\":' || o_orderkey || ',\"s\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_orderkey) || ']' AS doc FROM orders GROUP BY 1")
def protocol(spark, sf_dir):
    """A run with its ordered actions as one JSON document."""
    return records.json_documents(table(spark, sf_dir, "orders"), "o_custkey", k="o_orderkey", s="o_orderstatus")


@cat.query("k12_byte_batches", "SELECT source, doc_id, CAST(floor((sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars) / 100000) AS BIGINT) AS batch FROM documents")
def byte_batches(spark, sf_dir):
    return records.byte_batches(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 100_000, block=128).drop("n_chars")


@cat.query("p08_p11_case_filter", "SELECT event_id FROM events WHERE event_type LIKE 'p%' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND (value IS NULL OR value > 20)")
def case_filter(spark, sf_dir):
    d = C("ts").cast("date")
    return table(spark, sf_dir, "events").where(C("event_type").startswith("p") & d.between(periods.day("2024-01-05"), periods.day("2024-01-20")) & (C("value").isNull() | (C("value") > 20))).select("event_id")


@cat.query("p09_y05_y06_skip_reasons", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'with_case' WHEN o_custkey % 7 = 0 THEN 'no_year' WHEN o_totalprice < 1000 THEN 'already_placed' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def skip_reasons(spark, sf_dir):
    """The first reason to skip a row, or none, and how often each holds."""
    reason = records.first_reason((C("o_orderstatus") == "P", "with_case"), (C("o_custkey") % 7 == 0, "no_year"), (C("o_totalprice") < 1000, "already_placed"))
    return table(spark, sf_dir, "orders").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@cat.query("p13_p10_scope_number", "SELECT p_partkey, CAST(regexp_extract(p_brand || ' ' || p_partkey, '([0-9]+)', 1) AS BIGINT) = 13 AS hit FROM part")
def scope_number(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", records.scope_number(F.concat_ws(" ", "p_brand", C("p_partkey").cast("string")), 13).alias("hit"))


@cat.query("p14_r09_lost_jobs", "SELECT event_id FROM events WHERE event_type = 'purchase' AND (value IS NULL OR ts < TIMESTAMP '2024-01-10' OR (ts < TIMESTAMP '2024-01-20' AND event_id % 3 = 0)) ORDER BY ts, event_id LIMIT 500")
def lost_jobs(spark, sf_dir):
    t = lambda s: F.lit(s).cast("timestamp")
    lost = C("value").isNull() | (C("ts") < t("2024-01-10")) | ((C("ts") < t("2024-01-20")) & (C("event_id") % 3 == 0))
    return records.lost_jobs(table(spark, sf_dir, "events"), C("event_type") == "purchase", lost, ["ts", "event_id"], 500).select("event_id")


@cat.query("p17_p18_record_status", "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'incomplete' WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'ai_suggested' ELSE 'confirmed' END AS status FROM orders GROUP BY 1")
def record_status(spark, sf_dir):
    return records.worst_status(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", [("P", "incomplete"), ("O", "ai_suggested")], "confirmed")


@cat.query("r04_r05_conflicts", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = l_tax * 100 THEN 'none' WHEN l_partkey % 3 = l_suppkey % 3 THEN 'take_remote' WHEN l_partkey % 3 = l_orderkey % 3 THEN 'take_local' ELSE 'conflict' END AS kind FROM lineitem")
def conflicts(spark, sf_dir):
    """Three-way comparison of local, last synced and remote state."""
    kind = records.conflict_kind(C("l_quantity") == C("l_tax") * 100, C("l_partkey") % 3, C("l_suppkey") % 3, C("l_orderkey") % 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"))


@cat.query("r11_dedupe_repeats", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS skipped FROM events")
def dedupe_repeats(spark, sf_dir):
    return records.repeated_jobs(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "skipped")


@cat.query("r10_stale_jobs", "SELECT event_id, CASE WHEN event_id % 4 >= 3 THEN 'failed' ELSE 'pending' END AS state FROM events WHERE ts < TIMESTAMP '2024-01-20' - to_minutes(CASE event_type WHEN 'view' THEN 1440 ELSE 7200 END)")
def stale_jobs(spark, sf_dir):
    minutes = F.when(C("event_type") == "view", 1440).otherwise(7200)
    return records.stale_jobs(table(spark, sf_dir, "events"), C("ts"), F.lit("2024-01-20").cast("timestamp"), minutes, C("event_id") % 4, 3).select("event_id", "state")


@cat.query("r19_alert_edges", "SELECT user_id, event_id, active AND NOT coalesce(before, false) AS raised, NOT active AND coalesce(before, false) AS cleared FROM (SELECT *, lag(active) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, value > 80 AS active FROM events))")
def alert_edges(spark, sf_dir):
    return records.alert_edges(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], C("value") > 80).select("user_id", "event_id", "raised", "cleared")


PAGED = "replace(text, '. ', chr(12))"


@cat.query("y01_split_pages", f"""
    WITH p AS (SELECT doc_id, string_split({PAGED}, chr(12)) AS parts, n_chars // 100 + 1 AS expected FROM documents),
    w AS (SELECT doc_id, expected, CASE WHEN trim(parts[-1]) = '' THEN parts[:-2] ELSE parts END AS parts FROM p)
    SELECT doc_id, CAST(i AS INT) AS page, coalesce(parts[i], '') AS text FROM (SELECT doc_id, parts, unnest(range(1, expected + 1)) AS i FROM w)""")
def split_pages(spark, sf_dir):
    """Whole texts as pages, as many as expected, padded with empty ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("\f")).alias("text"), (F.floor(C("n_chars") / 100) + 1).cast("int").alias("expected"))
    return d.select("doc_id", F.posexplode(pages.split_pages(C("text"), C("expected"))).alias("p", "text")).select("doc_id", (C("p") + 1).alias("page"), "text")


@cat.query("y04_y17_restart_state", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'ocr_done' WHEN d.n_chars > 500 THEN 'hashed' ELSE 'registered' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def restart(spark, sf_dir):
    return records.restart_state(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", C("n_chars") > 500).select("doc_id", "state")


@cat.query("y09_y38_y39_labels", "SELECT p_partkey, p_size IN (1, 2) AS owners, p_size > 2 AS tenants, p_size = 2 AS mixed, CASE WHEN p_size % 2 = 0 THEN p_size || '/1000' ELSE CAST(p_size AS VARCHAR) END AS share FROM part")
def plan_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C("p_size").isin(1, 2).alias("owners"), (C("p_size") > 2).alias("tenants"), (C("p_size") == 2).alias("mixed"), F.when(C("p_size") % 2 == 0, F.concat(C("p_size").cast("string"), F.lit("/1000"))).otherwise(C("p_size").cast("string")).alias("share"))


@cat.query("y13_y15_y16_field_audit", "SELECT c_nationkey, CASE WHEN o.n IS NULL THEN 'missing' WHEN o.n = 1 THEN 'same' ELSE 'other' END AS outcome, count(*) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey GROUP BY 1, 2")
def field_audit(spark, sf_dir):
    sources = table(spark, sf_dir, "orders").select(C("o_custkey").alias("c_custkey"))
    return records.field_audit(table(spark, sf_dir, "customer"), sources, "c_custkey", "c_nationkey")


@cat.query("y21_last_row_wins", "SELECT c_nationkey, max_by(c_name, c_custkey) AS name FROM customer GROUP BY 1")
def last_wins(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max_by("c_name", "c_custkey").alias("name"))


@cat.query("y26_y27_y29_bulk_preview", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'row' END, CASE WHEN o_orderkey % 3 = 0 THEN 'bulk' END, o_orderpriority) AS target, CAST(o_orderstatus = 'F' AS INT) + CAST(o_totalprice < 1000 AS INT) AS errors FROM orders")
def bulk_preview(spark, sf_dir):
    """Proposal, then bulk, then row override; errors as an array."""
    errors = F.filter(F.array(F.when(C("o_orderstatus") == "F", "closed"), F.when(C("o_totalprice") < 1000, "too_small")), lambda x: x.isNotNull())
    target = F.coalesce(F.when(C("o_orderkey") % 5 == 0, "row"), F.when(C("o_orderkey") % 3 == 0, "bulk"), "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", target.alias("target"), F.size(errors).alias("errors"))


@cat.query("y30_m01_m02_a32_json_paths", "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') IS NULL AS no_ref FROM events")
def json_paths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").isNull().alias("no_ref"))


@cat.query("y31_e30_parse_hints", "SELECT event_id, trim(json_extract_string(props, '$.page')) AS page, len(json_keys(props)) AS keys FROM events")
def parse_hints(spark, sf_dir):
    """A JSON object read with a schema, and its keys."""
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.trim(F.try_element_at(m, F.lit("page"))).alias("page"), F.size(F.map_keys(m)).alias("keys"))


@cat.query("y40_heartbeats", "SELECT t.kind, coalesce(epoch(TIMESTAMP '2024-01-31') - max(epoch(ts)) <= 86400, false) AS ok FROM (VALUES ('click'), ('view'), ('absent')) t(kind) LEFT JOIN events ON event_type = kind GROUP BY 1")
def heartbeats(spark, sf_dir):
    kinds = spark.createDataFrame([("click",), ("view",), ("absent",)], "kind string")
    last = table(spark, sf_dir, "events").groupBy(C("event_type").alias("kind")).agg(F.max(F.unix_timestamp("ts")).alias("last"))
    return kinds.join(last, "kind", "left").select("kind", F.coalesce(F.unix_timestamp(F.lit("2024-01-31").cast("timestamp")) - C("last") <= 86400, F.lit(False)).alias("ok"))


@cat.query("m04_m05_mapping", "SELECT user_id, list_sort(list(DISTINCT event_type))[1] AS first_key, max_by(event_id, (ts, event_id)) FILTER (event_type = 'click') AS click FROM events GROUP BY 1")
def mapping(spark, sf_dir):
    """Entries as a map, later overrides winning."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("v"))
    m = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return m.select("user_id", F.array_sort(F.map_keys("m"))[0].alias("first_key"), F.try_element_at("m", F.lit("click")).alias("click"))


def check_inputs(spark, sf_dir):
    objects = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("object_id"), F.when(C("s_suppkey") % 3 != 0, 20).alias("expected_units"), F.when(C("s_suppkey") % 4 == 0, F.lit(None)).otherwise(C("s_suppkey") % 4 == 1).cast("boolean").alias("sepa_used"))
    units = table(spark, sf_dir, "part").select((C("p_partkey") % 100 + 1).alias("object_id"), C("p_partkey").alias("unit_id"), F.when(C("p_size") > 5, C("p_size")).alias("share"))
    lines = table(spark, sf_dir, "lineitem")
    own = lines.select((C("l_partkey") % 100 + 1).alias("object_id"), C("l_partkey").alias("unit_id"), (C("l_orderkey") * 8 + C("l_linenumber")).alias("assignment_id"), C("l_suppkey").alias("owner_id"), (C("l_quantity") > 25).alias("current"), F.when(C("l_returnflag") != "R", C("l_returnflag")).alias("address"), F.when(C("l_linestatus") == "O", "m").alias("email"), F.when(C("l_tax") > 0.04, "a").alias("account"))
    kinds = F.element_at(F.array(*map(F.lit, ("owner_accounts", "annual_statement_year", "business_plan_year", "special_levy", "credits"))), (C("o_orderkey") % 5 + 1).cast("int"))
    docs = table(spark, sf_dir, "orders").select((C("o_custkey") % 100 + 1).alias("object_id"), kinds.alias("kind"), F.year("o_orderdate").alias("year"), (C("o_orderstatus") == "F").cast("int").alias("confirmed"))
    return objects, units, own, docs


CHECK_SRC = """WITH objects AS (SELECT s_suppkey AS object_id, CASE WHEN s_suppkey % 3 <> 0 THEN 20 END AS expected_units, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 4 = 1 END AS sepa_used FROM supplier),
  units AS (SELECT p_partkey % 100 + 1 AS object_id, p_partkey AS unit_id, CASE WHEN p_size > 5 THEN p_size END AS share FROM part),
  own AS (SELECT l_partkey % 100 + 1 AS object_id, l_partkey AS unit_id, l_orderkey * 8 + l_linenumber AS assignment_id, l_quantity > 25 AS current, CASE WHEN l_returnflag <> 'R' THEN 1 END AS address, CASE WHEN l_linestatus = 'O' THEN 1 END AS email, CASE WHEN l_tax > 0.04 THEN 1 END AS account FROM lineitem),
  docs AS (SELECT o_custkey % 100 + 1 AS object_id, (['owner_accounts', 'annual_statement_year', 'business_plan_year', 'special_levy', 'credits'])[o_orderkey % 5 + 1] AS kind, year(o_orderdate) AS year, CAST(o_orderstatus = 'F' AS INT) AS confirmed FROM orders),
  f AS (
    SELECT o.object_id, 'all_units_known' AS check_code, CASE WHEN expected_units IS NULL THEN CASE WHEN count(unit_id) > 0 THEN 'partial' ELSE 'missing' END WHEN count(unit_id) = expected_units AND count(share) = count(unit_id) THEN 'fulfilled' WHEN count(unit_id) > 0 THEN 'partial' ELSE 'missing' END AS status, false AS recommendation FROM objects o LEFT JOIN units u USING (object_id) GROUP BY o.object_id, expected_units
    UNION ALL SELECT o.object_id, 'owner_list_complete', CASE WHEN count(c.object_id) = 0 THEN 'missing' ELSE 'fulfilled' END, false FROM objects o LEFT JOIN (SELECT * FROM own WHERE current) c USING (object_id) GROUP BY 1
    UNION ALL SELECT u.object_id, 'owner_per_unit', CASE WHEN EXISTS (SELECT 1 FROM own c WHERE c.current AND c.unit_id = u.unit_id AND c.object_id = u.object_id) THEN 'fulfilled' ELSE 'missing' END, false FROM units u
    UNION ALL SELECT object_id, 'addresses', CASE WHEN address IS NOT NULL THEN 'fulfilled' ELSE 'missing' END, false FROM own WHERE current
    UNION ALL SELECT object_id, 'contact_data', CASE WHEN email IS NOT NULL THEN 'fulfilled' WHEN address IS NOT NULL THEN 'partial' ELSE 'missing' END, false FROM own WHERE current
    UNION ALL SELECT object_id, 'sepa_mandate', CASE WHEN sepa_used IS NULL THEN 'partial' WHEN NOT sepa_used THEN 'not_applicable' WHEN account IS NOT NULL THEN 'fulfilled' ELSE 'missing' END, false FROM own JOIN objects USING (object_id) WHERE current
    UNION ALL SELECT o.object_id, k, CASE WHEN sum(confirmed) > 0 THEN 'fulfilled' WHEN count(confirmed) > 0 THEN 'partial' ELSE 'missing' END, false FROM objects o CROSS JOIN (VALUES ('owner_accounts'), ('annual_statement_year'), ('business_plan_year')) t(k) CROSS JOIN (VALUES (1995), (1996)) y(y) LEFT JOIN docs d ON d.object_id = o.object_id AND d.kind = k AND d.year = y GROUP BY o.object_id, k, y
    UNION ALL SELECT o.object_id, k, CASE WHEN sum(confirmed) > 0 THEN 'fulfilled' WHEN count(confirmed) > 0 THEN 'partial' ELSE 'missing' END, k IN ('payment_agreement', 'dunning_procedure') FROM objects o CROSS JOIN (VALUES ('open_house_fees'), ('credits'), ('special_levy'), ('payment_agreement'), ('dunning_procedure'), ('owner_changes')) t(k) LEFT JOIN docs d ON d.object_id = o.object_id AND d.kind = k GROUP BY o.object_id, k) """


@cat.query("c01_c04_c05_owner_checks", CHECK_SRC + "SELECT object_id, check_code, status, count(*) AS n FROM f GROUP BY ALL")
def owner_checks(spark, sf_dir):
    """All checks of co-owned objects, years exploded."""
    return checks.owner_checks(*check_inputs(spark, sf_dir), [1995, 1996]).groupBy("object_id", "check_code", "status").agg(F.count("*").alias("n"))


@cat.query("a08_a09_c06_c08_summary", CHECK_SRC + "SELECT object_id, count(*) FILTER (status = 'fulfilled') AS fulfilled, count(*) FILTER (status = 'missing') AS missing, round(count(*) FILTER (status = 'fulfilled') / nullif(count(*) FILTER (status <> 'not_applicable'), 0)::DOUBLE, 4) AS ratio, CASE WHEN bool_or(status = 'missing') THEN 'missing' WHEN bool_or(status = 'partial') THEN 'partial' ELSE 'fulfilled' END AS worst FROM f WHERE NOT recommendation GROUP BY 1")
def completeness(spark, sf_dir):
    return checks.summary(checks.owner_checks(*check_inputs(spark, sf_dir), [1995, 1996]), "object_id").select("object_id", "fulfilled", "missing", "ratio", "worst")


TENANT_ORACLE = CHECK_SRC[: CHECK_SRC.index("  f AS (")] + """
  l AS (SELECT l_partkey % 100 + 1 AS object_id, l_partkey AS unit_id, CASE WHEN l_quantity > 10 THEN 1 END AS rent, CASE WHEN l_discount > 0.05 THEN 1 END AS deposit, CASE l_returnflag WHEN 'N' THEN 'unknown' WHEN 'A' THEN 'indexed' END AS adj,
               CASE WHEN l_linestatus = 'O' THEN 'm' END AS email, CASE WHEN l_tax > 0.04 THEN 'a' END AS account FROM lineitem),
  kinds AS (SELECT object_id, CASE kind WHEN 'credits' THEN 'tenant_accounts' WHEN 'special_levy' THEN 'tenant_dunning_procedure' ELSE kind END AS kind, confirmed FROM docs),
  found AS (
  SELECT 'deposit' AS check_code, CASE WHEN rent IS NOT NULL AND deposit IS NOT NULL THEN 'fulfilled' WHEN rent IS NOT NULL OR deposit IS NOT NULL THEN 'partial' ELSE 'missing' END AS status FROM l
  UNION ALL SELECT 'rent_adjustment', CASE WHEN adj = 'unknown' THEN 'partial' WHEN adj IS NOT NULL THEN 'fulfilled' ELSE 'missing' END FROM l
  UNION ALL SELECT 'lease_terms', CASE WHEN rent IS NOT NULL THEN 'fulfilled' ELSE 'missing' END FROM l
  UNION ALL SELECT 'tenant_contact_data', CASE WHEN email IS NOT NULL THEN 'fulfilled' ELSE 'missing' END FROM l
  UNION ALL SELECT 'tenant_sepa_mandate', CASE WHEN sepa_used IS NULL THEN 'partial' WHEN NOT sepa_used THEN 'not_applicable' WHEN account IS NOT NULL THEN 'fulfilled' ELSE 'missing' END FROM l JOIN objects USING (object_id)
  UNION ALL SELECT 'tenant_per_unit', CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.unit_id = u.unit_id AND l.object_id = u.object_id) THEN 'fulfilled' ELSE 'missing' END FROM units u
  UNION ALL SELECT 'tenant_list_complete', CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.object_id = o.object_id) THEN 'fulfilled' ELSE 'missing' END FROM objects o
  UNION ALL SELECT k, CASE WHEN sum(confirmed) > 0 THEN 'fulfilled' WHEN count(confirmed) > 0 THEN 'partial' ELSE 'missing' END FROM objects o CROSS JOIN (VALUES ('tenant_accounts'), ('tenant_dunning_procedure')) t(k) LEFT JOIN kinds d ON d.object_id = o.object_id AND d.kind = k GROUP BY o.object_id, k)
  SELECT check_code, status, count(*) AS n FROM found GROUP BY ALL"""


@cat.query("c02_tenant_checks", TENANT_ORACLE)
def tenant_checks(spark, sf_dir):
    """All nine checks of rented units."""
    objects, units, _, docs = check_inputs(spark, sf_dir)
    kind = F.when(C("kind") == "credits", "tenant_accounts").when(C("kind") == "special_levy", "tenant_dunning_procedure").otherwise(C("kind"))
    leases = table(spark, sf_dir, "lineitem").select(
        (C("l_partkey") % 100 + 1).alias("object_id"), C("l_partkey").alias("unit_id"), (C("l_orderkey") * 8 + C("l_linenumber")).alias("assignment_id"), F.when(C("l_quantity") > 10, 1).alias("rent"),
        F.when(C("l_discount") > 0.05, 1).alias("deposit"), F.when(C("l_returnflag") == "N", "unknown").when(C("l_returnflag") == "A", "indexed").alias("adjustment"),
        F.when(C("l_linestatus") == "O", "m").alias("email"), F.when(C("l_tax") > 0.04, "a").alias("account"),
    )
    f = checks.tenant_checks(objects, units, leases, docs.withColumn("kind", kind))
    return f.groupBy("check_code", "status").agg(F.count("*").alias("n"))


@cat.query("c03_catalogue_checks", CHECK_SRC + ", w AS (SELECT object_id, c, kinds FROM objects, (VALUES ('levy', ['special_levy', 'credits']), ('plan', ['business_plan_year'])) t(c, kinds)) SELECT w.object_id, c AS check_code, CASE WHEN sum(confirmed) > 0 THEN 'fulfilled' WHEN count(confirmed) > 0 THEN 'partial' ELSE 'missing' END AS status FROM w LEFT JOIN docs d ON d.object_id = w.object_id AND list_contains(kinds, d.kind) GROUP BY 1, 2")
def catalogue(spark, sf_dir):
    objects, _, _, docs = check_inputs(spark, sf_dir)
    wanted = spark.createDataFrame([("levy", ["special_levy", "credits"], False), ("plan", ["business_plan_year"], True)], "check_code string, kinds array<string>, recommendation boolean")
    return checks.catalogue_checks(objects, wanted, docs).drop("recommendation")
