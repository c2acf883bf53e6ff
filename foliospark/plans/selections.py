"""Queries of the selections over several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import selections
from .base import C, Catalogue, table

cat = Catalogue()
QUERIES, ORACLE_SQL = cat.queries, cat.oracles


@cat.query("j20_listed_documents", """
    SELECT o_orderkey AS doc, o_custkey AS object_id, n_name AS category, s_name AS upload
    FROM (SELECT *, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 30 END AS category_id, o_orderkey % 2000 AS upload_id FROM orders) o
    LEFT JOIN nation ON n_nationkey = category_id LEFT JOIN supplier ON s_suppkey = upload_id
    WHERE o_orderstatus <> 'P' AND o_orderkey % 7 > 0 AND o_orderkey % 5 > 0""")
def j20_listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = C("o_orderkey")
    documents = table(spark, sf_dir, "orders").select(
        key.alias("doc"),
        C("o_custkey").alias("object_id"),
        F.when(C("o_orderstatus") == "P", "moved_out").otherwise("filed").alias("status"),
        F.when(key % 7 == 0, C("o_orderdate")).alias("deleted_at"),
        F.when(key % 5 > 0, "x").otherwise("").alias("sha256"),
        F.when(key % 4 > 0, C("o_custkey") % 30).alias("category_id"),
        (key % 2000).alias("upload_id"),
    )
    categories = table(spark, sf_dir, "nation").select(C("n_nationkey").alias("category_id"), C("n_name").alias("category"))
    uploads = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("upload_id"), C("s_name").alias("upload"))
    return selections.listed_documents(documents, {"category_id": categories, "upload_id": uploads}).select("doc", "object_id", "category", "upload")


@cat.query("p06_matching_units", "SELECT p_partkey AS unit, 'WE' || p_partkey AS label FROM part WHERE starts_with('WE' || p_partkey, 'WE1') OR p_size = 1 ORDER BY p_brand, label, unit LIMIT 200")
def p06_matching_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "part").select(C("p_partkey").alias("unit"), F.concat(F.lit("WE"), C("p_partkey").cast("string")).alias("label"), C("p_size").cast("string").alias("number"), "p_brand")
    return selections.matching_units(units, "label", "number", "WE1", ["p_brand", "label", "unit"]).select("unit", "label")


@cat.query("d10_remote_dispositions", """
    WITH r AS (SELECT o_orderkey AS remote_id, o_orderkey % 11 = 0 AS trashed, o_orderkey % 13 = 0 AS failed, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS checksum FROM orders),
    l AS (SELECT l_orderkey AS remote_id, min(l_partkey) AS linked FROM lineitem WHERE l_quantity > 48 GROUP BY 1),
    d AS (SELECT c_custkey - c_custkey % 3 AS checksum, min(c_custkey) AS equal, count(*) AS n FROM customer WHERE c_custkey % 5 > 1 GROUP BY 1)
    SELECT r.remote_id, CASE WHEN linked IS NOT NULL THEN 'link_existing' WHEN trashed THEN 'out_of_scope' WHEN failed THEN 'error' WHEN n = 1 THEN 'link_existing' WHEN n > 1 THEN 'duplicate' ELSE 'new' END AS disposition,
           CASE WHEN linked IS NOT NULL THEN linked WHEN trashed OR failed THEN NULL ELSE equal END AS document_id
    FROM r LEFT JOIN l USING (remote_id) LEFT JOIN d USING (checksum)""")
def d10_remote_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = C("o_orderkey")
    remote = table(spark, sf_dir, "orders").select(key.alias("remote_id"), (key % 11 == 0).alias("trashed"), (key % 13 == 0).alias("failed"), F.when(key % 3 > 0, C("o_custkey")).cast("string").alias("checksum"))
    links = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(C("l_orderkey").alias("remote_id"), C("l_partkey").alias("document_id"))
    documents = table(spark, sf_dir, "customer").where("c_custkey % 5 > 1").select(C("c_custkey").alias("document_id"), (C("c_custkey") - C("c_custkey") % 3).cast("string").alias("sha256"))
    return selections.remote_dispositions(remote, links, documents)


@cat.query("a14_run_summary", """
    WITH last AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders GROUP BY 1)
    SELECT c_custkey AS object_id, run_id,
           CASE WHEN run_id IS NOT NULL THEN count(l_orderkey) FILTER (l_returnflag = 'R' AND l_quantity > 10) END AS R,
           CASE WHEN run_id IS NOT NULL THEN count(l_orderkey) FILTER (l_returnflag = 'N' AND l_quantity > 10) END AS N
    FROM customer LEFT JOIN last ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = run_id GROUP BY 1, 2""")
def a14_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "customer").select(C("c_custkey").alias("object_id"))
    runs = table(spark, sf_dir, "orders").select(C("o_custkey").alias("object_id"), C("o_orderkey").alias("run_id"), C("o_orderdate").alias("started_at"))
    actions = table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("run_id"), C("l_returnflag").alias("kind"), (C("l_quantity") > 10).alias("ok"))
    return selections.run_summary(objects, runs, actions, ["R", "N"])


@cat.query("y10_tenant_groups", "SELECT coalesce(CAST(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS VARCHAR), 'a' || o_orderkey) AS grp, count(*) AS members, min(o_orderkey) AS first FROM orders GROUP BY 1")
def y10_tenant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = selections.tenant_group(F.when(C("o_orderkey") % 3 > 0, C("o_custkey")), C("o_orderkey"))
    return o.groupBy(key.alias("grp")).agg(F.count("*").alias("members"), F.min("o_orderkey").alias("first"))


@cat.query("y32_manual_findings", """
    WITH d AS (SELECT l_orderkey AS finding, l_linenumber AS seq, CASE l_returnflag WHEN 'R' THEN 'fulfilled' WHEN 'A' THEN '' ELSE 'missing' END AS s, CASE WHEN l_quantity > 20 THEN trim(l_shipmode_) ELSE ' ' END AS r FROM (SELECT *, l_linestatus AS l_shipmode_ FROM lineitem)),
    j AS (SELECT *, CASE WHEN s NOT IN ('', 'fulfilled', 'not_applicable') THEN 'status' WHEN s <> '' AND trim(r) = '' THEN 'reason' END AS refused FROM d),
    g AS (SELECT finding, arg_max(struct_pack(s := nullif(s, ''), r := CASE WHEN s <> '' THEN trim(r) END), seq) AS last FROM j WHERE refused IS NULL GROUP BY 1),
    b AS (SELECT finding, count(*) AS n FROM j WHERE refused IS NOT NULL GROUP BY 1)
    SELECT o_orderkey AS finding, last.s AS manual_status, last.r AS manual_reason, coalesce(n, 0) AS refused FROM orders LEFT JOIN g ON g.finding = o_orderkey LEFT JOIN b ON b.finding = o_orderkey""")
def y32_manual_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("finding"))
    status = F.when(C("l_returnflag") == "R", "fulfilled").when(C("l_returnflag") == "A", "").otherwise("missing")
    place = F.struct("_metadata.file_path", "_metadata.row_index")  # the table repeats numbers; the first row of a number counts
    decisions = table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("finding"), C("l_linenumber").alias("seq"), place.alias("place"), status.alias("manual_status"), F.when(C("l_quantity") > 20, C("l_linestatus")).otherwise(" ").alias("manual_reason"))
    return selections.with_manual(findings, decisions, "finding")
