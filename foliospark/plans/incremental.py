"""Change application, debouncing and streams over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.shared import fresh
from ..streaming import incremental
from .base import C, Catalogue, table

cat = Catalogue()
QUERIES, ORACLE_SQL = cat.queries, cat.oracles


@cat.query("r01_r02_high_water_mark", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15' OR ts = TIMESTAMP '2024-01-15' AND event_id > 100 ORDER BY ts, event_id LIMIT 2000")
def poll(spark, sf_dir):
    """One poll behind the mark that the last one left."""
    return incremental.since(table(spark, sf_dir, "events"), "ts", "event_id", ("2024-01-15", 100), 2000).select("event_id")


@cat.query("r03_apply_changes", """
    WITH cur AS (SELECT c_custkey AS file_id, c_nationkey AS parent, c_mktsegment AS digest, CASE WHEN c_custkey % 11 = 0 THEN 'trashed' ELSE 'linked' END AS state FROM customer WHERE c_custkey % 4 <> 0),
    ch AS (SELECT o_custkey AS file_id, max_by(o_orderstatus, o_orderkey) AS s, max(o_orderkey) AS k FROM orders GROUP BY 1)
    SELECT coalesce(cur.file_id, ch.file_id) AS file_id, CASE WHEN k IS NULL THEN 'none' WHEN k % 9 = 0 THEN 'removed' WHEN k % 7 = 0 THEN 'trashed' WHEN state IS NULL THEN 'new' WHEN state = 'trashed' THEN 'restored' WHEN parent <> k % 25 THEN 'moved' ELSE 'changed' END AS action FROM cur FULL JOIN ch USING (file_id)""")
def changes(spark, sf_dir):
    cur = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(C("c_custkey").alias("file_id"), C("c_nationkey").cast("long").alias("parent"), C("c_mktsegment").alias("digest"), F.when(C("c_custkey") % 11 == 0, "trashed").otherwise("linked").alias("state"))
    k = C("o_orderkey")
    ch = table(spark, sf_dir, "orders").select(C("o_custkey").alias("file_id"), k.alias("seq"), (k % 9 == 0).alias("removed"), (k % 7 == 0).alias("trashed"), (k % 25).alias("parent"), C("o_orderstatus").alias("digest"))
    return incremental.apply_changes(cur, ch).select("file_id", "action")


@cat.query("r12_debounce", """
    WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t FROM events), a AS (SELECT user_id, min(t) AS armed_us FROM e GROUP BY 1 UNION ALL SELECT a.user_id, (SELECT min(t) FROM e WHERE e.user_id = a.user_id AND e.t >= a.armed_us + 36000000000) FROM a WHERE a.armed_us IS NOT NULL)
    SELECT user_id, armed_us FROM a WHERE armed_us IS NOT NULL""")
def debounce(spark, sf_dir):
    return incremental.debounced_batch(table(spark, sf_dir, "events"), "user_id", "ts", 36_000)


@cat.query("stream_windowed_counts", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed(spark, sf_dir):
    """A stream over the events files, driven to its end."""
    source = table(spark, sf_dir, "events")
    feed = incremental.file_feed(spark, f"{sf_dir}/events*.parquet", source.schema).withColumn("ts", C("ts").cast("timestamp"))
    counts = incremental.windowed_counts(feed, "ts", "event_type", "1 day", "31 days").select(F.unix_micros("window.start").alias("start_us"), "event_type", "n")
    return incremental.run_available(counts, fresh(spark, "windowed"), ["start_us", "event_type"])
