"""Joins, windows, ordering, deduplication, upserts and trees over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import evidence, labels, periods
from ..operators import pages
from ..operators import relational as op
from .base import C, Catalogue, table

cat = Catalogue()
QUERIES, ORACLE_SQL = cat.queries, cat.oracles
SPANS = "WITH spans AS (SELECT o_orderkey AS id, o_custkey AS owner, o_custkey % 40 AS unit, CAST(o_orderdate AS DATE) AS valid_from, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) END AS valid_to, CAST(o_totalprice * 100 AS BIGINT) % 100 AS share FROM orders) "


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments of owners to units with their validity, derived from orders."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        C("o_orderkey").alias("id"), C("o_custkey").alias("owner"), (C("o_custkey") % 40).alias("unit"), day.alias("valid_from"),
        F.when(C("o_orderkey") % 5 != 0, F.date_add(day, (C("o_orderkey") % 90).cast("int"))).alias("valid_to"), ((C("o_totalprice") * 100).cast("long") % 100).alias("share"),
    )


@cat.query("j04_a10_point_in_time_owners", SPANS + """
    SELECT c_nationkey AS nation, count(DISTINCT owner) AS owners, string_agg(DISTINCT CAST(unit AS VARCHAR), ',' ORDER BY CAST(unit AS VARCHAR)) AS units,
           CASE WHEN count(DISTINCT share) = 1 AND count(share) = count(*) THEN min(share) END AS share
    FROM spans JOIN customer ON c_custkey = owner
    WHERE valid_from <= DATE '1996-06-30' AND (valid_to IS NULL OR valid_to >= DATE '1996-06-30') GROUP BY 1""")
def point_in_time(spark, sf_dir):
    """Assignments on a day, grouped with ordered distinct labels and a share if it is the only one."""
    at = periods.day("1996-06-30")
    now = spans(spark, sf_dir).where(periods.overlaps(C("valid_from"), C("valid_to"), at, at))
    return now.join(table(spark, sf_dir, "customer").select(C("c_custkey").alias("owner"), C("c_nationkey").alias("nation")), "owner").groupBy("nation").agg(
        F.count_distinct("owner").alias("owners"), F.array_join(F.array_sort(F.collect_set(C("unit").cast("string"))), ",").alias("units"),
        F.when((F.count_distinct("share") == 1) & (F.count("share") == F.count("*")), F.min("share")).alias("share"))


@cat.query("j05_as_of_shipments", SPANS + "SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS hits FROM lineitem JOIN orders o ON o_orderkey = l_orderkey JOIN spans s ON s.owner = o.o_custkey AND s.valid_from <= CAST(l_shipdate AS DATE) AND (s.valid_to IS NULL OR s.valid_to >= CAST(l_shipdate AS DATE)) GROUP BY 1, 2")
def as_of(spark, sf_dir):
    """All assignments of the owner on the day of each shipment."""
    lines = table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("k"), C("l_linenumber").alias("n"), C("l_shipdate").cast("date").alias("day"))
    asked = lines.join(table(spark, sf_dir, "orders").select(C("o_orderkey").alias("k"), C("o_custkey").alias("owner")), "k").withColumn("day_end", C("day"))
    return op.touching(asked, spans(spark, sf_dir), ["owner"], ("day", "day_end", "valid_from", "valid_to")).groupBy("k", "n").agg(F.count("*").alias("hits"))


@cat.query("j06_owner_span_precedence", "SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 3 = 0 THEN make_date(year(o_orderdate), 1, 1) WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) - 5 ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS span_from, CAST(CASE WHEN o_orderkey % 3 = 0 THEN make_date(year(o_orderdate), 12, 31) WHEN o_orderkey % 3 = 1 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS span_to FROM orders")
def precedence(spark, sf_dir):
    """Year before period before day."""
    o = table(spark, sf_dir, "orders").withColumn("d", C("o_orderdate").cast("date"))
    s = op.span_for_document(F.when(C("o_orderkey") % 3 == 0, F.year("d")), F.when(C("o_orderkey") % 3 == 1, F.date_sub("d", 5)), F.lit(None).cast("date"), C("d"))
    return o.select(C("o_orderkey").alias("k"), s["from"].cast("string").alias("span_from"), s["to"].cast("string").alias("span_to"))


@cat.query("j07_y07_self_overlaps", SPANS + "SELECT a.id, b.id AS other_id FROM spans a JOIN spans b ON a.owner = b.owner AND a.unit = b.unit AND a.id < b.id WHERE a.valid_from <= coalesce(b.valid_to, DATE '9999-12-31') AND b.valid_from <= coalesce(a.valid_to, DATE '9999-12-31') AND NOT (a.id % 7 = 0 AND b.id % 7 = 0)")
def consistency(spark, sf_dir):
    """Overlapping assignments without an open case."""
    pairs = op.self_overlaps(spans(spark, sf_dir), ["owner", "unit"], "id", "valid_from", "valid_to").select("id", "other_id")
    known = pairs.where((C("id") % 7 == 0) & (C("other_id") % 7 == 0))
    return pairs.join(known, ["id", "other_id"], "left_anti")


@cat.query("p02_p04_overlap_fiscal_year", SPANS + "SELECT id, (valid_from <= DATE '1996-03-31' AND (valid_to IS NULL OR valid_to >= DATE '1995-04-01')) AS hit FROM spans")
def fiscal_overlap(spark, sf_dir):
    return spans(spark, sf_dir).select("id", periods.overlaps_year(C("valid_from"), C("valid_to"), F.lit(1995), F.lit(4)).alias("hit"))


@cat.query("j03_either_key", "SELECT DISTINCT o_orderkey, s_suppkey FROM orders, supplier WHERE s_suppkey = o_orderkey OR (s_nationkey = o_custkey % 25 AND s_suppkey % 10 = o_orderkey % 500)")
def either(spark, sf_dir):
    """Links by assignment or by unit and owner, without a nested loop."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", C("o_orderkey").alias("a"), (C("o_custkey") % 25).cast("int").alias("n"), (C("o_orderkey") % 500).alias("m"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", C("s_suppkey").alias("a"), C("s_nationkey").alias("n"), (C("s_suppkey") % 10).alias("m"))
    return op.either_key(o, s, ["a"], ["n", "m"], ["o_orderkey", "s_suppkey"])


@cat.query("j01_j02_owner_list", "SELECT p_partkey AS unit, l_orderkey AS assignment, s_name AS owner, CASE WHEN l_orderkey IS NULL THEN 'incomplete' WHEN l_returnflag = 'R' THEN 'ai_suggested' ELSE 'confirmed' END AS status FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_linenumber = 1 AND l_quantity > 40 LEFT JOIN supplier ON s_suppkey = l_suppkey")
def owner_list(spark, sf_dir):
    """All units with their current assignments; units without one stay."""
    lines = table(spark, sf_dir, "lineitem").where((C("l_linenumber") == 1) & (C("l_quantity") > 40)).select(C("l_partkey").alias("unit"), C("l_orderkey").alias("assignment"), "l_suppkey", "l_returnflag")
    owners = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("l_suppkey"), C("s_name").alias("owner"))
    units = table(spark, sf_dir, "part").select(C("p_partkey").alias("unit"))
    status = F.when(C("assignment").isNull(), "incomplete").when(C("l_returnflag") == "R", "ai_suggested").otherwise("confirmed")
    return units.join(lines, "unit", "left").join(owners, "l_suppkey", "left").select("unit", "assignment", "owner", status.alias("status"))


@cat.query("j12_owner_suggestions", "SELECT c_custkey, c_name, c_nationkey = 7 AS in_object FROM customer WHERE c_name LIKE '%1%' ORDER BY c_nationkey = 7 DESC, c_name LIKE 'Customer#00000001%' DESC, c_name LIMIT 12")
def suggestions(spark, sf_dir):
    """Ranked name search."""
    c = table(spark, sf_dir, "customer").where(C("c_name").contains("1")).withColumn("in_object", C("c_nationkey") == 7)
    return c.orderBy(C("in_object").desc(), C("c_name").startswith("Customer#00000001").desc(), "c_name").limit(12).select("c_custkey", "c_name", "in_object")


@cat.query("j13_sender_lookup", "WITH s AS (SELECT turn, role, conv_id, lower(role) || '-' || (conv_id % 50) AS mail FROM conversations), c AS (SELECT lower(c_mktsegment) AS seg, c_custkey, 'user-' || (c_custkey % 75) AS mail FROM customer) SELECT s.conv_id, s.turn, CASE count(DISTINCT c_custkey) WHEN 0 THEN NULL WHEN 1 THEN min(c_custkey) END AS owner, count(DISTINCT c_custkey) > 1 AS ambiguous FROM s LEFT JOIN c USING (mail) GROUP BY ALL")
def senders(spark, sf_dir):
    """A sender by case-insensitive equality, no guess when several match."""
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(F.concat_ws("-", "role", (C("conv_id") % 50).cast("string"))).alias("mail"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("user-"), (C("c_custkey") % 75).cast("string")).alias("mail")).groupBy("mail").agg(F.min("c_custkey").alias("one"), F.count_distinct("c_custkey").alias("n"))
    return s.join(c, "mail", "left").groupBy("conv_id", "turn").agg(F.max(F.when(C("n") == 1, C("one"))).alias("owner"), F.max(F.coalesce(C("n") > 1, F.lit(False))).alias("ambiguous"))


@cat.query("j14_keyed_hash_join", "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def hash_join(spark, sf_dir):
    """Parties met by the keyed hash of an account, never by the account."""
    from ..functions.bank import hmac_sha256

    h = lambda c: hmac_sha256(C(c).cast("string"), b"fixture")
    return table(spark, sf_dir, "customer").select("c_custkey", h("c_custkey").alias("h")).join(table(spark, sf_dir, "supplier").select("s_suppkey", h("s_suppkey").alias("h")), "h", "left").select("c_custkey", "s_suppkey")


@cat.query("j17_m06_rule_join", "SELECT l_orderkey, l_linenumber, count(*) AS rules FROM lineitem JOIN (SELECT DISTINCT s_suppkey, 'r' || (s_suppkey % 3) AS kind FROM supplier) r ON r.s_suppkey = l_suppkey AND kind IN ('r' || (l_linenumber % 3), 'r' || (l_partkey % 3)) GROUP BY ALL")
def rule_join(spark, sf_dir):
    """Exploded combination keys against learned rules."""
    lines = table(spark, sf_dir, "lineitem")
    kind = lambda c: F.concat(F.lit("r"), (C(c) % 3).cast("string"))
    combos = lines.select("l_orderkey", "l_linenumber", "l_suppkey", F.explode(F.array_distinct(F.array(kind("l_linenumber"), kind("l_partkey")))).alias("kind"))
    rules = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("l_suppkey"), kind("s_suppkey").alias("kind")).distinct()
    return combos.join(rules, ["l_suppkey", "kind"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("rules"))


@cat.query("j18_owner_records", "SELECT c_custkey, CAST(list_sort(coalesce(list(DISTINCT o_orderkey % 20) FILTER (o_orderkey IS NOT NULL), [])) AS VARCHAR) AS units FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def owner_records(spark, sf_dir):
    """One record for each owner with its set of units."""
    units = table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_set(C("o_orderkey") % 20)).alias("u"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(units, "c_custkey", "left").select("c_custkey", F.concat(F.lit("["), F.array_join(F.coalesce("u", F.array().cast("array<bigint>")), ", "), F.lit("]")).alias("units"))


@cat.query("j19_type_folders", "SELECT c.c_mktsegment AS kind, min(n_name) AS folder, count(*) AS n FROM customer c, nation WHERE n_nationkey IN (c_nationkey, (c_nationkey + 1) % 25) GROUP BY 1")
def type_folders(spark, sf_dir):
    """Members of an array joined to their names."""
    return table(spark, sf_dir, "customer").select(C("c_mktsegment").alias("kind"), F.explode(F.array(C("c_nationkey"), ((C("c_nationkey") + 1) % 25).cast("int"))).alias("n_nationkey")).join(table(spark, sf_dir, "nation"), "n_nationkey").groupBy("kind").agg(F.min("n_name").alias("folder"), F.count("*").alias("n"))


@cat.query("j21_d01_duplicates", "SELECT doc_id, nullif(min(doc_id) OVER (PARTITION BY text), doc_id) AS duplicate_of FROM documents")
def duplicate_documents(spark, sf_dir):
    """The first document of equal content keeps."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return op.duplicates(d, ["sha256"], "doc_id").select("doc_id", "duplicate_of")


@cat.query("j22_d03_s31_insert_absent", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def absent(spark, sf_dir):
    """Keys that aren't known yet."""
    return op.insert_absent(table(spark, sf_dir, "orders").select(C("o_custkey").alias("c_custkey")), table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@cat.query("j24_numeric_lookup", "SELECT p_partkey, n_name FROM part JOIN nation ON n_nationkey = p_partkey % 100")
def numeric_lookup(spark, sf_dir):
    """082 and 82 are the same number."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lpad((C("p_partkey") % 100).cast("string"), 4, "0").cast("int").alias("n_nationkey"))
    return p.join(table(spark, sf_dir, "nation"), "n_nationkey").select("p_partkey", "n_name")


TREE = "WITH RECURSIVE up(node, ancestor) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT node, ancestor // 7 FROM up WHERE ancestor // 7 > 0) "


@cat.query("j23_y24_empty_folders", TREE + "SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT ancestor FROM up JOIN part p ON p.p_partkey = up.node WHERE p.p_size > 30 OR p.p_brand = 'Brand#11')")
def empty_folders(spark, sf_dir):
    """Folders without kept or protected descendants."""
    parts = table(spark, sf_dir, "part")
    tree = parts.select(C("p_partkey").alias("node"), F.when(C("p_partkey") >= 7, F.floor(C("p_partkey") / 7)).alias("parent"))
    kept = parts.where((C("p_size") > 30) | (C("p_brand") == "Brand#11")).select(C("p_partkey").alias("node"))
    return parts.select(C("p_partkey").alias("node")).join(op.with_marked_below(tree, kept, "node", "parent"), "node", "left_anti")


@cat.query("y23_s33_tree_digest", TREE + "SELECT ancestor AS root, count(*) AS files, sha256(string_agg(CAST(node AS VARCHAR), chr(10) ORDER BY CAST(node AS VARCHAR))) AS digest FROM up WHERE ancestor < 7 GROUP BY 1")
def tree_digest(spark, sf_dir):
    """Number of descendants and a digest over their sorted ids, read as a stream."""
    tree = table(spark, sf_dir, "part").where("p_partkey is not null").select(C("p_partkey").alias("node"), F.when(C("p_partkey") >= 7, F.floor(C("p_partkey") / 7)).alias("parent"))
    return op.sorted_digest(op.top_of(tree, "node", "parent").where("top < 7"), "top", "node").select(C("top").alias("root"), C("rows").alias("files"), "digest")


@cat.query("j26_w06_owner_groups", SPANS + "SELECT id, dense_rank() OVER (PARTITION BY unit ORDER BY valid_to IS NULL DESC, valid_from, coalesce(valid_to, DATE '9999-12-31')) AS grp FROM spans")
def owner_groups(spark, sf_dir):
    """Co-owners with the same span form a group, current groups first."""
    w = Window.partitionBy("unit").orderBy(C("valid_to").isNull().desc(), "valid_from", F.coalesce("valid_to", periods.day(periods.NEVER)))
    return spans(spark, sf_dir).select("id", F.dense_rank().over(w).alias("grp"))


@cat.query("j25_owner_decision_table", SPANS + "SELECT u.unit, u.y, count(DISTINCT s.owner) AS owners, CASE WHEN count(DISTINCT s.owner) = 0 THEN 'no_owner' WHEN count(DISTINCT s.owner) = 1 THEN 'link' WHEN count(DISTINCT s.valid_from) = 1 THEN 'link_group' ELSE 'case' END AS outcome FROM (SELECT DISTINCT unit, y FROM spans, (VALUES (1995), (1996), (2030)) t(y)) u LEFT JOIN spans s ON s.unit = u.unit AND s.valid_from <= make_date(u.y, 1, 15) AND (s.valid_to IS NULL OR s.valid_to >= make_date(u.y, 1, 1)) GROUP BY 1, 2")
def owner_decisions(spark, sf_dir):
    """From units and a period to a link, a group of links or a case."""
    s = spans(spark, sf_dir)
    asked = s.select("unit").distinct().withColumn("y", F.explode(F.array(*map(F.lit, (1995, 1996, 2030)))))
    hits = op.touching(asked.withColumns({"a": F.make_date("y", F.lit(1), F.lit(1)), "b": F.make_date("y", F.lit(1), F.lit(15))}), s, ["unit"], ("a", "b", "valid_from", "valid_to"))
    counted = hits.groupBy("unit", "y").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("valid_from").alias("starts"))
    n = F.coalesce("owners", F.lit(0))
    return asked.join(counted, ["unit", "y"], "left").select("unit", "y", n.alias("owners"), F.when(n == 0, "no_owner").when(n == 1, "link").when(C("starts") == 1, "link_group").otherwise("case").alias("outcome"))


@cat.query("a12_a13_latest", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_order(spark, sf_dir):
    """The latest row of each key, active ones first."""
    return op.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [C("o_orderstatus") == "F", C("o_orderdate").desc(), C("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@cat.query("w01_queue_position", "SELECT event_id, CASE WHEN event_type = 'error' THEN rank() OVER (PARTITION BY user_id, event_type ORDER BY ts) END AS position FROM events")
def queue_position(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts")
    return table(spark, sf_dir, "events").select("event_id", F.when(C("event_type") == "error", F.rank().over(w)).alias("position"))


@cat.query("w02_w03_keyset_page", "SELECT event_id, user_id FROM events WHERE (user_id, event_id) > (50, 500) ORDER BY user_id, event_id LIMIT 51")
def keyset_page(spark, sf_dir):
    return op.page_after(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id", "event_id"], (50, 500), 50).select("event_id", "user_id")


@cat.query("w04_segments", "SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, m) AS segment_end FROM (SELECT conv_id, turn, role, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE role = 'user'")
def segments(spark, sf_dir):
    """From a start page to the page before the next start."""
    c = table(spark, sf_dir, "conversations").withColumn("m", F.max("turn").over(Window.partitionBy("conv_id"))).where(C("role") == "user")
    return op.until_next(c, ["conv_id"], "turn", C("m")).select("conv_id", "turn", "segment_end")


@cat.query("w04_islands", "SELECT user_id, min(d) AS first, max(d) AS last FROM (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g FROM (SELECT DISTINCT user_id, CAST(event_id // 40 AS BIGINT) AS d FROM events)) GROUP BY user_id, g")
def event_islands(spark, sf_dir):
    return op.islands(table(spark, sf_dir, "events").select("user_id", F.floor(C("event_id") / 40).alias("d")).distinct(), ["user_id"], "d")


@cat.query("s14_column_bounds", "WITH w AS (SELECT event_id // 64 AS page, event_id * 37 % 900 AS x0, event_id * 37 % 900 + 6 AS x1 FROM events), f AS (SELECT *, CASE WHEN x0 > max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 9 THEN 1 ELSE 0 END AS gap, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w) SELECT page, (before + x0) / 2 AS bound FROM f WHERE gap = 1")
def column_bounds(spark, sf_dir):
    """Middles of the gaps between the columns of a page's words."""
    from ..sources.tables import column_bounds as bounds

    e = table(spark, sf_dir, "events")
    left = C("event_id") * 37 % 900
    return bounds(e.select(F.floor(C("event_id") / 64).alias("page"), left.alias("x0"), (left + 6).alias("x1")), "page", 9)


# Turns as pages: a heading that some share, the text with its sentences as lines, and a footer.
TURN_PAGE = "concat(CASE WHEN turn % 3 < 2 THEN concat('Akte ', CAST(conv_id AS STRING), chr(10)) ELSE '' END, replace(coalesce(text, ''), '. ', concat('.', chr(10))), chr(10), 'Seite ', CAST(turn % 2 AS STRING))"
STRIPPED = "regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


@cat.query("w05_repeated_lines", f"""
    WITH p AS (SELECT conv_id, turn, string_split({STRIPPED.format(x=TURN_PAGE)}, chr(10)) AS lines FROM conversations),
    e AS (SELECT conv_id, 0 AS side, trim(lines[1]) AS line FROM p UNION ALL SELECT conv_id, 1, trim(lines[-1]) FROM p),
    o AS (SELECT conv_id, list(DISTINCT line) AS often FROM (SELECT conv_id, side, line FROM e WHERE line <> '' GROUP BY ALL HAVING count(*) >= 3) GROUP BY 1),
    k AS (SELECT p.conv_id, p.turn, lines, CASE WHEN p.turn = min(p.turn) OVER (PARTITION BY p.conv_id) THEN lines ELSE list_filter(lines, lambda x: NOT coalesce(list_contains(often, trim(x)), false)) END AS kept FROM p LEFT JOIN o USING (conv_id))
    SELECT conv_id, turn, coalesce(array_to_string(kept, chr(10)), '') AS text, len(lines) - len(kept) AS dropped FROM k""")
def repeated_lines(spark, sf_dir):
    """First and last lines that three or more pages share stay on the first page only."""
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{TURN_PAGE} AS text")
    return pages.without_repeated_lines(c, "conv_id", "turn", "text")


@cat.query("p15_chosen_pages", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE n <= 3 OR turn = last")
def chosen_pages(spark, sf_dir):
    return pages.chosen_pages(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@cat.query("f68_excerpts", f"""
    WITH c AS (SELECT conv_id, turn, {TURN_PAGE} AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE n <= 3 OR turn = last),
    p AS (SELECT conv_id, turn, string_split({STRIPPED.format(x="text")}, chr(10)) AS lines FROM c),
    e AS (SELECT conv_id, 0 AS side, trim(lines[1]) AS line FROM p UNION ALL SELECT conv_id, 1, trim(lines[-1]) FROM p),
    o AS (SELECT conv_id, list(DISTINCT line) AS often FROM (SELECT conv_id, side, line FROM e WHERE line <> '' GROUP BY ALL HAVING count(*) >= 3) GROUP BY 1),
    k AS (SELECT p.conv_id, p.turn, CASE WHEN p.turn = min(p.turn) OVER (PARTITION BY p.conv_id) THEN lines ELSE list_filter(lines, lambda x: NOT coalesce(list_contains(often, trim(x)), false)) END AS kept FROM p LEFT JOIN o USING (conv_id)),
    t AS (SELECT conv_id, turn, {STRIPPED.format(x="regexp_replace(coalesce(array_to_string(kept, chr(10)), ''), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS text FROM k),
    j AS (SELECT conv_id, string_agg(text, chr(10) || chr(12) ORDER BY turn) AS body FROM t GROUP BY 1)
    SELECT conv_id, CASE WHEN length(body) <= 600 THEN body ELSE regexp_replace(substr(body, 1, 420), '\\s+$', '') || ' [...] ' || regexp_replace(substr(body, length(body) - 172), '^\\s+', '') END AS excerpt FROM j""")
def excerpts(spark, sf_dir):
    """one excerpt for each conversation, at most 600 characters."""
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{TURN_PAGE} AS text")
    return pages.excerpts(c, "conv_id", "turn", "text", max_chars=600)


@cat.query("w08_header_row", "SELECT user_id, min_by(event_id, (-h, event_id)) AS header FROM (SELECT user_id, event_id, CAST(event_type IN ('click', 'view') AS INT) + CAST(value > 50 AS INT) + CAST(event_id % 2 = 0 AS INT) AS h FROM events) GROUP BY 1")
def header_row(spark, sf_dir):
    """The row with the most known headings, the earliest on a tie."""
    h = C("event_type").isin("click", "view").cast("int") + (C("value") > 50).cast("int") + (C("event_id") % 2 == 0).cast("int")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct(h, -C("event_id"))).alias("header"))


@cat.query("w09_first_entity", "SELECT conv_id, min_by(role, turn) FILTER (length(text) > 100) AS first_role, min(turn) FILTER (length(text) > 100) AS first_turn FROM conversations GROUP BY 1")
def first_entity(spark, sf_dir):
    """The first entity of a kind by position."""
    long_ = F.length("text") > 100
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by(F.when(long_, C("role")), F.when(long_, C("turn"))).alias("first_role"), F.min(F.when(long_, C("turn"))).alias("first_turn"))


@cat.query("t01_y25_natural_order", "SELECT label, row_number() OVER (PARTITION BY p_brand ORDER BY n, label) AS place FROM (SELECT p_brand, 'WE ' || p_partkey AS label, p_partkey AS n FROM part)")
def natural_order(spark, sf_dir):
    """The units of each object in natural order."""
    p = table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("WE "), C("p_partkey").cast("string")).alias("label"))
    return p.select("label", F.row_number().over(Window.partitionBy("p_brand").orderBy(labels.natural_key(C("label")))).alias("place"))


@cat.query("t02_t04_open_items", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority <> '1-URGENT', o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 200")
def open_items(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy(C("o_orderpriority") != "1-URGENT", "o_orderpriority", C("o_totalprice").desc(), "o_orderkey").limit(200).select("o_orderkey")


@cat.query("t03_t06_page_with_total", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_totalprice > 1000) AS total FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def offset_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 1000")
    return o.orderBy("o_orderkey").offset(100).limit(50).select("o_orderkey").crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))


@cat.query("t05_j08_ranked_candidates", "SELECT l_orderkey AS k, l_linenumber AS candidate, row_number() OVER w AS rank, CASE WHEN row_number() OVER w = 1 THEN CASE WHEN s < 0.3 THEN 'none' WHEN s < 0.85 THEN 'review' WHEN s - lead(s) OVER w < 0.25 THEN 'review' ELSE 'auto' END END AS outcome FROM (SELECT *, l_discount * 10 AS s FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber)")
def candidates(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("k"), C("l_linenumber").alias("candidate"), (C("l_discount") * 10).alias("s"))
    r = op.ranked_candidates(l, "k", "s", "candidate")
    return r.select("k", "candidate", "rank", F.when(C("rank") == 1, evidence.verdict(C("s"), C("next_score"), F.lit(False), least=0.3)).alias("outcome"))


@cat.query("d02_d04_c07_upsert", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'touch' ELSE 'change' END AS action FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 5 <> 0) b ON a.k = b.k")
def upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("k"), C("o_orderstatus").alias("v"))
    return op.upsert(o.where("k % 3 <> 0"), o.where("k % 5 <> 0").withColumn("v", F.when(C("k") % 7 == 0, "X").otherwise(C("v"))), "k", "v").select("k", "action")


@cat.query("d05_fill_empty", "SELECT c_custkey, coalesce(nullif(CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'own' END, ''), c_mktsegment) AS note FROM customer")
def fill(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("note", F.when(C("c_custkey") % 3 == 0, "").when(C("c_custkey") % 3 == 2, "own"))
    return op.fill_empty(c, {"note": "c_mktsegment"}).select("c_custkey", "note")


@cat.query("d06_old_uploads", "SELECT text_hash, doc_id, current FROM (SELECT doc_id, md5(text) AS text_hash, max(doc_id) OVER (PARTITION BY text) AS current FROM documents) WHERE doc_id <> current")
def old_uploads(spark, sf_dir):
    """Earlier uploads of a file, one row each, with the current one."""
    return op.superseded(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_hash")), "text_hash", "doc_id")


@cat.query("d07_rule_mining", "SELECT source, n_chars % 40 AS b, min(lang) AS target, count(DISTINCT doc_id) AS n_documents FROM documents GROUP BY 1, 2 HAVING count(DISTINCT lang) = 1 AND count(DISTINCT doc_id) >= 2 AND NOT bool_or(n_chars % 100 = 7)")
def rule_mining(spark, sf_dir):
    """Pairs of source and length class with one language, over all documents; a length that ends in 07 speaks against."""
    d = table(spark, sf_dir, "documents").withColumn("b", C("n_chars") % 40)
    return op.agreed_targets(d, ["source", "b"], "lang", "doc_id", 2, d.where("n_chars % 100 = 7")).select("source", "b", "target", "n_documents")


@cat.query("d08_reconcile_plan", "SELECT coalesce(n, r) AS name, CASE WHEN r IS NULL THEN 'create' WHEN n IS NULL THEN 'review' ELSE 'adopt' END AS action FROM (SELECT replace(lower(n_name), '_', ' ') AS n FROM nation WHERE n_nationkey % 3 <> 0) a FULL JOIN (SELECT replace(lower(n_name), '_', ' ') AS r FROM nation WHERE n_nationkey % 4 <> 0) b ON n = r")
def reconcile(spark, sf_dir):
    """Desired against actual folders as an action plan."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", labels.folder_norm(C("n_name")).alias("name"))
    want, have = n.where("n_nationkey % 3 <> 0").select("name", F.lit(1).alias("w")), n.where("n_nationkey % 4 <> 0").select("name", F.lit(1).alias("h"))
    return want.join(have, "name", "full").select("name", F.when(C("h").isNull(), "create").when(C("w").isNull(), "review").otherwise("adopt").alias("action"))


@cat.query("d09_d11_dispositions", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'link_existing' WHEN d.n_chars < 60 THEN 'out_of_scope' WHEN d.doc_id % 97 = 0 THEN 'error' WHEN n > 1 THEN 'duplicate' ELSE 'import_new' END AS disposition FROM documents d LEFT JOIN labels l USING (doc_id) JOIN (SELECT text, count(*) AS n FROM documents GROUP BY 1) c USING (text)")
def dispositions(spark, sf_dir):
    """Cascade of dispositions for each remote document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("h"))
    counts = d.groupBy("h").agg(F.count("*").alias("n"))
    linked = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("linked"))
    return d.join(counts, "h").join(linked, "doc_id", "left").select("doc_id", F.when(C("linked"), "link_existing").when(C("n_chars") < 60, "out_of_scope").when(C("doc_id") % 97 == 0, "error").when(C("n") > 1, "duplicate").otherwise("import_new").alias("disposition"))


@cat.query("d12_samples", "WITH s AS (SELECT doc_id, quality AS label, true AS review FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, toxic, false FROM labels) SELECT doc_id, label FROM (SELECT *, bool_or(review) OVER (PARTITION BY doc_id) AS any_review FROM s) WHERE review = any_review")
def samples(spark, sf_dir):
    """Review labels override the other labels of a document."""
    l = table(spark, sf_dir, "labels")
    s = l.where("doc_id % 2 = 0").select("doc_id", C("quality").alias("label"), F.lit(True).alias("review")).unionByName(l.select("doc_id", C("toxic").alias("label"), F.lit(False).alias("review")))
    return s.withColumn("any_review", F.max("review").over(Window.partitionBy("doc_id"))).where("review = any_review").select("doc_id", "label")


@cat.query("d13_m03_additional_addresses", "SELECT DISTINCT s_suppkey AS num, s_nationkey AS street FROM supplier WHERE (s_suppkey, s_nationkey) NOT IN (SELECT c_custkey, c_nationkey FROM customer)")
def additional(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("num"), C("s_nationkey").alias("street")).distinct()
    return s.join(table(spark, sf_dir, "customer").select(C("c_custkey").alias("num"), C("c_nationkey").alias("street")), ["num", "street"], "left_anti")


@cat.query("a26_stratified_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws(':', '42', CAST(doc_id AS VARCHAR))), doc_id) AS n FROM documents) WHERE n <= 5")
def sample(spark, sf_dir):
    return op.stratified(table(spark, sf_dir, "documents"), "source", "doc_id", 5, 42).select("source", "doc_id")


@cat.query("y03_objects_with_open_work", "SELECT DISTINCT o_custkey FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'P')")
def open_work(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").distinct().join(o.where("o_orderstatus = 'P'").select("o_custkey"), "o_custkey", "left_anti")


@cat.query("y08_y11_current_owners", SPANS + "SELECT unit, owner, CAST(min(valid_from) AS VARCHAR) AS since FROM spans WHERE valid_to IS NULL OR valid_to >= DATE '1998-01-01' GROUP BY 1, 2")
def current_owners(spark, sf_dir):
    s = spans(spark, sf_dir).where(C("valid_to").isNull() | (C("valid_to") >= periods.day("1998-01-01")))
    return s.groupBy("unit", "owner").agg(F.min("valid_from").cast("string").alias("since"))


@cat.query("y14_overview", "SELECT n_name, r_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, n_name) AS place FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey")
def overview(spark, sf_dir):
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_regionkey < 3"), C("n_regionkey") == C("r_regionkey"), "left")
    return j.select("n_name", "r_name", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey", "n_name")).alias("place"))


@cat.query("p05_p07_object_search", "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE (c_custkey = 77 OR lower(c_mktsegment) LIKE '%build%') AND o_orderstatus <> 'P' AND c_nationkey NOT IN (3, 4)")
def search(spark, sf_dir):
    """Conjunctive filters with a semi-join in place of distinct."""
    c = table(spark, sf_dir, "customer").where(((C("c_custkey") == 77) | F.lower("c_mktsegment").contains("build")) & ~C("c_nationkey").isin(3, 4))
    return c.join(table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(C("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")
