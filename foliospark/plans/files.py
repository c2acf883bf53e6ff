"""Readers and writers of files: rows of the tables go into files in the shared folder and are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import formats, intake, tables, workbooks
from ..sources.shared import fresh, written
from ..streaming import incremental
from .base import C, Catalogue, spread, table
from .imports import one_of

cat = Catalogue()
QUERIES, ORACLE_SQL = cat.queries, cat.oracles


@cat.query("s04_k01_workbooks", """
    SELECT 'list-' || (s_suppkey % 7) || '.xlsx' AS path, row_number() OVER (PARTITION BY s_suppkey % 7 ORDER BY s_suppkey) AS row_no, 'WE ' || s_suppkey AS unit, trim(s_name) AS name, round(s_acctbal, 2)::VARCHAR AS amount
    FROM supplier""")
def workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as workbooks with a cover sheet, and the sheet that is found to be the list."""
    s = table(spark, sf_dir, "supplier")
    path = F.concat(F.lit("list-"), (C("s_suppkey") % 7).cast("string"), F.lit(".xlsx"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("s_suppkey"))
    own = s.withColumn("path", path).withColumn("row_no", place)
    cells = F.array(F.concat(F.lit("WE "), C("s_suppkey").cast("string")), C("s_name"), F.round("s_acctbal", 2).cast("string"))
    rows = own.select("path", F.lit(1).alias("sheet_no"), F.lit("Aktuell").alias("sheet"), "row_no", cells.alias("cells"))
    heads = own.select("path").distinct()
    cover = heads.select("path", F.lit(0).alias("sheet_no"), F.lit("Hinweise & Stand").alias("sheet"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row_no"), F.array(F.lit("<Stand>"), F.lit("2024")).alias("cells"))
    title = heads.select("path", F.lit(1).alias("sheet_no"), F.lit("Aktuell").alias("sheet"), F.lit(0).alias("row_no"), F.array(F.lit("Einheit"), F.lit("Name"), F.lit(None).cast("string")).alias("cells"))
    files = written(workbooks.workbooks(cover.unionByName(title).unionByName(rows)), "workbooks")
    found = workbooks.chosen_sheets(workbooks.read_sheets(files)).where("row_no > 0")
    return found.select("path", "row_no", C("cells")[0].alias("unit"), C("cells")[1].alias("name"), C("cells")[2].alias("amount"))


@cat.query("s25_documents", "SELECT 'list-' || (n_nationkey % 3) || '.xlsx' AS path, 1 AS page, '[Blatt Liste]' || chr(10) || string_agg(n_name || chr(9) || n_regionkey, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_nationkey % 3")
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text pages of workbooks."""
    n = table(spark, sf_dir, "nation").withColumn("path", F.concat(F.lit("list-"), (C("n_nationkey") % 3).cast("string"), F.lit(".xlsx")))
    rows = n.select("path", F.lit(0).alias("sheet_no"), F.lit("Liste").alias("sheet"), C("n_nationkey").cast("int").alias("row_no"), F.array("n_name", C("n_regionkey").cast("string")).alias("cells"))
    return workbooks.read_documents(written(workbooks.workbooks(rows), "workbooks"))


@cat.query("s01_s02_s03_lists", """
    SELECT (c_custkey % 16)::INT AS file, ';' AS delimiter, count(*) AS n, sum(length(c_name) + length(c_mktsegment) + 5) AS chars FROM customer GROUP BY ALL""")
def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited files in the shared folder, read with the encoding and delimiter that each shows."""
    path = fresh(spark, "lists")
    c = table(spark, sf_dir, "customer").select((C("c_custkey") % 16).cast("int").alias("file"), F.concat_ws(";", "c_name", "c_mktsegment", F.lit("Müßig")).alias("line"))
    c.repartition("file").write.partitionBy("file").text(path)
    rows = tables.ragged(spark, path)
    named = rows.withColumn("file", F.regexp_extract("path", r"/file=(\d+)/", 1).cast("int"))
    return named.groupBy("file", "delimiter").agg(F.count("*").alias("n"), F.sum(F.length(F.array_join("cells", ""))).alias("chars"))


@cat.query("s12_ocr_words", "SELECT event_type AS text, event_id % 900 AS x0, event_id % 900 + 10 AS x1, event_id % 700 AS top, event_id % 700 + 8 AS bottom, CASE WHEN event_id % 3 > 0 THEN round(value, 2) END AS conf FROM events WHERE event_id % 5 < 4")
def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word rows of OCR files: other levels and words without letters go, unknown confidence is null."""
    path = fresh(spark, "ocr")
    e = table(spark, sf_dir, "events")
    number = lambda x: x.cast("int").cast("string")
    word = F.when(C("event_id") % 5 == 4, "--").otherwise(C("event_type"))
    conf = F.when(C("event_id") % 3 > 0, F.round("value", 2)).otherwise(-1.0).cast("string")
    fields = [F.lit("5"), *[F.lit("1")] * 5, number(C("event_id") % 900), number(C("event_id") % 700), F.lit("10"), F.lit("8"), conf, word]
    e.select(F.concat_ws("\t", *fields).alias("line")).write.option("lineSep", "\n").text(path)
    heads = spark.createDataFrame([("4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\tline",)], "line string")
    heads.write.mode("append").text(path)
    return tables.read_ocr_words(spark, path, header=False).select("text", "x0", "x1", "top", "bottom", "conf")


MAIL = "concat('From: ', c_name, ' <K', CAST(c_custkey AS STRING), '@Haus.example>', chr(10), 'To: x@y.example', chr(10), 'Subject: AW: Miete ', CAST(c_custkey AS STRING), chr(10), 'Date: Mon, 01 Jan 2024 10:00:00 +0000', chr(10), chr(10), 'Hallo ', c_mktsegment)"


@cat.query("s27_s29_messages", "SELECT 'AW: Miete ' || c_custkey AS subject, trim(c_name) AS from_name, 'k' || c_custkey || '@haus.example' AS from_address, '2024-01-01T10:00:00+00:00' AS date FROM customer")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole message texts as headers and pages."""
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    raw = customers.select(F.concat(F.lit("m"), C("c_custkey").cast("string"), F.lit(".eml")).alias("path"), F.expr(MAIL).cast("binary").alias("content"))
    return formats.parse_messages(raw).select("subject", "from_name", "from_address", "date")


@cat.query("s33_s34_files", "SELECT 'part-' || file || '.txt' AS name, n * 6 AS length FROM (SELECT (p_partkey % 9)::INT AS file, count(*) AS n FROM part GROUP BY 1) WHERE file NOT IN (3, 5)")
def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a folder without ignored and empty ones."""
    path = fresh(spark, "files")
    p = table(spark, sf_dir, "part").select((C("p_partkey") % 9).cast("int").alias("file"), F.lpad((C("p_partkey") % 100000).cast("string"), 5, "0").alias("line"))
    p.repartition("file").write.partitionBy("file").text(path)
    found = formats.list_files(spark, path, ignored=["_SUCCESS", "*.crc"])
    named = found.groupBy(F.regexp_extract("path", r"/file=(\d+)/", 1).alias("file")).agg(F.sum("length").alias("length"))
    kept = formats.not_ignored(named.withColumn("name", F.concat(F.lit("part-"), "file", F.lit(".txt"))), "name", ["part-3.*", "PART-5.txt"])
    return kept.select("name", "length")


UPLOAD = one_of(
    "page_id",
    "concat('/in/', CAST(page_id AS STRING), '.HTML')",
    "concat('C:\\\\alt\\\\', CAST(page_id AS STRING), '.pdf')",
    "concat('/in/', CAST(page_id AS STRING), '.exe')",
    "'/in/.html'",
    "concat('/in/ohne Endung ', CAST(page_id AS STRING), '/')",
    "concat('/in/leer.', CAST(page_id AS STRING), '.txt')",
    "'   '",
)
UPLOADED = "CASE WHEN page_id % 7 = 5 THEN '' WHEN page_id % 3 = 2 THEN repeat(html, 40) ELSE html END"
MOST = 100_000


@cat.query("s32_d01_intake", f"""
    WITH f AS (SELECT page_id, {UPLOAD.replace("AS STRING", "AS VARCHAR").replace(chr(92) * 2, chr(92))} AS path, encode({UPLOADED}) AS content FROM pages),
    n AS (SELECT *, coalesce(nullif(trim(replace(regexp_extract(path, '([^/]*)/*$', 1), chr(92), '_')), ''), 'dokument') AS name FROM f),
    s AS (SELECT *, lower(regexp_extract(name, '[^/]([.][^./]+)$', 1)) AS suffix FROM n),
    r AS (SELECT *, CASE WHEN suffix NOT IN ('.html', '.pdf', '.txt') THEN 'suffix' WHEN octet_length(content) > {MOST} THEN 'too_large' WHEN octet_length(content) = 0 THEN 'empty' END AS reason FROM s)
    SELECT page_id, name, suffix, octet_length(content)::BIGINT AS bytes, CASE suffix WHEN '.html' THEN 'text/html' WHEN '.pdf' THEN 'application/pdf' WHEN '.txt' THEN 'text/plain' END AS mime_type,
           CASE WHEN reason IS NULL THEN sha256(content) END AS content_hash, CASE WHEN reason IS NULL THEN 'registered' ELSE 'refused' END AS status, reason FROM r""")
def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of uploads, taken or refused, with the hashes of what is taken."""
    feed = incremental.file_feed(spark, f"{sf_dir}/pages*.parquet", table(spark, sf_dir, "pages").schema)
    files = feed.selectExpr("page_id", f"{UPLOAD} AS path", f"CAST({UPLOADED} AS BINARY) AS content")
    return incremental.run_available(intake.accepted(files, MOST).drop("path"), fresh(spark, "intake"), ["page_id"], mode="append")


LIST_NAME = one_of("c_custkey", "'einheiten.CSV'", "'liste.xlsx'", "'liste.tsv'", "'scan.JPG'", "'daten.dat'", "'kontakte.txt'", "CAST(NULL AS STRING)")
HEADINGS = one_of("floor(c_custkey / 7)", "'x;y|Objekt; Einheit ;MIETER;Miete'", "'Name;Telefon|E-Mail;Name'", "'Objekt;Einheit;Objekt;Objekt'", "'1|2|3|4|5|Objekt;Einheit;Mieter'")
CHOSEN = one_of("c_custkey", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "'second_vendor_export'", "'unknown'", "CAST(NULL AS STRING)")
HITS = "len(list_intersect(list_distinct(list_transform(string_split({row}, ';'), lambda c: lower(trim(c)))), {heads}))"


@cat.query("u03_s09_readers", f"""
    WITH f AS (SELECT c_custkey AS k, {LIST_NAME.replace("AS STRING", "AS VARCHAR")} AS name, {HEADINGS} AS rows, {CHOSEN.replace("AS STRING", "AS VARCHAR")} AS manual FROM customer),
    s AS (SELECT *, lower(regexp_extract(coalesce(name, ''), '[^/]([.][^./]+)$', 1)) AS suffix,
                 len(list_filter(string_split(rows, '|')[1:5], lambda r: {HITS.format(row="r", heads="['objekt', 'einheit', 'mieter', 'miete']")} >= 3 OR {HITS.format(row="r", heads="['name', 'telefon', 'e-mail']")} >= 2)) > 0 AS vendor FROM f)
    SELECT k, CASE WHEN manual = 'second_vendor_export' THEN manual WHEN suffix IN ('.csv', '.txt') AND vendor THEN 'vendor_export' WHEN suffix = '.jpg' THEN 'image_scan' WHEN suffix = '.xlsx' THEN 'xlsx_generic'
                   WHEN suffix IN ('.csv', '.txt', '.tsv') THEN 'csv_generic' ELSE 'generic_table' END AS code,
           CASE WHEN manual = 'second_vendor_export' THEN 0.0 WHEN suffix IN ('.csv', '.txt') AND vendor THEN 0.95 WHEN suffix = '.jpg' THEN 0.8 WHEN suffix = '.xlsx' THEN 0.7
                WHEN suffix IN ('.csv', '.txt', '.tsv') THEN 0.6 ELSE 0.1 END::DOUBLE AS score FROM s""")
def readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered reader that fits a file best, or the one that was chosen by hand."""
    registry = intake.standard([(["objekt", "einheit", "mieter", "miete"], 3), (["name", "telefon", "e-mail"], 2)])
    src = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", f"{LIST_NAME} AS name", f"{HEADINGS} AS rows", f"{CHOSEN} AS manual")
    rows = F.transform(F.split("rows", r"\|"), lambda r: F.split(r, ";"))
    return src.select("k", registry.choose(C("name"), rows, C("manual")).alias("c")).select("k", "c.code", "c.score")
