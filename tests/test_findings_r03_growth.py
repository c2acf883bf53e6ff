"""Findings of the third round on time at larger sizes."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from foliospark.functions import addresses
from foliospark.operators import classifier
from foliospark.plans import base, registry
from foliospark.sources import formats


def tasks_of_rows(spark, query, sf_dir) -> int:
    """The number of tasks in which the rows of ``query`` come out."""
    return registry.QUERIES[query](spark, sf_dir).select(F.spark_partition_id().alias("task")).distinct().count()


def narrow(spark, tmp_path, name, rows) -> str:
    """A folder with a table of ``rows`` of sf0.001 in one file."""
    spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(rows).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_messages_are_read_in_all_tasks(spark, tmp_path):
    """One row group of customers; before, one task parsed every message."""
    tasks = base.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert tasks_of_rows(spark, "s27_s29_messages", narrow(spark, tmp_path, "customer", 150)) == tasks


def test_remembered_headers_are_shown_as_the_message_shows_them(spark):
    """Encoded, folded, repeated, empty and missing headers."""
    from email import policy
    from email.parser import BytesParser

    heads = [
        "From: =?utf-8?q?M=C3=BCller=2C_Jo?= <Jo@Haus.example>\nTo: a@b.example,\n c@d.example\nSubject: eins\n zwei\nDate: Mon, 01 Jan 2024 10:00:00 +0000",
        "from: x@y.example\nFROM: other@y.example\nSubject:\nDate: gestern",
        "X-Note: nichts",
        "To: a@b.example,\n c@d.example\nSubject: =?iso-8859-1?q?Gr=FC=DFe?=\nDate: ",
    ]
    raw = [f"{h}\n\nHallo {k}".encode() for k, h in enumerate(heads)]
    df = spark.createDataFrame([(f"m{k}.eml", r) for k, r in enumerate(raw)], "path string, content binary")
    for r in formats.parse_messages(df).collect():
        m = BytesParser(policy=policy.default).parsebytes(bytes(raw[int(r["path"][1])]))
        want = [str(m.get(h, "")) for h in ("From", "To", "Date", "Subject")]
        assert r["text"].split("\n\n")[0] == "\n".join(f"{n}: {v}" for n, v in zip(("Von", "An", "Datum", "Betreff"), want, strict=True))
        assert (r["subject"], r["to"]) == (want[3], want[1] or None)
    got = {r["path"]: r["date"] for r in formats.parse_messages(df).collect()}
    assert got == {"m0.eml": "2024-01-01T10:00:00+00:00", "m1.eml": None, "m2.eml": None, "m3.eml": None}


AROUND = r"(?iu)[^\n,;:()]{0,90},[ \t]*\d{5}[ \t]+[A-ZÄÖÜ][^\n\d,;:()]{2,40}?(?=[\s,;.]|$)"


def test_surroundings_of_codes_are_those_of_one_pattern(spark):
    """Codes in a row, long lines, marks, line ends, letters outside the basic plane; the one pattern read 90 characters at each place."""
    rng = random.Random(11)
    pieces = [",", ", ", ",\t", "12345", " 12345 Rheinau", "54321 Bad Auen", ", 54321 Auenstadt", "Ulmenpark 7", "\n", " ", ";", "(", "ä", "Ö", "x" * 50, "𝄞", ".", " ", "\r", "ſee", " 99999  a1"]
    rows = [(k, "".join(rng.choices(pieces, k=rng.randint(0, 25)))) for k in range(4000)] + [(4000, ""), (4001, ","), (4002, "y" * 200 + ", 12345 Talheim")]
    both = spark.createDataFrame(rows, "k long, t string").select("t", addresses.around_codes(F.col("t")).alias("got"), F.regexp_extract_all("t", F.lit(AROUND), F.lit(0)).alias("want"))
    assert both.where("size(want) > 1").count() > 500
    assert both.where("got <> want").collect() == []


def test_long_texts_are_searched_for_addresses_in_little_time(spark):
    """Two million characters without a comma: the pattern began anew at each of them."""
    line = "ein langer Satz ohne Zeichen dazwischen und noch einer "
    df = spark.createDataFrame([(line * 36_000,)], "t string")
    searched = lambda f: [time.perf_counter(), df.select(F.size(f(F.col("t"))).alias("n")).collect(), time.perf_counter()]
    searched(addresses.around_codes)
    old, new = ((lambda a, _, b: b - a)(*searched(f)) for f in (lambda t: F.regexp_extract_all(t, F.lit(AROUND), F.lit(0)), addresses.around_codes))
    assert new < old


def test_documents_are_searched_in_all_tasks(spark, tmp_path):
    assert tasks_of_rows(spark, "y33_addresses_in_text", narrow(spark, tmp_path, "documents", 200)) == base.TASKS_A_CORE * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("query", ["f08_scrub_json", "f01_mask_text", "f20_mask_cell", "y02_masked_pages"])
def test_customers_are_masked_in_all_tasks(spark, tmp_path, query):
    assert tasks_of_rows(spark, query, narrow(spark, tmp_path, "customer", 150)) == base.TASKS_A_CORE * spark.sparkContext.defaultParallelism


def test_classifier_reads_texts_once_and_learns_the_same(spark):
    """Before, each document frequency and each pass over the samples split and counted the texts again."""
    words = ["miete", "haus", "konto", "brief", "dach", "zahlung"]
    rows = [(k, " ".join(words[(k * j) % 6] for j in range(1, 6)), "ab"[k % 3 == 0]) for k in range(120)]
    samples = classifier.with_weights(spark.createDataFrame(rows, "id long, text string, label string").coalesce(1))
    reads = spark.sparkContext.accumulator(0)

    def read(text):
        reads.add(1)
        return text

    model = classifier.fitted(samples.withColumn("text", F.udf(read, "string").asNondeterministic()("text")), 64)
    assert reads.value == len(rows)
    docs = samples.select("id", "text")
    got, want = ({r["id"]: (r["top"], round(r["p"], 6)) for r in classifier.predict(m, docs).collect()} for m in (model, classifier.pipeline(64).fit(samples)))
    assert got == want
