"""Intake of files: what is taken, the registry of readers, and kinds by content."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from foliospark.sources import formats, intake

FILES = [
    ("/in/a.PDF", b"x", "a.PDF", "registered", None),
    ("/in/b/", b"x", "b", "refused", "suffix"),
    ("c:\\d\\e.txt", b"xy", "c:_d_e.txt", "registered", None),
    ("/in/.html", b"x", ".html", "refused", "suffix"),
    ("f.tar.gz", b"x", "f.tar.gz", "refused", "suffix"),
    ("g.csv", b"", "g.csv", "refused", "empty"),
    ("h.csv", None, "h.csv", "refused", "empty"),
    ("i.csv", b"x" * 9, "i.csv", "refused", "too_large"),
    ("  ", b"x", "dokument", "refused", "suffix"),
    (None, b"x", "dokument", "refused", "suffix"),
]


def test_accepted(spark):
    df = spark.createDataFrame([(k, *f[:2]) for k, f in enumerate(FILES)], "name2 int, path string, content binary")
    got = intake.accepted(df, most=8).orderBy("name2").collect()
    for (_, content, name, status, reason), r in zip(FILES, got, strict=True):
        assert (r["name"], r["status"], r["reason"], r["bytes"]) == (name, status, reason, len(content or b""))
        assert r["content_hash"] == (hashlib.sha256(content).hexdigest() if status == "registered" else None)


def test_registry(spark):
    registry = intake.standard([(["a", "b", "c"], 2)])
    with pytest.raises(ValueError, match="already"):
        registry.add(intake.Reader("generic_table", "x", lambda name, rows: F.lit(1.0)))
    with pytest.raises(ValueError, match="no reader"):
        intake.Registry().choose(F.lit("x"), F.array())
    asked = [("x.csv", [["z"], [" A ", "b"]], None, "vendor_export"), ("x.csv", [["a", "a"]], None, "csv_generic"), ("x.csv", None, None, "csv_generic"), ("x.bin", [], None, "generic_table"), (None, [], None, "generic_table"), ("x.csv", [["a", "b"]], "second_vendor_export", "second_vendor_export"), ("x.csv", [[]] * 5 + [["a", "b"]], "none", "csv_generic")]
    df = spark.createDataFrame([(k, *a[:3]) for k, a in enumerate(asked)], "k int, name string, rows array<array<string>>, manual string")
    got = df.select("k", registry.choose(F.col("name"), F.col("rows"), F.col("manual")).alias("c")).orderBy("k").collect()
    assert [r["c"]["code"] for r in got] == [a[3] for a in asked]
    assert set(got[0]["c"]["scores"]) == set(registry.readers)
    registry.add(intake.Reader("special", "s", lambda name, rows: F.when(name.endswith("special.bin"), 0.95).otherwise(0.0)))
    df = spark.createDataFrame([("my.special.bin",)], "name string")
    assert df.select(registry.choose(F.col("name"), F.array().cast("array<array<string>>"))["code"]).first()[0] == "special"


def test_temporary_names_and_bitmaps(spark):
    bitmap = b"BM" + b"\x40\0\0\0" + b"\0" * 30
    rows = [("a.hed", b"%PDF-1"), ("a.indir", bitmap), ("a.herunterladen", b"BMW faehrt " * 9), ("a.pdf", b"x"), ("ohne", b"<html>"), ("a.TMP", b"")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, name string, content binary")
    got = [tuple(r["c"]) for r in df.select("k", formats.kind_checked(F.col("name"), F.lit("application/octet-stream"), F.col("content")).alias("c")).orderBy("k").collect()]
    assert got == [("pdf", True), ("bmp", True), ("unsupported", True), ("pdf", False), ("html", True), ("unsupported", True)]
