"""Table recognition on words with positions, and fixed-shape readers for lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def column_bounds(words: DataFrame, page: str, min_gap: float) -> DataFrame:
    """Middles of the gaps between columns; islands of the words' horizontal spans."""
    before = F.max("x1").over(Window.partitionBy(page).orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("before", before).where(F.col("x0") > F.col("before") + min_gap).select(page, ((F.col("before") + F.col("x0")) / 2).alias("bound"))


def row_clusters(words: DataFrame, page: str) -> DataFrame:
    """Rows of a page. A word opens a new row if its top is more than 0.6 median heights off the row's first top;
    that anchor moves with each new row, so a page is walked in order inside one group."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["top", "x0"], kind="stable")
        limit = 0.6 * float((pdf["bottom"] - pdf["top"]).median())
        rows, anchor, row = [], None, -1
        for top in pdf["top"]:
            if anchor is None or abs(top - anchor) > limit:
                anchor, row = top, row + 1
            rows.append(row)
        return pdf.assign(row_no=rows)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema) + ", row_no int"
    return words.groupBy(page).applyInPandas(walk, schema)


def mean_of_hundredths(x: Column) -> Column:
    """The mean to one place, halves up, of numbers from 0 taken in whole hundredths; so it doesn't depend on the order of rows."""
    total, n = F.sum(F.round(x * 100).cast("long")), F.count(x)
    return F.when(n > 0, F.call_function("div", 2 * total + 10 * n, F.nullif(20 * n, F.lit(0))) / 10)


def build_cells(words: DataFrame, bounds: Column) -> DataFrame:
    """Words to columns by their centre, joined text and mean confidence; needs page, row_no, text, x0, x1, conf."""
    column = F.size(F.filter(bounds, lambda b: b <= (F.col("x0") + F.col("x1")) / 2))
    parts = F.array_sort(F.collect_list(F.struct("x0", "text")))
    cells = words.withColumn("column_no", column).groupBy("page", "row_no", "column_no")
    return cells.agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), mean_of_hundredths(F.col("conf")).alias("conf"))


def is_footer(cells: Column) -> Column:
    """One filled cell that is a page number."""
    filled = F.filter(cells, lambda c: F.trim(c) != "")
    return (F.size(filled) == 1) & F.coalesce(F.try_element_at(filled, F.lit(1)).rlike(r"(?i)^\s*(seite\s*)?[0-9]+(\s*(von|/)\s*[0-9]+)?\s*$"), F.lit(False))


def merge_pages(rows: DataFrame, document: str = "document_id", lead: int = 3) -> DataFrame:
    """Pages as one table. Rows at the start of later pages that repeat the first page's lead rows go, and so do footers.

    ``rows``: document, page, row_no, cells array<string>."""
    first = rows.where((F.col("page") == 1) & (F.col("row_no") < lead)).groupBy(document).agg(F.collect_set(F.to_json("cells")).alias("__lead"))
    known = F.coalesce(F.array_contains("__lead", F.to_json("cells")), F.lit(False))
    run = Window.partitionBy(document, "page").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.join(first, document, "left").withColumn("__leading", F.min(known.cast("int")).over(run) == 1)
    return marked.where(~((F.col("page") > 1) & F.col("__leading")) & ~is_footer(F.col("cells"))).drop("__lead", "__leading")


def read_ocr_words(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Word rows of OCR output in tab-separated form; level 5, with letters or digits, negative confidence to null."""
    schema = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"
    raw = spark.read.csv(path, sep="\t", header=header, schema=schema, quote="")
    words = raw.where((F.col("level") == 5) & F.col("text").rlike(r"[\p{L}\p{N}]"))
    return words.select("page_num", "text", F.col("left").alias("x0"), (F.col("left") + F.col("width")).alias("x1"), "top", (F.col("top") + F.col("height")).alias("bottom"), F.when(F.col("conf") >= 0, F.col("conf")).alias("conf"))


def ragged(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files as rows of cells, with the encoding and delimiter found for each file.

    Files are split lists of records, so each is one task's work; columns: path, row_no, cells array<string>, encoding, delimiter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                encoding, text = decode(bytes(content))
                mark = delimiter(text)
                rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), delimiter=mark)]
                yield pd.DataFrame({"path": name, "row_no": range(len(rows)), "cells": rows, "encoding": encoding, "delimiter": mark})

    return files.mapInPandas(read, "path string, row_no int, cells array<string>, encoding string, delimiter string")


def decode(data: bytes) -> tuple[str, str]:
    """The first encoding that decodes without an error."""
    for name in ("utf-8-sig", "utf-8", "cp1252"):
        try:
            return name, data.decode(name)
        except UnicodeDecodeError:
            continue
    return "latin-1", data.decode("latin-1")


def delimiter(sample: str) -> str:
    """By the standard sniffer on the first lines, else the most frequent, else a semicolon."""
    import csv

    head = "\n".join(sample.splitlines()[:20])
    try:
        return csv.Sniffer().sniff(head, delimiters=";,\t|").delimiter
    except csv.Error:
        best = max(";,\t|", key=head.count)
        return best if head.count(best) else ";"


def profile_scores(header: Column, profiles: dict[str, tuple[list[str], int, float]], fallback: str = "generic") -> Column:
    """The best profile by known headings. ``profiles``: name to (headings, least hits, score)."""
    lower = F.transform(header, lambda c: F.lower(F.trim(c)))
    scored = [F.struct(F.when(F.size(F.array_intersect(lower, F.array(*map(F.lit, heads)))) >= least, score).otherwise(0.0).alias("score"), F.lit(k).alias("rank"), F.lit(name).alias("name")) for k, (name, (heads, least, score)) in enumerate(profiles.items())]
    return F.array_max(F.array(F.struct(F.lit(0.1).alias("score"), F.lit(-1).alias("rank"), F.lit(fallback).alias("name")), *scored))
