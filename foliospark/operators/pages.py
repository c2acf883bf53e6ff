"""Pages of documents: masking before they are kept, and excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bank
from ..functions.text import compress_blank_lines, truncate


def masked(pages: DataFrame, mode: str = "fulltext", key: bytes | None = None, text_column: str = "text") -> DataFrame:
    """``pages`` with the masked text in place of the text, ``hits`` and ``n_hits``; the clear text goes no further."""
    found = pages.withColumn("__masked", bank.mask_text(F.col(text_column), mode, key))
    kept = [F.col("__masked.text").alias(c) if c == text_column else F.col(c) for c in pages.columns]
    return found.select(*kept, F.col("__masked.hits").alias("hits"), F.coalesce(F.size("__masked.hits"), F.lit(0)).alias("n_hits"))


def split_pages(text: Column, expected: Column, mark: str = "\f") -> Column:
    """The pages of a text file, exactly ``expected`` many: an empty last one doesn't count, missing ones are empty."""
    parts = F.split(F.coalesce(text, F.lit("")), mark, -1)
    whole = F.when(F.trim(F.element_at(parts, -1)) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    padded = F.concat(whole, F.array_repeat(F.lit(""), F.greatest(expected - F.size(whole), F.lit(0))))
    return F.slice(padded, 1, expected)


def without_repeated_lines(pages: DataFrame, document: str, page: str, text: str, least: int = 3) -> DataFrame:
    """Lines that begin or end ``least`` or more pages of a document stay on its first page only.

    Returns ``document``, ``page``, ``text`` (white space around a page is cut) and ``dropped``, the number of lines that went.
    """
    lines = pages.select(document, page, F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), "\n", -1).alias("__lines"))
    ends = [lines.select(document, F.lit(k).alias("__end"), F.trim(F.element_at("__lines", at)).alias("__line")) for k, at in ((0, 1), (1, -1))]
    often = ends[0].unionByName(ends[1]).where("__line <> ''").groupBy(document, "__end", "__line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    known = often.groupBy(document).agg(F.collect_set("__line").alias("__often"))
    first = lines.groupBy(document).agg(F.min(page).alias("__first"))
    kept = F.when(F.col(page) == F.col("__first"), F.col("__lines")).otherwise(F.filter("__lines", lambda x: ~F.coalesce(F.array_contains("__often", F.trim(x)), F.lit(False))))
    marked = lines.join(first, document).join(known, document, "left").withColumn("__kept", kept)
    return marked.select(document, page, F.array_join("__kept", "\n").alias(text), (F.size("__lines") - F.size("__kept")).alias("dropped"))


def chosen_pages(pages: DataFrame, document: str, page: str, first: int = 3) -> DataFrame:
    """The first pages and the last one of each document."""
    n = F.row_number().over(Window.partitionBy(document).orderBy(page))
    last = F.max(page).over(Window.partitionBy(document))
    return pages.withColumns({"__n": n, "__last": last}).where((F.col("__n") <= first) | (F.col(page) == F.col("__last"))).drop("__n", "__last")


def excerpts(pages: DataFrame, document: str, page: str, text: str, first: int = 3, max_chars: int = 10_500) -> DataFrame:
    """one excerpt a document: chosen pages without repeated lines, blank lines compressed, joined by form feeds and cut to size."""
    clean = without_repeated_lines(chosen_pages(pages, document, page, first), document, page, text)
    parts = F.array_sort(F.collect_list(F.struct(F.col(page), compress_blank_lines(F.col(text)).alias("t"))))
    return clean.groupBy(document).agg(truncate(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\f"), max_chars).alias("excerpt"))
