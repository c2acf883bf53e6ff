"""Intake of files: which are taken, and which reader fits; the same for a table of files and for a stream of them.

Readers are entries of a registry. Each has a code, the suffixes that it reads, and an expression that scores a file by its name and the
cells of its first rows; so choosing a reader is one projection, whatever is registered. Files are read by Spark's own sources, which reach
every store; a reader is given their content.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes that are taken, their media types, and the most bytes of a file.
MEDIA = {
    ".pdf": "application/pdf", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".tif": "image/tiff", ".tiff": "image/tiff", ".bmp": "image/bmp",
    ".gif": "image/gif", ".webp": "image/webp", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12", ".csv": "text/csv",
    ".txt": "text/plain", ".eml": "message/rfc822", ".msg": "application/vnd.ms-outlook", ".html": "text/html", ".htm": "text/html",
}
MOST_BYTES, NAMELESS = 524_288_000, "dokument"
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff")
FIRST_ROWS = 5


def safe_name(name: Column) -> Column:
    """The last part of a path, without what could part it again; ``dokument`` if nothing is left."""
    last = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)/*$", 1)
    return F.coalesce(F.nullif(F.trim(F.replace(last, F.lit("\\"), F.lit("_"))), F.lit("")), F.lit(NAMELESS))


def suffix_of(name: Column) -> Column:
    """The lower-case suffix with its dot; empty for names without one and for those that only begin with a dot."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def accepted(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """``files`` (path, content) with name, suffix, bytes, mime_type, content_hash, status and reason.

    ``status`` is registered, or refused with the first ``reason`` of: suffix, too_large, empty. The hash is of the content, null if refused;
    null content is empty. Works on a stream as on a table: nothing looks at two rows.
    """
    name = safe_name(F.col("path"))
    suffix, length = suffix_of(name), F.coalesce(F.length("content"), F.lit(0)).cast("long")
    kinds = F.create_map(*(F.lit(v) for pair in MEDIA.items() for v in pair))
    reason = F.when(~suffix.isin(*MEDIA), "suffix").when(length > most, "too_large").when(length == 0, "empty")
    return files.select(
        *[c for c in files.columns if c != "content"], name.alias("name"), suffix.alias("suffix"), length.alias("bytes"), F.try_element_at(kinds, suffix).alias("mime_type"),
        F.when(reason.isNull(), F.sha2("content", 256)).alias("content_hash"), F.when(reason.isNull(), "registered").otherwise("refused").alias("status"), reason.alias("reason"),
    )


@dataclass(frozen=True)
class Reader:
    """A reader: ``score`` maps a lower-case file name and the cells of its first rows (array<array<string>>) to 0 to 1."""

    code: str
    source_format: str
    score: Callable[[Column, Column], Column]


def by_suffix(suffixes: tuple[str, ...], score: float) -> Callable[[Column, Column], Column]:
    return lambda name, rows: F.when(suffix_of(name).isin(*suffixes), score).otherwise(0.0)


def by_headings(suffixes: tuple[str, ...], lists: list[tuple[list[str], int]], score: float) -> Callable[[Column, Column], Column]:
    """A file with one of the suffixes, of whose first rows one has enough of a list's headings."""

    def scored(name: Column, rows: Column) -> Column:
        cells = lambda row: F.array_distinct(F.transform(row, lambda c: F.lower(F.trim(c))))
        hit = lambda row: [F.size(F.array_intersect(cells(row), F.array(*map(F.lit, heads)))) >= least for heads, least in lists]
        any_of = lambda row: F.exists(F.array(*hit(row)), lambda x: x)
        return F.when(suffix_of(name).isin(*suffixes) & F.coalesce(F.exists(F.slice(rows, 1, FIRST_ROWS), any_of), F.lit(False)), score).otherwise(0.0)

    return scored


@dataclass
class Registry:
    """Readers by code. Among equal scores ``preferred`` wins, then the one that was registered first."""

    readers: dict[str, Reader] = field(default_factory=dict)
    preferred: str | None = None

    def add(self, reader: Reader) -> None:
        if reader.code in self.readers:
            raise ValueError(f"there is a reader {reader.code!r} already")
        self.readers[reader.code] = reader

    def choose(self, name: Column, rows: Column, manual: Column | None = None) -> Column:
        """Struct of code, source_format, score and all scores. A known ``manual`` code is taken as it is; a null name has none."""
        if not self.readers:
            raise ValueError("no reader is registered")
        low = F.lower(F.coalesce(name, F.lit("")))
        scored = [F.struct(r.score(low, rows).cast("double").alias("score"), F.lit(r.code == self.preferred).alias("preferred"), F.lit(-k).alias("order"), F.lit(r.code).alias("code"), F.lit(r.source_format).alias("source_format")) for k, r in enumerate(self.readers.values())]
        every = F.array(*scored)
        asked = F.lit(None).cast("string") if manual is None else manual
        best = F.coalesce(F.try_element_at(F.filter(every, lambda s: s["code"] == asked), F.lit(1)), F.array_max(every))
        return F.struct(best["code"].alias("code"), best["source_format"].alias("source_format"), best["score"].alias("score"), F.map_from_entries(F.transform(every, lambda s: F.struct(s["code"], s["score"]))).alias("scores"))


def standard(vendor_lists: list[tuple[list[str], int]]) -> Registry:
    """The readers of lists, with a vendor's headings. The second vendor's export has no known headings: it scores 0 and is chosen by hand."""
    registry = Registry(preferred="vendor_export")
    for code, source_format, score in (
        ("vendor_export", "vendor", by_headings((".csv", ".txt"), vendor_lists, 0.95)),
        ("xlsx_generic", "xlsx", by_suffix((".xlsx", ".xlsm"), 0.7)),
        ("csv_generic", "csv", by_suffix((".csv", ".txt", ".tsv"), 0.6)),
        ("image_scan", "scan", by_suffix(IMAGES, 0.8)),
        ("second_vendor_export", "second_vendor", lambda name, rows: F.lit(0.0)),
        ("generic_table", "other", lambda name, rows: F.lit(0.1)),
    ):
        registry.add(Reader(code, source_format, score))
    return registry
