"""Workbooks and text documents: zip files with XML inside, read and written file by file in tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
OPEN_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
OPEN_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
#: Fixed value: what a cell holds that counts as a unit's label.
UNIT_LIKE = r"^\s*(WE|GE|TG|GA|ST|SP|S|Garage|Stellplatz|Wohnung|Haus)\s*(Nr\.?)?\s*\d+"
#: Built-in number formats that are dates.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
EPOCH = datetime(1899, 12, 30)
SHEETS = "path string, sheet_no int, sheet string, row_no int, cells array<string>"


def column_of(reference: str) -> int:
    """A cell's column from its reference, from 0."""
    n = 0
    for ch in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def place_of(reference: str) -> tuple[int, int]:
    return int(re.search(r"\d+", reference).group()) - 1, column_of(reference)


class Workbook:
    """The sheets of an xlsx file as rows of German cell texts; merged cells have the text of their first one."""

    def __init__(self, content: bytes):
        self.files = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.files.namelist())
        self.shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in self.xml("xl/sharedStrings.xml").iter(f"{MAIN}si")]
        styles = self.xml("xl/styles.xml")
        own = {f.get("numFmtId"): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
        formats = [x.get("numFmtId", "0") for part in styles.iter(f"{MAIN}cellXfs") for x in part]
        self.dates = [int(f) in DATE_FORMATS or bool(re.search("[dmy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(f, "")).lower())) for f in formats]

    def xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.files.read(name)) if name in self.names else ElementTree.Element("none")

    def text(self, cell: ElementTree.Element) -> str:
        kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
        if value is None:
            return ""
        if kind == "s":
            return self.shared[int(value)]
        if kind == "b":
            return "ja" if value == "1" else "nein"
        if kind != "n":
            return value
        number, style = float(value), int(cell.get("s", "0"))
        if style < len(self.dates) and self.dates[style]:
            return (EPOCH + timedelta(days=number)).strftime("%d.%m.%Y")
        return str(int(number)) if number.is_integer() else str(number).replace(".", ",")

    def sheets(self) -> Iterator[tuple[str, list[list[str]]]]:
        targets = {r.get("Id"): r.get("Target", "") for r in self.xml("xl/_rels/workbook.xml.rels")}
        for sheet in self.xml("xl/workbook.xml").iter(f"{MAIN}sheet"):
            target = targets.get(sheet.get(f"{LINKS}id"), "")
            page = self.xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            rows: list[list[str]] = []
            for row in page.iter(f"{MAIN}row"):
                at = int(row.get("r", len(rows) + 1)) - 1
                rows += [[] for _ in range(at - len(rows))]
                cells: list[str] = []
                for cell in row.iter(f"{MAIN}c"):
                    column = column_of(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [""] * (column - len(cells))
                    cells.append(self.text(cell).strip())
                rows.append(cells)
            width = max(map(len, rows), default=0)
            rows = [r + [""] * (width - len(r)) for r in rows]
            for merged in page.iter(f"{MAIN}mergeCell"):
                (top, left), (bottom, right) = map(place_of, merged.get("ref").split(":"))
                for r in range(top, min(bottom + 1, len(rows))):
                    for c in range(left, min(right + 1, width)):
                        rows[r][c] = rows[top][left]
            yield sheet.get("name", ""), rows


def read_sheets(files: DataFrame) -> DataFrame:
    """``files`` (path, content) as rows of all sheets: path, sheet_no, sheet, row_no (from 0), cells.

    A file is one list and one task's work. A file that is no workbook gives no rows.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    sheets = list(Workbook(bytes(content)).sheets())
                except (zipfile.BadZipFile, ElementTree.ParseError):
                    continue
                for k, (name, rows) in enumerate(sheets):
                    yield pd.DataFrame({"path": path, "sheet_no": k, "sheet": name, "row_no": range(len(rows)), "cells": rows})

    return files.select("path", "content").mapInPandas(read, SHEETS)


def chosen_sheets(rows: DataFrame, sheet: str | None = None) -> DataFrame:
    """The rows of one sheet a file: the one named, else that with most rows that hold a unit, then most rows,
    then the first."""
    unit = F.exists("cells", lambda c: c.rlike("(?i)" + UNIT_LIKE))
    sizes = rows.groupBy("path", "sheet_no", "sheet").agg(F.count_if(unit).alias("units"), F.count("*").alias("n"))
    named = F.lit(False) if sheet is None else F.col("sheet") == sheet
    best = sizes.groupBy("path").agg(F.max_by("sheet_no", F.struct(named, "units", "n", -F.col("sheet_no"))).alias("sheet_no"))
    return rows.join(best, ["path", "sheet_no"])


def document_text(path: str, content: bytes) -> list[str]:
    """The pages of an office file by its suffix: a sheet is a page, any other document is one."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("xlsx", "xlsm"):
        pages = [f"[Blatt {name}]\n" + "\n".join("\t".join(r) for r in rows) for name, rows in Workbook(content).sheets()]
        return pages or [""]
    files = zipfile.ZipFile(io.BytesIO(content))
    if suffix == "docx":
        body = ElementTree.fromstring(files.read("word/document.xml")).find(f"{WORD}body")
        said = lambda x: "".join(t.text or "" if t.tag == f"{WORD}t" else "\t" if t.tag == f"{WORD}tab" else "" for t in x.iter())
        lines = [said(p) for p in body.findall(f"{WORD}p")]
        return ["\n".join([*lines, *("\t".join(said(c) for c in row.findall(f"{WORD}tc")) for row in body.iter(f"{WORD}tr"))])]
    body = ElementTree.fromstring(files.read("content.xml"))
    rows = ["\t".join("".join(c.itertext()) for c in row.iter(f"{OPEN_TABLE}table-cell")) for row in body.iter(f"{OPEN_TABLE}table-row")]
    inside = {p for row in body.iter(f"{OPEN_TABLE}table-row") for p in row.iter(f"{OPEN_TEXT}p")}
    return ["\n".join(["".join(p.itertext()) for p in body.iter() if p.tag in (f"{OPEN_TEXT}p", f"{OPEN_TEXT}h") and p not in inside] + rows)]


def read_documents(files: DataFrame) -> DataFrame:
    """``files`` (path, content) of the kinds docx, odt, ods, xlsx and xlsm as path, page (from 1), text; null for a broken file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out += [(path, k, text) for k, text in enumerate(document_text(path, bytes(content)), 1)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    out.append((path, 1, None))
            yield pd.DataFrame(out, columns=["path", "page", "text"])

    wanted = F.lower("path").rlike(r"\.(docx|odt|ods|xlsx|xlsm)$")
    return files.where(wanted).select("path", "content").mapInPandas(read, "path string, page int, text string")


TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def cell_name(row: int, column: int) -> str:
    letters = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row + 1}"


def workbook_bytes(sheets: list[tuple[str, list[list[str | None]]]]) -> bytes:
    """An xlsx file of text cells; equal input gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), HEAD + text)
        numbered = list(enumerate(sheets, 1))
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{TYPES}.worksheet+xml"/>' for k, _ in numbered)
        put("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{TYPES}.sheet.main+xml"/>{parts}</Types>')
        relations = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
        put("_rels/.rels", f'<Relationships {relations}><Relationship Id="r1" Type="{LINKS[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINKS[1:-1]}"><sheets>' + "".join(f'<sheet name={quoteattr(name[:31])} sheetId="{k}" r:id="r{k}"/>' for k, (name, _) in numbered) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", f"<Relationships {relations}>" + "".join(f'<Relationship Id="r{k}" Type="{LINKS[1:-1]}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k, _ in numbered) + "</Relationships>")
        for k, (_, rows) in numbered:
            cell = lambda r, c, v: f'<c r="{cell_name(r, c)}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
            put(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(rows: DataFrame) -> DataFrame:
    """``rows`` (path, sheet_no, sheet, row_no, cells) as one file a path: path, content.

    A file is one list for people, so its rows fit a task; the files are dealt over all tasks. Control characters,
    which XML can't hold, become spaces.
    """

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sheet_no", "row_no"], kind="stable")
        clean = lambda v: None if v is None else re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", v)
        sheets = [(part["sheet"].iloc[0], [[clean(v) for v in cells] for cells in part["cells"]]) for _, part in pdf.groupby("sheet_no", sort=True)]
        return pd.DataFrame([(pdf["path"].iloc[0], workbook_bytes(sheets))], columns=["path", "content"])

    return rows.groupBy("path").applyInPandas(write, "path string, content binary")
