"""Workbooks and text documents, made by hand."""

from __future__ import annotations

import io
import zipfile

from foliospark.sources import workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(**files: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def book(sheet: str, shared: str = "", styles: str = "") -> bytes:
    links = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return packed(
        xl__workbook_dot_xml=f'<workbook {MAIN} {links}><sheets><sheet name="Liste" sheetId="1" r:id="a"/></sheets></workbook>',
        xl___rels__workbook_dot_xml_dot_rels='<Relationships><Relationship Id="a" Target="worksheets/one.xml"/></Relationships>'.replace("_rels", "_rels"),
        xl__worksheets__one_dot_xml=f"<worksheet {MAIN}>{sheet}</worksheet>",
        xl__sharedStrings_dot_xml=f"<sst {MAIN}>{shared}</sst>",
        xl__styles_dot_xml=f"<styleSheet {MAIN}>{styles}</styleSheet>",
    )


def rows_of(spark, content: bytes, path: str = "a.xlsx"):
    files = spark.createDataFrame([(path, bytearray(content))], "path string, content binary")
    return [r["cells"] for r in workbooks.read_sheets(files).orderBy("sheet_no", "row_no").collect()]


def test_cells_of_all_kinds(spark):
    sheet = """<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>1234.5</v></c></row>
      <row r="3"><c r="A3" s="1"><v>45292</v></c><c r="B3" t="b"><v>1</v></c><c r="C3"><v>7</v></c><c r="D3" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row></sheetData>"""
    content = book(sheet, "<si><r><t>Na</t></r><r><t>me</t></r></si>", '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>')
    assert rows_of(spark, content) == [["Name", "", "1234,5", ""], ["", "", "", ""], ["01.01.2024", "ja", "7", "ab"]]


def test_merged_cells(spark):
    sheet = '<sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>x</t></is></c><c r="B1"/></row><row r="2"><c r="A2"/><c r="B2"/></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells>'
    assert rows_of(spark, book(sheet)) == [["x", "x"], ["x", "x"]]


def test_broken_and_empty_files(spark):
    assert rows_of(spark, b"no zip") == [] and rows_of(spark, b"") == []
    files = spark.createDataFrame([("a.docx", bytearray(b"no zip")), ("b.bin", bytearray(b""))], "path string, content binary")
    assert [tuple(r) for r in workbooks.read_documents(files).collect()] == [("a.docx", 1, None)]


def test_round_trip(spark):
    rows = [("f.xlsx", 0, "A & B", 0, ["<x>", None, "\x01y"]), ("f.xlsx", 1, "C", 0, ["WE 1", "z", ""]), ("f.xlsx", 1, "C", 1, ["  q ", "", None])]
    files = workbooks.workbooks(spark.createDataFrame(rows, workbooks.SHEETS))
    got = workbooks.read_sheets(files)
    assert sorted((r["sheet"], r["row_no"], r["cells"]) for r in got.collect()) == [("A & B", 0, ["<x>", "", "y"]), ("C", 0, ["WE 1", "z", ""]), ("C", 1, ["q", "", ""])]
    assert {r["sheet"] for r in workbooks.chosen_sheets(got).collect()} == {"C"}
    assert {r["sheet"] for r in workbooks.chosen_sheets(got, "A & B").collect()} == {"A & B"}
    assert workbooks.workbook_bytes([("a", [["b"]])]) == workbooks.workbook_bytes([("a", [["b"]])])


def test_documents(spark):
    word = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = packed(word__document_dot_xml=f"<w:document {word}><w:body><w:p><w:r><w:t>Hallo</w:t></w:r><w:r><w:t> Welt</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>")
    text, tab = 'xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"', 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
    odt = packed(content_dot_xml=f"<x {text} {tab}><text:h>Kopf</text:h><text:p>Zeile <b>eins</b></text:p><table:table-row><table:table-cell><text:p>c</text:p></table:table-cell><table:table-cell><text:p>d</text:p></table:table-cell></table:table-row></x>")
    files = spark.createDataFrame([("a.docx", bytearray(docx)), ("b.ODT", bytearray(odt))], "path string, content binary")
    got = {r["path"]: r["text"] for r in workbooks.read_documents(files).collect()}
    assert got == {"a.docx": "Hallo Welt\na\t", "b.ODT": "Kopf\nZeile eins\nc\td"}
