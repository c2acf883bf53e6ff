"""Kinds of files by name and content, and text from HTML pages, messages and plain files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds by suffix and by leading bytes.
SUFFIXES = {"pdf": ["pdf"], "image": ["jpg", "jpeg", "png", "tif", "tiff", "gif", "bmp", "webp"], "office": ["docx", "xlsx", "odt", "ods", "csv", "txt"], "email": ["eml", "msg"], "html": ["html", "htm"], "office_legacy": ["doc", "xls", "ppt", "rtf"]}
MAGIC = [("FFD8FF", "jpeg"), ("89504E470D0A1A0A", "png"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("474946383761", "gif"), ("474946383961", "gif"), ("D0CF11E0A1B11AE1", "ole"), ("504B0304", "zip"), ("7B5C727466", "rtf")]
TEMPORARY = ("", "tmp", "herunterladen", "indir", "hed", "part", "crdownload")
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "article", "section"}
SKIPPED = {"script", "style", "head"}
#: Headers of messages that a task remembers.
REMEMBERED_HEADERS = 4096


def kind_by_name(name: Column, mime: Column) -> Column:
    """Kind of a file by suffix, then by media type."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = F.when(mime == "application/vnd.google-apps.document", "google_doc")
    for kind, suffixes in SUFFIXES.items():
        out = out.when(suffix.isin(suffixes), kind)
    return out.when(F.lower(mime).startswith("image/"), "image").when(F.lower(mime) == "application/pdf", "pdf").when(F.lower(mime) == "text/html", "html").when(F.lower(mime) == "message/rfc822", "email").otherwise("unsupported")


def kind_by_content(content: Column) -> Column:
    """Kind by the first bytes; %PDF may follow within 1,024 bytes."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    out = F.when(F.instr(F.substring(text, 1, 1024), "%PDF") > 0, "pdf")
    for sign, kind in MAGIC:
        out = out.when(head.startswith(sign), kind)
    out = out.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    out = out.when(head.startswith("424D") & (F.substring(head, 13, 8) == "00000000") & (F.length(content) > 26), "bmp")
    from ..functions.text import looks_like_html

    return out.when(looks_like_html(text), "html").when(looks_like_email(text), "email")


def looks_like_email(text: Column) -> Column:
    """The first line is a known header and two header lines stand together."""
    return text.rlike(r"^(?i)(from|to|subject|date|received|return-path|message-id|mime-version|delivered-to|x-[a-z-]+):[^\n]*\r?\n([ \t][^\n]*\r?\n)*[A-Za-z][A-Za-z0-9-]*:")


def kind_checked(name: Column, mime: Column, content: Column) -> Column:
    """Content decides only where the name says nothing or is temporary."""
    by_name = kind_by_name(name, mime)
    odd = (by_name == "unsupported") | F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*TEMPORARY)
    return F.struct(F.when(odd, F.coalesce(kind_by_content(content), F.lit("unsupported"))).otherwise(by_name).alias("kind"), odd.alias("content_checked"))


def html_text(html: str) -> str:
    """Tags to text; blocks to lines, cells to tabs; nested hidden parts are counted."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.out: list[str] = []
            self.hidden = 0

        def handle_starttag(self, tag, attrs):
            if tag in SKIPPED:
                self.hidden += 1
            elif tag in BLOCKS:
                self.out.append("\n")
            elif tag in ("td", "th"):
                self.out.append("\t")

        def handle_endtag(self, tag):
            if tag in SKIPPED:
                self.hidden = max(0, self.hidden - 1)
            elif tag in BLOCKS:
                self.out.append("\n")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    reader = Reader()
    reader.feed(html)
    reader.close()
    lines = [re.sub(r"[ \xa0\r\f\v]+", " ", line).strip() for line in "".join(reader.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_to_text(column: Column, most: int = 100_000, marker: str = "\n[truncated]") -> Column:
    """Text of a page, cut at ``most`` characters with a mark."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = (None if h is None else html_text(h) for h in batch.to_pylist())
            yield pa.array([t if t is None or len(t) <= most else t[:most] + marker for t in texts], pa.string())

    return run(column)


def header_block(text: Column) -> Column:
    """Header fields from the first lines of a message's text page."""
    head = F.array_join(F.slice(F.split(F.regexp_replace(text, r"\n\s*\n[\s\S]*$", ""), "\n"), 1, 8), "\n")
    get = lambda name: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{name}:(.*)$", 1)), F.lit(""))
    sender = get("Von")
    return F.struct(get("Betreff").alias("subject"), F.nullif(F.trim(F.regexp_extract(sender, r"^([^<]*)<", 1)), F.lit("")).alias("from_name"), F.lower(F.nullif(F.regexp_extract(sender, r"([^\s<>]+@[^\s<>]+)", 1), F.lit(""))).alias("from_address"), get("An").alias("to"), get("Datum").alias("date"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """The message files of a folder, as ``parse_messages`` reads them."""
    return parse_messages(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.eml").load(path))


def parse_messages(files: DataFrame) -> DataFrame:
    """``files`` (path, content) as headers, one text page and attachment names."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from email import policy
        from email.parser import BytesParser
        from email.utils import parseaddr, parsedate_to_datetime

        # A message parses a header anew each time that it is asked for, which takes most of the time; many messages share some.
        shown = lru_cache(maxsize=REMEMBERED_HEADERS)(lambda name, raw: str(policy.default.header_fetch_parse(name, raw)))

        def header(m, name: str) -> str:
            return next((shown(k, raw) for k, raw in m.raw_items() if k.lower() == name), "")

        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                m = BytesParser(policy=policy.default).parsebytes(bytes(content))
                body = m.get_body(("plain", "html"))
                text = "" if body is None else body.get_content()
                if body is not None and body.get_content_type() == "text/html":
                    text = html_text(text)
                sender, to, sent, subject = (header(m, h) for h in ("from", "to", "date", "subject"))
                who, address = parseaddr(sender)
                try:
                    date = parsedate_to_datetime(sent).isoformat() if sent else None
                except ValueError:
                    date = None
                files = [a.get_filename() or "" for a in m.iter_attachments()]
                page = "\n".join([f"Von: {sender}", f"An: {to}", f"Datum: {sent}", f"Betreff: {subject}", "", text.strip(), *([f"Anhänge: {', '.join(files)}"] if files else [])])
                out.append((name, subject, who or None, address.lower() or None, to or None, date, page, files))
            yield pd.DataFrame(out, columns=["path", "subject", "from_name", "from_address", "to", "date", "text", "attachments"])

    return files.select("path", "content").mapInPandas(read, "path string, subject string, from_name string, from_address string, to string, date string, text string, attachments array<string>")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Plain and delimited text files as pages; form feeds part pages, delimiters become tabs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,csv}").load(path)
    text = F.coalesce(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")), F.decode("content", "ISO-8859-1"))
    table = F.when(F.lower("path").endswith(".csv"), F.regexp_replace(text, "[;,]", "\t")).otherwise(text)
    return files.select("path", F.posexplode(F.split(table, "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)


def not_ignored(files: DataFrame, name: str, ignored: list[str]) -> DataFrame:
    """Rows whose ``name`` matches none of the patterns with * and ?, in any case."""
    for glob in ignored:
        shape = "^" + re.escape(glob.lower()).replace(r"\*", ".*").replace(r"\?", ".") + "$"
        files = files.where(~F.lower(name).rlike(shape))
    return files


def list_files(spark: SparkSession, path: str, ignored: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Files of a folder tree, without ignored names; too many are an error, not a cut."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    files = not_ignored(files.withColumn("__name", F.regexp_extract("path", r"([^/]+)$", 1)), "__name", ignored or []).drop("__name")
    if most is not None and files.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files under {path}")
    return files.where(F.col("length") > 0)


def digital_page(chars: Column, ratio: Column, cover: Column, least: int = 30, alnum: float = 0.5, most: float = 0.9) -> Column:
    """Whether a page's text layer can be used, and why."""
    return F.when(chars < least, "too_few_chars").when(ratio < alnum, "garbage_text_layer").when(cover > most, "full_page_image").otherwise("text_layer")
