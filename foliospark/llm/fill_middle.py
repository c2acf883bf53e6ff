"""Fill-in-middle transformation by a streaming matcher that runs twice over a text and keeps none of its units.

A unit is what one pattern matches, left to right; by default a code point. The first pass counts the units. Two hashes of the
document's id, modulo the count plus one, give the ranks at which the text is cut. The second pass moves a lazy iterator of
matches to the smaller rank and on to the larger one, so memory holds one match at a time, however long the text is.

Forms: ``psm`` is prefix, suffix, middle, each behind its sentinel; ``spm`` is suffix, prefix, middle; ``plain`` is the text itself.
A text that is empty or holds a sentinel, and a share of all others, stay plain, so a transformed text holds each sentinel once and
``restored`` rebuilds the original exactly with built-in functions.

Defined cases: a null text is empty; a null id counts as an empty string; what lies behind the last unit belongs to the suffix; equal
ids with equal texts are cut alike; an empty table gives an empty result. Other columns are kept, but an input column with the name
of a new one gives way to it.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINT = r"(?s:.)"
SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of texts that are transformed, and of these the percent in suffix-prefix-middle order.
TRANSFORMED, SUFFIX_FIRST = 90, 20
NEW = ("fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text")
SCHEMA = "units long, prefix_chars long, middle_chars long, text string"


def unit_count(pattern: re.Pattern, text: str) -> int:
    """How many units ``text`` has; the matches are dropped as they come."""
    n = count()
    deque(zip(pattern.finditer(text), n), maxlen=0)  # noqa: B905
    return next(n)


def cut_ends(pattern: re.Pattern, text: str, first: int, last: int) -> tuple[int, int]:
    """Where the ``first`` and the ``last`` unit of ``text`` end (0 for none); ``first <= last``, both at most its units."""
    matches: Iterator[re.Match] = pattern.finditer(text)
    a = next(islice(matches, first - 1, None)).end() if first else 0
    return a, next(islice(matches, last - first - 1, None)).end() if last > first else a


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must stay recognisable wherever they stand: none may hold another or begin as one ends."""
    if len(sentinels) != 3 or not all(sentinels):
        raise ValueError("three sentinels that aren't empty are needed")
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if i != j and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")


def ranks(id_column: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: str = CODE_POINT, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with ``fim_units``, ``fim_form``, ``fim_prefix_chars``, ``fim_middle_chars`` and ``fim_text``; one pass, no shuffle."""
    check_sentinels(sentinels)
    p, s, m = sentinels

    @F.arrow_udf(SCHEMA)
    def cut(texts: pa.Array, forms: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        pattern = re.compile(unit)
        out: list[list] = [[], [], [], []]
        for held, form, x, y in zip(texts, forms.to_pylist(), h1.to_pylist(), h2.to_pylist(), strict=True):
            text = held.as_py()  # one text at a time
            n = unit_count(pattern, text)
            row = (n, None, None, text)
            if form != "plain":
                first, last = sorted((x % (n + 1), y % (n + 1)))
                a, b = cut_ends(pattern, text, first, last)
                done = (p, text[:a], s, text[b:], m, text[a:b]) if form == "psm" else (s, text[b:], p, text[:a], m, text[a:b])
                row = (n, a, b - a, "".join(done))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["units", "prefix_chars", "middle_chars", "text"])

    own = [f"c{k}" for k in range(len(docs.columns))]  # an input column may have any name
    text = F.coalesce(F.col(own[docs.columns.index(text_column)]), F.lit(""))
    h1, h2, h3, h4 = ranks(F.col(own[docs.columns.index(id_column)]), seed)
    stays = (text == "") | F.contains(text, F.lit(p)) | F.contains(text, F.lit(s)) | F.contains(text, F.lit(m)) | (h3 % 100 >= transformed)
    form = F.when(stays, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    made = docs.toDF(*own).select("*", form.alias("form"), text.alias("text"), h1.alias("h1"), h2.alias("h2")).select(*own, "form", cut("text", "form", "h1", "h2").alias("cut"))
    kept = [F.col(x).alias(c) for x, c in zip(own, docs.columns, strict=True) if c not in NEW]
    return made.select(*kept, F.col("cut.units").alias("fim_units"), F.col("form").alias("fim_form"), F.col("cut.prefix_chars").alias("fim_prefix_chars"), F.col("cut.middle_chars").alias("fim_middle_chars"), F.col("cut.text").alias("fim_text"))


def restored(form: Column, text: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The original text from a form and its output, by built-in functions."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(text, F.lit(len(first) + 1), F.length(text))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substring(rest, F.length(two) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(text)
