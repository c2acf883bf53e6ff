"""Source divergence audit: how far the words of each source lie from those of the other sources of its language.

Terms are runs of ASCII letters and of characters beyond ASCII, with only A-Z lower-cased. Each language keeps the terms that at
least ``MIN_DOCS`` of its documents hold. Every (lang, source) group, and each language, gives every kept term a smoothed share in
billionths, ``p = 1 + floor(10**9 * (count + 1) / (total + kept terms))``. The distance of two shares is
``floor((p - q) * (p - q) / q)``. All arithmetic is in whole numbers.

- ``pairs``: for each group and each other source of its language, the sum of the distances over all kept terms. Most counts are zero,
  so all terms are first taken at both groups' baseline shares, those of a term that never occurs. The terms that do occur
  correct this: those of one group by a histogram of its counts, those of both by a join on the term.
- ``terms``: for each group the 200 terms that are most above their language's share. No group is sorted: distributed histograms
  over the bits of the values, from the highest on, find the value of each group's 200th term; among equal values,
  histograms over the bytes of the terms go on. Only rows that stay are ranked.

Texts are counted in tasks, which send one row for each term, source and some hundred thousand counted terms, so a frequent word
or a large source crosses the shuffle as a few rows. Tables of one row for each group are broadcast up to ``BROADCAST_ROWS``
rows; larger ones are joined by a shuffle that deals each group's rows over ``SALT`` parts.

Defined cases: null text, lang and source are empty strings; a group without terms is there, and all its counts are zero; a language
without kept terms has pairs of value 0 and no term rows; repeated rows count as often as they occur; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text, written

TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Documents of its language that a term needs, and ranks that each group's terms get.
MIN_DOCS, TOP = 3, 200
#: Shares are in parts of this.
SCALE = 10**9
#: Counted terms that a task holds before it sends them on; bytes of a text that are cut into terms at once.
HELD, PART = 300_000, 4 << 20
ROWS = 50_000
#: Rows of a table of groups that is broadcast, and parts over which a group is dealt beyond that.
BROADCAST_ROWS, SALT = 20_000, 64
#: Bits of a value that one histogram tells apart, and of the largest distance: (10**9)**2 is less than 2**60.
DIGIT, BITS = 15, 60
GROUP = ("lang", "source")


def term_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a part at a time."""
    raw, start = raw.lower(), 0  # bytes.lower() changes A-Z only
    gap = re.compile(rb"[^a-z\x80-\xff]")
    while len(raw) - start > PART and (found := gap.search(raw, start + PART)):
        yield TERM.findall(raw, start, found.start())
        start = found.start()
    yield TERM.findall(raw, start)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) with several rows a term; a null term stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = [None, *n]
                for k in range(0, len(terms), ROWS):
                    some = terms[k : k + ROWS]
                    columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for terms in term_lists(raw.as_py()):
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
                size += len(n) - before + 1
                if size > HELD:
                    yield from sent()
                    held, size = {}, 0
        yield from sent()

    plain = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), whole_text().cast("binary").alias("text"))
    return plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column, kept: Column) -> Column:
    """The smoothed share in billionths; null if there is nothing to share. Long division by thousands, so nothing overflows."""
    whole = F.nullif(total + kept, F.lit(0))
    left, out = n + 1, F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1_000
        out, left = out * 1_000 + div(left, whole), left % whole
    return out + 1


def distance(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


def beside(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to a written table that has few rows for each key of ``on``, whatever the key's share of ``rows``."""
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), on, how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALT)))
    dealt = small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return salted.join(dealt, [*on, "salt"], how).drop("salt")


def shares(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Two written tables: the groups (lang, source, kept, base), and the kept terms that occur (lang, source, term, p, q).

    ``kept`` counts the language's kept terms, ``base`` is the group's share of a term that it doesn't have, ``p`` the group's share of
    a term, ``q`` the language's.
    """
    of_term = Window.partitionBy("lang", "term")
    added = counted(docs).repartition("lang", "term").groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    known = added.withColumn("lang_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term)).withColumn("first", F.min("source").over(of_term) == F.col("source"))
    counts = written(known.where(F.col("term").isNull() | (F.col("lang_docs") >= min_docs)).select(*GROUP, "term", "n", "lang_n", (F.col("first") & F.col("term").isNotNull()).cast("long").alias("first")), "term-counts")
    totals = counts.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    of_lang = Window.partitionBy("lang")  # one row for each source of the language
    groups = written(totals.select(*GROUP, "total", F.sum("total").over(of_lang).alias("lang_total"), F.sum("firsts").over(of_lang).alias("kept")), "term-groups")
    base = share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))
    rated = beside(counts.where("term is not null").select(*GROUP, "term", "n", "lang_n"), groups, list(GROUP))
    rated = written(rated.select(*GROUP, "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"), base.alias("base")), "term-shares")
    return groups.select(*GROUP, "kept", base.alias("base")), rated


def pairs(groups: DataFrame, rated: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each group and each other source ``item`` of its language."""
    others = written(groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"), "kept"), "term-others")
    a, b = F.col("base"), F.col("item_base")
    whole = beside(groups.drop("kept"), others, ["lang"]).where("source <> item")
    parts = [whole.select(*GROUP, "item", F.coalesce(F.col("kept") * distance(a, b), F.lit(0)).alias("value"))]
    # Terms that the source has, at the other's baseline, in place of both baselines; in both directions.
    p, terms = F.col("p"), F.col("terms")
    single = beside(rated.groupBy(*GROUP, "p", "base").agg(F.count("*").alias("terms")), others, ["lang"]).where("source <> item")
    single = single.groupBy(*GROUP, "item").agg(F.sum(terms * (distance(p, b) - distance(a, b))).alias("there"), F.sum(terms * (distance(b, p) - distance(b, a))).alias("back"))
    # Terms that both have: what either alone has corrected is taken back.
    left = rated.select("lang", "term", "source", "p", "base")
    right = rated.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("o"), F.col("base").alias("item_base"))
    o = F.col("o")
    both = lambda p, o, a, b: distance(p, o) - distance(p, b) - distance(a, o) + distance(a, b)
    double = left.join(right, ["lang", "term"]).where("source < item").groupBy(*GROUP, "item").agg(F.sum(both(p, o, a, b)).alias("there"), F.sum(both(o, p, b, a)).alias("back"))
    for both_ways in (single, double):
        parts.append(both_ways.select(*GROUP, "item", F.col("there").alias("value")))
        parts.append(both_ways.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))


def reached(histogram: DataFrame, group: list[str], digit: Column) -> DataFrame:
    """Of each group's bins (group, digit, left, ties) in the order of ``digit``, the one that holds the ``left``-th row.

    ``left`` becomes the place within the bin. A group with fewer rows has none.
    """
    run = Window.partitionBy(*group).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("upto") - F.col("ties")
    return histogram.withColumn("upto", F.sum("ties").over(run)).where((F.col("upto") >= F.col("left")) & (before < F.col("left"))).withColumn("left", F.col("left") - before).drop("upto")


def top_of_groups(rows: DataFrame, group: list[str], k: int, digit_bits: int = DIGIT, bits: int = BITS) -> DataFrame:
    """Of a written table of ``group`` columns, ``item`` (string) and ``value`` (long, 0 to 2**bits - 1), each group's first ``k`` rows by
    value descending and item ascending in UTF-8 bytes, with ``rank`` from 1. Rows with one item and value twice have no defined order.
    """
    state, value = None, F.col("value")
    for shift in range(bits - digit_bits, -1, -digit_bits):
        digit = F.shiftright(value, shift).bitwiseAND((1 << digit_bits) - 1)
        if state is None:
            bins = rows.select(*group, F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("left"), digit.alias("digit"))
        else:
            bins = beside(rows.select(*group, "value"), state, group).where(F.shiftright(value, shift + digit_bits) == F.col("prefix")).select(*group, "prefix", "left", digit.alias("digit"))
        bins = bins.groupBy(*group, "prefix", "left", "digit").agg(F.count("*").alias("ties"))
        found = reached(bins, group, F.col("digit").desc())
        state = written(found.select(*group, (F.shiftleft("prefix", digit_bits) + F.col("digit")).alias("prefix"), "left", "ties"), "radix-values")
        state = state.select(*group, "prefix", "left", "ties") if shift == 0 else state.select(*group, "prefix", "left")
    # The k-th value of each group is known. Where more rows share it than fit, their bytes decide.
    raw = F.col("item").cast("binary")
    bounds = state.where("ties = left").select(*group, "prefix", F.lit(None).cast("binary").alias("bound"))
    open_, at, width = state.where("ties > left").select(*group, "prefix", F.lit(b"").alias("bound"), "left"), 1, 2
    while not open_.isEmpty():
        same = beside(rows, open_, group).where((value == F.col("prefix")) & (F.substring(raw, 1, at - 1) == F.col("bound")))
        bins = same.select(*group, "prefix", "bound", "left", F.substring(raw, at, width).alias("digit")).groupBy(*group, "prefix", "bound", "left", "digit").agg(F.count("*").alias("ties"))
        step = reached(bins, group, F.col("digit")).select(*group, "prefix", F.concat("bound", "digit").alias("bound"), "left", ((F.col("ties") > F.col("left")) & (F.octet_length("digit") == width)).alias("goes_on"))
        step = written(step, "radix-bytes")
        bounds = bounds.unionByName(step.where("not goes_on").select(*group, "prefix", "bound"))
        open_, at, width = step.where("goes_on").drop("goes_on"), at + width, 2 * width
    limits = written(bounds, "radix-bounds")
    prefix, bound = F.col("prefix"), F.col("bound")
    first = F.substring(raw, F.lit(1), F.octet_length(bound))
    kept = beside(rows, limits, group, "left").where(prefix.isNull() | (value > prefix) | ((value == prefix) & (bound.isNull() | (first <= bound))))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("value").desc(), F.col("item")))
    return kept.select(*group, "item", "value", rank.alias("rank")).where(F.col("rank") <= k)


def terms(rated: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): each group's terms that lie farthest above their language's share."""
    over = written(rated.where("p > q").select(*GROUP, F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value")), "term-distances")
    return top_of_groups(over, list(GROUP), top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Both parts: lang, source, part, item, value, rank."""
    groups, rated = shares(docs, min_docs)
    of_pairs = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item"))
    ranked = pairs(groups, rated).select(*GROUP, F.lit("pair").alias("part"), "item", "value", F.row_number().over(of_pairs).alias("rank"))
    return ranked.unionByName(terms(rated, top).select(*GROUP, F.lit("term").alias("part"), "item", "value", "rank"))
