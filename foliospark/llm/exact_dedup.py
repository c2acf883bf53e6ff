"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

1. A first pass takes the length and the hash of the first characters of each text. Only these keys are shuffled:
   lengths that occur once go first, then prefixes that occur once among equal lengths.
2. The (length, prefix) keys that are left become a bitmap of fixed size, which every later scan asks before it
   reads a text to its end. A bit that two keys share lets too much through, never too little.
3. Only those texts get a full hash, and equal full hashes form the groups.

Texts never travel to find groups; ``keep_one`` shuffles those that passed the bitmap once, by hash and id, so
the copies of one frequent text spread over all tasks. ``digest`` shuffles only the hashes of those that passed,
and those of very common texts not at all. Everything is DataFrame functions.

Defined cases: a null text counts as empty, so null and empty rows form one group; of equal texts the row
with the largest id stays (a null id is smaller than any other); of wholly repeated rows (same id and
text) exactly one stays; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import asked_of, bitmap_of, whole_text, with_own_names, written
from .grouped import join_by_key

PREFIX_CHARS = 64
#: Parts of a frequent length.
SALTS = 32


def full_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def cheap_keys(text: Column) -> dict[str, Column]:
    """Length in bytes and hash of the first characters."""
    return {"__bytes": F.octet_length(text), "__prefix": F.xxhash64(F.substring(text, 1, PREFIX_CHARS))}


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` occurs more than once.

    The keys meet the rows in ``SALTS`` parts, so the rows of one frequent key don't gather in one task.
    """
    more = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("__prefix", F.rand(7)), F.lit(SALTS)).cast("int"))
    return salted.join(more, [key, "salt"], "left_semi").drop("salt")


def refined(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The bitmap of the (length, prefix) keys that two or more rows share: (__map, __bits)."""
    keys = written(docs.select(*(c.alias(n) for n, c in cheap_keys(whole_text(text_column)).items())), "exact-keys")
    shared = repeated(keys, "__bytes").groupBy("__bytes", "__prefix").agg(F.count("*").alias("n")).where("n > 1")
    return written(bitmap_of(shared, "__bytes", "__prefix"), "exact-bitmap")


def marked(docs: DataFrame, bitmap: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with ``__text``, and ``__again``: whether a text may have a copy. No shuffle."""
    rows = docs.withColumns({"__text": whole_text(text_column)}).withColumns(cheap_keys(F.col("__text")))
    return asked_of(rows, bitmap, "__again", "__bytes", "__prefix").drop("__bytes", "__prefix")


def full_groups(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each full hash among the texts that may have a copy: text_sha256, keep_id, group_size."""
    hashed = found.where("__again").select(F.col(id_column).alias("id"), full_hash(F.col("__text")).alias("text_sha256"))
    return hashed.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each group of two or more equal texts: text_sha256, keep_id, group_size."""
    return full_groups(marked(docs, refined(docs, text_column), text_column), id_column).where("group_size > 1")


def digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of single texts too)."""
    found = marked(docs.select(id_column, text_column), refined(docs, text_column), text_column)
    keys = found.select(F.col(id_column).alias("doc_id"), full_hash(F.col("__text")).alias("text_sha256"), "__again")
    hashed = written(keys.where("__again").select("doc_id", "text_sha256"), "exact-hashes")
    sizes = hashed.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.count("*").alias("n"))
    grouped = join_by_key(hashed, written(sizes, "exact-groups"), "text_sha256", "n")
    alone = keys.where(~F.col("__again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    rows = written(alone.unionByName(grouped.select("doc_id", "keep_id", "group_size", "text_sha256")), "exact-rows")
    chosen = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Only the rows that carry the kept id can tie, so the window sees no large group of different rows.
    again = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("keep_id"))
    ones = rows.where(chosen).withColumn("kept", again == 1)
    rest = rows.where(~chosen).withColumn("kept", F.lit(False))
    return ones.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return with_own_names(docs, kept_rows, id_column=id_column, text_column=text_column)


def kept_rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    found = marked(docs, refined(docs, text_column), text_column)
    kept = written(full_groups(found, id_column), "exact-groups").select(F.col("text_sha256").alias("__kept_sha"), F.col("keep_id").alias("__keep"))
    own = found.where("__again").withColumn("__sha", full_hash(F.col("__text")))
    left = own.join(kept.hint("merge"), (F.col("__sha") == F.col("__kept_sha")) & F.col(id_column).eqNullSafe(F.col("__keep")), "left_semi")
    # What is left of a group is the kept row and wholly repeated rows, so no window partition is large.
    first = left.withColumn("__n", F.row_number().over(Window.partitionBy("__sha").orderBy(F.col(id_column)))).where("__n = 1")
    return found.where(~F.col("__again")).select(*docs.columns).unionByName(first.select(*docs.columns))
