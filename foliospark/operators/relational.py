"""Temporal joins, latest rows, deduplication, upserts, paging, islands and trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.periods import overlaps
from ..sources.shared import written


def active(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    """Rows that aren't marked as deleted."""
    return df.where(F.col(deleted).isNull())


def touching(left: DataFrame, right: DataFrame, keys: Sequence[str], spans: tuple[str, str, str, str]) -> DataFrame:
    """All pairs with equal keys whose intervals meet. The inequality comes after the equi-join."""
    a, b, c, d = (F.col(s) for s in spans)
    return left.join(right, list(keys)).where(overlaps(a, b, c, d))


def span_for_document(year: Column, start: Column, end: Column, day: Column) -> Column:
    """Billing year, else explicit period, else the document's day."""
    return F.when(year.isNotNull(), F.struct(F.make_date(year, F.lit(1), F.lit(1)).alias("from"), F.make_date(year, F.lit(12), F.lit(31)).alias("to"))).when(start.isNotNull() | end.isNotNull(), F.struct(start.alias("from"), end.alias("to"))).when(day.isNotNull(), F.struct(day.alias("from"), day.alias("to")))


def self_overlaps(df: DataFrame, keys: Sequence[str], id_column: str, start: str, end: str) -> DataFrame:
    """Pairs of rows of one key whose intervals meet, each once."""
    other = df.select(*keys, F.col(id_column).alias("other_id"), F.col(start).alias("other_from"), F.col(end).alias("other_to"))
    return df.join(other, list(keys)).where((F.col(id_column) < F.col("other_id")) & overlaps(F.col(start), F.col(end), F.col("other_from"), F.col("other_to")))


def either_key(left: DataFrame, right: DataFrame, first: Sequence[str], second: Sequence[str], id_columns: Sequence[str]) -> DataFrame:
    """A join on one key or another, as a union of two equi-joins without repeats."""
    pick = lambda keys: left.join(right.drop(*(c for c in left.columns if c in right.columns and c not in keys)), list(keys)).select(*id_columns)
    return pick(first).unionByName(pick(second)).distinct()


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """A12, A13, W: the first row of each key in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def duplicates(df: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """The first row of each key keeps, later ones name it. The rows meet their first id in a join,
    so a very frequent key isn't sorted in one task."""
    first = df.groupBy(*keys).agg(F.min(id_column).alias("first_id"))
    return df.join(first, list(keys)).withColumn("duplicate_of", F.when(F.col(id_column) != F.col("first_id"), F.col("first_id"))).drop("first_id")


def upsert(current: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """What an idempotent upsert does with each key."""
    a, b = current.select(key, F.col(value).alias("old"), F.lit(True).alias("has_old")), new.select(key, F.col(value).alias("new"), F.lit(True).alias("has_new"))
    return a.join(b, key, "full").withColumn("action", F.when(F.col("has_old").isNull(), "insert").when(F.col("has_new").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("new")), "touch").otherwise("change")).drop("has_old", "has_new")


def insert_absent(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key isn't known yet."""
    return new.join(current.select(key), key, "left_anti")


def fill_empty(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Only null or empty targets are filled from their sources."""
    return df.withColumns({t: F.coalesce(F.nullif(F.col(t), F.lit("")), F.col(s)) for t, s in pairs.items()})


def islands(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Runs of consecutive positions as first and last."""
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn("__g", F.col(position) - F.row_number().over(w)).groupBy(*keys, "__g").agg(F.min(position).alias("first"), F.max(position).alias("last")).drop("__g")


def until_next(df: DataFrame, keys: Sequence[str], position: str, last: Column) -> DataFrame:
    """Segments from a start to the place before the next start."""
    return df.withColumn("segment_end", F.coalesce(F.lead(position).over(Window.partitionBy(*keys).orderBy(position)) - 1, last))


def page_after(df: DataFrame, order: Sequence[str], after: Sequence | None, size: int) -> DataFrame:
    """The rows behind a cursor, one more than a page holds."""
    key = F.struct(*order)
    behind = df if after is None else df.where(key > F.struct(*(F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, after, strict=True))))
    return behind.orderBy(*order).limit(size + 1)


def cursor(*columns: Column) -> Column:
    """A page's cursor as URL-safe text."""
    return F.translate(F.base64(F.to_json(F.array(*(c.cast("string") for c in columns))).cast("binary")), "+/", "-_")


def with_marked_below(edges: DataFrame, marked: DataFrame, node: str, parent: str, rounds: int = 1_000) -> DataFrame:
    """The marked nodes and all nodes above one, as (node).

    ``edges`` holds each node with its parent. The marks climb one level a round, those that are new only, and each
    round is written, so lineage stays short; the number of rounds is the height of the tree above the marks.
    """
    up = edges.where(F.col(parent).isNotNull()).select(F.col(node).alias("__node"), F.col(parent).alias("__parent"))
    front = written(marked.select(F.col(node).alias("__node")).distinct(), "marks")
    parts = [front]
    for _ in range(rounds):
        known = reduce(DataFrame.unionByName, parts)
        front = written(up.join(front, "__node").select(F.col("__parent").alias("__node")).distinct().join(known, "__node", "left_anti"), "marks")
        if front.isEmpty():
            return known.select(F.col("__node").alias(node))
        parts.append(front)
    raise RuntimeError(f"the tree is higher than {rounds} levels, or has a cycle")


def top_of(edges: DataFrame, node: str, parent: str, rounds: int = 64) -> DataFrame:
    """Each node with the top node of its tree, as (node, top).

    Every node points to its parent, then to its parent's parent, and so on: twice as far each round, so a tree of
    height h takes log2(h) rounds. Each round is written. A top node is one without a parent.
    """
    now = written(edges.select(F.col(node).alias("__node"), F.coalesce(F.col(parent), F.col(node)).alias("__top")), "tops")
    for _ in range(rounds):
        further = now.select(F.col("__node").alias("__top"), F.col("__top").alias("__next")).distinct()  # a repeated node stays one parent
        new = written(now.join(further, "__top", "left").select("__node", F.coalesce("__next", "__top").alias("__top"), (F.col("__next") != F.col("__top")).alias("__moved")), "tops")
        now = new.drop("__moved")
        if new.where("__moved").isEmpty():
            return now.select(F.col("__node").alias(node), F.col("__top").alias("top"))
    raise RuntimeError(f"the tree is higher than 2**{rounds} levels, or has a cycle")


def sorted_digest(df: DataFrame, key: str, column: str) -> DataFrame:
    """Number of rows and the SHA-256 of each group's values, sorted as strings and joined by line breaks, as (key, rows, digest).

    The sort of a shuffle, which spills, brings a group's values to its task in order, and the digest takes them as a stream: no group is
    collected. Equal values count as often as they occur; rows with a null value or key are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, digest = None, 0, hashlib.sha256()
        done = lambda: pa.RecordBatch.from_pydict({"key": [group], "rows": [rows], "digest": [digest.hexdigest()]}, out)
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows and k == group:
                    digest.update(b"\n")
                elif rows:
                    yield done()
                    rows, digest = 0, hashlib.sha256()
                group, rows = k, rows + 1
                digest.update(value.encode())
        if rows:
            yield done()

    own = df.select(F.col(key).alias("key"), F.col(column).cast("string").alias("value")).where("key is not null and value is not null")
    form = StructType([StructField("key", own.schema["key"].dataType), StructField("rows", LongType()), StructField("digest", StringType())])
    out = to_arrow_schema(form)
    return own.repartition("key").sortWithinPartitions("key", "value").mapInArrow(run, form).withColumnRenamed("key", key)


def superseded(df: DataFrame, content: str, id_column: str) -> DataFrame:
    """One row for each earlier upload of a content: (content, id, current). The largest id is the current one.

    Contents with several ids only, so the join meets few keys; a content with very many rows is split by the adaptive join.
    """
    several = df.groupBy(content).agg(F.max(id_column).alias("current"), F.min(id_column).alias("__least")).where("current <> __least").drop("__least")
    return df.select(content, id_column).join(several, content).where(F.col(id_column) != F.col("current")).distinct()


def stratified(df: DataFrame, stratum: str, id_column: str, most: int, seed: int) -> DataFrame:
    """At most so many rows of each stratum, by a seeded hash."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")), 256), id_column)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def agreed_targets(df: DataFrame, combo: Sequence[str], target: str, id_column: str, least: int, negative: DataFrame | None = None) -> DataFrame:
    """Feature combinations with a single target, enough documents and no negative evidence."""
    found = df.groupBy(*combo).agg(F.min(target).alias("target"), F.count_distinct(target).alias("n_targets"), F.count_distinct(id_column).alias("n_documents")).where((F.col("n_targets") == 1) & (F.col("n_documents") >= least))
    return found if negative is None else found.join(negative.select(*combo).distinct(), list(combo), "left_anti")


def ranked_candidates(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """Rank, score and the next score of each candidate."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), tie)
    return df.withColumns({"rank": F.row_number().over(w), "next_score": F.lead(score).over(w)})
