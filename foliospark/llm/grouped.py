"""Work on groups in tasks, and connected components of a graph that is kept in tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def map_groups(df: DataFrame, keys: list[str], work: Callable[[list[pa.Table]], pa.Table | None], schema: str, batch_rows: int = 20_000) -> DataFrame:
    """Shuffle and sort by ``keys`` and hand ``work`` lists of whole groups, many small ones at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def emit(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
            if out := work([table.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]):
                yield from out.to_batches()

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < batch_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cuts = bounds(table, keys, np)
            if len(cuts) > 2:  # the last group may go on in the next batch
                yield from emit(table, cuts[:-1])
                table = table.slice(cuts[-2])
            held, rows = table.to_batches(), table.num_rows
        if held and rows:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from emit(table, bounds(table, keys, np))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def bounds(table: pa.Table, keys: list[str], np) -> list[int]:
    import pyarrow.compute as pc

    change = np.zeros(table.num_rows, dtype=bool)
    for k in keys:
        column = table.column(k).combine_chunks()
        change[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return [0, *np.flatnonzero(change).tolist(), table.num_rows]


#: A key with more than one in ``HOT`` of all rows doesn't go through a shuffle; there can be at most ``HOT`` such keys.
HOT = 1_024


def join_by_key(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """``left`` inner-joined to ``right``, which has one row for each key and how many rows of ``left`` have it.

    The few keys that hold a large share of the rows are broadcast, so their rows stay where they are; all others
    are joined by a shuffle. ``left`` is read twice and must be a written table or a cheap scan, ``right`` as well.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HOT > total
    hot = right.where(heavy).drop(weight)
    near = left.join(F.broadcast(hot), key)
    return near.unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(~heavy).drop(weight), key))


def with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with ``m``, the least of a and its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select("a", F.least("a", "m").alias("m"), "degree")
    return join_by_key(edges, written(least, "least"), "a", "degree")


def fingerprint(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges; for different ones only with a probability of 2**-64."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``edges`` (a, b) as (node, root), the root being the least node of its component.

    Large-star and small-star steps alternate; each writes its edges into the shared folder, so lineage stays
    short and no edge reaches the driver. The many neighbours of a hub don't gather in one task. Nodes without
    an edge to another node don't appear.
    """
    downwards = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(edges.where("a <> b").select(*downwards).distinct(), "edges")
    seen = fingerprint(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = written(with_least(both).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        lower = with_least(large)
        small = lower.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        now = written(small.where("a <> b").select(*downwards).distinct(), "edges")
        before, seen = seen, fingerprint(now)
        if before == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
