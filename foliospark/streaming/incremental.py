"""Incremental reads, change application, debouncing, heartbeats and alerts as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_feed(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder; the query's checkpoint is the cursor, a bounded number each time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def since(df: DataFrame, time: str, key: str, mark: tuple | None, most: int) -> DataFrame:
    """Rows behind the high-water mark ``(time, key)`` of the last poll's last row, oldest first, at most so many.

    Rows of one time are ordered by their key, so a poll that ends among them leaves none out. Rows without a time are never read;
    of one time, a null key comes first and is behind no mark of that time.
    """
    at, own = F.col(time), F.col(key)
    new = df.where(at.isNotNull()) if mark is None else df.where((at > F.lit(mark[0]).cast(df.schema[time].dataType)) | ((at == F.lit(mark[0]).cast(df.schema[time].dataType)) & (own > F.lit(mark[1]))))
    return new.orderBy(at, own.asc_nulls_first()).limit(most)


def run_available(stream: DataFrame, path: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Drive a stream over what is there now and return its last state: one row for each of ``keys``.

    Each batch's changes are written below ``path`` under the batch's number, so a repeated batch replaces its own
    files; the newest change of a key counts. Nothing passes through the driver.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/{number}")

    schema = stream.select("*", F.lit(0).cast("long").alias("__batch")).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/rows/none")  # for a stream without rows
    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__last")).select(*keys, "__last.*")


def deduplicated(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, delay: str) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def debounced(stream: DataFrame, key: str, time: str, seconds: int = 60) -> DataFrame:
    """The first request arms a timer, others within the time are swallowed; one row when the time is over.

    Returns key, armed_at, swallowed. Event time drives the timer, so late data within the watermark counts.
    """

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        armed, swallowed = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            out.append((k[0], pd.Timestamp(armed, unit="s"), swallowed))
            state.remove()
        else:
            times = sorted(t.timestamp() for pdf in batches for t in pdf[time])
            for t in times:
                if armed is not None and t >= armed + seconds:
                    out.append((k[0], pd.Timestamp(armed, unit="s"), swallowed))
                    armed = None
                if armed is None:
                    armed, swallowed = t, 0
                else:
                    swallowed += 1
            state.update((armed, swallowed))
            state.setTimeoutTimestamp(max(int((armed + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "armed_at", "swallowed"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.withWatermark(time, "10 minutes").groupBy(key).applyInPandasWithState(work, f"{key} {kind}, armed_at timestamp, swallowed long", "armed double, swallowed long", "append", GroupStateTimeout.EventTimeTimeout)


def apply_changes(current: DataFrame, changes: DataFrame, key: str = "file_id", order: str = "seq") -> DataFrame:
    """The latest change of each key applied: removed, trashed, restored, moved, changed or new.

    ``current``: key, parent, digest, state; ``changes``: key, order, removed, trashed, parent, digest.
    """
    last = changes.groupBy(key).agg(F.max_by(F.struct("removed", "trashed", F.col("parent").alias("new_parent"), F.col("digest").alias("new_digest")), order).alias("c")).select(key, "c.*")
    j = current.join(last, key, "full")
    action = (
        F.when(F.col("removed").isNull(), "none").when(F.col("removed"), "removed").when(F.col("trashed"), "trashed").when(F.col("state").isNull(), "new")
        .when(F.col("state") == "trashed", "restored").when(~F.col("parent").eqNullSafe(F.col("new_parent")), "moved").when(~F.col("digest").eqNullSafe(F.col("new_digest")), "changed").otherwise("none")
    )
    return j.select(key, F.coalesce("new_parent", "parent").alias("parent"), F.coalesce("new_digest", "digest").alias("digest"), action.alias("action"), F.when(F.col("removed"), "removed").when(F.col("trashed"), "trashed").otherwise("linked").alias("state"))


def debounced_batch(df: DataFrame, key: str, time: str, seconds: int = 60) -> DataFrame:
    """R12 over a finished table: the requests that arm a timer, as (key, armed_us).

    A key's requests are walked in time order with the last armed time alone in hand: the rows are dealt by key, sorted
    within the partitions, and a key may go on from one batch of rows to the next, so no key is held as a whole.
    """
    kind = df.schema[key].dataType.simpleString()
    ordered = df.select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("__t")).where("__t is not null").repartition(key).sortWithinPartitions(key, "__t")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, armed, begun = None, 0, False
        for pdf in batches:
            keys, times = pdf[key].tolist(), pdf["__t"].tolist()
            out = []
            for k, t in zip(keys, times, strict=True):
                if not begun or k != last_key or t >= armed + seconds * 1_000_000:
                    last_key, armed, begun = k, t, True
                    out.append((k, t))
            yield pd.DataFrame(out, columns=[key, "armed_us"])

    return ordered.mapInPandas(walk, f"`{key}` {kind}, armed_us long")
