"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if spark.sparkContext.master.startswith("local["):  # one machine: its own folder is shared
        return os.path.join(tempfile.gettempdir(), "checkpoints")
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now instead of at the next collection of the driver's memory.

    The scheduler keeps hold of its last job, so an empty one takes its place first.
    """
    gc.collect()
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()


def whole_text(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def with_own_names(docs: DataFrame, run: Callable[..., DataFrame], **columns: str) -> DataFrame:
    """``run`` on ``docs`` under neutral column names, for operators that return a part of the rows.

    ``columns`` are the columns that ``run`` needs, which get their new names; so a column of the input may have any
    name, even one that the operator uses itself.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    return run(docs.toDF(*names), **{k: names[docs.columns.index(v)] for k, v in columns.items()}).select(*names).toDF(*docs.columns)


def adding(docs: DataFrame, run: Callable[..., DataFrame], added: list[str], **columns: str) -> DataFrame:
    """``run`` on ``docs`` under neutral column names, with the columns of ``docs`` and those that it adds: ``added``.

    ``columns`` are as in ``with_own_names``; an input column of a new one's name gives way to it.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    out = run(docs.toDF(*names), **{k: names[docs.columns.index(v)] for k, v in columns.items()})
    kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in added]
    return out.select(*kept, *added)


def replacing(docs: DataFrame, *added: str) -> list[str]:
    """The columns of ``docs`` that stay beside new ones: an input column of a new one's name gives way to it."""
    return [c for c in docs.columns if c not in added]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls into fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, seed: int) -> list:
    """At most ``per_class`` labelled rows of each class, as ``(doc_id, text, label)`` rows on the driver.

    The choice is by a hash of the id, so it doesn't depend on partitioning. ``per_class`` is the
    documented bound that makes this sample safe to collect, whatever ids are repeated.
    """
    known = labels.where(keep & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"), F.col("y")]
    ids = known.where("y = 0").orderBy(*order).limit(per_class).unionByName(known.where("y = 1").orderBy(*order).limit(per_class))
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(ids.distinct()), "doc_id")
    # A repeated id counts once for each label, with its least text, so the bound holds for rows too.
    once = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return sorted((r.doc_id, r.text, r.y) for r in once.collect())


#: Bits of one row of a bitmap, as ``bitmap_construct_agg`` makes them, and rows: 256 of 4 KB, so 1 MB is broadcast at any size.
MAP_BITS, MAPS = 32_768, 256


def bitmap_of(keys: DataFrame, *key: str) -> DataFrame:
    """The keys as a bitmap of fixed size: (__map, __bits). Two keys may share a bit."""
    bit = F.pmod(F.xxhash64(*key), F.lit(MAP_BITS * MAPS))
    bits = keys.select(bit.alias("bit")).select((F.col("bit") / MAP_BITS).cast("int").alias("__map"), (F.col("bit") % MAP_BITS).alias("at"))
    return bits.groupBy("__map").agg(F.bitmap_construct_agg("at").alias("__bits"))


def asked_of(rows: DataFrame, bitmap: DataFrame, name: str, *key: str) -> DataFrame:
    """``rows`` with the boolean ``name``: false only if the key isn't in the bitmap. No shuffle."""
    marked = rows.withColumn("__bit", F.pmod(F.xxhash64(*key), F.lit(MAP_BITS * MAPS)))
    found = marked.withColumn("__map", (F.col("__bit") / MAP_BITS).cast("int")).join(F.broadcast(bitmap), "__map", "left")
    at = (F.col("__bit") % MAP_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.withColumn(name, F.coalesce(F.bit_get(byte, at % 8) == 1, F.lit(False))).drop("__map", "__bits", "__bit")
