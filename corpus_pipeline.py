"""From raw documents to token ids: five stages, each a function of Spark, documents and the tables' folder.

Each stage but the last returns the columns of ``documents``. ``run`` writes what a stage keeps as Parquet
into the shared folder and gives it to the next one. The order of mixing lies in the order of its files and rows;
the last stage reads it from there and returns it as ``mix_position``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import exact_dedup, mixing, near_join, quality, sentencepieces
from foliospark.llm.common import table, written
from foliospark.llm.queries import PIECE_MODEL

#: Words that the encoder remembers: few, as its workers keep them while the other stages run.
REMEMBERED = 50_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays, that with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one stays, that with the least doc_id."""
    return near_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that follows the target weights of their sources."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids in place of the texts, from which they can be decoded exactly, and the place of each document in the mixed order."""
    return sentencepieces.encode(mixing.with_place(docs), PIECE_MODEL, verify=False, remembered=REMEMBERED).drop("text")


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The classifier and the mixing order have no SQL form; a brute-force version in the tests takes its place.
ORACLE_SQL = None
