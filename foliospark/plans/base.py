"""Tables of a scale-factor folder, and queries whose input both engines build with the same expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks for each core among which ``spread`` deals rows.
TASKS_A_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores, for costly work on each: a narrow table lies in few row groups, each of which one task reads."""
    return df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


class Catalogue:
    """Collects the queries of a module with their oracles."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def scalar(self, name: str, source: str, inputs: dict[str, str], outputs: dict[str, Callable[[], Column]], oracle: dict[str, str] | None) -> None:
        """A projection: ``inputs`` are expressions of both dialects, ``outputs`` columns over them."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = table(spark, sf_dir, source).selectExpr(*(f"{e} AS {c}" for c, e in inputs.items()))
            return df.select("k", *(make().alias(c) for c, make in outputs.items()))

        self.queries[name] = run
        if oracle is not None:
            self.oracles[name] = f"WITH src AS (SELECT {', '.join(f'{e} AS {c}' for c, e in inputs.items())} FROM {source}) SELECT k, {', '.join(f'{e} AS {c}' for c, e in oracle.items())} FROM src"

    def query(self, name: str, oracle: str | None = None):
        def add(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return add


C = F.col
