"""Key figures, progress, costs and their exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import percent


def key_figures(documents: DataFrame, cases: DataFrame, costs: DataFrame, today: Column) -> DataFrame:
    """One row of figures for each object, from one aggregation of each fact table.

    ``documents``: object_id, status, category, decided_by, pages; ``cases``: object_id, status, created_on, resolved_on,
    confirmed; ``costs``: object_id, cost.
    """
    docs = documents.groupBy("object_id").agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"), F.count_if(F.col("status") == "filed").alias("filed"), F.count_if(F.col("category") == "99").alias("misc"), F.count_if(F.col("decided_by") == "stage1").alias("by_stage1"), F.count_if(F.col("decided_by") == "stage2").alias("by_stage2"), F.count_if(F.col("status") == "error").alias("errors"))
    age = F.datediff(today, "created_on")
    open_ = F.col("status") == "open"
    own = cases.groupBy("object_id").agg(F.count_if(open_).alias("open_cases"), F.median(F.when(open_, age)).alias("median_age"), F.max(F.when(open_, age)).alias("max_age"), F.count_if(F.col("resolved_on").isNotNull()).alias("resolved"), F.count_if(F.col("confirmed")).alias("confirmed"))
    money = costs.groupBy("object_id").agg(F.sum("cost").alias("cost"))
    joined = docs.join(own, "object_id", "left").join(money, "object_id", "left")
    return joined.withColumns({"misc_share": percent(F.col("misc"), F.col("documents")), "filed_share": percent(F.col("filed"), F.col("documents")), "hit_rate": percent(F.col("confirmed"), F.col("resolved"))})


def decimal_text(x: Column, places: int = 2) -> Column:
    """German decimals, null as empty."""
    return F.coalesce(F.replace(F.format_string(f"%.{places}f", x.cast("double")), F.lit("."), F.lit(",")), F.lit(""))


def crlf_lines(df: DataFrame) -> DataFrame:
    """The lines of the export, each with CR, for a text sink that adds LF."""
    return df.select(F.concat(F.concat_ws(";", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit("\r")).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolons and CR LF; distributed, one file for each task."""
    crlf_lines(df).write.mode("overwrite").text(path)


def progress(jobs: DataFrame, key: str, status: str, names: list[str]) -> DataFrame:
    """Counts by status as columns."""
    return jobs.groupBy(key).agg(*(F.count_if(F.col(status) == n).alias(n.lower()) for n in names), F.count("*").alias("total"))


def canonical_digest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """A digest over the rows of each group in order, as pinned text."""
    row = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    parts = F.array_sort(F.collect_list(F.struct(*order, row.alias("__row"))))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["__row"]), "\n"), 256).alias("digest"))
