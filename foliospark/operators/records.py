"""Figures, states and choices over records: cases, jobs, runs, costs and matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def queue_figures(cases: DataFrame, key: str, is_open: Column, created: Column, before: Column, has_candidates: Column) -> DataFrame:
    """Open cases of each key, those created before a time, and those with candidates."""
    return cases.groupBy(key).agg(F.count_if(is_open).alias("open"), F.count_if(is_open & (created < before)).alias("older"), F.count_if(is_open & has_candidates).alias("with_candidates"))


def run_figures(documents: DataFrame, run: str, is_misc: Column, time: Column) -> DataFrame:
    """Documents of each run, the share of the catch-all category, and documents a minute of the run's span."""
    minutes = F.greatest(F.lit(0.001), (F.max(F.unix_timestamp(time)) - F.min(F.unix_timestamp(time))) / 60)
    return documents.groupBy(run).agg(F.count("*").alias("documents"), F.round(F.count_if(is_misc) / F.count("*"), 6).alias("misc"), F.round(F.count("*") / minutes, 6).alias("per_minute"))


def lease_ends(spans: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """First start and last end of each key; open if any span is."""
    return spans.groupBy(key).agg(F.min(start).alias("start"), F.when(F.count("*") == F.count(end), F.max(end)).alias("ends"))


def costs(calls: DataFrame, keys: Sequence[str], amount: Column, day: Column) -> DataFrame:
    """Sum of the amounts, number of calls and last day, by the given keys."""
    return calls.groupBy(*keys).agg(F.sum(amount).alias("cost"), F.count("*").alias("calls"), F.max(day).alias("last_call"))


def job_report(jobs: DataFrame, kind: str, duration: str, worker: str) -> DataFrame:
    """Number, total and longest duration of the jobs of each kind, and how many workers had them."""
    return jobs.groupBy(kind).agg(F.count("*").alias("n"), F.sum(duration).alias("total"), F.max(duration).alias("longest"), F.count_distinct(worker).alias("users"))


def top_values(df: DataFrame, column: str, most: int) -> DataFrame:
    """The most frequent values with their numbers, ties in order."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(most)


def hit_rates(examples: DataFrame, holdout: Column, hit: Column, rejected: Column) -> DataFrame:
    """Rates over all examples, the training part and the holdout, from one pass."""
    marked = examples.withColumn("__h", holdout)
    part = F.when(F.grouping("__h") == 1, "all").when(F.first("__h"), "holdout").otherwise("training")
    hits = F.count_if(hit)
    rates = marked.groupingSets([[], [F.col("__h")]], F.col("__h")).agg(part.alias("part"), F.count("*").alias("n"), F.round(F.try_divide(hits, F.count("*")), 4).alias("hit_rate"), F.round(F.try_divide(F.count_if(rejected), hits), 4).alias("reject_rate"))
    return rates.drop("__h")


def state_summary(jobs: DataFrame, key: str, state: str, waiting: Sequence[str], failed: str, oldest_of: str, time: str) -> DataFrame:
    """Waiting and failed jobs of each key, and since when the oldest one of a state is there."""
    s = F.col(state)
    return jobs.groupBy(key).agg(F.count_if(s.isin(*waiting)).alias("queue"), F.count_if(s == failed).alias("failed"), F.min(F.when(s == oldest_of, F.col(time))).alias("oldest"))


def class_readiness(samples: DataFrame, label: str, weight: Column, least: float) -> DataFrame:
    """Whether every class has samples of enough weight."""
    return samples.groupBy(label).agg(F.sum(weight).alias("w")).agg(F.bool_and(F.col("w") >= least).alias("ready"))


def best_with_margin(mentions: DataFrame, key: str, candidate: str, margin: float = 2) -> DataFrame:
    """The candidate that most mentions of a key name, and whether it has ``margin`` times the next one's."""
    counts = mentions.groupBy(key, candidate).agg(F.count("*").alias("hits"))
    w = Window.partitionBy(key).orderBy(F.col("hits").desc(), candidate)
    ranked = counts.withColumns({"__n": F.row_number().over(w), "__next": F.lead("hits").over(w)}).where("__n = 1")
    return ranked.select(key, candidate, "hits", (F.col("hits") >= margin * F.coalesce("__next", F.lit(0))).alias("clear"))


def pivot_counts(df: DataFrame, row: str, column: str, names: Sequence[str]) -> DataFrame:
    """Counts of the named values as columns."""
    return df.groupBy(row).pivot(column, list(names)).agg(F.count(F.lit(1))).na.fill(0)


def subtotals(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts by either column, by both and of all, with their grouping level."""
    a, b = F.col(first), F.col(second)
    return df.groupingSets([[], [a], [b], [a, b]], a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def compound_counts(df: DataFrame, *parts: Column) -> DataFrame:
    """Counts by the parts joined with a slash, a missing one being empty."""
    return df.groupBy(F.concat_ws("/", *(F.coalesce(p, F.lit("")) for p in parts)).alias("kind")).agg(F.count("*").alias("n"))


def unit_totals(units: DataFrame, key: str, share: str, base: str, expected: Column) -> DataFrame:
    """Units of each key, whether they are as many as expected, their shares, and whether all have one base."""
    return units.groupBy(key).agg(F.count("*").alias("units"), (F.count("*") == expected).alias("expected"), F.sum(share).alias("shares"), (F.count_distinct(base) == 1).alias("single_base"))


def letter(items: DataFrame, key: str, category: str, most: int) -> DataFrame:
    """The items of each key counted by category as lines of a letter; more than ``most`` items become an attachment."""
    counts = items.groupBy(key, category).agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.struct(category, "n")))
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x[category], F.lit(": "), x["n"].cast("string"))), "\n")
    return counts.groupBy(key).agg(body.alias("body"), (F.sum("n") > most).alias("attachment"))


def top_of_each(df: DataFrame, key: str, score: str, tie: str, most: int) -> DataFrame:
    """The best ``most`` candidates of each key as text, best first. Only the best ones are gathered."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), tie)
    best = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.col(tie).cast("string").alias("t")))), lambda x: x["t"]), ",").alias("top"))


def json_documents(actions: DataFrame, run: str, **fields: str) -> DataFrame:
    """Each run's actions as one JSON array, in the order of the fields."""
    return actions.groupBy(run).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(n) for n, c in fields.items()))))).alias("doc"))


def byte_batches(rows: DataFrame, key: str, order: str, size: str, limit: int, block: int = 100_000) -> DataFrame:
    """Rows of each key in order, cut into batches: row k is in batch floor(bytes before it / limit).

    The bytes before a row are those of whole blocks of ``order`` before its own, from a small table, and those before
    it in its block; so a key that holds a third of all rows isn't sorted in one task.
    """
    cut = rows.withColumn("__block", F.floor(F.col(order) / block))
    sums = cut.groupBy(key, "__block").agg(F.sum(size).alias("__bytes"))
    before = F.coalesce(F.sum("__bytes").over(Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(size).over(Window.partitionBy(key, "__block").orderBy(order)) - F.col(size)
    placed = cut.withColumn("__inside", inside).join(sums.select(key, "__block", before.alias("__before")), [key, "__block"])
    return placed.withColumn("batch", F.floor((F.col("__before") + F.col("__inside")) / limit)).select(*rows.columns, "batch")


def first_reason(*reasons: tuple[Column, str]) -> Column:
    """The name of the first condition that holds, else null."""
    out = F.when(*reasons[0])
    for condition, name in reasons[1:]:
        out = out.when(condition, name)
    return out


def worst_status(records: DataFrame, key: str, status: str, order: Sequence[tuple[str, str]], otherwise: str) -> DataFrame:
    """One status for each key: that of the first value in ``order`` that any of its records has."""
    have = {value: F.bool_or(F.col(status) == value) for value, _ in order}
    return records.groupBy(key).agg(F.coalesce(first_reason(*((have[v], name) for v, name in order)), F.lit(otherwise)).alias("status"))


def scope_number(text: Column, number: int) -> Column:
    """Whether the first number of a text is ``number``, leading zeros aside."""
    return F.regexp_extract(text, "([0-9]+)", 1).try_cast("long") == number


def lost_jobs(jobs: DataFrame, open_: Column, lost: Column, order: Sequence[str], most: int) -> DataFrame:
    """Open jobs that nobody works on, oldest first, as many as one sweep takes."""
    return jobs.where(open_ & lost).orderBy(*order).limit(most)


def conflict_kind(equal: Column, local: Column, base: Column, remote: Column) -> Column:
    """What a three-way comparison says: nothing to do, one side changed, or both."""
    return F.when(equal, "none").when(local.eqNullSafe(base), "take_remote").when(local.eqNullSafe(remote), "take_local").otherwise("conflict")


def repeated_jobs(jobs: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Jobs with ``skipped``: true behind the first one of equal keys. The first is joined back, so a very frequent
    key isn't sorted in one task; ``order`` must tell all jobs of a key apart."""
    first = jobs.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    return jobs.join(first, list(keys)).withColumn("skipped", F.struct(*order) > F.col("__first")).drop("__first")


def stale_jobs(jobs: DataFrame, started: Column, now: Column, minutes: Column, attempts: Column, most: int) -> DataFrame:
    """Jobs that run for longer than their kind may; failed after the last attempt, else pending again."""
    late = F.unix_timestamp(started) < F.unix_timestamp(now) - minutes * 60
    return jobs.where(late).withColumn("state", F.when(attempts >= most, "failed").otherwise("pending"))


def alert_edges(samples: DataFrame, key: str, order: Sequence[str], active: Column) -> DataFrame:
    """Where an alert of a key begins and where it ends."""
    marked = samples.withColumn("__a", F.coalesce(active, F.lit(False)))
    before = F.coalesce(F.lag("__a").over(Window.partitionBy(key).orderBy(*order)), F.lit(False))
    return marked.withColumns({"raised": F.col("__a") & ~before, "cleared": ~F.col("__a") & before}).drop("__a")


def restart_state(documents: DataFrame, pages: DataFrame, key: str, hashed: Column) -> DataFrame:
    """Where the work on a document goes on: it has pages, a hash, or nothing yet."""
    known = pages.select(key).distinct().withColumn("__paged", F.lit(True))
    return documents.join(known, key, "left").withColumn("state", F.when(F.col("__paged"), "ocr_done").when(hashed, "hashed").otherwise("registered")).drop("__paged")


def field_audit(records: DataFrame, sources: DataFrame, key: str, group: str) -> DataFrame:
    """Records of each group without a source, with exactly one, and with several."""
    n = sources.groupBy(key).agg(F.count("*").alias("__n"))
    outcome = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") == 1, "same").otherwise("other")
    return records.join(n, key, "left").groupBy(group, outcome.alias("outcome")).agg(F.count("*").alias("n"))


def merged(*values: Column) -> Column:
    """Of several readings of a fact, the first that says anything."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def in_order_of_appearance(df: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """The distinct values of each key in the order in which they first occur, as text."""
    first = df.groupBy(key, value).agg(F.min(position).alias("__at"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", value))), lambda x: x[value]), ",").alias(f"{value}s"))


def final_action(contradicted: Column, category: Column, short: Column, trusted: Column) -> Column:
    """What becomes of a document: contradictions go to review, short ones without a category aside, trusted
    ones are filed, untrusted ones reviewed, the rest go to the next stage."""
    return F.when(contradicted, "review").when(category.isNull() & short, "misc").when(trusted, "file").when(~trusted, "review").otherwise("stage3")


def batch_key(*parts: Column, most: int = 120) -> Column:
    """The key that groups alike decisions."""
    return F.substring(F.concat_ws(":", *parts), 1, most)


def numbered_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """equal names get counters from the second on, in order."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("__n", n).withColumn("unique_name", F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat_ws("_", name, F.col("__n").cast("string")))).drop("__n")
