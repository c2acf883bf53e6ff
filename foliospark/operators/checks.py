"""Completeness checks: declarative checks over objects, units, assignments and years, and their summaries.

A finding has the columns object_id, check_code, scope, unit_id, assignment_id, year, status, category,
recommendation, blocking; ``status`` is fulfilled, partial, missing or not_applicable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = ["object_id", "check_code", "scope", "unit_id", "assignment_id", "year", "status", "category", "recommendation", "blocking"]
RANK = {"missing": 3, "partial": 2, "fulfilled": 1, "not_applicable": 0}


def finding(df: DataFrame, code: str, scope: str, status: Column, *, unit: str | None = None, assignment: str | None = None, year: str | None = None, category: str = "general", recommendation: bool = False, blocking: bool = False) -> DataFrame:
    """Rows of one check in the common shape."""
    opt = lambda c, t: (F.col(c) if c else F.lit(None)).cast(t)
    return df.select(F.col("object_id").cast("long").alias("object_id"), F.lit(code).alias("check_code"), F.lit(scope).alias("scope"), opt(unit, "long").alias("unit_id"), opt(assignment, "long").alias("assignment_id"), opt(year, "int").alias("year"), status.alias("status"), F.lit(category).alias("category"), F.lit(recommendation).alias("recommendation"), F.lit(blocking).alias("blocking"))


def document_status(confirmed: Column, in_review: Column) -> Column:
    """Fulfilled by a confirmed document, partial by one in review."""
    return F.when(confirmed > 0, "fulfilled").when(in_review > 0, "partial").otherwise("missing")


def owner_checks(objects: DataFrame, units: DataFrame, assignments: DataFrame, documents: DataFrame, years: list[int]) -> DataFrame:
    """The checks for co-owned objects.

    ``objects``: object_id, expected_units, sepa_used; ``units``: object_id, unit_id, share; ``assignments``:
    object_id, unit_id, assignment_id, owner_id, current, address, email, account; ``documents``: object_id,
    kind, year, confirmed (0 or 1).
    """
    per_object = units.groupBy("object_id").agg(F.count("*").alias("n_units"), F.sum("share").alias("shares"), F.count("share").alias("with_share"))
    current = assignments.where("current")
    owned = units.join(current.groupBy("object_id", "unit_id").agg(F.count("*").alias("n")), ["object_id", "unit_id"], "left")
    docs = documents.groupBy("object_id", "kind", "year").agg(F.sum("confirmed").alias("ok"), F.sum(1 - F.col("confirmed")).alias("open"))
    any_year = documents.groupBy("object_id", "kind").agg(F.sum("confirmed").alias("ok"), F.sum(1 - F.col("confirmed")).alias("open"))
    have = lambda kind: objects.join(any_year.where(F.col("kind") == kind), "object_id", "left")
    by_year = lambda kind: objects.withColumn("year", F.explode(F.array(*map(F.lit, years)))).join(docs.where(F.col("kind") == kind), ["object_id", "year"], "left")
    status = document_status(F.coalesce("ok", F.lit(0)), F.coalesce("open", F.lit(0)))
    full = objects.join(per_object, "object_id", "left")
    n = F.coalesce("n_units", F.lit(0))
    out = [
        finding(full, "all_units_known", "object", F.when(F.col("expected_units").isNull(), F.when(n > 0, "partial").otherwise("missing")).when((n == F.col("expected_units")) & (F.coalesce("with_share", F.lit(0)) == n), "fulfilled").when(n > 0, "partial").otherwise("missing"), category="master_data", blocking=True),
        finding(full.join(current.select("object_id").distinct().withColumn("any", F.lit(1)), "object_id", "left"), "owner_list_complete", "object", F.when(F.col("any").isNull(), "missing").otherwise("fulfilled"), category="master_data", blocking=True),
        finding(owned, "owner_per_unit", "unit", F.when(F.col("n") > 0, "fulfilled").otherwise("missing"), unit="unit_id", category="master_data"),
        finding(current, "addresses", "assignment", F.when(F.col("address").isNotNull(), "fulfilled").otherwise("missing"), unit="unit_id", assignment="assignment_id", category="contact"),
        finding(current, "contact_data", "assignment", F.when(F.col("email").isNotNull(), "fulfilled").when(F.col("address").isNotNull(), "partial").otherwise("missing"), unit="unit_id", assignment="assignment_id", category="contact"),
        finding(current.join(objects, "object_id"), "sepa_mandate", "assignment", F.when(F.col("sepa_used").isNull(), "partial").when(~F.col("sepa_used"), "not_applicable").when(F.col("account").isNotNull(), "fulfilled").otherwise("missing"), unit="unit_id", assignment="assignment_id", category="payment"),
    ]
    out += [finding(by_year(kind), kind, "object", status, year="year", category="accounting") for kind in ("owner_accounts", "annual_statement_year", "business_plan_year")]
    out += [finding(have(kind), kind, "object", status, category="accounting", recommendation=kind in ("payment_agreement", "dunning_procedure")) for kind in ("open_house_fees", "credits", "special_levy", "payment_agreement", "dunning_procedure", "owner_changes")]
    return reduce(DataFrame.unionByName, out)


def tenant_checks(objects: DataFrame, units: DataFrame, leases: DataFrame, documents: DataFrame) -> DataFrame:
    """The checks for rented units. ``leases``: object_id, unit_id, assignment_id, rent, deposit, adjustment, email, account."""
    counted = units.join(leases.groupBy("object_id", "unit_id").agg(F.count("*").alias("n")), ["object_id", "unit_id"], "left")
    both = lambda a, b: F.when(a & b, "fulfilled").when(a | b, "partial").otherwise("missing")
    with_ = lambda c: F.col(c).isNotNull()
    any_year = documents.groupBy("object_id", "kind").agg(F.sum("confirmed").alias("ok"), F.sum(1 - F.col("confirmed")).alias("open"))
    status = document_status(F.coalesce("ok", F.lit(0)), F.coalesce("open", F.lit(0)))
    keys = {"unit": "unit_id", "assignment": "assignment_id"}
    out = [
        finding(objects.join(leases.select("object_id").distinct().withColumn("any", F.lit(1)), "object_id", "left"), "tenant_list_complete", "object", F.when(F.col("any").isNull(), "missing").otherwise("fulfilled"), category="master_data"),
        finding(counted, "tenant_per_unit", "unit", F.when(F.col("n") > 0, "fulfilled").otherwise("missing"), unit="unit_id", category="master_data"),
        finding(leases, "lease_terms", "assignment", F.when(with_("rent"), "fulfilled").otherwise("missing"), **keys, category="lease"),
        finding(leases, "deposit", "assignment", both(with_("deposit"), with_("rent")), **keys, category="lease"),
        finding(leases, "rent_adjustment", "assignment", F.when(F.col("adjustment") == "unknown", "partial").when(with_("adjustment"), "fulfilled").otherwise("missing"), **keys, category="lease"),
        finding(leases, "tenant_contact_data", "assignment", F.when(with_("email"), "fulfilled").otherwise("missing"), **keys, category="contact"),
        finding(leases.join(objects, "object_id"), "tenant_sepa_mandate", "assignment", F.when(F.col("sepa_used").isNull(), "partial").when(~F.col("sepa_used"), "not_applicable").when(F.col("account").isNotNull(), "fulfilled").otherwise("missing"), **keys, category="payment"),
    ]
    out += [finding(objects.join(any_year.where(F.col("kind") == kind), "object_id", "left"), kind, "object", status, category="accounting") for kind in ("tenant_accounts", "tenant_dunning_procedure")]
    return reduce(DataFrame.unionByName, out)


def catalogue_checks(objects: DataFrame, checks: DataFrame, documents: DataFrame) -> DataFrame:
    """A list of required document kinds. ``checks``: check_code, kinds array<string>, recommendation."""
    wanted = objects.select("object_id").join(F.broadcast(checks), how="cross").withColumn("kind", F.explode_outer("kinds"))
    counts = documents.groupBy("object_id", "kind").agg(F.sum("confirmed").alias("ok"), F.sum(1 - F.col("confirmed")).alias("open"))
    best = wanted.join(counts, ["object_id", "kind"], "left").groupBy("object_id", "check_code", "recommendation").agg(F.sum(F.coalesce("ok", F.lit(0))).alias("ok"), F.sum(F.coalesce("open", F.lit(0))).alias("open"))
    return best.select("object_id", "check_code", document_status(F.col("ok"), F.col("open")).alias("status"), "recommendation")


def effective(status: Column, manual: Column) -> Column:
    """A manual status wins."""
    return F.coalesce(manual, status)


def summary(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts by status, ratio of fulfilled ones, worst status, and whether it is mostly complete."""
    counted = findings.where(~F.col("recommendation"))
    n = lambda s: F.count_if(F.col("status") == s)
    rank = reduce(lambda c, s: c.when(F.col("status") == s, RANK[s]), RANK, F.when(F.lit(False), 0))
    out = counted.groupBy(*keys).agg(*(n(s).alias(s) for s in RANK), F.max(rank).alias("__worst"), F.coalesce(F.max(F.col("blocking") & (F.col("status") == "missing")), F.lit(False)).alias("blocked"))
    total = F.col("fulfilled") + F.col("partial") + F.col("missing")
    ratio = F.when(total > 0, F.round(F.col("fulfilled") / total, 4))
    worst = reduce(lambda c, s: c.when(F.col("__worst") == RANK[s], s), RANK, F.when(F.lit(False), ""))
    return out.withColumns({"ratio": ratio, "worst": worst}).withColumn("mostly_complete", F.coalesce((F.col("ratio") >= 0.9) & ~F.col("blocked"), F.lit(False))).drop("__worst")
