"""Selections over documents, units and runs that join several tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import latest

#: What a finding may be set to by hand.
MANUAL_STATUSES = ["fulfilled", "not_applicable"]


def listed_documents(documents: DataFrame, names: dict[str, DataFrame], object_id: str = "object_id") -> DataFrame:
    """The documents that have content and are neither deleted nor moved away, with the names that their keys stand for.

    ``documents``: ``object_id``, sha256, status, deleted_at and a key for each of ``names``, which maps the key to a
    table of key and name; a key without a name, and a missing key, give null.
    """
    own = F.col("deleted_at").isNull() & (F.coalesce("sha256", F.lit("")) != "") & ~F.coalesce(F.col("status") == "moved_out", F.lit(False))
    out = documents.where(own & F.col(object_id).isNotNull())
    for key, table in names.items():
        out = out.join(table, key, "left")
    return out


def matching_units(units: DataFrame, label: str, number: str, asked: str, order: Sequence[str], most: int = 200) -> DataFrame:
    """Units whose normalised label begins with ``asked``, or whose number has its digits; at most one page of them."""
    hit = F.startswith(F.col(label), F.lit(asked))
    digits = "".join(ch for ch in asked if ch.isdigit())
    if digits:
        hit = hit | (F.col(number) == digits)
    return units.where(hit).orderBy(*order).limit(most)


def remote_dispositions(remote: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """What becomes of each document of a remote archive, by the first rule that holds.

    ``remote``: remote_id, trashed, failed, checksum; ``links``: remote_id, document_id; ``documents``: document_id,
    sha256 of those that may be linked. Linked already, in the bin, unreadable, equal to one document, equal to
    several, else new. ``document_id`` is the linked or the first equal one.
    """
    linked = links.groupBy("remote_id").agg(F.min("document_id").alias("__linked"))
    equal = documents.where("sha256 is not null").groupBy(F.col("sha256").alias("checksum")).agg(F.min("document_id").alias("__equal"), F.count("*").alias("__n"))
    found = remote.join(linked, "remote_id", "left").join(equal, "checksum", "left")
    rule = (
        F.when(F.col("__linked").isNotNull(), "link_existing")
        .when(F.col("trashed"), "out_of_scope")
        .when(F.col("failed"), "error")
        .when(F.col("__n") == 1, "link_existing")
        .when(F.col("__n") > 1, "duplicate")
        .otherwise("new")
    )
    document = F.when(F.col("__linked").isNotNull(), F.col("__linked")).when(rule.isin("link_existing", "duplicate"), F.col("__equal"))
    return found.select("remote_id", rule.alias("disposition"), document.alias("document_id"))


def run_summary(objects: DataFrame, runs: DataFrame, actions: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """The last run of each object with the number of its successful actions of each kind; objects without one stay.

    ``runs``: object_id, run_id, started_at; ``actions``: run_id, kind, ok.
    """
    last = latest(runs, ["object_id"], [F.col("started_at").desc(), F.col("run_id").desc()])
    counts = actions.groupBy("run_id").agg(*(F.count_if((F.col("kind") == k) & F.col("ok")).alias(k) for k in kinds))
    joined = objects.join(last, "object_id", "left").join(counts, "run_id", "left")
    return joined.select(*objects.columns, "run_id", *(F.when(F.col("run_id").isNotNull(), F.coalesce(k, F.lit(0))).alias(k) for k in kinds))


def tenant_group(lease_id: Column, assignment_id: Column) -> Column:
    """The key of the group that shares a file: the lease, or the assignment alone."""
    return F.coalesce(lease_id.cast("string"), F.concat(F.lit("a"), assignment_id.cast("string")))


def with_manual(findings: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Findings with the last decision by hand: a status other than fulfilled or not applicable, or one without a
    reason, is refused and named; an empty status takes an earlier decision back.

    ``decisions``: ``key``, seq, manual_status, manual_reason and, where several of a finding may have one seq, ``place``: of these
    the one with the smallest place counts. One without a seq is never the last. Refused decisions change nothing.
    """
    if "place" not in decisions.columns:
        decisions = decisions.withColumn("place", F.lit(0))
    status, reason = F.nullif(F.col("manual_status"), F.lit("")), F.nullif(F.trim(F.coalesce("manual_reason", F.lit(""))), F.lit(""))
    refused = F.when(status.isNotNull() & ~status.isin(MANUAL_STATUSES), "status").when(status.isNotNull() & reason.isNull(), "reason")
    judged = decisions.select(key, "seq", "place", status.alias("__s"), F.when(status.isNotNull(), reason).alias("__r"), refused.alias("__refused"))
    good = latest(judged.where("__refused is null and seq is not null"), [key], [F.col("seq").desc(), F.col("place")]).select(key, "__s", "__r")
    bad = judged.where("__refused is not null").groupBy(key).agg(F.count("*").alias("refused"))
    out = findings.join(good, key, "left").join(bad, key, "left")
    return out.select(*findings.columns, F.col("__s").alias("manual_status"), F.col("__r").alias("manual_reason"), F.coalesce("refused", F.lit(0)).alias("refused"))
