"""Language identification of web pages by Bayesian fusion of evidence.

For each language the posterior is proportional to: the host's prior, times the likelihood of the page's text
under a model of character 3-grams, times the likelihoods of the declared markup language and of the
address's suffix. The tables for declarations and suffixes, and the priors, come from grouped aggregation
of soft language counts (the text's own posteriors) over all pages. A host's prior is smoothed towards
its domain's, which is smoothed towards the prior of all pages; a page's own soft count is taken out.

Defined cases: a null html counts as empty and its text says nothing; a null or odd address has an empty
host, whose prior is that of all pages without one; unknown declarations are one value, missing ones another;
ties go to the first language in alphabetical order; repeated rows are judged alike; without labelled documents
the language is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text, written

BUCKETS = 1 << 15
#: Bound of the training sample: labelled documents of each language.
PER_LANGUAGE = 300
#: 3-grams of a text depend on each other; this share of their number counts as independent evidence.
TEMPER = 0.2
KAPPA = 10.0
ALPHA = 1.0
#: Where something may be hidden: a comment, a script, a style, a head, or any other tag.
OPENING = re.compile(r"<(?:(!--)|(script|style|head)\b)?", re.IGNORECASE)
ENDS = {"!--": re.compile("-->")} | {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "head")}
TAG_END = re.compile(">")


def visible(html: str) -> str:
    """The text outside of tags, comments, scripts, styles and heads. What is never closed hides nothing; each kind of
    end is looked for once behind its last place, so the work is linear even in broken pages."""
    out, at = [], 0
    closed: dict[str, bool] = {}

    def end_of(kind: str, pattern: re.Pattern, start: int) -> int | None:
        if closed.get(kind, True):
            if found := pattern.search(html, start):
                return found.end()
            closed[kind] = False
        return None

    while opening := OPENING.search(html, at):
        kind = (opening.group(1) or opening.group(2) or "").lower()
        stop = end_of(kind, ENDS[kind], opening.end()) if kind else None
        stop = stop or end_of(">", TAG_END, opening.end())
        if stop is None:
            out.append(html[at : opening.end()])
            at = opening.end()
            continue
        out.append(html[at : opening.start()])
        out.append(" ")
        at = stop
    out.append(html[at:])
    return re.sub(r"&#?\w+;", " ", "".join(out))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character 3-grams of a lower-case text, with their counts."""
    points = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
        h ^= h >> np.uint64(15)
    return np.unique((h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)


@dataclass(frozen=True)
class GramModel:
    languages: list[str]
    logs: np.ndarray

    def log_likelihoods(self, text: str) -> list[float]:
        grams, counts = gram_counts(text)
        scores = (self.logs[:, grams] * counts).sum(axis=1) * TEMPER
        return (scores - scores.max()).tolist() if len(scores) else []


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> GramModel:
    """Learn from a bounded sample of each language's documents."""
    known = docs.where(F.col("lang").isNotNull()).select("doc_id", "lang")
    named = [r["lang"] for r in known.select("lang").distinct().collect()]
    if not named:
        return GramModel([], np.zeros((0, BUCKETS)))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(31)), "doc_id")
    ids = known.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).select("doc_id", "lang")
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(ids), "doc_id")
    # A repeated id counts once for each language, with its least text, so the bound holds for rows too.
    rows = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    named = sorted(named)
    counts = np.full((len(named), BUCKETS), 0.05)
    for r in rows:
        grams, n = gram_counts(r["text"])
        counts[named.index(r["lang"]), grams] += n
    return GramModel(named, np.log(counts / counts.sum(axis=1, keepdims=True)))


def evidence(pages: DataFrame, model: GramModel, id_column: str = "page_id") -> DataFrame:
    """page_id, host, domain, suffix, declared, and the text's log likelihoods ``text_logs``."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def text_logs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shared.value.log_likelihoods(visible(t)) for t in batch.to_pylist()], pa.list_(pa.float64()))

    html = whole_text("html")
    host = F.regexp_extract(F.lower(whole_text("url")), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    labels = F.split(host, r"\.")
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})", 1))
    return pages.select(
        F.col(id_column).alias("page_id"),
        host.alias("host"),
        F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), ".").alias("domain"),
        F.element_at(labels, -1).alias("suffix"),
        F.when(declared == "", "none").when(declared.isin(model.languages), declared).otherwise("other").alias("declared"),
        text_logs(html).alias("text_logs"),
    )


def softmax(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def sums(size: int) -> Column:
    """Soft counts of a group, one for each language."""
    return F.array(*(F.sum(F.col("soft")[k]) for k in range(size)))


def identify(pages: DataFrame, model: GramModel, id_column: str = "page_id") -> DataFrame:
    """page_id, lang, probability, text_lang, declared, suffix, host, and the array ``posterior`` in the order of ``model.languages``."""
    names, size = F.array(*map(F.lit, model.languages)), len(model.languages)
    if not size:
        return pages.select(F.col(id_column).alias("page_id"), *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"), ("suffix", "string"), ("host", "string"), ("posterior", "array<double>"))))
    rows = written(evidence(pages, model, id_column), "evidence").withColumn("soft", softmax(F.col("text_logs")))
    world = F.transform(F.array(*(F.lit(float(x)) for x in [v or 0.0 for v in (rows.agg(sums(size).alias("s")).first()["s"])])), lambda x: x)
    all_pages = F.aggregate(world, F.lit(0.0), lambda a, b: a + b)
    tables = {c: written(rows.groupBy(c).agg(sums(size).alias(f"{c}_counts")), f"language-{c}") for c in ("declared", "suffix", "host", "domain")}
    wide = rows
    for c in ("declared", "suffix", "domain", "host"):  # written tables, so Spark can split a host that holds a third of all pages
        wide = wide.join(tables[c], c)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    own = lambda a: F.zip_with(a, "soft", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    base = F.zip_with(world, "soft", lambda w, s: (F.greatest(w - s, F.lit(0.0)) + ALPHA) / (F.greatest(all_pages - 1, F.lit(0.0)) + ALPHA * size))
    wide = wide.withColumns({"base": base, "d": own(F.col("domain_counts")), "h": own(F.col("host_counts"))})
    wide = wide.withColumn("domain_prior", F.zip_with("d", "base", lambda n, p: (n + KAPPA * p) / (total(F.col("d")) + KAPPA)))
    wide = wide.withColumn("prior", F.zip_with("h", "domain_prior", lambda n, p: (n + KAPPA * p) / (total(F.col("h")) + KAPPA)))
    given = lambda c, values: F.zip_with(own(F.col(f"{c}_counts")), world, lambda n, w: F.log((n + ALPHA) / (w + ALPHA * values)))
    logs = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.log(F.col("prior")[k]) + F.col("text_logs")[k] + F.col("declared_logs")[k] + F.col("suffix_logs")[k])
    done = wide.withColumns({"declared_logs": given("declared", size + 2), "suffix_logs": given("suffix", 64)}).withColumn("posterior", softmax(logs))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return done.select("page_id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"), best(F.col("soft")).alias("text_lang"), "declared", "suffix", "host", "posterior")
