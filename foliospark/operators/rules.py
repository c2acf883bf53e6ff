"""Declarative rules compiled to column expressions, their evaluation, evidence scores and mined features."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import noisy_or

FIELDS = {"text", "subject", "filename", "sender"}


def validate(rule: dict) -> None:
    """Fields, patterns and target of a rule."""
    missing = {"id", "when", "then"} - rule.keys()
    if missing or "category" not in rule.get("then", {}):
        raise ValueError(f"rule {rule.get('id')!r} lacks {sorted(missing) or ['category']}")
    for field, patterns in rule["when"].items():
        if field not in FIELDS | {"any_of", "management_type"}:
            raise ValueError(f"rule {rule['id']!r}: unknown field {field!r}")
        for p in patterns if field in FIELDS else []:
            re.compile(p)


def load(path: str) -> list[dict]:
    """Rules of a JSON file, with unique ids."""
    import json

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    if len({r["id"] for r in rules}) < len(rules):
        raise ValueError("rule ids repeat")
    for r in rules:
        validate(r)
    return rules


def condition(when: dict) -> Column:
    """AND over fields, OR inside a list, any_of as one more OR, a list of management types as scope."""
    parts = [reduce(lambda a, b: a | b, (F.coalesce(F.col(field), F.lit("")).rlike(f"(?iU){p}") for p in patterns)) for field, patterns in when.items() if field in FIELDS]
    if when.get("any_of"):
        parts.append(reduce(lambda a, b: a | b, map(condition, when["any_of"])))
    if when.get("management_type"):
        parts.append(F.col("management_type").isin(when["management_type"]))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def hit(rule: dict) -> Column:
    """A rule's hit as a struct, null without one. A rule on the subject only is soft and at most 0.6 sure."""
    then = rule["then"]
    only_subject = set(rule["when"]) & FIELDS == {"subject"} and not rule["when"].get("any_of")
    sure = min(then.get("confidence", 0.8), 0.6) if only_subject else then.get("confidence", 0.8)
    return F.when(condition(rule["when"]), F.struct(F.lit(-rule.get("priority", 0)).alias("order"), F.lit(-float(sure)).alias("doubt"), F.lit(rule["id"]).alias("id"), F.lit(then["category"]).alias("category"), F.lit(bool(then.get("hard")) and not only_subject).alias("hard")))


def evaluate(docs: DataFrame, rules: list[dict]) -> DataFrame:
    """Category, confidence, hard, conflict and the hits' ids of each document. Rules are few and become one projection."""
    for r in rules:
        validate(r)
    hits = F.array_sort(F.filter(F.array(*map(hit, rules)), lambda h: h.isNotNull()))
    out = docs.withColumn("__hits", hits)
    hard = F.filter("__hits", lambda h: h["hard"])
    conflict = F.size(F.array_distinct(F.transform(hard, lambda h: h["category"]))) > 1
    best = F.try_element_at(F.when(F.size(hard) > 0, hard).otherwise(F.col("__hits")), F.lit(1))
    return out.withColumns({"conflict": conflict, "rule_category": F.when(~conflict, best["category"]), "rule_confidence": F.when(~conflict, -best["doubt"]), "rule_hard": F.coalesce(F.when(~conflict, best["hard"]), F.lit(False)), "rule_ids": F.transform("__hits", lambda h: h["id"])}).drop("__hits")


def score_candidates(evidence: DataFrame, document: str = "document_id", candidate: str = "object_id") -> DataFrame:
    """Evidence rows (document, candidate, kind, weight, strong, address_key) to scores.

    A strong address of another candidate contradicts; candidates of one address halve each other's address
    weights unless other evidence anchors them; the best address counts fully, two more add 0.05 each.
    """
    address = F.col("kind") == "address"
    anchored = evidence.where(~address & (F.col("weight") > 0)).select(document, candidate).distinct().withColumn("anchored", F.lit(True))
    shared = evidence.where(address).groupBy(document, "address_key").agg(F.count_distinct(candidate).alias("sharers"))
    w = Window.partitionBy(document, candidate, "kind").orderBy(F.col("weight").desc(), "address_key")
    rows = evidence.join(anchored, [document, candidate], "left").join(shared, [document, "address_key"], "left").withColumn("n", F.row_number().over(w))
    halved = F.when(address & (F.col("sharers") > 1) & F.col("anchored").isNull(), F.col("weight") / 2).otherwise(F.col("weight"))
    used = F.when(address & (F.col("n") > 3), 0.0).when(address & (F.col("n") > 1) & (F.col("weight") > 0), F.lit(0.05)).otherwise(halved)
    scored = rows.withColumn("used", used).groupBy(document, candidate).agg(noisy_or(F.array_sort(F.collect_list("used"))).alias("score"), F.max(F.col("strong") & address).alias("strong"))
    strong = scored.groupBy(document).agg(F.count_if("strong").alias("strong_candidates"))
    return scored.join(strong, document).withColumn("contradicted", F.col("strong_candidates") - F.col("strong").cast("int") > 0).drop("strong_candidates")


def cross_check(scored: DataFrame, document: str, own: Column) -> DataFrame:
    """Whether evidence points to the own candidate, another one, both or none."""
    return scored.groupBy(document).agg(F.coalesce(F.bool_or(own & (F.col("score") >= 0.3)), F.lit(False)).alias("__own"), F.coalesce(F.bool_or(~own & F.col("strong")), F.lit(False)).alias("__other"), F.max("score").alias("best")).select(document, F.when(F.col("__other"), "second_reference").when(F.col("best").isNull() | (F.col("best") == 0), "no_reference").when(~F.col("__own"), "weak_reference").otherwise("clear").alias("kind"))


def amounts(text: Column) -> Column:
    """German amounts with their labels, as an array of (label, amount text)."""
    shape = r"(?i)(kaution|kaltmiete|nebenkosten|heizkosten|gesamt|summe|betrag)[^0-9\n]{0,60}([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})"
    return F.arrays_zip(F.transform(F.regexp_extract_all(text, F.lit(shape), 1), F.lower).alias("label"), F.regexp_extract_all(text, F.lit(shape), 2).alias("amount"))


def numbers(text: Column) -> Column:
    """contract, customer, meter, insurance and property numbers by the word in front, without repeats."""
    kinds = {"contract": "vertrags", "customer": "kunden", "meter": "z(?:ä|ae)hler", "insurance": "versicherungs", "property": "liegenschafts"}
    found = [F.transform(F.regexp_extract_all(F.lower(text), F.lit(rf"{word}-?(?:nummer|nr\.?)[:\s]*([a-z0-9][a-z0-9\-/.]*)"), 1), lambda v, k=kind: F.struct(F.lit(k).alias("kind"), F.regexp_replace(v, "[^a-z0-9]", "").alias("value"))) for kind, word in kinds.items()]
    return F.array_distinct(F.filter(F.concat(*found), lambda x: F.length(x["value"]) >= 3))


def dates(text: Column) -> Column:
    """Dates of a page."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})\b"), 1), lambda d: F.try_to_date(d, "d.M.yyyy")), lambda d: d.isNotNull())


def keyword_groups(text: Column, groups: dict[str, list[str]]) -> Column:
    """the words of each group that a text holds, as a map without empty groups."""
    found = F.create_map(*(v for name, words in groups.items() for v in (F.lit(name), F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))))
    return F.map_filter(found, lambda _, v: F.size(v) > 0)


def gazetteer_hits(pages: DataFrame, streets: DataFrame) -> DataFrame:
    """Streets of a dictionary in page texts, by an equi-join on tokens with a check of the house number.

    ``pages``: page_id, text (normalised); ``streets``: object_id, street_key (one word), number.
    """
    words = F.split("text", r"\s+")
    near = F.arrays_zip(words.alias("street_key"), F.slice(words, 3, F.size(words)).alias("next"))
    tokens = pages.select("page_id", F.posexplode(near).alias("at", "token")).select("page_id", "at", "token.*")
    hits = tokens.join(streets, "street_key")
    return hits.select("page_id", "object_id", "street_key", "at", F.coalesce(F.regexp_extract("next", r"^([0-9]+)", 1).try_cast("int") == F.col("number"), F.lit(False)).alias("number_match"))
