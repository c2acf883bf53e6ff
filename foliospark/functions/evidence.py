"""Confidence of evidence: noisy-or, fusion of stages, and decisions on ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The thresholds of the fusion of classification stages.
STAGES = {"gap_factor": 0.3, "call": 0.75, "bonus": 0.05, "malus": 0.15, "conflict_p": 0.9, "support": 0.1}
#: The weight of an address by the role in which it is found.
ROLES = {"object": 0.75, "billing": 0.35, "travel": 0.3, "supplier": 0.0, "owner": 0.2, "neutral": 0.45}


def noisy_or(weights: Column) -> Column:
    """one minus the product of the misses, less the sum of negative weights, between 0 and 1."""
    miss = F.aggregate(F.filter(weights, lambda w: w > 0), F.lit(1.0), lambda a, w: a * (1 - F.least(w, F.lit(1.0))))
    penalty = F.aggregate(F.filter(weights, lambda w: w < 0), F.lit(0.0), lambda a, w: a - w)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - miss - penalty))


def address_weight(role: Column, ambiguous: Column, postal: Column, city: Column, postal_bonus: float = 0.25, city_bonus: float = 0.1, factor: float = 0.5) -> Column:
    """weight of an address and whether it is a clear reference."""
    base = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for p in ROLES.items() for v in p)), role), F.lit(ROLES["neutral"])) * F.when(ambiguous, factor).otherwise(1.0)
    weights = F.array(base, F.when(postal, postal_bonus).otherwise(0.0), F.when(city, city_bonus).otherwise(0.0))
    return F.struct(
        F.when(role == "supplier", F.lit(ROLES["supplier"])).otherwise(noisy_or(weights)).alias("weight"),
        ((role == "object") | ((role == "neutral") & postal & city)).__and__(~ambiguous).alias("strong"),
    )


def fuse(rule: Column, rule_confidence: Column, hard: Column, conflict: Column, top: Column, p: Column, gap: Column, support: Column) -> Column:
    """Category, confidence, whether the third stage is needed, and who decided."""
    t = STAGES
    cold = top.isNull()
    only_model = p * (1 - t["gap_factor"] * (1 - gap))
    cold_c = F.when(~hard & support & (rule == "05"), F.least(F.lit(1.0), rule_confidence + t["support"])).otherwise(rule_confidence)
    agree = F.least(F.lit(1.0), F.greatest(rule_confidence, p) + t["bonus"])
    differ = F.greatest(rule_confidence, p) - t["malus"]
    by_rule = rule_confidence >= p
    cases = [
        (conflict, None, F.lit(0.0), F.lit(True), "none"),
        (rule.isNull() & cold, None, F.lit(0.0), F.lit(True), "none"),
        (rule.isNull(), top, only_model, only_model < t["call"], "stage2"),
        (cold, rule, cold_c, cold_c < t["call"], "stage1"),
        (hard & (top == rule), rule, F.lit(1.0), F.lit(False), "stage1"),
        (hard & (p > t["conflict_p"]), rule, F.lit(t["call"] - 0.01), F.lit(True), "stage1"),
        (hard, rule, rule_confidence, F.lit(False), "stage1"),
        (top == rule, rule, agree, agree < t["call"], "stage1"),
    ]
    category, confidence, third, by = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(0.0)), F.when(F.lit(False), F.lit(True)), F.when(F.lit(False), F.lit(""))
    for when, c, x, need, who in cases:
        category, confidence, third, by = category.when(when, F.lit(None) if c is None else c), confidence.when(when, x), third.when(when, need), by.when(when, who)
    return F.struct(
        category.otherwise(F.when(by_rule, rule).otherwise(top)).alias("category"),
        F.round(confidence.otherwise(F.greatest(differ, F.lit(0.0))), 4).alias("confidence"),
        third.otherwise(differ < t["call"]).alias("third_stage"),
        by.otherwise(F.when(by_rule, "stage1").otherwise("stage2")).alias("decided_by"),
    )


def fuse_third(category: Column, confidence: Column, third: Column, third_confidence: Column, override: float = 0.85) -> Column:
    """Fusion with a third stage that may override."""
    same = category == third
    win = third_confidence >= override
    return F.struct(
        F.when(third.isNull(), category).when(category.isNull() | same, F.coalesce(category, third)).when(win, third).otherwise(category).alias("category"),
        F.round(F.when(third.isNull(), confidence).when(category.isNull(), third_confidence).when(same, F.least(F.lit(1.0), F.greatest(confidence, third_confidence) + 0.05)).when(win, third_confidence).otherwise(F.greatest(F.lit(0.0), confidence - 0.15)), 4).alias("confidence"),
        F.coalesce(~same & win, F.lit(False)).alias("overridden"),
    )


def verdict(score: Column, second: Column, contradicted: Column, auto: float = 0.85, gap: float = 0.25, least: float = 0.30) -> Column:
    """What to do with the best candidate."""
    return F.when(score.isNull() | (score <= 0) | (score < least), "none").when(score < auto, "review").when(second.isNotNull() & (score - second < gap), "review").when(contradicted, "review").otherwise("auto")


def band(confidence: Column, high: float = 0.85, medium: float = 0.6) -> Column:
    """Y37."""
    return F.when(confidence >= high, "high").when(confidence >= medium, "medium").otherwise("low")
