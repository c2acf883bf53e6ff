"""Every query with an oracle, on the smallest tables."""

from __future__ import annotations

import pytest

from foliospark.plans import registry
from tests.oracle import same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"e18_e22_classifier"}))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES


def test_classifier_sees_words_behind_1000_characters(spark, tmp_path):
    """The class words lie between the 1,500th and the 4,000th character; one document has no label."""
    rows = [(k, "word " * 300 + ("good " if k % 2 else "bad ") * 20, "src") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(39)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r["top"] for r in registry.QUERIES["e18_e22_classifier"](spark, str(tmp_path)).collect()}
    assert got == {k: str(k % 2) for k in range(40)}


def test_fuzzy_join_equals_brute_force(spark, tmp_path, monkeypatch):
    """All pairs of a nation count, whatever their ids end in, over several blocks."""
    from foliospark.functions.similarity import token_set_ratio
    from foliospark.plans import texts

    monkeypatch.setattr(texts, "FUZZY_BLOCK", 5, raising=False)
    words = ("nord", "haus", "bau", "stadt", "garten", "werk", "licht")
    name = lambda k: f"{words[k % 7]} {words[k * 3 % 5]} {k % 11}"
    suppliers, customers = [(k, name(k * 2), k % 3) for k in range(12)], [(100 + k, name(k), k % 3) for k in range(60)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    want = {}
    for k, a, n in suppliers:
        top = sorted((-min(100.0, token_set_ratio(a, b) + 8), i) for i, b, m in customers if m == n)
        score, second = -top[0][0] / 100, -top[1][0] / 100
        outcome = "none" if score < 0.3 else "review" if score < 0.85 or score - second < 0.25 else "auto"
        want[k] = (top[0][1], round(score * 100, 6), outcome)
    got = {r["s_suppkey"]: (r["c_custkey"], r["score"], r["outcome"]) for r in registry.QUERIES["j08_j09_j10_j11_fuzzy_join"](spark, str(tmp_path)).collect()}
    assert got == want
