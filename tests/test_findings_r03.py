"""Cases of the third round's findings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import additive_search
from foliospark.functions import similarity
from foliospark.operators import alike, fuzzy, relational
from foliospark.plans import registry


def test_manual_findings_take_the_first_of_equal_numbers(spark, tmp_path):
    """Several decisions of a finding with the same number, over several files: the first one in the table counts, as in SQL."""
    rows = [(k % 40, 3 if k < 3000 else None, 17.0 + k % 7, "RAN"[(k // 40 + k) % 3], "OF"[k // 80 % 2]) for k in range(3100)]
    form = "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, form).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(41)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(con.execute(registry.ORACLE_SQL["y32_manual_findings"]).fetchall())
    got = sorted(tuple(r) for r in registry.QUERIES["y32_manual_findings"](spark, str(tmp_path)).collect())
    assert got == want


def test_sorted_digest_streams_groups(spark):
    """Ids sorted as strings, several groups in a task, repeated values, and rows without a key or value."""
    rows = [(k % 3, k) for k in range(500)] + [(1, 1), (None, 5), (2, None)]
    df = spark.createDataFrame(rows, "top int, node long").repartition(7)
    got = {r["top"]: (r["rows"], r["digest"]) for r in relational.sorted_digest(df, "top", "node").collect()}
    lists = {t: sorted(str(n) for k, n in rows if k == t and n is not None) for t in range(3)}
    assert got == {t: (len(v), hashlib.sha256("\n".join(v).encode()).hexdigest()) for t, v in lists.items()}


def test_repeated_nodes_keep_one_parent(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 1), (2, 1), (3, 2)], "n int, p int")
    assert sorted(tuple(r) for r in relational.top_of(df, "n", "p").collect()) == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 1)]


def test_vector_search_finds_neighbours_of_other_shapes(spark):
    """Many dimensions, directions that hardly differ, and large narrow groups: recall against brute force."""
    rng = np.random.default_rng(8)
    shapes = {
        "wide": rng.normal(size=(6000, 256)),
        "alike": rng.normal(size=(4000, 16)) + 3000,
        "groups": rng.normal(size=(3, 32))[rng.integers(0, 3, 4000)] + 1e-4 * rng.normal(size=(4000, 32)),
    }
    for name, x in shapes.items():
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        got: dict = {}
        for r in additive_search.search(df, F.col("vec_id") % 50 == 0, k=5, shortlist=60).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        hits = 0
        for q in range(0, len(x), 50):
            away = ((u - u[q]) ** 2).sum(axis=1)
            away[q] = np.inf
            hits += len(got[q] & set(np.argsort(away)[:5].tolist()))
        assert hits / (5 * len(range(0, len(x), 50))) >= 0.95, name


@pytest.mark.parametrize("kind", ["ratio", "partial"])
def test_blocks_of_names_equal_single_comparisons(kind):
    """Names of all lengths, beyond 63 letters too, with letters outside the basic plane and long common endings."""
    rng = random.Random(4)
    word = lambda a, b: "".join(rng.choice("abcdé 𝄞") for _ in range(rng.randint(a, b)))
    left = [word(0, 14) for _ in range(60)] + ["x" * 70, "abc" * 30, "a" * 12]
    right = [word(0, 20) for _ in range(100)] + ["x" * 69, "abc" * 29, ""] + [x[:3] + x[4:] for x in left] + [f"zz {x} gmbh" for x in left]
    how = {"ratio": similarity.ratio, "partial": similarity.partial_ratio}[kind]
    got = {(int(i), int(j)): s for x, y, z in alike.alike(*alike.both(left, right), kind, 78.0) for i, j, s in zip(x, y, z, strict=True)}
    assert got == {(i, j): how(a, b) for i, a in enumerate(left) for j, b in enumerate(right) if a and b and how(a, b) >= 78 - 1e-9}


def test_best_two_of_each_block(spark):
    """Equal scores, several words, and a name that is missing counts as empty, so it isn't the best."""
    left = spark.createDataFrame([(1, "nord bau", 0), (2, "haus", 0), (3, None, 0)], "l long, a string, n int")
    right = [(1, None), (9, "haus"), (5, "haus"), (7, "bau nord"), (8, "hau")]
    got = fuzzy.best_two(left, spark.createDataFrame([(k, b, 0) for k, b in right], "r long, b string, n int"), "n", 8.0, 100).collect()
    assert sorted((r["l"], r["r"], round(r["score"], 3)) for r in got) == sorted(
        (k, i, round(s, 3)) for k, a in ((1, "nord bau"), (2, "haus"), (3, "")) for s, i in sorted(((min(100.0, similarity.token_set_ratio(a, b or "") + 8), i) for i, b in right), key=lambda x: (-x[0], x[1]))[:2]
    )
