"""Cases of the fourth round's findings."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.functions import similarity
from foliospark.llm import mixing
from foliospark.llm.common import table, written
from foliospark.operators import alike, fuzzy, places
from tests.test_fuzzy import plain_search

SMALL = "/root/testdata/sf0.001"


def test_pipeline_returns_the_mixed_order(spark):
    """The result names each document's place, and the places are those that mixing gave, whichever task read which file."""
    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, SMALL), name)
    want = {r["doc_id"]: r["mix_position"] for r in mixing.mix(docs).collect()}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"]: r["mix_position"] for r in got} == want and len(got) == len(want)
    assert sorted(want.values()) == list(range(len(want)))


def test_places_follow_the_numbers_of_files(spark, tmp_path):
    """Files of several sizes, more than one digit in their names, an empty table, and an input column of the new one's name."""
    for k, n in enumerate([3, 0, 50, 1, 7, 2, 9, 4, 5, 6, 8, 30]):
        spark.range(1000 * k, 1000 * k + n, 1, 1).selectExpr("id", "'own' AS mix_position", "'x' AS file").write.parquet(f"{tmp_path}/docs/n={k}")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = mixing.with_place(docs)
    assert out.columns == ["id", "file", "n", "mix_position"]
    rows = sorted((r["mix_position"], r["id"]) for r in out.collect())
    assert rows == list(enumerate(sorted(r["id"] for r in docs.collect()))) and {r["file"] for r in out.collect()} == {"x"}
    empty = mixing.with_place(spark.read.schema("id long").parquet(str(tmp_path / "docs" / "n=1"))).where(F.lit(True))
    assert empty.columns == ["id", "mix_position"] and empty.count() == 0


def near(rng: random.Random, n: int) -> list[str]:
    """Names of all lengths, near copies, companies with one ending, letters outside the basic plane, and names beyond 63 letters."""
    word = lambda a, b: "".join(rng.choice("abcdé 𝄞") for _ in range(rng.randint(a, b)))
    out = [word(0, 14) for _ in range(n)] + [f"{word(3, 9)} bau gmbh" for _ in range(2 * n)] + ["x" * 70, "abc" * 30, "aaaa" * 5, ""]
    return out + [x[:4] + rng.choice(("", "x", x[:1])) + x[5:] for x in out[::3]]


@pytest.mark.parametrize(("kind", "least"), [("ratio", 78.0), ("ratio", 67.0), ("partial", 80.0), ("partial", 68.0)])
def test_best_of_blocks_equal_all_pairs(kind, least):
    """Counting pairs of letters loses no similar pair, and names with many similar ones get their best or are named as cut."""
    rng = random.Random(int(least))
    left, right = near(rng, 40), near(rng, 50)
    how = {"ratio": similarity.ratio, "partial": similarity.partial_ratio}[kind]
    want = {(i, j): s for i, a in enumerate(left) for j, b in enumerate(right) if a and b and (s := how(a, b)) >= least - 1e-9}
    got = [(int(i), int(j), s) for x, y, z in alike.alike(*alike.both(left, right), kind, least) for i, j, s in zip(x, y, z, strict=True)]
    assert len(got) == len(want) and {(i, j): s for i, j, s in got} == want
    several = Counter()
    for above in (0.0, 6.0):
        for (i, j, score), cut in alike.best(left, right, kind, least, 3, above):
            several[above] += len(cut)
            for k in {*i.tolist(), *cut.tolist()}:
                level = least + above if k in cut else least
                own = sorted((-s, b) for (a, b), s in want.items() if a == k and s >= level - 1e-9)[:3]
                assert [(-s, b) for a, b, s in zip(i.tolist(), j.tolist(), score.tolist(), strict=True) if a == k] == own
    assert not several[0.0] and several[6.0]


@pytest.mark.parametrize("kind", ["ratio", "partial", "token_set"])
def test_pairs_in_arrays_equal_single_ones(kind):
    rng = random.Random(3)
    left, right = near(rng, 60), near(rng, 60)
    right[:40] = [x + " " + x[::-1] for x in left[:40]]
    how = {"ratio": similarity.ratio, "partial": similarity.partial_ratio, "token_set": similarity.token_set_ratio}[kind]
    assert alike.of_pairs(left, right, kind).tolist() == [how(a, b) for a, b in zip(left, right, strict=True)]
    assert alike.of_pairs([], [], kind).tolist() == []


def test_names_that_were_cut_are_compared_again(spark, monkeypatch):
    """Few near names above the first level: the rest is found in a second round, over several blocks."""
    monkeypatch.setattr(fuzzy, "RIGHT_BLOCK", 300)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    left, right = ([f"{word()} bau gmbh" for _ in range(n)] for n in (60, 900))
    dfs = [spark.createDataFrame(list(enumerate(x)), f"{k} long, {v} string") for x, k, v in ((left, "l", "a"), (right, "r", "b"))]
    rounds = []
    monkeypatch.setattr(fuzzy, "similar_pairs", lambda *a, real=fuzzy.similar_pairs: rounds.append(a[5]) or real(*a))
    got: dict = {}
    for r in fuzzy.similar_pairs(*dfs, "partial", 70.0, 2, (16.0,)).collect():
        got.setdefault(r["l"], []).append((-r["score"], r["r"]))
    assert rounds == [(16.0,), ()]
    assert {k: sorted(v)[:2] for k, v in got.items()} == {k: sorted((-s, j) for j, b in enumerate(right) if (s := similarity.partial_ratio(a, b)) >= 70)[:2] for k, a in enumerate(left)}


def test_search_order_decides_ties_over_blocks(spark, monkeypatch):
    """Equal texts are searched once; of more equal scores than fit, the order of names decides, in whichever block they lie."""
    monkeypatch.setattr(fuzzy, "RIGHT_BLOCK", 40)
    parties = [(900 - k, f"HAUS {k % 7}{k:03d} MEIER", f"x{k}", None) for k in range(200)]
    queries = [(k, "Meier") for k in range(3)] + [(7, "aus 3")]
    got = fuzzy.party_search(spark.createDataFrame(parties, "party_id long, search_name string, last_name string, company_name string"), spark.createDataFrame(queries, "query_id long, text string")).collect()
    assert {(r["query_id"], r["party_id"], r["place"], r["score"] and round(r["score"], 6)) for r in got} == plain_search(parties, queries)


def test_repeated_rows_are_not_broadcast(spark, monkeypatch):
    """Beyond the bound no table is broadcast with its rows repeated for each part, however small its files are."""
    monkeypatch.setattr(fuzzy, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(places, "BROADCAST_ROWS", 10)
    small = written(spark.range(200).selectExpr("id % 20 AS k", "id AS v"), "small")
    rows = spark.range(50).selectExpr("id % 20 AS k", "id AS w")
    out = fuzzy.beside(rows, small, ["k"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.join(small, "k").select("k", "w", "v").collect()))
    docs = spark.createDataFrame([(k, f"an den Birkenweg {k % 30 + 1}, 50667 Köln") for k in range(40)], "doc_id long, text string")
    entries = spark.createDataFrame([(k, "Birkenweg", str(k % 30 + 1), "50667", "Köln") for k in range(90)], "object_id long, street string, house_number string, postal_code string, city string")
    hits = places.address_hits(docs, entries)
    assert hits.count() == 40 * 3
    for df in (out, hits):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
