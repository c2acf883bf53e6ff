"""Exact and near duplicates against brute force, with the odd cases."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliospark.llm import exact_dedup, grouped, near_join

ODD = [(1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (None, "a"), (6, "b" * 70), (7, "b" * 71), (8, "b" * 64 + "c" * 6), (9, "   "), (10, "x " * 60_000)]


def test_exact_digest(docs_of):
    got = exact_dedup.digest(docs_of(ODD)).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r["text_sha256"]].append(r)
    want = defaultdict(list)
    for i, t in ODD:
        want[t or ""].append(i)
    assert sorted(len(g) for g in by.values()) == sorted(len(g) for g in want.values())
    for g in by.values():
        assert {r["group_size"] for r in g} == {len(g)}
        assert sum(r["kept"] for r in g) == 1
        ids = [r["doc_id"] for r in g if r["doc_id"] is not None]
        assert {r["keep_id"] for r in g} == {max(ids)}
        assert [r["doc_id"] for r in g if r["kept"]] == [max(ids)]


def test_exact_keep_one(docs_of):
    docs = docs_of(ODD)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["text"] or "" for r in kept.collect()) == Counter({t or "": 1 for _, t in ODD})
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0
    assert exact_dedup.digest(docs.limit(0)).count() == 0


def test_exact_null_ids(docs_of):
    got = exact_dedup.keep_one(docs_of([(None, "z"), (None, "z")])).collect()
    assert len(got) == 1


def jaccard_rows(rng: random.Random, families: int, size: int, words: int) -> list[tuple[int, str]]:
    rows, n = [], 0
    for _ in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            rows.append((n, " ".join(own)))
            n += 1
    return rows


def brute(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("limits", [{}, {"limit": 6, "block": 4}])
def test_near_join_equals_brute_force(docs_of, limits):
    rows = jaccard_rows(random.Random(3), 6, 12, 90) + [(900, "one two three"), (901, "One  two three"), (902, ""), (903, None), (904, "one two")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_join.join(docs_of(rows), **limits).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    missed = [i for i in want if got[i] != want[i]]
    assert not missed
    assert got[902] == (902, 0) and got[903] == (903, 0)
    assert got[901] == (900, 1)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_near_join_at_other_thresholds(docs_of, threshold):
    """Pairs of equal and of unequal sizes around the threshold: 0.99 of the links are found, and no other."""
    rng, rows = random.Random(int(100 * threshold)), []
    for k in range(150):
        words = [f"u{rng.randrange(10**7)}" for _ in range(rng.choice((12, 40, 120)))]
        other = words[: max(5, int(len(words) * rng.uniform(0.85, 1.15) * threshold))]
        if k % 3 == 0:  # of one size: some words changed
            other = list(words)
            for _ in range(max(1, int(len(words) * (1 - threshold) / 8))):
                other[rng.randrange(len(other))] = f"v{rng.randrange(10**7)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    want = brute(rows, threshold)
    got = {r["doc_id"]: r["n_links"] for r in near_join.join(docs_of(rows), threshold=threshold).collect()}
    assert all(got[i] <= n for i, (_, n) in want.items())
    assert sum(n for _, n in want.values()) >= 60
    assert sum(got.values()) >= 0.99 * sum(n for _, n in want.values())


def test_near_join_keeps_links_below_the_usual_threshold(docs_of):
    words = [f"w{k}" for k in range(100)]
    pair = lambda n: [(1, " ".join(words)), (2, " ".join(words[:n]))]
    for threshold, n in ((0.7, 75), (0.5, 60), (0.2, 30)):
        assert [r["n_links"] for r in near_join.join(docs_of(pair(n)), threshold=threshold).collect()] == [1, 1]


def test_sketch_plan():
    """The chance to share fewer values than asked for is a millionth at most."""
    for threshold in (0.1, 0.3, 0.5, 0.8, 0.9):
        size, need = near_join.sketch_plan(threshold)
        below = sum(math.comb(size, k) * threshold**k * (1 - threshold) ** (size - k) for k in range(need))
        assert size >= 32 and need >= 1 and below <= 1.01e-6


def test_near_keep_one(docs_of):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, None), (6, ""), (7, "other words that stand alone here")]
    docs = docs_of(rows)
    kept = near_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7]
    assert near_join.keep_one(docs.limit(0)).count() == 0
    assert near_join.join(docs.limit(0)).count() == 0


def test_runs_follow_the_recall():
    assert near_join.runs_needed(0.99, 2) > near_join.runs_needed(0.9, 2)
    assert near_join.runs_needed(0.99, 3) > near_join.runs_needed(0.99, 1)
    for depth in (1, 2):
        assert 1 - (1 - (1 - math.exp(-1)) ** depth) ** near_join.runs_needed(0.99, depth) >= 0.99


def test_near_join_finds_contained_texts(docs_of):
    """Texts that are nine tenths of another one: the sets differ in size."""
    rng = random.Random(8)
    rows = []
    for k in range(60):
        words = [f"u{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 245 + k % 50]))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_join.join(docs_of(rows)).collect()}
    want = brute(rows)
    missed = sum(got[i] != want[i] for i in want)
    assert missed <= 2


def test_near_join_odd_rows(docs_of):
    """Null ids, a very long text, blank texts and copies."""
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(None, "same five words are here"), (3, "same five words are here"), (4, long), (5, long + " end"), (6, "   "), (7, "   "), (None, None)]
    got = [tuple(r) for r in near_join.join(docs_of(rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, 3, 1, 2), (3, 3, 1, 2), (4, 4, 1, 2), (5, 4, 1, 2), (6, 6, 0, 1), (7, 7, 0, 1), (None, None, 0, 1)], key=str)
    kept = near_join.keep_one(docs_of(rows)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "4", "6", "7", "None"]


def test_near_join_recall_on_documents(spark):
    """Measured recall of links against all pairs of the given documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    texts: dict = {}
    for i, t in rows:
        texts.setdefault(" ".join((t or "").lower().split()), []).append(i)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    at = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            at[g].append(k)
    common = Counter((a, b) for ks in at.values() if len(ks) > 1 for x, a in enumerate(ks) for b in ks[x + 1 :])
    sizes = [len(i) for i in texts.values()]
    linked = [(a, b) for (a, b), n in common.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8]
    want = sum(2 * sizes[a] * sizes[b] for a, b in linked) + sum(n * (n - 1) for n, s in zip(sizes, sets, strict=True) if s)
    got = near_join.join(docs).agg(F.sum("n_links")).first()[0]
    assert linked and 0.99 * want <= got <= want


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (200, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in grouped.components(df).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    hub = [(0, k) for k in range(1, 3000)] + [(k, 5000 + k) for k in range(1, 50)]
    got = {r["node"]: r["root"] for r in grouped.components(spark.createDataFrame(hub, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 3049
