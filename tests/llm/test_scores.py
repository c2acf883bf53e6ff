"""Quality, toxicity, language and language-model scores."""

from __future__ import annotations

import math
import os
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import backoff, language, quality, queries, toxicity
from foliospark.llm.common import table
from tests.oracle import same

SMALL = "/root/testdata/sf0.01"


def accuracy(spark, scored, label):
    return scored.where("held_out").join(table(spark, SMALL, "labels"), "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


def test_quality_on_held_out_rows(spark):
    scored = queries.op1_quality_classifier(spark, SMALL).cache()
    assert scored.count() == table(spark, SMALL, "documents").count()
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    assert accuracy(spark, scored, "quality") > 0.9


def test_quality_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "text"), (4, "long " * 50_000), (5, "text"), (5, "text")])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        got = quality.score(docs, quality.fit(docs, l)).collect()
        assert len(got) == 6 and all(0 <= r["quality_score"] <= 1 for r in got)
    model = quality.train([(k, ("good words here " if k % 2 else "BAD!! BAD!! ") * 40 + str(k), k % 2) for k in range(200)])
    scores = {r["doc_id"]: r["quality_score"] for r in quality.score(docs_of([(1, "good words here " * 30), (2, "BAD!! BAD!! " * 30), (3, "")]), model).collect()}
    assert scores[1] > 0.9 > 0.1 > scores[2]
    assert quality.score(docs.limit(0), model).count() == 0


def test_toxicity_on_held_out_rows(spark):
    scored = queries.op3_toxicity(spark, SMALL).cache()
    assert scored.count() == table(spark, SMALL, "documents").count()
    assert accuracy(spark, scored, "toxic") > 0.9


def test_toxicity_gradients():
    """Backward against finite differences."""
    import numpy as np

    net = toxicity.train([(k, " ".join(random.Random(k).choices(["a", "bad", "c", "d"], k=12)), k % 2) for k in range(24)], 0.5, epochs=1)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 3, 6 * toxicity.HIDDEN)).astype(np.float32)
    mask = np.arange(5)[:, None] < np.array([5, 3, 4])
    keep: dict = {}
    net.forward(x, mask, keep)
    grads = {k: np.zeros_like(v) for k, v in net.p.items()}
    dx = net.backward(np.ones(3, np.float32), keep, grads)
    for name, at in (("uf", (1, 5)), ("wa", (2, 1)), ("wo", (3,))):
        old = net.p[name][at].copy()
        ends = []
        for step in (1e-2, -1e-2):
            net.p[name][at] = old + step
            ends.append(net.forward(x, mask).sum())
        net.p[name][at] = old
        assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-2, abs=2e-2)
    for at in ((0, 0, 1), (2, 1, 30), (4, 0, 20)):
        ends = []
        for step in (1e-2, -1e-2):
            moved = x.copy()
            moved[at] += step
            ends.append(net.forward(moved, mask).sum())
        assert dx[at] == pytest.approx((ends[0] - ends[1]) / 2e-2, abs=2e-2)
    assert abs(dx[4, 1]).max() == 0  # behind the end of that window


def test_toxicity_windows_and_odd_rows(spark, docs_of):
    assert toxicity.spans(0) == [] and toxicity.spans(10) == [0]
    for n in (33, 48, 100, 1000):
        own = toxicity.spans(n)
        assert own[-1] == n - toxicity.WINDOW and all(b - a <= toxicity.STRIDE for a, b in zip(own, own[1:], strict=False))
    docs = docs_of([(1, None), (2, ""), (None, "text"), (4, "long " * 30_000), (5, "text"), (5, "text")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r["toxicity"] <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_stupid_backoff_equals_sql(spark):
    same(spark, queries.op8_stupid_backoff, queries.ORACLE_SQL["op8_stupid_backoff"], SMALL)


def test_stupid_backoff_small(docs_of):
    rows = [(1, "a b c a b c"), (2, "a b d"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "A  b\nc")]
    got = backoff.score(docs_of(rows)).collect()
    assert len(got) == len(rows)
    texts = [(t or "").lower().split() for _, t in rows]
    counts = Counter(tuple(w[i : i + n]) for w in texts for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(map(len, texts))

    def one(context, word):
        if not context:
            return counts[word,] / total
        g = (*context, word)
        return counts[g] / counts[context] if counts[g] >= 2 else 0.4 * one(context[1:], word)

    want = sorted(round(sum(math.log(one(tuple(w[max(0, i - 2) : i]), w[i])) for i in range(len(w))), 9) for w in texts)
    assert sorted(round(r["log_score"], 9) for r in got) == want
    assert backoff.score(docs_of(rows).limit(0)).count() == 0


def expected_scores(texts, min_count=2):
    """(log score, number of full matches) of each text, by the definition."""
    texts = [(t or "").lower().split() for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in texts for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(map(len, texts))

    def one(context, word):
        if not context:
            return counts[word,] / total, 1
        g = (*context, word)
        return (counts[g] / counts[context], 1) if counts[g] >= min_count else (0.4 * one(context[1:], word)[0], 0)

    scored = [[one(tuple(w[max(0, i - 2) : i]), w[i]) for i in range(len(w))] for w in texts]
    return [(round(sum(math.log(x) for x, _ in s), 8), sum(f for _, f in s)) for s in scored]


def scored(docs, **options):
    return sorted((str(r["doc_id"]), round(r["log_score"], 8), r["n_full"], r["n_tokens"] - r["n_full"] == r["n_backed_off"]) for r in backoff.score(docs, **options).collect())


@pytest.mark.parametrize("options", [{"share": 1, "slices": 2}, {"share": 20, "slices": 3}, {"share": 100_000, "slices": 1}, {"share": 8, "sample": 50}, {"min_count": 1, "share": 20}, {"min_count": 3, "share": 20}])
def test_stupid_backoff_equals_brute_force(docs_of, options):
    """With few, some and all n-grams taken for frequent."""
    rng = random.Random(7)
    vocabulary = ["the"] * 30 + ["of", "a", "b"] * 5 + [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(30)))) for k in range(60)]
    rows += [(100, "the of the of"), (100, "the of the of"), (101, rows[3][1]), (None, "alone"), (None, None), (102, ""), (103, "long text " * 20_000)]
    want = expected_scores([t for _, t in rows], options.get("min_count", 2))
    assert scored(docs_of(rows), **options) == sorted((str(i), s, f, True) for (i, _), (s, f) in zip(rows, want, strict=True))


def test_stupid_backoff_keeps_repeated_rows(spark):
    """The same rows in several partitions, doubled, moved and filtered inputs."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    doubled = docs.unionByName(docs)
    rows = docs.collect()
    for some in (doubled, doubled.repartition(7), doubled.where("doc_id % 2 = 0").coalesce(1)):
        kept = sorted(r["doc_id"] for r in some.collect())
        texts = {r["doc_id"]: r["text"] for r in rows}
        want = expected_scores([texts[i] for i in kept])
        got = scored(some)
        assert [g[0] for g in got] == sorted(map(str, kept))
        assert [(g[0], round(g[1], 5), g[2]) for g in got] == sorted((str(i), round(s, 5), f) for i, (s, f) in zip(kept, want, strict=True))


def test_stupid_backoff_asks_in_one_pass(spark, docs_of):
    """Before, a slice read the words three times, dealt three kinds of rows and counted them in four windows with two sorts."""
    words = backoff.hashed_words(docs_of([(1, "a b c a b c"), (2, "a b d")])).select("row", "words")
    known = backoff.frequent(words, 9, 9, 4)
    plan = backoff.answered(words, known, 0, 1, 0.4, 2, 9)._jdf.queryExecution().sparkPlan().toString()
    assert (plan.count("MapInArrow"), plan.count("Window"), plan.count("parquet")) == (2, 0, 1)


def test_stupid_backoff_tasks_follow_the_places(monkeypatch, docs_of):
    """A slice's questions are dealt to as many tasks as its places need, and no key is parted."""
    monkeypatch.setattr(backoff, "PLACES", 50)
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{rng.randrange(300)}" for _ in range(40))) for k in range(100)]
    words = backoff.hashed_words(docs_of(rows)).select("row", "words")
    plan = backoff.answered(words, backoff.frequent(words, 4000, 4000, 8), 0, 2, 0.4, 2, 4000)._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 40)" in plan
    want = expected_scores([t for _, t in rows])
    assert scored(docs_of(rows), share=8, slices=2) == sorted((str(i), s, f, True) for (i, _), (s, f) in zip(rows, want, strict=True))


@pytest.mark.parametrize("most", [1, 4, 1 << 62])
def test_stupid_backoff_sums_lose_nothing(most):
    rng = np.random.default_rng(2)
    row, value, full = rng.integers(0, 9, 500), rng.integers(-9, 9, 500) / 8, rng.integers(0, 3, 500)
    got = backoff.summed(row, value, full, most).to_pandas()
    assert len(got) >= (9 if most > 500 else 500 / most)
    by_row = (got["whole"] / backoff.WHOLE).groupby(got["row"]).sum()
    assert [by_row[k] for k in range(9)] == [value[row == k].sum() for k in range(9)]
    assert got["full"].sum() == full.sum()
    assert backoff.summed(row[:0], value[:0], full[:0], most).num_rows == 0


def test_language(spark, docs_of):
    model = language.fit(table(spark, SMALL, "documents"))
    pages = [(1, "http://a.example.net/x", '<html lang="de"><p>der die und nicht eine</p></html>'), (2, None, None), (3, "odd", ""), (None, "http://u@h:8/", "<p>the and of that with</p>"), (3, "odd", "")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, lang string")
    got = language.identify(df, model).collect()
    assert len(got) == len(pages)
    assert {r["lang"] for r in got if r["page_id"] == 1} == {"de"}
    assert all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in got)
    assert {r["suffix"] for r in got if r["page_id"] is None} == {"h"}
    assert language.identify(df.limit(0), model).count() == 0
    none = language.fit(docs_of([]).limit(0))
    assert {r["lang"] for r in language.identify(df, none).collect()} == {None}


def test_language_on_all_pages(spark):
    found = queries.op6_language_fusion(spark, SMALL)
    path = table(spark, SMALL, "pages").select("page_id", F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("want"))
    good, n = found.join(path, "page_id").where("want <> ''").agg(F.avg((F.col("lang") == F.col("want")).cast("int")), F.count("*")).first()
    assert n > 100 and good > 0.97


def test_language_learns_every_language(spark):
    names = [f"x{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    model = language.fit(spark.createDataFrame([(k, f"words of {n}", n) for k, n in enumerate(names)], "doc_id long, text string, lang string"))
    assert model.languages == names


def test_visible_text_of_broken_pages():
    assert language.visible("<head><title>x</title></head><p>a&amp;b</p><!-- c --><script>d</script>e<f") .split() == ["a", "b", "e<f"]
    assert language.visible("<script>never closed <b>x</b>").split() == ["never", "closed", "x"]
    assert language.visible("<header>a</header><HEAD>b</HEAD >c").split() == ["a", "c"]
    many = "<script " * 60_000 + "<!--" * 60_000
    began = time.time()
    assert language.visible(many + ">end").endswith("end")
    assert time.time() - began < 5


def test_language_equals_brute_force(spark, docs_of):
    """The posterior by its definition, page by page."""
    import numpy as np

    rng = random.Random(9)
    model = language.fit(docs_of([(k, " ".join(rng.choices(w, k=30))) for k, w in enumerate([["der", "und", "nicht"], ["the", "and", "of"]])]).withColumn("lang", F.when(F.col("doc_id") == 0, "de").otherwise("en")))
    words = {"de": "der und nicht", "en": "the and of"}
    pages = []
    for k in range(40):
        lang = rng.choice(["de", "en"])
        host = rng.choice(["a.one.example", "b.one.example", "two.test", "c.d.two.test"])
        said = rng.choice([f'<html lang="{lang}">', "<html>", '<html lang="xx">'])
        pages.append((k, f"https://{host}/p{k}", f"{said}<p>{words[lang] if k % 5 else ''}</p>"))
    pages += [(50, None, None), (50, None, None), (None, "odd", "<p>the</p>")]
    got = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()

    size = len(model.languages)
    logs = [np.array(model.log_likelihoods(language.visible(h or ""))) for _, _, h in pages]
    soft = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in logs]
    hosts = ["" if not u or "://" not in u else u.split("/")[2] for _, u, _ in pages]
    keys = {"host": hosts, "domain": [".".join(h.split(".")[-2:]) for h in hosts], "suffix": [h.split(".")[-1] for h in hosts]}
    keys["declared"] = ["none" if not h or "lang=" not in h else "other" if "xx" in h else h.split('"')[1] for _, _, h in pages]
    world = sum(soft)
    want = []
    for k in range(len(pages)):
        own = lambda kind: np.maximum(sum(soft[j] for j in range(len(pages)) if keys[kind][j] == keys[kind][k]) - soft[k], 0)  # noqa: B023, E731
        base = (np.maximum(world - soft[k], 0) + language.ALPHA) / (max(world.sum() - 1, 0) + language.ALPHA * size)
        domain = (own("domain") + language.KAPPA * base) / (own("domain").sum() + language.KAPPA)
        prior = (own("host") + language.KAPPA * domain) / (own("host").sum() + language.KAPPA)
        total = np.log(prior) + logs[k]
        for kind, values in (("declared", size + 2), ("suffix", 64)):
            total = total + np.log((own(kind) + language.ALPHA) / (world + language.ALPHA * values))
        p = np.exp(total - total.max())
        want.append((str(pages[k][0]), *np.round(p / p.sum(), 9).tolist()))
    assert sorted((str(r["page_id"]), *(round(x, 9) for x in r["posterior"])) for r in got) == sorted(want)


def test_quality_equals_plain_compression(spark, docs_of):
    """Scores against sizes from plain compression with the two dictionaries, on every document."""
    import zstandard

    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = quality.fit(docs, labels)
    size = lambda raw, d: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw))
    for r in quality.score(docs.where("doc_id % 37 = 0"), model).collect():
        raw = (r["text"] or "").encode()
        blocks = [raw[k : k + quality.BLOCK_BYTES] for k in range(0, len(raw), quality.BLOCK_BYTES)]
        d = sum(size(b, model.bad) - size(b, model.good) for b in blocks) / len(raw) if raw else 0.0
        assert r["quality_score"] == pytest.approx(1 / (1 + math.exp(-(model.slope * d + model.intercept))), abs=1e-9)


def test_toxicity_equals_single_windows(spark, docs_of):
    """A document's score is that of its worst window, each scored alone."""
    import numpy as np

    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(docs.where("doc_id % 97 = 0"), model).collect():
        words = (r["text"] or "").lower().split()
        if not words:
            continue
        alone = [model.document_logits([" ".join(words[s : s + toxicity.WINDOW])])[0] for s in toxicity.spans(len(words))]
        assert r["toxicity"] == pytest.approx(float(model.probabilities(np.array([max(alone)]))[0]), abs=1e-4)


def test_toxicity_network_learns_without_log_odds(spark):
    """The network alone, all embeddings started at random, on rows that it never saw."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    from foliospark.llm.common import fold, labelled_sample

    rows = labelled_sample(docs, labels, "toxic", fold("doc_id", 3) != 1, 1_500, 23)
    model = toxicity.train(rows, 0.1, informed=False)
    scored = toxicity.score(docs.join(labels, "doc_id").where(fold("doc_id", 3) == 1).select("doc_id", "text", F.col("toxic").alias("truth")), model)
    hits, n = scored.agg(F.avg((F.col("toxic") == (F.col("truth") == 1)).cast("int")), F.count("*")).first()
    assert n > 300 and hits > 0.9


@pytest.mark.parametrize("informed", [True, False])
def test_toxicity_ranks_and_finds_held_out_rows(spark, informed):
    """By the area under the curve, and by precision and recall at the threshold, on rows that training never saw; most rows are clean."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    from foliospark.llm.common import fold, labelled_sample

    rows = labelled_sample(docs, labels, "toxic", fold("doc_id", 3) != 1, toxicity.PER_CLASS, 23)
    model = toxicity.train(rows, sum(r[2] for r in rows) / len(rows), informed=informed)
    held = docs.join(labels, "doc_id").where((fold("doc_id", 3) == 1) & F.col("toxic").isin(0, 1)).select("doc_id", "text", F.col("toxic").alias("truth"))
    got = toxicity.score(held, model).select("toxicity", "toxic", "truth").collect()
    bad, clean = ([r["toxicity"] for r in got if r["truth"] == y] for y in (1, 0))
    area = sum((b > c) + 0.5 * (b == c) for b in bad for c in clean) / len(bad) / len(clean)
    found, right = sum(r["toxic"] and r["truth"] == 1 for r in got), sum(r["toxic"] for r in got)
    assert len(bad) > 100 and area > (0.92 if informed else 0.85)
    if informed:
        assert found / len(bad) > 0.65 and found / right > 0.8


def test_repeated_ids_and_clashing_columns(spark, docs_of):
    """Labelled rows with one id, and input columns named like the results."""
    docs = docs_of([(1, f"text {k}") for k in range(50)] + [(2, "other"), (None, "none")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")
    from foliospark.llm.common import labelled_sample

    rows = labelled_sample(docs, labels, "quality", F.lit(True), 10, 1)
    assert [(i, t, y) for i, t, y in rows] == [(1, "text 0", 0), (1, "text 0", 1), (2, "other", 0)]
    named = docs.withColumns({"quality_score": F.lit("own"), "quality_ok": F.lit("own"), "toxicity": F.lit("own"), "__x": F.lit("own")})
    model = quality.fit(named, labels)
    got = quality.score(named, model)
    assert got.columns.count("quality_score") == 1 and all(0 <= r["quality_score"] <= 1 for r in got.collect())
    kept = quality.keep_good(named, model, 0.0)
    assert kept.columns == named.columns and {r["quality_score"] for r in kept.collect()} == {"own"} and kept.count() == 52
    assert toxicity.score(named, toxicity.fit(named, labels)).columns.count("toxicity") == 1


def test_toxicity_training_keeps_numbers_not_sets():
    """The driver's memory: what training adds for 1.2 million words of 2,000 rows, in a process of its own."""
    import subprocess
    import sys

    program = """
import random, resource
from foliospark.llm import toxicity
r = random.Random(5)
words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(20_000)]
rows = [(k, " ".join(r.choices(words, k=600)), k % 2) for k in range(2_000)]
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
before = peak()
toxicity.train(rows, 0.5, epochs=1)
print((peak() - before) // 1024)
"""
    env = os.environ | {"OMP_NUM_THREADS": "1"}
    assert int(subprocess.run([sys.executable, "-c", program], env=env, check=True, capture_output=True, text=True).stdout) < 350
