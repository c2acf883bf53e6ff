"""Token stores, pieces, vectors, mixing and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import additive_search, exact_dedup, mixing, near_join, packed_tokens, quality, queries, sentencepieces, words
from foliospark.llm.common import table
from foliospark.llm.words import WordHasher

SMALL = "/root/testdata/sf0.001"
ODD = ["", "  ", "a\x1cb c!\x1f!d", "x<|endoftext|>y <|startoftext|> ΑΣ ΣΣ", "it's don't I'LL 'SS", "é é ́a İ ½ ² 12a3 ١٢", "naïve—dash…‹›", "▁ mark ▁▁", "tab\tand\r\nlines\n\n", "漢字 かな 🙂", "word " * 40_000]


@pytest.fixture(scope="module")
def piece_model():
    return sentencepieces.pieces(queries.PIECE_MODEL)


@pytest.fixture(scope="module")
def chunk_encoder():
    return packed_tokens.ChunkEncoder(queries.WORD_BPE)


def library(encoder, text):
    return np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=30), max_size=5))
def test_chunks_encode_like_whole_texts(chunk_encoder, texts):
    assert chunk_encoder.encode(texts) == [library(chunk_encoder, t) for t in texts]


def test_odd_texts_encode_like_the_library(chunk_encoder):
    assert chunk_encoder.encode(ODD) == [library(chunk_encoder, t) for t in ODD]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_store(spark, docs_of, chunk_encoder, tmp_path, encoding):
    rows = [(k * 3 % 11, t) for k, t in enumerate(ODD)] + [(50, None), (50, None), (None, "null id")]
    path = packed_tokens.write_store(docs_of(rows), queries.WORD_BPE, str(tmp_path / "store"), encoding=encoding)
    got = packed_tokens.catalogue(spark, path).orderBy("start").collect()
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = library(chunk_encoder, t or "") + np.array([1], "<u4").tobytes()
        want.append((i, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    assert [tuple(r) for r in got] == want
    assert [r["doc_id"] for r in packed_tokens.read_range(spark, path, 2, 5).collect()] and {r["doc_id"] for r in packed_tokens.read_range(spark, path, 2, 5).collect()} <= {2, 3, 4, 5}
    files = [p for p in (tmp_path / "store").glob("*.parquet") if pq.read_metadata(p).num_rows]
    column = next(c for c in (pq.read_metadata(files[0]).row_group(0).column(k) for k in range(5)) if c.path_in_schema.startswith("ids"))
    assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")
    assert packed_tokens.catalogue(spark, packed_tokens.write_store(docs_of([(1, "a")]).limit(0), queries.WORD_BPE, str(tmp_path / "none"))).count() == 0


def test_store_order_of_equal_ids(spark, docs_of, tmp_path):
    """``start`` counts the ids that lie before a row in the files, for equal ids with different texts too."""
    rows = [(7, f"text number {k} {'x ' * k}") for k in range(30)] + [(None, f"null {k}") for k in range(5)] + [(3, "a"), (9, "b")]
    path = packed_tokens.write_store(docs_of(rows).repartition(4), queries.WORD_BPE, str(tmp_path / "store"))
    at, want = 0, set()
    for r in sorted(packed_tokens.read_store(spark, path).collect(), key=lambda r: (r["part"], r["place"])):
        raw = np.array(r["ids"], "<u4").tobytes()
        want.add((r["doc_id"], at, r["n_tokens"], zlib.crc32(raw)))
        at += r["n_tokens"]
    assert {tuple(r) for r in packed_tokens.catalogue(spark, path).collect()} == want
    assert len(want) == len(rows)


def brute_best(model, word):
    """Best score over all segmentations, by plain dynamic programming over every piece."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(end):
            if (p := model.normal.get(word[begin:end])) is not None:
                best[end] = max(best[end], (best[begin][0] + p[1], best[begin][1] - 1))
        if best[end][0] == -math.inf:
            best[end] = (best[end - 1][0] + sentencepieces.BYTE_SCORE, best[end - 1][1] - 1)
    return best[-1][0]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="▁abcdethingo.é漢", min_size=1, max_size=25))
def test_best_path_equals_brute_force(piece_model, word):
    ids = piece_model.best(word)
    scores = {i: s for i, s in piece_model.normal.values()}
    total, run = 0.0, b""
    for i in ids:
        if i in scores:
            total += scores[i]
        else:
            run += piece_model.surface[i]
    total += sentencepieces.BYTE_SCORE * len(run.decode())
    assert total == pytest.approx(brute_best(piece_model, word))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_pieces_round_trip(piece_model, text):
    assert piece_model.decode(np.frombuffer(piece_model.encode(text), "<i4").tolist()) == text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ▁\nthe.", max_size=40))
def test_words_alone_are_as_good_as_the_whole(piece_model, text):
    """The split at words' borders loses nothing against one path over the whole line."""
    if "▁" in text or "\n" in text:
        return
    whole = piece_model.best(text.replace(" ", "▁")) if text else []
    assert np.frombuffer(piece_model.encode(text), "<i4").tolist() == whole


def test_encode_frame(spark, docs_of):
    docs = docs_of([(k, t) for k, t in enumerate(ODD)] + [(90, None), (90, None)])
    out = sentencepieces.encode(docs, queries.PIECE_MODEL)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.withColumn("back", sentencepieces.decode("piece_ids", queries.PIECE_MODEL)).collect()
    assert all(r["back"] == (r["text"] or "") and r["round_trip"] for r in rows) and len(rows) == len(ODD) + 2
    assert sentencepieces.encode(docs.limit(0), queries.PIECE_MODEL).count() == 0


def brute_nearest(rows, k):
    sound = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = {}
    for i, v in sound:
        if i % 50 == 0:
            c = sorted(((-float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w in sound if j != i))[:k]
            out[i] = [(j, -s) for s, j in c]
    return out


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    same = rows[0][1]
    rows += [(1000 + i, same) for i in range(40)] + [(2000, None), (2050, [0.0] * 8), (2100, [math.nan] * 8), (2150, [1.0, None] * 4), (2200, [1.0] * 5), (None, same), (2250, [math.inf] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label string")
    got: dict = {}
    for r in additive_search.search(df, F.col("vec_id") % 50 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(rows, 5)
    assert got.keys() == want.keys()
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert [j for j, _ in got[0]] == [1000, 1001, 1002, 1003, 1004]
    assert [j for j, _ in got[1000]] == [0, 1001, 1002, 1003, 1004]
    few = df.where("vec_id in (0, 1, 2)")
    assert additive_search.search(few, F.col("vec_id") % 50 == 0, k=5).count() == 2
    assert additive_search.search(df.limit(0), F.lit(True), k=5).count() == 0


def test_vector_search_far_ends_of_the_range(spark):
    """Components near the ends of a double's range, equal directions of different length, and an id with two vectors."""
    rng = np.random.default_rng(5)
    sizes = [1.0, 1e-200, 1e200, 1e-308, 1e300]
    rows = [(i, [float(x) for x in rng.normal(size=8) * sizes[i % 5]]) for i in range(60)]
    rows += [(60, [2 * x for x in rows[0][1]]), (61, [1e200, 1e-200] * 4), (62, [5e-324] + [0.0] * 7), (7, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in additive_search.search(df, F.col("vec_id") % 50 == 0, k=5, shortlist=60).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = [(i, np.array(v) / np.abs(v).max()) for i, v in rows]
    cosine = lambda v, w: float(v @ w / np.linalg.norm(v) / np.linalg.norm(w))
    for q in (0, 50):
        best: dict = {}
        for i, w in whole:
            if i != q:
                best[i] = max(best.get(i, -2.0), *(cosine(v, w) for j, v in whole if j == q))
        want = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:5]
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=1e-12)


def test_vector_search_recall(spark):
    """Recall of the codes: a shortlist of one in a hundred vectors against all of them."""
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in df.select("vec_id", "embedding").collect()]
    got: dict = {}
    for r in additive_search.search(df, F.col("vec_id") % 50 == 0, k=5, shortlist=len(rows) // 100).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    ids = np.array([i for i, _ in rows])
    units = np.stack([v / np.linalg.norm(v) for _, v in rows])
    hits = n = 0
    for k in np.flatnonzero(ids % 50 == 0):
        order = [j for j in np.lexsort((ids, -(units @ units[k]))) if j != k][:5]
        hits += len(got[int(ids[k])] & {int(ids[j]) for j in order})
        n += 5
    assert hits / n >= 0.9


def test_beam_search_is_no_worse_than_greedy():
    x = additive_search.unit(np.random.default_rng(2).normal(size=(500, 16)))
    model = additive_search.train(x, books=6, entries=16)
    error = lambda beam: ((x - model.decode(model.encode(x, beam)[0])) ** 2).sum()
    assert error(8) <= error(1)
    codes, norms = model.encode(x)
    exact = x[:5] @ model.decode(codes).T / norms
    assert np.allclose(model.scores(x[:5], codes, norms), exact, atol=1e-4)


def test_mix_equals_a_slot_by_slot_schedule(spark, docs_of):
    """Positions against a schedule made slot by slot from the definition."""
    from fractions import Fraction

    rng = random.Random(6)
    rows = [(k, "t", rng.choice(["a", "a", "a", "b", "c"])) for k in range(700)]
    weights, cycle, block = {"a": 0.5, "b": 0.25}, 16, 4
    out = mixing.mix(docs_of(rows), weights, block_rows=block, cycle=cycle).collect()
    sizes = Counter(s if s in weights else "*" for _, _, s in rows)
    left, done, order = {s: -(-n // block) for s, n in sizes.items()}, Counter(), []
    while any(left.values()):
        own = mixing.shares({s: w for s, w in mixing.targets(weights).items() if left.get(s)}, cycle)
        whole = min(left[s] // own[s] for s in own)
        for times, slots in ((whole, own), (1, None)):
            slots = slots or {s: min(left[s], own[s]) for s in own if left[s]}
            total = sum(slots.values())
            for _ in range(times if slots else 0):
                given: Counter = Counter()
                for t in range(total):  # of all sources whose next block is released, the earliest deadline
                    ready = [(math.ceil(Fraction((given[s] + 1) * total, n)), s) for s, n in slots.items() if given[s] < n and math.floor(Fraction(given[s] * total, n)) <= t]
                    s = min(ready)[1]
                    order.append((s, done[s]))
                    given[s] += 1
                    done[s] += 1
                    left[s] -= 1
    assert {(r["mix_source"], r["mix_block"], r["mix_slot"]) for r in out} == {(s, k, slot) for slot, (s, k) in enumerate(order)}


def test_clashing_columns(spark, docs_of):
    docs = docs_of([(k, "a b", "src0") for k in range(9)]).withColumns({c: F.lit("own") for c in ("mix_slot", "mix_block", "piece_ids", "n_pieces", "__source", "__rep")})
    out = mixing.mix(docs)
    assert sorted(out.columns) == sorted({*docs.columns, *mixing.ADDED}) and sorted(r["mix_position"] for r in out.collect()) == list(range(9))
    assert mixing.mix(docs.limit(0)).columns == out.columns
    for kept in (mixing.mixed(docs), near_join.keep_one(docs), exact_dedup.keep_one(docs)):
        assert kept.columns == docs.columns and {r["mix_slot"] for r in kept.collect()} == {"own"}
    coded = sentencepieces.encode(docs, queries.PIECE_MODEL)
    assert coded.columns.count("piece_ids") == 1 and all(r["n_pieces"] for r in coded.collect())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 400), min_size=1))
def test_pattern_deviates_by_less_than_one_block(slots):
    total = sum(slots.values())
    seen = Counter()
    for t, s in enumerate(mixing.pattern(slots), 1):
        seen[s] += 1
        for k, n in slots.items():
            assert abs(seen[k] - n * t / total) < 1
    assert seen == Counter(slots)


def test_phases_place_every_block_once():
    blocks = {"a": 1000, "b": 37, "c": 5, "*": 400}
    weights = mixing.targets({"a": 0.2, "b": 0.3, "c": 0.1})
    plan = mixing.phases(blocks, weights, 64)
    assert Counter({s: sum(p["slots"].get(s, 0) * p["cycles"] for p in plan) for s in blocks}) == Counter(blocks)
    at = 0
    for p in plan:
        assert p["start"] == at
        at += sum(p["slots"].values()) * p["cycles"]


def test_mix(spark, docs_of):
    rng = random.Random(4)
    rows = [(k, "t", rng.choice(["src0", "src0", "src1", "src2", "z", None])) for k in range(2800)] + [(5, "t", "src1"), (None, "t", "src0")]
    docs = docs_of(rows)
    out = mixing.mix(docs, {"src0": 0.25, "src1": 0.5, "nobody": 0.05}, block_rows=4, cycle=64).collect()
    assert sorted(r["mix_position"] for r in out) == list(range(len(rows)))
    by_slot: dict = {}
    for r in out:
        by_slot.setdefault(r["mix_slot"], set()).add((r["mix_source"], r["mix_block"]))
    assert all(len(v) == 1 for v in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
    order = [next(iter(by_slot[k]))[0] for k in range(100)]
    share = {"src0": 0.25 / 0.95, "src1": 0.5 / 0.95, "*": 0.2 / 0.95}
    for t in range(1, 101):
        for s, w in share.items():
            assert abs(order[:t].count(s) - w * t) < 2.5  # one block, and the rounding of the weights to the cycle
    mixed = mixing.mixed(docs, {"src0": 0.25, "src1": 0.5}, cycle=64)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0.9, "b": 0.2})


def test_pipeline_equals_brute_force(spark):
    docs = [r.asDict() for r in table(spark, SMALL, "documents").collect()]
    model = quality.fit(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    good = model.scorer()
    docs = [d for d in docs if good(d["text"] or "") >= quality.THRESHOLD]
    best: dict = {}
    for d in docs:
        best[d["text"]] = max(best.get(d["text"], -1), d["doc_id"])
    docs = [d for d in docs if best[d["text"]] == d["doc_id"]]
    from tests.llm.test_dedup import brute

    classes = brute([(d["doc_id"], d["text"]) for d in docs])
    want = {d["doc_id"]: d for d in docs if classes[d["doc_id"]][0] == d["doc_id"]}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    pieces = sentencepieces.pieces(queries.PIECE_MODEL)
    assert all(pieces.decode(r["piece_ids"]) == want[r["doc_id"]]["text"] for r in got)


def test_stages_keep_the_columns(spark):
    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name


def test_shared_words_are_hashed_alike():
    from foliospark.llm.words import WordHasher

    one, many = WordHasher(), WordHasher()
    texts = ["a b c", "", "Über  alles\nc", "c " * 1000, "b"]
    alone = [one([t])[0].tolist() for t in texts]
    words, starts = many(texts)
    assert [words[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == alone
    assert near_join.shingle_sets(["x y"], one)[0].shape == (1,)


def test_columns_of_any_name_stay(docs_of):
    """Input columns that are named like the operators' own come back as they went in."""
    names = ("__enc", "encoded", "c0", "__phase", "__source", "__rank", "__k", "__j", "__slice", "s")
    docs = docs_of([(k, f"some text {k}") for k in range(20)]).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for out, new in ((mixing.mix(docs), mixing.ADDED), (sentencepieces.encode(docs, queries.PIECE_MODEL), ["piece_ids", "n_pieces", "round_trip"])):
        assert out.columns == [*docs.columns, *new]
        rows = out.collect()
        assert len(rows) == 20 and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    assert sorted(r["mix_position"] for r in mixing.mix(docs).collect()) == list(range(20))


def test_words_are_hashed_in_bounded_memory():
    """Beside the words themselves, hashing takes a few bytes a byte of text; it took some 45."""
    import tracemalloc

    text = "lorem ipsum dolor " * 200_000
    tracemalloc.start()
    hashes, starts = WordHasher()([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hashes) == starts[-1] == 600_000 and len(np.unique(hashes)) == 3
    assert peak < 25 * len(text)


def test_long_words_are_hashed_like_short_ones(monkeypatch):
    """A word beyond a block is summed in pieces, which gives the same hash as one block."""
    texts = ["ab " + "xyz" * 50 + " é" + "ü" * 70, "c", " ".join(["ab", "xyz" * 50, "é" + "ü" * 70])]
    whole = WordHasher()(texts)[0]
    monkeypatch.setattr(words, "BLOCK", 64)
    assert (WordHasher()(texts)[0] == whole).all()


def test_remembered_words_are_bounded(piece_model):
    """A small memory of words changes no ids."""
    small = sentencepieces.Pieces(queries.PIECE_MODEL, 10)
    text = " ".join(f"w{k % 37} x{k}" for k in range(300))
    assert small.encode(text) == piece_model.encode(text)
    assert len(small.known) <= 10 and len(small.before) <= 10
