"""Packing, source audit and fill-in-middle against plain versions of themselves."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import divergence, fill_middle, packing, queries
from tests.oracle import same

SMALL = "/root/testdata/sf0.001"
ODD = ["", "  ", "a\x1cb c!\x1f! d", "x <|endoftext|> y", "it's don't I'LL", "é é ́a\xa0 b\x85 c", "tab\tand\r\n lines\n\n", "漢字 かな 🙂", "  two  spaces ", "x" * 500 + " y", "a's 'sb !'s 1's 'll’s _'t", "x²5 ½a 5³", "q\u02b0 e\u0301x Ⅷ9", "snake_case_1'd", "end. ", " lead, a  b\n", "x.\n y!\x1c", "z.\x1c"]


@pytest.fixture(scope="module")
def units():
    return packing.UnitEncoder(queries.BYTE_BPE)


def library(encoder, text):
    return np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


# Packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sal1._²\x1c\xa0é,!"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_units_encode_like_whole_texts(units, texts):
    assert units.encode(texts) == [library(units, t) for t in texts]


def test_long_and_odd_texts_encode_like_the_library(units, monkeypatch):
    assert units.encode(ODD) == [library(units, t) for t in ODD]
    text = " ".join(ODD) * 40
    monkeypatch.setattr(packing, "PART", 500)
    assert len(list(packing.parts(text, 500))) > 20 and "".join(packing.parts(text, 500)) == text
    assert b"".join(units.encode([p])[0] for p in packing.parts(text, 500)) == library(units, text)


def test_added_tokens_that_take_white_space_are_refused():
    with pytest.raises(ValueError, match="white space"):
        packing.UnitEncoder(queries.WORD_BPE)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.sampled_from([8, 16]))
def test_sum_of_squares_rule_and_result(sizes, width):
    """Each placement is the one that a search over all levels finds; at the end no id is lost and nothing is padded."""
    packer, done = packing.SumOfSquares(width, open_ids=10**6), []
    for k, n in enumerate(sizes):
        size, before = n % width, Counter(w.fill for level in packer.open for w in level)
        if size:
            def total(level, size=size, before=before):
                after = before + Counter([level + size])
                after[level] -= 1
                return sum(c * c for f, c in after.items() if 0 < f < width)

            levels = [level for level in range(width - size + 1) if not level or before[level]]
            want = max(levels, key=lambda level: (-total(level), level))
            assert packer.best(size) == want
        done += packer.add(k, np.arange(n, dtype="<u4").tobytes())
        assert packer.levels[1:width].tolist() == [len(level) for level in packer.open[1:]]
    done += packer.close()
    found = defaultdict(list)
    for pieces in done:
        n = sum(len(ids) // 4 for _, _, ids in pieces)
        assert n <= width and (n == width or n & (n - 1) == 0)
        for k, start, ids in pieces:
            found[k].append((start, np.frombuffer(ids, "<u4").tolist()))
    assert {k: sum((ids for _, ids in sorted(v)), []) for k, v in found.items()} == {k: list(range(n)) for k, n in enumerate(sizes)}
    assert all(start == ids[0] for v in found.values() for start, ids in v)
    if len(sizes) and width == 16:
        assert sum(len(v) for v in found.values()) <= sum(-(-n // width) for n in sizes) + len(sizes) + 4


def test_pack(spark, docs_of, units):
    rows = [(k * 3 % 11, t) for k, t in enumerate(ODD)] + [(50, None), (50, None), (None, "null id"), (7, "word " * 30_000), (8, "some words " * 700)]
    docs = docs_of(rows).withColumn("ids", F.lit("x")).withColumn("offset", F.lit(3)).repartition(3)
    pieces = packing.pack(docs, queries.BYTE_BPE).cache()
    got = defaultdict(list)
    for r in pieces.orderBy("start").collect():
        got[r["doc_id"], r["doc_tokens"]].append(r)
        assert len(r["ids"]) == 4 * r["length"]
    once = [r for r in rows if [x[0] for x in rows].count(r[0]) == 1]
    for key, text in once:
        raw = library(units, text or "") + b"\1\0\0\0"
        own = got[key, len(raw) // 4]
        assert b"".join(r["ids"] for r in own) == raw
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
    assert len(got[50, 1]) == 2
    for r in packing.sequences(pieces).collect():
        assert r["n_tokens"] <= 2048 and r["padding"] == 0 and len(r["ids"]) == 4 * r["n_tokens"]
    by = defaultdict(list)
    for r in pieces.collect():
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] for v in by.values())
    assert packing.pack(docs_of([(1, "a")]).limit(0), queries.BYTE_BPE).count() == 0


def test_packing_query(spark, units):
    """Every id of every document lies in exactly one piece, as the library encodes the whole text."""
    got = defaultdict(list)
    rows = queries.op11_packing(spark, SMALL).collect()
    for r in rows:
        got[r["doc_id"]].append(r)
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values())
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert set(got) == {d["doc_id"] for d in documents}
    for d in documents:
        raw = library(units, d["text"] or "") + b"\1\0\0\0"
        at = 0
        for r in sorted(got[d["doc_id"]], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(raw) // 4)
            assert r["ids_crc32"] == zlib.crc32(raw[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(raw) // 4


def test_open_windows_are_bounded():
    packer, done = packing.SumOfSquares(16, open_ids=64), []
    for k in range(200):
        done += packer.add(k, b"\0\0\0\0" * 9)
        assert sum(w.fill for level in packer.open for w in level) <= 64
    done += packer.close()
    assert sum(len(ids) for pieces in done for _, _, ids in pieces) == 200 * 36


# Source audit


def plain_audit(rows, min_docs=3, top=200):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    df, n, groups = Counter(), Counter(), sorted({r[:2] for r in rows})
    for lang, source, words in rows:
        df.update({(lang, w) for w in words})
        n.update((lang, source, w) for w in words)
    out = set()
    for lang in {g[0] for g in groups}:
        kept, sources = sorted(w for (x, w), c in df.items() if x == lang and c >= min_docs), [s for x, s in groups if x == lang]
        totals = {s: sum(n[lang, s, w] for w in kept) for s in sources}
        share = {s: {w: 1 + 10**9 * (n[lang, s, w] + 1) // (totals[s] + len(kept)) for w in kept} for s in sources}
        whole = {w: 1 + 10**9 * (sum(n[lang, s, w] for s in sources) + 1) // (sum(totals.values()) + len(kept)) for w in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            of_pairs = [(-sum(f(share[s][w], share[o][w]) for w in kept), o) for o in sources if o != s]
            of_terms = [(-f(share[s][w], whole[w]), w) for w in kept if n[lang, s, w] and share[s][w] > whole[w]]
            for part, found, most in (("pair", of_pairs, None), ("term", of_terms, top)):
                out |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most], 1)}
    return out


SCHEMA = "text string, lang string, source string, term string, value int, salt string, prefix int"


def audited(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    return [tuple(r) for r in divergence.audit(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect()]


ROWS = [
    ("Aa bb aa ÄÖ äö naïve x_y 漢字", "en", "a"), ("aa bb cc\x00dd İ", "en", "b"), ("AA bb cc cc cc", "en", "b"), ("bb cc", "en", "c"), (None, "en", "none"), ("", "en", None),
    ("aa bb aa", None, "a"), ("one two", "fr", "a"), ("one", "fr", "b"), ("one two", "de", "solo"), (None, None, None), ("Aa bb aa ÄÖ äö naïve x_y 漢字", "en", "a"),
]


def test_audit_equals_plain_version(spark):
    got = audited(spark, ROWS)
    assert len(got) == len(set(got)) and set(got) == plain_audit(ROWS)
    assert any(part == "pair" and value == 0 and lang == "fr" for lang, _, part, _, value, _ in got)


def test_audit_of_many_ties_and_groups_beyond_a_broadcast(spark, monkeypatch):
    """Hundreds of terms share a value at the 200th rank, with long common beginnings, and no table is small enough to broadcast."""
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(divergence, "HELD", 50)
    letters = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:03d}")
    tied = " ".join("verylongcommonbeginning" * 2 + letters(k) + "é" * (k % 3) for k in range(300)) + " verylongcommonbeginning"
    rows = [(tied, "en", "a")] * 3 + [("other words here", "en", s) for s in "bcbcb"] + [("verylongcommonbeginning other", "en", "b")]
    got = audited(spark, rows)
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows)
    assert sum(r[1] == "a" and r[2] == "term" for r in got) == 200


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aAbé 漢.", max_size=12), st.sampled_from(["x", None]), st.sampled_from(["s", "t", "u"])), max_size=12))
def test_audit_of_any_rows(spark, rows):
    assert set(audited(spark, rows, min_docs=1, top=2)) == plain_audit(rows, 1, 2)


def test_top_of_groups(spark, tmp_path):
    """Values over the whole range of bits, ties, small groups and equal rows."""
    rng = np.random.default_rng(5)
    rows = [(f"g{k % 3}", f"i{k:04d}", int(rng.integers(0, 4)) << int(rng.integers(0, 58))) for k in range(900)] + [("few", "a", 0), ("few", "b", (1 << 60) - 1)]
    spark.createDataFrame(rows, "g string, item string, value long").write.parquet(f"{tmp_path}/rows")
    got = {tuple(r) for r in divergence.top_of_groups(spark.read.parquet(f"{tmp_path}/rows"), ["g"], 50).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        want |= {(g, i, v, k) for k, (_, i, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:50], 1)}
    assert got == want


def test_shares_do_not_overflow(spark):
    n, total = 4_000_000_000_000, 9_000_000_000_000
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(1)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 1) // (total + 1)


def test_long_text_is_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PART", 64)
    raw = ("Wörter und Words, " * 50 + "x" * 500 + " END").encode()
    assert sum(divergence.term_lists(raw), []) == divergence.TERM.findall(raw.lower())


# Fill in the middle


def plain_middle(key, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle(spark, docs_of):
    texts = [*ODD, None, "<P>", "a<S", "<<<<", "<P", "has <M> inside", "word 🙂\r\n" * 30_000]
    rows = [(k, t) for k, t in enumerate(texts * 6)] + [(None, "null id"), (3, "same"), (3, "same")]
    docs = docs_of(rows).withColumn("fim_text", F.lit("x")).withColumn("cut", F.lit("y")).withColumn("form", F.lit("z"))
    made = fill_middle.transform(docs)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "rank", "cut", "form", *fill_middle.NEW]
    got = made.withColumn("back", fill_middle.restored(F.col("fim_form"), F.col("fim_text"))).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"z"}
    assert Counter((r["doc_id"], *(r[c] for c in fill_middle.NEW)) for r in got) == Counter((k, *plain_middle(k, t)) for k, t in rows)
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {r["fim_form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_other_units_and_sentinels(spark, docs_of):
    """Words as units: the cuts lie at ends of words, what follows the last one is suffix."""
    marks = ("[pre]", "[suf]", "[mid]")
    docs = docs_of([(k, "one two, three\n four. ") for k in range(40)])
    got = fill_middle.transform(docs, unit=r"\w+", sentinels=marks, transformed=100, suffix_first=50)
    for r in got.withColumn("back", fill_middle.restored(F.col("fim_form"), F.col("fim_text"), marks)).collect():
        a = r["fim_prefix_chars"]
        assert r["fim_units"] == 4 and r["back"] == r["text"]
        assert {a, a + r["fim_middle_chars"]} <= {0, 3, 7, 14, 20}
    for bad in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("", "a", "b"), ("xy", "yz", "q")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_middle.transform(docs, sentinels=bad)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \né🙂", max_size=20), st.sampled_from([r"(?s:.)", r"\w+", r"a*"]), st.integers(0, 30), st.integers(0, 30))
def test_matcher_equals_a_list_of_units(text, unit, x, y):
    pattern = re.compile(unit)
    ends = [0, *(m.end() for m in pattern.finditer(text))]
    assert fill_middle.unit_count(pattern, text) == len(ends) - 1
    a, b = sorted((x % len(ends), y % len(ends)))
    assert fill_middle.cut_ends(pattern, text, a, b) == (ends[a], ends[b])


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_fill_in_middle"])
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL)
