"""Similar names against comparisons of all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import similarity, text
from foliospark.operators import fuzzy


def names(rng: random.Random, n: int) -> list[str]:
    """Names of one to fourteen letters, near copies of some, repeated letters, and several words."""
    out = [""]
    for _ in range(n):
        word = "".join(rng.choice("aeinrst") for _ in range(rng.choice((1, 2, 3, 4, 6, 9, 14))))
        out.append(word if rng.random() < 0.7 else f"{word} {rng.choice(('li', 'anna', 'otto'))}")
        if rng.random() < 0.5:
            at = rng.randrange(len(word))
            out.append(word[:at] + rng.choice(("", "x", word[at] * 2)) + word[at + 1 :])
    return out


@pytest.mark.parametrize(("kind", "least", "rows"), [("partial", 80.0, 50_000), ("partial", 78.0, 0), ("ratio", 78.0, 50_000), ("ratio", 70.0, 50_000), ("token_set", 78.0, 0)])
def test_similar_pairs_equal_all_pairs(spark, monkeypatch, kind, least, rows):
    monkeypatch.setattr(fuzzy, "BROADCAST_ROWS", rows)
    rng = random.Random(int(least) + len(kind))
    a, b = ([" ".join(sorted(set(x.split()))) if kind == "token_set" else x for x in names(rng, n)] for n in (40, 60))
    how = {"ratio": similarity.ratio, "partial": similarity.partial_ratio, "token_set": similarity.token_set_ratio}[kind]
    left = spark.createDataFrame([*enumerate(a), (900, None)], "l long, a string")
    right = spark.createDataFrame([*enumerate(b), (901, None)], "r long, b string")
    got = {(r["l"], r["r"]): r["score"] for r in fuzzy.similar_pairs(left, right, kind, least).collect()}
    want = {(i, j): s for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (s := how(x, y)) >= least - 1e-9}
    assert got == pytest.approx(want) and len(want) >= 20


def test_few_pairs_are_compared(spark):
    """Of random names the index leaves a small share to compare."""
    rng = random.Random(1)
    make = lambda: "".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(12))
    n = [("l", "a", 300), ("r", "b", 300)]
    dfs = [spark.createDataFrame([(k, make()) for k in range(m)], f"{i} long, {x} string") for i, x, m in n]
    compared = fuzzy.similar_pairs(*dfs, "partial", 80.0)
    assert compared.count() == 0
    both = dfs[0].crossJoin(dfs[1]).where(F.size(F.array_intersect(fuzzy.pairs_of_letters(F.col("a")), fuzzy.pairs_of_letters(F.col("b")))) >= fuzzy.needed(F.lit(12), 80.0))
    assert both.count() < 0.02 * 300 * 300


def test_low_similarities_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], "l long, a string")
    with pytest.raises(ValueError, match="pair of letters"):
        fuzzy.similar_pairs(df, df.toDF("r", "b"), "ratio", 60.0)


def plain_search(parties, queries):
    out = set()
    plain = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})
    for q, asked in queries:
        if not asked:
            continue
        needle = asked.translate(plain).upper()
        order = lambda p: (p[1] or "", p[0])
        rows = sorted((p for p in parties if (p[1] or "").startswith(needle) or any((x or "").lower().startswith(asked.lower()) for x in p[2:])), key=order)[:100]
        found = [(p[0], None) for p in rows]
        if len(rows) < 3:
            rest = [(-similarity.partial_ratio(needle, (p[1] or "").upper()), *order(p)) for p in parties if p not in rows and p[1]]
            found += [(i, -s) for s, _, i in sorted(rest) if -s >= 80][: 20 - len(rows)]
        out |= {(q, i, k, s and round(s, 6)) for k, (i, s) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("rows", [50_000, 0])
def test_party_search(spark, monkeypatch, rows):
    monkeypatch.setattr(fuzzy, "BROADCAST_ROWS", rows)
    rng = random.Random(4)
    words = [w for w in names(rng, 60) if w]
    parties = [(k, f"{w.upper()} {rng.choice('ABC')}", w.title() if k % 3 else None, None if k % 3 else f"{w} gmbh") for k, w in enumerate(words)]
    parties += [(1000 + k, f"STADT {k}", f"Stadt {k}", None) for k in range(130)] + [(2000, None, None, None), (2001, "", "", "")]
    queries = list(enumerate([*rng.sample(words, 20), "stad", "Städt 7", "x", "li", "Rt", "", "anna nastr", "tsadt 12"])) + [(90, None)]
    got = fuzzy.party_search(spark.createDataFrame(parties, "party_id long, search_name string, last_name string, company_name string"), spark.createDataFrame(queries, "query_id long, text string")).collect()
    assert {(r["query_id"], r["party_id"], r["place"], r["score"] and round(r["score"], 6)) for r in got} == plain_search(parties, queries)


OWNER = "kind string, first_name string, last_name string, company_name string, email string, postal_code string, street string, iban_hash string"


def plain_match(person, owners, norm):
    """The best owner by comparing all."""
    scored = []
    kind, first, last, company, email, postal, street, iban, unit = person
    for owner_id, (okind, ofirst, olast, ocompany, oemail, opostal, ostreet, oiban), units, inside in owners:
        natural = kind == okind == "natural_person"
        if natural and first and ofirst:
            base = similarity.token_set_ratio(norm(f"{last or ''} {first}"), norm(f"{olast or ''} {ofirst}"))
        elif natural:
            base = similarity.ratio(norm(last), norm(olast))
        else:
            a, b = norm(company or last), norm(ocompany or olast)
            how = similarity.partial_ratio if "natural_person" not in (kind, okind) else similarity.ratio
            base = how(a, b) if a and b else 0.0
        signals = [
            name
            for name, given in {
                "same_unit": unit is not None and unit in units,
                "same_address": bool(postal and postal == opostal and norm(street) and norm(street) == norm(ostreet)),
                "same_email": bool(email and oemail and email.strip().lower() == oemail.strip().lower()),
                "same_iban_hash": bool(iban and iban == oiban),
                "same_first_name": bool(natural and first and ofirst and norm(first) == norm(ofirst) and similarity.ratio(norm(last), norm(olast)) >= 85),
            }.items()
            if given
        ]
        scored.append((-min(100.0, base + sum(fuzzy.WEIGHTS[s] for s in signals)), owner_id, signals, inside))
    scored = sorted(s for s in scored if -s[0] >= 78)
    if not scored:
        return ("new", None, None, None)
    score, owner_id, signals, inside = scored[0]
    return ("auto" if -score >= 90 and signals and inside and len(scored) == 1 else "candidates", owner_id, round(-score, 6), signals)


def test_owner_match_equals_all_pairs(spark):
    rng = random.Random(9)
    norm = lambda x: " ".join("".join(c if c.isalnum() else " " for c in (x or "").lower().replace("-", " ")).split())
    lasts, firsts = [w for w in names(rng, 30) if len(w) > 2], ["Anna", "Karl", "Ute-Maria", None]

    def one(k):
        natural = rng.random() < 0.7
        last = rng.choice(lasts)
        row = ["natural_person" if natural else "legal_entity", rng.choice(firsts) if natural else None, last if natural or k % 4 == 0 else None, None if natural else f"{last} Bau GmbH"]
        maybe = lambda x: x if rng.random() < 0.3 else rng.choice((None, ""))
        return (*row, maybe(f"M{rng.randrange(30)}@x.example "), maybe("12345"), maybe(f"Weg {rng.randrange(9)}"), maybe(f"h{rng.randrange(40)}"))

    owners = [(k, one(k), [rng.randrange(50)] if k % 3 else [], k % 2 == 0) for k in range(120)]
    persons = [(k, (*one(k), rng.randrange(50) if k % 2 else None)) for k in range(60)]
    own = spark.createDataFrame([(k, *x, u, i) for k, x, u, i in owners], f"owner_id long, {OWNER}, unit_ids array<long>, in_object boolean")
    asked = spark.createDataFrame([(k, *x) for k, x in persons], f"person_id long, {OWNER}, unit_id long")
    got = {r["person_id"]: (r["decision"], r["owner_id"], r["score"] and round(r["score"], 6), r["signals"]) for r in fuzzy.owner_match(asked, own).collect()}
    want = {k: plain_match(x, owners, norm) for k, x in persons}
    assert got == want
    assert {d for d, *_ in want.values()} == {"auto", "candidates", "new"}
    assert spark.range(1).select(text.norm_name(F.lit("Ute-Maria Öz!"))).first()[0] == "ute maria oez"
