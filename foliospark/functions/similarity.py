"""Similarity of names: normalised insertions and deletions, as ratio, token-set ratio and partial ratio."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if common and (not left or not right):
        return 100.0
    one, two = (f"{common} {s}".strip() for s in (left, right))
    return max(ratio(one, two), *((ratio(common, one), ratio(common, two)) if common else (0.0,)))


def partial_ratio(a: str, b: str) -> float:
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 0.0
    n = len(short)
    return max(ratio(short, long_[max(0, i) : i + n]) for i in range(1 - n, len(long_)))


def similarity(a: Column, b: Column, kind: str = "ratio") -> Column:
    """``kind`` is ratio, token_set or partial; in Arrow batches."""
    how = {"ratio": ratio, "token_set": token_set_ratio, "partial": partial_ratio}[kind]

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([None if p is None or q is None else how(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return run(a, b)


def owner_score(name: Column, unit: Column, address: Column, email: Column, account: Column, first: Column) -> Column:
    """Name similarity and bonuses for signals, at most 100."""
    bonus = lambda c, n: F.when(c, n).otherwise(0)
    return F.least(F.lit(100.0), name + bonus(unit, 15) + bonus(address, 8) + bonus(email, 15) + bonus(account, 15) + bonus(first, 8))
