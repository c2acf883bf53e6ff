"""Hashes of words and word n-grams, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that are summed at once; the tables of powers and all temporaries have this size.
BLOCK = 1 << 16


class WordHasher:
    """Hashes of lower-case, white-space-separated words by prefix sums of a polynomial over the bytes."""

    def __init__(self) -> None:
        with np.errstate(over="ignore"):
            self.powers, self.inverses = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK, x)]), dtype=np.uint64) for x in (BASE, INVERSE))

    def sums(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The polynomials of the words ``raw[first:last]``: at most ``BLOCK`` bytes of words, or one long word."""
        with np.errstate(over="ignore"):
            if len(raw) > BLOCK:
                pieces = (raw[k : k + BLOCK].astype(np.uint64) + np.uint64(1) for k in range(0, len(raw), BLOCK))
                total = sum(int((x * self.powers[: len(x)]).sum(dtype=np.uint64)) * pow(int(BASE), k * BLOCK, 1 << 64) for k, x in enumerate(pieces))
                return np.array([total % (1 << 64)], np.uint64)
            sums = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=sums[1:])
            return (sums[last] - sums[first]) * self.inverses[first]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and where each text's words begin (one more entry than texts)."""
        parts = [t.lower().split() for t in texts]
        starts = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=starts[1:])
        if not starts[-1]:
            return np.zeros(0, dtype=np.uint64), starts
        raw = np.frombuffer(" ".join([" ".join(p) for p in parts if p]).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        del parts
        gaps = np.flatnonzero(raw == 32)
        first, last = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
        out, i = np.empty(len(first), np.uint64), 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(last, first[i] + BLOCK, "right")))
            out[i:j] = self.sums(raw[first[i] : last[j - 1]], first[i:j] - first[i], last[i:j] - first[i])
            i = j
        with np.errstate(over="ignore"):
            return mix(out + (last - first).astype(np.uint64)), starts


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words that begin at each place; the last n - 1 places are meaningless and left out."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(words) - n + 1
    with np.errstate(over="ignore"):
        out = np.full(size, np.uint64(n))
        for k in range(n):
            out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[k : k + size])
    return out
