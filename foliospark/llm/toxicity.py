"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A token's input is its word embedding beside the mean embedding of its character 3- and 4-grams. Two gated
recurrent layers read a window forwards and backwards, attention pools their states, and a linear layer gives
the window's logit. A document is cut into all overlapping windows; its highest logit is mapped to a
probability by a curve fitted on labelled rows that the network didn't see.

Labels are of documents, so training picks for each toxic document the window that looks most toxic (first by
the log odds of words and character n-grams, later by the network itself); windows of other documents are negative.

Defined cases: a null or empty text has no window and gets the prior probability; copies are scored alike;
an empty table gives an empty result; without both classes in the training rows the score is the share
of toxic rows, at least 0.001 and at most 0.999 (0.001 without any row); other columns are kept, but an input column
with the name of a new one gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, replacing, whole_text
from .quality import logistic

WINDOW = 32
STRIDE = 16
HIDDEN = 8
WORD_DIM = 8
CHAR_DIM = 8
BUCKETS = 1 << 15
THRESHOLD = 0.7
#: Bound of the training sample: rows of each class.
PER_CLASS = 1_500
#: Tokens whose inputs a worker remembers before it starts afresh.
REMEMBERED = 200_000
EDGE = ".,;:!?\"'()[]…«»"


def tokens(text: str) -> list[str]:
    return text.lower().split()


def char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character 3- and 4-grams of ``^word$``, and where each word's grams begin."""
    words = [w.strip(EDGE) or w for w in words]
    points = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counts3, counts4 = lengths - 2, np.maximum(lengths - 3, 0)
    begins = np.concatenate([[0], np.cumsum(counts3 + counts4)])
    out = np.zeros(begins[-1], dtype=np.int64)
    for n, counts, shift in ((3, counts3, 0), (4, counts4, counts3)):
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(first, counts) + inner
        h = np.full(len(at), np.uint64(n))
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h ^ points[at + k]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(29)
        out[np.repeat(begins[:-1] + shift, counts) + inner] = (h % np.uint64(BUCKETS)).astype(np.int64)
    return out, begins


def spans(n: int) -> list[int]:
    """Where the windows of ``n`` tokens begin: every stride, the last one reaching the end."""
    if n <= WINDOW:
        return [0] if n else []
    out = list(range(0, n - WINDOW, STRIDE))
    return [*out, n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    vocabulary: dict[str, int]
    p: dict[str, np.ndarray]
    slope: float = 1.0
    intercept: float = 0.0
    prior: float = 0.0
    _known: dict[str, int] = field(default_factory=dict, repr=False)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word ids, gram buckets with their begins, and the input vectors of tokens."""
        ids = np.array([self.vocabulary.get(w.strip(EDGE), 0) for w in words], dtype=np.int64)
        grams, begins = char_grams(words)
        counts = np.maximum(np.diff(begins), 1)
        chars = np.add.reduceat(self.p["chars"][grams], begins[:-1], axis=0) / counts[:, None]
        return ids, grams, begins, np.concatenate([self.p["words"][ids], chars.astype(np.float32)], axis=1)

    def layer(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time, batch, hidden) from projected inputs (time, batch, 3 * hidden) in direction ``d``."""
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        u, hn = self.p[f"u{d}"], HIDDEN
        h = np.zeros((x.shape[1], hn), dtype=np.float32)
        out = np.zeros((len(x), x.shape[1], hn), dtype=np.float32)
        for t in steps:
            g = h @ u
            rz = 1 / (1 + np.exp(-(x[t, :, : 2 * hn] + g[:, : 2 * hn])))
            r, z = rz[:, :hn], rz[:, hn:]
            n = np.tanh(x[t, :, 2 * hn :] + r * g[:, 2 * hn :])
            new = n + z * (h - n)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, g, r, z, n, m))
            h = np.where(m, new, h)
            out[t] = h
        return out

    def forward(self, projected: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows from (time, batch, 6 * hidden) projections."""
        kf, kb = ([], []) if keep is not None else (None, None)
        hs = np.concatenate([self.layer(projected[:, :, : 3 * HIDDEN], mask, "f", kf), self.layer(projected[:, :, 3 * HIDDEN :], mask, "b", kb)], axis=2)
        a = np.tanh(hs @ self.p["wa"] + self.p["ba"])
        e = np.where(mask, a @ self.p["va"], -1e9)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = (w[:, :, None] * hs).sum(axis=0)
        if keep is not None:
            keep.update(f=kf, b=kb, hs=hs, a=a, w=w, pooled=pooled)
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def backward(self, dlogit: np.ndarray, keep: dict, grads: dict[str, np.ndarray]) -> np.ndarray:
        """Gradient of the projections; parameter gradients are added to ``grads``."""
        hs, a, w, pooled = (keep[k] for k in ("hs", "a", "w", "pooled"))
        grads["wo"] += pooled.T @ dlogit
        grads["bo"] += dlogit.sum()
        dpooled = dlogit[:, None] * self.p["wo"]
        dw = (hs * dpooled).sum(-1)
        de = w * (dw - (w * dw).sum(axis=0))
        da = de[:, :, None] * self.p["va"] * (1 - a**2)
        grads["va"] += np.einsum("tb,tbk->k", de, a)
        flat = da.reshape(-1, da.shape[-1])
        grads["wa"] += hs.reshape(-1, hs.shape[-1]).T @ flat
        grads["ba"] += flat.sum(0)
        dhs = w[:, :, None] * dpooled + da @ self.p["wa"].T
        hn = HIDDEN
        out = np.zeros((*hs.shape[:2], 6 * hn), dtype=np.float32)
        for d, at in (("f", 0), ("b", 1)):
            u, carry = self.p[f"u{d}"], np.zeros(hs.shape[1:2] + (hn,), dtype=np.float32)
            for t, h, g, r, z, n, m in reversed(keep[d]):
                total = dhs[t, :, at * hn : (at + 1) * hn] + carry
                dnew = np.where(m, total, 0)
                dn = dnew * (1 - z) * (1 - n**2)
                dz = dnew * (h - n) * z * (1 - z)
                dr = dn * g[:, 2 * hn :] * r * (1 - r)
                dg = np.concatenate([dr, dz, dn * r], axis=1)
                grads[f"u{d}"] += h.T @ dg
                carry = np.where(m, dnew * z, total) + dg @ u.T
                out[t, :, at * 3 * hn : (at + 1) * 3 * hn] = np.concatenate([dr, dz, dn], axis=1)
        return out

    def document_logits(self, texts: list[str]) -> np.ndarray:
        """The highest window logit of each text; NaN for texts without tokens."""
        words = [tokens(t) for t in texts]
        if len(self._known) > REMEMBERED:
            self._known.clear()
            self._rows = []
        known = self._known
        new = list({w for ws in words for w in ws if w not in known})
        if not known:
            self._rows = []
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self._rows.append((self.inputs(new)[3] @ self.p["wi"] + self.p["bi"]).astype(np.float32))
            if len(self._rows) > 8:
                self._rows = [np.concatenate(self._rows)]
        get = known.__getitem__
        flat = np.fromiter((get(w) for ws in words for w in ws), dtype=np.int64)
        lengths = [len(ws) for ws in words]
        starts, owner, left = [], [], []
        base = 0
        for k, n in enumerate(lengths):
            own = spans(n)
            starts += [base + s for s in own]
            owner += [k] * len(own)
            left += [min(n, WINDOW)] * len(own)
            base += n
        out = np.full(len(texts), np.nan)
        if not starts:
            return out
        table = np.concatenate(self._rows) if len(self._rows) > 1 else self._rows[0]
        self._rows = [table]
        starts, left, owner = np.array(starts), np.array(left), np.array(owner)
        logits = np.empty(len(starts), dtype=np.float32)
        steps = np.arange(WINDOW)[:, None]
        for a in range(0, len(starts), 4096):
            mask = steps < left[None, a : a + 4096]
            at = np.minimum(starts[None, a : a + 4096] + steps, len(flat) - 1)
            logits[a : a + 4096] = self.forward(table[flat[at]], mask)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logits)
        out[np.unique(owner)] = best[np.unique(owner)]
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(logits), self.prior, sigmoid(self.slope * np.nan_to_num(logits) + self.intercept))


def log_odds(present: Iterable[np.ndarray], labels: np.ndarray, things: int) -> dict[int, float]:
    """Smoothed log odds of things, numbered below ``things``, by the labels of the documents that hold them; at least three documents.

    ``present`` holds the distinct things of one document after the other, so only the counts are kept.
    """
    seen = np.zeros((2, things), dtype=np.int64)
    for own, y in zip(present, labels.tolist(), strict=True):
        seen[y, own] += 1
    n0, n1 = (labels == 0).sum(), (labels == 1).sum()
    return {x: float(np.log((seen[1, x] + 0.5) / (n1 + 1)) - np.log((seen[0, x] + 0.5) / (n0 + 1))) for x in np.flatnonzero(seen.sum(axis=0) >= 3).tolist()}


def numbered(lists: Iterable[list[str]]) -> tuple[list[np.ndarray], list[str]]:
    """Each list as numbers of its words, and the different words in the order of their first places; one list is held at a time."""
    index: dict[str, int] = {}
    seqs = [np.fromiter((index.setdefault(w, len(index)) for w in ws), dtype=np.int64, count=len(ws)) for ws in lists]
    return seqs, list(index)


def train(rows: list, base_rate: float, seed: int = 7, epochs: int = 6, batch: int = 256, informed: bool = True) -> Network:
    """``rows``: (doc_id, text, label). Every fourth row is kept for the curve.

    ``informed`` starts one dimension of either embedding at the log odds; without it all dimensions start at random.
    """
    rng = np.random.default_rng(seed)
    rows = [rows[k] for k in rng.permutation(len(rows))]
    fit_rows, curve_rows = [r for k, r in enumerate(rows) if k % 4], [r for k, r in enumerate(rows) if not k % 4]
    y = np.array([r[2] for r in fit_rows], dtype=np.int64)
    rate = min(max(base_rate, 1e-3), 1 - 1e-3)
    prior = float(np.log(rate / (1 - rate)))
    shape = {"wi": (WORD_DIM + CHAR_DIM, 6 * HIDDEN), "uf": (HIDDEN, 3 * HIDDEN), "ub": (HIDDEN, 3 * HIDDEN), "wa": (2 * HIDDEN, HIDDEN), "va": (HIDDEN,), "wo": (2 * HIDDEN,)}
    p = {k: rng.normal(0, 0.4 / np.sqrt(s[0] / 8), s).astype(np.float32) for k, s in shape.items()} | {"bi": np.zeros(6 * HIDDEN, np.float32), "ba": np.zeros(HIDDEN, np.float32), "bo": np.zeros(1, np.float32)}
    net = Network({}, p, prior=rate)
    net.p["chars"], net.p["words"] = np.zeros((BUCKETS, CHAR_DIM), np.float32), np.zeros((1, WORD_DIM), np.float32)
    if len(set(y.tolist())) < 2 or len({r[2] for r in curve_rows}) < 2:
        net.slope, net.intercept = 0.0, prior
        return net
    seqs, unique = numbered(tokens(r[1]) for r in fit_rows)
    (bare,), stems = numbered([[w.strip(EDGE) for w in unique]])
    odds = {stems[k]: v for k, v in log_odds((np.unique(bare[s]) for s in seqs), y, len(stems)).items()}
    grams, begins = char_grams(unique)
    held = (np.unique(np.concatenate([grams[begins[k] : begins[k + 1]] for k in np.unique(s).tolist()])) if len(s) else s for s in seqs)
    gram_odds = np.zeros(BUCKETS)
    for g, v in log_odds(held, y, BUCKETS).items():
        gram_odds[g] = v
    net.vocabulary = {w: k + 1 for k, w in enumerate(sorted(odds))}
    net.p["words"] = rng.normal(0, 0.1, (len(net.vocabulary) + 1, WORD_DIM)).astype(np.float32)
    net.p["chars"] = rng.normal(0, 0.1, (BUCKETS, CHAR_DIM)).astype(np.float32)
    if informed:
        net.p["words"][1:, 0] = np.clip([odds[w] for w in sorted(odds)], -3, 3)
        net.p["chars"][:, 0] = np.clip(gram_odds, -3, 3)
    token_odds = np.array([max(odds.get(w.strip(EDGE), 0.0), 0.0) for w in unique]) + np.maximum(np.add.reduceat(gram_odds[grams], begins[:-1]) / np.maximum(np.diff(begins), 1), 0)
    windows = [(k, s) for k, seq in enumerate(seqs) for s in spans(len(seq))]
    owner = np.array([k for k, _ in windows])
    first = np.array([s for _, s in windows])
    score = np.array([token_odds[seqs[k][s : s + WINDOW]].max() for k, s in windows])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch in (2, 4):  # the network itself now names the windows
            score = np.empty(len(windows))
            table = np.concatenate([net.inputs(unique[a : a + 16_384])[3] for a in range(0, len(unique), 16_384)]) @ net.p["wi"] + net.p["bi"]
            for a in range(0, len(windows), 4096):
                o, f = owner[a : a + 4096], first[a : a + 4096]
                ids, mask = gather(seqs, o, f)
                score[a : a + 4096] = net.forward(table[ids].astype(np.float32, copy=False), mask)
        order = np.lexsort((-score, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        positive = order[(y[owner[order]] == 1) & (rank < 1)]
        none = order[y[owner[order]] == 0]
        hard = none[rank[y[owner[order]] == 0] < 1]
        negative = np.unique(np.concatenate([hard, rng.choice(none, min(len(none), 2 * len(hard)), replace=False)]))
        chosen = rng.permutation(np.concatenate([positive, negative]))
        for a in range(0, len(chosen), batch):
            own = chosen[a : a + batch]
            target = y[owner[own]].astype(np.float32)
            ids, mask = gather(seqs, owner[own], first[own])
            used, local = np.unique(ids, return_inverse=True)
            wid, g, b, x = net.inputs([unique[k] for k in used.tolist()])
            keep: dict = {}
            projected = (x @ net.p["wi"] + net.p["bi"])[local.reshape(ids.shape)].astype(np.float32)
            logit = net.forward(projected, mask, keep)
            weight = np.where(target == 1, 2.0, 1.0) / len(own)
            grads = {k: np.zeros_like(v) for k, v in net.p.items()}
            dproj = net.backward(((sigmoid(logit) - target) * weight).astype(np.float32), keep, grads)
            flat = dproj.reshape(-1, 6 * HIDDEN)
            dtable = np.zeros((len(used), 6 * HIDDEN), dtype=np.float32)
            np.add.at(dtable, local.ravel(), flat)
            grads["wi"] += x.T @ dtable
            grads["bi"] += dtable.sum(0)
            dx = dtable @ net.p["wi"].T
            np.add.at(grads["words"], wid, dx[:, :WORD_DIM])
            counts = np.maximum(np.diff(b), 1)
            np.add.at(grads["chars"], g, np.repeat(dx[:, WORD_DIM:] / counts[:, None], np.diff(b), axis=0))
            step += 1
            for k, v in net.p.items():
                m1, m2 = moments[k]
                m1 += 0.1 * (grads[k] - m1)
                m2 += 0.01 * (grads[k] ** 2 - m2)
                v -= 0.01 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    logits = np.nan_to_num(np.concatenate([net.document_logits([r[1] for r in curve_rows[a : a + 200]]) for a in range(0, len(curve_rows), 200)]))
    target = np.array([r[2] for r in curve_rows], dtype=float)
    net.slope, net.intercept = logistic(logits, target)
    net.intercept += prior - float(np.log(target.mean() / (1 - target.mean())))
    net._known, net._rows = {}, []
    return net


def gather(seqs: list[np.ndarray], owner: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids (time, window) and their mask."""
    ids, mask = np.zeros((WINDOW, len(owner)), dtype=np.int64), np.zeros((WINDOW, len(owner)), dtype=bool)
    for k, (o, s) in enumerate(zip(owner.tolist(), first.tolist(), strict=True)):
        part = seqs[o][s : s + WINDOW]
        ids[: len(part), k], mask[: len(part), k] = part, True
    return ids, mask


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, per_class: int = PER_CLASS, seed: int = 23) -> Network:
    """Learn from labelled rows outside the held-out fold; the sample is bounded by ``per_class``."""
    keep = fold("doc_id", folds) != held_out
    counts = {r["y"]: r["n"] for r in labels.where(keep & F.col("toxic").isin(0, 1)).groupBy(F.col("toxic").cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    return train(labelled_sample(docs, labels, "toxic", keep, per_class, seed), counts.get(1, 0) / total if total else 0.0)


def score(docs: DataFrame, model: Network, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with ``toxicity`` and ``toxic`` added; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            parts = [model.document_logits(texts.iloc[k : k + 128].tolist()) for k in range(0, len(texts), 128)]
            yield pd.Series(model.probabilities(np.concatenate(parts) if parts else np.zeros(0)))

    scored = docs.withColumn("toxicity", toxicity(whole_text())).withColumn("toxic", F.col("toxicity") >= threshold)
    return scored.select(*replacing(docs, "toxicity", "toxic"), "toxicity", "toxic")
