"""Quality classifier by compression.

Two zstandard dictionaries are built, one from well-rated and one from badly rated text. A document is
cut into blocks, each block is compressed with either dictionary, and the difference of the summed sizes
over the raw size is mapped to a probability by a logistic curve fitted on rows that neither dictionary saw.

Defined cases: a null or empty text has difference 0 and gets the curve's value there; repeated rows are
scored alike; an empty table gives an empty result; without both classes in the training rows the score is
the share of good rows (0.5 without any; at least 0.001 and at most 0.999). Other columns are kept, but an input column
with the name of a new one gives way to it in ``score`` (``keep_good`` keeps all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, replacing, whole_text, with_own_names

BLOCK_BYTES = 512
DICTIONARY_BYTES = 112_640
#: Bound of the training sample: rows of each class.
PER_CLASS = 2_000
LEVEL = 3
THRESHOLD = 0.3
#: Texts that are turned into Python strings at once.
ROWS = 512


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def scorer(self):
        import zstandard

        pair = []
        for raw in (self.good, self.bad):
            if raw:
                own = zstandard.ZstdCompressionDict(raw)
                own.precompute_compress(level=LEVEL)
                pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
        return lambda text: self.probability(difference(text, *pair) if len(pair) == 2 else 0.0)

    def probability(self, d: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * d + self.intercept, -60, 60))))


def blocks(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]


def difference(text: str, good, bad) -> float:
    """Bytes that the bad dictionary needs beyond the good one, per byte of text."""
    total = extra = 0
    for block in blocks(text):
        total += len(block)
        extra += len(bad.compress(block)) - len(good.compress(block))
    return extra / total if total else 0.0


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept by Newton's method, on standardised values with a light ridge."""
    mid, scale = float(x.mean()), float(x.std()) or 1.0
    a = np.column_stack([(x - mid) / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mid / scale)


def train(rows: list, base_rate: float | None = None) -> QualityModel:
    """``rows``: (doc_id, text, label). Even rows build the dictionaries, odd rows the curve."""
    import zstandard

    by = {y: [t for _, t, l in rows if l == y and t] for y in (0, 1)}
    n0, n1 = len(by[0]), len(by[1])
    rate = base_rate if base_rate is not None else (n1 / (n0 + n1) if n0 + n1 else 0.5)
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    prior = float(np.log(rate / (1 - rate)))
    dictionaries = []
    for y in (1, 0):
        parts = [b for t in by[y][::2] for b in blocks(t)]
        try:
            dictionaries.append(zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, parts)) // 4)), parts).as_bytes())
        except (zstandard.ZstdError, ValueError):
            return QualityModel(b"", b"", 0.0, prior)
    raw = QualityModel(*dictionaries, 1.0, 0.0)
    import zstandard as z

    pair = [z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in dictionaries]
    x = np.array([difference(t, *pair) for y in (0, 1) for t in by[y][1::2]])
    y = np.array([v for v in (0, 1) for _ in by[v][1::2]], dtype=float)
    if len(set(y)) < 2:
        return QualityModel(raw.good, raw.bad, 0.0, prior)
    slope, intercept = logistic(x, y)
    return QualityModel(raw.good, raw.bad, slope, intercept + prior - float(np.log(y.mean() / (1 - y.mean()))))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS, seed: int = 11) -> QualityModel:
    """Learn from labelled rows outside the held-out fold; the sample is bounded by ``per_class``."""
    keep = fold("doc_id", folds) != held_out
    counts = {r["y"]: r["n"] for r in labels.where(keep & F.col("quality").isin(0, 1)).groupBy(F.col("quality").cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    rows = labelled_sample(docs, labels, "quality", keep, per_class, seed)
    return train(rows, counts.get(1, 0) / total if total else None)


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with ``quality_score`` and ``quality_ok`` added; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = shared.value.scorer()
        for batch in batches:
            yield pa.array([one(t) for k in range(0, len(batch), ROWS) for t in batch.slice(k, ROWS).to_pylist()], pa.float64())

    scored = docs.withColumn("quality_score", quality(whole_text())).withColumn("quality_ok", F.col("quality_score") >= threshold)
    return scored.select(*replacing(docs, "quality_score", "quality_ok"), "quality_score", "quality_ok")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    return with_own_names(docs, lambda d, text: score(d.withColumn("text", F.col(text)), model, threshold).where("quality_ok"), text=text_column)
