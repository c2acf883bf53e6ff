"""Approximate nearest neighbours by cosine with additive quantisation.

A vector's direction, taken from the sample's mean and in units of the sample's spread, is coded as a sum of one entry from each of
``books`` full-dimensional codebooks, one for each four dimensions or more. The codebooks are trained one after another on residuals of a
bounded sample; a beam search chooses the entries; two norms, of the vector and of its code, are stored. A query is scored against all
codes with lookup tables of its products with all entries, and the best codes are ranked again by the exact cosine on the original vectors,
which lie beside their codes: so only the best few of a block leave its task, however long the shortlist is.

How many are ranked again is measured, as it depends on how far apart the vectors lie: ``PROBES`` of the queries are compared with every
vector, and the shortlist is as long as it takes to hold nearly all of their nearest ones, but at least ``shortlist``.

Vectors are scaled by a power of two, which brings the largest component near 1 and changes no digit: so neither
very large nor very small components overflow or vanish in a product. Equal vectors are one entry with their smallest
ids, as many as a result can hold, so a very common vector neither fills the shortlist nor gathers in one task. An
entry's number is given when the entries are written; nothing is told apart by hashes. Queries go in blocks against
blocks of codes; each pair of blocks is one row of an equi-join, and a task returns the best few of it for each query.
There are about as many tasks as blocks of codes, whatever the number of queries.

Defined cases: rows with a null id or vector, a null, NaN or infinite component, only zeros, or another
dimension than most of the sample take no part, neither as query nor as candidate; ties go to the smaller id;
repeated ids count once for each different vector; with fewer candidates than asked for, all are returned;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BOOKS = 32
ENTRIES = 64
BEAM = 4
#: Bound of the training sample, in vectors.
SAMPLE = 10_000
SHORTLIST = 192
#: Queries whose true neighbours set the length of the shortlist, the share of neighbours it must hold, and what it is multiplied with.
PROBES, HELD, SPARE = 128, 0.99, 1.5
#: Vectors of one block of codes and queries of one block at most, and bytes of their vectors.
CODE_BLOCK = 65_536
QUERY_BLOCK = 32_768
BLOCK_BYTES = 16 << 20
#: How far sums in another order may lie from each other.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Codebooks:
    """``entries[m]`` is a (size, dimension) matrix."""

    entries: list[np.ndarray]

    @property
    def dimension(self) -> int:
        return self.entries[0].shape[1]

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, books) and norms of the coded vectors, by beam search over residuals."""
        n = len(x)
        rest, codes = x[:, None, :], np.zeros((n, 1, 0), dtype=np.uint8)
        for book in self.entries:
            width, size = rest.shape[1], len(book)
            cost = (rest**2).sum(-1, keepdims=True) - 2 * (rest.reshape(n * width, -1) @ book.T).reshape(n, width, size) + (book**2).sum(-1)
            flat = cost.reshape(n, width * size)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
            parent, entry = best // size, best % size
            rows = np.arange(n)[:, None]
            rest = rest[rows, parent] - book[entry]
            codes = np.concatenate([codes[rows, parent], entry[..., None].astype(np.uint8)], axis=2)
        return codes[:, 0], np.linalg.norm(self.decode(codes[:, 0]), axis=1).astype(np.float32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.entries))

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Estimated products of queries and coded unit vectors (queries, codes) from lookup tables and stored norms."""
        out = np.zeros((len(queries), len(codes)))
        for m in range(0, len(self.entries), 2):  # one table for two books: half as many lookups
            pair = self.entries[m : m + 2]
            place = codes[:, m].astype(np.intp)
            table = queries @ pair[0].T.astype(np.float64)
            if len(pair) == 2:
                place = place * len(pair[1]) + codes[:, m + 1]
                table = (table[:, :, None] + (queries @ pair[1].T.astype(np.float64))[:, None, :]).reshape(len(queries), -1)
            for q in range(len(queries)):
                out[q] += table[q].take(place)
        return out / np.maximum(norms, 1e-12)


@dataclass(frozen=True)
class Coder:
    """Codebooks over directions less their ``mean``, in units of ``spread``."""

    books: Codebooks
    mean: np.ndarray
    spread: float

    def placed(self, x: np.ndarray) -> np.ndarray:
        return (unit(x) - self.mean) / self.spread

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and for each vector its own length, the length of its code."""
        own = self.placed(x)
        codes, norms = self.books.encode(own.astype(np.float32))
        return codes, np.column_stack([np.linalg.norm(own, axis=1), norms])

    def estimates(self, queries: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(queries, codes), largest for the nearest: half the square of the distance, from below, less what only the query tells."""
        return self.books.scores(queries, codes, lengths[:, 1]) * lengths[:, 0] - lengths[:, 0] ** 2 / 2


def coder(sample: np.ndarray, books: int) -> Coder:
    x = unit(sample)
    mean = x.mean(axis=0)
    spread = float(np.sqrt(((x - mean) ** 2).sum(axis=1).mean())) or 1.0
    return Coder(train((x - mean) / spread, max(books, -(-x.shape[1] // 4))), mean, spread)


def train(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 8, seed: int = 3) -> Codebooks:
    rng = np.random.default_rng(seed)
    rest, out = x.astype(np.float32), []
    for _ in range(books):
        size = min(entries, len(rest))
        book = rest[rng.choice(len(rest), size, replace=False)].copy()
        for _ in range(rounds):
            near = ((book**2).sum(1) - 2 * rest @ book.T).argmin(1)
            order = np.argsort(near, kind="stable")
            used, first, counts = np.unique(near[order], return_index=True, return_counts=True)
            book[used] = np.add.reduceat(rest[order], first, axis=0) / counts[:, None]
        near = ((book**2).sum(1) - 2 * rest @ book.T).argmin(1)
        rest = rest - book[near]
        out.append(book)
    return Codebooks(out)


def usable(column: str) -> Column:
    wrong = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(column).isNotNull() & ~wrong & F.exists(column, lambda v: v != 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64).reshape(len(column), -1)


def scaled(v: Column) -> Column:
    """The vector over a power of two near its largest component: the same digits, safe to multiply."""
    largest = F.array_max(F.transform(v, F.abs))
    by = F.pow(F.lit(2.0), F.floor(F.log2(largest)))
    return F.transform(v, lambda x: x / by)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """In double precision, for vectors from ``scaled``."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(cid, vector, ids): equal vectors once, with their ``most`` smallest ids and a number of their own, written."""
    first = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= most)
    own = first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return written(own.select(F.monotonically_increasing_id().alias("cid"), "vector", "ids"), "vectors")


def code_block(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, codes and lengths of one row of blocks."""
    ids, code, lengths = (np.frombuffer(batch.column(i)[row].as_py(), dtype=t) for i, t in ((0, np.int64), (1, np.uint8), (2, np.float64)))
    return ids, code.reshape(len(ids), -1), lengths.reshape(len(ids), 2)


def enough(model: Broadcast, queries: DataFrame, every: DataFrame, codes: DataFrame, k: int) -> int:
    """How many codes a shortlist needs, by the ranks of the true neighbours of some ``queries`` among all codes.

    Only ``PROBES`` queries and their ``k`` nearest pass through the driver, whatever the number of vectors.
    """
    probes = queries.orderBy(F.xxhash64("qid", F.lit(3)), "qid").limit(PROBES).collect()
    if not probes:
        return 0
    own, given = np.array([r["qid"] for r in probes]), np.array([r["vector"] for r in probes], dtype=np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = unit(given)
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            # Half the square of the distance; from the mean, so near vectors differ in more digits than by their products.
            at, centre = unit(x) - model.value.mean, asked - model.value.mean
            s = np.where(ids[None, :] == own[:, None], -np.inf, centre @ at.T - (at**2).sum(axis=1) / 2)
            keep = min(k, len(ids))
            best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            code = model.value.encode(x[best.ravel()])
            guess = [model.value.estimates(model.value.placed(given[p : p + 1]), *(c[p * keep : (p + 1) * keep] for c in code))[0] for p in range(len(own))]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(own), dtype=np.int32), keep)), pa.array(np.take_along_axis(s, best, 1).ravel()), pa.array(np.concatenate(guess))], ["p", "s", "estimate"])

    true = every.select("cid", "vector").mapInArrow(nearest, "p int, s double, estimate double").where(F.col("s") > float("-inf"))
    first = true.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy(F.col("s").desc()))).where(F.col("n") <= k)
    marks: list[list[float]] = [[] for _ in probes]
    for r in first.collect():
        marks[r["p"]].append(r["estimate"])

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = model.value.placed(given)
        for batch in batches:
            for row in range(batch.num_rows):
                _, code, lengths = code_block(batch, row)
                for p, mark in enumerate(marks):
                    s = model.value.estimates(asked[p : p + 1], code, lengths)[0]
                    yield pa.RecordBatch.from_pydict({"p": [p] * len(mark), "j": list(range(len(mark))), "n": [int((s >= m - 1e-9 * abs(m)).sum()) for m in mark]}, pa.schema([("p", pa.int32()), ("j", pa.int32()), ("n", pa.int64())]))

    ranks = [r[0] for r in codes.mapInArrow(above, "p int, j int, n long").groupBy("p", "j").agg(F.sum("n").alias("n")).select("n").collect()]
    return int(np.ceil(SPARE * np.quantile(ranks, HELD))) + 1 if ranks else 0


def search(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", shortlist: int = SHORTLIST, books: int = BOOKS) -> DataFrame:
    """For each row of ``vectors`` that ``queries`` selects, its ``k`` nearest other rows.

    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    sound = vectors.where(F.col(id_column).isNotNull() & usable(vector_column))
    order = [F.xxhash64(F.col(id_column), F.lit(1)), F.col(id_column)]
    sample = [r[0] for r in sound.orderBy(*order).select(F.col(vector_column)).limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], out)
    sizes = [len(v) for v in sample]
    dimension = max(sorted(set(sizes)), key=sizes.count)
    model = spark.sparkContext.broadcast(coder(np.array([v for v in sample if len(v) == dimension], dtype=np.float64), books))

    double = F.col(vector_column).cast("array<double>")
    rows = sound.where(F.size(vector_column) == dimension).select(F.col(id_column).cast("long").alias("id"), scaled(double).alias("vector"), queries.alias("asked"))
    every = distinct_vectors(rows.select("id", "vector"), k + 1)
    chosen = rows.where("asked").select("id", "vector").distinct().join(every.select("cid", "vector"), "vector")
    asked = written(chosen.select(F.col("id").alias("query_id"), F.col("cid").alias("qid"), "vector"), "queries")
    distinct_queries = asked.select("qid", "vector").dropDuplicates(["qid"])
    n_blocks = max(1, -(-distinct_queries.count() // min(QUERY_BLOCK, max(64, BLOCK_BYTES // (8 * dimension)))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            columns = [np.concatenate([h[i] for h in held]) for i in range(4)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], ["ids", "codes", "lengths", "vectors"])

        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                some = batch.slice(a, 2048)
                x = matrix(some.column(1))
                held.append((some.column(0).to_numpy(), *model.value.encode(x), x))
                if sum(len(h[0]) for h in held) >= min(CODE_BLOCK, BLOCK_BYTES // (8 * dimension)):
                    yield block()
        if held:
            yield block()

    codes = written(every.select("cid", "vector").mapInArrow(encode, "ids binary, codes binary, lengths binary, vectors binary"), "codes")
    shortlist = max(shortlist, enough(model, distinct_queries, every, codes.drop("vectors"), k))
    parts = max(1, -(-codes.count() // n_blocks))
    spread = F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")
    left = codes.withColumns({"s": spread, "q": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))})
    block_of = F.pmod(F.xxhash64("qid", F.lit(2)), F.lit(n_blocks)).cast("int")
    blocks = distinct_queries.withColumn("q", block_of).groupBy("q").agg(F.collect_list("qid").alias("qids"), F.flatten(F.collect_list("vector")).alias("parts"))
    right = blocks.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    few = 2 * (k + 1)  # one for the query itself, and as many again for the order of sums

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, code, lengths = code_block(batch, row)
                vectors = np.frombuffer(batch.column(3)[row].as_py()).reshape(len(ids), -1)
                qids = batch.column(4)[row].values.to_numpy()
                given = batch.column(5)[row].values.to_numpy().reshape(len(qids), -1)
                placed, asked_for = model.value.placed(given), unit(given)
                for a in range(0, len(qids), 64):
                    s = model.value.estimates(placed[a : a + 64], code, lengths)
                    keep = min(shortlist, len(ids))
                    best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                    for q, own in enumerate(best, a):
                        near = unit(vectors[own]) @ asked_for[q]
                        least = np.partition(near, -few)[-few] if len(near) > few else -np.inf
                        top = near >= least - ROUNDING
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(top.sum(), qids[q])), pa.array(ids[own[top]]), pa.array(near[top])], ["qid", "cid", "near"])

    near = left.join(right, ["q", "s"]).select("ids", "codes", "lengths", "vectors", "qids", "parts").mapInArrow(score, "qid long, cid long, near double")
    by_near = Window.partitionBy("qid").orderBy(F.round("near", 12).desc())
    short = near.withColumn("n", F.rank().over(by_near)).where(F.col("n") <= few).select("qid", "cid")
    # The query's own class always takes part: it holds the query's copies.
    short = short.unionByName(distinct_queries.select("qid", F.col("qid").alias("cid"))).distinct()
    pairs = short.join(distinct_queries.withColumnRenamed("vector", "own"), "qid").join(every, "cid")
    exact = pairs.select("qid", "ids", cosine(F.col("own"), F.col("vector")).alias("score"))
    by_score = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    single = exact.select("qid", "score", F.explode("ids").alias("vec_id")).groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    best = single.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1)
    answers = asked.select("query_id", "qid").join(best.select("qid", "vec_id", "score"), "qid").where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(final))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
