"""Stupid-backoff language-model scores with n-gram counts over all documents.

The score of a word after its two predecessors is the 3-gram's count over the 2-gram's if the 3-gram occurs at
least ``min_count`` times; else ``alpha`` times the 2-gram's count over the word's before it, by the same rule; else
``alpha`` times ``alpha`` times its share of all words. The first word of a document has its share, the second
backs off from its 2-gram. A document's score is the sum of the logarithms.

Relational form. Each place is a row with its word ``b``, the word before it ``a`` and the word after it ``c``. Every
count that the places (.., a, b) and (a, b, c) need counts rows that have the same ``b``: b itself, (a, b), (b, c) and
(a, b, c). So the exploded n-grams are dealt by a hash to as many tasks as keep each small; the count tables of its keys are made in
arrays in the task in which all rows of those keys lie, and joined there to the n-grams that they count without another
shuffle. The terms are summed by document.

A frequent word would gather in one task, so the key is as long as it must be: the rows of a frequent word are dealt
by its 2-grams, and those of a frequent 2-gram by the 3-gram. Which
n-grams are frequent comes from a sample of ``SAMPLE`` places; there can be only about ``SHARE`` of each length. Their counts
are exact, over all documents, and are broadcast; a wrong guess would cost time and change no result. Places whose n-grams
are all frequent are scored where they are.

The exploded n-grams are many times the texts, so they are taken in ``SLICES`` slices of the n-grams' hashes, one after
another, each leaving one row for each document. This bounds the disk that shuffles need and leaves out nothing.

Defined cases: words are lower-case and separated by white space, told apart by 64-bit hashes; null and empty texts have
no words and the score 0; copies count as often as they occur; repeated and null ids keep their rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, whole_text, written
from .words import WordHasher, mix

ALPHA = 0.4
MIN_COUNT = 2
#: Places in the sample that tells which n-grams are frequent, and the part of it that makes one so.
SAMPLE = 1 << 22
SHARE = 16_384
SLICES = 5
#: Words that a task looks at together.
STEP = 1 << 18
#: Places whose questions a task answers, on the average: a slice is dealt to as many tasks as that takes, so each holds its rows at once.
PLACES = 1 << 19
#: Terms of a document that such a task adds itself, so the rows that it leaves to Spark's sums grow with its questions.
ADDED = 4
#: Words of some documents that leave a task together.
BATCH = 1 << 24
#: Bits of a key that find its place among known ones.
LEADING = 18
#: Terms are summed as two whole numbers of these units: large terms of opposite sign cancel exactly, in any order.
WHOLE, PART = 1 << 20, 1 << 32
#: Stand for what is before the first and after the last word.
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
#: Bits of ``kind``.
AHEAD, FIRST, SECOND, LAST = 1, 2, 4, 8
#: What a question's key is; beside ``kind`` in ``what``, before the places of two frequent n-grams in their table (0: none).
WORD, PAIR, THREE = 0, 16, 32
PLACE_BITS = 28

#: A document's words are the hashes in order, 8 bytes each.
WORDS = "doc_id long, n_tokens int, words binary"
ASKED = "row long, key long, prev long, next long, what long"
SUMS = "row long, whole long, part long, full long"


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x * np.uint64(0x2545F4914F6CDD1D) + y)


@dataclass(frozen=True)
class Known:
    """Exact counts of some n-grams."""

    keys: np.ndarray
    counts: np.ndarray

    @cached_property
    def begins(self) -> np.ndarray:
        """Where the keys with each sequence of leading bits begin."""
        lead = (self.keys >> np.uint64(64 - LEADING)).astype(np.int64)
        return np.concatenate([[0], np.cumsum(np.bincount(lead, minlength=1 << LEADING))])

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The places of ``keys`` among the known ones from 1, 0 for those that are not among them."""
        out = np.zeros(len(keys), np.int64)
        lead = (keys >> np.uint64(64 - LEADING)).astype(np.int64)
        at, end = self.begins[lead], self.begins[lead + 1]
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], keys[left]
        while len(left):
            hit = self.keys[at] == wanted
            out[left[hit]] = at[hit] + 1
            at += 1
            on = ~hit & (at < end)
            left, at, end, wanted = left[on], at[on], end[on], wanted[on]
        return out

    @cached_property
    def from_places(self) -> np.ndarray:
        return np.concatenate([[0], self.counts]).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The counts of ``keys``, 0 for those that are not among them."""
        return self.from_places[self.places(keys)]


@dataclass(frozen=True)
class Places:
    """The places of some documents: own, last and next word, keys of their n-grams, and where they stand."""

    row: np.ndarray
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    ab: np.ndarray
    abc: np.ndarray
    at: np.ndarray
    last: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return self.at == 0

    @property
    def bc(self) -> np.ndarray:
        """Meaningless at the last word."""
        return np.roll(self.ab, -1)


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[Places]:
    """Batches of (row, words), some whole documents at a time."""
    for batch in batches:
        words = batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        flat = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: offsets[-1]].view(np.uint64)
        offsets = offsets // 8
        rows = batch.column(0).to_numpy()
        k = 0
        while k < len(rows):
            end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + STEP, "right")) - 1)
            own, sizes = flat[offsets[k] : offsets[end]], np.diff(offsets[k : end + 1])
            if len(own):
                begin = np.repeat(offsets[k:end] - offsets[k], sizes)
                at = np.arange(len(own)) - begin
                last = at == np.repeat(sizes, sizes) - 1
                a, c = np.where(at == 0, START, np.roll(own, 1)), np.where(last, END, np.roll(own, -1))
                ab = joined(a, own)
                yield Places(np.repeat(rows[k:end], sizes), a, own, c, ab, joined(ab, c), at, last)
            k = end


def batch_of(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for k, v in columns.items()})


def hashed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as (row, doc_id, n_tokens, words), each row with a number of its own, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                words, starts = hasher(some.column(1).to_pylist())
                sizes, k = pa.array(np.diff(starts), pa.int32()), 0
                while k < len(sizes):  # a batch holds less than 2 GB
                    end = max(k + 1, int(np.searchsorted(starts, starts[k] + BATCH, "right")) - 1)
                    offsets = ((starts[k : end + 1] - starts[k]) * 8).astype(np.int32)
                    bodies = pa.Array.from_buffers(pa.binary(), end - k, [None, pa.py_buffer(offsets), pa.py_buffer(words[starts[k] : starts[end]])])
                    yield pa.RecordBatch.from_arrays([some.column(0)[k:end], sizes[k:end], bodies], ["doc_id", "n_tokens", "words"])
                    k = end

    return written(docs.mapInArrow(run, WORDS).select(F.monotonically_increasing_id().alias("row"), "*"), "ngram-words", compression="zstd")


def frequent(words: DataFrame, total: int, sample: int, share: int) -> Known:
    """The n-grams that hold more than one in ``share`` of a sample of places, with their counts over all places."""
    bound = np.uint64(min(2.0**64 - 2048, max(1.0, sample / max(total, 1) * 2.0**64)))

    def keys_in(p: Places, chosen: np.ndarray) -> Iterator[np.ndarray]:
        yield p.b[chosen]
        yield p.ab[chosen & ~p.first]
        yield p.abc[chosen & ~p.first & ~p.last]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in places(batches):
            chosen = joined(p.row.view(np.uint64), p.at.view(np.uint64)) <= bound
            yield batch_of(key=np.concatenate(list(keys_in(p, chosen))))

    least = max(1, min(sample, total) // share)
    found = words.mapInArrow(sampled, "key long").groupBy("key").count().where(F.col("count") > least)
    guessed = np.sort(np.array([r[0] for r in found.collect()], dtype=np.int64).view(np.uint64))
    known = Known(guessed, np.zeros(len(guessed), np.int64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(guessed) + 1, np.int64)
        for p in places(batches):  # the sample has each n-gram at its middle or last word, so a frequent one lies at a frequent word
            on = known.places(p.b)
            counts += np.bincount(on, minlength=len(counts))
            at = np.flatnonzero((on > 0) & ~p.first)
            on = known.places(p.ab[at])
            counts += np.bincount(on, minlength=len(counts))
            at = at[(on > 0) & ~p.last[at]]
            counts += np.bincount(known.places(p.abc[at]), minlength=len(counts))
        used = np.flatnonzero(counts[1:])
        yield batch_of(key=guessed[used], n=counts[1:][used])

    exact = words.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    exact = sorted((int(np.int64(r["key"]).view(np.uint64)), r["n"]) for r in exact)
    return Known(np.array([k for k, _ in exact], np.uint64), np.array([n for _, n in exact], np.int64))


@dataclass(frozen=True)
class Routed:
    """What is known of each place, and which of its two questions must be asked elsewhere."""

    n_word: np.ndarray
    n_back: np.ndarray
    n_ahead: np.ndarray
    n_three: np.ndarray
    ask_back: np.ndarray
    ask_ahead: np.ndarray


def routed(p: Places, known: Known) -> Routed:
    n_word = known(p.b)
    n_back = np.zeros(len(p.b), np.int64)
    maybe = np.flatnonzero(~p.first & (n_word > 0))
    n_back[maybe] = known(p.ab[maybe])
    n_ahead = np.where(p.last, 0, np.roll(n_back, -1))
    n_three = np.zeros(len(p.b), np.int64)
    maybe = np.flatnonzero((n_back > 0) & ~p.first & ~p.last)
    n_three[maybe] = known(p.abc[maybe])
    back_known = (n_word > 0) & (p.first | (n_back > 0) & (p.last | (n_three > 0)))
    ahead_known = (n_word > 0) & (p.last | (n_ahead > 0) & (p.first | (n_three > 0)))
    return Routed(n_word, n_back, n_ahead, n_three, ~back_known, ~ahead_known)


def kinds(p: Places, on: np.ndarray) -> np.ndarray:
    at = p.at[on]
    return (at == 0) * FIRST + (at == 1) * SECOND + p.last[on] * LAST


def by_word(p: Places, known: Known, chosen: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple]:
    """One question for each place of a word that isn't frequent, between ``prev`` and ``next``."""
    on = np.flatnonzero(chosen(p.b))
    on = on[known.places(p.b[on]) == 0]
    yield p.row[on], p.b[on], p.a[on], p.c[on], kinds(p, on) | WORD


def by_pair(p: Places, known: Known, chosen: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple]:
    """One question for each 2-gram (x, y) that isn't frequent and has a frequent word, between ``prev`` and ``next``.

    It answers what y asks looking back and what x asks looking ahead, as far as they are frequent.
    """
    on = np.flatnonzero(~p.first & chosen(p.ab))
    x, y = known.places(p.a[on]), known.places(p.b[on])
    open_ = ((x > 0) | (y > 0)) & (known.places(p.ab[on]) == 0)
    on, x, y = on[open_], x[open_], y[open_]
    prev = np.where(p.at[on] == 1, START, p.a[on - 1])  # the word before a document's second word is its first one
    yield p.row[on], p.ab[on], prev, p.c[on], packed(kinds(p, on) | PAIR, x, y)


def by_three(p: Places, known: Known, chosen: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple]:
    """At most two questions for each place of a frequent word, one for each frequent 2-gram in a 3-gram that isn't frequent."""
    on = np.flatnonzero(~p.first & ~p.last & chosen(p.abc))
    word = known.places(p.b[on])
    on, word = on[word > 0], word[word > 0]
    back, ahead_ = known.places(p.ab[on]), known.places(p.bc[on])
    open_ = np.flatnonzero((back > 0) | (ahead_ > 0))
    open_ = open_[known.places(p.abc[on[open_]]) == 0]
    on, word = on[open_], word[open_]
    for ahead, pair in ((0, back[open_]), (AHEAD, ahead_[open_])):
        at, none = on[pair > 0], np.zeros(np.count_nonzero(pair), np.uint64)
        yield p.row[at], mix(p.abc[at] ^ np.uint64(ahead)), none, none, packed(kinds(p, at) | THREE | ahead, word[pair > 0], pair[pair > 0])


def packed(what: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return what | one << 6 | other << (6 + PLACE_BITS)


def asked(known: Known, slice_no: int, slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The questions of one slice as rows, in one pass over the words."""

    def chosen(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(8)) % np.uint64(slices) == slice_no

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in places(batches):
            parts = [x for form in (by_word, by_pair, by_three) for x in form(p, known, chosen)]
            row, key, prev, next_, what = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield batch_of(row=row, key=key, prev=prev, next=next_, what=what)

    return run


def rows_of(keys: np.ndarray) -> np.ndarray:
    """How many rows have the same key: the count table of the keys, joined to their rows."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(begins, len(keys)))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def log(n: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(n, 1))


@dataclass(frozen=True)
class Terms:
    """What questions add to the scores of their documents, and how many full matches they find."""

    alpha: float
    min_count: int
    total: int

    def share(self, steps: np.ndarray, word: np.ndarray) -> np.ndarray:
        return steps * math.log(self.alpha) + log(word) - math.log(max(self.total, 1))

    def back(self, word: np.ndarray, pair: np.ndarray, three: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """What a place asks looking back: its own share if its 2-gram is too rare, and the context of the place behind it."""
        first, second, last = (kind & bit != 0 for bit in (FIRST, SECOND, LAST))
        share = np.where(first | (pair < self.min_count), self.share(np.where(first, 0, np.where(second, 1, 2)), word), 0.0)
        return share - np.where(~first & ~last & (three >= self.min_count), log(pair), 0.0)

    def ahead(self, word: np.ndarray, pair: np.ndarray, three: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a place asks looking ahead: the place behind it by its 3-gram, else by its 2-gram; and whether that is a full match."""
        first, last = (kind & bit != 0 for bit in (FIRST, LAST))
        whole = ~first & ~last & (three >= self.min_count)
        by_pair = np.where(first, 0.0, math.log(self.alpha)) + log(pair) - log(word)
        value = np.where(last, 0.0, np.where(whole, log(three), np.where(pair >= self.min_count, by_pair, 0.0)))
        return value, whole | first & ~last & (pair >= self.min_count)

    def of_words(self, key: np.ndarray, prev: np.ndarray, next_: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = joined(prev, key)
        word, pair, three = rows_of(key), rows_of(before), rows_of(joined(before, next_))
        value, full = self.ahead(word, rows_of(joined(key, next_)), three, kind)
        return self.back(word, pair, three, kind) + value, full.astype(np.int64) + (kind & FIRST != 0)

    def of_pairs(self, key: np.ndarray, prev: np.ndarray, next_: np.ndarray, kind: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair, before, behind = rows_of(key), rows_of(joined(prev, key)), rows_of(joined(key, next_))
        step, often = math.log(self.alpha), pair >= self.min_count
        second, last = (kind & bit != 0 for bit in (SECOND, LAST))
        back = np.where(often, 0.0, self.share(np.where(second, 1, 2), n_y)) - np.where(~last & (behind >= self.min_count), log(pair), 0.0)
        whole = ~second & (before >= self.min_count)
        ahead = np.where(whole, log(before), np.where(often, np.where(second, 0.0, step) + log(pair) - log(n_x), 0.0))
        return np.where(n_y > 0, back, 0.0) + np.where(n_x > 0, ahead, 0.0), (n_x > 0) & (whole | second & often)

    def of_threes(self, key: np.ndarray, kind: np.ndarray, n_word: np.ndarray, n_pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        three, ahead = rows_of(key), kind & AHEAD != 0
        value, full = self.ahead(n_word, n_pair, three, kind)
        return np.where(ahead, value, self.back(n_word, n_pair, three, kind)), ahead & full


def summed(row: np.ndarray, value: np.ndarray, full: np.ndarray, most: int = 1 << 62) -> pa.RecordBatch:
    """Terms by row, in whole numbers, at most ``most`` of them in each sum."""
    order = np.argsort(row, kind="stable")
    row, value, full = row[order], value[order] * WHOLE, full[order].astype(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (np.arange(1, len(row)) % most == 0)
    begins = np.flatnonzero(new)
    whole = np.floor(value)
    parts = {"whole": whole.astype(np.int64), "part": np.floor((value - whole) * PART).astype(np.int64), "full": full}
    return batch_of(row=row[begins], **{k: np.add.reduceat(v, begins) if len(v) else v for k, v in parts.items()})


def answered(words: DataFrame, known: Known, slice_no: int, slices: int, alpha: float, min_count: int, total: int) -> DataFrame:
    """Sums by row of the questions of one slice."""
    terms = Terms(alpha, min_count, total)
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, -(-total // (slices * PLACES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if held:
            row, key, prev, next_, what = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            key, prev, next_ = (x.view(np.uint64) for x in (key, prev, next_))
            value, full = np.zeros(len(row)), np.zeros(len(row), np.int64)
            sort, mask = what & (PAIR | THREE), (1 << PLACE_BITS) - 1
            for of in (WORD, PAIR, THREE):
                on = np.flatnonzero(sort == of)
                kind, (one, other) = what[on] & 15, (known.from_places[what[on] >> by & mask] for by in (6, 6 + PLACE_BITS))
                if of == WORD:
                    value[on], full[on] = terms.of_words(key[on], prev[on], next_[on], kind)
                elif of == PAIR:
                    value[on], full[on] = terms.of_pairs(key[on], prev[on], next_[on], kind, one, other)
                else:
                    value[on], full[on] = terms.of_threes(key[on], kind, one, other)
            yield summed(row, value, full, ADDED)

    rows = words.mapInArrow(asked(known, slice_no, slices), ASKED).repartition(tasks, "key")
    return rows.mapInArrow(run, SUMS).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("whole", "part", "full")))


def answered_at_once(words: DataFrame, known: Known, alpha: float, min_count: int, total: int) -> DataFrame:
    """Sums by row of the questions whose n-grams are all known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = math.log(alpha)
        for p in places(batches):
            r = routed(p, known)
            whole = ~p.first & ~p.last & (r.n_three >= min_count)
            share = np.where(p.first | (r.n_back < min_count), np.minimum(p.at, 2) * step + log(r.n_word) - math.log(max(total, 1)), 0.0)
            back = np.where(r.ask_back, 0.0, share - np.where(whole, log(r.n_back), 0.0))
            paired = ~p.last & ~whole & (r.n_ahead >= min_count)
            value = np.where(whole, log(r.n_three), np.where(paired, np.where(p.first, 0.0, step) + log(r.n_ahead) - log(r.n_word), 0.0))
            ahead = np.where(r.ask_ahead | p.last, 0.0, value)
            full = (~r.ask_back & p.first).astype(np.int64) + (~r.ask_ahead & (whole | p.first & paired))
            yield summed(p.row, back + ahead, full)

    return words.mapInArrow(run, SUMS)


def score(docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT, slices: int = SLICES, sample: int = SAMPLE, share: int = SHARE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, log_score, n_full, n_backed_off."""
    words = hashed_words(docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")))
    total = words.agg(F.sum("n_tokens")).first()[0] or 0
    bare = words.select("row", "words")
    known = frequent(bare, total, sample, share)
    sums = written(answered_at_once(bare, known, alpha, min_count, total), "ngram-sums")
    for k in range(slices):
        sums = sums.unionByName(written(answered(bare, known, k, slices, alpha, min_count, total), "ngram-sums"))
        released(docs.sparkSession)
    score_sum = (F.sum("whole") + F.sum("part") / float(PART)) / float(WHOLE)
    by_row = sums.groupBy("row").agg(score_sum.alias("score"), F.sum("full").alias("full"))
    found = words.select("row", "doc_id", F.col("n_tokens").cast("long").alias("n_tokens")).join(by_row, "row", "left")
    full = F.coalesce("full", F.lit(0)).cast("long")
    return found.select("doc_id", "n_tokens", F.coalesce("score", F.lit(0.0)).alias("log_score"), full.alias("n_full"), (F.col("n_tokens") - full).alias("n_backed_off"))
