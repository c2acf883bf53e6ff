"""Packing documents into windows of fixed width by the sum-of-squares rule, online and without a shuffle.

Each task encodes its documents with a public byte-level tokenizer, closes each with an end id, and packs them as they come. A
document's whole windows stand alone. Its rest goes on top of the open windows of one fill level, or into a new window: the level is
chosen that makes the sum over all levels of (number of open windows with this fill) squared least; among equals the fullest.
One array holds these numbers by level, another the open windows. At a task's end, and whenever its open windows hold
``OPEN_IDS`` ids, the emptiest windows fill the gaps of the fullest ones, cut where they must be, and the last rest is cut into
sequences whose lengths are powers of two, which need no padding. So no sequence is padded, and hardly any document is cut twice.

Result: one row for each piece, ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``; ``ids`` are little-endian unsigned
32-bit integers; ``sequence_id`` is the task's number times 2**32 plus a count. ``docs`` should be a table, so that a task that is
run again after the loss of an executor sees the same rows in the same order.

Defined cases: a null text is empty and gives the end id alone; repeated rows are packed one by one; a null doc_id stays null; an
empty table gives no piece; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed_tokens import END_ID, ODD_SPACE

WIDTH = 2_048
#: Ids that open windows of one task may hold (4 bytes each) before all are closed.
OPEN_IDS = 4 << 20
#: Units of one generation that a worker remembers, and the characters of the longest of them.
REMEMBERED, LONGEST = 400_000, 128
#: Units that go to the library at once; characters that are encoded at once.
SLICE, PART = 4_096, 1 << 20
#: White space and what follows it up to the next white space: the tokenizer's words never reach across the end of one.
UNIT = re.compile(r"\s*\S+")
#: Marks that are a word of their own behind a letter, and the letters for which every library's tables agree.
MARKS, NEAR = ".,;:!?", "\u0530"
NEAR_LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ʯͰ-ϿЀ-ԯ]+").fullmatch
#: Leads the key of a unit that doesn't begin with a space; no text holds this character.
BARE = "\ud800"
#: A place where a long text may be cut, whatever a library takes for white space.
BORDER = re.compile(r"(?<=[!-~])[ \n](?=[!-~])")
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
ROWS = 1_024


class UnitEncoder:
    """Encodes texts with the tokenizers library, each distinct unit once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("this tokenizer's words may reach across white space")
        if any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError("an added token of this tokenizer takes white space")
        self.added = [t["content"] for t in spec["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]  # one character a byte
        # The model's own view of text: each byte is a character, printable ones themselves, the others from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in printable]
        self.byte_letters = {b: 256 + k for k, b in enumerate(others) if b != ord("\n")}
        self.of_words = Tokenizer(self.tokenizer.model)
        self.of_words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.marks = dict(zip(MARKS, self.library(list(MARKS)), strict=True))
        self.known: dict[str, bytes | None] = {BARE: b""}
        self.before: dict[str, bytes | None] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, ids: list[int], units: list[str]) -> list[bytes] | None:
        """The ids of units that were encoded in one go; the ids' bytes tell where each ends. None if they don't."""
        own = np.array(ids, dtype="<u4")
        ends, want = np.cumsum(self.bytes_of[own]), np.cumsum([len(u.encode()) for u in units])
        cuts = np.searchsorted(ends, want)
        if len(ends) <= cuts[-1] or not np.array_equal(ends[cuts], want):
            return None
        raw, at = own.tobytes(), [0, *((cuts + 1) * 4).tolist()]
        return [raw[i:j] for i, j in zip(at, at[1:])]  # noqa: B905

    def units(self, new: list[str]) -> list[bytes]:
        """The ids of units that begin with white space and end with none."""
        out: dict[str, bytes] = {}
        for k in range(0, len(new), SLICE):  # the library's results are large
            some = new[k : k + SLICE]
            ids = self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids
            out.update(zip(some, self.cut(ids, some) or self.library(some), strict=True))
        return [out[u] for u in new]

    def words(self, new: list[str]) -> list[bytes]:
        """The ids of a space and ``new``, which are letters: single words for the tokenizer, so its model gets them parted by newlines."""
        out: dict[str, bytes] = {}
        space = chr(self.byte_letters[ord(" ")])
        for ascii in (True, False):
            own = [w for w in new if w.isascii() == ascii]
            for k in range(0, len(own), SLICE):
                some = own[k : k + SLICE]
                mapped = space + f"\n{space}".join(some) if ascii else "\n".join([f" {w}" for w in some]).encode().decode("latin-1").translate(self.byte_letters)
                led = [f" {w}" for w in some]
                out.update(zip(some, self.cut(self.of_words.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, led) or self.library(led), strict=True))
        return [out[w] for w in new]

    def learn(self, keys: set[str]) -> list[str]:
        """Make all keys known and return the new ones. A key is a unit without its first space, or ``BARE`` and a unit.

        A unit that ends in white space, or holds a control that Python takes for it, can't be told from its neighbours: None.
        """
        known, before = self.known, self.before
        new = keys.difference(known)
        again = {k for k in new if k in before}
        known.update((k, before[k]) for k in again)
        new -= again
        unclear = {k for k in new if not k or k[-1].isspace()}
        if ODD_SPACE.search("".join(new)):
            unclear |= {k for k in new if ODD_SPACE.search(k)}
        known.update(dict.fromkeys(unclear))
        new -= unclear
        marked = {k for k in new if k[-1] in MARKS and k[-2:-1].isalpha() and k[-2] < NEAR}
        fresh = (new - marked) | {k[:-1] for k in marked}.difference(known)
        plain = [k for k in fresh if NEAR_LETTERS(k) and k.isalpha()]
        known.update(zip(plain, self.words(plain), strict=True))
        fresh.difference_update(plain)
        led = [k for k in fresh if k[0] != BARE or k[1] == "\n"]
        known.update(zip(led, self.units([k[1:] if k[0] == BARE else f" {k}" for k in led]), strict=True))
        bare = list(fresh.difference(led))
        known.update(zip(bare, self.library([k[1:] for k in bare]), strict=True))
        known.update((k, known[k[:-1]] + self.marks[k[-1]]) for k in marked)
        return [*new, *plain, *fresh]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; together they should have about ``PART`` characters."""
        if len(self.known) > REMEMBERED:  # the units of one generation back are kept, so frequent ones stay
            self.before, self.known = self.known, {BARE: b""}
        bodies = [t.rstrip() for t in texts]
        split = [b.replace("\n", f" {BARE}\n").split(" ") for b in bodies]
        for words in split:
            words[0] = BARE + words[0]
        learnt = self.learn(set().union(*split))
        get, out = self.known.__getitem__, []
        for text, body, words in zip(texts, bodies, split, strict=True):
            ids = None
            if not any(a in text for a in self.added):
                try:
                    ids = b"".join(map(get, words))
                except TypeError:  # white space beside other white space
                    words = [u[1:] if u[0] == " " else BARE + u for u in UNIT.findall(body)]
                    learnt += self.learn(set(words))
                    with suppress(TypeError):
                        ids = b"".join(map(get, words))
            tail = text[len(body) :]
            out.append(self.library([text])[0] if ids is None or ODD_SPACE.search(tail) else ids + self.library([tail])[0] if tail else ids)
        for k in learnt:
            if len(k) > LONGEST:
                self.known.pop(k, None)
        return out

    def whole(self, text: str) -> bytes:
        """The ids of one text of any length, by parts."""
        return b"".join(self.encode([p])[0] for p in parts(text))


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut before white space only."""
    start = 0
    while len(text) - start > size and (found := BORDER.search(text, start + size)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


@lru_cache(maxsize=2)
def unit_encoder(path: str) -> UnitEncoder:
    """One for each worker process, so its tasks share what was learned."""
    return UnitEncoder(path)


Piece = tuple  # (document, start, ids)


class Window:
    """An open window: its pieces from the left, and how many ids they have."""

    __slots__ = ("fill", "pieces")

    def __init__(self) -> None:
        self.pieces: list[Piece] = []
        self.fill = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece[2]) // 4


class SumOfSquares:
    """The online rule; ``add`` and ``close`` return the windows that are done."""

    def __init__(self, width: int = WIDTH, open_ids: int = OPEN_IDS):
        self.width, self.open_ids, self.held = width, open_ids, 0
        self.levels = np.zeros(width + 1, dtype=np.int64)  # open windows of each fill
        self.open: list[list[Window]] = [[] for _ in range(width)]
        # What the sum changes by when a window leaves a level, or reaches one. A new window leaves none, a full one reaches none.
        self.leave = np.full(width + 1, np.iinfo(np.int64).max // 4)
        self.leave[0] = 0
        self.reach = np.ones(width + 1, dtype=np.int64)
        self.reach[width] = 0

    def counted(self, level: int, change: int) -> None:
        if 0 < level < self.width:
            n = self.levels[level] = self.levels[level] + change
            self.leave[level] = 1 - 2 * n if n else np.iinfo(np.int64).max // 4
            self.reach[level] = 1 + 2 * n

    def best(self, size: int) -> int:
        """The level on which a piece of ``size`` ids is put."""
        cost = self.leave[: self.width - size + 1] + self.reach[size:]
        return self.width - size - int(np.argmin(cost[::-1]))

    def add(self, document: object, ids: bytes) -> Iterator[list[Piece]]:
        at, step = 0, 4 * self.width
        while len(ids) - at >= step:
            yield [(document, at // 4, ids[at : at + step])]
            at += step
        if size := (len(ids) - at) // 4:
            level = self.best(size)
            window = self.open[level].pop() if level else Window()
            window.add((document, at // 4, ids[at:]))
            self.counted(level, -1)
            self.held += size
            if window.fill == self.width:
                self.held -= self.width
                yield window.pieces
            else:
                self.open[window.fill].append(window)
                self.counted(window.fill, 1)
        if self.held > self.open_ids:
            yield from self.close()

    def close(self) -> Iterator[list[Piece]]:
        """Fill the fullest windows from the emptiest, then cut the rest into powers of two."""
        rest = [w for level in range(self.width - 1, 0, -1) for w in self.open[level]]
        self.__init__(self.width, self.open_ids)
        i, j = 0, len(rest) - 1
        while i < j:
            taker, giver = rest[i], rest[j]
            document, start, ids = giver.pieces.pop()
            keep = max(0, len(ids) - 4 * (self.width - taker.fill))
            if keep:  # the end of the piece goes over
                giver.pieces.append((document, start, ids[:keep]))
            moved = (document, start + keep // 4, ids[keep:])
            taker.add(moved)
            giver.fill -= len(moved[2]) // 4
            if taker.fill == self.width:
                yield taker.pieces
                i += 1
            if not giver.fill:
                j -= 1
        for last in rest[i : i + 1] if i == j else []:
            yield from in_powers(last)


def in_powers(window: Window) -> Iterator[list[Piece]]:
    """The pieces of a window in sequences whose lengths are the powers of two that make up its fill."""
    left, out, room = window.fill, Window(), 0
    for document, start, ids in window.pieces:
        at = 0
        while at < len(ids):
            room = room or 1 << (left.bit_length() - 1)
            take = min(room * 4, len(ids) - at)
            out.add((document, start + at // 4, ids[at : at + take]))
            at, room, left = at + take, room - take // 4, left - take // 4
            if not room:
                yield out.pieces
                out = Window()


def batched(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts with about ``PART`` characters: where each begins, and its texts."""
    held: list[str] = []
    size = first = 0
    for k, value in enumerate(column):
        held.append(value.as_py())
        size += len(held[-1])
        if size >= PART:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def pack(docs: DataFrame, tokenizer_path: str, width: int = WIDTH, end_id: int = END_ID, open_ids: int = OPEN_IDS) -> DataFrame:
    """The pieces of all documents (columns ``doc_id`` and ``text``), packed task by task."""
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer, sequence = unit_encoder(tokenizer_path), SumOfSquares(width, open_ids), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def windows() -> Iterator[list[Piece]]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for first, texts in batched(batch.column(1)):
                    coded = encoder.encode(texts) if sum(map(len, texts)) < 2 * PART else map(encoder.whole, texts)
                    for key, ids in zip(keys[first:], coded):  # noqa: B905
                        ids += end
                        yield from packer.add((key, len(ids) // 4), ids)
            yield from packer.close()

        for pieces in windows():
            offset = 0
            for (key, tokens), start, ids in pieces:
                rows.append((key, start, len(ids) // 4, tokens, sequence, offset, ids))
                offset += len(ids) // 4
            sequence += 1
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECE)


def sequences(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each sequence: ``sequence_id, n_tokens, padding, ids``, the ids of its pieces in order (at most ``width``)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
    padding = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(width - F.col("n_tokens")).cast("long")
    return out.select("sequence_id", "n_tokens", padding.alias("padding"), "ids")
