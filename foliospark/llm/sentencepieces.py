"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The pieces of a public SentencePiece model form an Aho-Corasick automaton. One pass over the text follows
its output links: every piece that ends at a position relaxes the best score there, and the best path gives
the pieces with the largest sum of scores. A character that no piece covers becomes its UTF-8 bytes as byte
pieces, so decoding gives back every text exactly.

A piece has its word mark (for a space) only in front, so the best path always has a border between another
character and a space, and beside a line break, which no piece holds. Words between such borders are
segmented alone, and a word met before is looked up.

Among equal scores the path with fewer pieces wins, then the longer last piece.

Defined cases: null counts as the empty text, which has no ids; a word mark that stands in the text itself is
written as bytes, so that it doesn't turn into a space; lone surrogates can't occur in Spark strings; repeated
rows are encoded alike; an empty table gives an empty result; all input columns are kept, but one with the name of a
new column gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import adding, whole_text

MARK = "▁"
#: Score of a byte piece, below that of any ordinary piece's.
BYTE_SCORE = -1e6
#: Words of one generation that a worker remembers; it keeps two, of about 250 bytes a word, also while it works for other stages.
REMEMBERED = 250_000
#: Texts that are turned into Python strings at once.
ROWS = 512
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    def __init__(self, model_path: str, remembered: int = REMEMBERED):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        self.surface: list[bytes] = [b""] * model.get_piece_size()
        self.byte_ids = [0] * 256
        self.automaton = ahocorasick.Automaton()
        self.normal: dict[str, tuple[int, float]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.surface[i] = piece.replace(MARK, " ").encode()
                self.normal[piece] = (i, model.get_score(i))
                self.automaton.add_word(piece, (len(piece), i, model.get_score(i)))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.normal):
            raise ValueError("a piece of this model reaches over a word's border")
        self.automaton.make_automaton()
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def best(self, word: str) -> list[int]:
        """Ids of the best path over ``word``: one pass over the automaton's outputs."""
        n = len(word)
        score = [0.0] + [float("-inf")] * n
        count = [0] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        at = 1
        for end, (length, i, s) in self.automaton.iter(word):
            end += 1
            while at < end:  # positions that no piece reaches are left as bytes
                if score[at] == float("-inf"):
                    score[at], count[at], back[at] = score[at - 1] + BYTE_SCORE, count[at - 1] + 1, (at - 1, -1)
                at += 1
            begin = end - length
            total, pieces = score[begin] + s, count[begin] + 1
            if total > score[end] or total == score[end] and (pieces < count[end] or pieces == count[end] and begin < back[end][0]):
                score[end], count[end], back[end] = total, pieces, (begin, i)
        while at <= n:
            if score[at] == float("-inf"):
                score[at], count[at], back[at] = score[at - 1] + BYTE_SCORE, count[at - 1] + 1, (at - 1, -1)
            at += 1
        out: list[int] = []
        while n:
            begin, i = back[n]
            if i < 0:
                out.extend(self.byte_ids[b] for b in reversed(word[begin:n].encode("utf-8", "surrogatepass")))
            else:
                out.append(i)
            n = begin
        return out[::-1]

    def ids(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.remembered:  # the words of one generation back are kept, so frequent ones stay
                self.before, self.known = self.known, {}
            found = self.before.get(word) or np.array(self.best(word), dtype="<i4").tobytes()
            self.known[word] = found
        return found

    def literal(self) -> bytes:
        """A word mark that stands in the text itself."""
        return np.array([self.byte_ids[b] for b in MARK.encode()], dtype="<i4").tobytes()

    def line(self, text: str) -> bytes:
        """Ids of a text without line breaks."""
        if not text:
            return b""
        if MARK in text:
            return self.literal().join(self.line(part) for part in text.split(MARK))
        ids, known = self.ids, self.known
        if "  " in text or text[0] == " " or text[-1] == " ":
            return b"".join(map(ids, WORDS.findall(text.replace(" ", MARK))))
        words = text.replace(" ", " " + MARK).split(" ")
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            return b"".join(map(ids, words))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers. A leading mark is not added, so decoding is exact."""
        end = self.newline
        return end.join(map(self.line, text.split("\n")))

    @property
    def newline(self) -> bytes:
        return np.array([self.byte_ids[10]], dtype="<i4").tobytes()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def pieces(model_path: str, remembered: int = REMEMBERED) -> Pieces:
    """One automaton for each worker process."""
    return Pieces(model_path, remembered)


def lists(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def encode(docs: DataFrame, model_path: str, text_column: str = "text", verify: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` with ``piece_ids array<int>``, ``n_pieces long`` and, if ``verify``, ``round_trip boolean``."""

    @F.arrow_udf("struct<piece_ids: array<int>, n_pieces: long, round_trip: boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pieces(model_path, remembered)
        for batch in batches:
            out, same = [], []
            for k in range(0, len(batch), ROWS):
                texts = batch.slice(k, ROWS).to_pylist()
                some = [model.encode(t) for t in texts]
                out += some
                same += [model.decode(np.frombuffer(o, dtype="<i4").tolist()) == t for o, t in zip(some, texts, strict=True)] if verify else [None] * len(some)
            yield pa.StructArray.from_arrays([lists(out), pa.array([len(o) // 4 for o in out], pa.int64()), pa.array(same, pa.bool_())], ["piece_ids", "n_pieces", "round_trip"])

    new = ["piece_ids", "n_pieces", *(["round_trip"] if verify else [])]

    def with_pieces(own: DataFrame, text: str) -> DataFrame:
        return own.withColumn("encoded", run(whole_text(text))).select("*", *(f"encoded.{c}" for c in new))

    return adding(docs, with_pieces, new, text=text_column)


def decode(column: Column | str, model_path: str) -> Column:
    """The text of an ``array<int>`` column of piece ids; null for null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pieces(model_path)
        for batch in batches:
            yield pa.array([None if ids is None else model.decode(ids) for ids in batch.to_pylist()], pa.string())

    return run(F.col(column) if isinstance(column, str) else column)
