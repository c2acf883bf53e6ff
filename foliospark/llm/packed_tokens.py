"""Token ids as a binary column store: Parquet list columns with dictionary or delta encoding.

Texts are encoded with a public tokenizer, an end id closes each document, and the ids are written in
ascending id order as ``ids array<int>`` beside small metadata columns. Row groups and pages are bounded, and
Parquet's page indexes let a reader fetch the metadata or a range of documents without touching other ids.

File format (one folder of Parquet files, ordered by ``part`` then ``doc_id``):
``part int, place long, doc_id long, n_tokens long, ids array<int>``; ``place`` counts the rows of a part.

Defined cases: a null text is empty and gets only the end id; repeated ids stay separate rows, ordered by a
hash of their texts; a null doc_id sorts first; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, whole_text

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
#: Chunks of one generation that a worker remembers; bounds its memory.
REMEMBERED = 300_000
#: Chunks that go to the library at once.
SLICE = 4_096
#: Documents that are turned into Python strings at once.
ROWS = 128
END_ID = 1
#: Controls that Python's split() takes for white space and the tokenizer's pattern doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Characters beyond the Latin, Greek and Cyrillic blocks, whose classes depend on a library's Unicode version.
FAR = re.compile("[^\x00-\u052f]")
STORE = "place long, doc_id long, n_tokens long, ids array<int>"


class ChunkEncoder:
    """Encodes texts with the tokenizers library, one white-space-free chunk at a time.

    For a tokenizer that drops white space and never joins across it, a text's ids are its chunks' ids in
    order, so each distinct chunk needs the library only once. New chunks are normalized together, split into words
    by one search, and their distinct words go through the library's model in one call; the vocabulary's word
    ends tell where each word's ids stop. Chunks that may hold an added token, and texts with unusual control
    characters, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        first, *rest = spec["pre_tokenizer"]["pretokenizers"] if spec["pre_tokenizer"]["type"] == "Sequence" else [{}]
        if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
            raise ValueError("this tokenizer's words are not what one pattern matches")
        if [r["type"] for r in rest] != ["ByteLevel"] or rest[0]["add_prefix_space"] or rest[0]["use_regex"] or not spec["model"].get("end_of_word_suffix"):
            raise ValueError("this tokenizer's words are not byte-level with marked ends")
        self.pattern = regex.compile(first["pattern"]["Regex"] + "|\n")
        self.of_words = Tokenizer(self.tokenizer.model)  # words parted by a space, already normalized
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word_ids(self, words: list[str]) -> list[bytes] | None:
        """The ids of normalized words; None if their ends can't be told."""
        ids = np.array(self.of_words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = [0, *((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] if len(cuts) == len(words) + 1 and cuts[-1] == len(raw) else None

    def chunks(self, new: list[str]) -> list[bytes]:
        """The ids of chunks without white space."""
        joined = " ".join(new)
        normal = joined.lower() if joined.isascii() else self.tokenizer.normalizer.normalize_str(joined)
        found = self.pattern.findall(normal.replace(" ", "\n"))
        if normal.count(" ") != len(new) - 1 or found.count("\n") != len(new) - 1 or any(a in joined for a in self.added):
            return self.direct(new)
        if FAR.search(normal):
            odd = " ".join(c for c in normal.split(" ") if FAR.search(c))
            if [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(odd)] != [m.span() for m in self.pattern.finditer(odd)]:
                return self.direct(new)
        own = list(dict.fromkeys(found))
        if "\n" in own:
            own.remove("\n")
        ids = self.word_ids(own)
        if ids is None:
            return self.direct(new)
        table = dict(zip(own, ids, strict=True))
        out, parts = [], []
        for piece in found:
            if piece != "\n":
                parts.append(table[piece])
            else:
                out.append(parts[0] if len(parts) == 1 else b"".join(parts))
                parts = []
        return [*out, b"".join(parts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [None if ODD_SPACE.search(t) else t.split() for t in texts]
        if len(self.known) > REMEMBERED:  # the chunks of one generation back are kept, so frequent ones stay
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        new = set().union(*filter(None, split)).difference(known)
        again = {c for c in new if c in before}
        known.update(zip(again, map(before.__getitem__, again), strict=True))
        fresh = list(new - again)
        for k in range(0, len(fresh), SLICE):  # the library's results are large
            known.update(zip(fresh[k : k + SLICE], self.chunks(fresh[k : k + SLICE]), strict=True))
        get = known.__getitem__
        return [self.direct([t])[0] if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One for each worker process, so its tasks share what was learned."""
    return ChunkEncoder(path)


def lists(parts: list[bytes]) -> pa.Array:
    """An array<int> column from little-endian 32-bit buffers."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """``docs`` (doc_id, text) as (place, doc_id, n_tokens, ids); keeps partitions and their order, which ``place`` counts."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = encoder(tokenizer_path), 0
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                some = batch.slice(k, ROWS)
                out = [x + end for x in own.encode(some.column(1).to_pylist())]
                places = pa.array(np.arange(place, place + len(out)))
                place += len(out)
                yield pa.RecordBatch.from_arrays([places, some.column(0), pa.array([len(x) // 4 for x in out], pa.int64()), lists(out)], ["place", "doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, STORE)


def write_store(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = END_ID, encoding: str = "dictionary") -> str:
    """Encode ``docs``, write the store in ascending doc_id order, and return its folder.

    ``encoding``: "dictionary", or "delta" for Parquet's second data-page version with binary-packed deltas.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    store = encoded(ordered, tokenizer_path, end_id).select(F.spark_partition_id().alias("part"), "*")
    options = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": "true" if encoding == "dictionary" else "false", "parquet.writer.version": "v1" if encoding == "dictionary" else "v2", "compression": "zstd"}
    store.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)
    return path


def read_store(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The store's columns; naming some reads no others."""
    return spark.read.schema(f"part int, {STORE}").parquet(path).select(*(columns or ("*",)))


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Documents ``first`` to ``last``; page indexes skip the pages of all others."""
    return read_store(spark, path).where(F.col("doc_id").between(first, last))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document: doc_id, start, n_tokens, ids_crc32; ``start`` counts ids before it."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            raw = memoryview(ids.flatten().to_numpy().astype("<i4", copy=False).view(np.uint8))  # no copy of the ids
            cuts = [0, *(np.cumsum(batch.column(3).to_numpy()) * 4).tolist()]
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(crc, pa.int64())], ["part", "place", "doc_id", "n_tokens", "ids_crc32"])

    rows = read_store(spark, path).mapInArrow(sums, "part int, place long, doc_id long, n_tokens long, ids_crc32 long")
    parts = read_store(spark, path, "part", "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    # One row for each part, of which there are as many as tasks wrote: a single small window.
    before = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("before"))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).cast("long").alias("start"), "n_tokens", "ids_crc32")
