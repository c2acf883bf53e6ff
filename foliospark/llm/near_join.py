"""N-gram Jaccard self-join by chosen paths.

Texts are sets of word 5-grams; two texts are linked when the Jaccard similarity of their sets is 0.8 or more.

1. In each run and on each level a hash function picks the shingles of a set ``x`` with probability
   ``1 / (threshold * |x|)``. Sets that picked the same shingle meet in a bucket. A bucket above ``limit`` sets
   is split again by the next level's picks; what is still large on the last level is compared block by block.
   A pair at the threshold shares ``t`` times the larger set's shingles at least, and picks each of them alike with
   probability ``1 / (t * larger)``; so it survives a level with ``1 - exp(-1)`` or more (more if the sets are of
   equal size), and the number of runs follows from that, the depth and the target recall.
2. Small buckets are compared by brute force on bottom-k sketches, which only a pair well below the threshold
   fails. Sets that may be similar get into one component.
3. Within a component all pairs are compared on their whole sets, in tiles. Links are counted with the number
   of copies of each text, and classes are the components of the exact links.

Equal texts are one set with a multiplicity, so copies are never expanded into pairs. No pair leaves a task:
tiles return one row for each set, with its number of links and a root.

Defined cases: words are lower-case and separated by white space; a text of one to four words is one shingle;
null and empty texts have no shingle, no link and a class of their own; copies (equal texts) are linked to each
other; ties in the class id go to the smallest doc_id; rows with a null id are counted as documents; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import asked_of, bitmap_of, whole_text, with_own_names, written
from .grouped import components, join_by_key, map_groups
from .words import WordHasher, mix, ngrams

N = 5
THRESHOLD = 0.8
RECALL = 0.99
LEVELS = 2
#: Sets of a bucket that is compared by brute force.
LIMIT = 1024
#: Sets of one side of a tile.
BLOCK = 1024
#: Least values of a sketch, and the probability that a similar pair shares fewer of them than ``sketch_plan`` asks for.
SKETCH, MISSED = 32, 1e-6
#: Of small sets, whose sketches are the sets, this share of what a similar pair has in common is asked for.
SMALL_SHARE = 0.875
#: Text that a task looks at together; its words and shingles take some ten times as much.
TEXT_BYTES = 512 << 10


def text_key(text: Column) -> Column:
    """128 bits of the text's hash."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def runs_needed(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold, of any two sizes, has met with probability ``recall``, at that depth."""
    once = (1 - math.exp(-1)) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def sketch_plan(threshold: float, least: int = SKETCH, missed: float = MISSED) -> tuple[int, int]:
    """How many values a sketch has, and how many of them a pair at the threshold shares but for a chance of ``missed``.

    Each of the least values of both sets together is common with a probability of the threshold, so the shared ones are
    binomial; a low threshold needs a larger sketch to share any.
    """
    size = max(least, math.ceil(math.log(missed) / math.log(1 - threshold))) if threshold < 1 else least
    need, below = 0, (1 - threshold) ** size
    while need < size and below <= missed:
        need += 1
        below += math.comb(size, need) * threshold**need * (1 - threshold) ** (size - need)
    return size, max(1, need)


def shingle_sets(texts: list[str], hasher: WordHasher, n: int = N) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, starts = hasher(texts)
    grams = ngrams(words, n)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - n + 1]) if b - a >= n else ngrams(words[a:b], b - a) if b > a else grams[:0])
    return out


def batched(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``TEXT_BYTES`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
        yield start, end
        start = end


def signatures(reps: DataFrame, runs: int, threshold: float, n: int, levels: int = LEVELS, seed: int = 17) -> DataFrame:
    """(rep, text) as (rep, size, sketch, picks): ``picks[run][level]`` are the shingles chosen there."""
    schema = "rep binary, size int, sketch array<long>, picks array<array<array<long>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (kept, _) = WordHasher(), sketch_plan(threshold)
        seeds = mix(np.arange(1, runs * levels + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        for batch in batches:
            for a, b in batched(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(a, b - a).to_pylist(), hasher, n)
                sizes = np.array([len(s) for s in sets])
                every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                owner = np.repeat(np.arange(len(sets)), sizes)
                limits = np.minimum(1 / (threshold * np.maximum(sizes, 1)), 1.0) * 2.0**64
                bound = np.minimum(limits, 2.0**64 - 2048).astype(np.uint64)[owner]
                chosen = []
                for s in seeds:
                    at = np.flatnonzero(mix(every ^ s) <= bound)
                    ends = np.searchsorted(owner[at], np.arange(len(sets) + 1)).astype(np.int32)
                    chosen.append((every[at].view(np.int64), ends))
                # interleave: for each set, its runs; for each run, its levels
                counts = np.stack([np.diff(e) for _, e in chosen], axis=1) if len(sets) else np.zeros((0, len(seeds)), int)
                flat = np.concatenate([v for v, _ in chosen])
                place = np.concatenate([np.repeat(np.arange(len(sets)) * len(seeds) + k, np.diff(e)) for k, (_, e) in enumerate(chosen)])
                flat = flat[np.argsort(place, kind="stable")]
                inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts.ravel())]).astype(np.int32)), pa.array(flat))
                middle = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * runs * levels + 1, levels, dtype=np.int32)), inner)
                outer = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * runs + 1, runs, dtype=np.int32)), middle)
                low = [s[:kept].view(np.int64) for s in sets]
                sketch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)), pa.array(np.concatenate(low) if low else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int32()), sketch, outer], ["rep", "size", "sketch", "picks"])

    return reps.mapInArrow(run, schema)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set on the left shares with each on the right."""
    va, vb = np.concatenate(left), np.concatenate(right)
    ia, ib = (np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (left, right))
    shared = np.intersect1d(va, vb)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    step = 4096  # columns at a time bound the memory
    ka, kb = np.searchsorted(shared, va), np.searchsorted(shared, vb)
    ok_a, ok_b = (k < len(shared) for k in (ka, kb))
    ok_a[ok_a] &= shared[ka[ok_a]] == va[ok_a]
    ok_b[ok_b] &= shared[kb[ok_b]] == vb[ok_b]
    ia, ka, ib, kb = ia[ok_a], ka[ok_a], ib[ok_b], kb[ok_b]
    for c in range(0, len(shared), step):
        width = min(step, len(shared) - c)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        m = (ka >= c) & (ka < c + width)
        a[ia[m], ka[m] - c] = 1
        m = (kb >= c) & (kb < c + width)
        b[ib[m], kb[m] - c] = 1
        out += a @ b.T
    return out


def roots(adjacent: np.ndarray) -> np.ndarray:
    """The least index of each node's component."""
    label = np.arange(len(adjacent))
    while True:
        new = label.copy()
        for a in range(0, len(adjacent), 512):
            new[a : a + 512] = np.minimum(new[a : a + 512], np.where(adjacent[a : a + 512], label[None, :], len(adjacent)).min(axis=1, initial=len(adjacent)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def square(sets: list[np.ndarray], similar, side: int = 512) -> np.ndarray:
    """The symmetric matrix of ``similar(overlap, rows, columns)``."""
    n = len(sets)
    out = np.zeros((n, n), dtype=bool)
    for a in range(0, n, side):
        for b in range(a, n, side):
            ra, rb = np.arange(a, min(a + side, n)), np.arange(b, min(b + side, n))
            out[a : a + side, b : b + side] = t = similar(overlaps(sets[a : a + side], sets[b : b + side]), ra, rb)
            out[b : b + side, a : a + side] = t.T
    np.fill_diagonal(out, False)
    return out


def split_lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    array = column.combine_chunks()
    offsets = array.offsets.to_numpy()
    return np.split(array.values.to_numpy()[offsets[0] : offsets[-1]], (offsets[1:-1] - offsets[0]).tolist())


def plausible(threshold: float):
    _, need = sketch_plan(threshold)

    def asked(low: np.ndarray) -> np.ndarray:
        return np.maximum(1, np.minimum(need, np.floor(SMALL_SHARE * threshold * low)))

    def work(groups: list[pa.Table]) -> pa.Table:
        """Buckets (path, i, j, rep, size, sketch) as (a, b): each set with the root of those that it may resemble."""
        a_out, b_out = [], []
        for g in groups:
            if g.num_rows < 2:
                continue
            reps, sizes, sketches = g.column("rep").to_pylist(), g.column("size").to_numpy(), split_lists(g.column("sketch"))
            if g.num_rows == 2:
                if len(np.intersect1d(*sketches, assume_unique=True)) >= asked(sizes.min()) and sizes.min() >= threshold * sizes.max() - 1e-6:
                    a_out.append(max(reps))
                    b_out.append(min(reps))
                continue

            def similar(common: np.ndarray, x: np.ndarray, y: np.ndarray, sizes=sizes) -> np.ndarray:
                low, high = np.minimum(sizes[x][:, None], sizes[y][None, :]), np.maximum(sizes[x][:, None], sizes[y][None, :])
                return (common >= asked(low)) & (low >= threshold * high - 1e-6)

            root = roots(square(sketches, similar))
            for k in np.flatnonzero(root != np.arange(len(root))).tolist():
                a_out.append(reps[k])
                b_out.append(reps[root[k]])
        return pa.table({"a": pa.array(a_out, pa.binary()), "b": pa.array(b_out, pa.binary())})

    return work


def exact_links(threshold: float):
    def work(groups: list[pa.Table]) -> pa.Table:
        """Tiles (comp, i, j, side, rep, copies, shingles) as (rep, root, links)."""
        rep_out, root_out, link_out = [], [], []
        for g in groups:
            reps, copies, block = g.column("rep").to_pylist(), g.column("copies").to_numpy(), g.column("side").to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in g.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            cross = g.column("i")[0].as_py() != g.column("j")[0].as_py()

            def similar(common: np.ndarray, x: np.ndarray, y: np.ndarray, sizes=sizes, block=block, cross=cross) -> np.ndarray:
                either = sizes[x][:, None] + sizes[y][None, :] - common
                same = common >= threshold * either - 1e-6
                return same & (block[x][:, None] != block[y][None, :]) if cross else same

            linked = square(sets, similar)
            root = roots(linked)
            rep_out += reps
            root_out += [reps[k] for k in root.tolist()]
            link_out += (linked @ copies).tolist() if len(reps) > 1 else [0]
        return pa.table({"rep": pa.array(rep_out, pa.binary()), "root": pa.array(root_out, pa.binary()), "links": pa.array(link_out, pa.int64())})

    return work


def blocks_of(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of group ``key`` (with its ``members``) dealt to all pairs of blocks that their own block belongs to."""
    many = F.greatest(F.lit(1), F.ceil(F.col("members") / size)).cast("int")
    own = df.withColumn("side", F.pmod(F.xxhash64("rep"), many).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), many - 1)))
    return own.withColumns({"i": F.least("side", "__other"), "j": F.greatest("side", "__other")}).drop("__other")


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, limit: int = LIMIT, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, rep (a key of its text), head (the text that stands for its class; null without words), class_id, n_links, class_size."""
    runs = runs_needed(recall, LEVELS)
    text = whole_text(text_column)
    own = docs.select(F.col(id_column).alias("doc_id"), text_key(text).alias("rep"), text.alias("text"))
    sig = written(signatures(own.select("rep", "text"), runs, threshold, n).dropDuplicates(["rep"]).where("size > 0"), "signatures")
    keys = written(own.select("doc_id", "rep"), "near-keys")

    picks = sig.select("rep", "picks").select("rep", F.posexplode("picks").alias("run", "levels"))
    members = picks.select("rep", "run", F.explode(F.col("levels")[0]).alias("token")).select("rep", "run", F.xxhash64(F.lit(0).cast("long"), F.col("run"), "token").alias("path"))
    found = []
    for level in range(LEVELS):
        sizes = written(members.groupBy("path").agg(F.count("*").cast("int").alias("members")).where("members > 1").withColumn("n", F.col("members")), f"sizes{level}")
        sized = written(join_by_key(members, sizes, "path", "n"), f"paths{level}")
        last = level == LEVELS - 1
        found.append(sized.where(F.lit(True) if last else F.col("members") <= limit).select("path", "rep", "members"))
        if last or not sized.where(F.col("members") > limit).limit(1).count():
            break
        deeper = sig.select("rep", F.posexplode("picks").alias("run", "levels")).select("rep", "run", F.col("levels")[level + 1].alias("next"))
        again = sized.where(F.col("members") > limit).join(deeper, ["rep", "run"]).select("rep", "run", "path", F.explode("next").alias("token"))
        members = written(again.select("rep", "run", F.xxhash64("path", "run", "token").alias("path")), f"members{level + 1}")
    buckets = found[0]
    for more in found[1:]:
        buckets = buckets.unionByName(more)
    tiles = blocks_of(buckets.join(sig.select("rep", "size", "sketch"), "rep"), "path", limit).select("path", "i", "j", "rep", "size", "sketch")
    near = map_groups(tiles, ["path", "i", "j"], plausible(threshold), "a binary, b binary").distinct()
    comp = written(components(near).select(F.col("node").alias("rep"), F.col("root").alias("comp")), "near-components")

    copies = keys.join(comp.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.count("*").alias("copies"))
    sizes = written(comp.groupBy("comp").agg(F.count("*").alias("members"), F.count("*").alias("n")), "near-sizes")
    counted = join_by_key(comp, sizes, "comp", "n").join(copies, "rep")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for a, b in batched(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(a, b - a).to_pylist(), hasher, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"])

    # The same plan at every size: the few texts that take part meet their keys in a shuffle.
    chosen = own.select("rep", "text").join(comp.select("rep").hint("merge"), "rep", "left_semi").dropDuplicates(["rep"])
    sets = chosen.mapInArrow(to_sets, "rep binary, shingles binary")
    pairs = blocks_of(counted.join(sets, "rep"), "comp", block).select("comp", "i", "j", "side", "rep", "copies", "shingles")
    linked = written(map_groups(pairs, ["comp", "i", "j"], exact_links(threshold), "rep binary, root binary, links long", batch_rows=512), "near-links")

    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "root")
    counts = keys.groupBy("rep").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    given = counts.join(links, "rep", "left").join(classes, "rep", "left")
    named = written(given.select("rep", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root")), "near-named")
    first = F.min_by("rep", F.struct(F.col("least").isNull(), "least", "rep"))
    heads = named.groupBy("root").agg(F.min("least").alias("class_id"), first.alias("head"), F.sum("copies").alias("class_size"), F.count("*").alias("texts"))
    ready = join_by_key(named, written(heads, "near-heads"), "root", "texts")
    worded = sig.select("rep", F.lit(True).alias("worded"))
    shown = ready.join(worded, "rep", "left").select("rep", "head", "class_id", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links"), "worded", "copies")
    full = join_by_key(keys, written(shown, "near-classes"), "rep", "copies")
    alone = F.col("worded").isNull()
    return full.select(
        "doc_id",
        "rep",
        F.when(~alone, F.col("head")).alias("head"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
    )


def join(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, n_links, class_size."""
    return classes(docs, **options).select("doc_id", "class_id", "n_links", "class_size")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each class the one with the least id.

    Only texts that may have to go travel: a bitmap of fixed size tells them from the rest. They meet the ids that
    stay by text and id, so the copies of one frequent text spread over all tasks.
    """
    return with_own_names(docs, partial(first_of_classes, **options), id_column=id_column, text_column=text_column)


def first_of_classes(docs: DataFrame, id_column: str, text_column: str, **options) -> DataFrame:
    found = written(classes(docs, id_column=id_column, text_column=text_column, **options).where("class_size > 1 and head is not null").select("doc_id", "rep", "head", "class_id"), "near-found")
    bitmap = written(bitmap_of(found.select("rep"), "rep"), "near-bitmap")
    stay = found.where("rep = head and doc_id <=> class_id").select(F.col("rep").alias("__stay"), F.col("doc_id").alias("__id")).distinct()
    crowded = found.select(F.col("rep").alias("__stay")).distinct()
    marked = asked_of(docs.withColumn("__rep", text_key(whole_text(text_column))), bitmap, "__maybe", "__rep")
    maybe = marked.where("__maybe").select(*docs.columns, "__rep")
    kept = maybe.join(stay.hint("merge"), (F.col("__rep") == F.col("__stay")) & F.col(id_column).eqNullSafe(F.col("__id")), "left_semi")
    # What is left of a class is its first row and wholly repeated rows, so no window partition is large.
    first = kept.withColumn("__again", F.row_number().over(Window.partitionBy("__rep").orderBy(F.col(id_column)))).where("__again = 1")
    # Texts that share a bit with another one's key.
    other = maybe.join(crowded.hint("merge"), F.col("__rep") == F.col("__stay"), "left_anti")
    parts = (marked.where(~F.col("__maybe")), first, other)
    return parts[0].select(*docs.columns).unionByName(parts[1].select(*docs.columns)).unionByName(parts[2].select(*docs.columns))
