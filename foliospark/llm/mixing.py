"""Mixing sources to target weights by Pfair scheduling.

The documents of each source form blocks. In a schedule with one block per slot, block ``k`` of a source with
weight ``w`` is released at ``floor(k / w)`` and due at ``ceil((k + 1) / w)``; the earliest deadline among the
released blocks goes first. With weights that are multiples of 1/D the schedule repeats every D slots, so the
driver computes one pattern of at most D slots for each set of sources that still has blocks, and Spark places
every block by arithmetic: slot = start of its phase + cycle * D + place in the pattern. At every slot a
source's share deviates from its weight by less than one block while it lasts.

Every document is placed exactly once. A phase lasts as many whole cycles as its scarcest source allows;
a last, shorter cycle uses that source up, and the weights of the others are scaled up for the next phase.

``weights`` names sources; all others together are one pooled source with the weight that is left over (or,
if nothing is left over, they follow when all others are used up). The number of named sources is a parameter
given by the user, so nothing that the driver holds grows with the input.

Defined cases: a null source belongs to the pool; a source without documents is left out; equal and repeated
rows are placed separately; an empty table gives an empty result; other columns are kept, but an input column with
the name of a new one gives way to it in ``mix`` (``mixed`` keeps all).
"""

from __future__ import annotations

import heapq
import re
from fractions import Fraction
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import adding, with_own_names

#: Slots of one cycle; weights are rounded to multiples of its reciprocal.
CYCLE = 1024
#: Documents of one block.
BLOCK_ROWS = 4
POOL = "*"
ADDED = ["mix_source", "mix_block", "mix_slot", "mix_position"]
#: Slices of a source for ranking its documents; a slice is one window partition.
SLICES = 4096
#: Production weights: the large source is held down, a few are raised, the pool has the rest.
TARGETS = {"src0": 0.25, "src1": 0.10, "src2": 0.08, "src3": 0.07}


def shares(weights: dict[str, float], cycle: int) -> dict[str, int]:
    """Whole slots a cycle by largest remainder, at least one each."""
    if len(weights) > cycle:
        raise ValueError(f"{len(weights)} sources need a cycle of at least as many slots, not {cycle}")
    total = sum(weights.values())
    exact = {s: Fraction(w).limit_denominator(10**9) / Fraction(total).limit_denominator(10**9) * cycle for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))
    k = 0
    while sum(out.values()) < cycle:
        out[order[k % len(order)]] += 1
        k += 1
    while sum(out.values()) > cycle:
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def pattern(slots: dict[str, int]) -> list[str]:
    """The source of each slot of one cycle: earliest deadline first among released blocks."""
    total = sum(slots.values())
    waiting = [(0, s, 0) for s, n in sorted(slots.items()) if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // slots[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append(s)
        if k + 1 < slots[s]:
            heapq.heappush(waiting, ((k + 1) * total // slots[s], s, k + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], cycle: int = CYCLE) -> list[dict]:
    """The schedule as a few phases: first slot, number of cycles, and blocks of each source done before."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    at, out = 0, []
    while left:
        named = {s: weights.get(s, 0.0) for s in left}
        named = {s: w for s, w in named.items() if w > 0} or dict.fromkeys(left, 1.0)
        own = shares(named, cycle)
        for slots, times in ((own, min(left[s] // own[s] for s in own)), (None, 1)):
            slots = slots or {s: min(left[s], own[s]) for s in own if left[s]}
            if times and slots:
                out.append({"start": at, "cycles": times, "slots": slots, "before": dict(done)})
                at += times * sum(slots.values())
                for s, n in slots.items():
                    done[s] += n * times
                    left[s] -= n * times
        left = {s: n for s, n in left.items() if n}
    return out


def source_key(weights: dict[str, float], column: str = "source") -> Column:
    return F.when(F.col(column).isin(*weights), F.col(column)).otherwise(F.lit(POOL)) if weights else F.lit(POOL)


def targets(weights: dict[str, float]) -> dict[str, float]:
    if any(w <= 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights must be positive and sum to 1 at most")
    return weights | {POOL: max(0.0, 1.0 - sum(weights.values()))}


def ranked(docs: DataFrame, weights: dict[str, float], id_column: str, source_column: str, seed: int) -> DataFrame:
    """``docs`` with ``__source`` and ``__rank``, the place of a document in its source's hashed order.

    Documents are ranked within slices of the hash range; the slices' counts give the offsets, so no source
    is sorted as a whole in one task.
    """
    spread = F.xxhash64(F.col(id_column), F.lit(seed))
    own = docs.withColumns({"__source": source_key(weights, source_column), "__hash": spread}).withColumn("__slice", F.pmod(F.shiftrightunsigned("__hash", 20), F.lit(SLICES)).cast("int"))
    counts = own.groupBy("__source", "__slice").agg(F.count("*").alias("__n"))
    running = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__source", "__slice", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__source", "__slice").orderBy("__hash", id_column)
    return own.withColumn("__row", F.row_number().over(within)).join(offsets, ["__source", "__slice"]).withColumn("__rank", F.col("__before") + F.col("__row") - 1)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_column: str = "doc_id", source_column: str = "source", block_rows: int = BLOCK_ROWS, cycle: int = CYCLE, seed: int = 5) -> DataFrame:
    """``docs`` with ``mix_source``, ``mix_block``, ``mix_slot`` and ``mix_position`` (0, 1, 2, ... in mixed order)."""
    run = partial(placed, weights=weights, block_rows=block_rows, cycle=cycle, seed=seed)
    return adding(docs, run, ADDED, id_column=id_column, source_column=source_column)


def placed(docs: DataFrame, id_column: str, source_column: str, weights: dict[str, float] | None, block_rows: int, cycle: int, seed: int) -> DataFrame:
    """``mix`` for columns whose names begin with no underscore."""
    weights = TARGETS if weights is None else weights
    want = targets(weights)
    rows = docs.groupBy(source_key(weights, source_column).alias("s")).agg(F.count("*").alias("n")).collect()  # one row for each named source and the pool
    sizes = {r["s"]: r["n"] for r in rows}
    plan = phases({s: -(-n // block_rows) for s, n in sizes.items()}, want, cycle)
    cells, tails = [], []
    for k, phase in enumerate(plan):
        seen: dict[str, int] = {}
        for place, s in enumerate(pattern(phase["slots"])):
            j = seen.get(s, 0)
            seen[s] = j + 1
            cells.append((k, s, j, place))
        for s, n in phase["slots"].items():
            tails.append((s, k, phase["before"][s], n, phase["before"][s] + n * phase["cycles"], phase["start"], sum(phase["slots"].values())))
    spark = docs.sparkSession
    extra = ["mix_source string", "mix_block long", "mix_slot long", "mix_position long"]
    if not plan:
        return docs.limit(0).select(*docs.columns, *(F.lit(None).cast(e.split()[1]).alias(e.split()[0]) for e in extra))
    # Both tables are bounded by the number of named sources and the cycle, whatever the input's size.
    pieces = spark.createDataFrame(tails, "__source string, __phase int, __from long, __share int, __to long, __start long, __slots int")
    places = spark.createDataFrame(cells, "__phase int, __source string, __j int, __place int")
    # The last block of a source may be short; positions count those gaps, of which there is one a source.
    full = {s: -(-n // block_rows) * block_rows - n for s, n in sizes.items()}
    owned = ranked(docs, weights, id_column, source_column, seed).withColumn("mix_block", F.floor(F.col("__rank") / block_rows).cast("long"))
    last = [(s, -(-n // block_rows) - 1, full[s]) for s, n in sizes.items() if full[s]]
    gap_slots = []
    for s, block, gap in last:
        for k, phase in enumerate(plan):
            n = phase["slots"].get(s, 0)
            first = phase["before"].get(s, 0)
            if n and first <= block < first + n * phase["cycles"]:
                j, cycle_no = (block - first) % n, (block - first) // n
                place = next(p for (kk, ss, jj, p) in cells if (kk, ss, jj) == (k, s, j))
                gap_slots.append((phase["start"] + cycle_no * sum(phase["slots"].values()) + place, gap))
    missing = sum((F.when(F.col("mix_slot") > slot, F.lit(gap)).otherwise(F.lit(0)) for slot, gap in gap_slots), F.lit(0))
    slots = (
        owned.join(F.broadcast(pieces), "__source")
        .where(F.col("mix_block").between(F.col("__from"), F.col("__to") - 1))
        .withColumn("__k", F.col("mix_block") - F.col("__from"))
        .withColumn("__j", (F.col("__k") % F.col("__share")).cast("int"))
        .join(F.broadcast(places), ["__phase", "__source", "__j"])
        .withColumn("mix_slot", (F.col("__start") + F.floor(F.col("__k") / F.col("__share")) * F.col("__slots") + F.col("__place")).cast("long"))
    )
    return slots.withColumn("mix_position", (F.col("mix_slot") * block_rows + F.col("__rank") % block_rows - missing).cast("long")).select(*docs.columns, F.col("__source").alias("mix_source"), *ADDED[1:])


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, id_column: str = "doc_id", source_column: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` in mixed order: files and rows follow the schedule."""
    return with_own_names(docs, partial(in_order, weights=weights, **options), id_column=id_column, source_column=source_column)


def in_order(docs: DataFrame, weights: dict[str, float] | None, **options) -> DataFrame:
    return mix(docs, weights, **options).repartitionByRange("mix_position").sortWithinPartitions("mix_position")


def with_place(docs: DataFrame, name: str = "mix_position") -> DataFrame:
    """``docs``, which were read from files, with the place of each row among all (0, 1, 2, ...): files by name, then rows.

    So rows that ``mixed`` put in order and that were written keep their places, whichever task reads which file. Numbers in file names
    count as numbers. The driver holds one number for each file. An input column of that name gives way to the new one.
    """
    def natural(path: str) -> list[str | int]:
        return [int(x) if k % 2 else x for k, x in enumerate(re.split(r"([0-9]+)", path))]

    own, at = [f"c{k}" for k in range(len(docs.columns))], docs.metadataColumn("_metadata")
    rows = docs.select("*", at["file_path"], at["row_index"]).toDF(*own, "file", "row")
    sizes = {r["file"]: r["count"] for r in rows.groupBy("file").count().collect()}
    starts, before = [], 0
    for path in sorted(sizes, key=natural):
        starts.append((path, before))
        before += sizes[path]
    files = docs.sparkSession.createDataFrame(starts, "file string, before long")
    kept = [F.col(n).alias(c) for n, c in zip(own, docs.columns, strict=True) if c != name]
    return rows.join(F.broadcast(files), "file").select(*kept, (F.col("before") + F.col("row")).alias(name))
