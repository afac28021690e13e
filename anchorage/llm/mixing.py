"""Mixing sources to target weights by Pfair scheduling, in built-in functions only.

Block i of a source of weight w, as an exact share of the weights of all active
sources, may not run before slot floor(i / w) and must run before slot
ceil((i + 1) / w). Serving the eligible block with the earliest deadline meets every
window, so at any time a source has run less than one block more or less than its
weight asks for. The driver serves the blocks one after the other and Spark numbers
the rows. When a source is used up, the rest share its weight from there on: nothing
is dropped.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorage.llm.common import table

BLOCK = 8
#: Blocks of a source that one row of the plan holds.
SLOTS = 64
#: Without given weights a source weighs its rows to this power.
POWER = 0.5
MOST_SOURCES = 4096
RANK_ROWS = 20_000
#: Deadlines of vanishing weights are written as this.
LATEST = 2**62


def shares(weights: dict[str, float], slots: int) -> dict[str, Fraction]:
    """The exact part of ``slots`` that every source's weight asks for."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: slots * w / total for s, w in exact.items()}


def served(share: dict, total) -> Iterator[tuple]:
    """(source, release, deadline) slot by slot, without end, where ``share`` of every ``total`` slots are a source's."""
    waiting = [(0, s) for s in share]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    taken = dict.fromkeys(share, 0)
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            release, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(taken[s] + 1) * total // share[s]), s, release))
        deadline, s, release = heapq.heappop(ready)
        yield s, release, deadline
        taken[s] += 1
        heapq.heappush(waiting, (taken[s] * total // share[s], s))
        slot += 1


def timetable(share: dict, slots: int) -> dict[str, list[int]]:
    """Slots of each source's blocks among the first ``slots``, earliest deadline first."""
    found: dict[str, list[int]] = {s: [] for s in share}
    for slot, (s, _, _) in enumerate(islice(served(share, slots), slots)):
        found[s].append(slot)
    return found


def phases(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int, int]]:
    """(source, phase, release, deadline) of every block, slot by slot.

    A phase ends before the slot that asks a used-up source for a block.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    exact = {s: Fraction(weights[s]) for s in left if weights.get(s, 0) > 0}
    common = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * common) for s, w in exact.items()}
    base = seen = 0
    phase = dict.fromkeys(left, 0)
    while left:
        active = {s: whole[s] for s in left if s in whole} or dict.fromkeys(left, 1)
        for s, release, deadline in served(active, sum(active.values())):
            if s not in left:
                break
            yield s, phase[s], base + release, base + deadline
            seen += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                if not left:
                    return
        for s in active:
            phase[s] += 1
        base = seen


def plan(spark: SparkSession, blocks: dict[str, int], weights: dict[str, float], size: int) -> DataFrame:
    """(name, part, phase, release, deadline, slot): ``size`` blocks of a source a row, as arrays."""
    names = sorted(blocks)
    number = {s: k for k, s in enumerate(names)}
    source, phase, release, deadline = array("i"), array("i"), array("q"), array("q")
    for s, at, first, last in phases(blocks, weights):
        source.append(number[s])
        phase.append(at)
        release.append(first)
        deadline.append(min(last, LATEST))
    owner = np.frombuffer(source, np.int32) if source else np.zeros(0, np.int32)
    slot = np.argsort(owner, kind="stable")
    owner = owner[slot]
    block = np.arange(len(owner)) - np.searchsorted(owner, owner)
    first = np.flatnonzero(block % size == 0)
    edges = pa.array(np.append(first, len(owner)), pa.int32())
    lists = [("phase", phase, np.int32), ("release", release, np.int64), ("deadline", deadline, np.int64)]
    columns = {"name": pa.array([names[k] for k in owner[first]], pa.string()), "part": pa.array(block[first] // size, pa.int64())}
    columns |= {k: pa.ListArray.from_arrays(edges, pa.array(np.array(v, t)[slot])) for k, v, t in lists}
    columns["slot"] = pa.ListArray.from_arrays(edges, pa.array(slot, pa.int64()))
    return spark.createDataFrame(pa.table(columns))


def named(source):
    """A name for every source, the missing one included."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def schedule(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, slots: int = SLOTS, power: float = POWER
) -> DataFrame:
    """(row, block, phase, release, deadline, slot, place) for every row of ``docs`` (doc_id, source).

    ``row`` holds all columns of the input, whatever their names. Rows of a source
    are blocked in hash order of doc_id; the last block may be short. Rows without
    a source are a source of their own. Sources that ``weights`` leaves out follow
    when the others are used up, in equal shares. Repeated rows are rows; an empty
    table gives none. Reading by (slot, place) gives the mix. ``slots`` blocks of a
    source are one row of the plan, which changes nothing in the result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"), "doc_id", named(F.col("source")).alias("name"))
    sizes = {r["name"]: r["n"] for r in rows.groupBy("name").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them before mixing")
    given = {"" if s is None else f"={s}": w for s, w in weights.items()} if weights else {s: n**power for s, n in sizes.items()}
    counts = {s: math.ceil(n / block) for s, n in sorted(sizes.items())}
    blocks = plan(spark, counts, given, slots)

    buckets = max(8, sum(sizes.values()) // RANK_ROWS)
    rows = rows.withColumn("order", F.xxhash64("doc_id")).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(buckets)))
    before = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("name", "bucket")
        .agg(F.count("*").alias("n"))
        .select("name", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("name", "bucket").orderBy("order", "doc_id")
    ranked = rows.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["name", "bucket"])
    rank = F.col("nth") + F.col("start")
    at = ranked.select("row", "name", F.floor(rank / block).alias("block"), F.pmod(rank, F.lit(block)).cast("int").alias("place"))

    # The plan has some 30 bytes a block; Spark broadcasts it only below its size threshold.
    at = at.withColumn("part", F.floor(F.col("block") / slots)).join(blocks, ["name", "part"])
    i = F.pmod("block", F.lit(slots)).cast("int")
    found = [F.get(c, i).alias(c) for c in ("phase", "release", "deadline", "slot")]
    return at.select("row", "block", *found, "place")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, in ranges of slots.

    All columns come back whatever their names, repeated rows as often as they came; rows
    without a source are a source of their own; an empty table gives no rows.
    """
    rows = schedule(docs, weights, block)
    return rows.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Place in the mix of every row of the whole table ``documents``, by its source."""
    rows = schedule(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return rows.select("row.doc_id", "row.source", "block", "phase", "release", "deadline", "slot", "place")
