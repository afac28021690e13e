"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are projected on Gaussian directions and cut into slots; a table's
bucket is the slots of its directions. For a neighbour at a given distance the
projections differ by a normal amount, which gives the chance that it lies in any
perturbed bucket. Each query visits buckets of a table by falling chance until
their sum reaches ``SUCCESS``; the candidates of all tables are ranked by exact
cosine. A query may visit 100,000 buckets of a table, so none is listed: it carries
the chance of its last bucket, and a bucket is visited if its own is no smaller. The
rows are dealt into groups that hold the buckets of their own rows, so no hot bucket
meets in a task, and the queries travel to every group. A query that found too few
rows, or whose last one is farther than the fitted distance, is searched again in
blocks against all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from anchorage.llm.common import discard, mapped, ship, staged, table

TOP = 5
EVERY = 50
TABLES = 5
#: Chance, by estimate, of meeting a neighbour at the fitted distance in one table.
SUCCESS = 0.6
#: Queries that the distance is fitted on, against every row.
FIT_QUERIES = 64
FIT_QUANTILE = 0.9
PER_BUCKET = 16
SLOT = 1.5
#: Most rows, and most queries, that meet in one call, and most numbers of either.
GROUP_ROWS = 32_768
GROUP_VALUES = 1 << 22
#: Fewest rows of a group, while there are fewer than four groups a core.
LEAST_ROWS = 4_096
QUERY_BLOCK = 128
#: Pairs whose vectors are laid side by side for the exact cosine.
PAIRS = 4_096
#: Rows of a block whose chances are summed at once, so that they stay in the cache.
TILE = 512
#: Sums over half the directions that are kept apart; more are rounded down to 1 / GRID.
MOST_SUMS, GRID = 1 << 16, 1024
SEED = 11
ERF = np.frompyfunc(math.erf, 1, 1)


@dataclass
class Index:
    """Directions, offsets and slot width of all tables, and the distance they are fitted to."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    distance: float

    def slots(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, place within the slot) of each vector, table and direction."""
        at = np.einsum("nd,tkd->ntk", unit, self.directions) / self.width + self.offsets
        slot = np.floor(at)
        return slot.astype(np.int64), at - slot

    def chances(self, place: np.ndarray) -> np.ndarray:
        """Log chance, for every place within a slot, that a neighbour at the fitted distance
        lies one slot below, in the same slot or one above: along a last axis of three."""
        spread = self.distance / self.width * math.sqrt(2)
        bound = [ERF(x / spread).astype(float) for x in (place, 1 - place, 1 + place, 2 - place)]
        chance = np.stack([bound[2] - bound[0], bound[0] + bound[1], bound[3] - bound[1]], axis=-1) / 2
        return np.log(np.maximum(chance, 1e-12))


def sums(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log chance, chance) of every combination of moves along some directions, by rising chance."""
    total, chance = np.zeros(1), np.ones(1)
    for row in logs:
        total = (total[:, None] + row).ravel()
        chance = (chance[:, None] * np.exp(row)).ravel()
        if len(total) > MOST_SUMS:
            steps, at = np.unique(np.floor(total * GRID), return_inverse=True)
            total, chance = steps / GRID, np.bincount(at, weights=chance)
    order = np.argsort(total)
    return total[order], chance[order]


def least(logs: np.ndarray, success: float) -> float:
    """Log chance of the last bucket of a table to visit by falling chance, until the
    chances sum to ``success``; if they never do, of the unlikeliest within reach.

    A direction moves down, stays or moves up. The chances of all combinations above a
    bound are summed from those of the two halves of the directions, and the bound is
    found by bisection.
    """
    (few, own), (many, other) = sums(logs[: len(logs) // 2]), sums(logs[len(logs) // 2 :])
    held = np.append(np.cumsum(other[::-1])[::-1], 0)
    low, high = few[0] + many[0], few[-1] + many[-1] + 1e-6
    if own.sum() * held[0] >= success:
        while high - low > 1e-7:
            bound = (low + high) / 2
            if own @ held[np.searchsorted(many, bound - few)] >= success:
                low = bound
            else:
                high = bound
    return low - 1e-9  # room for sums in another order


def tree(slots: np.ndarray, whole: bool = True) -> tuple[tuple, np.ndarray]:
    """(node, row of the node for each row of ``slots``) of the distinct rows of slots.

    A node of one direction holds its distinct slots; one of more holds the nodes of its
    halves and the pairs of their rows that occur, at the root those of every row.
    """
    if slots.shape[1] == 1:
        found, at = np.unique(slots[:, 0], return_inverse=True)
        return (found,), at
    half = slots.shape[1] // 2
    (a, at_a), (b, at_b) = tree(slots[:, :half], False), tree(slots[:, half:], False)
    if whole:
        return (a, b, at_a, at_b), np.arange(len(slots))
    wide = len(b[-1])
    pairs, at = np.unique(at_a * wide + at_b, return_inverse=True)
    return (a, b, pairs // wide, pairs % wide), at


def chances_of(node: tuple, slot: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log chance of every row of a node for every query, whose own slots and the chances
    of the moves are ``slot`` and ``logs``; out of reach it is minus infinity."""
    if len(node) == 1:
        move = node[0][:, None] - slot[:, 0] + 1
        found = logs[np.arange(len(slot)), 0, np.clip(move, 0, 2)]
        return np.where((move >= 0) & (move <= 2), found, -np.inf)
    a, b, at_a, at_b = node
    half = slot.shape[1] // 2
    found = chances_of(a, slot[:, :half], logs[:, :half])[at_a]
    found += chances_of(b, slot[:, half:], logs[:, half:])[at_b]
    return found


def visit(missed: np.ndarray, node: tuple, at: np.ndarray, slot: np.ndarray, logs: np.ndarray, bound: np.ndarray) -> None:
    """Clear ``missed`` (rows x queries) where the row's bucket in one table is visited.

    The halves of the directions are summed first: a row whose half no query of the
    block can complete to its bound is passed over.
    """
    if len(node) == 1:
        missed[(chances_of(node, slot, logs) >= bound)[at]] = False
        return
    a, b, at_a, at_b = node
    half = slot.shape[1] // 2
    one, two = chances_of(a, slot[:, :half], logs[:, :half]), chances_of(b, slot[:, half:], logs[:, half:])
    live = (one >= bound - two.max(axis=0) - 1e-9).any(axis=1)[at_a]
    live &= (two >= bound - one.max(axis=0) - 1e-9).any(axis=1)[at_b]
    rows = np.flatnonzero(live)
    first, second = np.empty((2, TILE, len(slot)))
    for start in range(0, len(rows), TILE):
        tile = rows[start : start + TILE]
        n = len(tile)
        one.take(at_a[tile], axis=0, out=first[:n], mode="clip")
        two.take(at_b[tile], axis=0, out=second[:n], mode="clip")
        first[:n] += second[:n]
        missed[tile] &= first[:n] < bound


def shortlist(near: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the ``top`` + 1 highest values of every column at least, with room
    for rounding; minus infinity is left out.

    The bound is taken over the highest of 16 rows each: those are values as well, so no
    more than the values sought lie above it by them.
    """
    whole = len(near) // 16 * 16
    high = near
    if whole > 64 * (top + 1):
        high = np.concatenate([near[:whole].reshape(-1, 16, near.shape[1]).max(axis=1), near[whole:]])
    place = max(len(high) - top - 1, 0)
    last = np.partition(high, place, axis=0)[place]
    return np.divmod(np.flatnonzero(near >= np.maximum(last - 1e-9, -2)), near.shape[1])


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) that can take part: finite, not zero, of the commonest length.

    Rows without an id are left out; of rows that repeat an id the smallest vector counts.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    good = rows.select("vec_id", "embedding").filter("vec_id is not null and embedding is not null")
    good = good.filter(~bad).filter(some).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return good.withColumn("size", F.size("embedding"))


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column])


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of every pair of rows, each summed in the same order wherever it is computed."""
    norms = [np.sqrt(np.einsum("nd,nd->n", x, x)) for x in (a, b)]
    return np.einsum("ad,bd->ab", a, b) / norms[0][:, None] / norms[1][None, :]


def scores(own: np.ndarray, x: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Cosine of row ``i`` of ``own`` and row ``k`` of ``x`` for each pair, summed in one order everywhere."""
    found = np.empty(len(i))
    for start in range(0, len(i), PAIRS):
        a, b = own[i[start : start + PAIRS]], x[k[start : start + PAIRS]]
        norms = [np.sqrt(np.einsum("nd,nd->n", v, v)) for v in (a, b)]
        found[start : start + PAIRS] = np.einsum("nd,nd->n", a, b) / norms[0] / norms[1]
    return found


def highest(query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best of every query by score, ties to the smaller id."""
    order = np.lexsort((vec_id, -score, query))
    sorted_ = query[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < n]


def fit(rows: DataFrame, queries: DataFrame, total: int, size: int, top: int = TOP) -> Index:
    """Slot width and number of directions from the row count and the distance of the
    ``top``-th neighbour of at most ``FIT_QUERIES`` queries, found against every row."""
    chosen = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_QUERIES).collect()
    own = matrix([r["embedding"] for r in chosen]) if chosen else np.empty((0, size))
    ids = [r["vec_id"] for r in chosen]

    def best(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows or not len(own):
                continue
            near = cosines(own, matrix(batch.column(1).to_pylist()))
            near[np.array(ids)[:, None] == batch.column(0).to_numpy()[None, :]] = -2
            near = -np.sort(-near, axis=1)[:, :top]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(own)), near.shape[1])), pa.array(near.ravel())], names=["q", "near"]
            )

    near = mapped(rows.select("vec_id", "embedding"), best, "q long, near double")
    last = Window.partitionBy("q").orderBy(F.desc("near"))
    found = [r["near"] for r in near.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") == top).collect()]
    distance = float(np.quantile([math.sqrt(max(2 - 2 * x, 1e-4)) for x in found], FIT_QUANTILE)) if found else 1.0
    width = SLOT * distance
    spread = max(1.2, math.sqrt(2 * math.pi * math.e) / width)
    k = int(np.clip(round(math.log(max(total, 1) / PER_BUCKET + 1) / math.log(spread)), 1, 32))
    random = np.random.default_rng(SEED)
    return Index(random.standard_normal((TABLES, k, size)), random.random((TABLES, k)), width, distance)


def search(rows: DataFrame, queries: DataFrame, top: int = TOP, success: float = SUCCESS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows found for every query,
    by cosine, ties to the smaller id, a row never for itself.

    Both inputs hold (vec_id, embedding); rows that cannot take part are those that
    ``usable`` leaves out. Of rows with one and the same vector only the smallest
    ``top`` + 1 ids can be among the nearest, so the index holds those; equal queries
    are searched once. Other columns are ignored; no usable rows give no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    vectors = staged(usable(rows), "vectors")
    sizes = {r["size"]: r["n"] for r in vectors.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(1).collect()}
    size, total = next(iter(sizes.items()), (1, 0))
    asked = usable(queries).filter(F.col("size") == size).select("vec_id", "embedding")
    good = vectors.filter(F.col("size") == size).select("vec_id", "embedding")
    index = fit(good, asked, total, size, top)

    same = Window.partitionBy("embedding").orderBy("vec_id")
    kept = good.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= top + 1).drop("nth")
    kept = staged(kept.select(F.col("vec_id").cast("long"), "embedding"), "index")
    discard(vectors)
    distinct = staged(asked.groupBy("embedding").agg(F.min("vec_id").cast("long").alias("first")), "queries")
    ids = staged(asked.join(distinct, "embedding").select(F.col("vec_id").alias("query_id"), "first"), "ids")
    cores = spark.sparkContext.defaultParallelism
    most = max(1, min(GROUP_ROWS, GROUP_VALUES // max(size, 1)))
    parts = max(1, -(-total // most), min(4 * cores, total // LEAST_ROWS))

    def bounds(frames):
        for frame in frames:
            if frame.empty:
                continue
            logs = index.chances(index.slots(units(matrix(frame["embedding"])))[1])
            yield frame.assign(least=[[least(of, success) for of in tables] for tables in logs])

    def rank(rows_: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"first": [], "vec_id": [], "score": []}).astype({"first": "int64", "vec_id": "int64"})
        if rows_.empty or asking.empty:
            return empty
        x, ids, q, firsts = matrix(rows_["embedding"]), rows_["vec_id"].to_numpy(), matrix(asking["embedding"]), asking["first"].to_numpy()
        unit, order = units(x), np.arange(len(q))
        if hashed := "least" in asking:
            bound = matrix(asking["least"])
            slots, places = index.slots(units(q))
            trees = [tree(of) for of in np.moveaxis(index.slots(unit)[0], 1, 0)]
            # Queries of the same buckets share a block, which then visits few rows.
            order = np.lexsort(slots[:, 0].T[::-1])
        out = [empty]
        for start in range(0, len(q), QUERY_BLOCK):
            block = order[start : start + QUERY_BLOCK]
            own, seen = q[block], slice(None)
            if hashed:
                logs = index.chances(places[block])
                missed = np.ones((len(x), len(block)), bool)
                for t, (node, at) in enumerate(trees):
                    visit(missed, node, at, slots[block, t], logs[:, t], bound[block, t])
                met = ~missed.all(axis=1)
                if not met.all():
                    seen = np.flatnonzero(met)
                    missed = missed[seen]
            near = unit[seen] @ (own / np.linalg.norm(own, axis=1, keepdims=True)).T
            if not len(near):
                continue
            if hashed:
                np.copyto(near, -np.inf, where=missed)
            k, i = shortlist(near, top)
            k = np.arange(len(x))[seen][k]
            score = scores(own, x, i, k)
            best = highest(i, score, ids[k], top + 1)
            out.append(pd.DataFrame({"first": firsts[block[i[best]]], "vec_id": ids[k[best]], "score": score[best]}))
        return pd.concat(out)

    def nearest(asking: DataFrame, n: int) -> DataFrame:
        """The best ``top`` + 1 rows for each of ``n`` queries, sent to every group of rows."""
        sides = max(1, -(-n // most))
        part, side = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))) for count in (parts, sides))
        here = kept.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).withColumn("side", side)
        sent = asking.withColumn("side", F.pmod(F.xxhash64("first"), F.lit(sides))).withColumn("part", part)
        # Few groups need many partitions, or several share one while cores are idle.
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * parts * sides, 32 * cores))
        here, sent = (rows_.repartition(tasks, "part", "side").groupBy("part", "side") for rows_ in (here, sent))
        pairs = here.cogroup(sent).applyInPandas(rank, "first long, vec_id long, score double")
        by_score = Window.partitionBy("first").orderBy(F.desc("score"), "vec_id")
        return pairs.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= top + 1).drop("nth")

    def ranked(found: DataFrame) -> DataFrame:
        mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        own = ids.join(found, "first").filter("vec_id != query_id")
        return own.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= top)

    spread = distinct.select("first", "embedding").repartition(cores, "first")
    bounded = spread.mapInPandas(bounds, f"first long, embedding {distinct.schema['embedding'].dataType.simpleString()}, least array<double>")
    found = staged(nearest(bounded, distinct.count()), "found")
    ends = ranked(found).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last"))
    far = F.col("last") < 1 - index.distance**2 / 2
    short = ids.join(ends, "query_id", "left").filter((F.coalesce("n", F.lit(0)) < top) | far)
    short = staged(distinct.join(short.select("first").distinct(), "first", "left_semi"), "short")
    if n := short.count():
        more = staged(nearest(short, n), "more")
        found = found.join(short, "first", "left_anti").union(more.select(*found.columns))
    discard(kept)
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The five nearest rows of the whole table ``embeddings`` for every row whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter(F.col("vec_id") % EVERY == 0))
