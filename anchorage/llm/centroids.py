"""Centroid clustering with bounds that loosen by geometry instead of by full drift.

Every vector carries a lower bound on its distance to all centroids but its own. When
centroids move, a bound need not loosen by the largest drift: the vectors of a cluster
lie in a sphere around its old centroid, and seen in the plane through that centre and
the two places of a moved centroid, the sphere tells how much nearer any of its points
can have come. A vector whose exact distance to its own centroid stays below its bound
keeps it; the others are compared with all centroids. All distances are whole numbers,
so the assignment is that of comparing everything.

Vectors stay on the executors: a round writes them with their bounds and sums them by
cluster. The driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import discard, mapped, staged, table

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Components of this size and more would give squared distances beyond a long.
LARGEST = 2.0**21

STATE = "vec_id long, x array<int>, cluster int, distance long, lower double, scanned boolean"


@dataclass
class Move:
    """Centroids as rows of whole numbers, and by how much each cluster's bounds loosen."""

    centres: np.ndarray
    loosen: np.ndarray


def whole_vectors(rows: DataFrame, size: int = SIZE, scale: int = SCALE, largest: float = LARGEST) -> DataFrame:
    """(vec_id, x) of the vectors that take part, each component turned into floor(scale * component)."""
    fits = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) < largest, F.lit(False)))
    good = rows.select("vec_id", "embedding").filter((F.size("embedding") == size) & fits)
    return good.select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("int")).alias("x"))


def starts(vectors: DataFrame, clusters: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes; ids that repeat are ordered by their components."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(F.asc_nulls_last(order), "x").limit(clusters).select("x").collect()
    return np.array([r["x"] for r in first], dtype=np.int64)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of every row of ``x`` to every centroid, exact."""
    most = max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0))
    kind = np.float64 if x.shape[1] * int(most) ** 2 < 1 << 53 else np.int64
    dots = (x.astype(kind) @ centres.T.astype(kind)).astype(np.int64)
    own = np.einsum("nd,nd->n", x, x)
    return own[:, None] + np.einsum("kd,kd->k", centres, centres)[None, :] - 2 * dots


def tightened(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much the distance of any vector of cluster i to any other centroid can have shrunk.

    For a point p and a centroid that moved from a to b, |p - a| - |p - b| is at most
    |b - a| times the cosine of the angle at the midpoint of a and b between p and the
    move, because |p - a| + |p - b| is at least twice the distance to the midpoint. In
    the plane of the sphere's centre and the move the sphere covers the angles within
    asin(radius / distance) of its centre; the smallest of them decides. Spheres that
    hold the midpoint loosen by the full drift, spheres behind it not at all.
    """
    k = len(old)
    move = (new - old).astype(np.float64)
    drift = np.sqrt((move**2).sum(axis=1))
    loosen = np.zeros(k)
    for i in range(k):
        for j in range(k):
            if i == j or not drift[j]:
                continue
            to = old[i] - (old[j] + new[j]) / 2
            away = math.sqrt(float(to @ to))
            share = 1.0
            if away > radius[i]:
                angle = math.acos(max(-1.0, min(1.0, float(to @ move[j]) / (away * drift[j]))))
                share = max(0.0, math.cos(max(0.0, angle - math.asin(radius[i] / away))))
            loosen[i] = max(loosen[i], drift[j] * share)
    return loosen


def assign(vectors: DataFrame, move: Move, first: bool) -> DataFrame:
    """``STATE`` of every vector for the centroids of ``move``; ``first`` compares all with all."""
    centres, loosen = move.centres, move.loosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)
            if first:
                cluster, distance, lower = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n)
                open_ = np.ones(n, bool)
            else:
                cluster = batch.column(2).to_numpy().copy()
                gap = x - centres[cluster]
                distance = np.einsum("nd,nd->n", gap, gap)
                lower = batch.column(4).to_numpy() - loosen[cluster]
                # Room for rounding, so that a tie is always compared in whole numbers.
                open_ = np.sqrt(distance) * (1 + 1e-9) + 1e-6 >= lower
            if open_.any():
                all_ = squared(x[open_], centres)
                best = all_.argmin(axis=1)
                at = np.arange(len(all_))
                cluster[open_], distance[open_] = best, all_[at, best]
                # A single centroid has no others to be nearer.
                all_[at, best] = np.iinfo(np.int64).max
                lower[open_] = np.sqrt(all_.min(axis=1))
            columns = [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(lower), pa.array(open_)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "distance", "lower", "scanned"])

    return mapped(vectors, run, STATE)


def moved(state: DataFrame, centres: np.ndarray) -> Move:
    """The centroids after replacing every non-empty one by the floor of its vectors' mean."""
    size = centres.shape[1]
    sums = [F.sum(F.col("x")[d].cast("decimal(20,0)")).alias(f"s{d}") for d in range(size)]
    found = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect()
    new, radius = centres.copy(), np.zeros(len(centres))
    for row in found:
        new[row["cluster"]] = [int(row[f"s{d}"]) // row["n"] for d in range(size)]
        radius[row["cluster"]] = math.sqrt(row["far"]) * (1 + 1e-9)
    return Move(new, tightened(centres, new, radius) * (1 + 1e-9) + 1e-9)


def cluster(
    rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, cluster, distance, lower, scanned) of every vector after ``rounds`` updates, and the final centroids.

    ``rows`` holds (vec_id, embedding). Vectors that are null, of another length or hold
    a null or non-finite component are left out, as are those with a component of
    ``LARGEST`` in size, whose squared distances a long cannot hold. Repeated rows are
    vectors each; rows without an id take part but start a centroid only where the others
    are too few. Fewer vectors than ``clusters`` give as many centroids as vectors. Other
    columns are ignored, and no vectors give no rows.
    """
    vectors = staged(whole_vectors(rows, size, scale), "whole-vectors")
    centres = starts(vectors, clusters)
    if not len(centres):
        return assign(vectors, Move(np.zeros((1, size), np.int64), np.zeros(1)), True), centres.reshape(0, size)
    move = Move(centres, np.zeros(len(centres)))
    state = staged(assign(vectors, move, True), "clusters")
    discard(vectors)
    for _ in range(rounds):
        move = moved(state, move.centres)
        last, state = state, staged(assign(state, move, False), "clusters")
        discard(last)
    return state, move.centres


def digest(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centre).encode()).hexdigest()


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """Centroid clustering of the whole table ``embeddings``, with inertias and centroid digests."""
    state, centres = cluster(table(spark, sf_dir, "embeddings"))
    totals = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia")).collect()
    own = {r["cluster"]: r["cluster_inertia"] for r in totals}
    told = [(c, n, sum(own.values()), digest(centres[c])) for c, n in own.items()]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per centroid.
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _rounds(clusters: int, rounds: int) -> str:
    """The chain of assignments a0, a1, ... and centroids c0, c1, ... in SQL."""
    parts = []
    for t in range(rounds + 1):
        parts.append(f"""
d{t} AS (SELECT vec_id, x, k, c, list_sum(list_transform(range(1, {SIZE + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d
         FROM v, c{t}),
a{t} AS (SELECT vec_id, x, k, d AS distance FROM d{t}
         QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if t < rounds:
            parts.append(f"""
m{t} AS (SELECT k, list(m ORDER BY i) AS c FROM (
           SELECT k, i, (sum(u) - ((sum(u) % count(*)) + count(*)) % count(*)) // count(*) AS m
           FROM (SELECT k, unnest(x) AS u, unnest(range(1, {SIZE + 1})) AS i FROM a{t}) GROUP BY k, i) GROUP BY k),
c{t + 1} AS (SELECT c{t}.k, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (k))""")
    return ",".join(parts)


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {SIZE}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, x AS c FROM v
       ORDER BY sha256('1:' || vec_id) LIMIT {CLUSTERS}),{_rounds(CLUSTERS, ROUNDS)}
SELECT vec_id, a{ROUNDS}.k::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY a{ROUNDS}.k)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(c, lambda e: e::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON a{ROUNDS}.k = c{ROUNDS}.k
"""
