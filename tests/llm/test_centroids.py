import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from anchorage.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster int, x string"


def brute(rows, clusters=16, rounds=3, size=64):
    """(vec_id, cluster, distance) per vector and the centroids, by comparing everything in whole numbers."""
    fine = [
        (i, tuple(math.floor(64 * v) for v in e))
        for i, e in rows
        if e is not None and len(e) == size and all(v is not None and math.isfinite(v) for v in e)
    ]
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "z"
    centres = [x for _, x in sorted(fine, key=lambda r: (name(r[0]), r[1]))[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        found = [nearest(x)[1] for _, x in fine]
        for k in range(len(centres)):
            mine = [x for (_, x), f in zip(fine, found) if f == k]
            if mine:
                centres[k] = tuple(sum(column) // len(mine) for column in zip(*mine))
    return Counter((i, nearest(x)[1], nearest(x)[0]) for i, x in fine), centres


def planted(count, groups, spread, seed=3):
    draw = random.Random(seed)
    middles = [[draw.uniform(-3, 3) for _ in range(64)] for _ in range(groups)]
    return [(i, [m + draw.gauss(0, spread) for m in draw.choice(middles)]) for i in range(count)]


@pytest.mark.parametrize("spread", [0.05, 1.5])
def test_equals_brute_force(spark, spread):
    rows = planted(400, 8, spread)
    state, centres = centroids.cluster(spark.createDataFrame([(i, e, 7, "z") for i, e in rows], SCHEMA))
    want, middles = brute(rows)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in state.collect()) == want
    assert [tuple(c) for c in centres.tolist()] == middles


def test_bounds_spare_comparisons(spark):
    state, _ = centroids.cluster(spark.createDataFrame([(i, e, 0, "") for i, e in planted(600, 16, 0.02)], SCHEMA), rounds=4)
    scanned = sum(r["scanned"] for r in state.collect())
    assert scanned < 300


def test_geometric_bound_holds_and_is_below_the_drift():
    random_ = np.random.default_rng(4)
    less = 0
    for _ in range(200):
        old = random_.integers(-50, 50, (4, 8))
        new = old + random_.integers(-6, 7, (4, 8))
        radius = random_.uniform(0, 60, 4)
        loosen = centroids.tightened(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(axis=1))
        for i in range(4):
            others = [j for j in range(4) if j != i]
            way = random_.standard_normal((500, 8))
            length = radius[i] * random_.random((500, 1)) ** 0.1
            points = old[i] + way / np.linalg.norm(way, axis=1, keepdims=True) * length
            shrunk = np.linalg.norm(points[:, None] - old[others], axis=2) - np.linalg.norm(points[:, None] - new[others], axis=2)
            assert shrunk.max() <= loosen[i] + 1e-9
            assert loosen[i] <= drift[others].max() + 1e-9
            less += loosen[i] < 0.9 * drift[others].max()
    assert less > 100


def test_odd_rows(spark):
    rows = planted(60, 3, 0.5)
    same = [(100 + i, rows[0][1]) for i in range(300)]
    odd = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 63 + [None]), (5, [1.0] * 63 + [float("nan")]), (6, [float("inf")] * 64)]
    large = [(7, [1_000_000.0] * 64), (8, [-1_000_000.5] * 64), (None, [0.25] * 64), (0, [-0.01] * 64)]
    every = rows + same + odd + large
    state, centres = centroids.cluster(spark.createDataFrame([(i, e, 0, "") for i, e in every], SCHEMA))
    want, middles = brute(every)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in state.collect()) == want
    assert [tuple(c) for c in centres.tolist()] == middles


@pytest.mark.parametrize("count", [0, 1, 5])
def test_few_vectors(spark, count):
    rows = planted(count, 2, 1.0)
    state, centres = centroids.cluster(spark.createDataFrame([(i, e, 0, "") for i, e in rows], SCHEMA))
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in state.collect()) == brute(rows)[0]
    assert len(centres) == count


def test_query_equals_sql_and_brute_force(spark, duck, folder):
    got = centroids.op12_centroid_clustering(spark, folder)
    rows = [tuple(r) for r in got.collect()]
    want, middles = brute(duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall())
    assert Counter(r[:3] for r in rows) == want
    for _, k, _, own, total, name in rows:
        assert own == sum(d * n for (_, c, d), n in want.items() if c == k) and total == sum(d * n for (_, _, d), n in want.items())
        assert name == hashlib.sha256(",".join(map(str, middles[k])).encode()).hexdigest()
    con = duck.execute(centroids.SQL)
    assert [d[0] for d in con.description] == got.columns
    assert Counter(con.fetchall()) == Counter(rows)
