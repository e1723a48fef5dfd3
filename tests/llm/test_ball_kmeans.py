"""Ball k-means against comparing everything with everything in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import ball_kmeans
from verdigris.llm import queries as Q


def brute(rows, k=8, rounds=10, dim=64):
    v = []
    for i, x in rows:
        if i is None or x is None or len(x) != dim or any(y is None or not math.isfinite(y) or not math.isfinite(y * 1024) for y in x):
            continue
        v.append((i, tuple(math.floor(y * 1024) for y in x)))
    c = [x for _, x in sorted(v, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    assigned = lambda: [min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c)) for _, x in v]
    for _ in range(rounds):
        a = assigned()
        for j in range(len(c)):
            members = [x for (_, label), (_, x) in zip(a, v) if label == j]
            if members:
                c[j] = tuple(sum(t) // len(members) for t in zip(*members))
    a = assigned()
    fits = lambda z: z if z < 2**63 else None
    inertia = [sum(d for d, label in a if label == j) for j in range(len(c))]
    return sorted(((i, label, fits(d), fits(inertia[label]), fits(sum(inertia)), hashlib.sha256(",".join(map(str, c[label])).encode()).hexdigest()) for (i, _), (d, label) in zip(v, a)), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("x", "cluster", "count", "inertia")})


RNG = random.Random(2)
TIES = [(i, [RNG.choice([0.0, 0.001, 0.5, -0.7]) for _ in range(3)]) for i in range(200)]
ODD = TIES[:5] + [(1, TIES[1][1]), (None, [1.0, 2.0, 3.0]), (9, None), (10, [1.0, 2.0]), (11, [1.0, None, 2.0]), (12, [1.0, math.nan, 1.0]), (13, [1.0, math.inf, 1.0]), (14, [1e308, 1.0, 1.0]), (15, [])]
HUGE = TIES[:30] + [(500 + i, [RNG.choice([1e30, 1e5, 1e300, -1e200]) for _ in range(3)]) for i in range(20)]


@pytest.mark.parametrize("rows", [TIES, ODD, HUGE, []], ids=["ties", "odd", "huge", "empty"])
def test_equals_brute_force(spark, rows):
    got = ball_kmeans.ball_k_means(frame(spark, rows), k=8, rounds=4, dim=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 8, 4, 3)


def test_query_on_its_table(spark, sf_dir):
    rows = [(r.vec_id, [float(y) for y in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, Q.op11_ball_kmeans(spark, sf_dir).collect()), key=str) == brute(rows)


def test_balls_spare_distances():
    """Members of stable cores meet no other centroid, and the result is that of all comparisons."""
    rng = np.random.default_rng(5)
    middle = rng.integers(-3000, 3000, (12, 8))
    x = (middle[rng.integers(0, 12, 3000)] + rng.integers(-200, 200, (3000, 8))).astype("f8")
    c = middle.astype("f8")
    of, _ = ball_kmeans.first_clusters(x, c)
    new = np.floor([x[of == j].mean(axis=0) for j in range(12)])
    gaps = ((new[:, None] - new[None]) ** 2).sum(axis=2)
    count: list = []
    best, near = ball_kmeans.moved_members(x, of, new, gaps, np.full(12, True), count)
    want, far = ball_kmeans.first_clusters(x, new)
    assert (best == want).all() and (near == far).all()
    assert count[0] < 0.3 * len(x) * len(c)
    still: list = []
    ball_kmeans.moved_members(x, of, new, gaps, np.full(12, False), still)
    assert still[0] == len(x)
