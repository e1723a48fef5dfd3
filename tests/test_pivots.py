"""Pivots skip tiles without losing a pair."""

import numpy as np

from verdigris.operators import vectors as V


def brute(rows, threshold):
    found = {}
    for i, x, a in rows:
        for j, y, b in rows:
            if x is not None and y is not None and len(x) == len(y) and a < b:
                scale = np.linalg.norm(x) * np.linalg.norm(y)
                score = float(np.dot(x, y) / (scale or 1.0))
                if score >= threshold:
                    found[a, b] = max(found.get((a, b), (-2.0, 0, 0)), (score, -i, -j))
    return {k: (-i, -j) for k, (_, i, j) in found.items()}


def test_tiles_are_skipped_and_pairs_kept(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 16))
    rows = [(k, (middle[k % 40] + 0.15 * rng.normal(size=16)).tolist(), (k * 7) % 12) for k in range(700)]
    rows += [(2000, [0.0] * 16, 1), (2001, None, 2), (2002, [1.0, 2.0], 3), (2003, [1.0, 2.1], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    for threshold in (0.99, 0.95, 0.5):
        got = {(r.label_a, r.label_b): (r.id_a, r.id_b) for r in V.conflicts(df, threshold, pivots=64).collect()}
        assert got == brute(rows, threshold)
    assert {(r.label_a, r.label_b): (r.id_a, r.id_b) for r in V.conflicts(df, 0.95).collect()} == brute(rows, 0.95)
    _, kept = V.pivot_tiles(df, 0.95, pivots=64)
    assert kept < 0.5


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<double>, label long"
    assert V.conflicts(spark.createDataFrame([], schema), 0.5).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 2)], schema)
    assert [tuple(r) for r in V.conflicts(one, 0.9).collect()] == [(1, 2, 1, 2, 1.0)]
