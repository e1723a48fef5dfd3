"""Ball k-means on integer vectors: clusters are balls, and members meet only the centroids that can matter.

Each round is one pass over a written table of (vector, cluster). Within a batch, the members
of a cluster form a ball around its new centroid, whose radius is their largest distance. Only
centroids nearer to it than twice that radius are its neighbours. Members closer than half the
way to the nearest neighbour are its stable core and stay without further distances. The rest
lie in annuli, one for each further neighbour whose half-way they pass, and are compared with
just these. A ball whose centroid and neighbours did not move since the round before keeps all
its members. Sums leave a task as one row for each cluster, beside the vectors; the rounds meet
at the driver with k rows. All comparisons are of whole numbers, so that the result is exactly
that of comparing everything with everything.

Numbers are exact: doubles while no square of a distance can pass 2 ** 53, Python's integers
beyond. Vectors: those of exactly ``dim`` components, none null, with finite integers.

Defined cases: other vectors and null ids take no part; ties go to the smaller centroid; rows
that repeat are vectors each, and equal first centroids leave the later ones empty; fewer than k
vectors give fewer centroids; an empty table gives none; a distance or inertia beyond a long is
null; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import workers_ready, written
from verdigris.session import made, removed

#: What a vector becomes: the whole part of so many times a component.
SCALE = 1024
LONG = (1 << 63) - 1


def whole(vectors: DataFrame, dim: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the integers of the vectors that take part, as doubles."""
    x = F.col("embedding")
    scaled = F.transform(x, lambda v: v.cast("double") * scale)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).filter(F.col("vec_id").isNotNull() & (F.size(x) == dim))
    # Beyond 2 ** 53 a double has no part after the point, and no long could hold it.
    part = lambda v: F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))
    return good.withColumn("x", scaled).filter(F.forall("x", finite)).select("vec_id", F.transform("x", part).alias("x"))


def narrow(x: np.ndarray, c: np.ndarray) -> bool:
    """Whether squares of distances between the two are exact in double precision."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    return 2 * most < math.sqrt(2.0**53 / x.shape[1])


def integers(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from the rows of c, or from one row."""
    d = x - c
    return np.einsum("ij,ij->i", d, d) if d.dtype != object else (d * d).sum(axis=1)


def first_clusters(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance by comparing all with all."""
    best = np.zeros(len(x), "i4")
    near = squares(x, c[0])
    for j in range(1, len(c)):
        d = squares(x, c[j])
        closer = (d < near).astype(bool)
        best[closer], near[closer] = j, d[closer]
    return best, near


def moved_members(x: np.ndarray, of: np.ndarray, c: np.ndarray, between: np.ndarray, moved: np.ndarray, counter: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance from the clusters of the round before.

    between: squared distances of centroids; moved: which are not where the round before had
    them; counter, if given, takes the number of distances that were computed.
    """
    best, near, work = of.copy(), np.zeros(len(x), between.dtype), 0
    for i in np.unique(of).tolist():
        rows = np.flatnonzero(of == i)
        own = squares(x[rows], c[i])
        work += len(rows)
        # Neighbours: their half-way lies within the ball. The ball of this batch is in the cluster's.
        order = sorted((int(between[i, j]), j) for j in range(len(c)) if j != i and between[i, j] <= 4 * own.max())
        near[rows] = own
        if not moved[i] and not any(moved[j] for _, j in order):
            continue
        new, label = own.copy(), np.full(len(rows), i, "i4")
        for gap, j in order:
            # Those beyond half the way to j; the others of the core or of inner annuli are done.
            out = np.flatnonzero(4 * own >= gap)
            if not len(out):
                break
            d = squares(x[rows[out]], c[j])
            work += len(out)
            better = ((d < new[out]) | ((d == new[out]) & (j < label[out]))).astype(bool)
            new[out[better]], label[out[better]] = d[better], j
        best[rows], near[rows] = label, new
    if counter is not None:
        counter.append(work)
    return best, near


SCHEMA = "vec_id long, x array<double>, cluster int, distance long, count long, sums array<string>, inertia string"


def one_round(table: DataFrame, centroids: list[list[int]], moved: list[bool] | None, name: str) -> DataFrame:
    """The vectors with their clusters for these centroids, and for each task and cluster a row of sums."""
    dim = len(centroids[0])

    def run(batches):
        c = np.array(centroids, dtype=object)
        flat = c.astype("f8")
        gaps = np.array([[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in centroids] for p in centroids], dtype=object).reshape(len(centroids), -1)
        counts, sums, inertia = [0] * len(c), [[0] * dim for _ in c], [0] * len(c)
        for b in batches:
            if not b.num_rows:
                continue
            x, at = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim), flat
            between = gaps
            if narrow(x, flat):
                between = gaps.astype("f8")
                values = x
            else:
                values, at = integers(x), c
            if moved is None:
                best, near = first_clusters(values, at)
            else:
                best, near = moved_members(values, b.column(2).to_numpy(), at, between, np.array(moved))
            for i in np.unique(best).tolist():
                rows = np.flatnonzero(best == i)
                counts[i] += len(rows)
                inertia[i] += int(near[rows].sum())
                sums[i] = [s + int(v) for s, v in zip(sums[i], values[rows].sum(axis=0).tolist(), strict=True)]
            none = pa.nulls(b.num_rows)
            distance = pa.array([int(d) if d <= LONG else None for d in near.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best.astype("i4")), distance, *(none.cast(t) for t in (pa.int64(), pa.list_(pa.string()), pa.string()))], names=["vec_id", "x", "cluster", "distance", "count", "sums", "inertia"])
        held = [i for i in range(len(c)) if counts[i]]
        if held:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(held)).cast(t) for t in (pa.int64(), pa.list_(pa.float64()))), pa.array(held, pa.int32()), pa.nulls(len(held)).cast(pa.int64()), pa.array([counts[i] for i in held], pa.int64()), pa.array([[str(v) for v in sums[i]] for i in held]), pa.array([str(inertia[i]) for i in held])], names=["vec_id", "x", "cluster", "distance", "count", "sums", "inertia"])

    return written(table.mapInArrow(run, SCHEMA), name)


def totals(found: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """Count, sums and inertia of every cluster with members: the tasks' rows are added up per cluster, k rows come back."""

    def add(batches):
        held: dict = {}
        for b in batches:
            for cluster, count, sums, inertia in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                n, s, d = held.get(cluster, (0, [0] * len(sums), 0))
                held[cluster] = n + count, [x + int(y) for x, y in zip(s, sums, strict=True)], d + int(inertia)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([[str(x) for x in v[1]] for v in held.values()], pa.list_(pa.string())), pa.array([str(v[2]) for v in held.values()], pa.string())], names=["cluster", "count", "sums", "inertia"])

    partial = found.filter("count is not null").select("cluster", "count", "sums", "inertia")
    summed = partial.repartition("cluster").mapInArrow(add, "cluster int, count long, sums array<string>, inertia string")
    return {r["cluster"]: (r["count"], [int(x) for x in r["sums"]], int(r["inertia"])) for r in summed.collect()}


def ball_k_means(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: str = "3", scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    k is a parameter: k rows of dim numbers go to the driver and to the tasks in each round.
    """
    spark = vectors.sparkSession
    workers_ready(spark)
    table = written(whole(vectors, dim, scale), "vectors")
    drawn = table.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "x").orderBy("hash", "x").limit(k).collect()
    centroids = [[int(v) for v in r["x"]] for r in drawn]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], schema)
    moved = None
    for at in range(rounds + 1):
        # The table of the round before is of no more use once this one is there.
        last = made(spark)[-1]
        table = one_round(table.select("vec_id", "x", *(["cluster"] if moved else [])), centroids, moved, f"round-{at}")
        removed(spark, made(spark).index(last), keep=(made(spark)[-1],))
        found = totals(table)
        table = table.filter("count is null")
        if at == rounds:
            break
        new = [[s // found[j][0] for s in found[j][1]] if j in found else old for j, old in enumerate(centroids)]
        moved, centroids = [a != b for a, b in zip(new, centroids, strict=True)], new
        if not any(moved):
            # Nothing changes any more: further rounds would give the same.
            break
    long = lambda v: v if v <= LONG else None
    inertia = sum(v[2] for v in found.values())
    told = [(j, long(found[j][2]), long(inertia), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j in found]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.select("vec_id", "cluster", "distance").join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
