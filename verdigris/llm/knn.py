"""Nearest neighbours of a query set by blocked matrix products over all vectors.

Equal vectors collapse to one class with its k + 1 smallest ids, behind a limit that each task
applies before the shuffle. Classes are dealt by hash into groups of bounded size, and each
group's task gets every different query vector; it holds its classes in tiles, and query blocks
stream past them. A single-precision product bounds each distance; only pairs whose lower bound
does not exceed the k-th best so far are recomputed in double precision. A query's lists of all
groups are merged, and its own row is left out at the end. No true neighbour can be lost.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components,
and null ids, take no part; any finite components may be, however large or small; vectors meet those of their own dimension only; ties go to
the smaller id; rows that repeat, or share an id, are queries and candidates each, and a query
leaves out its own row only; fewer candidates than k give fewer rows; an empty table gives
none; extra columns, whatever their names, are not read.

Every different query vector meets every different candidate, by contract: with queries a fixed
share of the rows the work grows with their square. Each vector is shuffled twice, each different
query vector once for each group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from verdigris.llm.common import workers_ready, written

#: Queries of a block and vectors of a tile.
QUERIES, CANDIDATES = 1024, 2048
#: Bytes of vectors that one task holds.
HELD = 192_000_000


def usable(vector: Column) -> Column:
    """Whether every component is finite and some are not zero."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    return vector.isNotNull() & F.forall(vector, good) & F.exists(vector, lambda x: x != 0)


def lengths(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances of vectors from rows; where squares would leave the doubles' range, of scaled components."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        total = np.cumsum((a - rows) ** 2, axis=1)[:, -1]
        found = np.sqrt(total)
        odd = np.flatnonzero(~((total > 1e-280) & (total < 1e300)))
        if len(odd):
            part = a[odd] / 4 - rows[odd] / 4
            power = np.frexp(np.abs(part).max(axis=1))[1]
            found[odd] = np.ldexp(np.sqrt((np.ldexp(part, -power[:, None]) ** 2).sum(axis=1)), power + 2)
    return found


def firsts(of: np.ndarray, k: int) -> np.ndarray:
    """Which entries of a sorted array are among the first k of their value."""
    at = np.arange(len(of))
    start = np.maximum.accumulate(np.where(np.r_[True, of[1:] != of[:-1]], at, 0))
    return at - start < k


class Tile:
    """Vectors of one dimension, and their single-precision form with half the squared length as one more component."""

    def __init__(self, x: np.ndarray):
        self.dim = x.shape[1]
        most = float(np.abs(x).max())
        # One power of two for all, so that no square overflows or vanishes.
        self.power = 0 if 2.0**-20 < most < 2.0**20 else -int(np.frexp(most)[1])
        # Above this dimension the bound on the rounding of sums would be wide.
        self.kind, unit = ("f4", 2.0**-24) if self.dim <= 65_536 else ("f8", 2.0**-53)
        self.gamma = (self.dim + 9) * unit * 1.01
        scaled = np.ldexp(x.astype("f8"), self.power)
        squares = (scaled**2).sum(axis=1)
        self.longest = math.sqrt(squares.max())
        self.coded = np.empty((self.dim + 1, len(x)), self.kind)
        self.coded[:-1], self.coded[-1] = scaled.T, -squares / 2
        self.x = None if x.dtype == self.kind and self.power == 0 else x

    def rows(self, at: np.ndarray) -> np.ndarray:
        return (self.coded[:-1, at].T if self.x is None else self.x[at]).astype("f8")

    def near(self, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) that contain all within the bound, or, where it is infinite, the k nearest."""
        size = self.coded.shape[1]
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            scaled = np.ldexp(q, self.power)
            far = np.abs(scaled).max(axis=1) > 2.0**40
            scaled[far] = 0
            square = (scaled**2).sum(axis=1)
            slack = 2 * self.gamma * (np.sqrt(square) * self.longest + self.longest**2 / 2) + 1e-11 * (square + self.longest**2) + self.dim * 1e-30
            one = np.ones((len(q), self.dim + 1), self.kind)
            one[:, :-1] = scaled
            product = one @ self.coded
            least = (square - np.ldexp(bound, self.power) ** 2 * (1 + 1e-11) - slack) / 2
            if len(new := np.flatnonzero(np.isinf(bound))):
                least[new] = -np.inf
                if size > k:
                    kth = np.partition(product[new], size - k, axis=1)[:, size - k].astype("f8")
                    # Distances beyond the doubles' range are equal: then nothing is ruled out.
                    within = np.isfinite(np.ldexp(np.sqrt(np.maximum(square[new] - 2 * kth + slack[new], 0)), -self.power))
                    least[new] = np.where(within, kth - slack[new], -np.inf)
            least[far] = -np.inf
            least = np.nextafter(least.astype(self.kind), np.array(-np.inf, self.kind))
            rows = np.flatnonzero(product.max(axis=1) >= least)
            a, c = np.nonzero(product[rows] >= least[rows, None])
        return rows[a], c


class Group:
    """The classes that one task holds, in tiles."""

    def __init__(self, size: int):
        self.size, self.tiles, self.waiting, self.n = size, [], [], 0
        self.counts, self.values = [], []

    def add(self, ids, x) -> None:
        self.counts.append(ids.value_lengths().to_numpy(zero_copy_only=False).astype("i8"))
        self.values.append(ids.flatten().to_numpy(zero_copy_only=False))
        self.waiting.append(x)
        self.n += len(x)
        if self.n >= self.size:
            self.close()

    def close(self) -> None:
        if self.waiting:
            x = np.concatenate(self.waiting)
            self.tiles += [Tile(x[i : i + self.size]) for i in range(0, len(x), self.size)]
            self.waiting, self.n = [], 0

    def ready(self) -> None:
        self.close()
        self.counts, self.values = (np.concatenate([np.zeros(0, "i8"), *a]) for a in (self.counts, self.values))
        self.starts = np.cumsum(self.counts) - self.counts

    def best(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, distance, id) of each query's k nearest rows, sorted; the id of a class is its smallest."""
        none = np.iinfo("i8").max
        d, i, at = np.full((len(q), k), np.inf), np.full((len(q), k), none), np.full((len(q), k), -1)
        start = 0
        for t in self.tiles:
            a, c = t.near(q, d[:, -1], k)
            step = max(1, (1 << 21) // t.dim)
            for s in range(0, len(a), step):
                self._merge(d, i, at, a[s : s + step], lengths(q[a[s : s + step]], t.rows(c[s : s + step])), c[s : s + step] + start, k)
            start += t.coded.shape[1]
        a, j = np.nonzero(at >= 0)
        found, n = at[a, j], self.counts[at[a, j]]
        a, d = np.repeat(a, n), np.repeat(d[a, j], n)
        ids = self.values[np.arange(n.sum()) + np.repeat(self.starts[found] - (np.cumsum(n) - n), n)]
        order = np.lexsort((ids, d, a))
        order = order[firsts(a[order], k)]
        return a[order], d[order], ids[order]

    def _merge(self, d, i, at, a, more, c, k) -> None:
        rows = np.unique(a)
        a = np.concatenate([np.repeat(rows, k), a])
        whole = [np.concatenate([old[rows].ravel(), new]) for old, new in ((d, more), (i, self.values[self.starts[c]]), (at, c))]
        order = np.lexsort((whole[1], whole[0], a))
        order = order[firsts(a[order], k)]
        for old, new in zip((d, i, at), whole):
            old[rows] = new[order].reshape(-1, k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, queries: int = QUERIES, candidates: int = CANDIDATES, held: int = HELD) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by Euclidean distance."""
    spark = vectors.sparkSession
    workers_ready(spark)
    taking = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("x")).filter(F.col("id").isNotNull() & usable(F.col("x"))).withColumn("hash", F.xxhash64("x"))
    most = k + 1  # a query's own row may be among them
    # Only sizes the groups; any number of them is right.
    different, values = taking.agg(F.approx_count_distinct("hash"), F.coalesce(F.avg(F.size("x")), F.lit(0.0))).first()
    # Single-precision components are held once, others beside their single-precision form.
    width = 4 if taking.schema["x"].dataType.elementType.typeName() == "float" else 12
    n = max(1, math.ceil(different * values * width / held), min(2 * spark.sparkContext.defaultParallelism, math.ceil(different / candidates)))
    rank = F.row_number().over(Window.partitionBy("hash", "x").orderBy("id"))
    classes = taking.withColumn("rank", rank).filter(F.col("rank") <= most).groupBy("hash", "x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = taking.filter(is_query)
    sought = written(asked.select("hash", "x").distinct().withColumn("key", F.monotonically_increasing_id()), "queries")
    group = F.pmod("hash", F.lit(n)).cast("int").alias("group")
    held_rows = classes.select(group, F.size("x").alias("dim"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), "ids", "x")
    query_rows = sought.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("group"), F.size("x").alias("dim"), F.lit(1).alias("kind"), "key", F.array().cast("array<long>").alias("ids"), "x")
    dealt = held_rows.union(query_rows).repartitionById(n, F.col("group")).sortWithinPartitions("dim", "kind")

    def run(batches):
        dim, group, keys, waiting = None, None, [], []

        def flush():
            key, q = np.concatenate(keys), np.concatenate(waiting).astype("f8")
            keys.clear()
            waiting.clear()
            a, d, i = group.best(q, most)
            offsets = np.searchsorted(a, np.arange(len(q) + 1)).astype("i4")
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(d), pa.array(i)], ["score", "id"]))
            return pa.RecordBatch.from_arrays([pa.array(key), found], names=["key", "found"])

        for b in (b for b in batches if b.num_rows):
            dims, kinds = b.column(1).to_numpy(), b.column(2).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (kinds[1:] != kinds[:-1])])
            for s, e in zip(cuts, [*cuts[1:], b.num_rows]):
                if dims[s] != dim:
                    if keys:
                        yield flush()
                    dim, group = dims[s], Group(candidates)
                x = b.column(5)[s:e].flatten().to_numpy(zero_copy_only=False).reshape(e - s, dim)
                if kinds[s] == 0:
                    group.add(b.column(4)[s:e], x)
                    continue
                if not hasattr(group, "starts"):
                    group.ready()
                for j in range(0, e - s, queries):
                    keys.append(b.column(3)[s:e].to_numpy()[j : j + queries])
                    waiting.append(x[j : j + queries])
                    if sum(map(len, keys)) >= queries:
                        yield flush()
        if keys:
            yield flush()

    partial = dealt.mapInArrow(run, "key long, found array<struct<score double, id long>>")
    answers = partial.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, most).alias("found"))
    own = F.array_position("found", F.struct(F.lit(0.0).alias("score"), F.col("id")))
    lists = asked.join(sought, ["hash", "x"]).select("id", "key").join(answers, "key").withColumn("own", own)
    others = F.slice(F.filter("found", lambda _, j: j + 1 != F.col("own")), 1, k)
    return lists.select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "near")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("near.id").alias("vec_id"), F.col("near.score").alias("score"))
