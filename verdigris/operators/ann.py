"""Approximate vector search: coarse cells, product-quantised residuals, exact re-ranking.

A model is fitted on a bounded sample by one task: centroids of the cells, and for each
sub-vector a codebook of at most 256 entries for what the centroid leaves over. Every row is
indexed, as its cell and one byte for each sub-vector. A search looks into the codes of the
nearest cells only: a table of the query's products with all codebook entries gives each code's
score by adding one entry a byte. The best few of these, the short list, are scored exactly by
their full vectors. So of the full vectors only the short lists are touched.

An index is built in parts. Each part's files are followed by a commit record; a build that was
stopped goes on behind the last record, with the model that was saved first. The parts are then
merged into a table that is partitioned by cell, so that a search reads the probed cells' files.

Vectors are compared by cosine, zero norms guarded by 1. Null vectors and ids, and vectors of
another dimension than the model's, are not in the index. The number of cells grows with the
square root of the rows up to MOST_CELLS, as the sample is bounded; beyond, cells grow.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.vectors import norms, top_k
from verdigris.session import ship

#: Rows on which a model is fitted at most, cells at most, and rows of the sample for each cell.
FIT_ROWS, MOST_CELLS, ROWS_A_CELL = 65_536, 4096, 16
#: Bytes of a code, and cells that a query looks into.
BYTES, PROBES = 16, 32
#: Queries and codes of a tile.
QUERY_BLOCK, CODE_BLOCK = 512, 16_384


@dataclass
class Model:
    """centroids (cells, dim) and codebooks (bytes, entries, dim / bytes), of unit vectors."""

    centroids: np.ndarray
    codebooks: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def nearest_cells(self, unit: np.ndarray, n: int) -> np.ndarray:
        far = (self.centroids**2).sum(axis=1)[None, :] - 2 * unit @ self.centroids.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def encoded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code) of every row."""
        cell = self.nearest_cells(unit, 1)[:, 0]
        return cell, codes_of(unit - self.centroids[cell], self.codebooks)

    def lookup(self, unit: np.ndarray) -> np.ndarray:
        """(query, byte, entry): products of the queries' sub-vectors with the codebooks."""
        m, _, width = self.codebooks.shape
        return np.einsum("qmw,mew->qme", unit.reshape(len(unit), m, width), self.codebooks).astype("f4")


def units(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1.0, norm)


def codes_of(rest: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    m, _, width = codebooks.shape
    parts = rest.reshape(len(rest), m, width)
    return np.stack([np.argmin((codebooks[j] ** 2).sum(axis=1)[None, :] - 2 * parts[:, j] @ codebooks[j].T, axis=1) for j in range(m)], axis=1).astype("u1")


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centroids of x by Lloyd's rounds; a cell without members moves to the farthest row."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        far = (c**2).sum(axis=1)[None, :] - 2 * x @ c.T
        of = far.argmin(axis=1)
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(-far[np.arange(len(x)), of], kind="stable")[: len(empty)]]
    return c


def trained(x: np.ndarray, cells: int, m: int, seed: int) -> Model:
    """The model of a sample; m is lowered to a divisor of the dimension."""
    unit = units(x)
    m = next(d for d in range(min(m, x.shape[1]), 0, -1) if x.shape[1] % d == 0)
    cells = max(1, min(cells, len(unit)))
    c = lloyd(unit, cells, 10, seed)
    coarse = Model(c, np.zeros((m, 1, x.shape[1] // m)))
    rest = (unit - c[coarse.nearest_cells(unit, 1)[:, 0]]).reshape(len(unit), m, -1)
    return Model(c, np.stack([lloyd(rest[:, j], min(256, len(unit)), 8, seed + j) for j in range(m)]))


def cells_for(rows: int, fit_rows: int = FIT_ROWS) -> int:
    """The square root of the rows, as far as the sample can fit cells."""
    return max(1, min(math.isqrt(rows), MOST_CELLS, fit_rows // ROWS_A_CELL))


def fitted(vectors: DataFrame, cells: int | None = None, m: int = BYTES, fit_rows: int = FIT_ROWS, seed: int = 3) -> Model:
    """The model of at most ``fit_rows`` rows, taken by hash, fitted in one task; only the model comes back."""
    ship(vectors.sparkSession)
    good = vectors.filter("vec_id is not null and size(embedding) > 0")
    cells = cells or cells_for(good.count(), fit_rows)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select(F.transform("embedding", lambda v: v.cast("double")).alias("x"))

    def run(batches):
        import pyarrow as pa

        rows = [row for b in batches for row in b.column(0).to_pylist()]
        if rows:
            model = trained(np.array([r for r in rows if len(r) == len(rows[0])], "f8"), cells, m, seed)
            shape = lambda x: pa.array([list(x.shape)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([shape(model.centroids), pa.array([model.centroids.ravel()]), shape(model.codebooks), pa.array([model.codebooks.ravel()])], names=["c_shape", "centroids", "b_shape", "codebooks"])

    return loaded_model(sample.mapInArrow(run, MODEL))


MODEL = "c_shape array<int>, centroids array<double>, b_shape array<int>, codebooks array<double>"


def loaded_model(rows: DataFrame) -> Model:
    found = rows.collect()
    if not found:
        return Model(np.zeros((1, 1)), np.zeros((1, 1, 1)))
    r = found[0]
    return Model(np.array(r["centroids"]).reshape(r["c_shape"]), np.array(r["codebooks"]).reshape(r["b_shape"]))


def model_rows(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame([(list(model.centroids.shape), model.centroids.ravel().tolist(), list(model.codebooks.shape), model.codebooks.ravel().tolist())], MODEL)


def encoded(vectors: DataFrame, model: Model) -> DataFrame:
    """(vec_id, cell, code) of every vector of the model's dimension."""
    ship(vectors.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                cell, code = model.encoded(units(x))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype("i4")), pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "cell", "code"])

    good = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") == model.dim))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x")).mapInArrow(run, "vec_id long, cell int, code binary")


def probed(queries: DataFrame, model: Model, probes: int) -> DataFrame:
    """(query_id, unit, cell, base) for each of a query's nearest cells; base is its product with the centroid."""
    ship(queries.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                unit = units(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                cells = model.nearest_cells(unit, probes)
                n = cells.shape[1]
                base = np.einsum("qd,qnd->qn", unit, model.centroids[cells])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(unit, n, axis=0).tolist()), pa.array(cells.ravel().astype("i4")), pa.array(base.ravel())], names=["query_id", "unit", "cell", "base"])

    good = queries.filter(F.col("query_id").isNotNull() & (F.size("q") == model.dim))
    return good.select(F.col("query_id").cast("long").alias("query_id"), F.transform("q", lambda v: v.cast("double")).alias("q")).mapInArrow(run, "query_id long, unit array<double>, cell int, base double")


def short_lists(probes: DataFrame, codes: DataFrame, model: Model, size: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the best of each query by codes, its own id left out.

    Queries and codes of a cell meet in tiles of bounded blocks, dealt by (cell, block): a cell
    that holds a third of all rows is many tasks. Only a tile's best leave it.
    """
    sizes = codes.groupBy("cell").agg(F.ceil(F.count("*") / CODE_BLOCK).cast("int").alias("blocks"))
    # One row for each cell at most: bounded by MOST_CELLS.
    counted = F.broadcast(sizes)
    many = F.lit(max(1, math.ceil(probes.select("query_id").distinct().count() / QUERY_BLOCK)))
    code_rows = codes.join(counted, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.struct("vec_id", "code").alias("c")).groupBy("cell", "block").agg(F.collect_list("c").alias("codes"))
    query_rows = probes.groupBy("cell", F.pmod(F.xxhash64("query_id"), many).alias("part")).agg(F.collect_list(F.struct("query_id", "unit", "base")).alias("queries"))
    spread = query_rows.join(counted, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "queries")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for j in range(b.num_rows):
                q, c = b.column(0)[j].values, b.column(1)[j].values
                ids, own = c.field(0).to_numpy(), q.field(0).to_numpy()
                code = np.frombuffer(b"".join(c.field(1).to_pylist()), "u1").reshape(len(ids), -1)
                unit = q.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                table = model.lookup(unit)
                score = np.repeat(q.field(2).to_numpy()[:, None].astype("f4"), len(ids), axis=1)
                for byte in range(code.shape[1]):
                    score += table[:, byte, code[:, byte]]
                score[own[:, None] == ids[None, :]] = -np.inf
                keep = min(size, len(ids))
                best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
                row, near = np.repeat(own, keep), best.ravel()
                value = np.take_along_axis(score, best, axis=1).ravel().astype("f8")
                good = np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array(row[good]), pa.array(ids[near][good]), pa.array(value[good])], names=["query_id", "vec_id", "score"])

    tiles = code_rows.join(spread, ["cell", "block"]).select("queries", "codes")
    return top_k(tiles.mapInArrow(run, "query_id long, vec_id long, score double"), size)


def rescored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, vec_id, label, score): exact cosines of the short lists' pairs, added in order of the components."""
    both = pairs.select("query_id", "vec_id").join(vectors.select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x")), "vec_id")
    both = both.join(queries.select("query_id", F.transform("q", lambda v: v.cast("double")).alias("q")), "query_id").select("query_id", "vec_id", F.col("label").cast("long").alias("label"), "q", "x")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                q, x = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for i in (3, 4))
                scale = norms(q) * norms(x)
                score = np.cumsum(q * x, axis=1)[:, -1] / np.where(scale == 0, 1.0, scale)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(score)], names=["query_id", "vec_id", "label", "score"])

    return both.mapInArrow(run, "query_id long, vec_id long, label long, score double")


def approximate_top_k(queries: DataFrame, vectors: DataFrame, codes: DataFrame, model: Model, k: int, probes: int = PROBES, short: int | None = None) -> DataFrame:
    """query_id, vec_id, label, score, rank: the best k of a short list (ten times k, if not given) by codes.

    ``codes`` is encoded(vectors), or an opened index; of that only probed cells are read.
    """
    asked = probed(queries, model, probes)
    pairs = short_lists(asked, codes, model, short or 10 * k)
    return top_k(rescored(pairs, queries, vectors), k)


# The index as files: <path>/model, <path>/parts/part=<n>, <path>/commits/part=<n>, <path>/index


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def build(vectors: DataFrame, path: str, parts: int = 4, stop_after: int | None = None, **fit) -> dict:
    """Build the index under a path, or go on with one: what was done now, {"fitted", "built", "merged"}.

    A part is the rows whose id leaves its number; its commit record is written after its files,
    so that a part without one is built again from the start. ``stop_after`` parts the build
    ends without merging, as if it were stopped.
    """
    spark = vectors.sparkSession
    done: dict = {"fitted": False, "built": [], "merged": False}
    if not _there(spark, f"{path}/model"):
        model_rows(spark, fitted(vectors, **fit)).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        done["fitted"] = True
    model = loaded_model(spark.read.parquet(f"{path}/model"))
    for part in range(parts):
        if stop_after is not None and len(done["built"]) >= stop_after:
            return done
        if not _there(spark, f"{path}/commits/part={part}"):
            rows = encoded(vectors.filter(F.pmod(F.col("vec_id"), F.lit(parts)) == part), model)
            rows.write.mode("overwrite").parquet(f"{path}/parts/part={part}")
            n = spark.read.parquet(f"{path}/parts/part={part}").count()
            spark.createDataFrame([(n, parts)], "rows long, of int").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/part={part}")
            done["built"].append(part)
    if done["built"] or not _there(spark, f"{path}/index"):
        merged = spark.read.parquet(*(f"{path}/parts/part={p}" for p in range(parts)))
        # Ranges of (cell, id): a large cell is several files, a small one mostly one.
        merged.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/index")
        done["merged"] = True
    return done


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(part, rows, of): the commit records."""
    return spark.read.option("basePath", f"{path}/commits").schema("rows long, of int, part int").parquet(f"{path}/commits").select("part", "rows", "of")


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, Model]:
    """The merged codes and the model of an index that was built to its end."""
    if not _there(spark, f"{path}/index"):
        raise ValueError(f"no finished index at {path}")
    codes = spark.read.schema("vec_id long, code binary, cell int").parquet(f"{path}/index").select("vec_id", "cell", "code")
    return codes, loaded_model(spark.read.parquet(f"{path}/model"))


def search(queries: DataFrame, vectors: DataFrame, path: str, k: int, probes: int = PROBES, short: int | None = None) -> DataFrame:
    """Approximate top k from an index on disk: the files of cells that no query probes are not opened."""
    codes, model = opened(queries.sparkSession, path)
    # At most as many numbers as there are cells.
    cells = [r["cell"] for r in probed(queries, model, probes).select("cell").distinct().collect()]
    return approximate_top_k(queries, vectors, codes.filter(F.col("cell").isin(cells)), model, k, probes, short)
