"""Approximate search: recall against the exact one, what it touches, and builds that stop and go on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import ann
from verdigris.operators import vectors as V


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(60, 32))
    x = middle[rng.integers(0, 60, 3000)] + 0.25 * rng.normal(size=(3000, 32))
    rows = [(k, x[k].tolist(), k % 7) for k in range(3000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4).cache()
    return v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v


@pytest.fixture(scope="module")
def built(clustered, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/whole"
    ann.build(clustered[1], path, parts=4)
    return path


def test_recall_while_a_tenth_is_touched(spark, clustered, built):
    queries, v = clustered
    codes, model = ann.opened(spark, built)
    asked = ann.probed(queries, model, 4)
    scanned = asked.join(codes.groupBy("cell").count(), "cell").groupBy("query_id").agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0]
    short = ann.short_lists(asked, codes, model, 100).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert scanned <= 0.2 * 3000 and short <= 100  # of the full vectors a thirtieth is touched
    mean_scanned = asked.join(codes.groupBy("cell").count(), "cell").groupBy("query_id").agg(F.sum("count").alias("n")).agg(F.avg("n")).first()[0]
    assert mean_scanned <= 0.1 * 3000
    found = ann.search(queries, v, built, 10, probes=4)
    assert V.recall(V.nearest(queries, v, 10), found).agg(F.avg("recall")).first()[0] >= 0.9


def test_every_row_is_indexed_once(spark, clustered, built):
    codes, model = ann.opened(spark, built)
    assert codes.count() == codes.select("vec_id").distinct().count() == 3000
    assert {len(r.code) for r in codes.select("code").distinct().collect()} == {model.codebooks.shape[0]}
    assert sorted(map(tuple, ann.progress(spark, built).collect())) == [(p, 750, 4) for p in range(4)]


def test_stopped_build_goes_on(spark, clustered, built, tmp_path):
    v, path = clustered[1], f"file://{tmp_path}/index"
    assert ann.build(v, path, parts=4, stop_after=2) == {"fitted": True, "built": [0, 1], "merged": False}
    with pytest.raises(ValueError):
        ann.opened(spark, path)
    files = sorted(str(p) for p in (tmp_path / "index" / "parts").rglob("*.parquet"))
    # Files without a commit record, as of a part that was being written: they are written again.
    ann.encoded(v.limit(3), ann.loaded_model(spark.read.parquet(f"{path}/model"))).write.parquet(f"{path}/parts/part=2")
    assert ann.build(v, path, parts=4) == {"fitted": False, "built": [2, 3], "merged": True}
    again = sorted(str(p) for p in (tmp_path / "index" / "parts").rglob("*.parquet"))
    assert set(files) <= set(again)
    assert ann.build(v, path, parts=4) == {"fitted": False, "built": [], "merged": False}
    a, b = (sorted((r.vec_id, r.cell, bytes(r.code)) for r in ann.opened(spark, p)[0].collect()) for p in (path, built))
    assert a == b


def test_search_opens_probed_cells_only(spark, clustered, built):
    queries, _ = clustered
    codes, model = ann.opened(spark, built)
    one = queries.orderBy("query_id").limit(1)
    cells = [r.cell for r in ann.probed(one, model, 3).select("cell").collect()]
    read = codes.filter(F.col("cell").isin(cells)).select(F.input_file_name().alias("f")).distinct().count()
    every = codes.select(F.input_file_name().alias("f")).distinct().count()
    assert len(cells) == 3 and read < every / 4


def test_scores_by_codes_are_near(spark, clustered, built):
    """What the tables add up is the product with the decoded vector."""
    queries, v = clustered
    codes, model = ann.opened(spark, built)
    rows = {r.vec_id: (r.cell, np.frombuffer(r.code, "u1")) for r in codes.collect()}
    q = {r.query_id: np.array(r.q) / np.linalg.norm(r.q) for r in queries.collect()}
    for r in ann.short_lists(ann.probed(queries, model, 4), codes, model, 5).collect():
        cell, code = rows[r.vec_id]
        decoded = model.centroids[cell] + np.concatenate([model.codebooks[j, c] for j, c in enumerate(code)])
        assert abs(r.score - q[r.query_id] @ decoded) < 1e-5 and r.vec_id != r.query_id


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [1.0], 1), (None, [1.0, 1.0], 1), (5, [1.0, 1.0], 2), (6, [1.0, 1.0], 2)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (8, [0.0, 0.0]), (9, None)], "query_id long, q array<double>")
    model = ann.fitted(v.filter("size(embedding) = 2"))
    codes = ann.encoded(v, model)
    assert sorted(r.vec_id for r in codes.collect()) == [1, 2, 5, 6]
    got = [(r.query_id, r.vec_id, r["rank"]) for r in ann.approximate_top_k(q, v, codes, model, 2).collect()]
    assert sorted(got) == [(1, 5, 1), (1, 6, 2), (8, 1, 1), (8, 2, 2)]
    none = v.limit(0)
    assert ann.approximate_top_k(q, none, ann.encoded(none, ann.fitted(none)), ann.fitted(none), 2).count() == 0
