"""Operators of the core against brute force on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.operators import statistics as St
from verdigris.operators import stores
from verdigris.operators import vectors as V
from verdigris.plans import registry
from verdigris.sources import files


def vectors(spark, n=400, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(size=dim).astype("f4").tolist(), k % 5) for k in range(n)]
    rows += [(n, rows[3][1], 1), (n + 1, [0.0] * dim, 2), (n + 2, None, 2), (None, rows[1][1], 2), (n + 3, [1.0], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")


def cosine(a, b):
    na, nb = (np.sqrt(np.cumsum(np.array(x, "f8") ** 2)[-1]) for x in (a, b))
    return float(np.cumsum(np.array(a, "f8") * np.array(b, "f8"))[-1] / (na * nb or 1.0))


def test_nearest_and_best_by_label_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_VALUES", 64)
    monkeypatch.setattr(V, "VECTOR_VALUES", 640)
    rows, v = vectors(spark)
    queries = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    good = [(i, x, y) for i, x, y in rows if i is not None and x]
    want, best = {}, {}
    for q, x, _ in good:
        if q % 50 == 0:
            near = sorted((-cosine(x, y), i, label) for i, y, label in good if i != q and len(y) == len(x))
            want[q] = [(i, label, -s) for s, i, label in near[:7]]
            best[q] = {label: max((-s, -i) for s, i, lab in near if lab == label) for label in {x[2] for x in near}}
    got = {}
    for r in V.nearest(queries, v, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.label, r.score))
    assert got == want
    by = V.best_by_label(queries, v).collect()
    assert {(r.query_id, r.label): (r.score, -r.vec_id) for r in by} == {(q, label): s for q, m in best.items() for label, s in m.items()}


def test_approximate_search_recalls_nine_of_ten(spark, sf_dir):
    found = registry.queries()["e5_recall_of_approximate_search"](spark, sf_dir.replace("0.001", "0.01"))
    n, mean = found.agg(F.count("*"), F.avg("recall")).first()
    assert n > 20 and mean >= 0.9


def test_window_hits_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefg") * rng.randint(1, 2)
    items = [(k, " ".join(word() for _ in range(rng.choice((2, 4, 9, 30))))) for k in range(20)] + [(90, "Aa  bb\ncc")]
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(60)]
    docs += [(100, "x " + items[3][1].upper() + " y"), (101, "zz aa BB cc zz"), (102, ""), (103, "aaa bb cc")]

    def hit(text, item):
        t, w = text.lower().split(), item.lower().split()
        n = min(8, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        return any(tuple(t[k : k + n]) in windows for k in range(len(t) - n + 1))

    got = T.window_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 8).collect()
    assert sorted(map(tuple, got)) == sorted((d, i) for d, t in docs for i, x in items if hit(t, x))


def test_blocks_with_context_see_what_the_whole_group_sees(spark):
    rng = random.Random(4)
    rows = [(k * rng.choice((1, 1, 977)) + k, "hot" if rng.random() < 0.8 else "other") for k in range(1, 900)]
    d = spark.createDataFrame(sorted({k: g for k, g in rows}.items()), "k long, g string")
    whole = Window.partitionBy("g").orderBy("k").rowsBetween(-10, -1)
    want = d.withColumn("s", F.coalesce(F.sum("k").over(whole), F.lit(0)))
    part = Window.partitionBy("g", "__block").orderBy("k").rowsBetween(-10, -1)
    got = St.with_context(d, "g", "k", 10, 50).withColumn("s", F.coalesce(F.sum("k").over(part), F.lit(0))).filter("__own").select("k", "g", "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_sums_and_disagreements(spark):
    d = spark.createDataFrame([(k, k % 3) for k in range(500)], "k long, x long").withColumn("r", F.expr("k div 70"))
    got = {r.k: r.n for r in St.running(d, "r", ["k"], {"n": F.col("x")}).collect()}
    assert got == {k: sum(j % 3 for j in range(k + 1)) for k in range(500)}
    rows = [("b", 1, 1, 0.5, False), ("b", 1, 2, 0.7, False), ("b", 2, 1, 0.5, False), ("b", 2, 2, 0.5, False), ("b", 3, 1, 0.1, True), ("b", 3, 2, 0.2, False), ("b", 4, 1, None, False), ("b", 4, 2, 0.2, False), ("c", 1, 2, 0.9, False), ("b", 1, 3, 9.0, False)]
    scores = spark.createDataFrame(rows, "benchmark string, sample long, model long, score double, errored boolean")
    assert [tuple(r) for r in St.disagreements(scores, 1, 2).collect()] == [("b", 1, 0.5, 0.7)]


def test_profiles_keep_short_tags_and_floors(spark):
    session = spark.createDataFrame([(1, 5, 0.8, False, "en", ["a", "b" * 300, "One. Two.", " ", "old"], 1.0), (2, 2, 0.9, False, "en", ["a"], 1.0), (3, 9, 0.5, False, "xx", ["t%d" % k for k in range(30)], 0.52)], "u long, n long, confidence double, cold boolean, language string, frames array<string>, abstraction double")
    stored = spark.createDataFrame([(1, "de", 0.98, ["old"], 0.85), (2, "de", 0.5, ["x"], 0.6)], "u long, language string, abstraction double, frames array<string>, confidence double")
    got = {r["u"]: tuple(r)[1:] for r in stores.distilled(session, stored, "u").collect()}
    assert got[1] == (True, "en", 0.98, ["old", "a"], 3, 0.85)
    assert got[2] == (False, "de", 0.5, ["x"], 1, 0.6)
    assert got[3] == (True, None, 0.52, ["t%d" % k for k in range(16)], 0, 0.5)


def test_threshold_levels_and_required_fields(spark, tmp_path):
    levels = files.threshold_levels(spark, "3:\n  high: 0.5\nsub_topics:\n  7:\n    med: 0.2\nnoise\n")
    assert sorted(map(tuple, levels.collect()), key=str) == sorted([(3, None, 0.5, None), (None, 7, None, 0.2)], key=str)
    with pytest.raises(ValueError):
        files.append_rows(spark.range(1), str(tmp_path / "rows"))
