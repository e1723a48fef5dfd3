"""Invariants on generated rows."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.operators import folds, vectors
from verdigris.sources import extract

steps = st.lists(st.tuples(st.integers(0, 3), st.floats(0, 2), st.floats(-1, 2)), min_size=1, max_size=30)


@settings(max_examples=8, deadline=None)
@given(steps)
def test_controller_stays_in_bounds(spark, rows):
    df = spark.createDataFrame([(s, k, pi, fresh) for k, (s, pi, fresh) in enumerate(rows)], "session_id long, seq long, pi double, fresh double")
    out = folds.controller(df).collect()
    assert len(out) == len(rows) and all(0 <= r.phi <= 1 for r in out)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20), st.floats(-1, 1)), min_size=1, max_size=30, unique_by=lambda r: (r[0], r[1])), st.integers(1, 5))
def test_ranks_are_dense(spark, rows, k):
    out = vectors.top_k(spark.createDataFrame(rows, "query_id long, vec_id long, score double"), k).collect()
    for q in {r[0] for r in rows}:
        ranks = sorted(r["rank"] for r in out if r.query_id == q)
        assert ranks == list(range(1, min(k, sum(x[0] == q for x in rows)) + 1))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abé \n", max_size=60), min_size=1, max_size=6), st.integers(3, 9), st.integers(0, 2))
def test_chunks_cover_the_text(spark, texts, size, overlap):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in df.select("k", T.fixed_chunks(F.col("t"), size, overlap).alias("c")).collect():
        text = ""
        for c in r.c:
            text = text[: c.start] + c.chunk
        assert text == texts[r.k]


@given(st.dictionaries(st.text(alphabet="abc", min_size=1), st.integers() | st.lists(st.integers(), max_size=3), max_size=4))
def test_leaves_of_nested_data(value):
    assert len(extract.leaves(value)) == sum(len(v) if isinstance(v, list) else 1 for v in value.values())
