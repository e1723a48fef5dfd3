"""Posting lists and secondary indexes: equal to a scan, and reading little."""

import random

from pyspark.sql import functions as F

from verdigris.operators import postings as P
from verdigris.sources import side_index


def texts(n=300, seed=4):
    rng = random.Random(seed)
    words = ["the", "of", "alpha", "beta", "gamma", "Äther", "日本語", "x", "a😀b", "delta-7"] + [f"w{k}" for k in range(40)]
    rows = [(k * 7, " ".join(rng.choices(words, weights=[30, 20] + [1] * (len(words) - 2), k=rng.randint(0, 30)))) for k in range(n)]
    return rows + [(5, ""), (6, None), (None, "alpha"), (5, "the repeated row"), (5, "the repeated row")]


def test_term_lookup_equals_first_seen_merging(spark):
    docs = texts()
    asked = [(1, ["alpha", "the", "alpha"]), (2, ["none", "w3", "w4", "of"]), (3, []), (4, None), (5, ["the"]), (6, ["none"]), (7, [None, "beta"])]
    split = F.split("text", " ")
    lists = P.stored(P.term_index(spark.createDataFrame(docs, "doc_id long, text string"), split, block=64))
    held: dict = {}
    for d, t in docs:
        if d is not None and t is not None:
            for w in t.split(" "):
                held.setdefault(w, set()).add(d)
    got: dict = {}
    for r in P.looked_up(spark.createDataFrame(asked, "query_id long, terms array<string>"), lists, 9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.term))
    want = {}
    for q, terms in asked:
        seen: dict = {}
        for t in terms or []:
            for d in sorted(held.get(t, ())):
                seen.setdefault(d, t)
        if seen:
            want[q] = [(k + 1, d, t) for k, (d, t) in enumerate(list(seen.items())[:9])]
    assert got == want
    # Lists are cut into blocks, and only those with a first document are decoded.
    blocks = lists.filter("term = 'the'").count()
    assert blocks > 20 and P.heads(lists, 9).filter("term = 'the'").count() <= 3
    assert {r.term: r.n for r in lists.groupBy("term").agg(F.sum("n").alias("n")).collect()} == {t: len(d) for t, d in held.items()}


def test_gaps_give_the_documents_back(spark):
    ids = sorted(random.Random(1).sample(range(10**6), 500))
    lists = P.postings(spark.createDataFrame([("t", i) for i in ids] * 2, "term string, doc_id long"), block=1000)
    got = [d for r in lists.orderBy("block").select(P.documents_of(F.col("first"), F.col("gaps")).alias("d")).collect() for d in r.d]
    assert got == ids


def test_substring_search_equals_the_scan(spark):
    docs = [r for r in texts() if r[0] not in (5,)] + [(5, "The ReThe")]
    sought = ["alpha", "a b", "ÄTHER", "日本語", "😀b", "the of", "w3", "x", "", None, "nowhere", "delta-7 the", "qq", "THE"]
    q = spark.createDataFrame([(k, s) for k, s in enumerate(sought)], "query_id long, sought string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lists = P.stored(P.trigram_index(df, block=64))
    want = {(k, d) for k, s in enumerate(sought) if s for d, t in docs if d is not None and t is not None and s.lower() in t.lower()}
    assert set(map(tuple, P.containing(q, df, lists).collect())) == want
    # What is verified holds the rarest trigrams, of the rarer word; it is not all texts.
    near = P.candidates(q.filter("sought in ('alpha', 'delta-7 the', 'nowhere')"), lists)
    holding = lambda w: len([1 for d, t in docs if d is not None and t and w in t.lower()])
    assert near.count() <= holding("alpha") + holding("delta-7") < len(docs) / 2


def test_pruned_files_lose_no_row(spark, tmp_path):
    path, index = f"file://{tmp_path}/rows", f"file://{tmp_path}/index"
    rng = random.Random(2)
    rows = [(k, rng.randrange(10**6) if k % 50 else None, f"n{rng.randrange(3000)}") for k in range(4000)]
    df = spark.createDataFrame(rows, "k long, v long, name string")
    df.repartitionByRange(20, "k").write.parquet(path)
    assert side_index.build(spark, path, ["k", "v", "name"], index) == 20
    assert side_index.build(spark, path, ["k", "v", "name"], index) == 0
    asked = [rows[17][1], rows[2301][1], -5, None, 10**7]
    keys = spark.createDataFrame([(a,) for a in asked], "v long")
    files = side_index.admitting(spark, path, index, "v", keys)
    assert 1 <= len(files) <= 4
    got = sorted(map(tuple, side_index.rows_of(spark, path, index, "v", keys).select("k", "v", "name").collect()))
    assert got == sorted(r for r in rows if r[1] in asked and r[1] is not None)
    near = spark.createDataFrame([(100,), (101,)], "k long")
    assert len(side_index.admitting(spark, path, index, "k", near)) == 1  # ranges alone prune it
    names = spark.createDataFrame([("n7",), ("nowhere",)], "name string")
    assert sorted(r.k for r in side_index.rows_of(spark, path, index, "name", names).collect()) == [r[0] for r in rows if r[2] == "n7"]
    # Further files are added by the next build, and found.
    spark.createDataFrame([(9000, asked[0], "late")], "k long, v long, name string").coalesce(1).write.mode("append").parquet(path)
    assert side_index.build(spark, path, ["k", "v", "name"], index) == 1
    assert 9000 in [r.k for r in side_index.rows_of(spark, path, index, "v", keys).collect()]
    none = f"file://{tmp_path}/none"
    df.limit(0).write.parquet(none)
    side_index.build(spark, none, ["v"], f"{none}-index")
    assert side_index.rows_of(spark, none, f"{none}-index", "v", keys).count() == 0


def test_full_blocks_are_decoded_in_one_pass(spark):
    """Twenty full blocks; copying the list for each document would take minutes."""
    import time

    n = P.BLOCK
    lists = spark.range(20).select((F.col("id") * n).alias("first"), F.array_repeat(F.lit(1), n - 1).alias("gaps"))
    began = time.time()
    d = lists.select(P.documents_of(F.col("first"), F.col("gaps")).alias("d")).select(F.size("d").alias("n"), F.get("d", 0).alias("a"), F.get("d", n - 1).alias("z")).collect()
    assert sorted((r.n, r.a, r.z) for r in d) == [(n, k * n, k * n + n - 1) for k in range(20)]
    assert time.time() - began < 15
