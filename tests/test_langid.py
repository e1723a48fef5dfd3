"""Languages by n-grams on held-out documents, and odd texts."""

from pyspark.sql import functions as F

from verdigris.operators import langid
from verdigris.plans import registry


def test_held_out_accuracy(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    got = registry.queries()["c10_ngram_language"](spark, d).filter("held_out")
    n, right, vote = got.join(registry.queries()["c10_language"](spark, d).select("doc_id", F.col("detected").alias("voted")), "doc_id").agg(F.count("*"), F.avg((F.col("detected") == F.col("lang")).cast("int")), F.avg((F.col("voted") == F.col("lang")).cast("int"))).first()
    assert n > 150 and right >= 0.97 and right >= vote


def test_odd_texts(spark):
    d = spark.createDataFrame([(1, "en", "the cat and the hat"), (2, "de", "der hund und die katze"), (3, None, "the the the"), (4, "en", None)], "doc_id long, lang string, text string")
    profile = langid.profiles(d)
    texts = spark.createDataFrame([(1, "THE  HAT"), (2, "und die"), (3, None), (4, ""), (5, "zzzzzz"), (6, "日本語")], "doc_id long, text string")
    assert {r.doc_id: r.detected for r in langid.detected(texts, "doc_id", profile).collect()} == {1: "en", 2: "de"}
    assert langid.detected(texts, "doc_id", langid.profiles(d.limit(0))).count() == 0
