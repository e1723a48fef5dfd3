"""Language by character n-grams: naive Bayes profiles counted from labelled texts.

A profile holds the MOST commonest n-grams of each language; the union of the profiles, a
bounded table, is what texts are compared by. A text's score for a language is the sum of the
logarithms of its distinct n-grams' smoothed frequencies there. All is grouping and joins.

Defined cases: null and blank texts, and texts without any n-gram of the profiles, have no
language (null); ties go to the first language by name; labels without a language do not count;
n-grams are of the text in lower case, white space being one blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.text import all_grams

#: n-grams of a profile, and their length.
MOST, N = 1500, 3


def prepared(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", " ")


def profiles(labelled: DataFrame, most: int = MOST, n: int = N) -> DataFrame:
    """(gram, lang, weight): for every n-gram of some profile and every language the logarithm of its frequency."""
    counts = labelled.filter("lang is not null and text is not null").select("lang", F.explode(all_grams(prepared(F.col("text")), n)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("c"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "gram"))).filter(F.col("r") <= most)
    kept = top.select("gram").distinct()
    held = counts.join(F.broadcast(kept), "gram")
    totals = held.groupBy("lang").agg(F.sum("c").alias("total"))
    size = kept.count()
    languages = [(r["lang"], r["total"]) for r in totals.collect()]
    every = kept.withColumn("l", F.explode(F.array(*(F.struct(F.lit(a).alias("lang"), F.lit(t).cast("long").alias("total")) for a, t in languages)))) if languages else kept.join(totals, F.lit(False))
    every = (every.select("gram", "l.lang", "l.total") if languages else every).join(held, ["gram", "lang"], "left")
    return every.select("gram", "lang", F.log((F.coalesce("c", F.lit(0)) + 1) / (F.col("total") + size).cast("double")).alias("weight"))


def detected(texts: DataFrame, key: str, profile: DataFrame, n: int = N) -> DataFrame:
    """(key, detected) of texts whose n-grams are known; a text is one row of scores, never its n-grams' product with languages shuffled."""
    grams = texts.filter("text is not null").select(key, F.explode(F.array_distinct(all_grams(prepared(F.col("text")), n))).alias("gram"))
    # One row for each n-gram: its weights by language. Bounded by the profiles.
    weights = profile.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("lang", "weight"))).alias("w"))
    langs = [r["lang"] for r in profile.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return texts.select(key, F.lit(None).cast("string").alias("detected")).limit(0)
    found = grams.join(F.broadcast(weights), "gram").groupBy(key).agg(*(F.sum(F.get("w", k)["weight"]).alias(f"s{k}") for k in range(len(langs))))
    best = F.array_max(F.array(*(F.struct(F.col(f"s{k}").alias("s"), F.lit(-k).alias("k")) for k in range(len(langs)))))
    names = F.array(*map(F.lit, langs))
    return found.select(key, F.get(names, -best["k"]).alias("detected"))
