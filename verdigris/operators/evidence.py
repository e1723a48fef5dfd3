"""Evidence sets: normalisation of search results and their adjudication.

Results are (query_id, rank, url, snippet); a set is one row per query. Groups are bounded
by what a search returns, and all set features come from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris import vocab
from verdigris.functions import text as T
from verdigris.functions.scoring import codes, first_match

ORDINALS = {"stale": 0, "acceptable": 1, "current": 2, "weak": 0, "moderate": 1, "strong": 2}


def normalised(results: DataFrame, most: int = 8) -> DataFrame:
    """Drop empty results, keep the first of each canonical URL, and at most ``most`` by rank."""
    r = results.filter("url is not null and url != '' and snippet is not null and snippet != ''").withColumn("canonical", T.canonical_url(F.col("url")))
    once = r.withColumn("__r", F.row_number().over(Window.partitionBy("query_id", "canonical").orderBy("rank"))).filter("__r = 1")
    return once.withColumn("__r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("__r") <= most).drop("__r")


def freshness(text: Column, current=vocab.FRESH, stale=vocab.OUTDATED) -> Column:
    """Current words go before stale ones."""
    return first_match([(vocab.has(text, current), "current"), (vocab.has(text, stale), "stale")], "acceptable")


def provenance(host: Column, strong: tuple[str, ...], weak: tuple[str, ...]) -> Column:
    ends = lambda list_: F.lit(False) if not list_ else F.exists(vocab.array(list_), lambda s: host.endswith(s))
    starts = F.exists(vocab.array(weak), lambda s: host.startswith(s))
    return first_match([(ends(strong), "strong"), (starts, "weak")], "moderate")


def diversity(sources: Column, n: Column) -> Column:
    return first_match([((sources >= 4) | ((sources >= 3) & (sources / n >= 0.6)), "high"), (sources >= 2, "medium")], "low")


def agreement(conflicts: Column, n: Column) -> tuple[Column, Column]:
    few = (conflicts == 1) | (conflicts / n < 0.4)
    return first_match([(conflicts == 0, "high"), (few, "mixed")], "low"), first_match([(conflicts == 0, "none"), (few, "minor")], "open")


def strength(sources: Column, diversity_: Column, agreement_: Column, provenance_: Column) -> Column:
    points = F.least(F.lit(2), F.greatest(F.lit(0), sources - 1)) + first_match([(diversity_ == "high", 2), (diversity_ == "medium", 1)], 0) + first_match([(agreement_ == "high", 2), (agreement_ == "mixed", 1)], 0) + first_match([(provenance_ == "strong", 2), (provenance_ == "moderate", 1)], 0)
    return first_match([(points >= 6, "strong"), (points >= 3, "medium")], "weak")


def adjudicated(items: DataFrame) -> DataFrame:
    """One row per query from items (query_id, source, freshness, provenance, conflicting)."""
    ordinal = lambda c: first_match([(F.col(c) == k, v) for k, v in ORDINALS.items()], 1)
    sets = items.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.count_if("conflicting").alias("conflicts"), F.min(ordinal("freshness")).alias("f"), F.sum(ordinal("provenance")).alias("p"))
    agree, conflict = agreement(F.col("conflicts"), F.col("n"))
    mean = F.col("p") / F.col("n")
    sets = sets.withColumns({"freshness": first_match([(F.col("f") == 0, "stale"), (F.col("f") == 1, "acceptable")], "current"), "provenance": first_match([(mean >= 1.5, "strong"), (mean >= 0.8, "moderate")], "weak"), "diversity": diversity(F.col("sources"), F.col("n")), "agreement": agree, "conflict": conflict})
    return sets.withColumn("strength", strength(F.col("sources"), F.col("diversity"), F.col("agreement"), F.col("provenance"))).drop("f", "p")


def admissibility(sets: DataFrame) -> DataFrame:
    """Rules A to E, the first that matches."""
    c = F.col
    rule = first_match([
        ((c("freshness") == "stale") | (c("strength") == "weak") & (c("provenance") == "weak"), "reject"), (c("conflict") == "open", "ask"),
        ((c("strength") == "strong") & (c("agreement") == "high") & (c("freshness") != "stale"), "admit"), ((c("strength") != "weak") & (c("conflict") != "open"), "admit_bounded"),
    ], "insufficient")
    return sets.withColumn("admissibility", rule)


def claim_agreement(claims: DataFrame) -> DataFrame:
    """high, mixed or low agreement of each query's claims (query_id, rank, claim).

    Claims of two words or fewer say nothing: mixed. Number sets of pairs overlap in a
    share of the pairs; without numbers the first two claims' words are compared.
    """
    c = claims.select("query_id", "rank", F.array_distinct(F.regexp_extract_all("claim", F.lit("[0-9]+"), 0)).alias("nums"), F.array_distinct(F.split(F.lower("claim"), " ")).alias("words"))
    pair = c.alias("a").join(c.alias("b"), F.expr("a.query_id = b.query_id and a.rank < b.rank"))
    numbers = pair.filter("size(a.nums) > 0 and size(b.nums) > 0").groupBy(F.col("a.query_id").alias("query_id")).agg((F.count_if(F.arrays_overlap("a.nums", "b.nums")) / F.count("*")).alias("rate"))
    first = c.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "words"))).alias("w"), F.max(F.size("words")).alias("longest"))
    share = F.size(F.array_intersect(F.get("w", 0)["words"], F.get("w", 1)["words"])) / F.least(F.size(F.get("w", 0)["words"]), F.size(F.get("w", 1)["words"]))
    joined = first.join(numbers, "query_id", "left")
    return joined.select("query_id", first_match([(F.col("longest") <= 2, "mixed"), (F.col("rate") >= 0.7, "high"), (F.col("rate") >= 0.3, "mixed"), (F.col("rate").isNotNull(), "low"), (F.size("w") < 2, "mixed"), (share >= 0.5, "high"), (share >= 0.2, "mixed")], "low").alias("agreement"))


def outcome(admissibility_: Column) -> Column:
    return first_match([(admissibility_ == "admit", "answer"), (admissibility_ == "admit_bounded", "bounded_answer"), (admissibility_ == "ask", "ask")], "abstain")


def notes(sets: DataFrame) -> Column:
    return F.array_join(codes([(F.col("freshness") == "stale", "stale"), (F.col("conflict") != "none", "conflict"), (F.col("diversity") == "low", "single_source")]), ",")


def second_adjudication(items: DataFrame, flags: dict[str, Column], strong: tuple[str, ...], moderate: tuple[str, ...]) -> DataFrame:
    """One row per query from items (query_id, rank, source, claim, web): eight steps, the last a verdict.

    flags: fresh, high_word, medium_word (what the query asks for) and gain (of coherence). The
    estimate of volatility and reliability is the stub's, from those words alone.
    """
    some = lambda names: F.exists(F.array(*map(F.lit, names)), lambda x: F.contains("source", x))
    sets = items.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("domains"), F.count_if(some(strong)).alias("s"), F.count_if(some(moderate)).alias("m"), F.bool_or("web").alias("has_web"))
    t = sets.join(claim_agreement(items.select("query_id", "rank", "claim")).withColumnRenamed("agreement", "said"), "query_id").withColumns(flags)
    c = F.col
    t = t.withColumns({
        "freshness": first_match([(~(c("fresh") | c("high_word") | c("medium_word")), "stable"), (c("fresh") & c("has_web"), "current"), (c("fresh"), "stale_risk")], "time_sensitive"),
        "diversity": first_match([(c("domains") >= 3, "high"), (c("domains") == 2, "moderate")], "low"), "agreement": F.when(c("n") <= 1, "high").otherwise(c("said")),
        "provenance": first_match([(c("s") >= 2, "strong"), ((c("s") >= 1) | (c("m") >= 1), "moderate")], "weak"),
        "tvs": first_match([(c("high_word"), 0.8), (c("fresh"), 0.7), (c("medium_word"), 0.5)], 0.2), "mkr": first_match([(c("high_word") | c("fresh"), 0.4), (c("medium_word"), 0.55)], 0.65),
    })
    t = t.withColumn("conflict", first_match([(c("agreement") == "high", "none"), (c("agreement") == "mixed", "managed")], "open"))
    settled = c("freshness").isin("stable", "current")
    firm = (c("diversity") == "high") & (c("agreement") == "high") & c("provenance").isin("moderate", "strong") & settled
    frail = (c("diversity") == "low") | (c("agreement") == "low") | (c("freshness") == "stale_risk")
    t = t.withColumn("strength", first_match([(c("conflict") == "open", "weak"), (firm, "strong"), (frail, "weak")], "medium"))
    gate = (c("tvs") < 0.6) & (c("mkr") > 0.5) & ~(c("gain") > 0.7)
    return t.withColumn("admissibility", first_match([(c("conflict") == "open", "bounded"), ((c("strength") == "strong") & settled & gate, "answerable"), (c("strength").isin("medium", "strong"), "bounded")], "failed"))
