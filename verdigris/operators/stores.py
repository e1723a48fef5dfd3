"""Mutations as table rewrites: upsert, removal, proposals, counters and lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.scoring import first_match


def upserted(store: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of the store less those changed, and the changes."""
    return store.join(changes.select(key), key, "left_anti").select(store.columns).unionByName(changes.select(store.columns))


def removal_log(store: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """removed or missing for each id asked for."""
    return ids.join(store.select(key, F.lit(True).alias("__there")), key, "left").select(key, F.when(F.col("__there"), "removed").otherwise("missing").alias("outcome"))


def flushed(counts: DataFrame, deltas: DataFrame, key: str) -> DataFrame:
    """Counter table with the deltas added; the latest hit wins."""
    return counts.unionByName(deltas).groupBy(key).agg(F.sum("hits").alias("hits"), F.max("last").alias("last"))


def layered(store: DataFrame, key: str, latest: Column, noise: Column, due: Column, most: int = 5) -> DataFrame:
    """One round of the layer pipeline over a store with a column layer.

    Rows of layer 0 that are due go to -1 if they are noise, else to 1; those not due stay. Then
    a key's latest rows of layers 1 and 2, a bounded number, are 2, and the others go back to 1.
    """
    rows = store.withColumn("__to", F.when((F.col("layer") == 0) & due, F.when(noise, -1).otherwise(1)).otherwise(F.col("layer")))
    active = F.col("__to") > 0
    # Ordered by the old layer too, so that rows of one key and place have one result.
    w = Window.partitionBy(key).orderBy(latest, F.desc("layer")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__r", F.count(F.when(active, 1)).over(w))
    return rows.withColumn("layer", first_match([(active & (F.col("__r") <= most), 2), (active, 1)], F.col("__to"))).drop("__to", "__r")


def staleness(age_days: Column, limit_days: Column) -> Column:
    return first_match([(age_days > 2 * limit_days, "stale"), (age_days > limit_days, "aging")], "fresh")


def proposed(store: DataFrame, proposals: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Store rows with valid proposals (reason long enough) appended to their history."""
    good = proposals.filter(F.length("reason") >= least).groupBy(key).agg(F.count("*").alias("added"))
    return store.join(good, key, "left").withColumns({"proposals": F.col("proposals") + F.coalesce("added", F.lit(0)), "status": F.when(F.col("added") > 0, "deletion_proposed").otherwise(F.col("status"))}).drop("added")


def migrated(rows: DataFrame, mapping: DataFrame, source: str) -> DataFrame:
    """Map an intent to its sub-topic; unmapped ones get ''."""
    return rows.join(F.broadcast(mapping), source, "left").withColumn("sub_topic", F.coalesce("sub_topic", F.lit("")))


def verified(facts: DataFrame, most_tvs: float = 0.3) -> DataFrame:
    """Facts that are stable enough to store; of equal claims of a session the last replaces the others."""
    stable = facts.filter(F.col("tvs") < most_tvs)
    return stable.groupBy("session", "claim").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("times"))


def names_fact(query: Column, claim: Column, longer_than: int = 3) -> Column:
    """Whether a longer word of a claim stands in the query."""
    return F.exists(F.split(F.lower(claim), " "), lambda w: (F.length(w) > longer_than) & F.contains(F.lower(query), w))


def correction_log(corrections: DataFrame, lists: tuple[str, ...] = ("facts", "assumptions", "open_questions", "constraints")) -> DataFrame:
    """Corrections (session, turn, field, new_value) in order with the value that a summary had before; unknown fields are refused."""
    known = corrections.filter(F.col("field").isin("summary", *lists))
    before = F.lag("new_value").over(Window.partitionBy("session", "field").orderBy("turn"))
    return known.withColumn("old_value", F.when(F.col("field") == "summary", before)).select("session", "turn", "field", "old_value", "new_value")


def promoted(evaluated: DataFrame) -> DataFrame:
    """A record of each evaluation (doc_id, outcome, entry_id, quality), and an entry of each that is promoted."""
    record = evaluated.select("doc_id", F.lit("record").alias("kind"), "outcome", F.lit(None).cast("string").alias("entry_id"), "quality")
    return record.unionByName(evaluated.filter("outcome = 'promoted'").select("doc_id", F.lit("entry").alias("kind"), "outcome", "entry_id", "quality"))


def distilled(session: DataFrame, stored: DataFrame, key: str, most: int = 16, most_chars: int = 240) -> DataFrame:
    """The profile after a session: (key, pass, language, abstraction, frames, rejected, confidence).

    session: key, n (turns), confidence, cold, language, frames, abstraction; stored has the
    last four but cold. Below the floors nothing changes. Long texts and those of several
    sentences are no tags; lists keep their order and at most ``most`` entries.
    """
    old = stored.select(key, *(F.col(c).alias(f"old_{c}") for c in ("language", "abstraction", "frames", "confidence")))
    both = session.join(old, key, "left")
    had = F.coalesce("old_frames", F.array().cast("array<string>"))
    passed = (F.col("confidence") >= 0.45) & (F.col("n") >= 3) & ~F.col("cold")
    tag = lambda f: (F.length(F.trim(f)) > 0) & (F.length(f) <= most_chars) & (F.regexp_count(f, F.lit("[.。!?？！]")) < 2)
    good = F.filter("frames", tag)
    before, sure = F.coalesce("old_abstraction", F.lit(0.0)), F.coalesce("old_confidence", F.lit(0.0))
    carried = F.when(passed & (F.abs(before - F.col("abstraction")) > 0.05), F.greatest(F.lit(0.0), F.least(F.lit(2.0), "abstraction"))).otherwise(before)
    return both.select(
        key, passed.alias("pass"), F.when(passed & F.col("language").isin("ja", "en", "fr", "de", "es", "zh"), F.col("language")).otherwise(F.col("old_language")).alias("language"), carried.alias("abstraction"),
        F.when(passed, F.slice(F.concat(had, F.array_except(good, had)), 1, most)).otherwise(had).alias("frames"), F.when(passed, F.size("frames") - F.size(good)).otherwise(1).alias("rejected"), F.when(passed, F.greatest(sure, F.least("confidence", F.lit(0.9)))).otherwise(sure).alias("confidence"),
    )
