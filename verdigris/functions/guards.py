"""Rules that rewrite a reply one after another: each sees the text as the rules before left it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule: its name, when it fires on the text so far, and what it makes of it.
Rule = tuple[str, Callable[[Column], Column], Callable[[Column], Column]]


def in_sequence(rows: DataFrame, text: str, rules: list[Rule], fired: str = "fired") -> DataFrame:
    """rows with ``text`` rewritten and the array ``fired`` of the rules that rewrote or flagged it, in order."""
    known = rows.withColumn(fired, F.array().cast("array<string>"))
    for name, when, then in rules:
        hit = F.coalesce(when(F.col(text)), F.lit(False))
        known = known.withColumn("__hit", hit).withColumns({text: F.when(F.col("__hit"), then(F.col(text))).otherwise(F.col(text)), fired: F.when(F.col("__hit"), F.array_append(fired, F.lit(name))).otherwise(F.col(fired))}).drop("__hit")
    return known


def prefixed(prefix: str) -> Callable[[Column], Column]:
    return lambda t: F.concat(F.lit(prefix), t)


def kept(t: Column) -> Column:
    """A rule that only flags."""
    return t


def head(t: Column, n: int) -> Column:
    return F.substring(t, 1, n)


def without_first_sentence(t: Column) -> Column:
    """What follows the first sentence's end; all of it where nothing follows."""
    rest = F.regexp_extract(t, r"(?s)^[^.!?]*[.!?]+\s+(.+)$", 1)
    return F.when(rest != "", rest).otherwise(t)
