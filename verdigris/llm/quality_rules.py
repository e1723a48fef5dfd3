"""Heuristic quality rules as a short-circuit cascade of SQL expressions.

A rule's cost and the share it rejects are estimated on a random sample of all rows; rules
then run in the order of rejections per cost inside one CASE expression, so that a cheap
rule that rejects much spares the dearer ones. A statistic that only a rule needs is
computed inside that rule's branch. The order never changes the verdict.

Defined cases: a null or empty text has no words and is rejected by the base rules; a text
of any length is read whole; rules that tie in rank keep their given order; an empty table
gives an empty table; repeated rows are judged each; extra columns stay in ``passing``, also
where they bear the name of a statistic, and are not read in ``judged``. Repeated windows are
found by their 64-bit hashes within one text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import written

#: Rows on which costs and selectivities are estimated, on average; runs of which the fastest counts.
SAMPLE_ROWS, RUNS = 4000, 2
_GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), "")


def window_hashes(words: Column) -> Column:
    """A hash for each window of three words."""
    return F.when(F.size(words) > 2, F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, k: F.xxhash64(w, F.get(words, k + 1), F.get(words, k + 2)))).otherwise(F.array().cast("array<bigint>"))


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes."""
    by_hash = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        places = F.sort_array(F.transform(twice, lambda x: x["k"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(by_hash, covered))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


#: Statistics of a text and its words; every rule reads some of them.
STATISTICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words),
    "word_chars": lambda text, words: F.length(F.array_join(words, "")),
    "n_symbols": lambda text, words: F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[#*$%&|<>]")),
    "n_upper": lambda text, words: F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Z]")),
    "n_bare_words": lambda text, words: F.size(F.filter(words, lambda w: ~w.rlike(r"[\p{L}\p{N}]"))),
    "n_lines": lambda text, words: F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
    "n_dup_lines": lambda text, words: repeated_lines(text),
    "n_repeat_words": lambda text, words: let(window_hashes(words), repeated_words),
}


#: Statistics that are wanted for every row; the others are computed where a rule needs them.
CONTRACT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """rejects: from the statistics, by name, to a Boolean column."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]


BASE = (
    Rule("few_words", ("n_words",), lambda n_words: n_words < 50),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda n_repeat_words, n_words: 100 * n_repeat_words > 50 * n_words),
)
RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda n_symbols, n_words: 100 * n_symbols > 10 * n_words),
    Rule("bare_words", ("n_bare_words", "n_words"), lambda n_bare_words, n_words: 100 * n_bare_words > 20 * n_words),
    Rule("capitals", ("n_upper", "word_chars"), lambda n_upper, word_chars: 100 * n_upper > 40 * word_chars),
    Rule("word_length", ("word_chars", "n_words"), lambda word_chars, n_words: (word_chars < 2 * n_words) | (word_chars > 15 * n_words)),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda n_dup_lines, n_lines: 100 * n_dup_lines > 40 * n_lines),
)


def on_words(rule: Rule, text: Column, words: Column) -> Column:
    """The rule as an expression of a text and its words."""
    return rule.rejects(*(STATISTICS[s](text, words) for s in rule.needs))


def ordered(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on a random sample of all rows, the best first.

    A rule's seconds are those of its job less those of a job that only splits the words.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = written(docs.select("text").sample(share, seed=5) if share < 1 else docs.select("text"), "rules-sample")
    tests = {None: lambda words: F.size(words) < 0} | {rule.name: partial(on_words, rule, F.col("text")) for rule in rules}
    took, rejected = dict.fromkeys(tests, float("inf")), {}
    for _ in range(RUNS):
        for name, test in tests.items():
            job = sample.agg(F.count_if(let(words_of(F.col("text")), test)), F.count("*"))
            began = time.perf_counter()
            rejected[name], n = job.first()
            took[name] = min(took[name], time.perf_counter() - began)
    worth = {name: (rejected[name] + 1) / max(1, n) / max(took[name] - took[None], 1e-3) for name in tests}
    return sorted(rules, key=lambda r: -worth[r.name])


def cascade(rules: list[Rule], test: Callable[[Rule], Column]) -> Column:
    """The name of the first rule that rejects, else null; later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(test(rule), F.lit(rule.name)).otherwise(verdict)
    return verdict


def with_statistics(docs: DataFrame, names: tuple[str, ...] = CONTRACT) -> DataFrame:
    """doc_id, text, the words and the named statistics; words and windows are computed once for all."""
    shared = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    if "n_repeat_words" in names:
        shared = shared.select("*", window_hashes(F.col("words")).alias("windows"))
    found = {s: repeated_words(F.col("windows")) if s == "n_repeat_words" else STATISTICS[s](F.col("text"), F.col("words")) for s in names}
    return shared.select("doc_id", "text", "words", *(c.cast("long").alias(s) for s, c in found.items()))


def judged(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the contract's statistics, base_failed, the rule that rejects and kept, for every row."""
    order = ordered(docs, RULES, sample_rows)
    seen = with_statistics(docs)

    def test(rule: Rule) -> Column:
        return rule.rejects(*(F.col(s) if s in CONTRACT else STATISTICS[s](F.col("text"), F.col("words")) for s in rule.needs))

    base = F.lit(False)
    for rule in BASE:
        base = base | test(rule)
    verdict = seen.select("*", base.alias("base_failed")).select("doc_id", *CONTRACT, "base_failed", F.when(~F.col("base_failed"), cascade(order, test)).alias("rule"))
    return verdict.select(F.col("doc_id").cast("long"), *CONTRACT, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def passing(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    order = ordered(docs, BASE + RULES, sample_rows)
    return docs.filter(let(words_of(F.col("text")), lambda words: cascade(order, lambda rule: on_words(rule, F.col("text"), words))).isNull())
