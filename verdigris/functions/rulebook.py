"""Rule books as columns: triggers of under-specification, prompt families, capsule texts, conflicts.

Every rule book takes its vocabularies as an argument (a name and its words); a null text holds
no word, is empty and has no length, so it fires only what emptiness fires.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris import vocab
from verdigris.functions.scoring import first_match

Words = Mapping[str, tuple[str, ...]]

#: The triggers of under-specification, in the order in which they are reported.
TRIGGERS = ("few_words", "pronoun", "vague_verb", "vague_best", "dependent_subject", "bare_action", "bare_freshness", "needs_context")

# Texts of capsules by type; %1 session, %2 turn, %3 route, %4 reason, %5 what the type adds, %6 summary.
CAPSULES = {
    "goal": "[Goal] Session %1$s turn %2$d: Long-term intent detected (%5$s). Route: %3$s. Reason: %4$s. %6$s",
    "constraint": "[Constraint] Session %1$s turn %2$d: Design constraint identified. Route: %3$s. Reason: %4$s. Notes: %5$s. %6$s",
    "preference": "[Preference] Session %1$s turn %2$d: User preference detected. Route: %3$s. Reason: %4$s. %6$s",
    "open_loop": "[OpenLoop] Session %1$s turn %2$d: Unresolved question — clarification needed before proceeding. Route: %3$s (ask). Reason: %4$s. %6$s",
    "stable_fact": "[StableFact] Session %1$s turn %2$d: Verified or stable information. Route: %3$s, %5$s. Reason: %4$s. %6$s",
}
#: Characters of the summary by type.
SUMMARY = {"goal": 120, "constraint": 100, "preference": 120, "open_loop": 100, "stable_fact": 120}


def _holds(text: Column, words: Words, name: str) -> Column:
    return F.coalesce(vocab.has(text, words[name]), F.lit(False))


def word_count(text: Column) -> Column:
    """Words between white space, and each ideograph or kana as one more; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n]+")) + F.regexp_count(text, F.lit(r"[\x{3000}-\x{9fff}\x{f900}-\x{faff}]")), F.lit(0))


def under_specification(text: Column, asks: Column, continues: Column, words: Words) -> dict[str, Column]:
    """Each trigger as a boolean; ``asks``: the text is a question, ``continues``: turns before it resolve it.

    Of ``words``, definition, reasoning and confirmatory excuse few words; a referent excuses
    freshness in at most eight words.
    """
    holds = lambda name: _holds(text, words, name)
    n = word_count(text)
    fires = (
        (n < 4) & ~holds("definition") & ~continues & ~holds("reasoning") & ~holds("confirmatory"),
        asks & holds("pronoun") & ~holds("reasoning"),
        *(holds(name) for name in TRIGGERS[2:6]),
        holds("freshness") & ~holds("referent") & (n <= 8),
        holds("needs_context") & ~continues,
    )
    return dict(zip(TRIGGERS, fires, strict=True))


def appraised(under: Column, about_self: Column, fresh: Column, referent: Column, stable: Column) -> dict[str, Column]:
    """Completeness, clarity and the ladder of uncertainty."""
    missing = under & ~about_self
    fresh_step = F.when(fresh & referent, 0.8).when(fresh, 0.55).otherwise(0.25)
    ladder = F.when(stable, 0.1).when(under, F.greatest(fresh_step, F.lit(0.55))).otherwise(fresh_step)
    return {"completeness": F.when(missing, 0.35).otherwise(0.8), "clarity": F.when(missing, 0.4).otherwise(0.85), "uncertainty": ladder}


def prompt_family(prompt: Column, words: Words) -> Column:
    """One of six families, the more specific signals first."""
    holds = lambda name: _holds(prompt, words, name)
    inquiry = F.coalesce(F.lower(prompt).rlike(r"^\s*(" + "|".join(words["inquiry"]) + r")($|[^a-z])"), F.lit(False))
    premise = holds("premise") & ~inquiry & (holds("current") | holds("volatile") | holds("entity"))
    return first_match(
        [
            (holds("closed"), "stable_control"), (holds("ambiguous"), "ambiguous_time_frame"), (premise, "stale_premise_trap"),
            (holds("boundary"), "date_boundary"), (holds("current") & holds("volatile"), "volatile_current"),
        ],
        "query_neutrality",
    )


def capsule_text(kind: Column, session: Column, turn: Column, route: Column, reason: Column, added: Column, reply: Column) -> Column:
    """The text of a capsule of a type, without white space around it; empty for a type without template."""
    text = F.lit("")
    for name, template in CAPSULES.items():
        parts = (F.substring(session, 1, 8), turn.cast("int"), route, F.coalesce(F.nullif(reason, F.lit("")), F.lit("unspecified")), F.coalesce(F.nullif(added, F.lit("")), F.lit("none")), F.substring(F.coalesce(reply, F.lit("")), 1, SUMMARY[name]))
        text = F.when(kind == name, F.trim(F.format_string(template, *parts))).otherwise(text)
    return text


def conflict_rank(priority: Column, score: Column, fits: Column, name: Column) -> Column:
    """The largest wins: priority, score, fit with the context, smaller first character, larger name."""
    return F.struct(priority.alias("priority"), score.alias("score"), fits.cast("int").alias("fits"), (-F.ascii(name)).alias("first"), name.alias("name"))


def structure(text: Column, words: Words) -> dict[str, Column]:
    """What a reply's form tells: its length and five flags; a null reply is empty."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return {"length_chars": F.length(t), "ends_with_question": t.endswith("?"), "contains_question": t.contains("?"), "mentions_verify": _holds(t, words, "verify"), "mentions_freshness": _holds(t, words, "freshness"), "is_empty": t == ""}
