"""Alias lookup: exact, plural rules, then an upper-case token within a sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aliases(words: DataFrame, table: DataFrame) -> DataFrame:
    """(id, target) for each (id, word): the candidate form of the best priority that is an alias.

    Candidate forms are few per word, so the join is on their keys.
    """
    w = F.lower(F.trim("word"))
    form = lambda p, x: F.struct(F.lit(p).alias("priority"), x.alias("alias"))
    # Tokens in upper case, of two characters or more, less the punctuation around them.
    bare = F.transform(F.split("word", r"[ \t\n\r\f]+"), lambda t: F.regexp_replace(t, r"""^[,.?!:;'"()\[\]]+|[,.?!:;'"()\[\]]+$""", ""))
    upper = F.filter(bare, lambda t: (F.length(t) >= 2) & (t == F.upper(t)) & (t != F.lower(t)))
    capitals = F.transform(upper, lambda t, i: F.struct((i + 4).alias("priority"), F.lower(t).alias("alias")))
    forms = F.concat(
        F.array(form(0, w)),
        F.array(form(1, F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(F.substr(w, F.lit(1), F.length(w) - 3), F.lit("y"))))),
        F.array(form(2, F.when(w.endswith("es") & (F.length(w) > 3), F.substr(w, F.lit(1), F.length(w) - 2)))),
        F.array(form(3, F.when(w.endswith("s") & (F.length(w) > 2), F.substr(w, F.lit(1), F.length(w) - 1)))),
        capitals,
    )
    candidates = words.select("id", F.explode(forms).alias("c")).select("id", "c.priority", "c.alias").filter("alias is not null")
    best = candidates.join(table, "alias").groupBy("id").agg(F.min_by("target", "priority").alias("target"))
    return words.select("id").join(best, "id", "left")
