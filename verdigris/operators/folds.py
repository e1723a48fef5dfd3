"""Ordered state folds per session, and window forms of stateful rules.

A fold whose state is clipped at each step has no window form: it gathers one session's
steps in order and folds the array. A session that outgrows a row goes through
``controller_long``, which folds in Arrow batches of one session's sorted rows, with
constant memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.scoring import clip, first_match

START, GAIN, FRESH, DAMP, SCALE = 0.20, 0.30, 0.20, 0.10, 0.37


def band(phi: Column) -> Column:
    return first_match([(phi <= 0.30, "answer"), (phi <= 0.60, "self_check"), (phi <= 0.90, "verify")], "ask_abstain")


def controller(steps: DataFrame) -> DataFrame:
    """phi after each step of (session_id, seq, pi, fresh): a clipped recurrence from 0.20."""
    s = steps.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "pi", "fresh"))).alias("steps"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + 1
        phi = clip(a["phi"] + GAIN * F.least(F.lit(1.0), x["pi"] / SCALE) + FRESH * clip(x["fresh"]) - DAMP * F.least(F.lit(1.0), n / 10.0))
        return F.struct(phi.alias("phi"), n.alias("n"), F.array_append(a["all"], F.struct(x["seq"].alias("seq"), phi.alias("phi"))).alias("all"))

    empty = F.array().cast("array<struct<seq:bigint,phi:double>>")
    folded = s.select("session_id", F.explode(F.aggregate("steps", F.struct(F.lit(START).alias("phi"), F.lit(0).alias("n"), empty.alias("all")), step, lambda a: a["all"])).alias("x"))
    return folded.select("session_id", "x.seq", "x.phi", band(F.col("x.phi")).alias("band"))


def controlled(steps: DataFrame, partitions: int, most: int = 256) -> DataFrame:
    """``controller`` for sessions of at most ``most`` steps, whose array grows by copying, ``controller_long`` for others."""
    longer = steps.groupBy("session_id").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("session_id")
    columns = ("session_id", "seq", "phi", "band")
    short = controller(steps.join(longer, "session_id", "left_anti")).select(*columns)
    return short.unionByName(controller_long(steps.join(longer, "session_id", "left_semi"), partitions).select(*columns))


def controller_long(steps: DataFrame, partitions: int) -> DataFrame:
    """The same for sessions of any length: rows sorted within partitions, state in one pass."""
    dealt = steps.select("session_id", "seq", "pi", "fresh").repartition(partitions, "session_id").sortWithinPartitions("session_id", "seq")

    def run(batches):
        import pyarrow as pa

        at, phi, n = None, START, 0
        for b in batches:
            out = []
            for s, pi, fresh in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if s != at:
                    at, phi, n = s, START, 0
                n += 1
                phi = max(0.0, min(1.0, phi + GAIN * min(1.0, pi / SCALE) + FRESH * max(0.0, min(1.0, fresh)) - DAMP * min(1.0, n / 10.0)))
                out.append(phi)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["session_id", "seq", "phi"])

    return dealt.mapInArrow(run, "session_id long, seq long, phi double").withColumn("band", band(F.col("phi")))


def runs(rows: DataFrame, session: str, order: str, key: Column) -> DataFrame:
    """Length of the run of equal keys up to each row (gaps and islands)."""
    w = Window.partitionBy(session).orderBy(order)
    marked = rows.withColumn("__key", key).withColumn("__new", F.when(F.col("__key").eqNullSafe(F.lag("__key").over(w)), 0).otherwise(1))
    grouped = marked.withColumn("__island", F.sum("__new").over(w))
    return grouped.withColumn("run", F.row_number().over(Window.partitionBy(session, "__island").orderBy(order))).drop("__key", "__new", "__island")


def ema(rows: DataFrame, session: str, order: str, value: Column, keep: float, start: float) -> DataFrame:
    """Last exponential average of each session: a fold over its ordered values."""
    g = rows.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("all"))
    return g.select(session, F.aggregate("all", F.lit(start), lambda a, x: keep * a + (1 - keep) * x["v"]).alias("ema"), F.size("all").alias("n"))


def themes(tokens: DataFrame) -> DataFrame:
    """Theme weight of each (session, token) from (session, token, turn, explicit): decays when the token comes again."""
    g = tokens.groupBy("session", "token").agg(F.array_sort(F.collect_list(F.struct("turn", "explicit"))).alias("all"))
    step = lambda a, x: F.struct(F.least(F.lit(2.0), a["w"] * 0.85 + 0.55 + F.when(a["n"] > 0, 0.30).otherwise(0.0) + F.when(x["explicit"], 0.15).otherwise(0.0)).alias("w"), (a["n"] + 1).alias("n"))
    weight = F.aggregate("all", F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("n")), step, lambda a: a["w"])
    return g.select("session", "token", weight.alias("weight"), (weight >= 0.58).alias("active"))


def sessions_by_gap(events: DataFrame, key: str, ts: str, gap: str, order: str) -> DataFrame:
    """Quiet-period sessions: a new one begins after the gap."""
    w = Window.partitionBy(key).orderBy(ts, order)
    new = F.when(F.lag(ts).over(w).isNull() | (F.col(ts) - F.lag(ts).over(w) > F.expr(f"interval {gap}")), 1).otherwise(0)
    marked = events.withColumn("__new", new).withColumn("session", F.sum("__new").over(w)).drop("__new")
    return marked.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def ring(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The latest rows of each key, a bounded number."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__r") <= most).drop("__r")


def fired(turns: Column, first: int, interval: int) -> Column:
    """How often a gate opens over so many turns: from ``first`` on, when ``interval`` turns have passed since the last time."""
    step = lambda a, t: F.when((t >= first) & (t - a["last"] >= interval), F.struct(t.alias("last"), (a["n"] + 1).alias("n"))).otherwise(a)
    start = F.struct(F.lit(-interval).cast("long").alias("last"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(turns, F.lit(1)).cast("long")), start, step, lambda a: a["n"])


#: Labels before a turn that its baseline folds: the weight of earlier ones is below a double's precision.
FOLDED = 200


def before_turns(users: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Add what a session's user turns (conv_id, turn, cues, tokens, label) before each showed: had, n, baseline, theme.

    had: the cues (of ``names``) given before; theme: the turn's tokens that two earlier turns
    have, by a running number for each (session, token). Nothing grows with the session but rows.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-FOLDED, -1)
    had = F.array_compact(F.array(*(F.when(F.max(F.array_contains("cues", n)).over(w), F.lit(n)) for n in names)))
    listed = users.withColumns({"had": had, "n": F.count("*").over(w), "labels": F.collect_list("label").over(near)})
    listed = listed.withColumn("baseline", F.aggregate("labels", F.lit(0.0), lambda a, x: 0.75 * a + 0.25 * x)).drop("labels")
    times = F.row_number().over(Window.partitionBy("conv_id", "token").orderBy("turn"))
    themes = users.select("conv_id", "turn", F.explode("tokens").alias("token")).withColumn("k", times).filter("k > 2").groupBy("conv_id", "turn").agg(F.collect_list("token").alias("theme"))
    return listed.join(themes, ["conv_id", "turn"], "left").withColumn("theme", F.coalesce("theme", F.array().cast("array<string>")))


def adoption_score(turns: DataFrame) -> tuple[Column, Column]:
    """(score, lexical overlap) of user turns of ``before_turns`` with the frame before them.

    Overlap, from 0.25 on in proportion and from 0.45 on in full; a cue, more if it was given
    before, less if only carried on; a theme (a token of two earlier turns) in the turn and in the
    frame, or in the turn alone; a level of abstraction near the session's.
    """
    from verdigris.functions.text import long_tokens, overlap

    c = {name: F.col(name) for name in turns.columns}
    lexical = overlap(c["text"], c["frame"])
    theme = c["theme"]
    words = first_match([(lexical >= 0.45, 0.4), (lexical >= 0.25, 0.4 * (lexical - 0.25) / 0.2)], 0.0)
    framing = first_match([((F.size("cues") > 0) & F.arrays_overlap("cues", "had"), 0.40), (F.size("cues") > 0, 0.25), ((F.size("had") > 0) & (c["n"] >= 3), 0.10)], 0.0)
    topic = first_match([(F.arrays_overlap(theme, long_tokens(c["frame"], 5)), 0.2), (F.size(theme) > 0, 0.1)], 0.0)
    level = F.when(F.abs(c["label"] - c["baseline"]) <= 1, 0.1).otherwise(0.0)
    return words + framing + topic + level, lexical
