"""Rule books on single texts: every trigger alone, the order of families, templates and conflicts."""

from pyspark.sql import functions as F

from verdigris.functions import rulebook as B

WORDS = {
    "definition": ("define",), "reasoning": ("why",), "confirmatory": ("right",), "pronoun": ("it",), "vague_verb": ("improve",), "vague_best": ("best",), "dependent_subject": ("setup",), "bare_action": ("run",),
    "freshness": ("latest",), "referent": ("python",), "needs_context": ("continue",),
}


def one(spark, rows, schema, columns):
    return [tuple(r) for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + schema).select("k", *columns).orderBy("k").drop("k").collect()]


def test_triggers(spark):
    cases = [
        ("tell me something", False, ["few_words"]), ("define the thing", False, []), ("tell me more", True, []), ("東京の天気", False, []), ("how does it work here?", False, ["pronoun"]), ("why does it work here?", False, []),
        ("please improve all of these", False, ["vague_verb"]), ("which is best of these", False, ["vague_best"]), ("does my setup look good", False, ["dependent_subject"]), ("please run all of these", False, ["bare_action"]),
        ("what is the latest there", False, ["bare_freshness"]), ("what is the latest python there", False, []), ("what is the latest one of all of these there", False, []), ("please do continue with that", False, ["needs_context"]),
        ("please do continue with that", True, []), ("", False, ["few_words"]), (None, False, ["few_words"]), ("word " * 50_000, False, []),
    ]
    t = F.col("text")
    fires = B.under_specification(t, F.coalesce(t.endswith("?"), F.lit(False)), F.col("continues"), WORDS)
    got = one(spark, [c[:2] for c in cases], "text string, continues boolean", [c.alias(n) for n, c in fires.items()])
    assert [[n for n, x in zip(B.TRIGGERS, r, strict=True) if x] for r in got] == [c[2] for c in cases]
    assert tuple(fires) == B.TRIGGERS and all(x is not None for r in got for x in r)


def test_ladder(spark):
    rows = [(False, False, False, False, False), (True, False, False, False, False), (True, True, False, False, False), (False, False, True, False, False), (True, False, True, True, False), (True, False, True, True, True)]
    got = one(spark, rows, "u boolean, me boolean, f boolean, r boolean, s boolean", [c.alias(n) for n, c in B.appraised(*map(F.col, ("u", "me", "f", "r", "s"))).items()])
    assert got == [(0.8, 0.85, 0.25), (0.35, 0.4, 0.55), (0.8, 0.85, 0.55), (0.8, 0.85, 0.55), (0.35, 0.4, 0.8), (0.35, 0.4, 0.1)]


def test_families(spark):
    words = {"closed": ("plus",), "ambiguous": ("still",), "premise": ("since",), "current": ("now",), "volatile": ("price",), "entity": ("acme",), "boundary": ("about",), "inquiry": ("is", "what")}
    cases = {
        "two plus two now price": "stable_control", "is acme still so": "ambiguous_time_frame", "since acme left": "stale_premise_trap", "what since acme left": "query_neutrality", "since long ago": "query_neutrality",
        "price now about": "date_boundary", "price now": "volatile_current", "price": "query_neutrality", "": "query_neutrality", None: "query_neutrality",
    }
    got = one(spark, [(x,) for x in cases], "p string", [B.prompt_family(F.col("p"), words)])
    assert [r[0] for r in got] == list(cases.values())


def test_capsules(spark):
    rows = [("goal", "session-long", 2, "answer", "", "x", "r" * 500), ("open_loop", "s", 0, "ask", "WHY", "", None), ("none", "s", 0, "ask", "WHY", "", "r"), (None, "s", 0, "ask", "WHY", "", "r")]
    text = B.capsule_text(*map(F.col, ("kind", "s", "t", "route", "reason", "added", "reply")))
    got = [r[0] for r in one(spark, rows, "kind string, s string, t int, route string, reason string, added string, reply string", [text])]
    assert got == ["[Goal] Session session- turn 2: Long-term intent detected (x). Route: answer. Reason: unspecified. " + "r" * 120, "[OpenLoop] Session s turn 0: Unresolved question — clarification needed before proceeding. Route: ask (ask). Reason: WHY.", "", ""]


def test_conflicts(spark):
    """Each later criterion decides only between equals in those before it."""
    order = [(2, 0.1, False, "z1"), (1, 0.9, False, "b1"), (1, 0.8, True, "b1"), (1, 0.8, False, "a2"), (1, 0.8, False, "a1"), (1, 0.8, False, "b9")]
    for k in range(len(order)):
        df = spark.createDataFrame(order[k:][::-1], "priority int, score double, fits boolean, name string")
        best = df.agg(F.max(B.conflict_rank(*map(F.col, df.columns))).alias("b")).first().b
        assert (best.priority, best.score, bool(best.fits), best.name) == order[k]


def test_structure(spark):
    words = {"verify": ("check",), "freshness": ("today",)}
    got = one(spark, [(" Check this today? ",), ("Why? So.",), ("",), (None,)], "t string", [c.alias(n) for n, c in B.structure(F.col("t"), words).items()])
    assert got == [(17, True, True, True, True, False), (8, False, True, False, False, False), (0, False, False, False, False, True), (0, False, False, False, False, True)]
