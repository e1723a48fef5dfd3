"""Queries of the decision tables over conversations, documents and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdigris import vocab
from verdigris.functions import scoring as S
from verdigris.plans.base import registrar, table
from verdigris.plans.texts import _has, pairs, _PAIRS

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

_HIGH, _LOW, _RECENT = _has(vocab.PROBE_VOLATILE), _has(vocab.PROBE_STABLE), _has(vocab.PROBE_RECENT)
_TVS = f"CASE WHEN {_LOW} AND NOT {_HIGH} THEN 0.10 WHEN {_LOW} AND {_HIGH} THEN 0.25 WHEN {_HIGH} THEN 0.85 ELSE 0.45 END"
_MATCHES = "len(regexp_extract_all(lower(text), '(and|this|that) '))"
_REC = f"CASE WHEN turn = 0 OR {_MATCHES} = 0 THEN 0.0 ELSE least(0.30, {_MATCHES} * 0.10) END"
_DOMAIN = f"CASE WHEN {_has(('was',))} THEN 'history' WHEN {_has(('with',))} THEN 'finance' WHEN {_has(('for',))} THEN 'law' ELSE 'general' END"
_ADJ = f"CASE {_DOMAIN} WHEN 'history' THEN 0.20 WHEN 'finance' THEN -0.15 WHEN 'law' THEN -0.10 ELSE 0.0 END"
_FAILS = "fails AS (SELECT conv_id, count(*) AS failures FROM conversations WHERE role = 'system' GROUP BY 1)"
_SCORED = f"""{_FAILS}, s AS (SELECT c.conv_id, turn, role, text, CAST({_TVS} AS DOUBLE) AS tvs, CAST({_REC} AS DOUBLE) AS recency, CAST(least(0.20, coalesce(failures, 0) * 0.05) AS DOUBLE) AS history, {_DOMAIN} AS domain, CAST({_ADJ} AS DOUBLE) AS adjustment FROM conversations c LEFT JOIN fails USING (conv_id)),
r AS (SELECT *, CAST(greatest(0.0, least(1.0, CAST(0.63 AS DOUBLE) + adjustment - recency - history)) AS DOUBLE) AS mkr FROM s)"""


def scored(spark, sf_dir):
    """Conversation turns with volatility, penalties, domain and effective reliability."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("text")
    fails = c.filter("role = 'system'").groupBy("conv_id").agg(F.count("*").alias("failures"))
    domain = S.first_match([(vocab.has(t, ("was",)), "history"), (vocab.has(t, ("with",)), "finance"), (vocab.has(t, ("for",)), "law")], "general")
    s = c.join(fails, "conv_id", "left").select(
        "conv_id", "turn", "role", "text", S.volatility(vocab.has(t, vocab.PROBE_VOLATILE), vocab.has(t, vocab.PROBE_STABLE)).alias("tvs"),
        S.recency_penalty(F.regexp_count(F.lower(t), F.lit("(and|this|that) ")), F.col("turn") == 0).alias("recency"), S.failure_penalty(F.col("failures")).alias("history"), domain.alias("domain"),
    )
    adjustment = S.first_match([(F.col("domain") == "history", 0.20), (F.col("domain") == "finance", -0.15), (F.col("domain") == "law", -0.10)], 0.0)
    return s.withColumn("adjustment", adjustment).withColumn("mkr", S.reliability(F.lit(0.63), F.col("adjustment"), F.col("recency"), F.col("history")))


@query(f"WITH {_SCORED} SELECT conv_id, turn, tvs, recency, history, domain, adjustment FROM s")
def d1_d2_d3_d4_d6_penalties(spark, sf_dir):
    return scored(spark, sf_dir).select("conv_id", "turn", "tvs", "recency", "history", "domain", "adjustment")


@query("""SELECT doc_id, CASE WHEN contains(name, 'mini') THEN 'small' WHEN contains(name, 'large') THEN 'large' WHEN b <= 7 THEN 'micro' WHEN b <= 13 THEN 'small' WHEN b <= 34 THEN 'medium' WHEN b > 34 THEN 'large' ELSE 'micro' END AS model_class
FROM (SELECT doc_id, 'net-' || CASE doc_id % 5 WHEN 0 THEN 'mini' WHEN 1 THEN 'large' ELSE CAST(doc_id % 70 AS VARCHAR) || 'b' END AS name, CASE WHEN doc_id % 5 > 1 THEN doc_id % 70 END AS b FROM documents)""")
def d5_model_class(spark, sf_dir):
    name = F.expr("concat('net-', CASE doc_id % 5 WHEN 0 THEN 'mini' WHEN 1 THEN 'large' ELSE concat(CAST(doc_id % 70 AS STRING), 'b') END)")
    return table(spark, sf_dir, "documents").select("doc_id", S.model_class(name).alias("model_class"))


@query(f"WITH {_SCORED} SELECT conv_id, turn, tvs < 0.30 AND mkr >= 0.52 AS eligible, concat_ws(',', CASE WHEN tvs >= 0.30 THEN 'TVS' END, CASE WHEN mkr < 0.52 THEN 'MKR_PRIOR' END, CASE WHEN recency > 0 THEN 'FRESH' END, CASE WHEN history > 0 THEN 'HIST' END) AS codes FROM r")
def d7_reliability(spark, sf_dir):
    r = scored(spark, sf_dir)
    return r.select("conv_id", "turn", S.eligible(F.col("tvs"), F.col("mkr")).alias("eligible"), F.array_join(S.fail_codes(F.col("tvs"), F.col("mkr"), F.col("recency"), F.col("history")), ",").alias("codes"))


_KEYWORDS = (("the", 0.25), ("of", -0.15), ("was", 0.4), ("for", 0.3), ("inwh", -0.2), ("tion", 0.1))
_KW_SQL = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}', CAST({x} AS DOUBLE))" for i, (w, x) in enumerate(_KEYWORDS)) + ") AS t(pos, word, weight))"


@query(f"""WITH {_KW_SQL}, m AS (SELECT conv_id, turn, weight, row_number() OVER (PARTITION BY conv_id, turn ORDER BY abs(weight) DESC, pos) AS r FROM conversations JOIN k ON contains(lower(text), word)),
s AS (SELECT conv_id, turn, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(weight ORDER BY r)), lambda a, x: a + x) AS s FROM m WHERE r <= 3 GROUP BY ALL)
SELECT c.conv_id, c.turn, greatest(CAST(0.05 AS DOUBLE), least(CAST(0.95 AS DOUBLE), CAST(0.25 AS DOUBLE) + greatest(CAST(-0.20 AS DOUBLE), least(CAST(0.45 AS DOUBLE), coalesce(s, 0) * CAST(0.4 AS DOUBLE))))) AS tvs FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn""")
def d8_keyword_volatility(spark, sf_dir):
    words = spark.createDataFrame([(i, w, x) for i, (w, x) in enumerate(_KEYWORDS)], "pos int, word string, weight double")
    c = table(spark, sf_dir, "conversations")
    hits = c.join(F.broadcast(words), F.contains(F.lower("text"), "word"))
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc(F.abs("weight")), "pos"))).filter("r <= 3")
    total = ranked.groupBy("conv_id", "turn").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("r", "weight"))), F.lit(0.0), lambda a, x: a + x["weight"]).alias("s"))
    tvs = S.clip(0.25 + S.clip(F.coalesce("s", F.lit(0.0)) * 0.4, -0.20, 0.45), 0.05, 0.95)
    return c.join(total, ["conv_id", "turn"], "left").select("conv_id", "turn", tvs.alias("tvs"))


@query(f"""WITH {_SCORED}, g AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN CAST(0.1 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), recency + (tvs - CAST(0.6 AS DOUBLE)) / 2 + CAST(0.1 AS DOUBLE))) END AS gain, CAST(0.4 AS DOUBLE) + least(CAST(0.2 AS DOUBLE), turn * CAST(0.05 AS DOUBLE)) AS damping FROM s) SELECT *, gain > 0.5 AS dangerous FROM g""")
def d13_convergence(spark, sf_dir):
    gain, damping, dangerous = S.convergence_gain(F.col("turn") == 0, F.col("recency"), F.col("tvs"), F.lit(0.1), F.col("turn"))
    return scored(spark, sf_dir).select("conv_id", "turn", gain.alias("gain"), damping.alias("damping"), dangerous.alias("dangerous"))


@query("""WITH l AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS lp FROM embeddings), w AS (SELECT vec_id, list_transform(lp, lambda x: exp(x - list_max(lp))) AS w FROM l), t AS (SELECT vec_id, w, w[1] + w[2] + w[3] + w[4] AS s FROM w)
SELECT vec_id, round(greatest(0.0, least(1.0, -(w[1]/s*ln(w[1]/s) + w[2]/s*ln(w[2]/s) + w[3]/s*ln(w[3]/s) + w[4]/s*ln(w[4]/s)) / ln(4.0))), 9) AS entropy FROM t""")
def d16_position_entropy(spark, sf_dir):
    lp = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", lp.alias("lp")).select("vec_id", F.round(S.entropy(F.col("lp")), 9).alias("entropy"))


_LAST3 = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"


@query(f"""WITH t AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, bool_or({_has(('was',))}) {_LAST3} AS near FROM conversations),
a AS (SELECT conv_id, turn, length(text) < 40 OR NOT {_LOW} AS under, coalesce(length(prev) > 10, FALSE) AS resolved, coalesce(near, FALSE) AND length(text) < 60 AS self_reference FROM t)
SELECT conv_id, turn, resolved, self_reference, CAST(CASE WHEN under AND NOT resolved THEN 0.35 ELSE 0.80 END AS DOUBLE) AS completeness, CAST(CASE WHEN under AND NOT resolved THEN 0.40 ELSE 0.85 END AS DOUBLE) AS clarity FROM a""")
def d19_d20_d21_appraisal(spark, sf_dir):
    t, w = F.col("text"), Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"prev": F.lag("text").over(w), "near": F.bool_or(vocab.has(t, ("was",))).over(w.rowsBetween(-3, -1))})
    resolved = F.coalesce(F.length("prev") > 10, F.lit(False))
    under = ((F.length(t) < 40) | ~vocab.has(t, vocab.PROBE_STABLE)) & ~resolved
    completeness, clarity, _ = S.appraisal(under)
    return c.select("conv_id", "turn", resolved.alias("resolved"), (F.coalesce("near", F.lit(False)) & (F.length(t) < 60)).alias("self_reference"), completeness.alias("completeness"), clarity.alias("clarity"))


_ROUTE = f"""CASE WHEN safety THEN 'abstain' WHEN correction THEN 'verify' WHEN selfref THEN 'answer' WHEN under THEN 'ask' WHEN stable AND ok THEN 'answer' WHEN stable THEN 'verify' WHEN fresh THEN 'verify' WHEN def AND ok THEN 'answer' WHEN def AND tvs >= 0.3 THEN 'verify' ELSE 'answer' END"""
_REASON = f"""CASE WHEN safety THEN 'SAFETY' WHEN correction THEN 'USER_CORRECTION' WHEN selfref THEN 'SELF_REFERENTIAL' WHEN under THEN 'MISSING_CONSTRAINTS' WHEN stable AND ok THEN 'LOW_STAKES_STABLE' WHEN stable THEN 'STABLE_BLOCKED' WHEN fresh THEN 'FRESHNESS_SENSITIVE' WHEN def AND ok THEN 'DEFINITIONAL_PASS' WHEN def AND tvs >= 0.3 THEN 'DEFINITIONAL_NEEDS_EVIDENCE' WHEN def THEN 'DEFINITIONAL' ELSE 'DEFAULT' END"""
_ROUTED = f"""{_SCORED}, f AS (SELECT *, {_has(('not',))} AS safety, {_has(('or',))} AS correction, {_has(('by',))} AS selfref, length(text) < 60 AS under, {_has(('in',))} AS stable, tvs < 0.30 AND mkr >= 0.52 AS ok, {_HIGH} AS fresh, {_LOW} AS def FROM r),
routed AS (SELECT conv_id, turn, role, text, tvs, mkr, domain, {_ROUTE} AS route, {_REASON} AS reason FROM f)"""


def routed(spark, sf_dir):
    """Scored turns with their route and reason."""
    r, t = scored(spark, sf_dir), F.col("text")
    under = F.length(t) < 60
    completeness, clarity, uncertainty = S.appraisal(under)
    route, reason = S.route(vocab.has(t, ("not",)), vocab.has(t, ("or",)), vocab.has(t, ("by",)), completeness, clarity, vocab.has(t, ("in",)), S.eligible(F.col("tvs"), F.col("mkr")), vocab.has(t, vocab.PROBE_VOLATILE), F.when(under, uncertainty).otherwise(0.3), vocab.has(t, vocab.PROBE_STABLE), F.col("tvs") >= 0.3)
    return r.select("conv_id", "turn", "role", "text", "tvs", "mkr", "domain", route.alias("route"), reason.alias("reason"))


@query(f"WITH {_ROUTED} SELECT conv_id, turn, CASE WHEN route = 'ask' AND length(text) <= 20 THEN 'answer' ELSE route END AS route, reason || CASE WHEN turn > 0 THEN ',CONTINUITY' ELSE '' END AS reasons FROM routed")
def d22_d23_route(spark, sf_dir):
    r = routed(spark, sf_dir)
    return r.select("conv_id", "turn", F.when((F.col("route") == "ask") & (F.length("text") <= 20), "answer").otherwise(F.col("route")).alias("route"), F.concat("reason", F.when(F.col("turn") > 0, ",CONTINUITY").otherwise("")).alias("reasons"))


@query(f"WITH {_ROUTED} SELECT conv_id, turn, CASE WHEN route <> 'verify' THEN 'none' WHEN tvs >= 0.7 THEN 'web' WHEN tvs >= 0.3 THEN 'static' ELSE 'local' END AS plan, CASE WHEN {_has(('by',))} THEN 'self' WHEN length(text) <= 20 THEN 'greeting' WHEN mkr >= 0.72 THEN 'neighbour' WHEN {_has(('for',))} THEN 'creative' ELSE 'factual' END AS intent FROM routed")
def d24_d25_plan_and_intent(spark, sf_dir):
    t = F.col("text")
    plan = S.first_match([(F.col("route") != "verify", "none"), (F.col("tvs") >= 0.7, "web"), (F.col("tvs") >= 0.3, "static")], "local")
    intent = S.first_match([(vocab.has(t, ("by",)), "self"), (F.length(t) <= 20, "greeting"), (F.col("mkr") >= 0.72, "neighbour"), (vocab.has(t, ("for",)), "creative")], "factual")
    return routed(spark, sf_dir).select("conv_id", "turn", plan.alias("plan"), intent.alias("intent"))


@query(f"WITH {_SCORED} SELECT conv_id, turn, CASE WHEN mkr < 0.40 THEN 'low' WHEN mkr >= 0.70 THEN 'high' ELSE 'medium' END AS intent_bucket, CASE WHEN tvs < 0.30 THEN 'low' WHEN tvs >= 0.70 THEN 'high' ELSE 'medium' END AS risk_bucket FROM r")
def d27_quality_buckets(spark, sf_dir):
    return scored(spark, sf_dir).select("conv_id", "turn", S.quality_bucket(F.col("mkr"), 0.40, 0.70).alias("intent_bucket"), S.quality_bucket(F.col("tvs"), 0.30, 0.70).alias("risk_bucket"))


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS age, CAST(('0x' || substr(sha256('audit:' || CAST(conv_id * 1000 + turn AS VARCHAR)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS draw FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN age <= 3 THEN 0.30 WHEN age <= 20 THEN 0.10 ELSE 0.05 END AS DOUBLE) AS rate, draw < CASE WHEN age <= 3 THEN 0.30 WHEN age <= 20 THEN 0.10 ELSE 0.05 END AS recorded FROM t""")
def d28_d29_audit_sampling(spark, sf_dir):
    age = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rate = S.sampling_rate(F.col("age"))
    return table(spark, sf_dir, "conversations").withColumn("age", age).select("conv_id", "turn", rate.alias("rate"), (S.hash_draw("audit", F.col("conv_id") * 1000 + F.col("turn")) < rate).alias("recorded"))


_KIND = f"CASE WHEN {_has(('was',))} THEN 'preference' WHEN {_has(('with',))} THEN 'correction' WHEN {_has(('for',))} THEN 'task' ELSE 'topic' END"


@query(f"""WITH {_SCORED}, k AS (SELECT conv_id, turn, {_KIND} AS kind, tvs, length(text) AS n FROM r), z AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(0.40 AS DOUBLE) + CASE WHEN kind = 'correction' THEN 0.20 ELSE 0 END::DOUBLE + CASE WHEN kind = 'preference' THEN 0.15 ELSE 0 END::DOUBLE + least(CAST(0.10 AS DOUBLE), turn * CAST(0.02 AS DOUBLE)) - CASE WHEN tvs > 0.7 THEN 0.15 ELSE 0 END::DOUBLE)) AS salience FROM k)
SELECT conv_id, turn, kind, salience, salience >= 0.45 AS kept, CASE WHEN kind = 'preference' THEN NULL WHEN tvs > 0.7 THEN 3 ELSE 7 END AS ttl_days, kind || ' (' || CAST(n AS VARCHAR) || ')' AS summary FROM z""")
def d31_d32_d33_d34_capsules(spark, sf_dir):
    t = F.col("text")
    kind = S.first_match([(vocab.has(t, ("was",)), "preference"), (vocab.has(t, ("with",)), "correction"), (vocab.has(t, ("for",)), "task")], "topic")
    r = scored(spark, sf_dir).withColumn("kind", kind)
    salience = S.salience(F.col("kind"), F.col("turn"), F.col("kind") == "correction", F.col("tvs"))
    return r.select("conv_id", "turn", "kind", salience.alias("salience"), (salience >= 0.45).alias("kept"), S.time_to_live(F.col("kind"), F.col("tvs")).alias("ttl_days"), F.format_string("%s (%d)", "kind", F.length(t)).alias("summary"))


@query(f"""WITH {_SCORED}, h AS (SELECT conv_id, turn, CAST(0.40 AS DOUBLE) * mkr + CAST(0.35 AS DOUBLE) * tvs + CAST(0.25 AS DOUBLE) * (1 - recency) AS s FROM r) SELECT conv_id, turn, s AS strength, CASE WHEN s < 0.35 THEN 'hold' WHEN s < 0.65 THEN 'hint' WHEN s < 0.82 THEN 'offer' ELSE 'lead' END AS policy FROM h""")
def d35_half_step(spark, sf_dir):
    strength, policy = S.half_step(F.col("mkr"), F.col("tvs"), F.col("recency"))
    return scored(spark, sf_dir).select("conv_id", "turn", strength.alias("strength"), policy.alias("policy"))


@query("""WITH d AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS dup, least(CAST(1 AS DOUBLE), (doc_id % 100) / CAST(100 AS DOUBLE) + CASE WHEN source = 'src2' THEN 0.10 ELSE 0 END::DOUBLE) AS quality FROM documents)
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 's_rejected' WHEN source = 'src3' THEN 'provenance' WHEN source = 'src4' THEN 'denylist' WHEN doc_id % 13 = 0 THEN 'term' WHEN n_chars = 0 THEN 'content' WHEN n_chars < 120 THEN 'too_short' WHEN n_chars > 8000 THEN 'too_long' WHEN dup THEN 'duplicate' WHEN quality < 0.55 THEN 'quality' WHEN doc_id % 5 < 2 THEN 'deferred' ELSE 'promoted' END AS outcome FROM d""")
def d37_promotion(spark, sf_dir):
    w = Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")
    d = table(spark, sf_dir, "documents").withColumn("dup", F.row_number().over(w) > 1)
    quality = F.least(F.lit(1.0), F.col("doc_id") % 100 / 100.0 + F.when(F.col("source") == "src2", 0.10).otherwise(0.0))
    return d.select("doc_id", S.promotion(F.col("doc_id") % 17 == 0, F.col("source") != "src3", F.col("source") == "src4", F.col("doc_id") % 13 != 0, F.col("n_chars"), F.col("dup"), quality, F.col("doc_id") % 5).alias("outcome"))


_FAMILY = f"CASE WHEN {_has(('was',), 'prompt')} THEN 'volatile_current' WHEN {_has(('with',), 'prompt')} THEN 'date_boundary' WHEN {_has(('for',), 'prompt')} THEN 'stale_premise_trap' WHEN {_has(('is',), 'prompt')} THEN 'stable_control' ELSE 'query_neutrality' END"
_SIG = f"{_has(('not',), 'answer')} AS refusal, {_has(('not',), 'substr(answer, 1, 100)')} AND length(answer) <= 400 AS refusal_dominant, turn % 5 = 1 AS tool_done, turn % 7 = 3 AS tool_hint, {_has(('from',), 'answer')} AS pushback, {_has(('from',), 'substr(answer, 1, 60)')} AS pushback_lead, {_has(('by',), 'answer')} AS date_bound, {_has(('at',), 'answer')} AS denial, {_has(('this',), 'answer')} AS current, {_has(('or',), 'answer')} AS abstain, {_has(('that',), 'answer')} AS intent, {_has(('be',), 'answer')} AS clarify"
_CLASSIFIED = f"""{_PAIRS}, sg AS (SELECT conv_id, turn, prompt, answer, {_FAMILY} AS family, {_SIG} FROM p),
cl AS (SELECT *, family IN ('volatile_current', 'date_boundary', 'stale_premise_trap', 'ambiguous_time_frame', 'query_neutrality') AND (date_bound OR denial) AS hedge, family IN ('query_neutrality', 'stable_control') AND NOT refusal_dominant AS soft FROM sg),
results AS (SELECT *, CASE WHEN length(answer) = 0 THEN 'abstain' WHEN refusal AND NOT hedge AND NOT soft AND refusal_dominant THEN 'refuse' WHEN tool_done AND length(answer) > 20 THEN 'verify' WHEN tool_hint AND NOT tool_done THEN 'execute' WHEN pushback AND (family = 'stale_premise_trap' OR pushback_lead) THEN 're_anchor' WHEN (date_bound OR denial) AND NOT current AND family <> 'stable_control' THEN 'date_bound_answer' WHEN abstain THEN 'abstain' WHEN intent AND NOT tool_done THEN 'verify' WHEN clarify AND length(answer) < 600 THEN 'ask' ELSE 'answer' END AS classified, turn % 11 = 5 AS errored,
CASE family WHEN 'volatile_current' THEN ['verify', 'date_bound_answer'] WHEN 'date_boundary' THEN ['date_bound_answer'] WHEN 'stale_premise_trap' THEN ['re_anchor', 'ask'] WHEN 'stable_control' THEN ['answer'] ELSE ['answer', 'ask'] END AS allowed FROM cl)"""


def results(spark, sf_dir):
    """Scorable records: (prompt, reply) pairs with family, signals, classified route and labels."""
    a, p = F.col("answer"), F.col("prompt")
    family = S.first_match([(vocab.has(p, ("was",)), "volatile_current"), (vocab.has(p, ("with",)), "date_boundary"), (vocab.has(p, ("for",)), "stale_premise_trap"), (vocab.has(p, ("is",)), "stable_control")], "query_neutrality")
    s = {
        "refusal": vocab.has(a, ("not",)), "refusal_dominant": vocab.has(F.substring(a, 1, 100), ("not",)) & (F.length(a) <= 400), "tool_done": F.col("turn") % 5 == 1, "tool_hint": F.col("turn") % 7 == 3, "pushback": vocab.has(a, ("from",)), "pushback_lead": vocab.has(F.substring(a, 1, 60), ("from",)),
        "date_bound": vocab.has(a, ("by",)), "denial": vocab.has(a, ("at",)), "current": vocab.has(a, ("this",)), "abstain": vocab.has(a, ("or",)), "intent": vocab.has(a, ("that",)), "clarify": vocab.has(a, ("be",)),
    }
    base = pairs(spark, sf_dir).withColumns({"family": family, **s})
    route, confidence = S.classified_route(a, {k: F.col(k) for k in s}, F.col("family"))
    lists = {"volatile_current": ("verify", "date_bound_answer"), "date_boundary": ("date_bound_answer",), "stale_premise_trap": ("re_anchor", "ask"), "stable_control": ("answer",)}
    allowed = S.first_match([(F.col("family") == f, vocab.array(x)) for f, x in lists.items()], vocab.array(("answer", "ask")))
    return base.withColumns({"classified": route, "confidence": confidence, "allowed": allowed, "errored": F.col("turn") % 11 == 5})


@query(f"WITH {_CLASSIFIED} SELECT conv_id, turn, family, classified FROM results")
def d38_d42_family_and_route(spark, sf_dir):
    return results(spark, sf_dir).select("conv_id", "turn", "family", "classified")


@query(f"""WITH {_CLASSIFIED} SELECT conv_id, turn, CASE WHEN family = 'stable_control' THEN prompt ELSE '[' || family || '] ' || prompt END AS prompt, CASE WHEN refusal_dominant AND family <> 'stable_control' THEN 'Hedged: ' || answer WHEN family = 'volatile_current' AND NOT date_bound THEN '[As of unknown] ' || answer WHEN family = 'stale_premise_trap' AND NOT pushback THEN 'Premise check: ' || answer ELSE answer END AS reply FROM results""")
def d39_d40_d41_transform_and_validate(spark, sf_dir):
    r = results(spark, sf_dir)
    f, a = F.col("family"), F.col("answer")
    reply = S.first_match([(F.col("refusal_dominant") & (f != "stable_control"), F.concat(F.lit("Hedged: "), a)), ((f == "volatile_current") & ~F.col("date_bound"), F.concat(F.lit("[As of unknown] "), a)), ((f == "stale_premise_trap") & ~F.col("pushback"), F.concat(F.lit("Premise check: "), a))], a)
    return r.select("conv_id", "turn", F.when(f == "stable_control", F.col("prompt")).otherwise(F.concat(F.lit("["), f, F.lit("] "), "prompt")).alias("prompt"), reply.alias("reply"))


_RISKY = "(family IN ('volatile_current', 'date_boundary', 'ambiguous_time_frame') AND current AND NOT date_bound AND NOT tool_done)"
_MODES = f"""CASE WHEN length(answer) = 0 THEN 'no_response' ELSE concat_ws(',', CASE WHEN {_RISKY} THEN 'unsupported_current_claim,stale_commitment' END, CASE WHEN family = 'date_boundary' AND classified = 'answer' AND NOT date_bound THEN 'missing_date_boundary' END, CASE WHEN family = 'stable_control' AND classified IN ('verify', 'ask') AND NOT list_contains(allowed, 'verify') AND NOT list_contains(allowed, 'ask') THEN 'over_verification_on_stable' END, CASE WHEN family = 'stable_control' AND classified = 'ask' THEN 'false_clarifying_question_on_stable' END, CASE WHEN family = 'stale_premise_trap' AND NOT pushback AND classified NOT IN ('re_anchor', 'ask') THEN 'stale_premise_accepted' END, CASE WHEN intent AND NOT tool_done THEN 'verification_started_not_completed' END) END"""


def modes():
    c = F.col
    return S.failure_modes(c("family"), c("classified"), F.length("answer") == 0, c("current"), c("date_bound"), c("tool_done"), c("intent"), c("pushback"), c("allowed"))


@query(f"WITH {_CLASSIFIED} SELECT conv_id, turn, {_MODES} AS modes FROM results")
def d43_failure_modes(spark, sf_dir):
    return results(spark, sf_dir).select("conv_id", "turn", F.array_join(modes(), ",").alias("modes"))


@query(f"""WITH {_CLASSIFIED}, d AS (SELECT conv_id, turn, CASE WHEN allowed[1] = classified THEN 'match' WHEN classified = 'answer' THEN 'A' WHEN allowed[1] = 'answer' THEN 'B' WHEN allowed[1] IN ('verify', 'ask') AND classified IN ('verify', 'ask') THEN 'C' ELSE 'other' END AS divergence FROM results)
SELECT *, CASE WHEN divergence = 'A' AND turn % 2 = 1 THEN 'A-hard' WHEN divergence = 'A' THEN 'context' WHEN divergence = 'other' THEN 'route' ELSE 'none' END AS bucket FROM d""")
def d44_n10_divergence(spark, sf_dir):
    d = results(spark, sf_dir).select("conv_id", "turn", S.divergence(F.get("allowed", 0), F.col("classified")).alias("divergence"))
    bucket = S.first_match([((F.col("divergence") == "A") & (F.col("turn") % 2 == 1), "A-hard"), (F.col("divergence") == "A", "context"), (F.col("divergence") == "other", "route")], "none")
    return d.withColumn("bucket", bucket)
