"""Queries of decision tables in full: domains, audit modes and buckets, guards in sequence, contingency."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris import vocab
from verdigris.functions import guards as G
from verdigris.functions import scoring as S
from verdigris.operators import statistics as St
from verdigris.plans.base import registrar, table
from verdigris.plans.evals import _R, _wilson, records
from verdigris.plans.scores import _CLASSIFIED, _HIGH, _ROUTED, results, routed
from verdigris.plans.texts import _has

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

# The domains in the order of their rules, with their adjustments; the words stand for the rules' patterns.
_DOMAINS = (("physical_science", "was", 0.20), ("geography", "with", 0.15), ("historical_institutional", "for", 0.12), ("stable_institutional", "this", 0.10), ("political_officeholder", "that", -0.10), ("economic_indicator", "not", -0.15))
_COUNTABLE = "(^|[^a-z])in[^a-z](.*[^a-z])?and([^a-z]|$)"
_DOMAIN6 = "CASE " + " ".join(f"WHEN {_has((w,))} THEN '{d}'" for d, w, _ in _DOMAINS) + " ELSE 'general' END"
_ADJ6 = "CASE domain " + " ".join(f"WHEN '{d}' THEN CAST({x} AS DOUBLE)" for d, _, x in _DOMAINS) + " ELSE CAST(0 AS DOUBLE) END"


@query(f"WITH d AS (SELECT conv_id, turn, text, {_DOMAIN6} AS domain FROM conversations) SELECT conv_id, turn, domain, {_ADJ6} - CASE WHEN regexp_matches(lower(text), '(?s){_COUNTABLE}') THEN CAST(0.10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS adjustment FROM d")
def d4_d6_domain_adjustment(spark, sf_dir):
    t = F.col("text")
    domain = S.first_match([(vocab.has(t, (w,)), d) for d, w, _ in _DOMAINS], "general")
    base = S.first_match([(F.col("domain") == d, x) for d, _, x in _DOMAINS], 0.0)
    less = F.when(F.lower(t).rlike(f"(?s){_COUNTABLE}"), 0.10).otherwise(0.0)
    return table(spark, sf_dir, "conversations").withColumn("domain", domain).select("conv_id", "turn", "domain", (base - less).alias("adjustment"))


@query(f"WITH {_ROUTED} SELECT conv_id, turn, CASE WHEN mkr < 0.40 THEN 'low' WHEN mkr >= 0.70 THEN 'high' ELSE 'ok' END AS intent, CASE WHEN {_HIGH} THEN 'high' WHEN tvs >= 0.70 THEN 'low' WHEN tvs < 0.30 THEN 'high' ELSE 'ok' END AS risk, CASE WHEN {_has(('not',))} THEN 'high' ELSE 'low' END AS meta_frame FROM routed")
def d27_audit_buckets(spark, sf_dir):
    """Clarity and uncertainty as buckets; risk runs against uncertainty, what is fresh overrides it."""
    t, mkr, tvs = F.col("text"), F.col("mkr"), F.col("tvs")
    intent = S.first_match([(mkr < 0.40, "low"), (mkr >= 0.70, "high")], "ok")
    risk = S.first_match([(vocab.has(t, vocab.PROBE_VOLATILE), "high"), (tvs >= 0.70, "low"), (tvs < 0.30, "high")], "ok")
    return routed(spark, sf_dir).select("conv_id", "turn", intent.alias("intent"), risk.alias("risk"), F.when(vocab.has(t, ("not",)), "high").otherwise("low").alias("meta_frame"))


_MODE = "CASE domain WHEN 'history' THEN 'full' WHEN 'finance' THEN 'off' WHEN 'law' THEN 'incident_only' ELSE 'shadow' END"
_DRAW = "CAST(('0x' || substr(sha256('audit:' || CAST(conv_id * 1000 + turn AS VARCHAR)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE)"


@query(f"""WITH {_ROUTED}, a AS (SELECT conv_id, turn, route, tvs, {_MODE} AS mode, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS age, {_DRAW} AS draw FROM routed),
b AS (SELECT *, route IN ('abstain', 'verify') OR tvs > 0.8 AS boost FROM a)
SELECT conv_id, turn, mode, boost, CASE mode WHEN 'full' THEN TRUE WHEN 'shadow' THEN boost OR draw < CASE WHEN age <= 3 THEN 0.30 WHEN age <= 20 THEN 0.10 ELSE 0.05 END ELSE FALSE END AS recorded FROM b""")
def d28_audit_modes(spark, sf_dir):
    """Whether a full record is made: by mode, else by risk, else by a draw that follows from the turn."""
    from pyspark.sql import Window

    mode = S.first_match([(F.col("domain") == "history", "full"), (F.col("domain") == "finance", "off"), (F.col("domain") == "law", "incident_only")], "shadow")
    r = routed(spark, sf_dir).withColumns({"mode": mode, "age": F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")), "boost": F.col("route").isin("abstain", "verify") | (F.col("tvs") > 0.8)})
    drawn = S.hash_draw("audit", F.col("conv_id") * 1000 + F.col("turn")) < S.sampling_rate(F.col("age"))
    return r.select("conv_id", "turn", "mode", "boost", S.first_match([(F.col("mode") == "full", True), (F.col("mode") == "shadow", F.col("boost") | drawn)], False).alias("recorded"))


_STABLE = ("stable_control", "query_neutrality")


def _starts(prefix: str) -> str:
    return f"starts_with(t, '{prefix}')"


def _step(before: str, name: str, when: str, then: str) -> str:
    return f"SELECT * EXCLUDE (t, fired, hit), CASE WHEN hit THEN {then} ELSE t END AS t, CASE WHEN hit THEN list_append(fired, '{name}') ELSE fired END AS fired FROM (SELECT *, coalesce({when}, FALSE) AS hit FROM ({before}))"


def _sequence_sql() -> str:
    rest = "CASE WHEN regexp_extract(t, '(?s)^[^.!?]*[.!?]+\\s+(.+)$', 1) <> '' THEN regexp_extract(t, '(?s)^[^.!?]*[.!?]+\\s+(.+)$', 1) ELSE t END"
    stable = "family IN ('stable_control', 'query_neutrality')"
    at = "SELECT conv_id, turn, family, safety, answer AS t, CAST([] AS VARCHAR[]) AS fired FROM r"
    at = _step(at, "refusal", f"{_has(('not',), 'substr(t, 1, 200)')} AND NOT safety AND family <> 'stable_control'", "'Hedged: ' || t")
    at = _step(at, "premise", f"family = 'stale_premise_trap' AND NOT {_has(('from',), 'substr(t, 1, 300)')}", "'Premise check: ' || t")
    at = _step(at, "current", f"{_has(('this',), 'substr(t, 1, 400)')} AND NOT {_has(('hedged', 'premise'), 'substr(t, 1, 400)')} AND length(t) >= 20", "'[As of unknown] ' || t")
    at = _step(at, "caveat", f"{stable} AND {_has(('or', 'hedged'), 'substr(t, 1, 60)')}", rest)
    at = _step(at, "ask", f"{_has(('be',), 'substr(t, 1, 80)')} AND length(t) < 120 AND family <> 'stable_control'", "'Which one is meant?'")
    at = _step(at, "stable_flag", "family = 'stable_control' AND starts_with(t, '[As of')", "t")
    return f"WITH {_CLASSIFIED}, r AS (SELECT conv_id, turn, family, answer, abstain AS safety FROM results) SELECT conv_id, turn, substr(sha256(t), 1, 12) AS digest, length(t) AS n, array_to_string(fired, ',') AS fired FROM ({at})"


@query(_sequence_sql())
def d40_d41_rules_in_sequence(spark, sf_dir):
    """Guards and validator as a chain: a prefix that one rule adds is seen by the next."""
    f = F.col("family")
    has = lambda t, n, words: vocab.has(G.head(t, n), words)
    rules: list[G.Rule] = [
        ("refusal", lambda t: has(t, 200, ("not",)) & ~F.col("abstain") & (f != "stable_control"), G.prefixed("Hedged: ")),
        ("premise", lambda t: (f == "stale_premise_trap") & ~has(t, 300, ("from",)), G.prefixed("Premise check: ")),
        ("current", lambda t: has(t, 400, ("this",)) & ~has(t, 400, ("hedged", "premise")) & (F.length(t) >= 20), G.prefixed("[As of unknown] ")),
        ("caveat", lambda t: f.isin(*_STABLE) & has(t, 60, ("or", "hedged")), G.without_first_sentence),
        ("ask", lambda t: has(t, 80, ("be",)) & (F.length(t) < 120) & (f != "stable_control"), lambda t: F.lit("Which one is meant?")),
        ("stable_flag", lambda t: (f == "stable_control") & t.startswith("[As of"), G.kept),
    ]
    made = G.in_sequence(results(spark, sf_dir), "answer", rules)
    return made.select("conv_id", "turn", F.substring(F.sha2("answer", 256), 1, 12).alias("digest"), F.length("answer").cast("long").alias("n"), F.array_join("fired", ",").alias("fired"))


_W = _wilson("count(*) FILTER (NOT correct)", "count(*)")


@query(f"""WITH {_R} SELECT family, count(*) FILTER (date_bound AND correct) AS a, count(*) FILTER (date_bound AND NOT correct) AS b, count(*) FILTER (NOT date_bound AND correct) AS c, count(*) FILTER (NOT date_bound AND NOT correct) AS d,
count(*) FILTER (NOT correct) / CAST(count(*) AS DOUBLE) AS error_rate, round({_W[0]}, 9) AS low, round({_W[1]}, 9) AS high FROM rec WHERE scored GROUP BY 1""")
def n11_contingency(spark, sf_dir):
    """Flag against hit by family, with the error rate and its interval."""
    r = records(spark, sf_dir).filter("scored")
    flag, good = F.col("date_bound"), F.col("correct")
    g = r.groupBy("family").agg(F.count_if(flag & good).alias("a"), F.count_if(flag & ~good).alias("b"), F.count_if(~flag & good).alias("c"), F.count_if(~flag & ~good).alias("d"), F.count_if(~good).alias("k"), F.count("*").alias("n"))
    low, high = St.wilson(F.col("k"), F.col("n"))
    return g.select("family", "a", "b", "c", "d", St.rate(F.col("k"), F.col("n")).alias("error_rate"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))
