"""Regeneration, kernels, second adjudication, checkpoints, profiles and memory contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris import vocab
from verdigris.functions import scoring as S
from verdigris.functions import text as T
from verdigris.operators import evidence as E
from verdigris.operators import folds, stores
from verdigris.operators import vectors as V
from verdigris.plans.base import registrar, table
from verdigris.plans.evidences import _NORM, results
from verdigris.plans.flagship import _PATTERNS, patterns
from verdigris.plans.scores import _ROUTED, _SCORED, routed, scored
from verdigris.plans.texts import _CORE, _has, _key_sql
from verdigris.session import scratch
from verdigris.sources import extract, files

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)


@query(f"""WITH {_SCORED}, f AS (SELECT conv_id, arg_min(mkr, turn) AS mkr, arg_min(tvs, turn) AS tvs FROM r GROUP BY 1), g AS (SELECT conv_id, turn, text, {_CORE} AS core FROM conversations WHERE role = 'assistant'),
p AS (SELECT conv_id, count(*) AS n, count(DISTINCT core) AS d, bool_or(core = '__error__') AS e, arg_min(text, turn) AS answer, arg_max(text, turn) AS rationale FROM g GROUP BY 1), k AS (SELECT p.*, tvs < 0.30 AND mkr >= 0.52 AND mkr < 0.65 AS triggered, d = 1 AND NOT e AS stable, {_key_sql('answer')} AS a, {_key_sql('rationale')} AS ra FROM p JOIN f USING (conv_id)),
sup AS (SELECT *, CASE WHEN rationale = '' OR starts_with(rationale, '[ERROR]') THEN FALSE WHEN len(a) = 0 THEN TRUE WHEN len(list_filter(a, lambda t: NOT regexp_matches(t, '^[0-9]+$'))) > 0 THEN len(list_intersect(list_filter(a, lambda t: NOT regexp_matches(t, '^[0-9]+$')), ra)) > 0 ELSE FALSE END AS supported FROM k)
SELECT conv_id, triggered, CAST(CASE WHEN triggered AND NOT stable THEN 0.15 ELSE 0 END AS DOUBLE) AS variance_penalty, CAST(CASE WHEN triggered AND stable AND NOT supported THEN 0.12 ELSE 0 END AS DOUBLE) AS conflict_penalty, CASE WHEN n < 2 THEN CAST(0 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), CAST(1.5 AS DOUBLE) * d / n) END AS diversity FROM sup""")
def d14_d15_d17_regeneration(spark, sf_dir):
    """A conversation's replies stand for regenerations of one answer: do they state one thing, and does the last bear out the first?

    Both penalties hold in the band of reliability from 0.52 to 0.65 only.
    """
    first = scored(spark, sf_dir).groupBy("conv_id").agg(F.min_by("mkr", "turn").alias("mkr"), F.min_by("tvs", "turn").alias("tvs"))
    g = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text", T.core_proposition(F.col("text")).alias("core"))
    p = g.groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("core").alias("d"), F.bool_or(F.col("core") == "__error__").alias("e"), F.min_by("text", "turn").alias("answer"), F.max_by("text", "turn").alias("rationale"))
    triggered = S.eligible(F.col("tvs"), F.col("mkr")) & (F.col("mkr") < 0.65)
    variance, conflict = S.regeneration_penalties(triggered, (F.col("d") == 1) & ~F.col("e"), T.supported(F.col("answer"), F.col("rationale")))
    return p.join(first, "conv_id").select("conv_id", triggered.alias("triggered"), variance.alias("variance_penalty"), conflict.alias("conflict_penalty"), S.diversity(F.col("d"), F.col("n")).alias("diversity"))


_PI = f"""{_SCORED}, pen AS (SELECT *, CASE WHEN tvs < 0.30 AND mkr >= 0.52 AND mkr < 0.65 AND turn % 3 = 1 THEN 0.15 ELSE 0 END::DOUBLE AS variance, CASE WHEN mkr >= 0.52 AND mkr < 0.65 AND turn % 4 = 2 THEN 0.10 ELSE 0 END::DOUBLE AS entropy FROM r), pi AS (SELECT *, round(variance + entropy, 3) AS pi, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM pen)"""
_STEP = "least(CAST(1 AS DOUBLE), pi / CAST(0.37 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * recency - CAST(0.1 AS DOUBLE) * least(CAST(1 AS DOUBLE), {n} / CAST(10 AS DOUBLE))"


@query(f"""WITH RECURSIVE {_PI}, c AS (SELECT conv_id, n, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(0.2 AS DOUBLE) + CAST(0.3 AS DOUBLE) * {_STEP.format(n='n')})) AS phi FROM pi WHERE n = 1
UNION ALL SELECT pi.conv_id, pi.n, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), c.phi + CAST(0.3 AS DOUBLE) * {_STEP.format(n='pi.n')})) FROM c JOIN pi ON pi.conv_id = c.conv_id AND pi.n = c.n + 1),
x AS (SELECT pi.*, phi, CASE WHEN phi <= 0.30 THEN 'answer' WHEN phi <= 0.60 THEN 'self_check' WHEN phi <= 0.90 THEN 'verify' ELSE 'ask_abstain' END AS band, round(greatest(0.0, least(1.0, mkr - pi)), 3) AS dynamic, tvs < 0.30 AND mkr >= 0.52 AS static FROM pi JOIN c ON c.conv_id = pi.conv_id AND c.n = pi.n)
SELECT conv_id, turn, dynamic AS mkr, tvs < 0.30 AND dynamic >= 0.52 AND band = 'answer' AS eligible, concat_ws(',', CASE WHEN variance > 0 THEN 'VARIANCE' END, CASE WHEN entropy > 0 THEN 'ENTROPY' END, CASE WHEN static AND NOT (tvs < 0.30 AND dynamic >= 0.52 AND band = 'answer') THEN CASE WHEN pi > 0 THEN 'PENALTY_BLOCKED' WHEN band <> 'answer' THEN 'CONTROLLER_BLOCKED' END END, 'BAND_' || upper(band)) AS codes FROM x""")
def d18_dynamic_composition(spark, sf_dir):
    """Reliability less the sum of the penalties; eligible only while the controller's band is answer; reasons in order."""
    r = scored(spark, sf_dir)
    inside = (F.col("mkr") >= 0.52) & (F.col("mkr") < 0.65)
    variance = F.when(inside & (F.col("tvs") < 0.30) & (F.col("turn") % 3 == 1), 0.15).otherwise(0.0)
    entropy = F.when(inside & (F.col("turn") % 4 == 2), 0.10).otherwise(0.0)
    r = r.withColumns({"variance": variance, "entropy": entropy}).withColumn("pi", F.round(F.col("variance") + F.col("entropy"), 3))
    state = folds.controlled(r.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("seq"), "pi", F.col("recency").alias("fresh")), int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = r.join(state.select(F.col("session_id").alias("conv_id"), F.col("seq").cast("int").alias("turn"), "band"), ["conv_id", "turn"])
    mkr, eligible, codes = S.dynamic_reliability(F.col("tvs"), F.col("mkr"), F.col("pi"), F.col("band"), [(F.col("variance") > 0, "VARIANCE"), (F.col("entropy") > 0, "ENTROPY")])
    return x.select("conv_id", "turn", mkr.alias("mkr"), eligible.alias("eligible"), F.array_join(codes, ",").alias("codes"))


_QK = """qk AS (SELECT k, k % 3 = 0 AS always, k % 3 = 1 AS context, k % 11 = 5 AS suppressed, CASE WHEN k % 5 = 0 THEN ['lite', 'std', 'pro'] WHEN k % 2 = 0 THEN ['std', 'pro'] ELSE ['pro'] END AS zones FROM (SELECT unnest(range(0, 42)) AS k))"""


@query(f"""WITH {_ROUTED}, {_QK}, a AS (SELECT DISTINCT route, CASE domain WHEN 'history' THEN 'translation' ELSE domain END AS intent, CASE WHEN tvs < 0.3 THEN 'lite' WHEN mkr >= 0.6 THEN 'pro' ELSE 'std' END AS zone FROM routed WHERE route NOT IN ('abstain', 'ask'))
SELECT route, intent, zone, k AS kernel FROM a JOIN qk ON CASE WHEN intent = 'translation' THEN k IN (3, 6, 10) ELSE NOT suppressed AND list_contains(zones, zone) AND NOT (k % 6 = 0 AND intent = 'law') AND ((always AND (k % 9 <> 0 OR zone = 'pro')) OR (context AND zone = 'pro' AND (k % 4 <> 1 OR intent = 'finance'))) END""")
def d26_kernel_selection(spark, sf_dir):
    """Three layers over 42 kernels: an intent with kernels of its own, those always on, and in one zone those that depend on context.

    Policy is small tables: kernels, suppressed intents, zone overrides, intents that a kernel is kept for.
    """
    k = F.col("kernel")
    zones = F.when(k % 5 == 0, F.array(*map(F.lit, ("lite", "std", "pro")))).when(k % 2 == 0, F.array(F.lit("std"), F.lit("pro"))).otherwise(F.array(F.lit("pro")))
    kernels = spark.range(42).select(F.col("id").alias("kernel")).select("kernel", (k % 3 == 0).alias("always"), (k % 3 == 1).alias("context"), (k % 11 == 5).alias("suppressed"), zones.alias("zones"))
    own = spark.createDataFrame([("translation", x) for x in (3, 6, 10)], "intent string, kernel long")
    suppressed = spark.createDataFrame([(x, "law") for x in range(0, 42, 6)], "kernel long, intent string")
    overrides = spark.createDataFrame([(x, "pro") for x in range(0, 42, 9)], "kernel long, only string")
    kept_for = spark.createDataFrame([(x, "finance") for x in range(1, 42, 4)], "kernel long, effective string")
    zone = S.first_match([(F.col("tvs") < 0.3, "lite"), (F.col("mkr") >= 0.6, "pro")], "std")
    asked = routed(spark, sf_dir).select("route", F.when(F.col("domain") == "history", "translation").otherwise(F.col("domain")).alias("intent"), zone.alias("zone")).distinct()
    return S.selected_kernels(asked, kernels, own, suppressed, overrides, kept_for).select("route", "intent", "zone", "kernel")


_CLAIMS = """c AS (SELECT query_id, rank, list_distinct(regexp_extract_all(claim, '[0-9]+')) AS nums, list_distinct(string_split(lower(claim), ' ')) AS words FROM cl),
nr AS (SELECT a.query_id, count(*) FILTER (len(list_intersect(a.nums, b.nums)) > 0) / CAST(count(*) AS DOUBLE) AS rate FROM c a JOIN c b ON a.query_id = b.query_id AND a.rank < b.rank WHERE len(a.nums) > 0 AND len(b.nums) > 0 GROUP BY 1),
fw AS (SELECT query_id, list(words ORDER BY rank) AS w, max(len(words)) AS longest FROM c GROUP BY 1), sh AS (SELECT fw.*, rate, len(list_intersect(w[1], w[2])) / CAST(least(len(w[1]), len(w[2])) AS DOUBLE) AS share FROM fw LEFT JOIN nr USING (query_id)),
ag AS (SELECT query_id, CASE WHEN longest <= 2 THEN 'mixed' WHEN rate >= 0.7 THEN 'high' WHEN rate >= 0.3 THEN 'mixed' WHEN rate IS NOT NULL THEN 'low' WHEN len(w) < 2 THEN 'mixed' WHEN share >= 0.5 THEN 'high' WHEN share >= 0.2 THEN 'mixed' ELSE 'low' END AS agreement FROM sh)"""


@query(f"""WITH {_NORM}, q AS (SELECT query_id, query_id % 4 = 0 AS fresh, query_id % 5 = 0 AS high, query_id % 5 = 1 AS medium, (query_id % 9) / CAST(10 AS DOUBLE) AS gain FROM (SELECT DISTINCT query_id FROM norm)),
it AS (SELECT query_id, rank, regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^[w.]+', '') AS source, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[-_=&?.]', ' ', 'g') || ' page of the site' AS claim FROM norm), cl AS (SELECT query_id, rank, claim FROM it), {_CLAIMS},
s AS (SELECT it.query_id, count(DISTINCT source) AS d, count(*) FILTER (ends_with(source, '.org')) AS strong, count(*) FILTER (contains(source, 'blog')) AS moderate, bool_or(rank % 3 = 0) AS web, count(*) AS n FROM it GROUP BY 1),
t AS (SELECT s.query_id, CASE WHEN NOT (fresh OR high OR medium) THEN 'stable' WHEN fresh AND web THEN 'current' WHEN fresh THEN 'stale_risk' ELSE 'time_sensitive' END AS freshness, CASE WHEN d >= 3 THEN 'high' WHEN d = 2 THEN 'moderate' ELSE 'low' END AS diversity, CASE WHEN n <= 1 THEN 'high' ELSE agreement END AS agreement, CASE WHEN strong >= 2 THEN 'strong' WHEN strong >= 1 OR moderate >= 1 THEN 'moderate' ELSE 'weak' END AS provenance, CASE WHEN high THEN 0.8 WHEN fresh THEN 0.7 WHEN medium THEN 0.5 ELSE 0.2 END::DOUBLE AS tvs, CASE WHEN high OR fresh THEN 0.4 WHEN medium THEN 0.55 ELSE 0.65 END::DOUBLE AS mkr, gain FROM s JOIN q USING (query_id) JOIN ag USING (query_id)),
u AS (SELECT *, CASE agreement WHEN 'high' THEN 'none' WHEN 'mixed' THEN 'managed' ELSE 'open' END AS conflict FROM t), v AS (SELECT *, CASE WHEN conflict = 'open' THEN 'weak' WHEN diversity = 'high' AND agreement = 'high' AND provenance IN ('moderate', 'strong') AND freshness IN ('stable', 'current') THEN 'strong' WHEN diversity = 'low' OR agreement = 'low' OR freshness = 'stale_risk' THEN 'weak' ELSE 'medium' END AS strength FROM u)
SELECT query_id, freshness, diversity, agreement, provenance, conflict, strength, tvs, mkr, CASE WHEN conflict = 'open' THEN 'bounded' WHEN strength = 'strong' AND freshness IN ('stable', 'current') THEN CASE WHEN tvs < 0.6 AND mkr > 0.5 AND NOT gain > 0.7 THEN 'answerable' ELSE 'bounded' END WHEN strength IN ('medium', 'strong') THEN 'bounded' ELSE 'failed' END AS admissibility FROM v""")
def g10_g11_second_adjudicator(spark, sf_dir):
    """The eight steps of the second adjudicator, with the stub estimate of volatility and reliability."""
    r = E.normalised(results(spark, sf_dir), 8).withColumn("source", T.source_name(F.col("url")))
    claim = F.concat(F.regexp_replace(F.regexp_extract("url", "([^/]*)$", 1), "[-_=&?.]", " "), F.lit(" page of the site"))
    items = r.select("query_id", "rank", "source", claim.alias("claim"), (F.col("rank") % 3 == 0).alias("web"))
    q = F.col("query_id")
    flags = {"fresh": q % 4 == 0, "high_word": q % 5 == 0, "medium_word": q % 5 == 1, "gain": q % 9 / 10.0}
    done = E.second_adjudication(items, flags, strong=(".org",), moderate=("blog",))
    return done.select("query_id", "freshness", "diversity", "agreement", "provenance", "conflict", "strength", "tvs", "mkr", "admissibility")


_THEMES = "tk AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS token, role = 'user' AS explicit FROM conversations), th AS (SELECT conv_id, count(*) AS themes FROM (SELECT conv_id, token FROM tk GROUP BY ALL HAVING count(*) >= 2 OR bool_or(explicit)) GROUP BY 1)"


@query(f"""WITH {_THEMES}, m AS (SELECT conv_id, count(*) AS turns, count(*) FILTER ({_has(('and', 'with'))}) AS frames, least(CAST(1 AS DOUBLE), count(*) / CAST(8 AS DOUBLE)) AS confidence FROM conversations GROUP BY 1), e AS (SELECT m.*, coalesce(themes, 0) AS themes, conv_id % 11 = 0 AS opt_out FROM m LEFT JOIN th USING (conv_id)), b AS (SELECT *, turns >= 3 AND confidence >= 0.55 AND turns >= 5 AND frames >= 1 AND themes >= 2 AS bar FROM e)
SELECT conv_id, CASE WHEN opt_out THEN 'blocked_opt_out' WHEN turns < 3 THEN 'too_early' WHEN NOT bar THEN 'low_confidence' ELSE 'promotable' END AS outcome, CAST(CASE WHEN opt_out OR NOT bar THEN 0 ELSE (turns - 5) // 3 + 1 END AS INTEGER) AS fired FROM b""")
def f6_checkpoint(spark, sf_dir):
    """The checkpoint's outcome, and how often it fires when three turns at least must pass in between."""
    c = table(spark, sf_dir, "conversations")
    tokens = c.select(F.col("conv_id").alias("session"), "turn", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0))).alias("token"), (F.col("role") == "user").alias("explicit"))
    themes = folds.themes(tokens).groupBy(F.col("session").alias("conv_id")).agg(F.count_if("active").alias("themes"))
    m = c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(vocab.has(F.col("text"), ("and", "with"))).alias("frames")).join(themes, "conv_id", "left")
    e = m.withColumns({"confidence": F.least(F.lit(1.0), F.col("turns") / 8.0), "themes": F.coalesce("themes", F.lit(0)), "opt_out": F.col("conv_id") % 11 == 0})
    outcome = S.checkpoint(F.col("opt_out"), F.col("confidence"), F.col("turns"), F.col("frames"), F.col("themes"))
    return e.select("conv_id", outcome.alias("outcome"), F.when(outcome == "promotable", folds.fired(F.col("turns"), 5, 3)).otherwise(0).alias("fired"))


_MAP = """u AS (SELECT user_id, count(*) AS n, least(CAST(1 AS DOUBLE), count(*) / CAST(30 AS DOUBLE)) AS confidence, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY 1),
x AS (SELECT *, n < 3 AS cold, CASE WHEN user_id % 7 = 3 THEN 'xx' ELSE 'en' END AS language, user_id % 3 = 0 AS known, CASE WHEN user_id % 5 = 0 THEN list_append(kinds, repeat('x', 300)) WHEN user_id % 5 = 1 THEN list_append(kinds, 'One. Two. Three.') ELSE kinds END AS frames, (user_id % 10) / CAST(5 AS DOUBLE) AS baseline FROM u)"""


@query(f"""WITH {_MAP}, p AS (SELECT *, NOT (confidence < 0.45 OR n < 3 OR cold) AS pass, CASE WHEN known THEN ['click', 'old'] ELSE [] END AS had, list_filter(frames, lambda f: length(f) <= 240 AND length(f) - length(replace(f, '.', '')) < 2) AS good FROM x)
SELECT user_id, pass, CASE WHEN pass AND language <> 'xx' THEN language WHEN known THEN 'de' END AS language, CASE WHEN pass AND abs(CASE WHEN known THEN 0.5 ELSE 0 END - baseline) > 0.05 THEN baseline WHEN known THEN 0.5 ELSE 0 END::DOUBLE AS abstraction, array_to_string(CASE WHEN pass THEN list_concat(had, list_filter(good, lambda f: NOT list_contains(had, f)))[1:16] ELSE had END, ',') AS frames, CAST(CASE WHEN pass THEN len(frames) - len(good) ELSE 1 END AS INTEGER) AS rejected, CASE WHEN pass THEN greatest(CASE WHEN known THEN 0.6 ELSE 0 END, least(confidence, 0.9)) WHEN known THEN 0.6 ELSE 0 END::DOUBLE AS confidence FROM p""")
def f8_profile(spark, sf_dir):
    """A session's map distilled into the stored profile: floors, explicit language, carried averages, capped lists of short tags."""
    return profiles(spark, sf_dir).select("user_id", "pass", "language", "abstraction", F.array_join("frames", ",").alias("frames"), "rejected", "confidence")


def profiles(spark, sf_dir) -> DataFrame:
    k = F.col("user_id")
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
    extra = F.when(k % 5 == 0, F.array(F.repeat(F.lit("x"), 300))).when(k % 5 == 1, F.array(F.lit("One. Two. Three."))).otherwise(F.array().cast("array<string>"))
    session = u.select(k, "n", F.least(F.lit(1.0), F.col("n") / 30.0).alias("confidence"), (F.col("n") < 3).alias("cold"), F.when(k % 7 == 3, "xx").otherwise("en").alias("language"), F.concat("kinds", extra).alias("frames"), (k % 10 / 5.0).alias("abstraction"))
    stored = u.filter("user_id % 3 = 0").select(k, F.lit("de").alias("language"), F.lit(0.5).alias("abstraction"), F.array(F.lit("click"), F.lit("old")).alias("frames"), F.lit(0.6).alias("confidence"))
    return stores.distilled(session, stored, "user_id")


@query(f"""WITH {_MAP} SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'deleted' ELSE 'kept' END AS state FROM x WHERE user_id % 3 = 0 OR NOT (confidence < 0.45 OR n < 3 OR cold)""")
def m4_profile_store(spark, sf_dir):
    """Profiles saved, loaded again, and some deleted."""
    p = profiles(spark, sf_dir).filter("pass or user_id % 3 = 0").select("user_id", "language", "frames", "confidence")
    path = scratch(spark, "profiles")
    files.published(p, f"{path}/saved")
    saved = spark.read.schema(p.schema).parquet(f"{path}/saved")
    left = saved.join(saved.filter("user_id % 4 = 0").select("user_id"), "user_id", "left_anti")
    files.published(left, f"{path}/left")
    return saved.select("user_id").join(spark.read.schema(p.schema).parquet(f"{path}/left").select("user_id", F.lit("kept").alias("state")), "user_id", "left").select("user_id", F.coalesce("state", F.lit("deleted")).alias("state"))


@query("""WITH c AS (SELECT conv_id, turn, text, (conv_id * 7 + turn * 3) % 10 / CAST(10 AS DOUBLE) AS salience, (conv_id * 5 + turn * 7) % 11 / CAST(11 AS DOUBLE) AS w, (conv_id * 3 + turn) % 13 / CAST(13 AS DOUBLE) AS s, CASE turn % 2 WHEN 0 THEN 'B' ELSE 'C' END AS box FROM conversations),
m AS (SELECT conv_id, string_agg('[Session memory] ' || text, chr(10) ORDER BY r) AS memory FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY salience DESC, turn) AS r FROM c WHERE salience >= 0.3) WHERE r <= 2 GROUP BY 1), k AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY r) FILTER (r <= 2) AS workspace, max(w) AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY w DESC, turn) AS r FROM c) WHERE r <= 3 GROUP BY 1),
v AS (SELECT conv_id, string_agg('[User workspace Box ' || box || '] ' || substr(text, 1, 400), chr(10) || chr(10) ORDER BY box, r) AS reserved FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, box ORDER BY s DESC, turn) AS r FROM c) WHERE r <= 2 AND conv_id % 2 = 0 GROUP BY 1)
SELECT k.conv_id, substr(sha256(coalesce(memory, '')), 1, 12) AS memory, substr(sha256(CASE WHEN best >= 0.35 THEN workspace ELSE '' END), 1, 12) AS workspace, substr(sha256(coalesce(reserved, '')), 1, 12) AS reserved FROM k LEFT JOIN m USING (conv_id) LEFT JOIN v USING (conv_id)""")
def n17_memory_context(spark, sf_dir):
    """What a prompt gets: two salient memories, the workspace's best two behind a gate, and two reserved places of each box."""
    i, t = F.col("conv_id"), F.col("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", ((i * 7 + t * 3) % 10 / 10.0).alias("salience"), ((i * 5 + t * 7) % 11 / 11.0).alias("w"), ((i * 3 + t) % 13 / 13.0).alias("s"), F.when(t % 2 == 0, "B").otherwise("C").alias("box"))

    def best(rows: DataFrame, by: str, n: int, *keys: str) -> DataFrame:
        return rows.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", *keys).orderBy(F.desc(by), "turn"))).filter(F.col("r") <= n)

    def block(rows: DataFrame, text, sep: str, name: str, *keys: str) -> DataFrame:
        return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, "r", text.alias("x")))), lambda x: x["x"]), sep).alias(name))

    memory = block(best(c.filter("salience >= 0.3"), "salience", 2), F.concat(F.lit("[Session memory] "), "text"), "\n", "memory")
    ranked = best(c, "w", 3)
    workspace = block(ranked.filter("r <= 2"), F.col("text"), "\n", "workspace").join(ranked.groupBy("conv_id").agg(F.max("w").alias("best")), "conv_id")
    reserved = block(best(c.filter("conv_id % 2 = 0"), "s", 2, "box"), F.concat(F.lit("[User workspace Box "), "box", F.lit("] "), F.substring("text", 1, 400)), "\n\n", "reserved", "box")
    said = lambda x: T.fingerprint(F.coalesce(x, F.lit("")), 12)
    joined = workspace.join(memory, "conv_id", "left").join(reserved, "conv_id", "left")
    return joined.select("conv_id", said(F.col("memory")).alias("memory"), said(F.when(F.col("best") >= 0.35, F.col("workspace"))).alias("workspace"), said(F.col("reserved")).alias("reserved"))


@query("""WITH a AS (SELECT conv_id, turn % 3 AS run, length(text) % 10 / CAST(10 AS DOUBLE) AS score, CASE turn % 2 WHEN 0 THEN 0.2 ELSE 0.5 END AS least FROM conversations), r AS (SELECT conv_id, run, count(*) FILTER (score < least) AS fails FROM a GROUP BY ALL)
SELECT conv_id, CAST(count(*) FILTER (fails = 0) AS BIGINT) AS passes, count(*) FILTER (fails = 0) >= 2 AS gate, string_agg('run ' || CAST(run AS VARCHAR) || ': ' || CASE WHEN fails = 0 THEN 'PASS' ELSE 'FAIL' END || ' (' || CAST(fails AS VARCHAR) || ' fail)', ' | ' ORDER BY run) AS detail FROM r GROUP BY 1""")
def n21_stochastic_gate(spark, sf_dir):
    """Runs of a scenario (turns by threes) pass when the judge's score of every assertion reaches its bound; two runs must pass."""
    least = F.when(F.col("turn") % 2 == 0, 0.2).otherwise(0.5)
    a = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 3).alias("run"), (F.length("text") % 10 / 10.0 < least).alias("fails"))
    r = a.groupBy("conv_id", "run").agg(F.count_if("fails").alias("fails"))
    told = F.format_string("run %d: %s (%d fail)", F.col("run"), F.when(F.col("fails") == 0, "PASS").otherwise("FAIL"), F.col("fails"))
    g = r.groupBy("conv_id").agg(F.count_if(F.col("fails") == 0).alias("passes"), F.array_sort(F.collect_list(F.struct("run", told.alias("t")))).alias("all"))
    return g.select("conv_id", "passes", (F.col("passes") >= 2).alias("gate"), F.array_join(F.transform("all", lambda x: x["t"]), " | ").alias("detail"))


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN contains('pat_' || CAST(p_partkey AS VARCHAR), '1') THEN 'id' END, CASE WHEN contains(lower(p_name), '1') OR contains(lower(p_name), 'gi') THEN 'intent' END, CASE WHEN contains(lower(p_brand), '1') THEN 'topic' END, CASE WHEN contains(lower(p_type), '1') THEN 'examples' END, CASE WHEN contains(lower(p_name || '1' || p_type), '1') AND p_size > 40 THEN 'negatives' END, CASE WHEN contains(CAST(p_size AS VARCHAR), '1') THEN 'tags' END) AS fields FROM part
WHERE contains(CAST(p_partkey AS VARCHAR), '1') OR contains(lower(p_name), '1') OR contains(lower(p_brand), '1') OR contains(lower(p_type), '1') OR p_size > 40 OR contains(CAST(p_size AS VARCHAR), '1')""".replace(" OR contains(lower(p_name), 'gi')", ""))
def e29_pattern_text_search(spark, sf_dir):
    """Patterns with the needle in any of six fields, and which."""
    one = lambda c: F.array(c.cast("string"))
    fields = {"id": one(F.concat(F.lit("pat_"), F.col("p_partkey").cast("string"))), "intent": one(F.col("p_name")), "topic": one(F.col("p_brand")), "examples": one(F.col("p_type")), "negatives": F.when(F.col("p_size") > 40, one(F.concat("p_name", F.lit("1"), "p_type"))).otherwise(F.array().cast("array<string>")), "tags": one(F.col("p_size"))}
    found = T.tags_in_order({name: F.exists(values, lambda x: F.contains(F.lower(x), F.lit("1"))) for name, values in fields.items()})
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("f")).filter("size(f) > 0").select("p_partkey", F.array_join("f", ",").alias("fields"))


_YAML = "0:\n  high: 0.40\n  med: 0.34\n1:\n  high: 0.38\nbroken\nsub_topics:\n  1:\n    high: 0.36\n  2:\n    med: 0.25\n"


@query(f"""WITH pat AS ({_PATTERNS}), lev AS (SELECT * FROM (VALUES (0, NULL, 0.40, 0.34), (1, NULL, 0.38, NULL), (NULL, 1, 0.36, NULL), (NULL, 2, NULL, 0.25)) AS t(topic, sub, high, medium)) SELECT pat.label, CAST(coalesce(s.high, t.high, 0.999) AS DOUBLE) AS high, CAST(coalesce(s.medium, t.medium, 0.999) AS DOUBLE) AS medium FROM pat LEFT JOIN lev s ON s.sub = pat.sub LEFT JOIN lev t ON t.topic = pat.topic""")
def a15_e18_loaded_thresholds(spark, sf_dir):
    """Thresholds of a nested configuration, by topic and sub-topic, resolved for every pattern."""
    levels = files.threshold_levels(spark, _YAML)
    return V.with_thresholds(patterns(spark, sf_dir)[0], levels).select("label", "high", "medium")


_CUES = {"brief": ("was", "with", "for"), "formal": ("and", "this", "that")}
_CUE_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_has(w)} THEN '{name}' END" for name, w in _CUES.items()) + "], lambda x: x IS NOT NULL)"
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= {1}))"


@query(f"""WITH u AS (SELECT conv_id, turn, text, {_CUE_SQL} AS cues, {_TOKENS.format('text', 5)} AS tokens, CASE WHEN {_has(('not',))} THEN 2.0 WHEN {_has(('of', 'the'))} THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM conversations WHERE role = 'user'),
h AS (SELECT *, coalesce(flatten(list(cues) OVER w), []) AS had, count(*) OVER w AS n, coalesce(list_reduce(list_prepend(CAST(0 AS DOUBLE), list(label) OVER w), lambda a, x: CAST(0.75 AS DOUBLE) * a + CAST(0.25 AS DOUBLE) * x), 0) AS baseline, coalesce(flatten(list(tokens) OVER w), []) AS before FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT h.*, f.text AS frame, {_TOKENS.format('h.text', 3)} AS a, {_TOKENS.format('f.text', 3)} AS b, list_filter(tokens, lambda t: len(list_filter(before, lambda x: x = t)) >= 2) AS theme FROM h JOIN conversations f ON f.conv_id = h.conv_id AND f.turn = h.turn - 1 AND f.role = 'assistant'),
l AS (SELECT *, coalesce(len(list_intersect(a, b)) / CAST(nullif(least(len(a), len(b)), 0) AS DOUBLE), 0) AS lex FROM p),
s AS (SELECT *, CASE WHEN lex >= 0.45 THEN 0.4 WHEN lex >= 0.25 THEN 0.4 * (lex - 0.25) / 0.2 ELSE 0 END + CASE WHEN len(cues) > 0 THEN 0.25 + CASE WHEN len(list_intersect(cues, had)) > 0 THEN 0.15 ELSE 0 END WHEN len(had) > 0 AND n >= 3 THEN 0.10 ELSE 0 END + CASE WHEN len(list_intersect(theme, {_TOKENS.format('frame', 5)})) > 0 THEN 0.2 WHEN len(theme) > 0 THEN 0.1 ELSE 0 END + CASE WHEN abs(label - baseline) <= 1 THEN 0.1 ELSE 0 END AS score FROM l)
SELECT conv_id, turn, CAST(round(score, 4) AS DOUBLE) AS score, CASE WHEN {_has(('or',))} THEN 'rejected' WHEN lex >= 0.45 OR round(score, 4) >= 0.4 THEN 'adopted' ELSE 'ignored' END AS outcome FROM s""")
def f3_adoption(spark, sf_dir):
    """Whether a user takes up the frame of the reply before: eight weighted signals, or plain overlap; a correction rejects it.

    What the session showed before (cues, themes, level of abstraction) comes from windows over
    its user turns.
    """
    c = table(spark, sf_dir, "conversations")
    t = F.col("text")
    label = S.first_match([(vocab.has(t, ("not",)), 2.0), (vocab.has(t, ("of", "the")), 1.0)], 0.0)
    users = c.filter("role = 'user'").select("conv_id", "turn", "text", T.cues(t, _CUES).alias("cues"), T.long_tokens(t, 5).alias("tokens"), label.alias("label"))
    state = folds.before_turns(users, tuple(_CUES))
    frames = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("frame"))
    score, lexical = folds.adoption_score(state.join(frames, ["conv_id", "turn"]))
    scored_ = state.join(frames, ["conv_id", "turn"]).select("conv_id", "turn", "text", F.round(score, 4).alias("score"), lexical.alias("lex"))
    outcome = S.first_match([(vocab.has(t, ("or",)), "rejected"), ((F.col("lex") >= 0.45) | (F.col("score") >= 0.4), "adopted")], "ignored")
    return scored_.select("conv_id", "turn", "score", outcome.alias("outcome"))


@query("""WITH r AS (SELECT page_id, 'p' || CAST(page_id AS VARCHAR) || CASE page_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '.csv' WHEN 2 THEN '.json' ELSE '.txt' END AS name, CASE page_id % 4 WHEN 0 THEN '<p>one <b>two</b></p><script>x</script>' WHEN 1 THEN 'a,b' || chr(10) || 'c,' || url WHEN 2 THEN '{"k": ["v", {"u": "' || url || '"}]}' ELSE url END AS raw FROM pages)
SELECT name, CASE page_id % 4 WHEN 0 THEN 'one two' WHEN 1 THEN 'a | b' || chr(10) || 'c | ' || url WHEN 2 THEN 'v' || chr(10) || 'u: ' || url ELSE url END AS text FROM r JOIN pages USING (page_id)""")
def a5_extracted_kinds(spark, sf_dir):
    """Text of files of four kinds from their content: pages without tags, rows as cells between bars, JSON as its leaves with their names."""
    k, url = F.col("page_id") % 4, F.col("url")
    kinds = ("html", "csv", "json", "txt")
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), S.first_match([(k == i, F.lit("." + x)) for i, x in enumerate(kinds)], ""))
    raw = S.first_match([(k == 0, F.lit("<p>one <b>two</b></p><script>x</script>")), (k == 1, F.concat(F.lit("a,b\nc,"), url)), (k == 2, F.concat(F.lit('{"k": ["v", {"u": "'), url, F.lit('"}]}')))], url)
    return extract.of_contents(table(spark, sf_dir, "pages").select(name.alias("path"), raw.cast("binary").alias("content"))).select(F.col("member").alias("name"), "text")
