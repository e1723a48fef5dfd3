"""Queries of whole rule books: all triggers, families and templates, intervals and sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris import vocab
from verdigris.functions import rulebook as B
from verdigris.functions import scoring as S
from verdigris.operators import statistics as St
from verdigris.operators import vectors as V
from verdigris.plans.base import registrar, table
from verdigris.plans.evals import _R, records
from verdigris.plans.flagship import _POOL, _SIMS, _ranked
from verdigris.plans.scores import _ROUTED, routed
from verdigris.plans.texts import _PAIRS, _has, pairs

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

#: Function words of the invented languages stand for the vocabularies of the rules.
_ASKED = {
    "definition": ("is", "est", "ist"), "reasoning": ("and", "et", "und"), "confirmatory": ("not", "nicht"), "pronoun": ("it", "la", "die"), "vague_verb": ("with", "avec", "mit"), "vague_best": ("from", "dans"),
    "dependent_subject": ("this", "une"), "bare_action": ("be", "auf"), "freshness": ("for", "pour", "von"), "referent": ("of", "de", "der"), "needs_context": ("by", "dem"), "self": ("on", "qui"), "stable": ("the", "le"),
}
_W = {k: _has(v, "s") for k, v in _ASKED.items()}
_N = r"(len(regexp_extract_all(s, '[^ \t\n]+')) + len(regexp_extract_all(s, '[\x{3000}-\x{9fff}\x{f900}-\x{faff}]')))"


@query(rf"""WITH p AS (SELECT conv_id, turn, regexp_split_to_array(text, '[.\n]+') AS parts FROM conversations), e AS (SELECT conv_id, turn, parts, unnest(range(len(parts))) AS pos FROM p), q AS (SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, parts[pos + 1] AS s FROM e WHERE trim(parts[pos + 1]) <> ''),
f AS (SELECT conv_id, turn, pos, {_N} < 4 AND NOT {_W['definition']} AND turn = 0 AND NOT {_W['reasoning']} AND NOT {_W['confirmatory']} AS few_words, s LIKE '%e' AND {_W['pronoun']} AND NOT {_W['reasoning']} AS pronoun, {_W['vague_verb']} AS vague_verb, {_W['vague_best']} AS vague_best,
{_W['dependent_subject']} AS dependent_subject, {_W['bare_action']} AS bare_action, {_W['freshness']} AND NOT {_W['referent']} AND {_N} <= 8 AS bare_freshness, {_W['needs_context']} AND turn = 0 AS needs_context, {_W['self']} AS about_self, {_W['freshness']} AS fresh, {_W['referent']} AS referent, {_W['stable']} AS stable FROM q),
u AS (SELECT *, {' OR '.join(B.TRIGGERS)} AS under FROM f)
SELECT conv_id, turn, pos, concat_ws(',', {', '.join(f"CASE WHEN {t} THEN '{t}' END" for t in B.TRIGGERS)}) AS fired, CAST(CASE WHEN under AND NOT about_self THEN 0.35 ELSE 0.8 END AS DOUBLE) AS completeness, CAST(CASE WHEN under AND NOT about_self THEN 0.4 ELSE 0.85 END AS DOUBLE) AS clarity,
CAST(CASE WHEN stable THEN 0.1 WHEN fresh AND referent THEN 0.8 WHEN fresh OR under THEN 0.55 ELSE 0.25 END AS DOUBLE) AS uncertainty FROM u""")
def d19_underspecified_triggers(spark, sf_dir):
    """Every sentence of every turn as a query: the triggers that fire, and what follows from them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"[.\n]+")).alias("pos", "s")).filter(F.trim("s") != "")
    s, holds = F.col("s"), lambda name: vocab.has(F.col("s"), _ASKED[name])
    fires = B.under_specification(s, s.endswith("e"), F.col("turn") > 0, _ASKED)
    under = F.exists(F.array(*map(F.col, fires)), lambda x: x)
    after = B.appraised(F.col("under"), holds("self"), holds("freshness"), holds("referent"), holds("stable"))
    fired = F.concat_ws(",", *(F.when(F.col(t), t) for t in fires))
    return c.withColumns(fires).withColumn("under", under).select("conv_id", "turn", "pos", fired.alias("fired"), *(v.alias(k) for k, v in after.items()))


_TYPES = ("goal", "constraint", "preference", "open_loop", "stable_fact")
_TYPE = f"CASE WHEN {_has(('was', 'une'))} THEN 'goal' WHEN {_has(('with', 'avec', 'mit'))} THEN 'constraint' WHEN {_has(('for', 'pour'))} THEN 'preference' WHEN route = 'ask' THEN 'open_loop' WHEN turn % 5 = 4 THEN 'other' ELSE 'stable_fact' END"
_ADDED = "CASE WHEN tvs >= 0.7 THEN 'volatile' WHEN turn > 0 THEN 'follow-up' ELSE '' END"
_HEAD = {"goal": "Long-term intent detected (' || added || '). Route: ' || route || '.", "constraint": "Design constraint identified. Route: ' || route || '.", "preference": "User preference detected. Route: ' || route || '.", "open_loop": "Unresolved question — clarification needed before proceeding. Route: ' || route || ' (ask).", "stable_fact": "Verified or stable information. Route: ' || route || ', ' || added || '."}
_TAG = {"goal": "Goal", "constraint": "Constraint", "preference": "Preference", "open_loop": "OpenLoop", "stable_fact": "StableFact"}
_CAPSULE = " ".join(
    f"WHEN '{k}' THEN trim('[{_TAG[k]}] Session ' || session || ' turn ' || CAST(turn AS VARCHAR) || ': {_HEAD[k]} Reason: ' || reason || '." + (" Notes: ' || added || '." if k == "constraint" else "") + f" ' || substr(text, 1, {B.SUMMARY[k]}))" for k in _TYPES
)


@query(f"WITH {_ROUTED}, k AS (SELECT conv_id, turn, route, reason, text, substr('s' || CAST(conv_id * 1000003 AS VARCHAR), 1, 8) AS session, {_TYPE} AS kind, coalesce(nullif({_ADDED}, ''), 'none') AS added FROM routed) SELECT conv_id, turn, kind, CASE kind {_CAPSULE} ELSE '' END AS memory_text FROM k")
def d34_capsule_templates(spark, sf_dir):
    """The text of every turn's capsule, by its type; a type without template has none."""
    t, turn = F.col("text"), F.col("turn")
    kind = S.first_match([(vocab.has(t, ("was", "une")), "goal"), (vocab.has(t, ("with", "avec", "mit")), "constraint"), (vocab.has(t, ("for", "pour")), "preference"), (F.col("route") == "ask", "open_loop"), (turn % 5 == 4, "other")], "stable_fact")
    added = S.first_match([(F.col("tvs") >= 0.7, "volatile"), (turn > 0, "follow-up")], "")
    r = routed(spark, sf_dir).withColumns({"kind": kind, "added": added, "session": F.concat(F.lit("s"), (F.col("conv_id") * 1000003).cast("string"))})
    return r.select("conv_id", "turn", "kind", B.capsule_text(F.col("kind"), F.col("session"), turn, F.col("route"), F.col("reason"), F.col("added"), t).alias("memory_text"))


_PROMPTED = {"closed": ("by", "dem"), "ambiguous": ("this", "une"), "premise": ("with", "avec", "mit"), "current": ("was", "est", "ist"), "volatile": ("for", "pour", "von"), "entity": ("from", "auf"), "boundary": ("on", "qui"), "inquiry": ("is", "le", "la", "die", "der", "the")}
_P = {k: _has(v, "prompt") for k, v in _PROMPTED.items()}


@query(rf"""WITH {_PAIRS} SELECT conv_id, turn, CASE WHEN {_P['closed']} THEN 'stable_control' WHEN {_P['ambiguous']} THEN 'ambiguous_time_frame' WHEN {_P['premise']} AND NOT regexp_matches(lower(prompt), '^\s*({"|".join(_PROMPTED["inquiry"])})($|[^a-z])') AND ({_P['current']} OR {_P['volatile']} OR {_P['entity']}) THEN 'stale_premise_trap'
WHEN {_P['boundary']} THEN 'date_boundary' WHEN {_P['current']} AND {_P['volatile']} THEN 'volatile_current' ELSE 'query_neutrality' END AS family FROM p""")
def d38_six_families(spark, sf_dir):
    """The family of every prompt; a question about a state is no premise."""
    return pairs(spark, sf_dir).select("conv_id", "turn", B.prompt_family(F.col("prompt"), _PROMPTED).alias("family"))


@query(f"""WITH {_SIMS}, {_POOL}, c AS (SELECT query_id, chr(CAST(97 + label % 3 AS INTEGER)) || CAST(label AS VARCHAR) AS pattern, label % 2 AS priority, round(score, 1) AS score, label % 4 <> 1 AS fits, round(score, 1) >= 0.4 AS sure FROM pool WHERE score > 0.05),
r AS (SELECT *, bool_or(sure) OVER (PARTITION BY query_id) AS any_sure FROM c), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN any_sure THEN priority END DESC, score DESC, CASE WHEN any_sure THEN CAST(fits AS INTEGER) END DESC, CASE WHEN any_sure THEN ascii(pattern) END, CASE WHEN any_sure THEN pattern END DESC, pattern) AS n FROM r WHERE sure = any_sure)
SELECT query_id, pattern, score, CASE WHEN any_sure THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN NOT any_sure THEN 'LOW_CONFIDENCE' END AS warning FROM w WHERE n = 1""")
def e19_conflicts_with_context(spark, sf_dir):
    """The pattern that each query's sure candidates resolve to, else the nearest unsure one with a warning."""
    label = F.col("label")
    c = V.max_pool(_ranked(spark, sf_dir, 20)).filter("score > 0.05").select("query_id", F.concat(F.chr(97 + label % 3), label.cast("string")).alias("pattern"), (label % 2).alias("priority"), F.round("score", 1).alias("score"), (label % 4 != 1).alias("fits"))
    sure = F.col("score") >= 0.4
    best = c.groupBy("query_id").agg(F.max(F.when(sure, B.conflict_rank(F.col("priority"), F.col("score"), F.col("fits"), F.col("pattern")))).alias("high"), F.min(F.when(~sure, F.struct((-F.col("score")).alias("s"), "pattern"))).alias("medium"))
    high = F.col("high").isNotNull()
    return best.select(
        "query_id", F.when(high, F.col("high.name")).otherwise(F.col("medium.pattern")).alias("pattern"), F.when(high, F.col("high.score")).otherwise(-F.col("medium.s")).alias("score"),
        F.when(high, "high").otherwise("medium").alias("confidence"), F.when(~high, "LOW_CONFIDENCE").alias("warning"),
    )


@query(f"""WITH {_R}, x AS (SELECT *, CAST(turn % 2 AS INTEGER) AS condition FROM rec) SELECT family, condition, CAST(grouping(family, condition) AS BIGINT) AS level, count(*) AS samples, count(*) FILTER (errored) AS errors, count(*) FILTER (errored AND conv_id % 2 = 0) AS placeholders,
count(*) FILTER (scored AND correct) / CAST(nullif(count(*) FILTER (scored), 0) AS DOUBLE) AS mean_score, sum(length(answer)) / CAST(count(*) AS DOUBLE) AS mean_latency, CAST(sum(length(prompt)) AS BIGINT) AS tokens_in, CAST(sum(length(answer)) AS BIGINT) AS tokens_out, arg_max(classified, conv_id * 100000 + turn) FILTER (scored) AS last_metric
FROM x GROUP BY GROUPING SETS ((family, condition), (family), (condition), ())""")
def h6_grouped_summary(spark, sf_dir):
    """Samples, errors, placeholders, mean score and latency, token sums and the last metric at four levels."""
    x = records(spark, sf_dir).withColumn("condition", (F.col("turn") % 2).cast("int"))
    return x.groupingSets([("family", "condition"), ("family",), ("condition",), ()], "family", "condition").agg(
        F.grouping_id("family", "condition").cast("long").alias("level"), F.count("*").alias("samples"), F.count_if("errored").alias("errors"), F.count_if(F.col("errored") & (F.col("conv_id") % 2 == 0)).alias("placeholders"),
        St.rate(F.count_if(F.col("scored") & F.col("correct")), F.count_if("scored")).alias("mean_score"), St.rate(F.sum(F.length("answer")), F.count("*")).alias("mean_latency"), F.sum(F.length("prompt")).cast("long").alias("tokens_in"), F.sum(F.length("answer")).cast("long").alias("tokens_out"),
        F.max_by(F.when(F.col("scored"), F.col("classified")), F.when(F.col("scored"), F.struct("conv_id", "turn"))).alias("last_metric"),
    )


_BOUND = "CAST(1.96 AS DOUBLE)"
_MID, _HALF = f"(r + {_BOUND} * {_BOUND} / (2 * n))", f"({_BOUND} * sqrt(r * (1 - r) / n + {_BOUND} * {_BOUND} / (4 * n * n)))"
_SHARE = lambda name: f"(SELECT kernel, string_agg({name} || '=' || CAST(CAST(round(share * 10000) AS BIGINT) AS VARCHAR), ' ' ORDER BY {name}) AS {name}s FROM (SELECT kernel, CAST({name} AS VARCHAR) AS {name}, count(*) FILTER (improved) / CAST(count(*) AS DOUBLE) AS share FROM j WHERE improved IS NOT NULL GROUP BY ALL) GROUP BY 1)"


@query(f"""WITH {_R}, j AS (SELECT family AS kernel, classified AS intent, length(answer) % 3 AS lang, CASE WHEN errored THEN NULL ELSE correct END AS improved FROM rec), k AS (SELECT kernel, CAST(count(improved) AS DOUBLE) AS n, count(*) AS n_all, count(*) FILTER (improved) / CAST(nullif(count(improved), 0) AS DOUBLE) AS r FROM j GROUP BY 1)
SELECT kernel, CAST(n AS BIGINT) AS n_valid, CAST(n_all - n AS BIGINT) AS n_null, round(coalesce(r, 0), 4) AS hit_rate, round(greatest(0, ({_MID} - {_HALF}) / (1 + {_BOUND} * {_BOUND} / n)), 4) AS ci_lower, round(least(1, ({_MID} + {_HALF}) / (1 + {_BOUND} * {_BOUND} / n)), 4) AS ci_upper, intents AS by_intent, langs AS by_language
FROM k LEFT JOIN {_SHARE('intent')} USING (kernel) LEFT JOIN {_SHARE('lang')} USING (kernel)""")
def h11_kernel_intervals(spark, sf_dir):
    """Every kernel's hit rate with its interval, and its rates by intent and language in ten thousandths."""
    j = records(spark, sf_dir).select(F.col("family").alias("kernel"), F.col("classified").alias("intent"), (F.length("answer") % 3).alias("lang"), F.when(~F.col("errored"), F.col("correct")).alias("improved"))
    k = j.groupBy("kernel").agg(F.count("improved").alias("n"), F.count("*").alias("n_all"), F.count_if("improved").alias("hits"))
    lower, upper = St.wilson(F.col("hits"), F.nullif("n", F.lit(0)), 1.96)

    def shares(name: str) -> DataFrame:
        of = j.filter("improved is not null").groupBy("kernel", F.col(name).cast("string").alias(name)).agg(F.round(St.rate(F.count_if("improved"), F.count("*")) * 10000).cast("long").alias("r"))
        return of.groupBy("kernel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "r"))), lambda x: F.concat_ws("=", x[name], x["r"])), " ").alias(f"by_{name}"))

    k = k.join(shares("intent"), "kernel", "left").join(shares("lang"), "kernel", "left")
    rate = F.coalesce(St.rate(F.col("hits"), F.col("n")), F.lit(0.0))
    return k.select("kernel", F.col("n").alias("n_valid"), (F.col("n_all") - F.col("n")).alias("n_null"), F.round(rate, 4).alias("hit_rate"), F.when(F.col("n") > 0, F.round(F.greatest(F.lit(0.0), lower), 4)).alias("ci_lower"), F.when(F.col("n") > 0, F.round(F.least(F.lit(1.0), upper), 4)).alias("ci_upper"), "by_intent", F.col("by_lang").alias("by_language"))


_FORM = {"verify": ("verify", "with", "avec"), "freshness": ("was", "ist", "est")}
_GOVERNED = "CASE WHEN family = 'stable_control' THEN answer WHEN family = 'date_boundary' THEN 'Which date? ' || answer ELSE answer || ' Can you verify this?' END"


@query(f"""WITH {_R}, b AS (SELECT family, unnest(['raw', 'governed']) AS side, answer, {_GOVERNED} AS governed FROM rec), s AS (SELECT family, side, trim(CASE WHEN side = 'raw' THEN answer ELSE governed END) AS t FROM b)
SELECT family AS category, side, count(*) AS n, round(sum(length(t)) / CAST(count(*) AS DOUBLE), 1) AS mean_length_chars, round(count(*) FILTER (t LIKE '%?') / CAST(count(*) AS DOUBLE), 4) AS ends_with_question_rate, round(count(*) FILTER (contains(t, '?')) / CAST(count(*) AS DOUBLE), 4) AS contains_question_rate,
round(count(*) FILTER ({_has(_FORM['verify'], 't')}) / CAST(count(*) AS DOUBLE), 4) AS mentions_verify_rate, round(count(*) FILTER ({_has(_FORM['freshness'], 't')}) / CAST(count(*) AS DOUBLE), 4) AS mentions_freshness_rate, round(count(*) FILTER (t = '') / CAST(count(*) AS DOUBLE), 4) AS is_empty_rate FROM s GROUP BY GROUPING SETS ((family, side), (side))""")
def h16_raw_and_governed(spark, sf_dir):
    """Structure of raw and governed replies side by side, by category and over all (category null)."""
    f, a = F.col("family"), F.col("answer")
    governed = F.when(f == "stable_control", a).when(f == "date_boundary", F.concat(F.lit("Which date? "), a)).otherwise(F.concat(a, F.lit(" Can you verify this?")))
    sides = records(spark, sf_dir).select("family", F.explode(F.create_map(F.lit("raw"), a, F.lit("governed"), governed)).alias("side", "t"))
    form = sides.select(F.col("family").alias("category"), "side", *(v.alias(k) for k, v in B.structure(F.col("t"), _FORM).items()))
    flags = [c for c in form.columns[3:]]
    return form.groupingSets([("category", "side"), ("side",)], "category", "side").agg(F.count("*").alias("n"), F.round(St.rate(F.sum("length_chars"), F.count("*")), 1).alias("mean_length_chars"), *(F.round(St.rate(F.count_if(c), F.count("*")), 4).alias(f"{c}_rate") for c in flags))


_NAMES = ("src0", "src1", "src2", "en", "de", "es")


@query(f"""WITH v AS (SELECT unnest({vocab.sql_list(_NAMES)}) AS name), x AS (SELECT doc_id, 'primary' AS field, source AS name FROM documents UNION ALL SELECT doc_id, 'exclude', unnest([lang, CASE WHEN n_chars > 4000 THEN 'long' ELSE source END]) FROM documents)
SELECT field, name, count(*) AS n, min(doc_id) AS first_id FROM x ANTI JOIN v USING (name) WHERE name IS NOT NULL GROUP BY ALL""")
def n13_namespace_violations(spark, sf_dir):
    """Names outside the namespace, in the primary place or among the excluded, with their number and first row."""
    valid = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    excluded = F.array("lang", F.when(F.col("n_chars") > 4000, "long").otherwise(F.col("source")))
    said = F.concat(F.array(F.struct(F.lit("primary").alias("field"), F.col("source").alias("name"))), F.transform(excluded, lambda x: F.struct(F.lit("exclude").alias("field"), x.alias("name"))))
    x = table(spark, sf_dir, "documents").select("doc_id", F.inline(said)).filter("name is not null")
    return x.join(F.broadcast(valid), "name", "left_anti").groupBy("field", "name").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
