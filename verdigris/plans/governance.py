"""Incidents, triage, behaviours, sessions, stores and their digests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris import vocab
from verdigris.functions import scoring as S
from verdigris.functions import text as T
from verdigris.operators import folds, stores
from verdigris.operators import statistics as St
from verdigris.plans.base import registrar, table
from verdigris.plans.evals import _R, records
from verdigris.plans.scores import _CLASSIFIED, _ROUTED, _SCORED, results, routed, scored
from verdigris.plans.states import _PHI, steps
from verdigris.plans.texts import _PAIRS, _has, pairs
from verdigris.session import scratch
from verdigris.sources import files

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)


@query("""WITH d AS (SELECT doc_id, regexp_split_to_array(lower(text), '\\s+') AS w FROM documents), b AS (SELECT item_id, regexp_split_to_array(lower(text), '\\s+') AS w FROM benchmark),
x AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8)), y AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS k FROM b WHERE len(w) >= 8)),
h AS (SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g) UNION SELECT doc_id, item_id FROM d JOIN b ON len(b.w) < 8 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' '))
SELECT doc_id, CAST(count(*) AS BIGINT) AS hits, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM h GROUP BY 1""")
def c44_contamination(spark, sf_dir):
    """Items of which eight words in a row, or the whole of a shorter one, stand in a document."""
    hits = T.window_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), 8)
    return hits.groupBy("doc_id").agg(F.count("*").alias("hits"), F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("items"))


_DIGITS = "lower(text)"
for _k, _w in enumerate(vocab.NUMBER_WORDS, 1):
    _DIGITS = f"regexp_replace({_DIGITS}, '(^|[^\\p{{L}}\\p{{N}}_]){_w}($|[^\\p{{L}}\\p{{N}}_])', '\\1{_k}\\2', 'g')"


@query(f"WITH t AS (SELECT item_id, 'Two of ' || text || ' are twelve, not one' AS text FROM benchmark) SELECT item_id, substr(sha256({_DIGITS}), 1, 12) AS digest FROM t")
def c20_numbers_as_digits(spark, sf_dir):
    t = F.concat(F.lit("Two of "), "text", F.lit(" are twelve, not one"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.fingerprint(T.numbers_as_digits(t), 12).alias("digest"))


@query(f"""{_PHI}, r AS (SELECT b.*, e.event_type, e.value, CASE WHEN e.event_type = 'view' THEN 'answer' WHEN b.band = 'ask_abstain' THEN 'ask' ELSE 'verify' END AS route, CASE WHEN e.event_type = 'click' THEN 'verify' WHEN e.event_type = 'view' THEN 'answer' WHEN b.band = 'ask_abstain' THEN 'ask' ELSE 'verify' END AS expected, lag(phi) OVER (PARTITION BY b.session_id ORDER BY b.seq) AS prev FROM b JOIN events e ON e.event_id = b.seq),
x AS (SELECT session_id, seq, concat_ws(',', CASE WHEN expected <> route THEN 'route' END, CASE WHEN event_type = 'error' AND value > 120 THEN 'clamp' END, CASE WHEN event_type = 'error' AND value < 20 THEN 'exception' END, CASE WHEN phi > 0.9 AND route IN ('ask', 'abstain') THEN 'phi' END, CASE WHEN phi > 0.9 AND prev > 0.9 THEN 'sustained' END) AS reasons FROM r) SELECT * FROM x WHERE reasons <> ''""")
def d30_incidents(spark, sf_dir):
    """Turns with any of the five reasons for an incident record."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type", "value")
    p = folds.controller_long(steps(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("phi", F.round("phi", 9)).join(e, "seq")
    route = S.first_match([(F.col("event_type") == "view", "answer"), (F.col("band") == "ask_abstain", "ask")], "verify")
    expected = F.when(F.col("event_type") == "click", "verify").otherwise(route)
    err = F.col("event_type") == "error"
    prev = F.lag("phi").over(Window.partitionBy("session_id").orderBy("seq"))
    found = p.withColumn("prev", prev).withColumn("reasons", S.incident_reasons(expected, route, err & (F.col("value") > 120), err & (F.col("value") < 20), F.col("phi"), F.col("prev")))
    return found.filter("size(reasons) > 0").select("session_id", "seq", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_CLASSIFIED}, s AS (SELECT conv_id, turn, prompt, allowed[1] AS expected, classified, family, CASE WHEN turn % 6 = 5 THEN NULL ELSE (length(answer) % 100) / CAST(100 AS DOUBLE) END AS score FROM results)
SELECT conv_id, turn, CASE WHEN expected = 'ask' AND classified = 'answer' THEN 'A-hard' WHEN family = 'query_neutrality' OR {_has(('this', 'that'), 'substr(prompt, 1, 12)')} THEN 'A-context' WHEN {_has(('by', 'or'), 'prompt')} THEN 'A-judge' WHEN score IS NULL THEN 'A-route' WHEN score >= 0.85 THEN 'A-retrieval' ELSE 'A-route' END AS bucket FROM s WHERE expected <> classified""")
def d45_divergence_bucket(spark, sf_dir):
    """Why a route diverged: hard, context, judge, retrieval or route, by the first test that holds."""
    r = results(spark, sf_dir).withColumns({"expected": F.get("allowed", 0), "score": F.when(F.col("turn") % 6 != 5, F.length("answer") % 100 / 100.0)}).filter("expected != classified")
    referential = (F.col("family") == "query_neutrality") | vocab.has(F.substring("prompt", 1, 12), ("this", "that"))
    hard = (F.col("expected") == "ask") & (F.col("classified") == "answer")
    return r.select("conv_id", "turn", S.divergence_bucket(hard, referential, vocab.has(F.col("prompt"), ("by", "or")), F.col("score")).alias("bucket"))


_HEDGES = ("or ", "may ", "by ")
_HC = "(" + " + ".join(f"CAST(contains(lower(answer), '{h}') AS INTEGER)" for h in _HEDGES) + ")"
_KWS = "list_filter(list_transform(regexp_split_to_array(lower({0}), '[, \\n\\t]+'), lambda w: trim(w)), lambda w: length(w) > 2)"
_RATIO = f"(CASE WHEN len({_KWS}) = 0 THEN FALSE ELSE len(list_filter({_KWS}, lambda w: contains(lower(answer), w))) / CAST(len({_KWS}) AS DOUBLE) > 0.3 END)"


@query(f"""WITH {_PAIRS}, x AS (SELECT conv_id, turn, answer, length(answer) AS n, (conv_id + turn) % 6 AS kind, {_HC} AS hedges, {_RATIO.format('prompt')} AS right_, {_RATIO.format('reverse(prompt)')} AS wrong, contains(answer, '?') AND contains(lower(answer), 'at th') AS asks FROM p)
SELECT conv_id, turn, CASE kind WHEN 0 THEN CASE WHEN right_ AND hedges > 0 THEN 'CORRECT_HEDGE' WHEN right_ THEN 'CORRECT_ASSERT' WHEN wrong AND hedges = 0 THEN 'INCORRECT_ASSERT' WHEN wrong THEN 'INCORRECT_HEDGE' WHEN hedges > 0 THEN 'CORRECT_HEDGE' ELSE 'INCORRECT_ASSERT' END WHEN 1 THEN CASE WHEN right_ AND n < 200 THEN 'CORRECT_ASSERT' WHEN right_ THEN 'CORRECT_VERBOSE' ELSE 'INCORRECT_ASSERT' END WHEN 2 THEN CASE WHEN hedges > 0 THEN 'CORRECT_HEDGE' ELSE 'INCORRECT_ASSERT' END
WHEN 3 THEN CASE WHEN NOT right_ THEN 'INCORRECT' WHEN hedges >= 2 THEN 'OVER_HEDGED' WHEN n > 500 THEN 'CORRECT_VERBOSE' ELSE 'CORRECT_DIRECT' END WHEN 4 THEN CASE WHEN asks THEN 'ASKED_UNNECESSARILY' WHEN NOT right_ THEN 'INCORRECT' WHEN hedges >= 2 THEN 'OVER_HEDGED' WHEN n > 500 THEN 'CORRECT_VERBOSE' ELSE 'CORRECT_DIRECT' END ELSE CASE WHEN length(trim(answer, ' ')) < 3 THEN 'ABSTAINED_UNNECESSARILY' WHEN n > 500 THEN 'CORRECT_VERBOSE' ELSE 'CORRECT_DIRECT' END END AS behaviour FROM x""")
def d46_behaviour(spark, sf_dir):
    """Behaviour by the rules of six subtypes; the prompt stands for the right answer, its reverse for the common error."""
    kinds = ("near_miss", "scope_creep", "false_confidence", "easy_factual", "clear_instruction", "casual")
    kind = S.first_match([((F.col("conv_id") + F.col("turn")) % 6 == k, name) for k, name in enumerate(kinds)], "casual")
    return pairs(spark, sf_dir).select("conv_id", "turn", S.behaviour(kind, F.col("answer"), F.col("prompt"), F.reverse("prompt"), _HEDGES, ("at th",)).alias("behaviour"))


_SPECS = (("route", "answer"), ("route_in", "answer|ask"), ("route_not", "abstain"), ("intent", "law"), ("intent_in", "law|finance"), ("contains_any", "tion|xyz"), ("contains_all", "the|an"), ("contains_none", "then"), ("length_min", "60"), ("length_max", "160"), ("language", "en"), ("codes_include", "DEFAULT"), ("codes_exclude", "SAFETY"), ("sources_min", "2"), ("tvs_min", "0.2"), ("tvs_max", "0.6"), ("self_reference", "false"), ("box_consulted", "true"), ("no_error", ""))
_SPEC_SQL = ", ".join(f"({k}, '{a}', '{v}')" for k, (a, v) in enumerate(_SPECS))


@query(f"""WITH {_ROUTED}, sp AS (SELECT * FROM (VALUES {_SPEC_SQL}) AS t(k, kind, value)), tn AS (SELECT *, turn % 4 AS sources, turn % 5 = 0 AS boxed, contains(text, 'whwh') AS failed, CASE WHEN regexp_matches(text, '[\\x{{4E00}}-\\x{{9FFF}}]') THEN 'zh' ELSE 'en' END AS lang FROM routed),
c AS (SELECT conv_id, turn, kind, CASE kind WHEN 'route' THEN route = value WHEN 'route_in' THEN list_contains(string_split(value, '|'), route) WHEN 'route_not' THEN NOT list_contains(string_split(value, '|'), route) WHEN 'intent' THEN domain = value WHEN 'intent_in' THEN list_contains(string_split(value, '|'), domain) WHEN 'contains_any' THEN len(list_filter(string_split(value, '|'), lambda v: contains(text, v))) > 0 WHEN 'contains_all' THEN len(list_filter(string_split(value, '|'), lambda v: NOT contains(text, v))) = 0
WHEN 'contains_none' THEN len(list_filter(string_split(value, '|'), lambda v: contains(text, v))) = 0 WHEN 'length_min' THEN length(text) >= TRY_CAST(value AS INTEGER) WHEN 'length_max' THEN length(text) <= TRY_CAST(value AS INTEGER) WHEN 'language' THEN lang = value WHEN 'codes_include' THEN reason = value WHEN 'codes_exclude' THEN reason <> value WHEN 'sources_min' THEN sources >= TRY_CAST(value AS INTEGER) WHEN 'tvs_min' THEN tvs >= TRY_CAST(value AS DOUBLE) WHEN 'tvs_max' THEN tvs <= TRY_CAST(value AS DOUBLE)
WHEN 'self_reference' THEN (reason = 'SELF_REFERENTIAL') = (value = 'true') WHEN 'box_consulted' THEN boxed = (value = 'true') ELSE NOT failed END AS holds FROM tn, sp) SELECT conv_id, turn, kind FROM c WHERE NOT holds""")
def d48_scenario_assertions(spark, sf_dir):
    """The failed assertions of each turn, nineteen kinds; the table of assertions is small."""
    specs = spark.createDataFrame([(a, v) for a, v in _SPECS], "kind string, value string")
    t = routed(spark, sf_dir).withColumns({"sources": F.col("turn") % 4, "boxed": F.col("turn") % 5 == 0, "failed": F.contains("text", F.lit("whwh")), "language": T.reply_language(F.col("text"))})
    return t.join(F.broadcast(specs), ~S.assertion_holds(F.col("kind"), F.col("value"))).select("conv_id", "turn", "kind")


_SIG = {"A": ("erth", "whhe"), "C": ("tion",), "B": ("and",)}


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'erth') OR contains(lower(text), 'whhe') THEN 'A' WHEN contains(lower(text), 'tion') THEN 'C' WHEN contains(lower(text), 'and') THEN 'B' ELSE 'Unknown' END AS triage FROM conversations""")
def d49_failure_triage(spark, sf_dir):
    """The category of the first signature found, A before C before B."""
    t = F.lower("text")
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, F.lower(w)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.first_match([(some(words), name) for name, words in _SIG.items()], "Unknown").alias("triage"))


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 9 = 1 THEN '  ' ELSE text END AS query, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE lang END AS language, CASE WHEN doc_id % 17 = 0 THEN '' ELSE source END AS intent_type FROM documents)
SELECT doc_id, CASE WHEN coalesce(query, '') = '' THEN 'missing field: query' WHEN coalesce(language, '') = '' THEN 'missing field: language' WHEN coalesce(intent_type, '') = '' THEN 'missing field: intent_type' WHEN trim(query) = '' THEN 'query empty' WHEN language NOT IN ('ja', 'en', 'zh') THEN 'unsupported language: ' || language END AS error FROM c""")
def d52_chunk_validity(spark, sf_dir):
    """The first failing rule of a corpus chunk: required fields in order, a query with text, a supported language."""
    k = F.col("doc_id")
    c = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 9 == 0, "").when(k % 9 == 1, "  ").otherwise(F.col("text")).alias("query"), F.when(k % 13 != 0, F.col("lang")).alias("language"), F.when(k % 17 == 0, "").otherwise(F.col("source")).alias("intent_type"))
    return c.select("doc_id", S.chunk_error(("query", "language", "intent_type"), ("ja", "en", "zh")).alias("error"))


_EFF = f"{_R}, j AS (SELECT family AS kernel, turn % 2 AS dimension, CASE WHEN errored THEN NULL ELSE correct END AS improved, CASE WHEN turn % 5 = 0 THEN 0 ELSE (turn % 10) / CAST(10 AS DOUBLE) END AS confidence, length(answer) % 3 AS lang FROM rec)"


@query(f"""WITH {_EFF}, q AS (SELECT kernel, count(improved) AS n_valid, count(*) AS n_all, count(*) FILTER (improved) AS hits, sum(CASE WHEN improved THEN CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END ELSE 0 END) AS w FROM j GROUP BY 1)
SELECT kernel, CAST(n_valid AS BIGINT) AS n_valid, CASE WHEN n_valid = 0 THEN 0.0 ELSE round(hits / CAST(n_valid AS DOUBLE), 4) END AS hit_rate, CASE WHEN n_valid = 0 THEN 0.0 ELSE round(w / CAST(n_valid AS DOUBLE), 4) END AS weighted, round((n_all - n_valid) / CAST(n_all AS DOUBLE), 4) AS null_rate, CASE WHEN n_valid > 0 AND hits / CAST(n_valid AS DOUBLE) >= 0.65 THEN 'always' WHEN n_valid > 0 AND hits / CAST(n_valid AS DOUBLE) >= 0.40 THEN 'context' ELSE 'suppress' END AS tier FROM q""")
def h11_kernel_effectiveness(spark, sf_dir):
    j = judged_kernels(spark, sf_dir)
    hits, n = F.count_if("improved"), F.count("improved")
    q = j.groupBy("kernel").agg(n.alias("n_valid"), F.count("*").alias("n_all"), hits.alias("hits"), F.sum(F.when(F.col("improved"), F.when(F.col("confidence") == 0, 0.5).otherwise(F.col("confidence"))).otherwise(0.0)).alias("w"))
    rate = F.coalesce(St.rate(F.col("hits"), F.col("n_valid")), F.lit(0.0))
    return q.select("kernel", "n_valid", F.round(rate, 4).alias("hit_rate"), F.round(F.coalesce(St.rate(F.col("w"), F.col("n_valid")), F.lit(0.0)), 4).alias("weighted"), F.round((F.col("n_all") - F.col("n_valid")) / F.col("n_all"), 4).alias("null_rate"), S.first_match([(rate >= 0.65, "always"), (rate >= 0.40, "context")], "suppress").alias("tier"))


def judged_kernels(spark, sf_dir) -> DataFrame:
    confidence = F.when(F.col("turn") % 5 == 0, 0.0).otherwise(F.col("turn") % 10 / 10.0)
    return records(spark, sf_dir).select(F.col("family").alias("kernel"), (F.col("turn") % 2).alias("dimension"), F.when(~F.col("errored"), F.col("correct")).alias("improved"), confidence.alias("confidence"), (F.length("answer") % 3).alias("lang"))


@query(f"""WITH {_EFF}, q AS (SELECT dimension, kernel, count(*) FILTER (improved) / CAST(nullif(count(improved), 0) AS DOUBLE) AS rate FROM j GROUP BY ALL), l AS (SELECT dimension, lang, count(*) FILTER (improved) / CAST(nullif(count(improved), 0) AS DOUBLE) AS rate FROM j GROUP BY ALL), r AS (SELECT dimension, string_agg(CAST(lang AS VARCHAR) || '=' || CAST(CAST(round(coalesce(rate, 0) * 10000) AS BIGINT) AS VARCHAR), ' ' ORDER BY lang) AS by_language FROM l GROUP BY 1)
SELECT q.dimension, round(avg(coalesce(rate, 0)), 4) AS mean_rate, (SELECT kernel FROM q b WHERE b.dimension = q.dimension ORDER BY coalesce(rate, 0) DESC, kernel LIMIT 1) AS best, (SELECT kernel FROM q b WHERE b.dimension = q.dimension ORDER BY coalesce(rate, 0), kernel LIMIT 1) AS worst, max(coalesce(rate, 0)) < 0.65 AS gap, any_value(by_language) AS by_language FROM q JOIN r ON r.dimension = q.dimension GROUP BY q.dimension""")
def h11_dimensions(spark, sf_dir):
    """Per dimension: mean rate, best and worst kernel, whether none is always on, and rates by language in ten thousandths."""
    j = judged_kernels(spark, sf_dir)
    rate = F.coalesce(St.rate(F.count_if("improved"), F.count("improved")), F.lit(0.0))
    q = j.groupBy("dimension", "kernel").agg(rate.alias("rate"))
    per = q.groupBy("dimension").agg(F.round(F.avg("rate"), 4).alias("mean_rate"), F.min(F.struct(-F.col("rate"), "kernel")).alias("b"), F.min(F.struct("rate", "kernel")).alias("w"), (F.max("rate") < 0.65).alias("gap"))
    langs = j.groupBy("dimension", "lang").agg(rate.alias("rate")).groupBy("dimension").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", F.round(F.col("rate") * 10000).cast("long").alias("r")))), lambda x: F.concat_ws("=", x["lang"], x["r"])), " ").alias("by_language"))
    return per.join(langs, "dimension").select("dimension", "mean_rate", F.col("b.kernel").alias("best"), F.col("w.kernel").alias("worst"), "gap", "by_language")


_LIB = "h AS (SELECT user_id AS pattern, count(*) FILTER (event_type = 'click') AS hits, min(ts) AS created, max(ts) AS last FROM events GROUP BY 1), lib AS (SELECT *, pattern % 4 AS topic, CASE pattern % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'review' ELSE 'deprecated' END AS status, CASE pattern % 5 WHEN 0 THEN 'autogen' ELSE 'manual' END AS origin, (pattern % 10) / CAST(10 AS DOUBLE) AS pass_rate, date_diff('day', CAST(created AS DATE), DATE '2024-04-15') AS age FROM h)"


def library(spark, sf_dir) -> DataFrame:
    """Patterns (users) with hits, state, origin, pass rate and age."""
    h = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("pattern")).agg(F.count_if(F.col("event_type") == "click").alias("hits"), F.min("ts").alias("created"), F.max("ts").alias("last"))
    k = F.col("pattern")
    return h.withColumns({"topic": k % 4, "status": S.first_match([(k % 3 == 0, "active"), (k % 3 == 1, "review")], "deprecated"), "origin": F.when(k % 5 == 0, "autogen").otherwise("manual"), "pass_rate": k % 10 / 10.0, "age": F.datediff(F.lit("2024-04-15").cast("date"), F.to_date("created"))})


@query(f"""WITH {_LIB}, n AS (SELECT 'topic' AS section, CAST(topic AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM lib GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM lib GROUP BY 2 UNION ALL SELECT 'origin', origin, count(*) FROM lib GROUP BY 2
UNION ALL SELECT 'hits', 'p50', quantile_cont(hits, 0.5) FROM lib UNION ALL SELECT 'hits', 'p75', quantile_cont(hits, 0.75) FROM lib UNION ALL SELECT 'hits', 'p95', quantile_cont(hits, 0.95) FROM lib UNION ALL SELECT 'hits', 'max', max(hits) FROM lib UNION ALL SELECT 'hits', 'total', sum(hits) FROM lib
UNION ALL SELECT 'candidate', CAST(pattern AS VARCHAR), age FROM lib WHERE hits = 0 AND age > 60 AND status = 'active' UNION ALL SELECT 'floor', CAST(pattern AS VARCHAR), pass_rate FROM lib WHERE pass_rate < 0.2) SELECT section, key, CAST(value AS DOUBLE) AS value FROM n""")
def h17_library_audit(spark, sf_dir):
    """Counts by topic, state and origin, hit percentiles, candidates to retire, and rates below the floor."""
    lib = library(spark, sf_dir)
    long = lambda rows, section, key, value: rows.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    counts = [long(lib.groupBy(c).agg(F.count("*").alias("n")), c, F.col(c), F.col("n")) for c in ("topic", "status", "origin")]
    marks = {"p50": F.percentile("hits", 0.5), "p75": F.percentile("hits", 0.75), "p95": F.percentile("hits", 0.95), "max": F.max("hits"), "total": F.sum("hits")}
    spread = lib.agg(*(c.cast("double").alias(k) for k, c in marks.items())).unpivot([], list(marks), "key", "value").select(F.lit("hits").alias("section"), "key", "value")
    named = [long(lib.filter("hits = 0 and age > 60 and status = 'active'"), "candidate", F.col("pattern"), F.col("age")), long(lib.filter("pass_rate < 0.2"), "floor", F.col("pattern"), F.col("pass_rate"))]
    out = spread
    for part in (*counts, *named):
        out = out.unionByName(part)
    return out


@query(f"""WITH {_LIB}, t AS (SELECT 'topic' AS section, CAST(topic AS VARCHAR) AS key, count(*) AS n FROM lib GROUP BY 2 UNION ALL SELECT 'state', status, count(*) FROM lib GROUP BY 2 UNION ALL SELECT 'sub_topic', CAST(pattern % 7 AS VARCHAR), count(*) FROM lib GROUP BY 2 UNION ALL SELECT 'listing', 'topic ' || CAST(topic AS VARCHAR) || ': ' || CAST(pattern AS VARCHAR), hits FROM lib) SELECT section, key, CAST(n AS BIGINT) AS n FROM t""")
def h22_library_stats(spark, sf_dir):
    lib = library(spark, sf_dir).withColumn("sub_topic", F.col("pattern") % 7)
    parts = [lib.groupBy(F.lit(s).alias("section"), F.col(c).cast("string").alias("key")).agg(F.count("*").alias("n")) for s, c in (("topic", "topic"), ("state", "status"), ("sub_topic", "sub_topic"))]
    listing = lib.select(F.lit("listing").alias("section"), F.concat(F.lit("topic "), F.col("topic").cast("string"), F.lit(": "), F.col("pattern").cast("string")).alias("key"), F.col("hits").alias("n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(listing)


@query("""WITH d AS (SELECT source AS domain, lang AS family, CASE WHEN n_chars < 200 THEN 'fresh' WHEN n_chars < 2000 THEN 'aging' ELSE 'stale' END AS staleness FROM documents), x AS (SELECT DISTINCT domain FROM d), y AS (SELECT unnest(['fresh', 'aging', 'stale', 'unknown']) AS staleness)
SELECT x.domain, y.staleness, CAST(count(d.family) AS BIGINT) AS n, CAST(count(DISTINCT d.family) AS BIGINT) AS families FROM x CROSS JOIN y LEFT JOIN d ON d.domain = x.domain AND d.staleness = y.staleness GROUP BY ALL""")
def h24_store_stats(spark, sf_dir):
    """By domain and state of staleness, states without entries as zero; domains are few."""
    n = F.col("n_chars")
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("domain"), F.col("lang").alias("family"), S.first_match([(n < 200, "fresh"), (n < 2000, "aging")], "stale").alias("staleness"))
    counted = d.groupBy("domain", "staleness").agg(F.count("*").alias("n"), F.countDistinct("family").alias("families"))
    cells = counted.select("domain").distinct().select("domain", F.explode(F.array(*map(F.lit, ("fresh", "aging", "stale", "unknown")))).alias("staleness"))
    return cells.join(counted, ["domain", "staleness"], "left").select("domain", "staleness", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("families", F.lit(0)).cast("long").alias("families"))


_KIND = f"CASE WHEN {_has(('was',))} THEN 'preference' WHEN {_has(('with',))} THEN 'correction' WHEN {_has(('for',))} THEN 'task' ELSE 'topic' END"


@query(f"""WITH {_SCORED}, k AS (SELECT {_KIND} AS kind, tvs, turn FROM r), z AS (SELECT kind, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(0.40 AS DOUBLE) + CASE WHEN kind = 'correction' THEN 0.20 ELSE 0 END::DOUBLE + CASE WHEN kind = 'preference' THEN 0.15 ELSE 0 END::DOUBLE + least(CAST(0.10 AS DOUBLE), turn * CAST(0.02 AS DOUBLE)) - CASE WHEN tvs > 0.7 THEN 0.15 ELSE 0 END::DOUBLE)) AS salience FROM k)
SELECT kind, CAST(count(*) AS BIGINT) AS n, round(avg(salience), 6) AS mean_salience FROM z GROUP BY 1""")
def h25_capsule_stats(spark, sf_dir):
    t = F.col("text")
    kind = S.first_match([(vocab.has(t, ("was",)), "preference"), (vocab.has(t, ("with",)), "correction"), (vocab.has(t, ("for",)), "task")], "topic")
    r = scored(spark, sf_dir).withColumn("kind", kind)
    z = r.select("kind", S.salience(F.col("kind"), F.col("turn"), F.col("kind") == "correction", F.col("tvs")).alias("salience"))
    return z.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("salience"), 6).alias("mean_salience"))


@query(f"""WITH {_ROUTED}, c AS (SELECT conv_id, turn, route, mkr < 0.4 AS clamped, turn % 7 = 0 AS oracle, reason FROM routed), n AS (SELECT conv_id, reason, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT conv_id, string_agg(reason, ',' ORDER BY r) AS codes FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, reason) AS r FROM n) WHERE r <= 5 GROUP BY 1)
SELECT c.conv_id, CAST(count(*) AS BIGINT) AS turns, CAST(count(*) FILTER (clamped) AS BIGINT) AS clamps, CAST(count(*) FILTER (route = 'verify') AS BIGINT) AS verifies, CAST(count(*) FILTER (route = 'ask') AS BIGINT) AS asks, CAST(count(*) FILTER (oracle) AS BIGINT) AS oracles, any_value(t.codes) AS codes FROM c JOIN t ON t.conv_id = c.conv_id GROUP BY c.conv_id""")
def h26_session_summary(spark, sf_dir):
    """Counts of a session's turns, and its five most frequent reason codes."""
    r = routed(spark, sf_dir)
    by_code = r.groupBy("conv_id", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("mkr") < 0.4).alias("clamps"), F.count_if(F.col("route") == "verify").alias("verifies"), F.count_if(F.col("route") == "ask").alias("asks"), F.count_if(F.col("turn") % 7 == 0).alias("oracles"))
    codes = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "reason"))), 1, 5), lambda x: x["reason"]), ",")
    return by_code.groupBy("conv_id").agg(F.sum("n").alias("turns"), *(F.sum(k).alias(k) for k in ("clamps", "verifies", "asks", "oracles")), codes.alias("codes"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, round(avg(n), 6) AS mean, round(coalesce(stddev_samp(n), 0), 6) AS sd, CAST(min(n) AS BIGINT) AS low, CAST(max(n) AS BIGINT) AS high, CAST(max(n) - min(n) AS BIGINT) AS span, round(coalesce(stddev_samp(n), 0) / avg(n) * 100, 4) AS variance_pct, coalesce(stddev_samp(n), 0) / avg(n) * 100 < 6.5 AS stable FROM d GROUP BY 1""")
def h31_run_stability(spark, sf_dir):
    """Mean, deviation and range of the runs (days), and whether they vary by less than 6.5 per cent."""
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    sd = F.coalesce(F.stddev_samp("n"), F.lit(0.0))
    return d.groupBy("event_type").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(sd, 6).alias("sd"), F.min("n").alias("low"), F.max("n").alias("high"), (F.max("n") - F.min("n")).alias("span"), F.round(sd / F.avg("n") * 100, 4).alias("variance_pct"), (sd / F.avg("n") * 100 < 6.5).alias("stable"))


@query("""SELECT query_id, kernel, min(src) AS src, arg_min(value, src * 1000000000 + pos) AS value FROM (SELECT 0 AS src, doc_id % 500 AS query_id, doc_id % 3 AS kernel, doc_id AS pos, n_chars AS value FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 1, doc_id % 500, doc_id % 3, doc_id, n_chars FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 2, doc_id % 500, doc_id % 3, doc_id, n_chars FROM documents WHERE doc_id % 5 = 0) GROUP BY ALL""")
def j15_first_file_wins(spark, sf_dir):
    """Three workers' files merged: of each (query, kernel) the first row of the first file stays."""
    d = table(spark, sf_dir, "documents")
    parts = [d.filter(F.col("doc_id") % m == 0).select(F.lit(k).alias("src"), (F.col("doc_id") % 500).alias("query_id"), (F.col("doc_id") % 3).alias("kernel"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("value")) for k, m in enumerate((2, 3, 5))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("query_id", "kernel").agg(F.min("src").alias("src"), F.min_by("value", F.struct("src", "pos")).alias("value"))


@query("""WITH h AS (SELECT doc_id % 40 AS query_id, lang AS title, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS rank FROM documents), q AS (SELECT DISTINCT query_id, CASE query_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'it' ELSE 'nn' END AS expected FROM h), m AS (SELECT q.query_id, q.expected, min(rank) FILTER (rank <= 5 AND contains(h.title, q.expected)) AS place FROM q LEFT JOIN h ON h.query_id = q.query_id GROUP BY ALL)
SELECT query_id, CASE WHEN place = 1 THEN 'other' WHEN place IS NOT NULL THEN 'ranked_too_low' WHEN expected IN ('de', 'it') THEN 'present_unindexed' ELSE 'missing' END AS diagnosis, CAST(place AS INTEGER) AS place FROM m""")
def k6_hard_cases(spark, sf_dir):
    """From the rank of the expected title in the top five, and whether the curated corpus has it."""
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    k = F.col("query_id") % 4
    h = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("query_id"), "doc_id", F.col("lang").alias("title")).withColumn("rank", first).filter("rank <= 5")
    expected = S.first_match([(k == 0, "de"), (k == 1, "en"), (k == 2, "it")], "nn")
    m = h.withColumn("expected", expected).groupBy("query_id", "expected").agg(F.min(F.when(F.contains("title", "expected"), F.col("rank"))).alias("place"))
    return m.select("query_id", S.first_match([(F.col("place") == 1, "other"), (F.col("place").isNotNull(), "ranked_too_low"), (F.col("expected").isin("de", "it"), "present_unindexed")], "missing").alias("diagnosis"), "place")


@query("""WITH f AS (SELECT user_id AS session, 'c' || CAST(event_id % 9 AS VARCHAR) || ' about ' || event_type AS claim, (event_id % 10) / CAST(20 AS DOUBLE) AS tvs, event_id, value FROM events), kept AS (SELECT session, claim, arg_max(value, event_id) AS value, CAST(count(*) AS BIGINT) AS times FROM f WHERE tvs < 0.3 GROUP BY ALL), w AS (SELECT session, claim, value, times, unnest(list_filter(string_split(claim, ' '), lambda x: length(x) > 3)) AS word FROM kept), q AS (SELECT DISTINCT user_id AS session, 'the ' || event_type || ' of it' AS query FROM events WHERE event_id % 50 = 0)
SELECT DISTINCT q.session, q.query, w.claim, w.value, w.times FROM q JOIN w ON w.session = q.session AND contains(lower(q.query), lower(w.word))""")
def e28_verified_facts(spark, sf_dir):
    """Facts of low volatility, the last of a claim kept; a query finds those of which a longer word stands in it."""
    e = table(spark, sf_dir, "events")
    claim = F.concat(F.lit("c"), (F.col("event_id") % 9).cast("string"), F.lit(" about "), "event_type")
    facts = stores.verified(e.select(F.col("user_id").alias("session"), claim.alias("claim"), (F.col("event_id") % 10 / 20.0).alias("tvs"), F.col("event_id").alias("seq"), "value"))
    asked = e.filter("event_id % 50 = 0").select(F.col("user_id").alias("session"), F.concat(F.lit("the "), "event_type", F.lit(" of it")).alias("query")).distinct()
    return asked.join(facts, "session").filter(stores.names_fact(F.col("query"), F.col("claim"))).select("session", "query", "claim", "value", "times")


@query("""WITH c AS (SELECT user_id AS session, event_id AS turn, CASE event_type WHEN 'click' THEN 'summary' WHEN 'view' THEN 'facts' WHEN 'error' THEN 'constraints' ELSE 'other' END AS field, CAST(floor(value) AS BIGINT) AS new_value FROM events)
SELECT session, turn, field, CASE WHEN field = 'summary' THEN lag(new_value) OVER (PARTITION BY session, field ORDER BY turn) END AS old_value, new_value FROM c WHERE field <> 'other'""")
def f11_correction_log(spark, sf_dir):
    """Corrections in order: a summary is overwritten and its old value noted, lists are appended to, other fields refused."""
    field = S.first_match([(F.col("event_type") == "click", "summary"), (F.col("event_type") == "view", "facts"), (F.col("event_type") == "error", "constraints")], "other")
    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("turn"), field.alias("field"), F.floor("value").alias("new_value"))
    return stores.correction_log(c)


@query(f"""WITH {_PAIRS}, x AS (SELECT conv_id, {_has(('not', 'or'), 'answer')} AS corrected, {_has(('and', 'with'), 'answer')} AS adopted, turn FROM p) SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, CAST(count(*) FILTER (adopted AND NOT corrected) AS BIGINT) AS adopted, CAST(count(*) FILTER (corrected) AS BIGINT) AS corrected, coalesce(count(*) FILTER (corrected) / CAST(nullif(count(*) FILTER (adopted AND NOT corrected) + count(*) FILTER (corrected), 0) AS DOUBLE), 0.0) AS over_leading FROM x GROUP BY 1""")
def f4_trajectory(spark, sf_dir):
    """Half-steps adopted and corrected, and the share that was corrected: the rate of over-leading."""
    a = F.col("answer")
    x = pairs(spark, sf_dir).select("conv_id", vocab.has(a, ("not", "or")).alias("corrected"), vocab.has(a, ("and", "with")).alias("adopted"))
    good, bad = F.count_if(F.col("adopted") & ~F.col("corrected")), F.count_if("corrected")
    return x.groupBy("conv_id").agg(F.count("*").alias("turns"), good.alias("adopted"), bad.alias("corrected"), F.coalesce(St.rate(bad, good + bad), F.lit(0.0)).alias("over_leading"))


@query(f"""WITH {_ROUTED} SELECT conv_id, turn, CAST(count(*) OVER w AS BIGINT) AS turns, CAST(count(*) FILTER (mkr < 0.4) OVER w AS BIGINT) AS clamps, CAST(count(*) FILTER (route = 'verify') OVER w AS BIGINT) AS verifies, CAST(count(*) FILTER (route = 'ask') OVER w AS BIGINT) AS asks, lag(tvs) OVER (PARTITION BY conv_id ORDER BY turn) AS phi_before, tvs AS phi, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS number FROM routed WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def f5_f12_sampler_state(spark, sf_dir):
    """The sampler's state after each turn, and the turn's number in the route history."""
    o = Window.partitionBy("conv_id").orderBy("turn")
    w = o.rowsBetween(Window.unboundedPreceding, 0)
    n = lambda c: F.count_if(c).over(w)
    return routed(spark, sf_dir).select("conv_id", "turn", F.count("*").over(w).alias("turns"), n(F.col("mkr") < 0.4).alias("clamps"), n(F.col("route") == "verify").alias("verifies"), n(F.col("route") == "ask").alias("asks"), F.lag("tvs").over(o).alias("phi_before"), F.col("tvs").alias("phi"), F.row_number().over(o).alias("number"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations), s AS (SELECT conv_id, substr(any_value(text) FILTER (a = 1), 1, 60) AS opening, string_agg(substr(trim(text, ' '), 1, 80), ' | ' ORDER BY turn) FILTER (z <= 20 AND role = 'user' AND trim(text, ' ') <> '') AS topics, count(*) FILTER (z <= 20 AND role = 'user' AND trim(text, ' ') <> '') AS n, count(*) FILTER (role = 'system') AS pre FROM t GROUP BY 1)
SELECT conv_id, opening, coalesce(topics, '') AS topics, greatest(CASE WHEN pre > 0 THEN CAST(0.6 AS DOUBLE) ELSE 0 END, CASE WHEN n > 0 THEN least(CAST(1 AS DOUBLE), CAST(0.2 AS DOUBLE) + CAST(0.05 AS DOUBLE) * n) ELSE 0 END)::DOUBLE AS confidence FROM s""")
def f9_recall_summary(spark, sf_dir):
    """The opening turn's label, the topics of the last twenty turns, and how sure the summary is."""
    c = table(spark, sf_dir, "conversations")
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    pre = c.groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 60).alias("opening"), F.count_if(F.col("role") == "system").alias("pre"))
    recent = c.withColumn("z", last).filter("z <= 20").filter((F.col("role") == "user") & (F.trim("text") != ""))
    topics = recent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.substring(F.trim("text"), 1, 80).alias("t")))).alias("t"))
    n = F.coalesce(F.size("t"), F.lit(0))
    sure = F.greatest(F.when(F.col("pre") > 0, 0.6).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), 0.2 + 0.05 * n)).otherwise(0.0))
    return pre.join(topics, "conv_id", "left").select("conv_id", "opening", F.coalesce(F.array_join(F.transform("t", lambda x: x["t"]), " | "), F.lit("")).alias("topics"), sure.alias("confidence"))


@query(f"""WITH {_R}, t AS (SELECT conv_id, turn, classified, length(answer) AS n, allowed[1] AS want, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z, turn % 3 = 1 AS refers, turn % 4 = 3 AS changes FROM rec), c AS (SELECT *, CASE WHEN want = classified THEN 'match' WHEN want IN ('ask', 'verify') AND classified = 'answer' THEN 'A' WHEN want = 'answer' AND classified = 'ask' THEN 'B' WHEN (want = 'answer' AND classified = 'verify') OR (want = 'verify' AND classified = 'ask') THEN 'C' ELSE 'other' END AS cat FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, count(*) FILTER (cat = 'A') / CAST(count(*) AS DOUBLE) AS a_rate, CASE WHEN count(*) FILTER (cat = 'A') / CAST(count(*) AS DOUBLE) < 0.05 THEN 'PASS' WHEN count(*) FILTER (cat = 'A') / CAST(count(*) AS DOUBLE) < 0.10 THEN 'INFO_PASS' ELSE 'WARNING' END AS verdict, count(*) FILTER (refers AND NOT (classified = 'ask' AND want <> 'ask')) / CAST(nullif(count(*) FILTER (refers), 0) AS DOUBLE) AS resolved, count(*) FILTER (changes AND classified IN ('answer', 'verify', 'ask', 'abstain')) / CAST(nullif(count(*) FILTER (changes), 0) AS DOUBLE) AS handled, bool_or(z = 1 AND classified IN ('answer', 'verify') AND n >= 5) AS natural FROM c GROUP BY 1""")
def n12_dialogue_metrics(spark, sf_dir):
    """Per dialogue: class A rate and verdict, referents resolved, intent changes handled, whether it ends naturally."""
    want, got = F.get("allowed", 0), F.col("classified")
    refers, changes = F.col("turn") % 3 == 1, F.col("turn") % 4 == 3
    a = want.isin("ask", "verify") & (got == "answer") & (want != got)
    last = F.max_by(got.isin("answer", "verify") & (F.length("answer") >= 5), "turn")
    rate = St.rate(F.count_if(a), F.count("*"))
    return records(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("turns"), rate.alias("a_rate"), S.first_match([(rate < 0.05, "PASS"), (rate < 0.10, "INFO_PASS")], "WARNING").alias("verdict"), St.rate(F.count_if(refers & ~((got == "ask") & (want != "ask"))), F.count_if(refers)).alias("resolved"), St.rate(F.count_if(changes & got.isin("answer", "verify", "ask", "abstain")), F.count_if(changes)).alias("handled"), last.alias("natural"))


@query("""WITH h AS (SELECT conv_id, substr(sha256(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (turn < last), '')), 1, 16) AS digest FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY 1) SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'changed' WHEN conv_id % 5 = 0 THEN 'new' ELSE 'intact' END AS outcome FROM h""")
def n14_append_only(spark, sf_dir):
    """The hash of all but the last line against the stored one: intact, changed, or new where none is stored."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    now = g.select("conv_id", T.fingerprint(F.array_join(F.transform(F.slice("t", 1, F.size("t") - 1), lambda x: x["text"]), "\n"), 16).alias("digest"))
    path = scratch(spark, "log-hashes")
    now.filter("conv_id % 5 != 0 or conv_id % 7 = 0").select("conv_id", F.when(F.col("conv_id") % 7 == 0, "x").otherwise(F.col("digest")).alias("stored")).write.parquet(path)
    return files.intact(now, spark.read.schema("conv_id long, stored string").parquet(path), "conv_id")


@query("""SELECT event_id, CASE WHEN user_id % 6 = 0 THEN 'blocked' WHEN event_type = 'view' THEN 'none' WHEN value < 5 THEN 'malformed' WHEN event_type = 'purchase' THEN 'promoted' WHEN event_type = 'error' THEN 'blocked' WHEN value > 100 AND event_id % 2 = 0 THEN 'pending_restored' WHEN value > 100 THEN 'pending_ready' ELSE 'pending_low' END AS status FROM events""")
def n16_presentation_status(spark, sf_dir):
    """What a user is shown of the pending candidate, by precedence."""
    t, v = F.col("event_type"), F.col("value")
    outcome = S.first_match([(t == "purchase", "promoted"), (t == "error", "blocked"), (v > 100, "promotable")], "too_early")
    return table(spark, sf_dir, "events").select("event_id", S.presentation_status(F.col("user_id") % 6 == 0, t != "view", v >= 5, outcome, F.col("event_id") % 2 == 0).alias("status"))


@query(f"""WITH {_ROUTED}, x AS (SELECT conv_id, turn, route, text, length(text) < 90 AS generic, turn % 6 = 1 AS failed FROM routed) SELECT conv_id, turn, CASE WHEN failed THEN substr(sha256(text), 1, 12) WHEN route = 'verify' AND length(text) < 80 THEN substr(sha256('[checked] ' || text), 1, 12) WHEN route = 'ask' AND generic THEN substr(sha256('Which detail? ' || text), 1, 12) ELSE substr(sha256(text), 1, 12) END AS digest,
CASE WHEN failed THEN '' ELSE concat_ws(',', CASE WHEN route = 'ask' AND generic THEN 'clarify_rewritten' END, CASE WHEN route = 'verify' AND length(text) < 80 THEN 'verify_fallback' END) END AS notes FROM x""")
def n19_post_processing(spark, sf_dir):
    """A generic question becomes one in context, a thin check the fallback's text; errors stay as they are. The texts of models are columns."""
    r = routed(spark, sf_dir).withColumns({"failed": F.col("turn") % 6 == 1, "clarify": F.concat(F.lit("Which detail? "), "text"), "fallback": F.concat(F.lit("[checked] "), "text")})
    text, notes = S.post_processed(F.col("route"), F.col("text"), F.length("text") < 90, F.length("text") < 80, F.col("failed"), F.col("clarify"), F.col("fallback"))
    return r.select("conv_id", "turn", T.fingerprint(text, 12).alias("digest"), F.array_join(notes, ",").alias("notes"))


@query("""SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, CASE event_id % 4 WHEN 0 THEN 'balanced' WHEN 1 THEN '' WHEN 2 THEN '' ELSE '' END AS profile, CASE event_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE ELSE FALSE END AS opt_out, CASE event_id % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'x' END AS notes, CAST(CASE event_id % 4 WHEN 0 THEN 3 ELSE 0 END AS BIGINT) AS last_turn FROM events""")
def n22_sanitised_import(spark, sf_dir):
    """Session files with fields of the wrong kind degrade to defaults."""
    bad = ('{"profile": "balanced", "opt_out": true, "notes": ["a", 7, "b"], "last_turn": 3}', '{"profile": 5, "opt_out": 1, "notes": "none", "last_turn": -4}', '{"notes": null, "last_turn": "x"}', '{"profile": ["p"], "opt_out": {"a": 1}, "notes": ["x"], "last_turn": null}')
    raw = S.first_match([(F.col("event_id") % 4 == k, b) for k, b in enumerate(bad)], "{}")
    e = table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json("props", "k int")["k"], F.lit(-1)).alias("k"), raw.alias("raw"))
    return files.sanitised(e, "raw").select("event_id", "k", "profile", "opt_out", F.array_join("notes", ",").alias("notes"), "last_turn")


_OUTCOME = """d AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS dup, least(CAST(1 AS DOUBLE), (doc_id % 100) / CAST(100 AS DOUBLE) + CASE WHEN source = 'src2' THEN 0.10 ELSE 0 END::DOUBLE) AS quality FROM documents),
o AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 's_rejected' WHEN source = 'src3' THEN 'provenance' WHEN source = 'src4' THEN 'denylist' WHEN doc_id % 13 = 0 THEN 'term' WHEN n_chars = 0 THEN 'content' WHEN n_chars < 120 THEN 'too_short' WHEN n_chars > 8000 THEN 'too_long' WHEN dup THEN 'duplicate' WHEN quality < 0.55 THEN 'quality' WHEN doc_id % 5 < 2 THEN 'deferred' ELSE 'promoted' END AS outcome FROM d)"""


@query(f"""WITH {_OUTCOME} SELECT doc_id, 'record' AS kind, outcome, NULL AS entry_id, quality FROM o UNION ALL SELECT doc_id, 'entry', outcome, substr(sha256(lang || '|' || source || '|' || CAST(doc_id AS VARCHAR)), 1, 16), quality FROM o WHERE outcome = 'promoted'""")
def m3_promotion_records(spark, sf_dir):
    """The write path of promotion: a record of every evaluation, and an entry for what is promoted."""
    w = Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").withColumn("dup", F.row_number().over(w) > 1).withColumn("quality", F.least(F.lit(1.0), k % 100 / 100.0 + F.when(F.col("source") == "src2", 0.10).otherwise(0.0)))
    o = d.withColumn("outcome", S.promotion(k % 17 == 0, F.col("source") != "src3", F.col("source") == "src4", k % 13 != 0, F.col("n_chars"), F.col("dup"), F.col("quality"), k % 5))
    return stores.promoted(o.select("doc_id", "outcome", T.fingerprint(F.concat_ws("|", "lang", "source", k.cast("string")), 16).alias("entry_id"), "quality"))


@query("""WITH h AS (SELECT doc_id % 30 AS query_id, doc_id, lang, source, (source = 'src1') AS token_hit, (lang = 'de') AS text_hit, (doc_id % 100) / 100.0 AS quality FROM documents), c AS (SELECT *, CASE WHEN token_hit THEN 0 ELSE 1 END AS way FROM h WHERE (token_hit OR text_hit) AND quality >= 0.6), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY way, doc_id) AS r FROM c), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, doc_id) AS rank FROM k WHERE r <= 4)
SELECT query_id, string_agg('[X] ' || CAST(doc_id AS VARCHAR) || ' — ' || lang || ' (domain: ' || source || ')', chr(10) || chr(10) ORDER BY rank) AS block, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS sources, CAST(max(quality) AS DOUBLE) AS score FROM s GROUP BY 1""")
def n18_curated_block(spark, sf_dir):
    """What the curated store says of a query: ranked sources, a block of text, and the best quality as the score."""
    from verdigris.operators import vectors as V

    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 30).alias("query_id"), "doc_id", "lang", "source", (F.col("source") == "src1").alias("token_hit"), (F.col("lang") == "de").alias("text_hit"), (F.col("doc_id") % 100 / 100.0).alias("quality"))
    hits = V.consulted(d, k=4, floor=0.6, weak=0.9).select("query_id", "rank", "doc_id").join(d.select("query_id", "doc_id", "lang", "source", "quality"), ["query_id", "doc_id"])
    line = F.concat(F.lit("[X] "), F.col("doc_id").cast("string"), F.lit(" — "), "lang", F.lit(" (domain: "), "source", F.lit(")"))
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), F.col("doc_id").cast("string").alias("id")))).alias("h"), F.max("quality").alias("score"))
    return g.select("query_id", F.array_join(F.transform("h", lambda x: x["line"]), "\n\n").alias("block"), F.array_join(F.transform("h", lambda x: x["id"]), ",").alias("sources"), "score")


@query("""SELECT doc_id, CAST(k AS INTEGER) AS start, CAST(length(c) AS BIGINT) AS n, CAST(len(regexp_extract_all(c, ' ')) / sqrt(pow(length(c), 2) + pow(len(regexp_extract_all(c, ' ')), 2)) AS DOUBLE) AS second FROM (SELECT doc_id, k, substr(text, CAST(k + 1 AS BIGINT), 800) AS c FROM (SELECT doc_id, text, unnest(range(0, length(text), 700)) AS k FROM documents))""")
def a12_ingested_documents(spark, sf_dir):
    """A folder of documents, read whole, chunked and embedded; the embedding is a column expression, here two counts of unit length."""
    path = scratch(spark, "folder")
    table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text").write.json(path)
    embed = lambda c: F.array(F.length(c).cast("double"), F.regexp_count(c, F.lit(" ")).cast("double"))
    made = files.ingested(files.read_jsonl(spark, path, "path string, text string"), embed)
    return made.select(F.col("path").cast("long").alias("doc_id"), "start", F.length("chunk").cast("long").alias("n"), F.get("embedding", 1).alias("second"))


_VALID = "len(examples) BETWEEN 5 AND 15 AND priority BETWEEN 0 AND 1000 AND regexp_matches(id, '^[a-z]+_[0-9]+$')"
_PART = "p AS (SELECT p_partkey, CASE WHEN p_partkey % 19 = 0 THEN 'Bad-' || CAST(p_partkey AS VARCHAR) ELSE 'pat_' || CAST(p_partkey AS VARCHAR) END AS id, p_brand AS topic, p_size * 25 AS priority, range(0, CAST(p_size % 20 AS BIGINT)) AS examples, CASE p_partkey % 5 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'under_review' ELSE 'active' END AS status FROM part)"


@query(f"WITH {_PART} SELECT id, topic, CAST(priority AS INTEGER) AS priority, CAST(len(examples) AS INTEGER) AS examples FROM p WHERE {_VALID} AND status = 'active' AND p_partkey % 23 <> 0")
def a14_loaded_library(spark, sf_dir):
    """The pattern files of a folder less those with an underscore in front; broken lines, invalid and inactive patterns are left out."""
    return loaded(spark, sf_dir).select("id", "topic", "priority", F.size("examples").alias("examples"))


def loaded(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "library")
    k = F.col("p_partkey")
    status = S.first_match([(k % 5 == 0, "deprecated"), (k % 5 == 1, "under_review")], "active")
    p = table(spark, sf_dir, "part").select(k, F.when(k % 19 == 0, F.concat(F.lit("Bad-"), k.cast("string"))).otherwise(F.concat(F.lit("pat_"), k.cast("string"))).alias("id"), F.col("p_brand").alias("topic"), (F.col("p_size") * 25).cast("int").alias("priority"), F.transform(F.slice(F.sequence(F.lit(0), F.lit(20)), F.lit(1), (F.col("p_size") % 20).cast("int")), lambda x: x.cast("string")).alias("examples"), F.struct(status.alias("audit_status")).alias("lifecycle"))
    p.filter("p_partkey % 23 != 0").drop("p_partkey").write.json(f"{path}/topics")
    p.filter("p_partkey % 23 = 0").drop("p_partkey").write.json(f"{path}/_taxonomy")
    return files.pattern_library(spark, path)


@query(f"WITH {_PART} SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM p WHERE {_VALID} AND status = 'active' AND p_partkey % 23 <> 0")
def a24_rebuilt_index_rows(spark, sf_dir):
    """All rows of the library in the order of their ids, with their positions: counts by the ids' first letters, then a running number."""
    rows = loaded(spark, sf_dir).select("id", F.substring("id", 1, 9).alias("range"))
    return St.running(rows, "range", ["id"], {"n": F.lit(1)}).select("id", (F.col("n") - 1).alias("position"))


@query("""SELECT conv_id, turn, 'chat' AS benchmark, substr(sha256(text), 1, 16) AS prompt_hash FROM conversations""")
def a2_appended_rows(spark, sf_dir):
    """Rows with all required fields, appended to a log in two steps; rows that lack one are refused."""
    path = scratch(spark, "bench-rows")
    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"), F.col("role").alias("output"), (F.col("turn") * 10.0).alias("latency"))
    fixed = {"run_id": "r", "timestamp": "2024-01-01", "model_profile": "m", "benchmark": "chat", "task": "t", "metric_name": "n", "error": "", "metadata": ""}
    rows = files.bench_rows(raw).withColumns({**{k: F.lit(v) for k, v in fixed.items()}, "sample_id": F.concat_ws(":", "conv_id", "turn"), "score": F.lit(1.0), "tokens_in": F.lit(1), "tokens_out": F.lit(1)})
    for part in (0, 1):
        files.append_rows(rows.filter(F.col("turn") % 2 == part), path)
    try:
        files.append_rows(rows.drop("score"), path)
    except ValueError:
        pass
    return files.read_jsonl(spark, path, "conv_id long, turn int, benchmark string, prompt_hash string")


@query("WITH n AS (SELECT CAST(max(ts) AS DATE) AS now FROM events) SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM events, n WHERE CAST(ts AS DATE) >= now - 20 GROUP BY 1")
def a16_purged_log(spark, sf_dir):
    """An audit log appended in batches and compressed by day, less the partitions past its days: only the rest is read and counted."""
    path = scratch(spark, "audit-log")
    e = table(spark, sf_dir, "events")
    for part in (0, 1):
        files.partitioned(e.filter(F.col("event_id") % 2 == part), path)
    now = e.agg(F.max(F.to_date("ts")).cast("string")).first()[0]
    files.purged(spark, path, now, 20)
    return spark.read.parquet(path).groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, CAST(tick AS BIGINT) AS tick FROM (SELECT event_id, user_id, (row_number() OVER (ORDER BY event_id) - 1) // 20 AS tick FROM events WHERE event_type = 'purchase')")
def t3_t4_micro_batches(spark, sf_dir):
    """The rows that each tick of a worker takes from its queue, twenty at most, in order; ranges number them."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", "user_id", F.expr("event_id div 10000").alias("range"))
    return St.running(rows, "range", ["event_id"], {"n": F.lit(1)}).select("event_id", "user_id", F.expr("(n - 1) div 20").alias("tick"))


@query("SELECT capsule_id, CAST(turns AS BIGINT) AS turns, CASE WHEN capsule_id % 3 = 0 THEN 1 ELSE 0 END AS layer FROM (SELECT conv_id AS capsule_id, count(*) AS turns FROM conversations GROUP BY 1)")
def a23_capsule_migration(spark, sf_dir):
    """A table with rows of an older schema and of the present one: the column that the older lack is filled."""
    path = scratch(spark, "capsule-table")
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("capsule_id")).agg(F.count("*").alias("turns"))
    c.filter("capsule_id % 3 != 0").write.parquet(f"{path}/v=1")
    c.filter("capsule_id % 3 = 0").withColumn("layer", F.lit(1)).write.parquet(f"{path}/v=2")
    return files.migrated(spark, path, {"capsule_id": ("long", None), "turns": ("long", 0), "layer": ("int", 0)})
