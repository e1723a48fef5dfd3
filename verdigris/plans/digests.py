"""Digests, rollups, judges and class statistics over whole tables.

Long results have the form (section, key, n): one table holds several histograms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import scoring as S
from verdigris.functions import text as T
from verdigris.operators import statistics as St
from verdigris.plans.base import registrar, table
from verdigris.plans.evals import _R, records
from verdigris.plans.scores import _ROUTED, _SCORED, routed, scored

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)


def top(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent keys of each section, ties by key."""
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "key"))
    return counts.withColumn("r", rank).filter(F.col("r") <= n).drop("r")


def histogram(rows: DataFrame, section: str, key: Column) -> DataFrame:
    return rows.groupBy(F.lit(section).alias("section"), key.cast("string").alias("key")).agg(F.count("*").alias("n"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query("SELECT doc_id, CASE WHEN text = '' THEN 'unknown' WHEN regexp_matches(text, '[\\x{3040}-\\x{30FF}]') THEN 'ja' WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'zh' ELSE 'en' END AS reply_language FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || 'の' WHEN 1 THEN text || '中文' WHEN 2 THEN '' ELSE text END AS text FROM documents)")
def c11_reply_language(spark, sf_dir):
    """The table has no kana, Han or empty text of its own: by id, some get a few characters more."""
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.concat("text", F.lit("の"))).when(k == 1, F.concat("text", F.lit("中文"))).when(k == 2, "").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.reply_language(text).alias("reply_language"))


_AUDIT = f"""{_ROUTED}, au AS (SELECT conv_id, turn, route, tvs, mkr, reason, turn % 10 <> 9 AS is_full, CASE turn % 4 WHEN 0 THEN 'bounded-only' WHEN 1 THEN 'answerable' ELSE '' END AS adm FROM routed),
cl AS (SELECT *, CASE WHEN contains(reason, 'FRESHNESS') THEN 'freshness' WHEN reason = 'LOW_STAKES_STABLE' THEN 'stable' WHEN reason = 'SAFETY' THEN 'safety' WHEN route = 'verify' AND tvs < 0.4 THEN 'stable_verify' WHEN route = 'verify' THEN 'freshness_verify' WHEN route = 'ask' THEN 'clarification' WHEN route = 'abstain' THEN 'abstain' ELSE 'answer_stable' END AS class FROM au),
agg AS (SELECT class, count(*) AS total, count(*) FILTER (route = 'verify') AS verify, count(*) FILTER (route = 'answer') AS answered, count(*) FILTER (adm = 'bounded-only') AS bounded, count(*) FILTER (adm = 'answerable') AS success, round(avg(tvs), 9) AS mean_tvs FROM cl WHERE is_full GROUP BY 1),
stat AS (SELECT *, round(greatest(CAST(0.10 AS DOUBLE), least(CAST(0.95 AS DOUBLE), CAST(0.55 AS DOUBLE) + success / CAST(total AS DOUBLE) * CAST(0.3 AS DOUBLE) - bounded / CAST(total AS DOUBLE) * CAST(0.2 AS DOUBLE) - verify / CAST(total AS DOUBLE) * greatest(CAST(0 AS DOUBLE), CAST(0.4 AS DOUBLE) - mean_tvs))), 9) AS signal FROM agg)"""


def audit(spark, sf_dir) -> DataFrame:
    """Audit records of routed turns: full ones and headers, with admissibility and query class."""
    adm = S.first_match([(F.col("turn") % 4 == 0, "bounded-only"), (F.col("turn") % 4 == 1, "answerable")], "")
    r = routed(spark, sf_dir).withColumns({"full": F.col("turn") % 10 != 9, "adm": adm})
    return r.withColumn("class", S.query_class(F.col("reason"), F.col("route"), F.col("tvs")))


def class_statistics(records_: DataFrame) -> DataFrame:
    """Per query class of the full records: counts, mean volatility and the reliability signal."""
    c = records_.filter("full").groupBy("class").agg(
        F.count("*").alias("total"), F.count_if(F.col("route") == "verify").alias("verify"), F.count_if(F.col("route") == "answer").alias("answered"),
        F.count_if(F.col("adm") == "bounded-only").alias("bounded"), F.count_if(F.col("adm") == "answerable").alias("success"), F.round(F.avg("tvs"), 9).alias("mean_tvs"),
    )
    return c.withColumn("signal", F.round(S.reliability_signal(F.col("total"), F.col("verify"), F.col("bounded"), F.col("success"), F.col("mean_tvs")), 9))


@query(f"WITH {_AUDIT} SELECT class, CAST(total AS BIGINT) AS total, CAST(verify AS BIGINT) AS verify, CAST(answered AS BIGINT) AS answered, CAST(bounded AS BIGINT) AS bounded, CAST(success AS BIGINT) AS success, mean_tvs, signal FROM stat")
def d9_d10_class_statistics(spark, sf_dir):
    return class_statistics(audit(spark, sf_dir))


@query(f"WITH {_AUDIT} SELECT CAST(row_number() OVER (ORDER BY signal, class) AS INTEGER) AS place, class, signal FROM stat WHERE mean_tvs < 0.4 AND signal < 0.62")
def d11_low_quadrant(spark, sf_dir):
    """Classes of low volatility and low signal, the lowest first; the bound of 0.5 is a parameter, here 0.62."""
    return S.low_quadrant(class_statistics(audit(spark, sf_dir)), 0.4, 0.62).select("place", "class", "signal")


@query(f"""WITH {_AUDIT} SELECT conv_id, turn, round(greatest(CAST(0.10 AS DOUBLE), least(CAST(0.95 AS DOUBLE), coalesce(signal, CAST(0.55 AS DOUBLE)) - CASE WHEN tvs < 0.4 AND route = 'verify' THEN (CAST(0.4 AS DOUBLE) - tvs) * CAST(0.3 AS DOUBLE) ELSE 0 END
- CASE adm WHEN 'bounded-only' THEN CAST(0.05 AS DOUBLE) WHEN 'answerable' THEN CAST(-0.05 AS DOUBLE) ELSE 0 END)), 9) AS estimate
FROM (SELECT cl.*, CASE WHEN route = 'verify' AND tvs < 0.4 THEN 'stable_verify' WHEN route = 'verify' THEN 'freshness_verify' WHEN route = 'ask' THEN 'clarification' WHEN route = 'abstain' THEN 'abstain' ELSE 'answer_stable' END AS plain FROM cl) x LEFT JOIN stat ON stat.class = x.plain""")
def d12_reliability_estimate(spark, sf_dir):
    """The class of a new query follows from route and volatility alone; the class table is a few rows."""
    a = audit(spark, sf_dir)
    known = class_statistics(a).select("class", "signal")
    asked = a.drop("class").withColumn("class", S.query_class(F.lit(""), F.col("route"), F.col("tvs")))
    joined = asked.join(F.broadcast(known), "class", "left")
    return joined.select("conv_id", "turn", F.round(S.estimated_reliability(F.col("signal"), F.col("tvs"), F.col("route"), F.col("adm")), 9).alias("estimate"))


#: Word lists of the axis scores: short, meant to be replaced; function words, which the invented text holds.
AXIS_WORDS = {"hedge": ("or ", "may "), "fabricated": ("as ", "of my"), "ask": ("which", "?", "at th"), "committed": ("not ", "the answer is"), "perspective": ("however", "with ", "by "), "certain": ("always", "are ")}
_W = {k: "[" + ", ".join("'" + w + "'" for w in v) + "]" for k, v in AXIS_WORDS.items()}
_HIT = {k: f"len(list_filter({w}, lambda h: contains(a, h)))" for k, w in _W.items()}
_AXES = f"""{_R}, ax AS (SELECT conv_id, turn, lower(answer) AS a, length(answer) AS n, CASE turn % 8 WHEN 1 THEN 'factual' WHEN 3 THEN 'underspec' WHEN 5 THEN 'opinion' ELSE 'casual' END AS kind, list_filter(regexp_split_to_array(lower(prompt), '[ ,()\\n\\t]+'), lambda w: length(w) > 2) AS kws FROM rec),
ay AS (SELECT *, len(list_filter(kws, lambda w: contains(a, w))) / greatest(len(kws), 1)::DOUBLE AS ratio, len(list_filter(list_filter(kws, lambda w: length(w) > 3)[1:3], lambda w: contains(CASE WHEN contains(a, '.') THEN string_split(a, '.')[1] ELSE substr(a, 1, 200) END, w))) AS direct, {_HIT['hedge']} > 0 AS hedged, {_HIT['fabricated']} > 0 AS fab, {_HIT['ask']} AS asked, {_HIT['committed']} > 0 AS committed, {_HIT['perspective']} AS p, {_HIT['certain']} AS c FROM ax)"""


@query(f"""WITH {_AXES} SELECT conv_id, turn, kind,
CAST(CASE kind WHEN 'factual' THEN CASE WHEN ratio > 0.6 THEN 5 WHEN ratio > 0.4 THEN 4 WHEN ratio > 0.2 THEN 3 WHEN ratio > 0 THEN 2 ELSE 1 END WHEN 'underspec' THEN CASE WHEN committed THEN 1 ELSE least(5, 2 + asked) END WHEN 'opinion' THEN least(5, 2 + p) ELSE CASE WHEN n > 5 THEN 4 ELSE 2 END END AS INTEGER) AS accuracy,
CAST(CASE kind WHEN 'factual' THEN least(5, 3 + direct) WHEN 'underspec' THEN CASE WHEN asked >= 2 THEN 4 WHEN asked >= 1 THEN 3 ELSE 2 END WHEN 'opinion' THEN CASE WHEN n > 50 THEN 4 ELSE 3 END ELSE CASE WHEN n < 500 THEN 4 ELSE 3 END END AS INTEGER) AS directness,
CAST(CASE kind WHEN 'factual' THEN CASE WHEN hedged THEN 4 ELSE 3 END WHEN 'underspec' THEN CASE WHEN committed THEN 1 ELSE 5 END WHEN 'opinion' THEN CASE WHEN c = 0 THEN least(5, 3 + p) ELSE 2 END ELSE 3 END AS INTEGER) AS uncertainty,
CAST(CASE kind WHEN 'factual' THEN CASE WHEN fab THEN 2 ELSE 4 END WHEN 'underspec' THEN CASE WHEN committed THEN 2 ELSE 5 END WHEN 'opinion' THEN CASE WHEN c = 0 THEN 4 ELSE 2 END ELSE 3 END AS INTEGER) AS hallucination,
CAST(CASE kind WHEN 'factual' THEN CASE WHEN n < 300 THEN 5 WHEN n < 600 THEN 4 WHEN n < 1000 THEN 3 ELSE 2 END WHEN 'underspec' THEN CASE WHEN n < 500 THEN 4 ELSE 3 END WHEN 'opinion' THEN CASE WHEN n < 800 THEN 4 ELSE 3 END ELSE CASE WHEN n < 200 THEN 5 WHEN n < 400 THEN 4 ELSE 3 END END AS INTEGER) AS conciseness FROM ay""")
def d47_axis_scores(spark, sf_dir):
    t = F.col("turn") % 8
    kind = S.first_match([(t == 1, "factual"), (t == 3, "underspec"), (t == 5, "opinion")], "casual")
    r = records(spark, sf_dir).withColumn("kind", kind)
    return r.select("conv_id", "turn", "kind", S.axis_scores(F.col("kind"), F.col("answer"), F.col("prompt"), AXIS_WORDS).alias("s")).select("conv_id", "turn", "kind", "s.*")


@query("""WITH g AS (SELECT * FROM (VALUES (0, 'local', 'example.com', 'blog'), (1, 'remote', NULL, NULL), (2, NULL, 'example.org', 'www')) AS t(profile, backend, forbidden, model)), e AS (SELECT page_id, page_id % 3 AS profile, CASE WHEN page_id % 5 = 0 THEN 'remote' ELSE 'local' END AS backend, url AS endpoint, CASE WHEN page_id % 4 > 0 THEN regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) END AS model FROM pages)
SELECT page_id, CASE WHEN g.backend <> e.backend THEN 'backend' WHEN contains(lower(endpoint), forbidden) THEN 'endpoint' WHEN e.model <> '' AND NOT contains(lower(e.model), g.model) THEN 'model' ELSE 'pure' END AS outcome FROM e JOIN g USING (profile)""")
def d51_backend_purity(spark, sf_dir):
    guards = spark.createDataFrame([(0, "local", "example.com", "blog"), (1, "remote", None, None), (2, None, "example.org", "www")], "profile long, need_backend string, forbidden string, need_model string")
    e = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 3).alias("profile"), F.when(F.col("page_id") % 5 == 0, "remote").otherwise("local").alias("backend"), F.col("url").alias("endpoint"), F.when(F.col("page_id") % 4 > 0, F.regexp_extract("url", "^[^:/?#]+://([^/?#]*)", 1)).alias("model"))
    return e.join(F.broadcast(guards), "profile").select("page_id", S.purity(F.col("need_backend"), F.col("forbidden"), F.col("need_model"), F.col("backend"), F.col("endpoint"), F.col("model")).alias("outcome"))


_TRACES = "WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200), m AS (SELECT *, event_type IN ('click', 'purchase') AS matched, CASE WHEN value > 100 THEN 'high' ELSE 'medium' END AS confidence FROM l)"


@query(f"""{_TRACES} SELECT 'count' AS section, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM m UNION ALL SELECT 'with_match', '', CAST(count(*) FILTER (matched) AS DOUBLE) FROM m UNION ALL SELECT 'match_rate', '', count(*) FILTER (matched) / CAST(count(*) AS DOUBLE) FROM m
UNION ALL SELECT 'topic', event_type, CAST(count(*) AS DOUBLE) FROM m WHERE matched GROUP BY 2 UNION ALL SELECT 'confidence', confidence, CAST(count(*) AS DOUBLE) FROM m WHERE matched GROUP BY 2""")
def h20_trace_summary(spark, sf_dir):
    """Matches, topics and confidence of the latest 200 traces (fewer, if there are fewer)."""
    latest = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    m = latest.select("event_type", F.col("event_type").isin("click", "purchase").alias("matched"), F.when(F.col("value") > 100, "high").otherwise("medium").alias("confidence"))
    whole = m.agg(F.count("*").alias("count"), F.count_if("matched").alias("with_match"), St.rate(F.count_if("matched"), F.count("*")).alias("match_rate"))
    totals = whole.select(F.explode(F.array(*(F.struct(F.lit(k).alias("section"), F.lit("").alias("key"), F.col(k).cast("double").alias("value")) for k in ("count", "with_match", "match_rate")))).alias("x")).select("x.*")
    hit = m.filter("matched")
    return together(totals, *(histogram(hit, s, F.col(c)).select("section", "key", F.col("n").cast("double").alias("value")) for s, c in (("topic", "event_type"), ("confidence", "confidence"))))


@query("""SELECT event_id // 50 AS batch_id, CAST(count(DISTINCT user_id) AS BIGINT) AS patterns, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS examples, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS primary_used FROM events GROUP BY 1 ORDER BY min(ts) DESC, batch_id DESC LIMIT 30""")
def h21_batch_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("batch_id", F.expr("event_id div 50"))
    b = e.groupBy("batch_id").agg(F.min("ts").alias("started"), F.countDistinct("user_id").alias("patterns"), F.sum(F.floor("value")).alias("examples"), F.count_if(F.col("event_type") == "purchase").alias("primary_used"))
    return b.orderBy(F.desc("started"), F.desc("batch_id")).limit(30).drop("started")


@query("""WITH h AS (SELECT 'lang' AS section, lang AS key FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'size', CAST(n_chars AS VARCHAR) FROM documents), c AS (SELECT section, key, count(*) AS n FROM h GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY section) AS kinds FROM c)
SELECT section, key, CAST(n AS BIGINT) AS n FROM k WHERE kinds <= 12 UNION ALL SELECT 'sample', CAST(doc_id AS VARCHAR), n_chars FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 3) UNION ALL SELECT 'column', c, 1 FROM (VALUES ('doc_id'), ('text'), ('lang'), ('source'), ('n_chars')) AS t(c)""")
def h32_file_digest(spark, sf_dir):
    """Columns, histograms of columns of at most 12 values, and three sample rows."""
    d = table(spark, sf_dir, "documents")
    long = d.select("lang", "source", F.col("n_chars").cast("string").alias("size")).unpivot([], ["lang", "source", "size"], "section", "key").groupBy("section", "key").agg(F.count("*").alias("n"))
    # The number of values is counted before any window, so that a column of many values is not one group.
    few = long.groupBy("section").agg(F.count("*").alias("kinds")).filter("kinds <= 12").select("section")
    sample = d.orderBy("doc_id").limit(3).select(F.lit("sample").alias("section"), F.col("doc_id").cast("string").alias("key"), F.col("n_chars").cast("long").alias("n"))
    columns = spark.createDataFrame([("column", c, 1) for c in d.columns], "section string, key string, n long")
    return together(long.join(F.broadcast(few), "section", "left_semi").select("section", "key", "n"), sample, columns)


@query(f"""WITH {_R}, x AS (SELECT conv_id, turn, family, classified, unlabelled, errored, CASE WHEN correct THEN 'correct' ELSE 'incorrect' END AS verdict, CASE WHEN preferred <> correct THEN 'changed' ELSE 'same' END AS change, CASE WHEN turn < 2 THEN 'early' ELSE 'late' END AS priority, string_split(family || '|' || classified || CASE WHEN errored THEN '|errored' ELSE '' END, '|') AS flags FROM rec),
h AS (SELECT 'route' AS section, classified AS key FROM x UNION ALL SELECT 'family', family FROM x UNION ALL SELECT 'priority', priority FROM x UNION ALL SELECT 'verdict', verdict FROM x UNION ALL SELECT 'change', change FROM x UNION ALL SELECT 'flag', unnest(flags) FROM x)
SELECT section, key, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY ALL UNION ALL SELECT 'failure', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), CAST(1 AS BIGINT) FROM x WHERE verdict = 'incorrect'""")
def h33_review_packet(spark, sf_dir):
    """Histograms of route, family, priority, verdict, change and flags, and the ids of failures."""
    flags = F.split(F.concat("family", F.lit("|"), "classified", F.when(F.col("errored"), "|errored").otherwise("")), r"\|")
    x = records(spark, sf_dir).select(
        "conv_id", "turn", "family", F.col("classified").alias("route"), F.when(F.col("correct"), "correct").otherwise("incorrect").alias("verdict"), F.when(F.col("preferred") != F.col("correct"), "changed").otherwise("same").alias("change"),
        F.when(F.col("turn") < 2, "early").otherwise("late").alias("priority"), flags.alias("flags"),
    )
    named = F.array(*(F.struct(F.lit(s).alias("section"), F.col(s).alias("key")) for s in ("route", "family", "priority", "verdict", "change")))
    counted = x.select(F.explode(F.concat(named, F.transform("flags", lambda f: F.struct(F.lit("flag").alias("section"), f.alias("key"))))).alias("e")).groupBy("e.section", "e.key").agg(F.count("*").alias("n"))
    failed = x.filter("verdict = 'incorrect'").select(F.lit("failure").alias("section"), F.concat_ws(":", "conv_id", "turn").alias("key"), F.lit(1).cast("long").alias("n"))
    return together(counted, failed)


@query("""WITH p AS (SELECT p_partkey, p_brand AS file, p_size, CASE p_partkey % 5 WHEN 0 THEN 'quarantined' WHEN 1 THEN 'unknown' ELSE 'active' END AS status, p_partkey % 11 = 0 AS deprecated, p_type AS sub_topic FROM part), ev AS (SELECT ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10),
h AS (SELECT file AS section, 'rows' AS key, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT file, 'status:' || status, count(*) FROM p GROUP BY ALL UNION ALL SELECT file, 'deprecated', count(*) FILTER (deprecated) FROM p GROUP BY 1 UNION ALL SELECT file, 'cold', count(*) FILTER (p_size < 10) FROM p GROUP BY 1 UNION ALL SELECT file, 'priority', sum(p_size) // count(*) FROM p GROUP BY 1
UNION ALL SELECT 'library', 'rows', count(*) FROM p UNION ALL SELECT 'library', 'status:' || status, count(*) FROM p GROUP BY ALL UNION ALL SELECT 'library', 'deprecated', count(*) FILTER (deprecated) FROM p UNION ALL SELECT 'sub_topic', sub_topic, count(*) FROM p GROUP BY ALL)
SELECT section, key, CAST(n AS BIGINT) AS n FROM h UNION ALL SELECT 'recent', strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CAST(user_id AS VARCHAR) || ' ' || event_type, CAST(1 AS BIGINT) FROM ev""")
def h34_library_digest(spark, sf_dir):
    """Per file and for the library: rows, states, deprecated, cold and mean priority; sub-topics; the ten latest events."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), "p_size", S.first_match([(k % 5 == 0, "quarantined"), (k % 5 == 1, "unknown")], "active").alias("status"), (k % 11 == 0).alias("deprecated"), F.col("p_type").alias("sub_topic"))
    numbers = [("rows", F.count("*")), ("deprecated", F.count_if("deprecated"))]
    of_file = [*numbers, ("cold", F.count_if(F.col("p_size") < 10)), ("priority", F.expr("sum(cast(p_size as bigint)) div count(*)"))]

    def told(grouped, section: Column, values) -> DataFrame:
        return grouped.agg(*(c.alias(n) for n, c in values)).select(section.alias("section"), F.explode(F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).cast("long").alias("n")) for n, _ in values))).alias("x")).select("section", "x.*")

    state = F.concat(F.lit("status:"), "status")
    states = p.groupBy(F.col("file").alias("section"), state.alias("key")).agg(F.count("*").alias("n"))
    recent = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select(F.lit("recent").alias("section"), F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("user_id").cast("string"), "event_type").alias("key"), F.lit(1).cast("long").alias("n"))
    return together(told(p.groupBy("file"), F.col("file"), of_file), states, told(p, F.lit("library"), numbers), histogram(p, "library", state), histogram(p, "sub_topic", F.col("sub_topic")), recent)


@query("""WITH c AS (SELECT o_custkey AS author, l_linestatus || '/' || CAST(l_suppkey AS VARCHAR) || CASE l_returnflag WHEN 'N' THEN '' ELSE '.' || lower(l_returnflag) END AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
h AS (SELECT 'author' AS section, CAST(o_custkey AS VARCHAR) AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'file', file, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'dir', string_split(file, '/')[1], count(*) FROM c GROUP BY 2 UNION ALL SELECT 'extension', CASE WHEN contains(file, '.') THEN '.' || string_split(file, '.')[2] ELSE '(no-ext)' END, count(*) FROM c GROUP BY 2)
SELECT section, key, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, key) AS r FROM h) WHERE r <= 10""")
def h35_history_rollup(spark, sf_dir):
    """Orders stand for commits, their lines for the files touched: authors, files, top folders and extensions."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    file = F.concat("l_linestatus", F.lit("/"), F.col("l_suppkey").cast("string"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("."), F.lower("l_returnflag"))))
    touched = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(file.alias("file"))
    suffix = F.regexp_extract("file", r"(\.[^./]+)$", 1)
    parts = [histogram(touched, "file", F.col("file")), histogram(touched, "dir", F.substring_index("file", "/", 1)), histogram(touched, "extension", F.when(suffix != "", suffix).otherwise("(no-ext)"))]
    return top(together(histogram(o, "author", F.col("o_custkey")), *parts), 10)


@query("""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents), h AS (SELECT * FROM l WHERE contains(line, 'tion')), f AS (SELECT doc_id, source, count(*) AS n FROM h GROUP BY ALL), t AS (SELECT doc_id FROM f ORDER BY n DESC, doc_id LIMIT 5)
SELECT 'dir' AS section, source AS key, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY 2 UNION ALL SELECT 'file', CAST(doc_id AS VARCHAR), CAST(n AS BIGINT) FROM f UNION ALL SELECT 'sample', CAST(doc_id AS VARCHAR) || ':' || CAST(ln AS VARCHAR), CAST(length(line) AS BIGINT) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS r FROM h WHERE doc_id IN (SELECT doc_id FROM t)) WHERE r <= 3""")
def h36_grep_digest(spark, sf_dir):
    """Hits of a pattern by file and by folder, and the first three of each of the five files with most."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    h = d.filter(F.contains("line", F.lit("tion"))).withColumn("at", F.col("at") + 1)
    files = h.groupBy("doc_id").agg(F.count("*").alias("n"))
    best = files.orderBy(F.desc("n"), "doc_id").limit(5).select("doc_id")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    samples = h.join(F.broadcast(best), "doc_id", "left_semi").withColumn("r", first).filter("r <= 3")
    return together(
        histogram(h, "dir", F.col("source")), files.select(F.lit("file").alias("section"), F.col("doc_id").cast("string").alias("key"), "n"),
        samples.select(F.lit("sample").alias("section"), F.concat_ws(":", "doc_id", "at").alias("key"), F.length("line").cast("long").alias("n")),
    )


@query("""WITH s AS (SELECT l_orderkey % 7 AS benchmark, l_orderkey AS sample, l_linenumber AS model, l_quantity AS score FROM lineitem WHERE l_returnflag <> 'R') SELECT DISTINCT a.benchmark, a.sample, a.score AS score_a, b.score AS score_b FROM (SELECT benchmark, sample, max(score) AS score FROM s WHERE model = 1 GROUP BY ALL) a JOIN (SELECT benchmark, sample, max(score) AS score FROM s WHERE model = 2 GROUP BY ALL) b ON a.benchmark = b.benchmark AND a.sample = b.sample WHERE a.score <> b.score""")
def j11_model_disagreements(spark, sf_dir):
    """Two models' scores of one (benchmark, sample) that differ; the models are two line numbers of an order, errors are returns."""
    l = table(spark, sf_dir, "lineitem")
    rows = l.select((F.col("l_orderkey") % 7).alias("benchmark"), F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("model"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").alias("errored"))
    return St.disagreements(rows, 1, 2)


_SHORT = "regexp_split_to_array(answer, '[^\\p{L}\\p{N}_]+')"
_HINTS = f"""{_R}, tk AS (SELECT conv_id, turn, list_filter({_SHORT}, lambda w: regexp_matches(w, '^[0-9]+$'))[1:3] AS nums, list_filter({_SHORT}, lambda w: regexp_matches(w, '^[A-Z][a-z][a-z]+$'))[1:3] AS names FROM rec WHERE correct AND length(answer) > 0 AND length(answer) < 300),
hints AS (SELECT conv_id, list_sort(list_distinct(flatten(list(list_concat(nums, names))))) AS hints FROM tk GROUP BY 1)"""


def hints(spark, sf_dir) -> DataFrame:
    """Per question (conversation): the first three numbers and names of its short correct answers, distinct."""
    words = F.split("answer", r"[^\p{L}\p{N}_]+")
    r = records(spark, sf_dir).filter("correct and length(answer) > 0 and length(answer) < 300")
    first = lambda p: F.slice(F.filter(words, lambda w: w.rlike(p)), 1, 3)
    found = F.concat(first("^[0-9]+$"), first("^[A-Z][a-z]{2,}$"))
    return r.select("conv_id", found.alias("h")).groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("h")))).alias("hints"))


@query(f"WITH {_HINTS} SELECT conv_id, array_to_string(hints, ' ') AS hints FROM hints")
def n3_answer_hints(spark, sf_dir):
    return hints(spark, sf_dir).select("conv_id", F.array_join("hints", " ").alias("hints"))


_HEDGED, _ABSTAINS = ("or ", "may "), ("not ", "cannot ")
_JUDGE = f"""{_HINTS}, peers AS (SELECT conv_id, list(struct_pack(turn := turn, w := list_filter(string_split(lower(answer), ' '), lambda w: length(w) > 3)[1:5]) ORDER BY turn) AS peers FROM rec WHERE correct AND length(answer) > 0 AND length(answer) < 200 GROUP BY 1),
x AS (SELECT rec.conv_id, rec.turn, lower(answer) AS a, rec.conv_id % 2 = 0 AS governed, CASE rec.turn % 4 WHEN 1 THEN 'bounded-only' WHEN 3 THEN 'verify-failed' ELSE 'answerable' END AS adm, CASE (rec.conv_id + rec.turn) % 3 WHEN 0 THEN 'incorrect' WHEN 1 THEN 'correct' ELSE '' END AS known, coalesce(hints, []) AS hints, list_filter(coalesce(peers, []), lambda p: p.turn <> rec.turn) AS peers FROM rec LEFT JOIN hints ON hints.conv_id = rec.conv_id LEFT JOIN peers ON peers.conv_id = rec.conv_id),
y AS (SELECT *, len(list_filter(hints, lambda h: contains(a, lower(h)))) > 0 AS hinted, contains(a, 'or ') OR contains(a, 'may ') AS hedged, contains(a, 'not ') OR contains(a, 'cannot ') AS abstains, CASE WHEN len(peers) = 0 THEN 'unknown' WHEN len(list_filter(peers, lambda p: len(list_filter(p.w, lambda w: contains(a, w))) >= 2)) > 0 THEN 'correct' ELSE 'incorrect' END AS vote FROM x)"""


@query(f"""WITH {_JUDGE} SELECT conv_id, turn, CASE WHEN abstains THEN 'abstained' WHEN governed AND hedged AND adm = 'bounded-only' THEN 'correct' WHEN governed AND known = 'incorrect' AND adm <> 'answerable' THEN 'correct' WHEN governed AND known = 'incorrect' AND len(hints) > 0 THEN CASE WHEN hinted THEN 'correct' ELSE 'incorrect' END WHEN governed AND known = 'incorrect' THEN vote WHEN governed AND known = 'correct' THEN 'correct' WHEN governed AND hinted THEN 'correct' WHEN governed THEN 'answered'
WHEN hinted THEN 'correct' WHEN vote = 'correct' THEN 'correct' WHEN hedged THEN 'hedged' WHEN vote = 'incorrect' THEN 'incorrect' ELSE 'unknown' END AS verdict FROM y""")
def n2_answer_judge(spark, sf_dir):
    """The governed or the raw ladder; the vote is by the other short correct answers to the question."""
    r = records(spark, sf_dir)
    words = lambda c: F.slice(F.filter(F.split(F.lower(c), " "), lambda w: F.length(w) > 3), 1, 5)
    peers = r.filter("correct and length(answer) > 0 and length(answer) < 200").groupBy("conv_id").agg(F.collect_list(F.struct("turn", words("answer").alias("w"))).alias("peers"))
    known = S.first_match([((F.col("conv_id") + F.col("turn")) % 3 == 0, "incorrect"), ((F.col("conv_id") + F.col("turn")) % 3 == 1, "correct")], "")
    adm = S.first_match([(F.col("turn") % 4 == 1, "bounded-only"), (F.col("turn") % 4 == 3, "verify-failed")], "answerable")
    x = r.select("conv_id", "turn", F.lower("answer").alias("a"), (F.col("conv_id") % 2 == 0).alias("governed"), adm.alias("adm"), known.alias("known")).join(hints(spark, sf_dir), "conv_id", "left").join(peers, "conv_id", "left")
    others = F.filter("peers", lambda p: p["turn"] != F.col("turn"))
    return x.select("conv_id", "turn", S.judged_answer(F.col("a"), F.col("governed"), F.col("adm"), F.col("known"), F.col("hints"), F.transform(others, lambda p: p["w"]), _ABSTAINS, _HEDGED).alias("verdict"))


@query("""WITH f AS (SELECT role AS intent, text, min(conv_id * 1000 + turn) AS pos FROM conversations WHERE text <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY pos) AS place FROM f) SELECT intent, CAST(place AS INTEGER) AS place, pos FROM r WHERE place <= 5""")
def n6_first_seeds(spark, sf_dir):
    """The first five distinct texts of each intent in the order of the file."""
    c = table(spark, sf_dir, "conversations").filter("text != ''").groupBy(F.col("role").alias("intent"), "text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    place = F.row_number().over(Window.partitionBy("intent").orderBy("pos"))
    return c.withColumn("place", place).filter("place <= 5").select("intent", "place", "pos")


_PHRASES = ("with the", "tion of", "at th")


@query("""WITH c AS (SELECT turn % 5 AS cat, text <> '' AND (contains(lower(text), 'with the') OR contains(lower(text), 'tion of') OR contains(lower(text), 'at th')) AS fail, role = 'system' AS fallback FROM conversations), s AS (SELECT cat, count(*) AS n, count(*) FILTER (fail) AS fail, count(*) FILTER (fallback) AS fallback FROM c GROUP BY 1)
SELECT section, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(fail), 0) AS BIGINT) AS fail, CAST(coalesce(sum(fallback), 0) AS BIGINT) AS fallback FROM (SELECT 'direct' AS section, * FROM s WHERE cat IN (0, 1, 2) UNION ALL SELECT 'restraint', * FROM s WHERE cat IN (3, 4)) GROUP BY 1""")
def n9_over_verification(spark, sf_dir):
    """Texts with a phrase of over-verification, summed over two sets of categories."""
    t = F.lower("text")
    fail = (F.col("text") != "") & reduce(Column.__or__, (F.contains(t, F.lit(p)) for p in _PHRASES))
    c = table(spark, sf_dir, "conversations").groupBy((F.col("turn") % 5).alias("cat")).agg(F.count("*").alias("n"), F.count_if(fail).alias("fail"), F.count_if(F.col("role") == "system").alias("fallback"))
    return c.groupBy(F.when(F.col("cat").isin(0, 1, 2), "direct").otherwise("restraint").alias("section")).agg(*(F.sum(k).alias(k) for k in ("n", "fail", "fallback")))


@query(f"WITH {_SCORED} SELECT domain, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (tvs < 0.3 AND mkr >= 0.52) AS BIGINT) AS eligible FROM r GROUP BY 1")
def d7_eligible_by_domain(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), F.count_if(S.eligible(F.col("tvs"), F.col("mkr"))).alias("eligible"))
