"""Folds, memory stores, lifecycles, and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdigris import vocab
from verdigris.functions import scoring as S
from verdigris.functions import text as T
from verdigris.operators import folds, stores
from verdigris.operators import statistics as St
from verdigris.plans.base import registrar, table
from verdigris.plans.texts import _has
from verdigris.session import scratch

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

_FOLD = """st AS (SELECT user_id AS session_id, event_id AS seq, ts, CAST(0.37 AS DOUBLE) * least(CAST(1 AS DOUBLE), value / 150) AS pi, CAST(CASE WHEN event_type = 'error' THEN 0.1 ELSE 0 END AS DOUBLE) AS fresh FROM events),
nu AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM st), f AS (SELECT session_id, n, seq, pi, fresh FROM nu)"""
_PHI = f"""WITH RECURSIVE {_FOLD}, c AS (SELECT session_id, n, seq, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(0.2 AS DOUBLE) + CAST(0.3 AS DOUBLE) * least(CAST(1 AS DOUBLE), pi / CAST(0.37 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * fresh - CAST(0.1 AS DOUBLE) * least(CAST(1 AS DOUBLE), n / CAST(10 AS DOUBLE)))) AS phi FROM f WHERE n = 1
UNION ALL SELECT f.session_id, f.n, f.seq, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), c.phi + CAST(0.3 AS DOUBLE) * least(CAST(1 AS DOUBLE), pi / CAST(0.37 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * fresh - CAST(0.1 AS DOUBLE) * least(CAST(1 AS DOUBLE), f.n / CAST(10 AS DOUBLE)))) FROM c JOIN f ON f.session_id = c.session_id AND f.n = c.n + 1),
b AS (SELECT session_id, seq, round(phi, 9) AS phi, CASE WHEN phi <= 0.30 THEN 'answer' WHEN phi <= 0.60 THEN 'self_check' WHEN phi <= 0.90 THEN 'verify' ELSE 'ask_abstain' END AS band FROM c)"""


def steps(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (0.37 * F.least(F.lit(1.0), F.col("value") / 150)).alias("pi"), F.when(F.col("event_type") == "error", 0.1).otherwise(0.0).alias("fresh"))


@query(f"{_PHI} SELECT * FROM b")
def f1_controller(spark, sf_dir):
    from verdigris.session import ship

    ship(spark)
    return folds.controlled(steps(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions")), 20).withColumn("phi", F.round("phi", 9))


@query(f"{_PHI} SELECT * FROM b")
def f1_controller_long_sessions(spark, sf_dir):
    from verdigris.session import ship

    ship(spark)
    return folds.controller_long(steps(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("phi", F.round("phi", 9))


_TOKENS = "tk AS (SELECT conv_id AS session, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS token, role = 'user' AS explicit FROM conversations)"


@query(f"""WITH {_TOKENS}, g AS (SELECT session, token, list(explicit ORDER BY turn) AS e FROM tk GROUP BY ALL), w AS (SELECT session, token, list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(e, lambda x, k: CASE WHEN k > 1 THEN CAST(0.30 AS DOUBLE) ELSE 0 END + CASE WHEN x THEN CAST(0.15 AS DOUBLE) ELSE 0 END)), lambda a, x: least(CAST(2 AS DOUBLE), a * CAST(0.85 AS DOUBLE) + CAST(0.55 AS DOUBLE) + x)) AS w FROM g)
SELECT session, token, round(w, 9) AS weight, w >= 0.58 AS active FROM w""")
def f2_theme_weights(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = c.select(F.col("conv_id").alias("session"), "turn", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0))).alias("token"), (F.col("role") == "user").alias("explicit"))
    return folds.themes(t).withColumn("weight", F.round("weight", 9))


@query(f"""WITH g AS (SELECT conv_id, list(CASE WHEN {_has(('was', 'with', 'for'))} THEN CAST(1 AS DOUBLE) ELSE 0 END ORDER BY turn) AS v, count(*) AS n FROM conversations GROUP BY 1), e AS (SELECT conv_id, n, list_reduce(list_prepend(CAST(0.5 AS DOUBLE), v), lambda a, x: CAST(0.75 AS DOUBLE) * a + CAST(0.25 AS DOUBLE) * x) AS e FROM g)
SELECT conv_id, round(e, 9) AS abstraction, n < 3 AS cold_start, CASE WHEN n < 3 THEN 'cold' WHEN e >= 0.55 AND n >= 5 THEN 'promotable' ELSE 'wait' END AS checkpoint FROM e""")
def f2_user_map(spark, sf_dir):
    v = F.when(vocab.has(F.col("text"), vocab.PROBE_VOLATILE), 1.0).otherwise(0.0)
    e = folds.ema(table(spark, sf_dir, "conversations"), "conv_id", "turn", v, 0.75, 0.5)
    return e.select("conv_id", F.round("ema", 9).alias("abstraction"), (F.col("n") < 3).alias("cold_start"), S.first_match([(F.col("n") < 3, "cold"), ((F.col("ema") >= 0.55) & (F.col("n") >= 5), "promotable")], "wait").alias("checkpoint"))


@query("""WITH k AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS run FROM i)
SELECT user_id, event_id, CAST(run AS INTEGER) AS run FROM r WHERE run >= 2""")
def f7_n15_confirmations(spark, sf_dir):
    return folds.runs(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type")).filter("run >= 2").select("user_id", "event_id", "run")


@query("""WITH p AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN -1 WHEN value > 100 THEN 1 ELSE 0 END AS layer FROM events),
b AS (SELECT user_id, event_id, CASE WHEN layer = 1 AND row_number() OVER (PARTITION BY user_id, layer ORDER BY event_id DESC) <= 5 THEN 2 ELSE layer END AS before FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, before >= 0 ORDER BY event_id DESC, before DESC) AS r FROM b)
SELECT user_id, event_id, before, CASE WHEN before < 0 THEN -1 WHEN r <= 5 THEN 2 ELSE 1 END AS layer FROM r""")
def f10_layers(spark, sf_dir):
    """Two rounds of a user's layers: noise and values over 100 are due in the first (before), all others in the second (layer)."""
    noise = F.col("event_type") == "error"
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.lit(0).alias("layer"))
    first = stores.layered(e, "user_id", F.desc("event_id"), noise, noise | (F.col("value") > 100)).withColumn("before", F.col("layer"))
    return stores.layered(first, "user_id", F.desc("event_id"), noise, F.lit(True)).select("user_id", "event_id", "before", "layer")


@query("""WITH k AS (SELECT user_id, event_id, event_type, value, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS run FROM i)
SELECT user_id, event_id, CAST(run AS INTEGER) AS run, event_type <> 'view' AND least(CAST(1 AS DOUBLE), value / 40) >= 0.65 AS promoted FROM r WHERE run >= 2""")
def f7_auto_promotion(spark, sf_dir):
    """Two or more confirmations of one signal; promoted with confidence of 0.65 and an adopted frame (anything but a view)."""
    r = folds.runs(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type")).filter("run >= 2")
    sure = F.least(F.lit(1.0), F.col("value") / 40) >= 0.65
    return r.select("user_id", "event_id", "run", ((F.col("event_type") != "view") & sure).alias("promoted"))


@query("""WITH c AS (SELECT source, doc_id, text, string_split(text, '') AS c FROM documents), g AS (SELECT source, doc_id, text, CASE WHEN len(c) < 3 THEN [] ELSE list_distinct(list_transform(range(1, len(c) - 1), lambda k: c[k] || c[k + 1] || c[k + 2])) END AS g FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM g),
m AS (SELECT a.doc_id, max(len(list_intersect(a.g, b.g)) / nullif(CAST(len(list_distinct(list_concat(a.g, b.g))) AS DOUBLE), 0)) AS j FROM o a LEFT JOIN o b ON a.source = b.source AND b.r BETWEEN a.r - 10 AND a.r - 1 AND least(len(a.g), len(b.g)) > 0.85 * greatest(len(a.g), len(b.g)) GROUP BY 1)
SELECT doc_id, coalesce(j > 0.85, FALSE) OR length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) <= 2 OR starts_with(text, '[ERROR') OR starts_with(text, 'Sure,') OR starts_with(text, 'Of course') AS rejected FROM m JOIN o USING (doc_id)""")
def j6_lint_against_recent(spark, sf_dir):
    """Too short, boilerplate, or 3-gram Jaccard over 0.85 with one of the ten before, of whole texts.

    The Jaccard is at most the ratio of the set sizes, so only texts of like size are compared.
    """
    near = lambda a, b: F.least(a, b) / F.nullif(F.greatest(a, b), F.lit(0)) > 0.85
    d = table(spark, sf_dir, "documents")
    # The grams of a text are found once, as hashes; only their number goes through the window.
    grams = d.select("source", "doc_id", F.transform(F.array_distinct(T.all_grams(F.col("text"), 3)), lambda g: F.xxhash64(g)).alias("g"))
    path = scratch(spark, "grams")
    grams.withColumn("n", F.size("g")).write.parquet(path)
    grams = spark.read.parquet(path)
    sizes = St.with_context(grams.select("source", "doc_id", "n"), "source", "doc_id", 10)
    w = Window.partitionBy("source", "__block").orderBy("doc_id").rowsBetween(-10, -1)
    recent = F.filter(F.collect_list(F.struct("n", "doc_id")).over(w), lambda x: near(x["n"], F.col("n")))
    pairs = sizes.withColumn("recent", recent).filter("__own").select("doc_id", F.col("n").alias("size"), F.explode("recent").alias("r")).select("doc_id", "size", F.col("r.doc_id").alias("other"), F.col("r.n").alias("m"))
    both = pairs.join(grams.select("doc_id", "g"), "doc_id").join(grams.select(F.col("doc_id").alias("other"), F.col("g").alias("before")), "other")
    # Shared / all > 0.85 in whole numbers, with all = sizes - shared.
    alike = both.filter(185 * F.size(F.array_intersect("g", "before")) > 85 * (F.col("size") + F.col("m"))).select("doc_id").distinct().withColumn("similar", F.lit(True))
    short = F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) <= 2
    boilerplate = F.col("text").startswith("[ERROR") | F.col("text").startswith("Sure,") | F.col("text").startswith("Of course")
    return d.join(alike, "doc_id", "left").select("doc_id", F.coalesce(short | boilerplate | F.coalesce("similar", F.lit(False)), F.lit(False)).alias("rejected"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), q AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'rejected' END AS judgment, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events, n WHERE NOT now - ts > INTERVAL 6 HOUR)
SELECT user_id, CAST(count(*) AS BIGINT) AS kept, bool_or(judgment = 'rejected') AS has_rejected FROM q WHERE r <= 4 GROUP BY 1""")
def t1_quarantine_ring(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    fresh = e.join(F.broadcast(now)).filter("not (now - ts > interval 6 hours)").withColumn("judgment", F.when(F.col("event_type").isin("click", "view", "purchase"), F.col("event_type")).otherwise("rejected"))
    return folds.ring(fresh, "user_id", [F.desc("ts"), F.desc("event_id")], 4).groupBy("user_id").agg(F.count("*").alias("kept"), F.bool_or(F.col("judgment") == "rejected").alias("has_rejected"))


@query("""WITH k AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM k)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY ALL""")
def t2_debounce(spark, sf_dir):
    return folds.sessions_by_gap(table(spark, sf_dir, "events"), "user_id", "ts", "1 hour", "event_id").select("user_id", "session", "n")


@query("WITH c AS (SELECT user_id AS pattern, count(*) AS hits, max(event_id) AS last FROM events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT user_id, count(*), max(event_id) FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT pattern, CAST(sum(hits) AS BIGINT) AS hits, max(last) AS last FROM c GROUP BY 1")
def t5_m7_hit_flush(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    part = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("pattern")).agg(F.count("*").alias("hits"), F.max("event_id").alias("last"))
    return stores.flushed(part(0), part(1), "pattern")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents WHERE n_chars > 512) WHERE r <= 256")
def t6_bounded_queue(spark, sf_dir):
    """What is above 512 characters is deferred; each source's queue keeps its latest 256."""
    return folds.ring(table(spark, sf_dir, "documents").filter("n_chars > 512"), "source", [F.desc("doc_id")], 256).select("source", "doc_id")


@query("WITH n AS (SELECT max(ts) AS now FROM events), a AS (SELECT event_id, CAST(date_diff('day', CAST(ts AS DATE), CAST(now AS DATE)) AS INTEGER) AS age, CASE event_type WHEN 'click' THEN 7 WHEN 'view' THEN 9 ELSE 12 END AS lim FROM events, n) SELECT event_id, CASE WHEN age > 2 * lim THEN 'stale' WHEN age > lim THEN 'aging' ELSE 'fresh' END AS state FROM a")
def t7_staleness(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    aged = e.join(F.broadcast(e.agg(F.max("ts").alias("now")))).withColumn("age", F.datediff(F.to_date("now"), F.to_date("ts")))
    limit = S.first_match([(F.col("event_type") == "click", 7), (F.col("event_type") == "view", 9)], 12)
    return aged.select("event_id", stores.staleness(F.col("age"), limit).alias("state"))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t9_tumbling_windows(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n", "total")


@query("WITH p AS (SELECT doc_id, count(*) FILTER (length(reason) >= 10) AS added FROM (SELECT doc_id % 100 AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'short' ELSE 'long enough reason' END AS reason FROM documents WHERE doc_id % 7 = 0) GROUP BY 1) SELECT d.doc_id, CAST(coalesce(added, 0) AS BIGINT) AS proposals, CASE WHEN added > 0 THEN 'deletion_proposed' ELSE 'active' END AS status FROM documents d LEFT JOIN p USING (doc_id)")
def m1_m6_deletion_proposals(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    store = d.select("doc_id", F.lit(0).cast("long").alias("proposals"), F.lit("active").alias("status"))
    asked = d.filter("doc_id % 7 = 0").select((F.col("doc_id") % 100).alias("doc_id"), F.when(F.col("doc_id") % 3 == 0, "short").otherwise("long enough reason").alias("reason"))
    return stores.proposed(store, asked, "doc_id")


@query("WITH s AS (SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0), c AS (SELECT doc_id, 'new' AS source FROM documents WHERE doc_id % 3 = 0) SELECT * FROM s WHERE doc_id NOT IN (SELECT doc_id FROM c) UNION ALL SELECT * FROM c")
def m2_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return stores.upserted(d.filter("doc_id % 2 = 0").select("doc_id", "source"), d.filter("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("source")), "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id < (SELECT count(*) FROM documents) THEN 'removed' ELSE 'missing' END AS outcome FROM documents WHERE doc_id % 5 = 0")
def m2_removal_log(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return stores.removal_log(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 5 = 0").select("doc_id"), "doc_id")


@query("SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'general' WHEN 'de' THEN 'law' ELSE '' END AS sub_topic FROM documents")
def m5_migration(spark, sf_dir):
    mapping = spark.createDataFrame([("en", "general"), ("de", "law")], "lang string, sub_topic string")
    return stores.migrated(table(spark, sf_dir, "documents").select("doc_id", "lang"), mapping, "lang").select("doc_id", "lang", "sub_topic")
