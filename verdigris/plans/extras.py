"""Further queries: approximate search, gates, flags and profile constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris import vocab
from verdigris.functions import scoring as S
from verdigris.functions import text as T
from verdigris.operators import ann
from verdigris.operators import vectors as V
from verdigris.plans.base import registrar, table
from verdigris.plans.flagship import _SIMS, _library
from verdigris.plans.scores import _SCORED, routed, scored, _ROUTED
from verdigris.plans.texts import _has
from verdigris.session import scratch

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)


@query()
def e4_ivf_search(spark, sf_dir):
    """Approximate top five over all vectors by quantised codes; the model is fitted, so a test measures the recall instead of SQL."""
    queries, library, _ = _library(spark, sf_dir)
    model = ann.fitted(library)
    return ann.approximate_top_k(queries, library, ann.encoded(library, model), model, 5).select("query_id", "rank", "vec_id", "score")


@query()
def e5_recall_of_approximate_search(spark, sf_dir):
    """Share of each query's exact top ten that the approximate search finds."""
    queries, library, _ = _library(spark, sf_dir)
    model = ann.fitted(library)
    return V.recall(V.nearest(queries, library, 10), ann.approximate_top_k(queries, library, ann.encoded(library, model), model, 10))


@query("""WITH p AS (SELECT vec_id % 4 AS part, count(*) AS rows, sum(vec_id) AS ids FROM embeddings GROUP BY 1) SELECT CAST(part AS INTEGER) AS part, rows, CAST(ids AS BIGINT) AS ids, (SELECT count(*) FROM embeddings) AS merged, TRUE AS resumed FROM p""")
def a11_index_build(spark, sf_dir):
    """An index built in four parts that stops after two and goes on: each part's rows in the merged table."""
    vectors, path = table(spark, sf_dir, "embeddings"), scratch(spark, "index")
    first = ann.build(vectors, path, parts=4, stop_after=2)
    rest = ann.build(vectors, path, parts=4)
    resumed = first["built"] == [0, 1] and rest["built"] == [2, 3] and not rest["fitted"]
    codes, _ = ann.opened(spark, path)
    found = codes.groupBy((F.col("vec_id") % 4).cast("int").alias("part")).agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))
    return ann.progress(spark, path).join(found, "part").filter("n = rows").select("part", "rows", "ids", F.lit(codes.count()).alias("merged"), F.lit(resumed).alias("resumed"))


@query(f"WITH {_SIMS}, r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sims WHERE label % 2 = 1) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 3")
def e7_curated_search(spark, sf_dir):
    """The best of the curated part (labels of odd numbers)."""
    queries, library, _ = _library(spark, sf_dir)
    return V.nearest(queries, library.filter("label % 2 = 1"), 3).select("query_id", "rank", "vec_id", "score")


@query(f"SELECT conv_id, turn, regexp_matches(text, '[A-Z]{{2,}}|[0-9]') OR {_has(('for',))} OR role = 'system' AS consult FROM conversations")
def e10_reference_gate(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (t.rlike("[A-Z]{2,}|[0-9]") | vocab.has(t, ("for",)) | (F.col("role") == "system")).alias("consult"))


_SETTINGS = """s AS (SELECT user_id, setting, arg_max(value, (ts, event_id)) AS value FROM (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'BOX_A' WHEN 'view' THEN 'BOX_B' WHEN 'error' THEN 'BOX_S' WHEN 'signup' THEN 'BOX_KIWIX' WHEN 'purchase' THEN 'BOX_W' END AS setting,
CASE WHEN value < 10 THEN ' No ' WHEN value < 20 THEN 'off' WHEN value < 30 THEN 'maybe' WHEN value < 60 THEN 'TRUE' ELSE '0' END AS value FROM events) GROUP BY ALL)"""


@query(f"""WITH {_SETTINGS}, k AS (SELECT user_id, setting, CASE WHEN lower(trim(value)) IN ('0', 'false', 'no', 'off') THEN FALSE WHEN lower(trim(value)) IN ('1', 'true', 'yes', 'on') THEN TRUE END AS flag FROM s)
SELECT user_id, box, coalesce((SELECT flag FROM k WHERE k.user_id = u.user_id AND k.setting = a.own), (SELECT flag FROM k WHERE k.user_id = u.user_id AND k.setting = a.older), TRUE) AS enabled FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('0', 'BOX_0', NULL), ('A', 'BOX_A', NULL), ('B', 'BOX_W', 'BOX_B'), ('S', 'BOX_S', NULL), ('K', 'BOX_KIWIX', NULL)) AS a(box, own, older)""")
def e27_box_flags(spark, sf_dir):
    """Each user's boxes, by the user's latest event of a type as the setting of that name."""
    setting = S.first_match([(F.col("event_type") == e, s) for e, s in (("click", "BOX_A"), ("view", "BOX_B"), ("error", "BOX_S"), ("signup", "BOX_KIWIX"), ("purchase", "BOX_W"))], F.lit(None).cast("string"))
    value = S.first_match([(F.col("value") < 10, " No "), (F.col("value") < 20, "off"), (F.col("value") < 30, "maybe"), (F.col("value") < 60, "TRUE")], "0")
    latest = table(spark, sf_dir, "events").groupBy("user_id", setting.alias("setting")).agg(F.max_by(value, F.struct("ts", "event_id")).alias("value"))
    return V.box_flags(latest, "user_id")


@query(f"WITH {_ROUTED}, n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, turn, concat_ws(',', CASE WHEN n < 3 THEN 'cold_start' END, CASE WHEN route = 'ask' AND n < 5 THEN 'few_questions' END, CASE WHEN turn = 0 THEN 'no_carryover' END) AS constraints FROM routed JOIN n USING (conv_id)")
def d36_cold_start_constraints(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    r = routed(spark, sf_dir).join(n, "conv_id")
    return r.select("conv_id", "turn", F.array_join(S.codes([(F.col("n") < 3, "cold_start"), ((F.col("route") == "ask") & (F.col("n") < 5), "few_questions"), (F.col("turn") == 0, "no_carryover")]), ",").alias("constraints"))
