"""Pattern matching by vectors (the flagship) and the queries built on similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import vectors as V
from verdigris.plans.base import registrar, table

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

_DOT = "list_reduce(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)), lambda s, y: s + y)"
#: One division and square root, as the Spark side has them.
_COS = "(" + _DOT + " / CASE WHEN {na} * {nb} = 0 THEN 1.0 ELSE {na} * {nb} END)"


def _norm(a: str) -> str:
    return "sqrt(" + _DOT.format(a=a, b=a) + ")"


_SIMS = f"""
v AS (SELECT vec_id, embedding AS x, label, {_norm('embedding')} AS n FROM embeddings),
q AS (SELECT vec_id AS query_id, x, n, label AS query_label FROM v WHERE vec_id % 10 = 0),
lib AS (SELECT vec_id, x, n, label FROM v),
neg AS (SELECT vec_id, x, n, (label + 1) % 10 AS label FROM v WHERE vec_id % 10 = 9),
sims AS (SELECT query_id, query_label, lib.vec_id, lib.label, {_COS.format(a='q.x', b='lib.x', na='q.n', nb='lib.n')} AS score FROM q JOIN lib ON q.query_id <> lib.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sims),
nsims AS (SELECT query_id, neg.label, max({_COS.format(a='q.x', b='neg.x', na='q.n', nb='neg.n')}) AS negative FROM q, neg GROUP BY ALL)
"""
_POOL = "pool AS (SELECT query_id, label, max(score) AS score, arg_min(vec_id, rank) AS best FROM ranked WHERE rank <= 20 GROUP BY ALL)"


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    queries = v.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("query_label"))
    library = v.select("vec_id", "embedding", "label")
    negatives = v.filter("vec_id % 10 = 9").select("vec_id", "embedding", ((F.col("label") + 1) % 10).alias("label"))
    return queries, library, negatives


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    queries, library, _ = _library(spark, sf_dir)
    return V.nearest(queries, library, k)


def _by_label(spark: SparkSession, sf_dir: str, negative: bool = False) -> DataFrame:
    """The best vector of each label, or of each label's negatives, for each query."""
    queries, library, negatives = _library(spark, sf_dir)
    return V.best_by_label(queries, negatives if negative else library)


#: What the pattern library knows of its patterns (labels), and its thresholds by topic and sub-topic.
_PATTERNS = "SELECT label, label % 3 AS topic, label % 4 AS sub, label * 37 % 5 AS priority, label % 7 = 6 AS deprecated, label % 5 = 0 AS required, CASE WHEN label % 4 = 1 THEN ['t1', 't2'] WHEN label % 4 = 2 THEN ['t9'] ELSE [] END AS excluded FROM (SELECT DISTINCT label FROM embeddings)"
_LEVELS = ((0, None, 0.40, 0.34), (1, None, 0.38, 0.30), (None, 1, 0.36, None), (None, 2, None, 0.25))


def patterns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("label")
    excluded = F.when(k % 4 == 1, F.array(F.lit("t1"), F.lit("t2"))).when(k % 4 == 2, F.array(F.lit("t9"))).otherwise(F.array().cast("array<string>"))
    found = table(spark, sf_dir, "embeddings").select(k.cast("long").alias("label")).distinct()
    levels = spark.createDataFrame(_LEVELS, "topic long, sub long, high double, medium double")
    return found.select("label", (k % 3).alias("topic"), (k % 4).alias("sub"), (k * 37 % 5).alias("priority"), (k % 7 == 6).alias("deprecated"), (k % 5 == 0).alias("required"), excluded.alias("excluded")), levels


@query(f"""WITH {_SIMS}, {_POOL}, pat AS ({_PATTERNS}), lev AS (SELECT * FROM (VALUES (0, NULL, 0.40, 0.34), (1, NULL, 0.38, 0.30), (NULL, 1, 0.36, NULL), (NULL, 2, NULL, 0.25)) AS t(topic, sub, high, medium)),
known AS (SELECT pat.*, CAST(coalesce(s.high, t.high, 0.999) AS DOUBLE) AS high, CAST(coalesce(s.medium, t.medium, 0.999) AS DOUBLE) AS medium FROM pat LEFT JOIN lev s ON s.sub = pat.sub LEFT JOIN lev t ON t.topic = pat.topic WHERE NOT deprecated),
clear AS (SELECT pool.* FROM pool LEFT JOIN nsims USING (query_id, label) WHERE negative IS NULL OR score - negative >= 0.05),
fit AS (SELECT clear.*, priority, high, medium FROM clear JOIN known USING (label) WHERE NOT (required AND query_id % 30 = 0) AND NOT list_has_any(excluded, CASE WHEN query_id % 20 = 0 THEN ['t2'] ELSE [] END)),
banded AS (SELECT *, CASE WHEN score > high THEN 2 WHEN score > medium THEN 1 END AS band FROM fit),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY band DESC, CASE WHEN band = 2 THEN priority ELSE 0 END DESC, score DESC, label DESC) AS r FROM banded WHERE band IS NOT NULL)
SELECT q.query_id, CASE band WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'none' END AS confidence, best.label AS pattern, best.score, CASE WHEN band = 1 THEN 'LOW_CONFIDENCE' END AS warning FROM q LEFT JOIN best ON q.query_id = best.query_id AND r = 1""")
def e17_pattern_match(spark, sf_dir):
    """One query in thirty has no session state, one in twenty has a tag that some patterns exclude."""
    queries, library, negatives = _library(spark, sf_dir)
    tags = F.when(F.col("query_id") % 20 == 0, F.array(F.lit("t2"))).otherwise(F.array().cast("array<string>"))
    return V.pattern_match(queries.withColumns({"has_state": F.col("query_id") % 30 != 0, "tags": tags}), library, negatives, *patterns(spark, sf_dir), pool=20, margin=0.05)


@query(f"WITH {_SIMS} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5")
def e1_top_k(spark, sf_dir):
    return _ranked(spark, sf_dir, 5).select("query_id", "rank", "vec_id", "score")


@query(f"""WITH {_SIMS}, hit AS (SELECT * FROM ranked WHERE rank <= 5 AND score >= 0.25)
SELECT q.query_id, count(vec_id) > 0 AS sufficient, CAST(count(vec_id) AS BIGINT) AS hits, coalesce(string_agg(CAST(label AS VARCHAR), ',' ORDER BY rank), '') AS sources
FROM q LEFT JOIN hit USING (query_id) GROUP BY 1""")
def e2_retrieval_sufficiency(spark, sf_dir):
    hits = _ranked(spark, sf_dir, 5).filter("score >= 0.25")
    found = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("label").cast("string").alias("label")))), lambda s: s["label"]), ",").alias("sources"))
    return _library(spark, sf_dir)[0].select("query_id").join(found, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) > 0).alias("sufficient"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.coalesce("sources", F.lit("")).alias("sources"))


@query(f"""WITH {_SIMS}, hit AS (SELECT query_id, rank, vec_id, greatest(0.0, least(1.0, score)) AS score FROM ranked WHERE rank <= 8 AND score > 0.3)
SELECT q.query_id, CASE WHEN count(vec_id) = 0 THEN 'failed' WHEN count(vec_id) < 8 THEN 'partial' ELSE 'success' END AS outcome, CAST(count(vec_id) AS BIGINT) AS n, max(score) AS top
FROM q LEFT JOIN hit USING (query_id) GROUP BY 1""")
def e3_clipped_search(spark, sf_dir):
    hits = _ranked(spark, sf_dir, 8).filter("score > 0.3").withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))
    return _library(spark, sf_dir)[0].select("query_id").join(hits, "query_id", "left").groupBy("query_id").agg(F.when(F.count("vec_id") == 0, "failed").when(F.count("vec_id") < 8, "partial").otherwise("success").alias("outcome"), F.count("vec_id").alias("n"), F.max("score").alias("top"))


@query(f"WITH {_SIMS} SELECT query_id, max(score) AS score, max(score) >= 0.35 AS sufficient FROM ranked WHERE rank <= 5 GROUP BY 1")
def e6_sufficiency_score(spark, sf_dir):
    return _ranked(spark, sf_dir, 5).groupBy("query_id").agg(F.max("score").alias("score"), (F.max("score") >= 0.35).alias("sufficient"))


@query(f"""WITH {_SIMS}, t AS (SELECT * FROM ranked WHERE rank <= 9), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS kept FROM t WHERE label % 3 <> 0)
SELECT query_id, CAST(kept AS INTEGER) AS rank, vec_id, score FROM f WHERE kept <= 3""")
def e14_filter_after_overfetch(spark, sf_dir):
    return V.overfetch(_ranked(spark, sf_dir, 9), F.col("label") % 3 != 0, 3).select("query_id", "rank", "vec_id", "score")


@query(f"WITH {_SIMS} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 4 AND score >= 0.3")
def e15_context_search(spark, sf_dir):
    return V.overfetch(_ranked(spark, sf_dir, 4), F.col("score") >= 0.3, 2 * 2).select("query_id", "rank", "vec_id", "score")


@query(f"""WITH {_SIMS}, t AS (SELECT query_id, vec_id, CASE WHEN label = 3 THEN score * 0.5 ELSE score END AS score FROM ranked WHERE rank <= 6), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM t)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 3""")
def e16_demotion(spark, sf_dir):
    return V.demoted(_ranked(spark, sf_dir, 6), F.col("label") == 3, 0.5, 3).select("query_id", "rank", "vec_id", "score")


@query("""WITH t AS (SELECT * FROM (VALUES (0, 1, 0.5), (0, 2, 0.6), (1, NULL, 0.7)) AS t(topic, sub, threshold)), k AS (SELECT DISTINCT label % 3 AS topic, label % 4 AS sub FROM embeddings)
SELECT CAST(k.topic AS INTEGER) AS topic, CAST(k.sub AS INTEGER) AS sub, CAST(coalesce(s.threshold, m.threshold, 0.999) AS DOUBLE) AS threshold FROM k LEFT JOIN t s ON s.topic = k.topic AND s.sub = k.sub LEFT JOIN t m ON m.topic = k.topic AND m.sub IS NULL""")
def e18_threshold_resolution(spark, sf_dir):
    levels = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.6), (1, None, 0.7)], "topic int, sub int, threshold double")
    keys = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("topic"), (F.col("label") % 4).alias("sub")).distinct()
    return V.thresholds(keys, levels).select(F.col("topic").cast("int"), F.col("sub").cast("int"), "threshold")


@query(f"""WITH {_SIMS}, {_POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY label % 3 DESC, score DESC, label DESC) AS r FROM pool WHERE score > 0.2)
SELECT query_id, label, score FROM r WHERE r = 1""")
def e19_conflict_resolution(spark, sf_dir):
    pool = V.max_pool(_ranked(spark, sf_dir, 20)).filter("score > 0.2")
    best = pool.groupBy("query_id").agg(F.max(F.struct((F.col("label") % 3).alias("priority"), "score", "label")).alias("b"))
    return best.select("query_id", "b.label", "b.score")


@query("""SELECT label, CAST(label % 4 = 1 AS BOOLEAN) AS excluded, CASE WHEN label % 4 = 1 THEN FALSE WHEN label % 5 = 0 THEN label % 10 = 0 ELSE TRUE END AS compatible FROM (SELECT DISTINCT label FROM embeddings)""")
def e20_context_compatibility(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    excluded = F.when(F.col("label") % 4 == 1, F.array(F.lit("t1"), F.lit("t2"))).otherwise(F.array(F.lit("t9")))
    state = F.array(F.lit("t2"))
    required, have = F.when(F.col("label") % 5 == 0, F.lit("s")), F.when(F.col("label") % 10 == 0, F.lit("s"))
    return labels.select("label", F.arrays_overlap(excluded, state).alias("excluded"), V.compatible(excluded, state, required, have).alias("compatible"))


@query(f"WITH {_SIMS}, {_POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS r FROM pool) SELECT query_id, label, best AS vec_id, score FROM r WHERE r <= 5")
def e21_semantic_pattern_search(spark, sf_dir):
    return V.best_patterns(_ranked(spark, sf_dir, 20), 5)


@query(f"""WITH {_SIMS}, n AS (SELECT * FROM ranked WHERE rank <= 3), c AS (SELECT query_id, label, count(*) AS votes, min(rank) AS nearest FROM n GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, nearest) AS r FROM c)
SELECT r.query_id, r.label AS predicted, n.score AS confidence, n.score >= 0.35 AS confident FROM r JOIN n ON n.query_id = r.query_id AND n.rank = 1 WHERE r = 1""")
def e22_knn_vote(spark, sf_dir):
    return V.knn_vote(_ranked(spark, sf_dir, 3), 0.35)


@query("""WITH h AS (SELECT doc_id // 50 AS query_id, doc_id, lower(lang) AS title, n_chars / 40000.0 AS score, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS pos, source FROM documents),
m AS (SELECT query_id, doc_id, title, score, pos, 0 AS src FROM h WHERE source <> 'src1'), c AS (SELECT query_id, doc_id, title, score, pos, 1 AS src FROM h WHERE source = 'src1'),
u AS (SELECT * FROM m UNION ALL SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = c.query_id AND m.title = c.title)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src, pos) AS rank FROM u)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, src = 1 AS curated FROM r WHERE rank <= 5""")
def e8_curated_merge(spark, sf_dir):
    from pyspark.sql import Window

    hits = table(spark, sf_dir, "documents").select(F.expr("doc_id div 50").alias("query_id"), "doc_id", F.lower("lang").alias("title"), (F.col("n_chars") / 40000.0).alias("score"), "source")
    hits = hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return V.merged(hits.filter("source != 'src1'").drop("source"), hits.filter("source = 'src1'").drop("source"), 5).select("query_id", "rank", "doc_id", "curated")


@query("""WITH h AS (SELECT page_id // 40 AS query_id, page_id, 1.0 / (1 + page_id % 7) + CASE WHEN url LIKE '%blog%' THEN 0.08 ELSE 0 END + CASE WHEN html LIKE '%the%' THEN 0.04 ELSE 0 END AS score, page_id % 7 AS pos FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, page_id) AS rank FROM h) SELECT query_id, CAST(rank AS INTEGER) AS rank, page_id FROM r""")
def e9_domain_rerank(spark, sf_dir):
    hits = table(spark, sf_dir, "pages").select(F.expr("page_id div 40").alias("query_id"), "page_id", (F.lit(1.0) / (1 + F.col("page_id") % 7)).alias("score"), (F.col("page_id") % 7).alias("pos"), "url", "html")
    return V.reranked(hits, F.contains("url", F.lit("blog")), F.contains("html", F.lit("the")), "page_id").select("query_id", "rank", "page_id")


@query("""WITH h AS (SELECT doc_id // 30 AS query_id, doc_id, (source = 'src1') AS token_hit, (lang = 'de') AS text_hit, (doc_id % 100) / 100.0 AS quality FROM documents),
c AS (SELECT *, CASE WHEN token_hit THEN 0 ELSE 1 END AS way FROM h WHERE (token_hit OR text_hit) AND quality >= 0.6),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY way, doc_id) AS r FROM c), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, doc_id) AS rank FROM k WHERE r <= 4)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, max(quality) OVER (PARTITION BY query_id) < 0.9 AS low_confidence FROM s""")
def e11_reference_consult(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 30").alias("query_id"), "doc_id", (F.col("source") == "src1").alias("token_hit"), (F.col("lang") == "de").alias("text_hit"), (F.col("doc_id") % 100 / 100.0).alias("quality"))
    return V.consulted(d, k=4, floor=0.6, weak=0.9)


@query("""WITH c AS (SELECT doc_id // 20 AS query_id, doc_id, doc_id % 4 AS cues, n_chars % 97 / CAST(100 AS DOUBLE) AS score FROM documents), m AS (SELECT *, max(cues) OVER (PARTITION BY query_id) AS best FROM c)
SELECT query_id, doc_id, score + CASE WHEN cues >= 2 THEN 0.12 WHEN cues = 1 THEN 0.06 WHEN best >= 2 THEN -0.04 ELSE 0 END::DOUBLE AS score FROM m""")
def e12_cue_disambiguation(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.expr("doc_id div 20").alias("query_id"), "doc_id", (F.col("doc_id") % 4).alias("cues"), (F.col("n_chars") % 97 / F.lit(100.0)).alias("score"))
    return V.cue_adjusted(c).select("query_id", "doc_id", "score")


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}'))) AS term FROM documents), f AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS r FROM t)
SELECT term, doc_id, CAST(r AS INTEGER) AS rank FROM f WHERE r <= 3""")
def e13_term_index(spark, sf_dir):
    return V.term_index(table(spark, sf_dir, "documents"), "[a-z]{9,}", 3)


_BOXED = "b AS (SELECT query_id, " + ", ".join(f"max(score) FILTER (label = {k} AND rank <= 20) AS score_{b}" for k, b in enumerate(V.BOXES)) + " FROM ranked GROUP BY 1)"
_OKS = {"M": 0.40, "0": 0.30, "A": 0.36, "B": 0.30, "X": 0.25, "S": 0.20}
_SELECT = f"""{_SIMS}, {_BOXED}, t AS (SELECT query_id, query_id % 20 = 0 AS fresh, query_id % 50 = 10 AS self_ref, query_id % 70 <> 20 AS allow_wiki, query_id % 40 <> 0 AS allow_search, query_id % 90 <> 30 AS on_X, query_id % 80 <> 0 AS on_S, query_id % 60 <> 50 AS on_A, {", ".join(f"score_{b}, coalesce(score_{b} >= {x}, FALSE) AS ok_{b}" for b, x in _OKS.items())} FROM b),
u AS (SELECT *, ok_0 AND (self_ref OR score_0 >= 0.55) AS zero FROM t), w AS (SELECT *, NOT zero AND on_A AND ok_A AS own FROM u), x AS (SELECT *, NOT zero AND NOT own AS after FROM w), y AS (SELECT *, after AND allow_wiki AND ok_B AND NOT fresh AS snap, after AND allow_wiki AND ok_B AND fresh AS held FROM x), z AS (SELECT *, after AND NOT snap AS late, after AND NOT snap AND NOT fresh AND on_X AND ok_X AS curated FROM y), web AS (SELECT *, late AND NOT curated AND on_S AND fresh AND ok_S AS web FROM z),
selected AS (SELECT *, CASE WHEN zero THEN '0' WHEN own THEN 'A' WHEN snap THEN 'B' WHEN curated THEN 'X' WHEN web THEN 'S' WHEN late AND held THEN 'B' ELSE 'failed' END AS box FROM web)"""


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query: the best score in each box (a label of the library), what the profile allows and what is on."""
    pool = V.max_pool(_ranked(spark, sf_dir, 20)).filter(F.col("label") < len(V.BOXES))
    wide = pool.groupBy("query_id").agg(*(F.max(F.when(F.col("label") == k, F.col("score"))).alias(f"score_{b}") for k, b in enumerate(V.BOXES)))
    i = F.col("query_id")
    on = {"M": F.lit(True), "0": F.lit(True), "A": i % 60 != 50, "B": F.lit(True), "X": i % 90 != 30, "S": i % 80 != 0}
    oks = {f"ok_{b}": F.coalesce(F.col(f"score_{b}") >= x, F.lit(False)) for b, x in _OKS.items()}
    asked = _library(spark, sf_dir)[0].select("query_id").join(wide, "query_id", "left")
    return asked.withColumns({"fresh": i % 20 == 0, "self_ref": i % 50 == 10, "allow_wiki": i % 70 != 20, "allow_search": i % 40 != 0, **oks, **{f"on_{b}": c for b, c in on.items()}})


@query(f"""WITH {_SELECT} SELECT query_id, box, box <> 'failed' AS sufficient, CAST(CASE WHEN box = '0' THEN score_0 WHEN box = 'A' THEN score_A WHEN box = 'B' THEN score_B WHEN box = 'X' THEN score_X WHEN box = 'S' THEN score_S ELSE 0 END AS DOUBLE) AS score,
concat_ws(' ', CASE WHEN score_M IS NOT NULL THEN 'M:ok' END, CASE WHEN ok_0 THEN '0:ok' ELSE '0:no' END, CASE WHEN NOT zero THEN CASE WHEN NOT on_A THEN 'A:skipped' WHEN ok_A THEN 'A:ok' ELSE 'A:no' END END, CASE WHEN after THEN CASE WHEN NOT allow_wiki THEN 'B:skipped by profile' WHEN ok_B THEN 'B:ok' ELSE 'B:no' END END, CASE WHEN late THEN 'K:skipped' END,
CASE WHEN late THEN CASE WHEN NOT on_X THEN 'X:skipped' WHEN fresh THEN 'X:skipped, fresh' WHEN ok_X THEN 'X:ok' ELSE 'X:no' END END, CASE WHEN late AND NOT curated AND fresh AND NOT allow_search AND on_S THEN 'S:forced by freshness' END,
CASE WHEN late AND NOT curated THEN CASE WHEN on_S AND fresh THEN CASE WHEN ok_S THEN 'S:ok' ELSE 'S:no' END WHEN NOT fresh AND NOT allow_search THEN 'S:skipped by profile' WHEN NOT on_S THEN 'S:skipped' ELSE 'S:skipped, not fresh' END END, CASE WHEN late AND NOT curated AND NOT web AND held THEN 'B:held over' END) AS trace FROM selected""")
def e25_tiered_selection(spark, sf_dir):
    return V.tier_selection(boxed(spark, sf_dir))


@query(f"""WITH {_SELECT} SELECT query_id, CASE WHEN box <> 'A' THEN 'none' WHEN query_id % 3 = 0 THEN 'not asked' WHEN NOT allow_wiki THEN 'off by profile' WHEN fresh THEN 'off, fresh' ELSE 'consulted' END AS note, CASE WHEN box = 'A' AND query_id % 3 <> 0 AND allow_wiki AND NOT fresh THEN score_B END AS extra FROM selected""")
def e26_supplementary_lookup(spark, sf_dir):
    """After A has decided: what B says, where the profile asks for it; it never decides."""
    rows = boxed(spark, sf_dir)
    said = V.tier_selection(rows).select("query_id", "box").join(rows, "query_id")
    note = V.supplementary(said, F.col("query_id") % 3 != 0)
    return said.select("query_id", note.alias("note"), F.when(note == "consulted", F.col("score_B")).alias("extra"))


@query(f"""WITH v AS (SELECT vec_id, embedding AS x, label, {_norm('embedding')} AS n FROM embeddings), p AS (SELECT a.label AS label_a, b.label AS label_b, a.vec_id AS id_a, b.vec_id AS id_b, {_COS.format(a='a.x', b='b.x', na='a.n', nb='b.n')} AS score FROM v a JOIN v b ON a.label < b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY label_a, label_b ORDER BY score DESC, id_a, id_b) AS r FROM p) SELECT label_a, label_b, id_a, id_b, score FROM r WHERE r = 1 AND score >= 0.4""")
def j2_pattern_conflicts(spark, sf_dir):
    return V.conflicts(table(spark, sf_dir, "embeddings"), 0.4)


@query(f"""WITH {_SIMS}, c AS (SELECT query_id, label, max(score) AS score FROM sims WHERE label <> query_label GROUP BY ALL), m AS (SELECT query_id, score, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label DESC) AS r FROM c) WHERE r = 1)
SELECT query_id, label, score, score >= 0.4 AS conflict FROM m""")
def j1_candidate_conflict(spark, sf_dir):
    own = _library(spark, sf_dir)[0].select("query_id", "query_label")
    best = _by_label(spark, sf_dir).join(own, "query_id").filter("label != query_label").groupBy("query_id").agg(F.max(F.struct("score", "label")).alias("m"))
    return best.select("query_id", "m.label", "m.score", (F.col("m.score") >= 0.4).alias("conflict"))


@query("SELECT a.label AS a, b.label AS b, CASE WHEN a.label % 3 = b.label % 3 THEN 0.92 WHEN a.label % 2 = b.label % 2 THEN 0.92 ELSE 0.95 END::DOUBLE AS threshold FROM (SELECT DISTINCT label FROM embeddings) a, (SELECT DISTINCT label FROM embeddings) b WHERE a.label < b.label")
def j3_relation_threshold(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("label").distinct()
    pairs = x.select(F.col("label").alias("a")).join(F.broadcast(x.select(F.col("label").alias("b"))), F.expr("a < b"))
    return pairs.withColumn("threshold", V.relation_threshold(F.col("a") % 3 == F.col("b") % 3, F.col("a") % 2 == F.col("b") % 2))


@query(f"WITH {_SIMS} SELECT query_id, max(score) AS score, max(score) < 0.4 AS novel FROM sims GROUP BY 1")
def j4_variant_gate(spark, sf_dir):
    return _ranked(spark, sf_dir, 1).select("query_id", "score", (F.col("score") < 0.4).alias("novel"))


@query(f"""WITH {_SIMS} SELECT p.query_id, p.score < 0.42 AND n.score < 0.35 AS accepted FROM (SELECT query_id, max(score) AS score FROM sims GROUP BY 1) p JOIN (SELECT query_id, max(negative) AS score FROM nsims GROUP BY 1) n USING (query_id)""")
def j5_two_gates(spark, sf_dir):
    return V.two_gates(_ranked(spark, sf_dir, 1), _by_label(spark, sf_dir, True), 0.42, 0.35)


@query(f"""WITH {_SIMS}, {_POOL} SELECT query_id, CASE WHEN max(score) >= 0.4 THEN 'positive' ELSE 'negative' END AS label_kind, max(score) AS score FROM pool GROUP BY 1 HAVING max(score) >= 0.4 OR max(score) < 0.33""")
def n4_strict_labels(spark, sf_dir):
    top = V.max_pool(_ranked(spark, sf_dir, 20)).groupBy("query_id").agg(F.max("score").alias("score"))
    return top.filter("score >= 0.4 or score < 0.33").select("query_id", F.when(F.col("score") >= 0.4, "positive").otherwise("negative").alias("label_kind"), "score")
