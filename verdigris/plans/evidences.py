"""Evidence queries: pages stand for search results, twelve of them a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.operators import evidence as E
from verdigris.plans.base import registrar, table

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

_CANON = "lower(regexp_extract(url, '^([^:/?#]+)://', 1)) || '://' || lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)"
_NORM = f"""res AS (SELECT CAST(page_id // 12 AS BIGINT) AS query_id, page_id % 12 AS rank, url, html AS snippet FROM pages), can AS (SELECT *, {_CANON} AS canonical FROM res WHERE url <> '' AND snippet <> ''),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, canonical ORDER BY rank) AS r FROM can), norm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM once WHERE r = 1) WHERE k <= 8)"""
_ITEMS = f"""{_NORM}, it AS (SELECT query_id, rank, regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^[w.]+', '') AS source, CASE WHEN regexp_matches(lower(snippet), '(^|[^a-z])(whed|inwh)($|[^a-z])') THEN 'current' WHEN regexp_matches(lower(snippet), '(^|[^a-z])(ouaed|thwh)($|[^a-z])') THEN 'stale' ELSE 'acceptable' END AS freshness, contains(snippet, 'with') AS conflicting FROM norm),
items AS (SELECT *, CASE WHEN ends_with(source, '.org') THEN 'strong' WHEN starts_with(source, 'blog.') OR starts_with(source, 'm.') THEN 'weak' ELSE 'moderate' END AS provenance FROM it)"""
_SETS = f"""{_ITEMS}, g AS (SELECT query_id, count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (conflicting) AS conflicts, min(CASE freshness WHEN 'stale' THEN 0 WHEN 'acceptable' THEN 1 ELSE 2 END) AS f, sum(CASE provenance WHEN 'weak' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END) / CAST(count(*) AS DOUBLE) AS p FROM items GROUP BY 1),
s AS (SELECT query_id, CAST(n AS BIGINT) AS n, CAST(sources AS BIGINT) AS sources, CASE f WHEN 0 THEN 'stale' WHEN 1 THEN 'acceptable' ELSE 'current' END AS freshness, CASE WHEN p >= 1.5 THEN 'strong' WHEN p >= 0.8 THEN 'moderate' ELSE 'weak' END AS provenance, CASE WHEN sources >= 4 OR (sources >= 3 AND sources / CAST(n AS DOUBLE) >= 0.6) THEN 'high' WHEN sources >= 2 THEN 'medium' ELSE 'low' END AS diversity,
CASE WHEN conflicts = 0 THEN 'high' WHEN conflicts = 1 OR conflicts / CAST(n AS DOUBLE) < 0.4 THEN 'mixed' ELSE 'low' END AS agreement, CASE WHEN conflicts = 0 THEN 'none' WHEN conflicts = 1 OR conflicts / CAST(n AS DOUBLE) < 0.4 THEN 'minor' ELSE 'open' END AS conflict FROM g),
p AS (SELECT *, least(2, greatest(0, sources - 1)) + CASE diversity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END + CASE agreement WHEN 'high' THEN 2 WHEN 'mixed' THEN 1 ELSE 0 END + CASE provenance WHEN 'strong' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END AS points FROM s),
sets AS (SELECT query_id, n, sources, freshness, provenance, diversity, agreement, conflict, CASE WHEN points >= 6 THEN 'strong' WHEN points >= 3 THEN 'medium' ELSE 'weak' END AS strength FROM p),
adm AS (SELECT *, CASE WHEN freshness = 'stale' OR (strength = 'weak' AND provenance = 'weak') THEN 'reject' WHEN conflict = 'open' THEN 'ask' WHEN strength = 'strong' AND agreement = 'high' THEN 'admit' WHEN strength <> 'weak' THEN 'admit_bounded' ELSE 'insufficient' END AS admissibility FROM sets)"""


def results(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 12).alias("query_id"), (F.col("page_id") % 12).alias("rank"), "url", F.col("html").alias("snippet"))


def items(spark, sf_dir):
    n = E.normalised(results(spark, sf_dir), 8).withColumn("source", T.source_name(F.col("url")))
    return n.select("query_id", "rank", "source", E.freshness(F.col("snippet"), ("whed", "inwh"), ("ouaed", "thwh")).alias("freshness"), E.provenance(F.col("source"), (".org",), ("blog.", "m.")).alias("provenance"), F.contains("snippet", F.lit("with")).alias("conflicting"))


_STRIP = """trim(replace(replace(replace(replace(replace(regexp_replace(snippet, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), ' ')"""


@query(f"""WITH {_NORM}, s AS (SELECT *, {_STRIP} AS t FROM norm), d AS (SELECT query_id, rank, canonical, CASE WHEN length(t) <= 400 THEN t ELSE (CASE WHEN position(' ' IN substr(t, 1, 400)) > 1 THEN substr(substr(t, 1, 400), 1, length(substr(t, 1, 400)) - position(' ' IN reverse(substr(t, 1, 400)))) ELSE substr(t, 1, 400) END) || '…' END AS snippet FROM s)
SELECT a.query_id, rank, canonical, substr(sha256(snippet), 1, 12) AS digest, rank IS NOT NULL AS success FROM (SELECT DISTINCT query_id FROM res) a LEFT JOIN d USING (query_id)""")
def g1_normalise_results(spark, sf_dir):
    """At most eight results of a query, tags stripped and cut to a snippet; a query without any has success false."""
    r = results(spark, sf_dir)
    n = E.normalised(r, 8).select("query_id", "rank", "canonical", T.fingerprint(T.snippet(T.unescaped(F.col("snippet"))), 12).alias("digest"))
    return r.select("query_id").distinct().join(n, "query_id", "left").withColumn("success", F.col("rank").isNotNull())


@query(f"WITH {_ITEMS} SELECT query_id, rank, source, freshness, provenance FROM items")
def g2_g3_g4_item_cues(spark, sf_dir):
    return items(spark, sf_dir).select("query_id", "rank", "source", "freshness", "provenance")


@query(f"WITH {_SETS} SELECT * FROM sets")
def g5_g6_g7_g8_adjudication(spark, sf_dir):
    return E.adjudicated(items(spark, sf_dir)).select("query_id", "n", "sources", "freshness", "provenance", "diversity", "agreement", "conflict", "strength")


@query(f"WITH {_SETS} SELECT query_id, admissibility, CASE admissibility WHEN 'admit' THEN 'answer' WHEN 'admit_bounded' THEN 'bounded_answer' WHEN 'ask' THEN 'ask' ELSE 'abstain' END AS outcome FROM adm")
def g9_g12_admissibility(spark, sf_dir):
    a = E.admissibility(E.adjudicated(items(spark, sf_dir)))
    return a.select("query_id", "admissibility", E.outcome(F.col("admissibility")).alias("outcome"))


@query("""WITH c AS (SELECT conv_id AS query_id, turn AS rank, list_distinct(regexp_extract_all(text, '[0-9]+')) AS nums, list_distinct(string_split(lower(text), ' ')) AS words FROM conversations),
nr AS (SELECT a.query_id, count(*) FILTER (len(list_intersect(a.nums, b.nums)) > 0) / CAST(count(*) AS DOUBLE) AS rate FROM c a JOIN c b ON a.query_id = b.query_id AND a.rank < b.rank WHERE len(a.nums) > 0 AND len(b.nums) > 0 GROUP BY 1),
f AS (SELECT query_id, list(words ORDER BY rank) AS w, max(len(words)) AS longest FROM c GROUP BY 1), s AS (SELECT f.*, rate, len(list_intersect(w[1], w[2])) / CAST(least(len(w[1]), len(w[2])) AS DOUBLE) AS share FROM f LEFT JOIN nr USING (query_id))
SELECT query_id, CASE WHEN longest <= 2 THEN 'mixed' WHEN rate >= 0.7 THEN 'high' WHEN rate >= 0.3 THEN 'mixed' WHEN rate IS NOT NULL THEN 'low' WHEN len(w) < 2 THEN 'mixed' WHEN share >= 0.5 THEN 'high' WHEN share >= 0.2 THEN 'mixed' ELSE 'low' END AS agreement FROM s""")
def j7_claim_agreement(spark, sf_dir):
    claims = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("text").alias("claim"))
    return E.claim_agreement(claims)


@query(f"""WITH {_ITEMS} SELECT query_id, string_agg(CAST(k AS VARCHAR) || '. ' || source, chr(10) ORDER BY k) AS block FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE freshness WHEN 'current' THEN 0 WHEN 'acceptable' THEN 1 ELSE 2 END, rank) AS k FROM items) GROUP BY 1""")
def e23_e24_evidence_block(spark, sf_dir):
    order = E.first_match([(F.col("freshness") == "current", 0), (F.col("freshness") == "acceptable", 1)], 2)
    grouped = items(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "rank", "source"))).alias("all"))
    return grouped.select("query_id", F.array_join(F.transform("all", lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x["source"])), "\n").alias("block"))
