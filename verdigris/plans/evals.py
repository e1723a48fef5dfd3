"""Evaluation queries: component vectors, paired statistics, group-bys, calibration and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdigris.functions import scoring as S
from verdigris.functions import text as T
from verdigris.operators import statistics as St
from verdigris.plans.base import registrar, table
from verdigris.plans.scores import _CLASSIFIED, _MODES, modes, results
from verdigris.plans.texts import _votes_sql

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

_STALE = "('volatile_current', 'stale_premise_trap', 'date_boundary', 'ambiguous_time_frame')"
_R = f"{_CLASSIFIED}, rec AS (SELECT *, NOT errored AND conv_id % 9 <> 0 AS scored, conv_id % 9 = 0 AND NOT errored AS unlabelled, list_contains(allowed, classified) AS correct, allowed[1] = classified AS preferred, {_MODES} AS modes FROM results)"


def records(spark, sf_dir):
    """Results with correctness against their labels; some are errored, some unlabelled."""
    r = results(spark, sf_dir)
    unlabelled = (F.col("conv_id") % 9 == 0) & ~F.col("errored")
    return r.withColumns({"scored": ~F.col("errored") & ~unlabelled, "unlabelled": unlabelled, "correct": F.array_contains(F.col("allowed"), F.col("classified")), "preferred": F.get("allowed", 0) == F.col("classified"), "modes": modes()})


def _d(n, d):
    return f"CAST({n} AS DOUBLE) / nullif({d}, 0)"


@query(f"""WITH {_R} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (scored) AS BIGINT) AS scored, CAST(count(*) FILTER (errored) AS BIGINT) AS errored,
{_d('count(*) FILTER (scored AND correct)', 'count(*) FILTER (scored)')} AS route_correctness, {_d('count(*) FILTER (scored AND preferred)', 'count(*) FILTER (scored)')} AS preferred_match,
{_d("count(*) FILTER (scored AND contains(modes, 'stale_commitment'))", f'count(*) FILTER (NOT unlabelled AND family IN {_STALE})')} AS stale_commitment_rate,
{_d("count(*) FILTER (scored AND contains(modes, 'over_verification'))", "count(*) FILTER (scored AND family = 'stable_control')")} AS over_verification_rate,
{_d("count(*) FILTER (scored AND family = 'date_boundary' AND (classified IN ('date_bound_answer', 'verify') OR date_bound))", "count(*) FILTER (scored AND family = 'date_boundary')")} AS date_boundary_clarity,
{_d("count(*) FILTER (scored AND (classified = 'verify' OR (intent AND NOT tool_done)) AND tool_done)", "count(*) FILTER (scored AND (classified = 'verify' OR (intent AND NOT tool_done)))")} AS verification_completion,
{_d('sum(length(answer)) FILTER (scored)', 'count(*) FILTER (scored)')} AS mean_length FROM rec""")
def h1_component_vector(spark, sf_dir):
    r = records(spark, sf_dir)
    sc, fam, has = F.col("scored"), F.col("family"), lambda m: F.exists("modes", lambda x: x.startswith(m))
    tried = (F.col("classified") == "verify") | (F.col("intent") & ~F.col("tool_done"))
    share = lambda n, d: St.rate(F.count_if(n), F.count_if(d))
    return r.agg(
        F.count("*").alias("total"), F.count_if(sc).alias("scored"), F.count_if("errored").alias("errored"), share(sc & F.col("correct"), sc).alias("route_correctness"), share(sc & F.col("preferred"), sc).alias("preferred_match"),
        share(sc & has("stale_commitment"), ~F.col("unlabelled") & fam.isin("volatile_current", "stale_premise_trap", "date_boundary", "ambiguous_time_frame")).alias("stale_commitment_rate"), share(sc & has("over_verification"), sc & (fam == "stable_control")).alias("over_verification_rate"),
        share(sc & (fam == "date_boundary") & (F.col("classified").isin("date_bound_answer", "verify") | F.col("date_bound")), sc & (fam == "date_boundary")).alias("date_boundary_clarity"), share(sc & tried & F.col("tool_done"), sc & tried).alias("verification_completion"), St.rate(F.sum(F.when(sc, F.length("answer"))), F.count_if(sc)).alias("mean_length"),
    )


@query(f"WITH {_R} SELECT family, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (scored AND correct) AS BIGINT) AS correct, CAST(count(*) FILTER (errored) AS BIGINT) AS errored, {_d('count(*) FILTER (scored AND correct)', 'count(*)')} AS rate FROM rec WHERE NOT unlabelled GROUP BY 1")
def h1_family_rates(spark, sf_dir):
    good = F.count_if(F.col("scored") & F.col("correct"))
    return records(spark, sf_dir).filter("not unlabelled").groupBy("family").agg(F.count("*").alias("n"), good.alias("correct"), F.count_if("errored").alias("errored"), St.rate(good, F.count("*")).alias("rate"))


@query(f"WITH {_R}, m AS (SELECT unnest(string_split(modes, ',')) AS mode FROM rec WHERE scored AND modes <> '') SELECT mode, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1")
def h1_failure_counts(spark, sf_dir):
    return records(spark, sf_dir).filter("scored").select(F.explode("modes").alias("mode")).groupBy("mode").agg(F.count("*").alias("n"))


@query(f"WITH {_CLASSIFIED}, ok AS (SELECT *, list_contains(allowed, classified) AS good FROM results WHERE NOT errored) SELECT {_d('count(*) FILTER (good)', 'count(*)')} AS correctness, {_d("count(*) FILTER (NOT good AND classified = 'answer' AND family IN ('volatile_current', 'stale_premise_trap'))", "count(*) FILTER (family IN ('volatile_current', 'stale_premise_trap'))")} AS stale, {_d("count(*) FILTER (family = 'stable_control' AND classified IN ('verify', 'ask'))", "count(*) FILTER (family = 'stable_control')")} AS over_verification, {_d("count(*) FILTER (list_contains(allowed, 'date_bound_answer') AND classified = 'date_bound_answer')", "count(*) FILTER (list_contains(allowed, 'date_bound_answer'))")} AS boundary, {_d("count(*) FILTER (classified = 'verify')", 'count(*) FILTER (tool_done)')} AS completion FROM ok")
def h2_earlier_scorer(spark, sf_dir):
    r = results(spark, sf_dir).filter("not errored").withColumn("good", F.array_contains(F.col("allowed"), F.col("classified")))
    c, f = F.col("classified"), F.col("family")
    share = lambda n, d: St.rate(F.count_if(n), F.count_if(d))
    two, bound = f.isin("volatile_current", "stale_premise_trap"), F.array_contains(F.col("allowed"), "date_bound_answer")
    return r.agg(St.rate(F.count_if("good"), F.count("*")).alias("correctness"), share(~F.col("good") & (c == "answer") & two, two).alias("stale"), share((f == "stable_control") & c.isin("verify", "ask"), f == "stable_control").alias("over_verification"), share(bound & (c == "date_bound_answer"), bound).alias("boundary"), St.rate(F.count_if(c == "verify"), F.count_if("tool_done")).alias("completion"))


@query(f"WITH {_R} SELECT allowed[1] AS preferred, classified, CAST(count(*) AS BIGINT) AS n FROM rec WHERE scored GROUP BY ALL ORDER BY n DESC, preferred, classified LIMIT 10")
def h3_confusion(spark, sf_dir):
    return records(spark, sf_dir).filter("scored").groupBy(F.get("allowed", 0).alias("preferred"), "classified").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "preferred", "classified").limit(10)


@query(f"WITH {_R} SELECT {_d('count(*) FILTER (preferred)', 'count(*)')} AS strict, {_d('count(*) FILTER (correct)', 'count(*)')} AS conditional, {_d("count(*) FILTER (classified = 'abstain')", 'count(*)')} AS abstain, CAST(sum(turn * 100) // count(*) AS BIGINT) AS latency FROM rec WHERE NOT errored")
def h4_bench_vector(spark, sf_dir):
    share = lambda c: St.rate(F.count_if(c), F.count("*"))
    return records(spark, sf_dir).filter("not errored").agg(share(F.col("preferred")).alias("strict"), share(F.col("correct")).alias("conditional"), share(F.col("classified") == "abstain").alias("abstain"), F.floor(F.sum(F.col("turn") * 100) / F.count("*")).alias("latency"))


_PAIRED = f"{_R}, pr AS (SELECT conv_id, turn, family, preferred AS raw, correct AS governed, classified, allowed[1] AS want FROM rec WHERE scored)"


def paired(spark, sf_dir):
    """Two variants of each task: strict ("raw") and by allowed sets ("governed")."""
    return records(spark, sf_dir).filter("scored").select("conv_id", "turn", "family", F.col("preferred").alias("raw"), F.col("correct").alias("governed"), "classified", F.get("allowed", 0).alias("want"))


@query(f"WITH {_PAIRED} SELECT family, {_d('count(*) FILTER (governed)', 'count(*)')} - {_d('count(*) FILTER (raw)', 'count(*)')} AS delta FROM pr GROUP BY 1")
def h5_deltas(spark, sf_dir):
    return paired(spark, sf_dir).groupBy("family").agg((St.rate(F.count_if("governed"), F.count("*")) - St.rate(F.count_if("raw"), F.count("*"))).alias("delta"))


_LI = "SELECT l_returnflag AS flag, l_linestatus AS status, CAST(count(*) AS BIGINT) AS samples, CAST(count(*) FILTER (l_quantity > 45) AS BIGINT) AS errors, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens FROM lineitem"


@query(f"{_LI} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")
def h6_h10_grouping_sets(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity")
    return l.groupingSets([("flag", "status"), ("flag",), ("status",), ()], "flag", "status").agg(F.count("*").alias("samples"), F.count_if(F.col("l_quantity") > 45).alias("errors"), F.sum(F.col("l_quantity").cast("long")).alias("tokens"))


@query("SELECT o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(floor(o_totalprice) AS BIGINT) END) AS BIGINT) AS total FROM orders GROUP BY 1")
def h7_errors_excluded(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") != "F", F.floor("o_totalprice"))).alias("total"))


@query("""WITH l AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'error')
SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'purchase') AS purchase FROM l WHERE r = 1 GROUP BY 1""")
def h8_latest_three_way(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type != 'error'")
    last = e.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.groupBy("user_id").agg(*(F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in ("click", "view", "purchase")))


@query(f"WITH {_R} SELECT family, turn % 2 AS condition, {_d("count(*) FILTER (classified = 'answer' AND NOT correct)", 'count(*)')} AS incorrect_assert FROM rec GROUP BY ALL")
def h9_incorrect_assert(spark, sf_dir):
    bad = (F.col("classified") == "answer") & ~F.col("correct")
    return records(spark, sf_dir).groupBy("family", (F.col("turn") % 2).alias("condition")).agg(St.rate(F.count_if(bad), F.count("*")).alias("incorrect_assert"))


_Z = "CAST(1.959963984540054 AS DOUBLE)"


def _wilson(k, n):
    p, n = f"(CAST({k} AS DOUBLE) / {n})", f"CAST({n} AS DOUBLE)"
    m, w = f"({p} + {_Z} * {_Z} / (2 * {n}))", f"({_Z} * sqrt({p} * (1 - {p}) / {n} + {_Z} * {_Z} / (4 * {n} * {n})))"
    return f"round(({m} - {w}) / (1 + {_Z} * {_Z} / {n}), 9)", f"round(({m} + {w}) / (1 + {_Z} * {_Z} / {n}), 9)"


@query(f"WITH {_R}, f AS (SELECT family, count(*) AS n, count(*) FILTER (correct) AS k FROM rec WHERE scored GROUP BY 1) SELECT family, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, {_wilson('k', 'n')[0]} AS low, {_wilson('k', 'n')[1]} AS high, CASE WHEN k / CAST(n AS DOUBLE) >= 0.65 THEN 'A' WHEN k / CAST(n AS DOUBLE) >= 0.40 THEN 'B' ELSE 'C' END AS tier FROM f")
def h12_h38_wilson(spark, sf_dir):
    f = records(spark, sf_dir).filter("scored").groupBy("family").agg(F.count_if("correct").alias("k"), F.count("*").alias("n"))
    low, high = St.wilson(F.col("k"), F.col("n"))
    return f.select("family", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), S.first_match([(F.col("k") / F.col("n") >= 0.65, "A"), (F.col("k") / F.col("n") >= 0.40, "B")], "C").alias("tier"))


@query(f"""WITH {_PAIRED}, t AS (SELECT coalesce(family, 'all') AS family, count(*) FILTER (raw AND governed) AS a, count(*) FILTER (raw AND NOT governed) AS b, count(*) FILTER (NOT raw AND governed) AS c, count(*) FILTER (NOT raw AND NOT governed) AS d FROM pr GROUP BY GROUPING SETS ((family), ()))
SELECT family, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, round(CASE WHEN b + c = 0 THEN 0 ELSE greatest(0, pow(abs(b - c) - 1, 2) / CAST(b + c AS DOUBLE)) END, 9)::DOUBLE AS chi2,
round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(CAST(b + c + 1 AS DOUBLE)) - lgamma(CAST(k + 1 AS DOUBLE)) - lgamma(CAST(b + c - k + 1 AS DOUBLE)) + (b + c) * ln(0.5))))) END, 9)::DOUBLE AS p FROM t""")
def h13_h15_mcnemar(spark, sf_dir):
    r, g = F.col("raw"), F.col("governed")
    t = paired(spark, sf_dir).groupingSets([("family",), ()], "family").agg(F.count_if(r & g).alias("a"), F.count_if(r & ~g).alias("b"), F.count_if(~r & g).alias("c"), F.count_if(~r & ~g).alias("d"))
    chi, p = St.mcnemar(F.col("b"), F.col("c"))
    return t.select(F.coalesce("family", F.lit("all")).alias("family"), "a", "b", "c", "d", F.round(chi, 9).alias("chi2"), F.round(p, 9).alias("p"))


@query()
def h14_paired_bootstrap(spark, sf_dir):
    diff = paired(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("governed").cast("int") - F.col("raw").cast("int")).alias("diff"))
    return St.bootstrap(diff)


@query(f"WITH {_R} SELECT family, {_d('sum(length(prompt))', 'count(*)')} AS prompt_length, {_d('sum(length(answer))', 'count(*)')} AS answer_length, {_d('count(*) FILTER (date_bound)', 'count(*)')} AS bound_rate FROM rec GROUP BY 1")
def h16_structural_means(spark, sf_dir):
    return records(spark, sf_dir).groupBy("family").agg(St.rate(F.sum(F.length("prompt")), F.count("*")).alias("prompt_length"), St.rate(F.sum(F.length("answer")), F.count("*")).alias("answer_length"), St.rate(F.count_if("date_bound"), F.count("*")).alias("bound_rate"))


_HITS = "h AS (SELECT user_id AS pattern, count(*) FILTER (event_type = 'click') AS hits, min(ts) AS created, max(ts) AS last FROM events GROUP BY 1)"


def hits(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("pattern")).agg(F.count_if(F.col("event_type") == "click").alias("hits"), F.min("ts").alias("created"), F.max("ts").alias("last"))


@query(f"WITH {_HITS}, b AS (SELECT * FROM (VALUES ('0'), ('1-9'), ('10-99'), ('100-999'), ('1000+')) AS t(bucket)) SELECT bucket, CAST(count(h.pattern) AS BIGINT) AS n FROM b LEFT JOIN h ON bucket = CASE WHEN hits = 0 THEN '0' WHEN hits < 10 THEN '1-9' WHEN hits < 100 THEN '10-99' WHEN hits < 1000 THEN '100-999' ELSE '1000+' END GROUP BY 1")
def h18_hit_histogram(spark, sf_dir):
    buckets = spark.createDataFrame([(b,) for b in ("0", "1-9", "10-99", "100-999", "1000+")], "bucket string")
    n = F.col("hits")
    counted = hits(spark, sf_dir).groupBy(S.first_match([(n == 0, "0"), (n < 10, "1-9"), (n < 100, "10-99"), (n < 1000, "100-999")], "1000+").alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"WITH {_HITS}, d AS (SELECT CAST(created AS DATE) AS day, count(*) AS n FROM h GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM d")
def h19_cumulative_growth(spark, sf_dir):
    d = hits(spark, sf_dir).groupBy(F.to_date("created").alias("day")).agg(F.count("*").alias("n"))
    return d.select(F.col("day").cast("string").alias("day"), F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("day")).alias("total"))


@query(f"WITH {_HITS}, o AS (SELECT hits, row_number() OVER (ORDER BY hits, pattern) - 1 AS k, count(*) OVER () AS n FROM h), t AS (SELECT greatest(max(hits) FILTER (k = n // 2), 1) AS threshold FROM o) SELECT h.pattern, CASE WHEN hits = 0 THEN 'cold' WHEN hits >= threshold THEN 'hot' ELSE 'warm' END AS kind FROM h, t")
def h23_hot_cold(spark, sf_dir):
    h = hits(spark, sf_dir)
    # The upper median from counts per value, so that no task sorts all keys.
    c = h.groupBy("hits").agg(F.count("*").alias("c"))
    w = Window.partitionBy(F.lit(1)).orderBy("hits")
    t = c.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(F.lit(1)))}).filter("upto > n div 2").agg(F.greatest(F.min("hits"), F.lit(1)).alias("threshold"))
    return h.join(F.broadcast(t)).select("pattern", S.first_match([(F.col("hits") == 0, "cold"), (F.col("hits") >= F.col("threshold"), "hot")], "warm").alias("kind"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) > 0.40 AS over_represented FROM documents GROUP BY 1")
def h27_distribution(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))).cast("double")
    return c.select("lang", "n", share.alias("share"), (share > 0.40).alias("over_represented"))


def _grams_sql(n: int, keys: str) -> str:
    """Every character n-gram of the whole texts."""
    parts = " || ".join(f"c[CAST(k AS BIGINT) + {j}]" for j in range(n))
    return f"SELECT {keys}, {parts} AS gram FROM (SELECT {keys}, c, unnest(range(1, len(c) - {n - 2})) AS k FROM (SELECT {keys}, string_split(text, '') AS c FROM (SELECT *, doc_id // 100 AS batch FROM documents)) WHERE len(c) >= {n})"


_BATCH = f"u AS (SELECT DISTINCT batch, gram FROM ({_grams_sql(4, 'batch')})), n AS (SELECT a.batch, count(*) AS grams, count(*) FILTER (p.gram IS NULL) AS fresh FROM u a LEFT JOIN u p ON p.batch = a.batch - 1 AND p.gram = a.gram GROUP BY 1), rt AS (SELECT batch, CAST(grams AS BIGINT) AS grams, fresh / CAST(grams AS DOUBLE) AS novelty FROM n)"


@query(f"WITH {_BATCH} SELECT *, count(*) OVER w = 3 AND max(novelty) OVER w < 0.05 AS converged FROM rt WINDOW w AS (ORDER BY batch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def h28_h29_novelty(spark, sf_dir):
    """Share of a batch's distinct 4-grams that the batch before lacks.

    A gram has one row per cell of 63 batches: bits 1 to 63 are the batches that hold it, bit 0 is
    the last batch of the cell before. So grams are shuffled once, and a cell has each only once.
    """
    batch = F.expr("doc_id div 100")
    own = F.struct(F.floor(batch / 63).alias("cell"), (F.pmod(batch, F.lit(63)) + 1).cast("int").alias("bit"))
    after = F.struct((F.floor(batch / 63) + 1).alias("cell"), F.lit(0).alias("bit"))
    d = table(spark, sf_dir, "documents").select(F.explode(F.when(own["bit"] == 63, F.array(own, after)).otherwise(F.array(own))).alias("at"), "text")
    seen = d.select("at", F.explode(F.array_distinct(T.all_grams(F.col("text"), 4))).alias("gram")).groupBy("at.cell", "gram").agg(F.bit_or(F.expr("shiftleft(1L, at.bit)")).alias("mask"))
    bits = F.filter(F.sequence(F.lit(1), F.lit(63)), lambda k: F.getbit("mask", k) == 1)
    held = seen.select("cell", "mask", F.explode(bits).alias("bit"))
    rates = held.groupBy((F.col("cell") * 63 + F.col("bit") - 1).alias("batch")).agg(F.count("*").alias("grams"), (F.count_if(F.getbit("mask", F.col("bit") - 1) == 0) / F.count("*").cast("double")).alias("novelty"))
    last = Window.partitionBy(F.lit(1)).orderBy("batch").rowsBetween(-2, 0)
    return rates.withColumn("converged", (F.count("*").over(last) == 3) & (F.max("novelty").over(last) < 0.05))


@query(f"WITH g AS (SELECT lang, gram, count(*) AS c FROM ({_grams_sql(3, 'lang')}) GROUP BY ALL) SELECT lang, count(*) FILTER (c = 1) / CAST(sum(c) AS DOUBLE) AS diversity FROM g GROUP BY 1")
def h30_gram_diversity(spark, sf_dir):
    g = table(spark, sf_dir, "documents").select("lang", F.explode(T.all_grams(F.col("text"), 3)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("c"))
    return g.groupBy("lang").agg((F.count_if(F.col("c") == 1) / F.sum("c").cast("double")).alias("diversity"))


@query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) SELECT source, doc_id, CAST(r AS INTEGER) AS r FROM r WHERE r <= 12")
def h37_newest_by_group(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id"))).alias("r")).filter("r <= 12")


@query(f"WITH {_PAIRED} SELECT want, classified, CAST(count(*) AS BIGINT) AS n, CASE WHEN want = classified THEN '=' WHEN bool_and(governed) THEN 'up' WHEN bool_or(governed) THEN '.' ELSE 'down' END AS mark FROM pr GROUP BY want, classified")
def j8_j9_transitions(spark, sf_dir):
    p = paired(spark, sf_dir).groupBy("want", "classified").agg(F.count("*").alias("n"), F.bool_and("governed").alias("all"), F.bool_or("governed").alias("any"))
    return p.select("want", "classified", "n", S.first_match([(F.col("want") == F.col("classified"), "="), (F.col("all"), "up"), (F.col("any"), ".")], "down").alias("mark"))


@query(f"WITH {_PAIRED} SELECT conv_id, turn FROM pr WHERE governed AND NOT raw")
def j10_changed_cases(spark, sf_dir):
    return paired(spark, sf_dir).filter("governed and not raw").select("conv_id", "turn")


@query("SELECT doc_id, quality IS NULL AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM (SELECT min(doc_id) AS k, sha256(text) AS h FROM documents GROUP BY 2 HAVING count(*) > 1) c WHERE c.h = sha256(documents.text) AND c.k <> documents.doc_id)")
def j12_j13_anti_and_left(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    first = d.groupBy("h").agg(F.min("doc_id").alias("k"))
    return d.select("doc_id").join(first.select(F.col("k").alias("doc_id")), "doc_id", "left_semi").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.col("quality").isNull().alias("unlabelled"))


@query("SELECT 't' || lpad(CAST(row_number() OVER (ORDER BY item_id, frame) AS VARCHAR), 4, '0') AS id, item_id, frame FROM benchmark, (SELECT unnest(range(0, 5)) AS frame)")
def j14_expansion(spark, sf_dir):
    """Each item in five frames, numbered in order without one task for all: counts per range, then a running number."""
    x = table(spark, sf_dir, "benchmark").select("item_id", F.expr("item_id div 1000").alias("range"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("frame"))
    numbered = St.running(x, "range", ["item_id", "frame"], {"n": F.lit(1)})
    return numbered.select(F.concat(F.lit("t"), F.when(F.col("n") > 9999, F.col("n").cast("string")).otherwise(F.lpad(F.col("n").cast("string"), 4, "0"))).alias("id"), "item_id", "frame")


@query("""WITH p AS (SELECT * FROM (VALUES ('a', 0), ('b', 1), ('c', 2)) AS t(profile, k)), t AS (SELECT DISTINCT event_type AS benchmark FROM events), r AS (SELECT event_type AS benchmark, user_id % 4 AS k, count(*) AS n, count(*) FILTER (value > 150) AS errors FROM events GROUP BY ALL)
SELECT t.benchmark, p.profile, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN n IS NULL THEN 'skipped' WHEN errors * 2 > n THEN 'failed' ELSE 'done' END AS status, CAST(count(*) FILTER (n IS NOT NULL) OVER (PARTITION BY p.profile) AS BIGINT) AS ran FROM t CROSS JOIN p LEFT JOIN r ON r.benchmark = t.benchmark AND r.k = p.k""")
def n20_suite_plan(spark, sf_dir):
    """The plan of a suite (benchmarks by profiles), each run's record, and how many runs of a profile there were; small tables."""
    e = table(spark, sf_dir, "events")
    profiles = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "profile string, k long")
    plan = e.select(F.col("event_type").alias("benchmark")).distinct().join(F.broadcast(profiles))
    runs = e.groupBy(F.col("event_type").alias("benchmark"), (F.col("user_id") % 4).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 150).alias("errors"))
    status = S.first_match([(F.col("n").isNull(), "skipped"), (F.col("errors") * 2 > F.col("n"), "failed")], "done")
    ran = F.count("n").over(Window.partitionBy("profile"))
    return plan.join(runs, ["benchmark", "k"], "left").select("benchmark", "profile", F.coalesce("n", F.lit(0)).cast("long").alias("n"), status.alias("status"), ran.alias("ran"))


_K1 = "WITH d AS (SELECT quality, CAST(n_chars AS DOUBLE) AS x FROM labels JOIN documents USING (doc_id)), q AS (SELECT quantile_cont(x, 0.10) FILTER (quality = 1) AS tp, quantile_cont(x, 0.90) FILTER (quality = 0) AS fp FROM d), t AS (SELECT tp, fp, tp > fp AS separated, CASE WHEN tp > fp THEN (tp + fp) / 2 ELSE CAST(0.95 AS DOUBLE) * tp END AS threshold FROM q)"


@query(f"{_K1} SELECT tp, fp, separated, threshold, (SELECT count(*) FILTER (quality = 1 AND x >= threshold) / CAST(count(*) FILTER (quality = 1) AS DOUBLE) FROM d) AS recall FROM t")
def k1_threshold_decision(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("quality", F.col("n_chars").cast("double").alias("x"))
    t = d.agg(F.percentile(F.when(F.col("quality") == 1, F.col("x")), 0.10).alias("tp"), F.percentile(F.when(F.col("quality") == 0, F.col("x")), 0.90).alias("fp"))
    t = t.withColumns({"separated": F.col("tp") > F.col("fp"), "threshold": F.when(F.col("tp") > F.col("fp"), (F.col("tp") + F.col("fp")) / 2).otherwise(F.col("tp") * 0.95)})
    good = d.filter("quality = 1").join(F.broadcast(t)).groupBy("tp", "fp", "separated", "threshold").agg((F.count_if(F.col("x") >= F.col("threshold")) / F.count("*").cast("double")).alias("recall"))
    return good


@query("WITH d AS (SELECT lang, quality, (doc_id * 37 % 101) / CAST(101 AS DOUBLE) AS x FROM labels JOIN documents USING (doc_id)), t AS (SELECT unnest(range(1, 11)) / CAST(20 AS DOUBLE) AS threshold), a AS (SELECT lang, threshold, count(*) FILTER ((x >= threshold) = (quality = 1)) / CAST(count(*) AS DOUBLE) AS accuracy FROM d, t GROUP BY ALL) SELECT lang, threshold, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY accuracy DESC, threshold) AS r FROM a) WHERE r = 1")
def k2_golden_sweep(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("lang", "quality", (F.col("doc_id") * 37 % 101 / 101.0).alias("x"))
    swept = d.withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: k / F.lit(20.0))))
    a = swept.groupBy("lang", "threshold").agg((F.count_if((F.col("x") >= F.col("threshold")) == (F.col("quality") == 1)) / F.count("*").cast("double")).alias("accuracy"))
    return a.groupBy("lang").agg(F.max(F.struct("accuracy", (-F.col("threshold")).alias("t"))).alias("b")).select("lang", (-F.col("b.t")).alias("threshold"), "b.accuracy")


@query("SELECT round(0.3 / greatest(avg(value) / 150, 0.1), 6) AS alpha, round(0.2 * count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE), 6) AS beta, round(0.1 * count(DISTINCT user_id) / CAST(count(*) AS DOUBLE), 6) AS gamma FROM events")
def k3_controller_calibration(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(F.round(0.3 / F.greatest(F.avg("value") / 150, F.lit(0.1)), 6).alias("alpha"), F.round(0.2 * F.count_if(F.col("event_type") == "error") / F.count("*").cast("double"), 6).alias("beta"), F.round(0.1 * F.countDistinct("user_id") / F.count("*").cast("double"), 6).alias("gamma"))


@query("SELECT doc_id FROM documents ORDER BY sha256('k4:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def k4_stable_sample(spark, sf_dir):
    return St.stable_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "k4", 50)


@query("""WITH s AS (SELECT source, row_number() OVER (ORDER BY source) AS place, count(*) OVER () AS strata FROM (SELECT DISTINCT source FROM documents)), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('k5:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents)
SELECT source, doc_id FROM r JOIN s USING (source) WHERE r <= 47 // strata + CASE WHEN place <= 47 % strata THEN 1 ELSE 0 END""")
def k5_stratified(spark, sf_dir):
    return St.stratified(table(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", "source", "k5", 47).select("source", "doc_id")


@query("SELECT doc_id, CASE WHEN v = 0 THEN 'unknown' WHEN y * 2 > v THEN 'yes' WHEN y * 2 < v THEN 'no' ELSE 'unknown' END AS truth FROM (SELECT doc_id, (doc_id % 2) + (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT AS y, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 3 END AS v FROM documents)")
def n1_majority_truth(spark, sf_dir):
    d = F.col("doc_id")
    votes = F.when(d % 7 == 0, F.array().cast("array<boolean>")).otherwise(F.array(d % 2 == 1, d % 3 == 0, d % 5 == 0))
    yes = F.size(F.filter(votes, lambda v: v)) * 2
    return table(spark, sf_dir, "documents").select("doc_id", S.first_match([(F.size(votes) == 0, "unknown"), (yes > F.size(votes), "yes"), (yes < F.size(votes), "no")], "unknown").alias("truth"))


_TAG = "CASE WHEN n_chars % 10 = 0 THEN lang || '-draft' WHEN n_chars % 7 = 0 THEN lang || '_' || CAST(doc_id AS VARCHAR) ELSE lang || '-' || lpad(CAST(doc_id AS VARCHAR), 5, '0') END"


@query(f"WITH t AS (SELECT regexp_extract({_TAG}, '^([a-z]+)[-_]', 1) AS prefix, TRY_CAST(nullif(regexp_extract({_TAG}, '^[a-z]+-([0-9]+)$', 1), '') AS BIGINT) AS n FROM documents) SELECT prefix, prefix || '-' || lpad(CAST(coalesce(max(n), 0) + 1 AS VARCHAR), 5, '0') AS next_id FROM t GROUP BY 1")
def n5_next_id(spark, sf_dir):
    """The next free id of each prefix: the largest number behind ``prefix-``, of ids of several forms."""
    tag = F.expr(_TAG.replace("CAST(doc_id AS VARCHAR)", "CAST(doc_id AS STRING)"))
    t = table(spark, sf_dir, "documents").select(F.regexp_extract(tag, "^([a-z]+)[-_]", 1).alias("prefix"), F.nullif(F.regexp_extract(tag, "^[a-z]+-([0-9]+)$", 1), F.lit("")).cast("long").alias("n"))
    return t.groupBy("prefix").agg(F.concat(F.col("prefix"), F.lit("-"), F.lpad((F.coalesce(F.max("n"), F.lit(0)) + 1).cast("string"), 5, "0")).alias("next_id"))


@query(f"SELECT doc_id, text AS item, {_votes_sql()} AS lang FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE trim(text, ' ') <> ''")
def n7_negatives_as_rows(spark, sf_dir):
    """Every line as a row, with the language of its own script and words."""
    items = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("item")).filter(F.trim("item") != "")
    return items.select("doc_id", "item", T.script_language(F.col("item")).alias("lang"))


@query("""WITH j AS (SELECT conv_id, turn % 3 AS cat, conv_id % 2 = 0 AS a_gov, (conv_id * 7 + turn) % 11 AS a, (conv_id * 5 + turn * 3) % 11 AS b FROM conversations), u AS (SELECT cat, CASE WHEN a_gov THEN a ELSE b END AS gov, CASE WHEN a_gov THEN b ELSE a END AS raw FROM j), m AS (SELECT cat, avg(gov) AS gov, avg(raw) AS raw, count(*) FILTER (gov > raw) AS wins FROM u GROUP BY 1)
SELECT cat, round(gov - raw, 9) AS delta, CAST(wins AS BIGINT) AS wins, CASE WHEN gov - raw >= 2 THEN 'strong' WHEN gov - raw >= 1 THEN 'clear' WHEN gov - raw >= 0.3 THEN 'slight' WHEN gov - raw > -0.3 THEN 'even' WHEN gov - raw > -1 THEN 'slight_loss' ELSE 'loss' END AS verdict FROM m""")
def n8_unblinding(spark, sf_dir):
    a, b, flip = (F.col("conv_id") * 7 + F.col("turn")) % 11, (F.col("conv_id") * 5 + F.col("turn") * 3) % 11, F.col("conv_id") % 2 == 0
    m = table(spark, sf_dir, "conversations").select((F.col("turn") % 3).alias("cat"), F.when(flip, a).otherwise(b).alias("gov"), F.when(flip, b).otherwise(a).alias("raw")).groupBy("cat").agg((F.avg("gov") - F.avg("raw")).alias("d"), F.count_if(F.col("gov") > F.col("raw")).alias("wins"))
    d = F.col("d")
    return m.select("cat", F.round(d, 9).alias("delta"), "wins", S.first_match([(d >= 2, "strong"), (d >= 1, "clear"), (d >= 0.3, "slight"), (d > -0.3, "even"), (d > -1, "slight_loss")], "loss").alias("verdict"))


@query(f"""WITH {_R}, w AS (SELECT conv_id, turn, count(*) OVER o AS n, sum(CASE WHEN correct THEN 0 ELSE 1 END) OVER o AS k FROM rec WHERE scored WINDOW o AS (ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k FROM w WHERE n >= 10 AND k / CAST(n AS DOUBLE) > 0.30 AND {_wilson('k', 'n')[0]} > 0.10 ORDER BY conv_id, turn LIMIT 1""")
def n11_early_exit(spark, sf_dir):
    """The first place where the running error rate is surely too high: counts per range of ids, then a running count within each."""
    rec = records(spark, sf_dir).filter("scored").select("conv_id", "turn", F.expr("conv_id div 100").alias("range"), F.when(F.col("correct"), 0).otherwise(1).alias("bad"))
    r = St.running(rec, "range", ["conv_id", "turn"], {"n": F.lit(1), "k": F.col("bad")}).select("conv_id", "turn", "n", "k")
    return r.filter((F.col("n") >= 10) & (F.col("k") / F.col("n") > 0.30) & (St.wilson(F.col("k"), F.col("n"))[0] > 0.10)).orderBy("conv_id", "turn").limit(1)


@query("SELECT conv_id, turn, role FROM conversations WHERE role NOT IN ('user', 'assistant')")
def n13_containment(spark, sf_dir):
    allowed = spark.createDataFrame([("user",), ("assistant",)], "role string")
    return table(spark, sf_dir, "conversations").join(F.broadcast(allowed), "role", "left_anti").select("conv_id", "turn", "role")
