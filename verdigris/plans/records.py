"""Queries of validated records: schemas, authoring, axis means."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import schema
from verdigris.operators import authoring
from verdigris.operators import statistics as St
from verdigris.plans.base import registrar, table
from verdigris.plans.digests import SQL as D47
from verdigris.plans.digests import d47_axis_scores
from verdigris.plans.scores import _CLASSIFIED, results
from verdigris.session import scratch

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)


def _task_records(spark, sf_dir):
    """A task record for each answered prompt, with the gaps and strange values that its text gives rise to."""
    r = results(spark, sf_dir)
    c = F.col
    fields = {
        "id": F.concat_ws("-", "conv_id", "turn"), "suite": F.when(~c("pushback"), "base"), "family": F.when(c("denial"), F.upper("family")).otherwise(c("family")), "domain": F.when(c("prompt").rlike("[.!?]"), "general"), "language": F.when(~c("clarify"), "en"),
        "user_prompt": F.when(F.length("prompt") >= 40, c("prompt")), "temporal_volatility": F.when(c("current"), "volatile").when(c("date_bound"), "high").otherwise("low"), "requires_current_verification": c("intent"), "tool_mode": F.when(c("refusal"), "tools").when(c("tool_done"), "tool_available").otherwise("no_tool"),
        "expected_routes": F.when(c("abstain"), F.array().cast("array<string>")).when(c("denial"), F.array_append("allowed", F.lit("shout"))).otherwise(c("allowed")), "primary_metric": F.when(c("current"), "accuracy").otherwise("route_correctness"),
    }
    text = F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    # A list that is none, and a record that is none.
    routes = F.when(c("pushback"), F.lit('"refuse"')).otherwise(F.lit('["refuse","sing"]'))
    whole = F.concat(F.substring(text, 1, F.length(text) - 1), F.lit(',"disallowed_routes":'), routes, F.lit("}"))
    return r.select("conv_id", "turn", F.when(F.length("answer") < 20, c("answer")).otherwise(whole).alias("record"))


def _sql_listed(values) -> str:
    return schema._listed(values).replace("'", "''")


_ERRORS = f"""CASE WHEN length(answer) < 20 THEN 'record: not an object' ELSE array_to_string(list_filter([
CASE WHEN pushback THEN 'field ''suite'': missing' END, CASE WHEN NOT regexp_matches(prompt, '[.!?]') THEN 'field ''domain'': missing' END, CASE WHEN clarify THEN 'field ''language'': missing' END, CASE WHEN length(prompt) < 40 THEN 'field ''user_prompt'': missing' END,
CASE WHEN denial THEN 'field ''family'': not in {_sql_listed(schema.FAMILIES)}' END, CASE WHEN refusal THEN 'field ''tool_mode'': not in {_sql_listed(schema.TOOL_MODES)}' END,
CASE WHEN abstain THEN 'field ''expected_routes'': must be non-empty list' WHEN denial THEN 'field ''expected_routes'': unknown route ''shout''' END,
CASE WHEN pushback THEN 'field ''disallowed_routes'': must be list' ELSE 'field ''disallowed_routes'': unknown route ''sing''' END,
CASE WHEN current THEN 'field ''temporal_volatility'': must be low|medium|high' END, CASE WHEN current THEN 'field ''primary_metric'': v0.1 uses ''route_correctness''' END], lambda e: e IS NOT NULL), '; ') END"""


@query(f"WITH {_CLASSIFIED} SELECT conv_id, turn, {_ERRORS} AS errors FROM results")
def d50_schema_errors(spark, sf_dir):
    r = _task_records(spark, sf_dir)
    return r.select("conv_id", "turn", F.array_join(schema.task_errors(F.col("record")), "; ").alias("errors"))


_MEAN = "avg(accuracy) AS accuracy, avg(directness) AS directness, avg(uncertainty) AS uncertainty, avg(hallucination) AS hallucination, avg(conciseness) AS conciseness, sum(accuracy + directness + uncertainty + hallucination + conciseness) / CAST(5 * count(*) AS DOUBLE) AS mean_score, count(*) AS n"


def _axis_sql() -> str:
    return f"WITH s AS ({D47['d47_axis_scores']}), k AS (SELECT s.*, CASE WHEN s.turn < 4 THEN 'early' ELSE 'late' END AS condition, c.role || '-' || CAST(s.conv_id % 3 AS VARCHAR) AS model FROM s JOIN conversations c USING (conv_id, turn)) SELECT condition, model, kind, {_MEAN} FROM k GROUP BY GROUPING SETS ((condition), (model, condition), (kind, condition))"


@query(_axis_sql())
def h10_axis_means(spark, sf_dir):
    """Means of the five axes by condition, model and condition, category and condition."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    rows = d47_axis_scores(spark, sf_dir).join(c, ["conv_id", "turn"])
    rows = rows.withColumns({"condition": F.when(F.col("turn") < 4, "early").otherwise("late"), "model": F.concat_ws("-", "role", (F.col("conv_id") % 3).cast("string"))})
    return St.axis_means(rows, ("accuracy", "directness", "uncertainty", "hallucination", "conciseness"), "condition", "model", "kind")


_WORD = "lower(regexp_extract(text, '[A-Za-z]+'))"
_FORMS = f"""o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
f AS (SELECT conv_id AS pos, max(CASE WHEN r = 1 THEN 'pat_' || {_WORD} || '_' || lpad(CAST(conv_id % 7 AS VARCHAR), 3, '0') END) AS id, max(CASE WHEN r = 1 THEN role END) AS topic, max(CASE WHEN r = 2 THEN {_WORD} END) AS intent,
string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') AS examples FROM o GROUP BY 1),
l AS (SELECT *, len(list_filter(list_transform(regexp_split_to_array(coalesce(examples, ''), '\\r\\n|\\r|\\n'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS n FROM f),
j AS (SELECT *, CASE WHEN n < 5 THEN 'Need at least 5 examples (got ' || CAST(n AS VARCHAR) || ').' WHEN NOT regexp_full_match(coalesce(id, ''), 'pat_[a-z_]+_[0-9]{{3}}') THEN 'id must match the form (got ''' || coalesce(id, '') || ''')' WHEN coalesce(intent, '') = '' THEN 'intent is required' END AS own FROM l)"""


@query(f"""WITH {_FORMS} SELECT pos, CAST(n AS INTEGER) AS n_examples, coalesce(own, CASE WHEN row_number() OVER (PARTITION BY id, own IS NULL ORDER BY pos) > 1 THEN 'id ''' || id || ''' already exists in library' END, 'created') AS outcome, (SELECT count(DISTINCT id) FROM j WHERE own IS NULL) AS stored FROM j""")
def m6_pattern_authoring(spark, sf_dir):
    """Each conversation as a form: its users' lines are the examples. Accepted forms are appended, half of them by a second writer."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    word = F.lower(F.regexp_extract("text", "[A-Za-z]+", 0))
    o = table(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(w))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    pid = F.concat(F.lit("pat_"), word, F.lit("_"), F.lpad((F.col("conv_id") % 7).cast("string"), 3, "0"))
    forms = o.groupBy(F.col("conv_id").alias("pos")).agg(F.max(F.when(F.col("r") == 1, pid)).alias("id"), F.max(F.when(F.col("r") == 1, F.col("role"))).alias("topic"), F.max(F.when(F.col("r") == 2, word)).alias("intent"), said.alias("examples"))
    forms = forms.withColumn("negatives", F.lit(None).cast("string"))
    path = scratch(spark, "patterns")
    middle = forms.agg(F.percentile_approx("pos", 0.5)).first()[0]
    first = authoring.append(forms.filter(F.col("pos") <= middle), path, "2024-01-01").select("pos", "examples", "error")
    first.write.parquet(f"{path}-first")
    rest = authoring.append(forms.filter(F.col("pos") > middle), path, "2024-01-02").select("pos", "examples", "error")
    n = authoring.stored(spark, path, "id string, topic string").count()
    both = spark.read.parquet(f"{path}-first").unionByName(rest)
    return both.select("pos", F.size("examples").alias("n_examples"), F.coalesce("error", F.lit("created")).alias("outcome"), F.lit(n).alias("stored"))


_LEAF = "SELECT 0 AS level, row_number() OVER (ORDER BY event_id) - 1 AS node, sha256(event_type || '|' || CAST(user_id AS VARCHAR) || '|' || props) AS hash, 1 AS size FROM events"


def _tree_sql(levels: int = 5) -> str:
    parts = [f"t0 AS ({_LEAF})"]
    for k in range(1, levels + 1):
        parts.append(f"t{k} AS (SELECT {k} AS level, node // 64 AS node, sha256(string_agg(hash, ',' ORDER BY node)) AS hash, sum(size) AS size FROM t{k - 1} GROUP BY node // 64)")
    whole = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(levels + 1))
    top = "(SELECT min(level) FROM a WHERE nodes = 1)"
    return f"WITH {', '.join(parts)}, u AS ({whole}), c AS (SELECT count(*) // 2 AS old FROM t0), a AS (SELECT level, count(*) AS nodes, count(*) FILTER ((node + 1) * power(64, level) > old) AS anew, CAST(sum(CAST(('0x' || substr(hash, 1, 8)) AS BIGINT) * (1 + node % 1000)) AS BIGINT) AS digest FROM u, c GROUP BY level) SELECT level, nodes, anew, digest, TRUE AS append_only FROM a WHERE level <= {top}"


@query(_tree_sql())
def n14_hash_tree(spark, sf_dir):
    """The log of all events as a hash tree that has grown by its second half: nodes of each level, those hashed anew, and the proof."""
    from verdigris.operators import hashtree

    e = table(spark, sf_dir, "events").withColumn("range", F.expr("event_id div 5000"))
    lines = St.running(e, "range", ["event_id"], {"seq": F.lit(1)}).select((F.col("seq") - 1).alias("seq"), F.concat_ws("|", "event_type", "user_id", "props").alias("line"))
    path = scratch(spark, "log")
    lines.write.parquet(path)
    lines = spark.read.parquet(path)
    half = lines.count() // 2
    hashtree.built(lines.filter(F.col("seq") < half)).write.parquet(f"{path}-old")
    old = spark.read.parquet(f"{path}-old")
    hashtree.appended(old, lines.filter(F.col("seq") >= half)).write.parquet(f"{path}-new")
    new = spark.read.parquet(f"{path}-new")
    proof = hashtree.begins_with(new, old)
    mark = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * (1 + F.col("node") % 1000)
    return new.groupBy("level").agg(F.count("*").alias("nodes"), F.count_if("anew").alias("anew"), F.sum(mark).alias("digest")).withColumn("append_only", F.lit(proof))
