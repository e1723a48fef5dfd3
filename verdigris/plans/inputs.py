"""Queries of the sources and sinks over pages, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.plans.base import registrar, table
from verdigris.session import scratch
from verdigris.sources import files, web

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)


@query("SELECT event_id, event_type FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def a1_tolerant_jsonl(spark, sf_dir):
    path = scratch(spark, "jsonl")
    e = table(spark, sf_dir, "events")
    good = F.to_json(F.struct("event_id", "event_type"))
    e.select(F.when(F.col("event_id") % 5 == 0, "{broken").when(F.col("event_id") % 7 == 0, "").otherwise(good).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "event_id long, event_type string")


@query("SELECT conv_id, turn, substr(sha256(text), 1, 16) AS prompt_hash, substr(sha256(role), 1, 16) AS output_hash, CAST(turn * 10 AS INTEGER) AS latency_ms FROM conversations")
def a3_row_factory(spark, sf_dir):
    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"), F.col("role").alias("output"), (F.col("turn") * 10.0).alias("latency"))
    return files.bench_rows(raw)


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def a4_gathered_files(spark, sf_dir):
    path = scratch(spark, "gather")
    table(spark, sf_dir, "events").select("event_id", "event_type").write.json(path)
    return files.gathered(spark, path, "event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) <> '' AS has_title, CAST(greatest(1, len(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>'))) AS BIGINT) AS paragraphs FROM pages")
def a5_a22_article(spark, sf_dir):
    title, text = web.article(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", (title != "").alias("has_title"), F.size(F.split(text, "\n")).cast("long").alias("paragraphs"))


@query("SELECT 'd' || CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 4 = 0 THEN 'removed' WHEN doc_id % 4 = 1 THEN 'added' ELSE 'altered' END AS change FROM documents WHERE doc_id % 4 IN (0, 1, 2)")
def a6_a7_changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 4).alias("k"))
    return files.changed(d.filter("k != 1").select("path", "hash"), d.filter("k != 0").select("path", F.when(F.col("k") == 2, "x").otherwise(F.col("hash")).alias("hash")))


@query("SELECT doc_id AS rowid, CAST(doc_id // 3 AS BIGINT) AS pos, lang FROM documents WHERE doc_id % 3 = 0")
def a9_random_access(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    wanted = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("rowid"), F.expr("doc_id div 3").alias("pos")).union(d.limit(1).select(F.lit(-5).cast("long"), F.lit(-1).cast("long")))
    return files.by_rowid(d.select(F.col("doc_id").alias("rowid"), "lang"), wanted).select("rowid", "pos", "lang")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS dense FROM documents")
def a10_dense_ids(spark, sf_dir):
    """Dense ids without one global sort task: counts per hash range, then a rank within each."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 1000").alias("r"))
    before = d.groupBy("r").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.partitionBy(F.lit(1)).orderBy("r")) - F.col("c"))
    rank = F.row_number().over(Window.partitionBy("r").orderBy("doc_id"))
    return d.join(before.select("r", "before"), "r").select("doc_id", (F.col("before") + rank - 1).alias("dense"))


@query("SELECT doc_id, source AS title, lang AS kind, length(text) AS n FROM documents")
def a13_frontmatter(spark, sf_dir):
    raw = F.concat(F.lit("---\ntitle: "), "source", F.lit("\nkind: "), "lang", F.lit("\n---\n"), "text")
    head, body = files.frontmatter(raw)
    return table(spark, sf_dir, "documents").select("doc_id", head["title"].alias("title"), head["kind"].alias("kind"), F.length(body).cast("long").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20")
def a18_latest_traces(spark, sf_dir):
    path = scratch(spark, "traces")
    files.partitioned(table(spark, sf_dir, "events"), path)
    return files.latest(spark, path, "2000-01-01", "click", 20).select("event_id", "event_type")


@query("SELECT page_id AS query_id, regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^$', '') AS title, url, 'a b' AS snippet, 'k: v' AS flat FROM pages")
def a19_a20_provider_rows(spark, sf_dir):
    body = F.to_json(F.struct(F.array(F.struct("url", F.lit("").alias("title"), F.array(F.lit("a"), F.lit("b")).alias("snippets"))).alias("results")))
    rows = web.provider_rows(table(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), body.alias("body")))
    return rows.select("query_id", "title", "url", "snippet", web.flattened(F.lit('{"k": "v"}')).alias("flat"))


@query("""SELECT page_id, coalesce(string_agg(link, ' ' ORDER BY k) FILTER (k <= 3), '') AS links FROM (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY first) AS k FROM (SELECT page_id, link, min(pos) AS first FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"#]+)"', 1) AS l FROM pages)) GROUP BY ALL)) GROUP BY 1""")
def a21_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", web.links(F.col("html"), 3).alias("l"))
    return p.filter("size(l) > 0").select("page_id", F.array_join("l", " ").alias("links"))


@query("SELECT conv_id AS capsule_id, 0 AS layer, CAST(count(*) AS BIGINT) AS turns FROM conversations GROUP BY 1")
def a8_a23_capsule_table(spark, sf_dir):
    path = scratch(spark, "capsules")
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("capsule_id")).agg(F.count("*").alias("turns"))
    files.published(c, path)
    return spark.read.parquet(path).withColumn("layer", F.lit(0))


@query("SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM pages")
def a5_text_extraction(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(files.text_of(F.lit("x.html"), F.col("html").cast("binary"))).cast("long").alias("n"))


def _stream(spark, sf_dir):
    """The events as a stream of the table's own file."""
    from verdigris.streaming import streams

    schema = table(spark, sf_dir, "events").schema
    path = scratch(spark, "stream")
    table(spark, sf_dir, "events").repartitionByRange(4, "ts").write.parquet(path)
    return streams, streams.replay(spark, path, schema)


@query("SELECT event_type, CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def t9_streamed_windows(spark, sf_dir):
    streams, events = _stream(spark, sf_dir)
    w = streams.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "60 days", "event_type")
    out = streams.to_files(w, scratch(spark, "windows"), "complete", scratch(spark, "cp"))
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS hits FROM events GROUP BY 1")
def t5_streamed_counts(spark, sf_dir):
    streams, events = _stream(spark, sf_dir)
    return streams.to_files(streams.hit_counts(events, "user_id"), scratch(spark, "counts"), "complete", scratch(spark, "cp")).select("user_id", "hits")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def t4_streamed_append_log(spark, sf_dir):
    streams, events = _stream(spark, sf_dir)
    path = scratch(spark, "applog")
    streams.append_log(events.filter("event_type = 'error'").select("event_id", "event_type"), path, scratch(spark, "cp"))
    return spark.read.parquet(path)


def _timed(spark, sf_dir, columns):
    """The events as a stream of four files in order of their times, for state with timers."""
    from verdigris.streaming import streams, timers

    timers.with_timers(spark)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("judgment")).select(columns)
    bounds = [None, *e.agg(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75])).first()[0], None]
    path = scratch(spark, "timed")
    for low, high in zip(bounds, bounds[1:], strict=False):
        at = F.unix_micros("ts")
        part = e.filter((at > low if low is not None else F.lit(True)) & (at <= high if high is not None else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(path)
    return streams, timers, streams.replay(spark, path, e.schema)


@query("""WITH w AS (SELECT max(ts) AS now FROM events), k AS (SELECT user_id, event_type NOT IN ('click', 'view', 'purchase') AS rejected, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events, w WHERE ts >= now - INTERVAL 3 DAY)
SELECT u.user_id, count(k.r) AS kept, coalesce(bool_or(k.rejected), FALSE) AS has_rejected FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN k ON k.user_id = u.user_id AND k.r <= 8 GROUP BY 1""")
def t1_expiring_ring(spark, sf_dir):
    """Each user's quarantine ring of eight entries and three days at the end of the stream; entries expire by timers."""
    streams, timers, events = _timed(spark, sf_dir, ["user_id", "event_id", "ts", "judgment"])
    out = streams.to_files(timers.ring(events, "0 seconds", 3 * 86_400, 8), scratch(spark, "rings"), "update", scratch(spark, "cp"))
    return out.groupBy("user_id").agg(F.max_by(F.struct("kept", "has_rejected"), "at").alias("s")).select("user_id", "s.kept", "s.has_rejected")


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, TRUE) AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT user_id, ts, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g)
SELECT user_id, epoch_us(min(ts)) // 1000 AS first, epoch_us(max(ts)) // 1000 AS last, count(*) AS n FROM b GROUP BY user_id, burst HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)""")
def t2_quiet_bursts(spark, sf_dir):
    """Bursts of a user's events, each given out by a timer once six quiet hours have passed."""
    streams, timers, events = _timed(spark, sf_dir, ["user_id", "ts"])
    return streams.to_files(timers.bursts(events, "0 seconds", 6 * 3600), scratch(spark, "bursts"), "append", scratch(spark, "cp"))
