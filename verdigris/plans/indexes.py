"""Queries of stored indexes: archives, secondary indexes, posting lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.operators import postings as P
from verdigris.operators import statistics as St
from verdigris.plans.base import registrar, table
from verdigris.session import scratch
from verdigris.sources import archive, side_index

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

_STRIPPED = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


def _pages_archive(spark, sf_dir) -> str:
    path = scratch(spark, "archive")
    archive.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path, [F.col("page_id"), F.col("url")])
    return path


@query(f"""WITH s AS (SELECT page_id, url, {_STRIPPED} AS t FROM pages), c AS (
SELECT page_id, url, 0 AS k, t AS c FROM s WHERE length(t) BETWEEN 80 AND 1536
UNION ALL SELECT page_id, url, k, c FROM (SELECT page_id, url, k, trim(substr(t, CAST(k + 1 AS BIGINT), 1536), ' ') AS c FROM (SELECT page_id, url, t, unnest(range(0, length(t), 1280)) AS k FROM s WHERE length(t) > 1536)) WHERE c <> '')
SELECT row_number() OVER (ORDER BY page_id, url, k) - 1 AS chunk_id, page_id, CAST(row_number() OVER (PARTITION BY page_id, url ORDER BY k) - 1 AS INTEGER) AS chunk_index, length(c) AS n FROM c""")
def a10_archive_scan(spark, sf_dir):
    """An archive of all pages, scanned in seven ranges of bytes; article chunks with dense ids."""
    pages = archive.scan(spark, _pages_archive(spark, sf_dir), 7, "page_id long, url string, html string")
    text = T.stripped(T.without_scripts(F.col("html")))
    chunks = pages.select("row_id", "page_id", F.posexplode(T.article_chunks(text)).alias("chunk_index", "c")).withColumn("range", F.expr("row_id div 1000"))
    dense = St.running(chunks, "range", ["row_id", "chunk_index"], {"chunk_id": F.lit(1)})
    return dense.select((F.col("chunk_id") - 1).alias("chunk_id"), "page_id", "chunk_index", F.length("c").cast("long").alias("n"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY page_id, url) - 1 AS row_id, page_id, length(html) AS n FROM pages)
SELECT l.doc_id AS request, r.page_id, r.n FROM labels l JOIN r ON r.row_id = l.doc_id""")
def a9_offset_lookup(spark, sf_dir):
    """Rows of the archive by number, for every labelled id; numbers beyond the archive are left out."""
    requests = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("request"))
    found = archive.get(requests, "request", _pages_archive(spark, sf_dir), "page_id long, html string")
    return found.select("request", "page_id", F.length("html").cast("long").alias("n"))


@query("""WITH best AS (SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1)
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM best)""")
def a23_secondary_index(spark, sf_dir):
    """Orders of each nation's richest customer, through an index on a column that the files are not sorted by."""
    store, index = scratch(spark, "orders"), scratch(spark, "orders-index")
    table(spark, sf_dir, "orders").repartitionByRange(16, "o_orderkey").write.parquet(store)
    side_index.build(spark, store, ["o_custkey", "o_orderdate"], index)
    best = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max(F.struct("c_acctbal", (-F.col("c_custkey")).alias("k"))).alias("m"))
    return side_index.rows_of(spark, store, index, "o_custkey", best.select((-F.col("m.k")).alias("o_custkey"))).select("o_orderkey", "o_custkey", "o_totalprice")


_TERMS = "regexp_extract_all(lower({0}), '[a-z]{{6,}}')"


@query(f"""WITH q AS (SELECT conv_id, turn, unnest({_TERMS.format('text')}) AS term, generate_subscripts({_TERMS.format('text')}, 1) AS pos FROM conversations), f AS (SELECT conv_id, turn, term, min(pos) AS pos FROM q GROUP BY ALL),
i AS (SELECT DISTINCT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents), s AS (SELECT conv_id, turn, doc_id, min(pos) AS pos, arg_min(term, pos) AS term FROM f JOIN i USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos, doc_id) AS rank FROM s)
SELECT conv_id, turn, CAST(rank AS INTEGER) AS rank, doc_id, term FROM r WHERE rank <= 5""")
def e13_term_lookup(spark, sf_dir):
    """For every turn the first five documents of its terms, from stored posting lists."""
    terms = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{6,}"), F.lit(0))
    lists = P.stored(P.term_index(table(spark, sf_dir, "documents"), terms("text")))
    asked = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), terms("text").alias("terms"))
    return P.looked_up(asked, lists, 5, "key").select("key.conv_id", "key.turn", "rank", "doc_id", "term")


@query("""WITH q AS (SELECT item_id AS query_id, substr(text, 1, 12) AS sought FROM benchmark), s AS (SELECT query_id, sought FROM q UNION ALL SELECT -1 - query_id, substr(sought, 1, 2) FROM q)
SELECT query_id, count(*) AS hits, min(doc_id) AS first, max(doc_id) AS last FROM s JOIN documents d ON length(sought) > 0 AND contains(lower(d.text), lower(sought)) GROUP BY query_id""")
def e29_trigram_search(spark, sf_dir):
    """Documents that hold the beginning of a benchmark item, whatever the case: twelve characters by trigrams, two by all texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 12).alias("sought"))
    q = q.unionByName(q.select((-1 - F.col("query_id")).alias("query_id"), F.substring("sought", 1, 2).alias("sought")))
    found = P.containing(q, docs, P.stored(P.trigram_index(docs)))
    return found.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
