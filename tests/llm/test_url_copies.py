"""op4: copies of one URL do not fill the training sample."""

from pyspark.sql import functions as F

from verdigris.llm import url_filter


def test_copies_of_a_url_leave_room_for_others(spark):
    rows = [(k, f"http://{'bad-pills' if k % 2 else 'good'}{k % 7}.site.net/en/{'9' * (k % 2 * 6)}x{k}") for k in range(200)]
    urls = spark.createDataFrame(rows, "page_id long, url string").withColumn("label", F.col("page_id") % 2)
    first = urls.orderBy(F.xxhash64("url"), "url").first()
    copies = urls.filter(F.col("url") == first["url"]).select(F.explode(F.sequence(F.lit(1000), F.lit(1299))).alias("page_id"), "url", "label")
    got = url_filter.judged(urls.select("page_id", "url"), rules=(), labelled=urls.union(copies).select("url", "label"), max_rows=250).collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in got) > 190
    assert url_filter.trained(urls.union(copies).select("url", *(c.alias(n) for c, n in zip(url_filter.parts(F.col("url")), ("host", "path"), strict=True)), "label"), 250)[2] is not None
