"""Results of search providers as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import host, squeezed


def provider_rows(responses: DataFrame, most: int = 4000) -> DataFrame:
    """(query_id, rank, url, title, snippet) from (query_id, body): snippets joined and capped, the host as a title of last resort."""
    kind = "results array<struct<url:string,title:string,snippets:array<string>>>"
    r = responses.select("query_id", F.posexplode(F.from_json("body", kind)["results"]).alias("rank", "r"))
    return r.select("query_id", "rank", "r.url", F.coalesce(F.nullif("r.title", F.lit("")), host(F.col("r.url"))).alias("title"), F.substring(F.array_join("r.snippets", " "), 1, most).alias("snippet"))


def flattened(snippet: Column) -> Column:
    """A JSON table in a snippet as `key: value` text, anything else as it is."""
    pairs = F.from_json(snippet, "map<string,string>")
    return F.when(F.trim(snippet).startswith("{") & pairs.isNotNull(), F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")).otherwise(snippet)


def links(html: Column, k: int) -> Column:
    """The first k distinct links."""
    return F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"#]+)"'), 1)), 1, k)


def article(html: Column) -> tuple[Column, Column]:
    """(title from h1, text of the paragraphs)."""
    paragraphs = F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), 1)
    text = F.array_join(F.transform(paragraphs, lambda p: squeezed(F.regexp_replace(p, "<[^>]+>", " "))), "\n")
    return squeezed(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " ")), text
