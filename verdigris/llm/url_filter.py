"""URL filters: host and path rules first, gradient-boosted trees for the rest.

Hosts and paths come from the URL as it is written; the longest fitting rule wins. URLs
that no rule fits are judged by boosted trees on lexical features: lengths, depth, digit
share, entropy of the characters, parameters, hyphens and labels of the host, and how
often URLs with the same host suffix (two labels, three labels) and with the same first part
of the path were blocked among the labelled ones, smoothed. The shares of a URL that
trains come from the other folds of the URLs. Labelled URLs are a table of (url,
label); the query, which has none, labels those that its rules decide, so that there the trees
carry the rules' decisions to URLs that look alike; ``held_out`` measures how well.

Only the fit is bounded: at most ``max_rows`` distinct labelled URLs, taken by hash, train
the trees, each with its mean label and weighted by its copies; the tables of shares have no
more rows than that and are broadcast.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is judged
by its features; with labels of one class only, that class is every verdict, and without
labels all are allowed; rules that tie in length block; URLs of any length are read whole;
repeated rows stay; equal URLs with both labels train as both; extra columns are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import written

#: (action, host, path): a rule fits the host and its subdomains where the path starts alike.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labelled URLs that may train, trees, their depth, and the weight of the overall share in a suffix's.
MAX_ROWS, TREES, DEPTH, SMOOTHING = 20_000, 12, 4, 20.0
#: Parts of the URLs that train; the shares of one come from the others.
FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_share", "host_digits", "entropy", "parameters", "hyphens", "labels", *(f"{g}_{x}" for g in ("suffix", "site", "section") for x in ("share", "seen")))


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its action; of equal length, blocks go first."""
    rule = action = F.lit(None).cast("string")
    for act, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, action = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def groups(host: Column, path: Column) -> dict[str, Column]:
    """Parts of a URL whose share of blocked URLs is a feature: two and three labels of the host, the path's first part."""
    return {"suffix": F.substring_index(host, ".", -2), "site": F.substring_index(host, ".", -3), "section": F.regexp_extract(path, "^/[^/]*/", 0)}


GROUPS = ("suffix", "site", "section")


def lexical(urls: DataFrame) -> DataFrame:
    """Add the lexical features of url, host and path."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(url, ""))
    share = lambda c: F.length(F.replace(url, c, F.lit(""))) / n
    entropy = F.aggregate(F.transform(F.filter(chars, lambda c: c != ""), lambda c: -(1 - share(c)) * F.log2(F.greatest(1 - share(c), F.lit(1e-12)))), F.lit(0.0), lambda a, x: a + x)
    return urls.select(
        "*", F.length(url).cast("double").alias("url_length"), F.length(host).cast("double").alias("host_length"), F.length(path).cast("double").alias("path_length"),
        F.regexp_count(path, F.lit("/")).cast("double").alias("depth"), (F.regexp_count(url, F.lit("[0-9]")) / n).alias("digit_share"), F.regexp_count(host, F.lit("[0-9]")).cast("double").alias("host_digits"),
        F.round(entropy, 9).alias("entropy"), F.regexp_count(url, F.lit("[?&][^=&#]*=")).cast("double").alias("parameters"), F.regexp_count(host, F.lit("-")).cast("double").alias("hyphens"), F.size(F.split(host, "\\.")).cast("double").alias("labels"), *(c.alias(g) for g, c in groups(host, path).items()),
    )


def told(group: str, blocked: Column, n: Column, overall: float) -> tuple[Column, Column]:
    """Share of blocked URLs of a group, smoothed, and how many there are."""
    return ((blocked + SMOOTHING * overall) / (n + SMOOTHING)).alias(f"{group}_share"), F.log1p(n).alias(f"{group}_seen")


def with_shares(features: DataFrame, sums: dict[str, DataFrame], overall: float) -> DataFrame:
    """Add the groups' shares to URLs that did not train."""
    for g in GROUPS:
        shares = sums[g].select(g, *told(g, F.col("all_blocked"), F.col("all_n"), overall))
        features = features.join(F.broadcast(shares), g, "left").withColumns({f"{g}_share": F.coalesce(f"{g}_share", F.lit(overall)), f"{g}_seen": F.coalesce(f"{g}_seen", F.lit(0.0))})
    return features


def trained(labelled: DataFrame, max_rows: int = MAX_ROWS):
    """(sums by group, overall share, model) from (url, host, path, label); the model is None with one class."""
    # Equal URLs become one row first, so that copies of one URL cannot fill the sample.
    copies = labelled.filter("label is not null").groupBy("url", "host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("label").cast("double")).alias("blocked"))
    sample = copies.orderBy(F.xxhash64("url"), "url").limit(max_rows)
    rows = written(lexical(sample), "urls")
    total = rows.agg(F.sum("n").alias("n"), (F.sum("blocked") / F.sum("n")).alias("share")).first()
    if not total["n"] or total["share"] in (0.0, 1.0):
        return None, total["share"] or 0.0, None
    sums = {g: rows.groupBy(g).agg(F.sum("blocked").alias("all_blocked"), F.sum("n").alias("all_n")) for g in GROUPS}
    # The trees take classes: a URL with both labels has a row for each, weighted by its copies.
    classes = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("blocked").alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("blocked")).alias("weight"))))
    # What a group tells about a URL that trains comes from the other folds of the URLs.
    fold = F.pmod(F.xxhash64("url", F.lit("share")), F.lit(FOLDS))
    others = rows.withColumn("fold", fold)
    for g in GROUPS:
        own = others.groupBy(g, "fold").agg(F.sum("blocked").alias("fold_blocked"), F.sum("n").alias("fold_n"))
        joined = others.join(F.broadcast(sums[g]), g).join(F.broadcast(own), [g, "fold"])
        others = joined.select(*others.columns, *told(g, F.col("all_blocked") - F.col("fold_blocked"), F.col("all_n") - F.col("fold_n"), total["share"]))
    weighted = others.select("*", classes.alias("c")).select("*", "c.label", "c.weight").filter("weight > 0")
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(weighted).select("features", "label", "weight")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=11, cacheNodeIds=False, weightCol="weight").fit(assembled)
    return sums, total["share"], model


def verdicts(urls: DataFrame, sums: dict | None, overall: float, model) -> DataFrame:
    """Add the method's verdict to rows with url, host and path."""
    if model is None:
        return urls.withColumn("verdict", F.lit("block" if overall >= 0.5 else "allow"))
    features = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_shares(lexical(urls), sums, overall))
    return model.transform(features).withColumn("verdict", F.when(F.col("prediction") == 1, "block").otherwise("allow"))


def held_out(labelled: DataFrame, max_rows: int = MAX_ROWS, folds: int = 5) -> tuple[int, float, float]:
    """(labelled rows held out, share judged right, share of their larger class): one fold of the URLs does not train."""
    host, path = parts(F.col("url"))
    known = labelled.select("url", "label").filter("label is not null").select("url", host.alias("host"), path.alias("path"), "label")
    fold = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(folds))
    out = verdicts(known.filter(fold == 0), *trained(known.filter(fold != 0), max_rows))
    n = out.agg(F.count("*").alias("n"), F.avg((F.col("verdict") == F.when(F.col("label") == 1, "block").otherwise("allow")).cast("double")).alias("right"), F.avg("label").alias("blocked")).first()
    return n["n"], n["right"] or 0.0, max(n["blocked"] or 0.0, 1 - (n["blocked"] or 0.0))


def judged(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict; labelled has url and label (1: block), by default what the rules decide."""
    host, path = parts(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").select("*", host.alias("host"), path.alias("path"))
    rule, action = fitting(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", rule.alias("rule"), action.alias("action"))
    if labelled is None:
        known = ruled.filter("action is not null").select("url", "host", "path", (F.col("action") == "block").cast("int").alias("label"))
    else:
        known = labelled.select("url", "label").select("url", host.alias("host"), path.alias("path"), "label")
    decided, open_ = ruled.filter("action is not null"), ruled.filter("action is null")
    out = ("page_id", "host", "path", "rule", "verdict")
    return decided.withColumn("verdict", F.col("action")).select(*out).union(verdicts(open_, *trained(known, max_rows)).select(*out))
