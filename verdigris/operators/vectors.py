"""Vector retrieval: similarity, top-k, pooling by key, margins, tiers and conflicts.

Inputs: queries(query_id, q, ...) and vectors(vec_id, embedding, label). Equal vectors collapse
to one class with its smallest ids; classes are dealt by hash into groups of bounded bytes, and
every query meets every group once. A task holds its group in tiles and lets the queries stream
past them in blocks, so that only a bounded piece of the scores exists at a time. Products are
in single precision with a bound on their error: what can be among the best is computed again
in double precision, in order. Top-k lists are bounded per query, so what follows them is linear
in the queries.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.scoring import first_match
from verdigris.session import ship

#: Numbers of a block of queries and of a tile of vectors at most, and rows of both: 8 MB of scores.
QUERY_VALUES, VECTOR_VALUES, QUERIES, CANDIDATES = 1 << 20, 1 << 22, 1024, 2048
#: Bytes of vectors that one task holds, and numbers of the pairs that are computed again together.
HELD, PAIR_VALUES = 192_000_000, 1 << 21
#: More than products in different orders can differ by.
NEAR = 1e-9
#: A missing label, inside a task.
NO_LABEL = np.iinfo("i8").min


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Cosine with zero norms guarded by 1."""
    return dot(a, b) / F.when(na * nb == 0, F.lit(1.0)).otherwise(na * nb)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths, added in order."""
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1])


def usable(id_: str, vector: str) -> Column:
    """Rows with an id and a vector of finite components; others have no score."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    return F.col(id_).isNotNull() & (F.size(vector) > 0) & F.forall(F.col(vector).cast("array<double>"), good)


class Block:
    """Vectors of one dimension, and their single-precision form of length 1.

    odd: those whose length or products might leave the range of the numbers; for them nothing is ruled out.
    """

    def __init__(self, x: np.ndarray):
        self.x = x.astype("f8")
        with np.errstate(over="ignore"):
            self.norm = norms(self.x)
        self.odd = (self.norm != 0) & ~((self.norm > 1e-25) & (self.norm < 1e30))
        # Above this dimension the bound on the rounding of sums would be wide.
        self.kind, self.unit_roundoff = ("f4", 2.0**-24) if x.shape[1] <= 65_536 else ("f8", 2.0**-53)
        self.slack = (x.shape[1] + 16) * self.unit_roundoff * 1.01 + 1e-12
        self.unit = (self.x / np.where((self.norm == 0) | self.odd, np.inf, self.norm)[:, None]).astype(self.kind)


class Tile:
    """Classes of a group: vectors in columns, and each one's (id, label) entries in order of the ids."""

    def __init__(self, x: np.ndarray, counts: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        block = Block(x)
        self.norm, self.odd, self.slack = block.norm, block.odd, block.slack
        # Single-precision vectors are held once, others beside their single-precision form.
        self.raw = x.dtype == block.kind
        self.coded = np.ascontiguousarray((np.where(block.odd[:, None], 0, x) if self.raw else block.unit).T)
        self.scale = (1 / np.where((self.norm == 0) | self.odd, np.inf, self.norm) if self.raw else np.ones(len(x))).astype(block.kind)
        self.x = x if not self.raw or self.odd.any() else None
        self.counts, self.ids, self.labels = counts, ids, labels
        self.starts = np.cumsum(counts) - counts
        self.label = labels[self.starts]
        self.edges = np.flatnonzero(np.r_[True, self.label[1:] != self.label[:-1]])
        # Classes of one id only are none for a query of that id.
        sole = np.flatnonzero(ids[self.starts] == ids[self.starts + counts - 1])
        order = np.argsort(ids[self.starts[sole]], kind="stable")
        self.sole, self.sole_id = sole[order], ids[self.starts[sole]][order]

    def rows(self, at: np.ndarray) -> np.ndarray:
        return (self.coded[:, at].T if self.x is None else self.x[at]).astype("f8")

    def products(self, q: Block, own: np.ndarray | None) -> np.ndarray:
        """Cosines to within the slack; lowest where the vector is odd or has the query's id only."""
        with np.errstate(all="ignore"):
            found = q.unit @ self.coded
            found *= self.scale
        found[:, self.odd] = -np.inf
        if own is not None:
            low, high = (np.searchsorted(self.sole_id, own, side) for side in ("left", "right"))
            n = high - low
            if n.any():
                places = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
                found[np.repeat(np.arange(len(own)), n), self.sole[places]] = -np.inf
        return found

    def above(self, q: Block, found: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) whose product reaches what is least for the query or pair, and all pairs with odd vectors."""
        least = np.nextafter(least.astype(found.dtype), np.array(-np.inf, found.dtype))
        least = least if least.ndim == 2 else least[:, None]
        least[q.odd] = -np.inf
        if self.odd.any() or least.shape[1] > 1:
            hit = found >= least
            hit[:, self.odd] = True
            return np.nonzero(hit)
        rows = np.flatnonzero(found.max(axis=1) >= least[:, 0])
        a, c = np.nonzero(found[rows] >= least[rows])
        return rows[a], c

    def near(self, q: Block, own: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that contain all that reach the bound, or, where it is infinite, the k best."""
        found = self.products(q, own)
        least, size = bound - self.slack, found.shape[1]
        if size > k and len(new := np.flatnonzero(np.isneginf(bound))):
            least[new] = np.partition(found[new], size - k, axis=1)[:, size - k].astype("f8") - 2 * self.slack
        return self.above(q, found, least)

    def near_by_label(self, q: Block, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that contain each query's best of every label."""
        found = self.products(q, own)
        best = np.maximum.reduceat(found, self.edges, axis=1).astype("f8") - 2 * self.slack
        return self.above(q, found, np.repeat(best, np.diff(np.r_[self.edges, found.shape[1]]), axis=1))

    def exact(self, q: Block, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Cosines added in order; zero norms are guarded by 1."""
        with np.errstate(all="ignore"):
            scale = q.norm[a] * self.norm[c]
            return np.cumsum(q.x[a] * self.rows(c), axis=1)[:, -1] / np.where(scale == 0, 1.0, scale)

    def scored(self, q: Block, own: np.ndarray, a: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, score, id, label) of the pairs' rows other than the query's own, a bounded number at a time."""
        step = max(1, PAIR_VALUES // self.coded.shape[0])
        for s in range(0, len(a), step):
            i, j = a[s : s + step], c[s : s + step]
            score = self.exact(q, i, j)
            good = np.isfinite(score)
            i, j, score = i[good], j[good], score[good]
            n = self.counts[j]
            at = np.arange(n.sum()) + np.repeat(self.starts[j] - (np.cumsum(n) - n), n)
            i, score = np.repeat(i, n), np.repeat(score, n)
            other = self.ids[at] != own[i]
            yield i[other], score[other], self.ids[at[other]], self.labels[at[other]]


def firsts(of: np.ndarray, k: int) -> np.ndarray:
    """Which entries of a sorted array are among the first k of their value."""
    at = np.arange(len(of))
    start = np.maximum.accumulate(np.where(np.r_[True, of[1:] != of[:-1]], at, 0))
    return at - start < k


def best_rows(tiles: list[Tile], q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, score, id, label) of each query's k best rows; ties go to the smaller id."""
    block = Block(q)
    held = (np.zeros(0, "i8"), np.zeros(0), np.zeros(0, "i8"), np.zeros(0, "i8"))
    bound = np.full(len(q), -np.inf)
    for t in tiles:
        for more in t.scored(block, own, *t.near(block, own, bound, k)):
            if not len(more[0]):
                continue
            a, score, ids, labels = (np.concatenate(both) for both in zip(held, more, strict=True))
            order = np.lexsort((ids, -score, a))
            order = order[firsts(a[order], k)]
            held = a[order], score[order], ids[order], labels[order]
            last = np.flatnonzero(np.r_[held[0][1:] != held[0][:-1], True])
            full = last[np.diff(np.r_[-1, last]) == k]
            bound[held[0][full]] = held[1][full]
    return held


def best_rows_by_label(tiles: list[Tile], q: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, score, id, label) of each query's best row of every label, in parts that may name a label again."""
    block, parts, size = Block(q), [], 0
    for t in tiles:
        for more in t.scored(block, own, *t.near_by_label(block, own)):
            parts.append(_best_of_label(more))
            size += len(parts[-1][0])
            if size > PAIR_VALUES // 2:
                best = _best_of_label(tuple(map(np.concatenate, zip(*parts, strict=True))))
                parts, size = [best], len(best[0])
                if size > PAIR_VALUES // 4:
                    yield best
                    parts, size = [], 0
    if parts:
        yield _best_of_label(tuple(map(np.concatenate, zip(*parts, strict=True))))


def _best_of_label(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    a, score, ids, labels = rows
    order = np.lexsort((ids, -score, labels, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (labels[order][1:] != labels[order][:-1])] if len(order) else order > 0
    return tuple(x[order[new]] for x in rows)


def in_groups(queries: DataFrame, vectors: DataFrame, most: int, by_label: bool, of: Callable) -> DataFrame:
    """query_id, vec_id, label, score: what of(tiles, q, own) finds for every block of queries in every group of classes.

    A class is a vector, by label also its label, with the rows of its ``most`` smallest ids.
    """
    spark = queries.sparkSession
    ship(spark)
    single = all(df.schema[c].dataType.elementType.typeName() == "float" for df, c in ((queries, "q"), (vectors, "embedding")))
    kind = "array<float>" if single else "array<double>"
    taking = vectors.filter(usable("vec_id", "embedding")).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("x")).withColumn("hash", F.xxhash64("x"))
    asked = queries.filter(usable("query_id", "q")).select(F.col("query_id").cast("long").alias("own"), F.col("q").cast(kind).alias("x"))
    # Only sizes the groups; any number of them is right.
    different, values = taking.agg(F.approx_count_distinct("hash"), F.coalesce(F.avg(F.size("x")), F.lit(0.0))).first()
    n = max(1, math.ceil(different * values * (4 if single else 12) / HELD), min(spark.sparkContext.defaultParallelism, math.ceil(different / CANDIDATES)))
    key = ["hash", "x", "label"] if by_label else ["hash", "x"]
    first = F.dense_rank().over(Window.partitionBy(*key).orderBy("id"))
    classes = taking.withColumn("first", first).filter(F.col("first") <= most).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("id", "label"))).alias("entries"))
    none = F.lit(None).cast("long")
    held = classes.select(F.pmod("hash", F.lit(n)).cast("int").alias("group"), F.size("x").alias("dim"), F.lit(0).alias("kind"), (F.col("label") if by_label else none).alias("label"), none.alias("own"), "entries", "x")
    spread = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("group"), F.size("x").alias("dim"), F.lit(1).alias("kind"), none.alias("label"), "own", F.array().cast("array<struct<id:bigint,label:bigint>>").alias("entries"), "x")
    dealt = held.union(spread).repartitionById(n, F.col("group")).sortWithinPartitions("dim", "kind", "label")
    query_values, vector_values, query_rows, vector_rows = QUERY_VALUES, VECTOR_VALUES, QUERIES, CANDIDATES

    def run(batches):
        import pyarrow as pa

        dim, tiles, owns, asked_rows, waiting = None, [], [], [], []

        def close():
            if waiting:
                x, counts, ids, labels = map(np.concatenate, zip(*waiting, strict=True))
                waiting.clear()
                tiles.append(Tile(x, counts, ids, labels))

        def flush():
            own, q = np.concatenate(owns), np.concatenate(asked_rows)
            owns.clear()
            asked_rows.clear()
            for a, score, ids, labels in of(tiles, q, own):
                for s in range(0, len(a), 1 << 16):
                    part = slice(s, s + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(own[a[part]]), pa.array(ids[part]), pa.array(labels[part], mask=labels[part] == NO_LABEL), pa.array(score[part])], names=["query_id", "vec_id", "label", "score"])

        for b in (b for b in batches if b.num_rows):
            dims, kinds = b.column(1).to_numpy(), b.column(2).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (kinds[1:] != kinds[:-1])])
            for s, e in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                if dims[s] != dim:
                    if owns:
                        yield from flush()
                    dim, tiles = int(dims[s]), []
                    waiting.clear()
                    block, tile = max(1, min(query_rows, query_values // dim)), max(1, min(vector_rows, vector_values // dim))
                x = b.column(6)[s:e].flatten().to_numpy(zero_copy_only=False).reshape(e - s, dim)
                if kinds[s] == 0:
                    entries = b.column(5)[s:e]
                    counts, at = entries.value_lengths().to_numpy(zero_copy_only=False).astype("i8"), 0
                    flat = entries.flatten()
                    ids, labels = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).fill_null(NO_LABEL).to_numpy(zero_copy_only=False)
                    ends = np.r_[0, np.cumsum(counts)]
                    while at < e - s:
                        upto = min(e - s, at + tile - sum(len(w[0]) for w in waiting))
                        waiting.append((x[at:upto].copy(), counts[at:upto], ids[ends[at] : ends[upto]], labels[ends[at] : ends[upto]]))
                        at = upto
                        if sum(len(w[0]) for w in waiting) >= tile:
                            close()
                    continue
                close()
                if not tiles:
                    continue
                own = b.column(4)[s:e].to_numpy(zero_copy_only=False)
                for j in range(0, e - s, block):
                    owns.append(own[j : j + block])
                    asked_rows.append(x[j : j + block].copy())
                    if sum(map(len, owns)) >= block:
                        yield from flush()
        if owns:
            yield from flush()

    return dealt.mapInArrow(run, "query_id long, vec_id long, label long, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, label, score, rank: each query's k best vectors by cosine, its own id left out."""
    return top_k(in_groups(queries, vectors, k + 1, False, lambda tiles, q, own: [best_rows(tiles, q, own, k)]), k)


def best_by_label(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, label, score, vec_id: each query's best vector of every label, its own id left out."""
    best = in_groups(queries, vectors, 2, True, best_rows_by_label).groupBy("query_id", "label").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("v"))).alias("m"))
    return best.select("query_id", "label", F.col("m.score").alias("score"), (-F.col("m.v")).alias("vec_id"))


def top_k(sims: DataFrame, k: int) -> DataFrame:
    """The k best per query with their rank; ties go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return sims.withColumn("rank", rank).filter(F.col("rank") <= k)


def max_pool(ranked: DataFrame) -> DataFrame:
    """The best score and example per query and label."""
    return ranked.groupBy("query_id", "label").agg(F.max("score").alias("score"), F.min_by("vec_id", "rank").alias("vec_id"))


def best_patterns(ranked: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "label"))
    return max_pool(ranked).withColumn("r", r).filter(F.col("r") <= k).select("query_id", "label", "vec_id", "score")


def context_fits(required: Column, excluded: Column, has_state: Column, tags: Column) -> Column:
    """What needs a state has one, and no excluded tag is in it."""
    return ~(required & ~has_state) & ~F.arrays_overlap(F.coalesce(excluded, F.array().cast("array<string>")), F.coalesce(tags, F.array().cast("array<string>")))


def pattern_match(queries: DataFrame, library: DataFrame, negatives: DataFrame, patterns: DataFrame, levels: DataFrame, pool: int = 20, margin: float = 0.05) -> DataFrame:
    """Route each query by the pattern library: one row per query.

    The best vectors, pooled by pattern, less deprecated patterns, those too near to one of
    their negatives and those that the session's state excludes; banded by the thresholds of
    the sub-topic, else the topic's, else 0.999. Of several high ones the priority, the score
    and the id decide; else the best medium one, with a warning.

    queries: query_id, q, has_state, tags; patterns: label, topic, sub, priority, deprecated,
    required, excluded; levels: topic or sub, high, medium. The last two are small tables.
    """
    pooled = max_pool(nearest(queries, library, pool))
    against = best_by_label(queries, negatives).select("query_id", "label", F.col("score").alias("negative"))
    known = with_thresholds(patterns.filter("not deprecated"), levels)
    clear = pooled.join(against, ["query_id", "label"], "left").filter(F.col("negative").isNull() | (F.col("score") - F.col("negative") >= margin))
    state = queries.select("query_id", "has_state", "tags")
    fit = clear.join(known, "label").join(state, "query_id").filter(context_fits(F.col("required"), F.col("excluded"), F.col("has_state"), F.col("tags")))
    banded = fit.withColumn("band", F.when(F.col("score") > F.col("high"), 2).when(F.col("score") > F.col("medium"), 1)).filter("band is not null")
    best = banded.groupBy("query_id").agg(F.max(F.struct("band", F.when(F.col("band") == 2, F.col("priority")).otherwise(0).alias("p"), "score", "label")).alias("b"))
    confidence = F.when(F.col("b.band") == 2, "high").when(F.col("b.band") == 1, "medium").otherwise("none")
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", confidence.alias("confidence"), F.col("b.label").alias("pattern"), F.col("b.score").alias("score"), F.when(F.col("b.band") == 1, "LOW_CONFIDENCE").alias("warning"))


def with_thresholds(patterns: DataFrame, levels: DataFrame, default: float = 0.999) -> DataFrame:
    """Add high and medium: the sub-topic's where it names them, else the topic's, else the default; each on its own."""
    subs = levels.filter("sub is not null").select("sub", F.col("high").alias("h_sub"), F.col("medium").alias("m_sub"))
    tops = levels.filter("sub is null").select("topic", F.col("high").alias("h_top"), F.col("medium").alias("m_top"))
    joined = patterns.join(F.broadcast(subs), "sub", "left").join(F.broadcast(tops), "topic", "left")
    return joined.select(*patterns.columns, F.coalesce("h_sub", "h_top", F.lit(default)).alias("high"), F.coalesce("m_sub", "m_top", F.lit(default)).alias("medium"))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the exact lists that the other search found."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.count("*").cast("double")).alias("recall"))


def overfetch(ranked: DataFrame, keep: Column, k: int) -> DataFrame:
    """Filter after the top list was cut, then cut again; the filter must not move below the first cut."""
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return ranked.filter(keep).withColumn("rank", again).filter(F.col("rank") <= k)


def demoted(ranked: DataFrame, marked: Column, factor: float, k: int) -> DataFrame:
    lower = ranked.drop("rank").withColumn("score", F.when(marked, F.col("score") * factor).otherwise(F.col("score")))
    return top_k(lower, k)


def thresholds(keys: DataFrame, levels: DataFrame, default: float = 0.999) -> DataFrame:
    """Sub-topic threshold, else the topic's, else the default; levels is a small table."""
    subs = levels.filter("sub is not null").select("topic", "sub", F.col("threshold").alias("t_sub"))
    tops = levels.filter("sub is null").select("topic", F.col("threshold").alias("t_top"))
    joined = keys.join(subs, ["topic", "sub"], "left").join(tops, "topic", "left")
    return joined.select(*keys.columns, F.coalesce("t_sub", "t_top", F.lit(default)).alias("threshold"))


def compatible(excluded: Column, tags: Column, required: Column, have: Column) -> Column:
    """No excluded tag in the state, and what is required is there."""
    return ~F.arrays_overlap(excluded, tags) & (required.isNull() | F.coalesce(required == have, F.lit(False)))


def knn_vote(nearest: DataFrame, gate: float) -> DataFrame:
    """Majority label of the nearest; ties go to the nearest neighbour's; confidence is the top score."""
    votes = nearest.groupBy("query_id", "label").agg(F.count("*").alias("n"), F.min("rank").alias("near"), F.max("score").alias("s"))
    best = votes.groupBy("query_id").agg(F.max(F.struct("n", (-F.col("near")).alias("near"), "label")).alias("b"), F.max("s").alias("confidence"))
    return best.select("query_id", F.col("b.label").alias("predicted"), "confidence", (F.col("confidence") >= gate).alias("confident"))


def merged(main: DataFrame, curated: DataFrame, k: int) -> DataFrame:
    """Curated hits without a main hit of their title join the main ones, by score, main first."""
    extra = curated.join(main.select("query_id", "title").distinct(), ["query_id", "title"], "left_anti")
    both = main.withColumn("src", F.lit(0)).unionByName(extra.withColumn("src", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "src", "pos"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("curated", F.col("src") == 1)


def reranked(hits: DataFrame, in_title: Column, in_body: Column, key: str) -> DataFrame:
    """Add 0.08 for a title hit and 0.04 for a body hit, 0.15 at most; order is stable."""
    boost = F.least(F.lit(0.15), F.when(in_title, 0.08).otherwise(0.0) + F.when(in_body, 0.04).otherwise(0.0))
    better = hits.withColumn("score", F.col("score") + boost)
    return better.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos", key)))


def consulted(hits: DataFrame, k: int, floor: float, weak: float) -> DataFrame:
    """Token hits before text hits, of sufficient quality, k of them, by quality; says if the best is weak."""
    way = F.when(F.col("token_hit"), 0).otherwise(1)
    good = hits.filter((F.col("token_hit") | F.col("text_hit")) & (F.col("quality") >= floor))
    first = good.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(way, "doc_id"))).filter(F.col("r") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("quality"), "doc_id")))
    return ranked.select("query_id", "rank", "doc_id", (F.max("quality").over(Window.partitionBy("query_id")) < weak).alias("low_confidence"))


def cue_adjusted(hits: DataFrame) -> DataFrame:
    """+0.12 for two cues, +0.06 for one, -0.04 for none where another has two."""
    best = F.max("cues").over(Window.partitionBy("query_id"))
    return hits.withColumn("score", F.col("score") + F.when(F.col("cues") >= 2, 0.12).when(F.col("cues") == 1, 0.06).when(best >= 2, -0.04).otherwise(0.0))


def term_index(docs: DataFrame, pattern: str, k: int) -> DataFrame:
    """The first k documents of each term."""
    terms = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 0))).alias("term"))
    return terms.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).filter(F.col("rank") <= k).select("term", "doc_id", "rank")


#: The boxes of the tiered selection, in the order in which they are tried.
BOXES = ("M", "0", "A", "B", "X", "S")


def tier_selection(rows: DataFrame, strong: float = 0.55) -> DataFrame:
    """query_id, box, sufficient, score, trace of the tiered fallback.

    rows: query_id, fresh, self_ref, allow_wiki, allow_search, and for each box its score
    (null: no result), ok_ (sufficient) and on_ (enabled and available). M is looked up but
    never decides; 0 decides when sufficient and asked about itself or strong; A when
    sufficient; B (the snapshot) when sufficient, unless freshness counts: then it is held over;
    X for queries that are not fresh; S for fresh ones only, whatever the profile allows; at
    last the held over B. The trace names each box tried or why it was skipped.
    """
    on, ok = ({b: F.coalesce(F.col(f"{p}_{b}"), F.lit(False)) for b in BOXES} for p in ("on", "ok"))
    score = {b: F.col(f"score_{b}") for b in BOXES}
    fresh, wiki = F.col("fresh"), F.col("allow_wiki")
    zero = on["0"] & ok["0"] & (F.col("self_ref") | (score["0"] >= strong))
    own = ~zero & on["A"] & ok["A"]
    after = ~zero & ~own
    tried_b = after & wiki & on["B"]
    snap, held = tried_b & ok["B"] & ~fresh, tried_b & ok["B"] & fresh
    late = after & ~snap
    curated = late & ~fresh & on["X"] & ok["X"]
    web_on = on["S"] & fresh
    web = late & ~curated & web_on & ok["S"]
    last = late & ~curated & ~web
    told = lambda b: F.when(ok[b], f"{b}:ok").otherwise(f"{b}:no")
    entry = lambda when, what: F.when(when, what)
    trace = F.array_compact(F.array(
        entry(on["M"] & score["M"].isNotNull(), "M:ok"), F.when(on["0"], told("0")).otherwise("0:skipped"), entry(~zero, F.when(on["A"], told("A")).otherwise("A:skipped")),
        entry(after, F.when(~wiki, "B:skipped by profile").when(on["B"], told("B")).otherwise("B:skipped")), entry(late, "K:skipped"), entry(late, first_match([(~on["X"], "X:skipped"), (fresh, "X:skipped, fresh")], told("X"))),
        entry(late & ~curated & fresh & ~F.col("allow_search") & on["S"], "S:forced by freshness"), entry(late & ~curated, first_match([(web_on, told("S")), (~fresh & ~F.col("allow_search"), "S:skipped by profile"), (~on["S"], "S:skipped")], "S:skipped, not fresh")), entry(last & held, "B:held over"),
    ))
    box = first_match([(zero, "0"), (own, "A"), (snap, "B"), (curated, "X"), (web, "S"), (last & held, "B")], "failed")
    of_box = first_match([(zero, score["0"]), (own, score["A"]), (snap, score["B"]), (curated, score["X"]), (web, score["S"]), (last & held, score["B"])], 0.0)
    return rows.select("query_id", box.alias("box"), (box != "failed").alias("sufficient"), of_box.alias("score"), F.array_join(trace, " ").alias("trace"))


def box_flags(settings: DataFrame, key: str) -> DataFrame:
    """key, box, enabled from (key, setting, value) texts: a box's own setting, for B the newer name before the old one, else on.

    Words for no and yes count, other values leave the default. Settings of one name are to be one for a key.
    """
    word = F.lower(F.trim("value"))
    known = settings.select(key, "setting", F.when(word.isin("0", "false", "no", "off"), False).when(word.isin("1", "true", "yes", "on"), True).alias("flag")).filter("flag is not null")
    asked = settings.sparkSession.createDataFrame([("0", "BOX_0", 0), ("A", "BOX_A", 0), ("B", "BOX_W", 0), ("B", "BOX_B", 1), ("S", "BOX_S", 0), ("K", "BOX_KIWIX", 0)], "box string, setting string, turn int")
    all_ = settings.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, ("0", "A", "B", "S", "K")))).alias("box"))
    found = known.join(F.broadcast(asked), "setting").groupBy(key, "box").agg(F.min(F.struct("turn", "flag")).alias("f"))
    return all_.join(found, [key, "box"], "left").select(key, "box", F.coalesce("f.flag", F.lit(True)).alias("enabled"))


def supplementary(selected: DataFrame, wanted: Column) -> Column:
    """The note of a further, never deciding, look into B after A has decided, where the profile asks for it."""
    return first_match([(selected["box"] != "A", "none"), (~wanted, "not asked"), (~F.col("allow_wiki"), "off by profile"), (F.col("fresh"), "off, fresh"), (~F.coalesce(F.col("on_B"), F.lit(False)), "not available")], "consulted")


#: Rows that pivots are fitted on, and pivots at most.
PIVOT_ROWS, PIVOTS = 4096, 64


def pivot_tiles(vectors: DataFrame, threshold: float, pivots: int = PIVOTS) -> tuple[tuple[DataFrame, list[tuple[int, int, int]]], float]:
    """((id, label, x, dim, cell), pairs of cells (dim, cell, cell)) that can hold a cosine of the threshold, and the share of cell pairs kept.

    Unit vectors are dealt into cells by their nearest pivot. A cosine of t is a distance of
    sqrt(2 - 2 t), so that by the triangle inequality two cells cannot hold such a pair if their
    pivots are farther apart than that and both radii. The pivots (of a bounded sample) and a row
    for each cell pass the driver. Thresholds are to be above 0; zero vectors reach none and take
    no part.
    """
    from verdigris.operators.ann import lloyd, units
    from verdigris.session import scratch

    if threshold <= 0:
        raise ValueError("pivots need a threshold above 0")
    spark = vectors.sparkSession
    ship(spark)
    good = labelled_vectors(vectors).filter(F.exists("x", lambda v: v != 0))
    sample = [r["x"] for r in good.orderBy(F.xxhash64("id"), "id").limit(PIVOT_ROWS).select("x").collect()]
    of_dim = {d: units(np.array([x for x in sample if len(x) == d], "f8")) for d in {len(x) for x in sample}}
    centers = {d: lloyd(x, max(1, min(pivots, len(x) // 4)), 5, 1) for d, x in of_dim.items()}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sizes = np.diff(b.column(2).offsets.to_numpy())
            cell, far = np.zeros(b.num_rows, "i4"), np.full(b.num_rows, 2.0)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                if d in centers:
                    unit = units(b.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d).astype("f8"))
                    gap = np.sqrt(np.maximum(0, (unit**2).sum(axis=1)[:, None] + (centers[d] ** 2).sum(axis=1)[None, :] - 2 * unit @ centers[d].T))
                    cell[at], far[at] = gap.argmin(axis=1), gap.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes.astype("i4")), pa.array(cell), pa.array(far)], names=["id", "label", "x", "dim", "cell", "far"])

    path = scratch(spark, "pivots")
    kind = good.schema["x"].dataType.simpleString()
    good.mapInArrow(run, f"id long, label long, x {kind}, dim int, cell int, far double").write.parquet(path)
    dealt = spark.read.parquet(path)
    cells = {(r["dim"], r["cell"]): r["far"] for r in dealt.groupBy("dim", "cell").agg(F.max("far").alias("far")).collect()}
    reach, pairs = math.sqrt(2 - 2 * min(threshold, 1.0)) + NEAR, []
    for (d, a), far_a in cells.items():
        for (e, b), far_b in cells.items():
            # Vectors of a dimension that the sample lacks have no pivot: their one cell meets itself.
            if d == e and (d not in centers or np.linalg.norm(centers[d][a] - centers[d][b]) <= reach + far_a + far_b):
                pairs.append((d, a, b))
    every = sum(1 for d, _ in cells for e, _ in cells if d == e)
    return (dealt.drop("far"), pairs), len(pairs) / max(every, 1)


def labelled_vectors(vectors: DataFrame) -> DataFrame:
    """(id, label, x) of the rows that have all three."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "array<double>"
    return vectors.filter(usable("vec_id", "embedding") & F.col("label").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("x"))


def conflicts(vectors: DataFrame, threshold: float, pivots: int | None = None) -> DataFrame:
    """The closest pair of each two patterns, if close enough; a task gives one pair for each two labels.

    Equal vectors of a label collapse to the smallest id. Groups of bounded bytes are dealt by hash;
    each group's rows stream past half of the groups, so that each two groups meet. Without a number
    of pivots there are four for each 4 million numbers; where they rule out less than half of the
    cell pairs, all meet in whole tiles, as small ones cost more than their pairs.
    """
    spark = vectors.sparkSession
    ship(spark)
    good = labelled_vectors(vectors)
    different, values = good.agg(F.approx_count_distinct(F.xxhash64("x", "label")), F.coalesce(F.sum(F.size("x")), F.lit(0))).first()
    if pivots is None:
        pivots = min(PIVOTS, max(1, 4 * (values // VECTOR_VALUES)))
    rows, meeting = good.select("id", "label", "x", F.size("x").alias("dim"), F.lit(0).alias("cell")), None
    if pivots > 1:
        (dealt, pairs), share = pivot_tiles(vectors, threshold, pivots)
        rows, meeting = (dealt, frozenset(pairs)) if share <= 0.5 else (dealt.withColumn("cell", F.lit(0)), None)
    width = 4 if rows.schema["x"].dataType.elementType.typeName() == "float" else 12
    n = max(1, math.ceil(values * width / HELD), min(spark.sparkContext.defaultParallelism, math.ceil(different / CANDIDATES)))
    classes = rows.groupBy("dim", "cell", "label", "x").agg(F.min("id").alias("id")).withColumn("own", F.pmod(F.xxhash64("x"), F.lit(n)).cast("int"))
    held = classes.select(F.col("own").alias("group"), "dim", F.lit(0).alias("kind"), "cell", "label", "id", "x")
    step = F.explode(F.sequence(F.lit(0), F.lit(n // 2)))
    moved = classes.withColumn("step", step).select(F.pmod(F.col("own") + F.col("step"), F.lit(n)).cast("int").alias("group"), "dim", F.lit(1).alias("kind"), "cell", "label", "id", "x")
    spread = held.union(moved).repartitionById(n, F.col("group")).sortWithinPartitions("dim", "kind", "cell", "label")
    query_values, vector_values, query_rows, vector_rows = QUERY_VALUES, VECTOR_VALUES, QUERIES, CANDIDATES

    def pieces(batches):
        """(dim, kind, cell, x, ids, labels) of bounded pieces, none of which crosses a cell."""
        at, parts, size = None, [], 0
        for b in (b for b in batches if b.num_rows):
            keys = np.stack([b.column(i).to_numpy() for i in (1, 2, 3)], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for s, e in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                key = tuple(keys[s].tolist())
                if key != at:
                    if size:
                        yield (*at, *map(np.concatenate, zip(*parts, strict=True)))
                    at, parts, size = key, [], 0
                    most = max(1, min(vector_rows, vector_values // key[0]) if key[1] == 0 else min(query_rows, query_values // key[0]))
                x = b.column(6)[s:e].flatten().to_numpy(zero_copy_only=False).reshape(e - s, key[0])
                ids, labels = (b.column(i)[s:e].to_numpy(zero_copy_only=False) for i in (5, 4))
                j = 0
                while j < e - s:
                    k = min(e - s, j + most - size)
                    parts.append((x[j:k].copy(), ids[j:k].copy(), labels[j:k].copy()))
                    size, j = size + k - j, k
                    if size == most:
                        yield (*at, *map(np.concatenate, zip(*parts, strict=True)))
                        parts, size = [], 0
        if size:
            yield (*at, *map(np.concatenate, zip(*parts, strict=True)))

    def run(batches):
        import pyarrow as pa

        of, tiles, best = None, [], {}
        for dim, kind, cell, x, ids, labels in pieces(batches):
            if dim != of:
                of, tiles = dim, []
            if kind == 0:
                tiles.append((cell, Tile(x, np.ones(len(x), "i8"), ids, labels)))
            else:
                q = Block(x)
                for other, t in tiles:
                    if meeting is None or (dim, cell, other) in meeting:
                        closest(q, ids, labels, t, threshold, best)
        if best:
            found = [(*key, *pair) for key, pair in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["label_a", "label_b", "score", "id_a", "id_b"])

    pairs = spread.mapInArrow(run, "label_a long, label_b long, score double, id_a long, id_b long")
    best = pairs.groupBy("label_a", "label_b").agg(F.max(F.struct("score", (-F.col("id_a")).alias("a"), (-F.col("id_b")).alias("b"))).alias("m"))
    return best.filter(F.col("m.score") >= threshold).select("label_a", "label_b", (-F.col("m.a")).alias("id_a"), (-F.col("m.b")).alias("id_b"), F.col("m.score").alias("score"))


def closest(q: Block, ids: np.ndarray, labels: np.ndarray, t: Tile, threshold: float, best: dict) -> None:
    """Put the closest pair (score, id, id) of each two labels of a block and a tile, both sorted by label, into ``best``, if it reaches the threshold."""
    found, odd = t.products(q, None), bool(q.odd.any() or t.odd.any())
    edges = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
    few = len(edges) * len(t.edges) <= 256
    names = [(min(x, y), max(x, y)) for x in labels[edges].tolist() for y in t.label[t.edges].tolist()] if few else []
    # Mostly nothing of a tile comes near to the best pairs so far.
    if few and not odd and float(found.max()) < min((best[n][0] if n in best else threshold for n in names if n[0] != n[1]), default=math.inf) - t.slack:
        return
    top = np.maximum.reduceat(np.maximum.reduceat(found, t.edges, axis=1), edges, axis=0).astype("f8")
    if odd:
        top[:] = np.inf
    ends, stops = np.r_[edges[1:], len(labels)], np.r_[t.edges[1:], len(t.label)]
    for i, j in zip(*np.nonzero(top >= threshold - t.slack), strict=True):
        x, y = int(labels[edges[i]]), int(t.label[t.edges[j]])
        key, low = (min(x, y), max(x, y)), threshold
        if key in best:
            low = best[key][0]
        if x == y or top[i, j] < low - t.slack:
            continue
        part = found[edges[i] : ends[i], t.edges[j] : stops[j]]
        least = -np.inf if odd else max(low - t.slack, top[i, j] - 2 * t.slack)
        rows, cols = np.nonzero(part >= np.nextafter(np.array(least, part.dtype), np.array(-np.inf, part.dtype)))
        rows, cols = rows + edges[i], cols + t.edges[j]
        step = max(1, PAIR_VALUES // t.coded.shape[0])
        for s in range(0, len(rows), step):
            a, c = rows[s : s + step], cols[s : s + step]
            score = t.exact(q, a, c)
            good = np.isfinite(score) & (score >= threshold)
            if good.any():
                score, mine, other = score[good], ids[a[good]], t.ids[c[good]]
                first, second = (mine, other) if x < y else (other, mine)
                k = np.lexsort((second, first, -score))[0]
                pair = (float(score[k]), int(first[k]), int(second[k]))
                if key not in best or (pair[0], -pair[1], -pair[2]) > (best[key][0], -best[key][1], -best[key][2]):
                    best[key] = pair


def relation_threshold(same_sub_topic: Column, same_topic: Column) -> Column:
    return F.when(same_sub_topic, 0.92).when(same_topic, 0.92).otherwise(0.95)


def two_gates(positive: DataFrame, negative: DataFrame, p: float, n: float) -> DataFrame:
    """Candidates far enough from all positives and all negatives."""
    a = positive.groupBy("query_id").agg(F.max("score").alias("p"))
    b = negative.groupBy("query_id").agg(F.max("score").alias("n"))
    return a.join(b, "query_id").select("query_id", ((F.col("p") < p) & (F.col("n") < n)).alias("accepted"))
