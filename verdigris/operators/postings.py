"""Posting lists as tables: term look-up with first-seen merging, and substring search by trigrams.

A posting list is cut into blocks of BLOCK consecutive document numbers; a block is one row with
its first document and the gaps to the next ones. So no row grows with the documents, and a term
of a third of all documents is many rows. Blocks are stored in ranges of the term, for readers
that skip by it. Document numbers are whole and not negative.

Look-up: a query's terms in order, each list in order of documents, a document counts where it is
seen first, the first k stay. No more than the first k of each list can matter, and only blocks
that hold these are decoded. Substring search: the rarest trigrams of what is sought are
intersected, and what is left is verified in the texts; strings of under three characters have
no trigram and are sought in all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from verdigris.functions.text import all_grams
from verdigris.session import scratch, ship

#: Documents of a block, and trigrams that a search intersects.
BLOCK, RAREST = 1 << 16, 3


def postings(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, block, first, n, gaps) from (term, doc_id); repeated pairs count once."""
    good = pairs.filter("term is not null and doc_id is not null").select("term", F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = good.groupBy("term", F.floor(F.col("doc_id") / block).alias("block")).agg(F.sort_array(F.collect_list("doc_id")).alias("d"))
    gaps = F.transform(F.slice("d", 2, F.size("d")), lambda x, i: (x - F.get("d", i)).cast("int"))
    return held.select("term", "block", F.get("d", 0).alias("first"), F.size("d").alias("n"), gaps.alias("gaps"))


def stored(lists: DataFrame, path: str | None = None) -> DataFrame:
    """The lists written in ranges of (term, block) and read again."""
    spark = lists.sparkSession
    path = path or scratch(spark, "postings")
    lists.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(path)
    return spark.read.schema(lists.schema).parquet(path)


@F.arrow_udf(ArrayType(LongType()))
def _summed(first: pa.Array, gaps: pa.Array) -> pa.Array:
    """The running sums of each row's gaps from its first, in one pass over all rows."""
    n = gaps.value_lengths().to_numpy(zero_copy_only=False).astype("i8") + 1
    ends = np.cumsum(n)
    starts = ends - n
    steps = np.empty(n.sum(), "i8")
    later = np.ones(len(steps), bool)
    later[starts] = False
    steps[starts] = first.to_numpy(zero_copy_only=False)
    steps[later] = gaps.flatten().to_numpy(zero_copy_only=False)
    total = np.cumsum(steps)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype("i4")), pa.array(total - np.repeat(total[starts] - steps[starts], n)))


def documents_of(first: Column, gaps: Column, most: Column | None = None) -> Column:
    """The documents of a block, or the first of them."""
    cut = gaps if most is None else F.slice(gaps, 1, F.greatest(most - 1, F.lit(0)).cast("int"))
    return _summed(first, cut)


def term_index(docs: DataFrame, terms: Column, block: int = BLOCK) -> DataFrame:
    """The posting lists of an array of terms for each document (doc_id)."""
    return postings(docs.select("doc_id", F.explode(terms).alias("term")), block)


def heads(lists: DataFrame, k: int) -> DataFrame:
    """(term, documents) of the blocks that hold each term's first k documents, no more of a block than that."""
    ship(lists.sparkSession)
    before = F.sum("n").over(Window.partitionBy("term").orderBy("block")) - F.col("n")
    # The window sees a term's block numbers; gaps are met again by a key that is unique.
    wanted = lists.select("term", "block", "n").withColumn("before", before).filter(F.col("before") < k).select("term", "block", "before")
    return lists.join(wanted, ["term", "block"]).select("term", documents_of(F.col("first"), F.col("gaps"), F.lit(k) - F.col("before")).alias("documents"))


def looked_up(queries: DataFrame, lists: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """(key, rank, doc_id, term): the first k documents of each query's terms, by term, then document.

    queries: key, terms (array, in order). A term that repeats counts where it is first.
    """
    asked = queries.select(key, F.posexplode(F.array_distinct("terms")).alias("pos", "term")).filter("term is not null")
    # Only terms that are asked for; each once, so that a term of many queries is decoded once.
    needed = lists.join(asked.select("term").distinct(), "term", "left_semi")
    seen = asked.join(heads(needed, k), "term").select(key, "pos", "term", F.explode("documents").alias("doc_id"))
    first = seen.groupBy(key, "doc_id").agg(F.min(F.struct("pos", "term")).alias("at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("at.pos", "doc_id"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= k).select(key, "rank", "doc_id", F.col("at.term").alias("term"))


def trigrams(text: Column) -> Column:
    """The trigrams of a text in lower case; none below three characters."""
    return all_grams(F.lower(text), 3)


def grams_of(text: str, n: int) -> np.ndarray:
    """The different n-grams (one to three characters) of a text, as numbers of 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("i8")
    if len(c) < n:
        return np.zeros(0, "i8")
    found = c[: len(c) - n + 1].copy()
    for k in range(1, n):
        found = found << 21 | c[k : len(c) - n + 1 + k]
    return np.unique(found)


def strings_of(codes: np.ndarray, n: int) -> list[str]:
    """The n-grams that the numbers stand for."""
    points = np.stack([codes >> 21 * k & 0x1FFFFF for k in range(n - 1, -1, -1)], axis=1).astype("<u4")
    whole = points.tobytes().decode("utf-32-le")
    return [whole[k : k + n] for k in range(0, len(whole), n)]


def lowered(texts: DataFrame) -> DataFrame:
    """(doc_id, text) in lower case, of the rows that have both."""
    return texts.filter("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))


def trigram_index(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Posting lists of the trigrams of (doc_id, text).

    A task takes each text's different trigrams and gathers them for its batch, so that what is
    shuffled is a list for each trigram, block and batch, of places in the block.
    """
    ship(texts.sparkSession)

    def run(batches):
        for b in (b for b in batches if b.num_rows):
            ids = b.column(0).to_numpy()
            found = [grams_of(t, 3) for t in b.column(1).to_pylist()]
            docs, codes = np.repeat(ids, [len(f) for f in found]), np.concatenate(found)
            order = np.lexsort((docs, codes))
            docs, codes = docs[order], codes[order]
            at = docs // block
            starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (at[1:] != at[:-1])]) if len(docs) else np.zeros(0, "i8")
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(docs)].astype("i4")), pa.array((docs - at * block).astype("i4")))
            yield pa.RecordBatch.from_arrays([pa.array(strings_of(codes[starts], 3), pa.string()), pa.array(at[starts]), lists], names=["term", "block", "places"])

    parts = lowered(texts).mapInArrow(run, "term string, block long, places array<int>")
    held = parts.groupBy("term", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("d"))
    gaps = F.transform(F.slice("d", 2, F.size("d")), lambda x, i: x - F.get("d", i))
    return held.select("term", "block", (F.col("block") * block + F.get("d", 0)).alias("first"), F.size("d").alias("n"), gaps.alias("gaps"))


def holding(texts: DataFrame, few: list[str]) -> DataFrame:
    """(doc_id, s) for each text and each of some strings of one or two characters, in lower case, that it holds."""
    ship(texts.sparkSession)
    sought = {n: sorted({s for s in few if len(s) == n}) for n in (1, 2)}

    def run(batches):
        # By their numbers, which are in the order of the strings' code points.
        known = {n: np.array([grams_of(s, n)[0] for s in of], "i8") for n, of in sought.items() if of}
        for b in (b for b in batches if b.num_rows):
            docs, names = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, codes in known.items():
                    for k in np.flatnonzero(np.isin(codes, grams_of(text, n))).tolist():
                        docs.append(doc)
                        names.append(sought[n][k])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(names, pa.string())], names=["doc_id", "s"])

    return lowered(texts).mapInArrow(run, "doc_id long, s string")


def candidates(queries: DataFrame, lists: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(query_id, doc_id): documents that hold the rarest trigrams of what is sought.

    A string with a trigram that no document has gives none.
    """
    ship(queries.sparkSession)
    asked = queries.select("query_id", F.explode(F.array_distinct(trigrams(F.col("sought")))).alias("term"))
    sizes = lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    told = asked.join(sizes, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))
    few = told.withColumn("place", place).filter(F.col("place") <= rarest).withColumn("of", F.count("*").over(Window.partitionBy("query_id")))
    held = few.filter("df > 0").join(lists, "term").select("query_id", "of", "block", documents_of(F.col("first"), F.col("gaps")).alias("d"))
    # At most a block's documents for each of a query's trigrams.
    whole = held.groupBy("query_id", "block").agg(F.collect_list("d").alias("all"), F.max("of").alias("of")).filter(F.size("all") == F.col("of"))
    common = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", 0), lambda a, x: F.array_intersect(a, x))
    return whole.select("query_id", F.explode(common).alias("doc_id"))


def containing(queries: DataFrame, texts: DataFrame, lists: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(query_id, doc_id) where the text holds what is sought (query_id, sought), whatever the case; nothing is sought by ''."""
    good = queries.filter("length(sought) > 0")
    known = texts.filter("text is not null and doc_id is not null").select("doc_id", "text")
    hit = F.contains(F.lower("text"), F.lower("sought"))
    long = candidates(good, lists, rarest).join(good.select("query_id", "sought"), "query_id").join(known, "doc_id").filter(hit)
    # Short strings: the distinct ones, of at most two characters, go with every task.
    short = good.filter(F.length(F.lower("sought")) < 3)
    few = [r["s"] for r in short.select(F.lower("sought").alias("s")).distinct().collect()]
    found = long.select("query_id", "doc_id")
    if few:
        found = found.unionByName(short.join(holding(known, few), F.lower("sought") == F.col("s")).select("query_id", "doc_id"))
    return found.distinct()
