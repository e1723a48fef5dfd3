"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes a sketch: number of distinct shingles, a 128-bit fingerprint of the
   shingle set, band keys of its minhashes and a short signature. Equal fingerprints collapse
   into one class, represented by its smallest id, so copies never form pairs. Every member
   is confirmed against its representative on the full sets; one that differs stands alone.
2. Members of a band bucket are candidates. First each is paired with the bucket's smallest
   member (a star, linear in the bucket); links found join components; then members of
   different components of one bucket meet in tiles of bounded blocks, never as rows.
3. Candidates compare their signatures batch by batch and are dropped as soon as the
   posterior probability of reaching the threshold falls below ``miss``; survivors are
   confirmed on their full shingle sets as byte strings.
4. Components follow by repeated minimum over neighbours with pointer jumping.

With rows=5 and bands=40 a pair exactly at similarity 0.75 shares no bucket with
probability 2e-5, more similar ones less.

Defined cases: null, empty and blank texts have no shingles and link with nothing; fewer
words than ``width`` form one shingle; a text of any length is taken whole; rows that share
an id are one node that links by each of its texts; a null id links with nothing and is
kept; of tied ids and repeated rows the smallest id represents; an empty table gives none;
extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import Memo, workers_ready, written

WIDTH, NUMERATOR, DENOMINATOR = 5, 75, 100
ROWS, BANDS, SIGNATURE, BATCH, MISS = 5, 40, 128, 32, 1e-6
#: What rows of one class share.
CLASS = ("fp1", "fp2", "apart")
#: Hashes of one step of the minima; members that one copy of a representative's text confirms.
_BLOCK, COPIES = 4096, 1000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of a worker whose hashes are kept.
_WORDS = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hash(word: bytes) -> int:
    """A keyed cryptographic hash: no construction of words makes two of them meet."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"near-duplicates").digest(), "little")


_HASHES = Memo(_word_hash, _WORDS)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return np.fromiter(map(_HASHES.__getitem__, words), "u8", len(words))


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    total = np.full(n, min(len(words), width), "u8")
    for k in range(min(width, len(words))):
        total = mixed(total + words[k : k + n] * np.uint64(2 * k + 3))
    return np.unique(total)


def shingle_set(text: str, width: int = WIDTH) -> set[bytes]:
    """The distinct shingles themselves."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)}


@lru_cache(maxsize=2)
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_601)
    return draw.integers(1, 1 << 32, n, "u4") | np.uint32(1), draw.integers(0, 1 << 32, n, "u4")


def minhashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """n minima of a multiply-add family over the hashes' upper halves."""
    a, b = _family(n)
    keys, least = (hashes >> np.uint64(32)).astype("u4"), np.full(n, 0xFFFFFFFF, "u4")
    for k in range(0, len(keys), _BLOCK):
        np.minimum(least, (a[:, None] * keys[None, k : k + _BLOCK] + b[:, None]).min(axis=1), out=least)
    return least


def sketches(docs: DataFrame, width: int = WIDTH, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """id, own (the row's text), n, fp1, fp2 (of the set), sig (low halves of minhashes), keys (of the bands)."""
    workers_ready(docs.sparkSession)
    n_hashes, salt = max(rows * bands, SIGNATURE), np.arange(bands, dtype="u8") * np.uint64(0xD1B54A32D192ED03)

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in b.column(2).to_pylist():
                h = shingle_hashes(text, width)
                if len(h):
                    least = minhashes(h, n_hashes)
                    keys = salt
                    for k in range(rows):
                        keys = mixed(keys + least[k : rows * bands : rows].astype("u8") + np.uint64(1))
                    row = [len(h), int(mixed(h).sum(dtype="u8").astype("i8")), int(mixed(h + np.uint64(77)).sum(dtype="u8").astype("i8")), least[:SIGNATURE].astype("<u2").tobytes(), keys.astype("i8")]
                else:
                    row = [0, 0, 0, b"", np.zeros(0, "i8")]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["id", "own", "n", "fp1", "fp2", "sig", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("own"), "text").mapInArrow(run, "id long, own long, n long, fp1 long, fp2 long, sig binary, keys array<bigint>")


def strays(texts: DataFrame, width: int = WIDTH, a_copy: int = COPIES) -> DataFrame:
    """(id, own) of the texts whose full shingle set is not that of their class's representative.

    texts: (id, own, text, rep, rep_own, n), n rows in the class. The representative's text is
    copied once for ``a_copy`` members, so that no class is one group.
    """
    copies = F.ceil(F.col("n") / a_copy).cast("int")
    members = texts.filter("id != rep or own != rep_own").select("id", "own", "text", "rep", F.pmod(F.xxhash64("id", "own"), copies).cast("int").alias("copy"))
    reps = texts.filter("id = rep and own = rep_own and n > 1").select("rep", F.col("text").alias("rep_text"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    workers_ready(texts.sparkSession)

    def run(batches):
        sets = lru_cache(maxsize=16)(lambda text: shingle_set(text, width))
        for t in batches:
            differ = [x != y and sets(x) != sets(y) for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["id", "own"]).filter(pa.array(differ, pa.bool_()))

    return members.join(reps, ["rep", "copy"]).select("id", "own", "text", "rep_text").mapInArrow(run, "id long, own long")


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float, size: int = SIGNATURE, batch: int = BATCH) -> tuple[tuple[int, int], ...]:
    """(hashes compared, matches needed): fewer matches leave P(similarity >= threshold) below miss.

    With a uniform prior the posterior is a beta distribution, whose tail is a binomial sum.
    """

    def tail(n: int, m: int) -> float:
        return sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return tuple((n, next(m for m in range(n + 1) if tail(n, m) >= miss)) for n in range(batch, size + 1, batch))


def likely(pairs: DataFrame, signatures: DataFrame, threshold: float, miss: float = MISS) -> DataFrame:
    """Pairs (a, b) whose signatures survive every batch."""
    steps = least_matches(threshold, miss)
    workers_ready(pairs.sparkSession)

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(t.column(k).to_pylist()), "<u2").reshape(t.num_rows, -1) for k in (2, 3))
            alive, matches, done = np.arange(t.num_rows), np.zeros(t.num_rows, int), 0
            for n, least in steps:
                matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
                alive, done = alive[matches[alive] >= least], n
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).take(pa.array(alive))

    both = pairs.join(signatures.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(signatures.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity."""
    workers_ready(pairs.sparkSession)

    def run(batches):
        sets = lru_cache(maxsize=64)(lambda text: shingle_set(text, width))
        for t in batches:
            good = []
            for k, (x, y) in enumerate(zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)):
                p, q = sets(x), sets(y)
                shared = len(p & q)
                if denominator * shared >= numerator * (len(p) + len(q) - shared):
                    good.append(k)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).take(pa.array(good, pa.int64()))

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def tile_survivors(left: list[dict], right: list[dict], key: int, steps) -> list[tuple[int, int]]:
    """Places (i, j) in two blocks of one bucket that signatures cannot tell apart, the likeliest first.

    Only pairs of different components count, each in the first band that it shares. Signatures
    are compared in batches for all pairs at once.
    """
    sig = [np.frombuffer(b"".join(m["sig"] for m in side), "<u2").reshape(len(side), -1) for side in (left, right)]
    comps = [np.array([m["comp"] for m in side]) for side in (left, right)]
    x, y = np.nonzero(comps[0][:, None] != comps[1][None, :])
    matches, done = np.zeros(len(x), int), 0
    for n, least in steps:
        matches = matches + (sig[0][x, done:n] == sig[1][y, done:n]).sum(axis=1)
        alive = matches >= least
        x, y, matches, done = x[alive], y[alive], matches[alive], n
    if not len(x):
        return []
    keys = [np.array([m["keys"] for m in side]) for side in (left, right)]
    here = (keys[0] == key).argmax(axis=1)
    first = (keys[0][x] == keys[1][y]).argmax(axis=1) == here[x]
    order = np.argsort(-matches[first], kind="stable")
    return list(zip(x[first][order].tolist(), y[first][order].tolist(), strict=True))


def tile_links(pairs: list[dict], texts: dict, width: int, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Links among a tile's survivors by full sets; what a link has joined needs no further test.

    pairs: a, b, their own and components, the likeliest first; texts: (id, own) -> text.
    """
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    sets = lru_cache(maxsize=None)(lambda k: shingle_set(texts[k], width))
    found = []
    for m in pairs:
        c, d = find(m["c"]), find(m["d"])
        if c == d:
            continue
        p, q = sets((m["a"], m["a_own"])), sets((m["b"], m["b_own"]))
        if denominator * min(len(p), len(q)) < numerator * max(len(p), len(q)):
            continue
        shared = len(p & q)
        if denominator * shared >= numerator * (len(p) + len(q) - shared):
            found.append((m["a"], m["b"]))
            root[c] = d
    return found


TILE = ["key", "block", "side"]
PAIRS = "array<struct<a:bigint,a_own:bigint,b:bigint,b_own:bigint,c:bigint,d:bigint>>"


def survivors(buckets: DataFrame, labels: DataFrame, signed: DataFrame, texts: DataFrame, threshold: float, miss: float, size: int = 128, most_chars: int = 4_000_000) -> DataFrame:
    """(key, block, side, pairs) of the tiles in which some pair of different components survives.

    In each bucket, members outside its largest component meet all members, in tiles of bounded
    blocks: no more members than ``size``, and no more characters of text than ``most_chars``
    but for one text. Only signatures go through the tiles. Pairs are never rows.
    """
    member = written(buckets.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")), "members")
    parts = member.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1").select("key", F.col("main.comp").alias("main"))
    mixed_ = written(member.join(main, "key"), "mixed")
    known = texts.select("id", "own", F.length("text").alias("chars")).join(signed, ["id", "own"])
    there = written(mixed_.join(known, "id").select("key", (F.col("comp") != F.col("main")).alias("outside"), "chars", F.struct("id", "own", "comp", "sig", "keys").alias("m")), "bucket-members")
    spread = lambda n, chars: F.greatest(F.ceil(n / size), F.ceil(chars / most_chars), F.lit(1)).cast("int")
    counts = written(there.groupBy("key").agg(spread(F.count("*"), F.sum("chars")).alias("all"), spread(F.count_if("outside"), F.sum(F.when(F.col("outside"), F.col("chars")).otherwise(0))).alias("out")), "bucket-sizes")
    # Blocks are dealt by (key, block), never by the key alone: a hot bucket is many tasks.
    dealt = there.join(counts, "key")
    block = lambda n: F.pmod(F.xxhash64("m.id"), F.col(n)).cast("int")
    outside = dealt.filter("outside").select("key", block("out").alias("block"), "m").repartition("key", "block").groupBy("key", "block").agg(F.collect_list("m").alias("left"))
    inside = dealt.select("key", "out", block("all").alias("side"), "m").repartition("key", "side").groupBy("key", "out", "side").agg(F.collect_list("m").alias("right")).select("key", "side", "right", F.explode(F.sequence(F.lit(0), F.col("out") - 1)).alias("block"))
    steps = least_matches(threshold, miss)
    workers_ready(buckets.sparkSession)

    def run(batches):
        for t in batches:
            found: list = []
            for k, block_, side, left, right in zip(*(t.column(c).to_pylist() for c in range(5)), strict=True):
                near = [{"a": left[i]["id"], "a_own": left[i]["own"], "b": right[j]["id"], "b_own": right[j]["own"], "c": left[i]["comp"], "d": right[j]["comp"]} for i, j in tile_survivors(left, right, k, steps)]
                if near:
                    found.append((k, block_, side, near))
            if found:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([(f, pa.int64()) for f in ("a", "a_own", "b", "b_own", "c", "d")])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=[*TILE, "pairs"])

    tiles = outside.join(inside, ["key", "block"]).select(*TILE, "left", "right")
    return tiles.mapInArrow(run, f"key long, block int, side int, pairs {PAIRS}")


def between(buckets: DataFrame, labels: DataFrame, signed: DataFrame, texts: DataFrame, threshold: float, miss: float, width: int, numerator: int, denominator: int, size: int = 128, most_chars: int = 4_000_000) -> DataFrame:
    """Links (a, b) between different components that share a bucket.

    Texts are joined to the tiles in which they survive, once for each; a text that no
    signature comes near is not shuffled, however large its bucket is.
    """
    near = written(survivors(buckets, labels, signed, texts, threshold, miss, size, most_chars), "survivors")
    one = lambda f: F.transform("pairs", lambda p: F.struct(p[f].alias("id"), p[f"{f}_own"].alias("own")))
    wanted = near.select(*TILE, F.explode(F.array_distinct(F.concat(one("a"), one("b")))).alias("w")).select(*TILE, "w.id", "w.own")
    held = wanted.join(texts.select("id", "own", "text"), ["id", "own"]).groupBy(*TILE).agg(F.collect_list(F.struct("id", "own", "text")).alias("texts"))

    def run(batches):
        for t in batches:
            found = [x for pairs, own in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True) for x in tile_links(pairs, {(m["id"], m["own"]): m["text"] for m in own}, width, numerator, denominator)]
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["a", "b"])

    return written(near.join(held, TILE).select("pairs", "texts").mapInArrow(run, "a long, b long").distinct(), "rest")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every end of an edge (a, b): comp is the smallest id reachable."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both["a"] == labels["id"]).groupBy(F.col("b").alias("id")).agg(F.min("comp").alias("near"))
        once = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("once"))
        jump = labels.select(F.col("id").alias("once"), F.col("comp").alias("far"))
        found = written(once.join(jump, "once").select("id", F.least("once", "far").alias("comp"), (F.least("once", "far") != F.col("old")).alias("moved")), "labels")
        labels = found.select("id", "comp")
        if found.filter("moved").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, rows: int = ROWS, bands: int = BANDS, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    threshold = numerator / denominator
    sketch = written(sketches(docs, width, rows, bands), "sketches")
    full = sketch.filter("n > 0 and id is not null").withColumn("apart", F.lit(""))
    known = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("own"), "text").filter("text is not null")
    if not full.groupBy("id", "own").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
        known = known.dropDuplicates(["id", "own"])

    while True:
        classes = written(full.groupBy(*CLASS).agg(F.min(F.struct("id", "own")).alias("first"), F.count("*").alias("c")).select(*CLASS, F.col("first.id").alias("rep"), F.col("first.own").alias("rep_own"), "c"), "classes")
        reps = full.select(*CLASS, "id", "own", "sig", "keys").join(classes.select(*CLASS, F.col("rep").alias("id"), F.col("rep_own").alias("own")), [*CLASS, "id", "own"]).dropDuplicates(["id", "own"])
        banded = reps.select("id", F.explode("keys").alias("key")).distinct()
        shared = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot < last").select("key", "pivot")
        buckets = written(banded.join(shared, "key"), "buckets")
        ids = written(buckets.select("id").distinct(), "candidates")
        # Texts are shuffled once, those of candidates and of classes with several members.
        told = full.select(*CLASS, "id", "own").distinct().join(classes, [*CLASS]).join(ids.withColumn("paired", F.lit(True)), "id", "left")
        wanted = told.filter("c > 1 or paired").select("id", "own", "rep", "rep_own", F.col("c").alias("n"), "paired")
        texts = written(known.join(wanted, ["id", "own"]), "texts")
        apart = written(strays(texts, width).distinct(), "strays")
        if apart.isEmpty():
            break
        # Equal fingerprints of different sets: these rows become classes of their own.
        full = written(full.drop("apart").join(apart.withColumn("apart", F.concat_ws("/", "id", "own")), ["id", "own"], "left").withColumn("apart", F.coalesce("apart", F.lit(""))), "full")
    texts = texts.filter("paired and id = rep and own = rep_own").select("id", "own", "text")
    signed = written(reps.join(ids, "id", "left_semi").select("id", "own", "sig", "keys"), "signatures")
    signatures = signed.select("id", "sig")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        return written(confirmed(written(likely(pairs, signatures, threshold, miss), "survivors"), texts, width, numerator, denominator).distinct(), name)

    star = links(buckets.filter("pivot < id").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "star")
    first = components(star)

    rest = between(buckets, first, signed, texts, threshold, miss, width, numerator, denominator)

    #: An id in several classes joins them.
    repeated = full.select(*CLASS, "id").join(classes, [*CLASS]).groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("a", "b")
    last = components(star.union(rest).union(repeated))
    labelled = written(classes.join(last, classes["rep"] == last["id"], "left").select(*CLASS, F.coalesce("comp", "rep").alias("component_id")), "labelled")
    linked = full.select(*CLASS, "id", "n").join(labelled, [*CLASS]).select("id", "n", "component_id")
    alone = sketch.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents less all but one of each group of near-duplicates; of rows that share an id one stays."""
    gone = near_duplicates(docs, **options).filter("not kept").select("doc_id").distinct()
    left = docs.join(written(gone, "gone"), "doc_id", "left_anti").select(docs.columns)
    repeated = written(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n")).filter("__n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    once = left.join(repeated, "doc_id", "left_semi").withColumn("__first", first).filter("__first = 1").select(docs.columns)
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)
