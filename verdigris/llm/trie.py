"""Prefix trie of conversations: polynomial prefix fingerprints, verified turn by turn, and a rollup.

A turn's number is a hash of its role and text. Conversations are sorted by ranges, and numpy
scans give each row its place and the running sum of number * base ** place modulo two primes,
the fingerprint of its prefix; a conversation that spans several partitions is carried on from
one to the next, so that none needs to fit into a task. With these, a prefix that comes from
another conversation only changes the sums by a constant of the conversation: texts are never
copied. Rows with equal (depth, fingerprint) are candidates for one node; each is compared with
the group's representative, the smallest conversation, by role, text and the fingerprint before.
What differs is split off by its exact content, and marks all deeper prefixes of that
conversation, so that nodes are exact whatever the fingerprints do.

Sums over subtrees need no descent level by level: each node lays its values at its smallest
member, sums from the end of every conversation give what lies at or below each depth, and a
node adds these up over its members.

Defined cases: null roles and texts are empty; null conv_ids take no part; turns are ordered by
turn, nulls first, ties by a hash of role and text, then as they stand; repeated rows are turns
each; an empty table gives no rows, not even a root; ``%`` keeps the sign of a negative id;
extra columns, whatever their names, are not read; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import workers_ready, written

#: Primes and bases of the two fingerprints.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525)
#: Turns that a conversation may take over from the head of its block, and the size of a block.
MOST, BLOCK = 3, 20
#: Characters of ids that one row of a hash's input holds.
CHUNK = 1 << 20
WORD = r"[\x20\x09-\x0D]+"

Terms = dict[str, tuple[int, int] | None]


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 to n - 1 modulo prime, by doubling."""
    found = np.ones(1, "i8")
    while len(found) < n:
        found = np.concatenate([found, found * pow(base, len(found), prime) % prime])
    return found[:n]


def scan(group: np.ndarray, terms: dict[str, np.ndarray], of: Terms, state: tuple) -> tuple[dict, tuple]:
    """Places, running sums and the sums before, within runs of equal groups, carried on from a state (group, rows, sums)."""
    n = len(group)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    start = np.repeat(first, np.diff(np.append(first, n)))
    head, seen, sums = state
    goes_on = (start == 0) & (head is not None and group[0] == head)
    found = {"place": np.arange(n) - start + np.where(goes_on, seen, 0)}
    for name, kind in of.items():
        x = terms[name]
        if kind:
            base, prime = kind
            weight = powers(base, prime, n)[np.arange(n) - start]
            x = x % prime * np.where(goes_on, weight * pow(base, seen, prime) % prime, weight) % prime
        total = np.cumsum(x)
        total = total - (total - x)[start] + (np.where(goes_on, sums[name], 0) if head is not None else 0)
        found[name], found[f"{name}_before"] = (total % kind[1], (total - x) % kind[1]) if kind else (total, total - x)
    return found, (group[-1], int(found["place"][-1]) + 1, {k: int(found[k][-1]) for k in of})


def carried(parts: list, of: Terms) -> list[tuple]:
    """(part, first group, rows, sums, weights) to put before a part's first group, from (part, first, last, rows and sums of the last)."""
    found, before = [], None
    for part, first, last, rows, sums in sorted(parts, key=lambda x: x[0]):
        if before and before[0] == first:
            weights = {k: pow(kind[0], before[1], kind[1]) if kind else 1 for k, kind in of.items()}
            found.append((part, first, before[1], before[2], weights))
            if first == last:
                sums = {k: before[2][k] + weights[k] * v for k, v in sums.items()}
                sums = {k: v % of[k][1] if of[k] else v for k, v in sums.items()}
                rows += before[1]
        before = (last, rows, sums)
    return found


def scanned(rows: DataFrame, group: str, order: list[Column], of: Terms, name: str) -> DataFrame:
    """rows with ``place``, from 0 within a group, and each term as its running sum, and the sum before as ``_before``.

    A term with (base, prime) is weighted by base ** place, modulo prime. Rows are sorted in
    ranges of (group, order); one row for each partition meets at the driver, and is put before
    the rows of the group that the partition begins with.
    """
    keep = rows.columns
    told = [c for c in keep if c not in of] + ["place", *(x for k in of for x in (k, f"{k}_before"))]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        part, state = TaskContext.get().partitionId(), (None, 0, {})
        for b in batches:
            if b.num_rows:
                columns = {c: b.column(i) for i, c in enumerate(keep)}
                found, state = scan(columns[group].to_numpy(), {k: columns[k].to_numpy() for k in of}, of, state)
                columns |= {k: pa.array(v) for k, v in found.items()}
                yield pa.RecordBatch.from_arrays([*(columns[c] for c in told), pa.array(np.full(b.num_rows, part, "i4"))], names=[*told, "part"])

    ordered = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    local = written(ordered.mapInArrow(run, ", ".join(f"{c} {types.get(c, 'bigint')}" for c in told) + ", part int"), name)
    last = F.max(F.struct(group, "place", *of)).alias("last")
    parts = [(r["part"], r["first"], r["last"][group], r["last"]["place"] + 1, {k: r["last"][k] for k in of}) for r in local.groupBy("part").agg(F.min(group).alias("first"), last).collect()]
    # One row for each partition at most.
    carry = [(part, first, n, *sums.values(), *weights.values()) for part, first, n, sums, weights in carried(parts, of)]
    ahead = rows.sparkSession.createDataFrame(carry, ", ".join(["__part int", "__group long", "__n long", *(f"__{k} long" for k in of), *(f"__by_{k} long" for k in of)]))
    both = local.join(F.broadcast(ahead), (F.col("part") == F.col("__part")) & (F.col(group) == F.col("__group")), "left")

    def joined(c: str, k: str) -> Column:
        total = F.coalesce(f"__{k}", F.lit(0)) + F.coalesce(f"__by_{k}", F.lit(1)) * F.col(c)
        return total % of[k][1] if of[k] else total

    whole = {c: joined(c, k) for k in of for c in (k, f"{k}_before")}
    return both.withColumns(whole | {"place": F.col("place") + F.coalesce("__n", F.lit(0))}).select(told)


def numbered(turns: DataFrame, primes: tuple[int, int] = PRIMES) -> tuple[DataFrame, DataFrame]:
    """(row, role, text) of every turn, and (conv_id, place, f0, f1, their _before, row, n_words): prefix fingerprints."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    good = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    hashed = good.withColumns({"hash": F.xxhash64("role", "text"), "n_words": F.size(F.filter(F.split("text", WORD), lambda w: w != "")).cast("long"), "row": F.monotonically_increasing_id()})
    # Written, so that a row keeps its number.
    table = written(hashed, "turns")
    slim = table.select("conv_id", "turn", "hash", "row", "n_words", F.col("hash").alias("f0"), F.col("hash").alias("f1"))
    order = [F.col("turn").asc_nulls_first(), F.col("hash"), F.col("row")]
    return table.select("row", "role", "text"), scanned(slim, "conv_id", order, dict(zip(("f0", "f1"), zip(BASES, primes))), "numbered").drop("turn", "hash")


def packed(a: Column, b: Column) -> Column:
    """Both fingerprints in one number."""
    return F.shiftleft(a.cast("long"), 31) + b


def rebuilt(seq: DataFrame, primes: tuple[int, int], most: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(one row for each conversation, steps on own turns).

    A conversation begins with the first turns of its block's head: what differs from its own
    prefix sums is one constant, and one power of the base where the head has too few turns.
    """
    at = lambda j: F.max(F.when(F.col("place") == j, F.struct("f0", "f1", "n_words"))).alias(f"at{j}")
    # An array that is null beyond the conversation's end.
    convs = written(seq.groupBy("conv_id").agg(F.count("*").alias("n"), *(at(j) for j in range(most))).select("conv_id", "n", F.array(*(f"at{j}" for j in range(most))).alias("own")), "conversations")
    base = F.col("conv_id") - F.col("conv_id") % block
    heads = convs.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("head_n"), F.col("own").alias("head"))
    # Its own turns are those of a head that is rebuilt from itself.
    h = F.when(F.col("conv_id") == F.col("base"), 0).otherwise(F.crc32(F.col("conv_id").cast("string")) % (most + 1))
    told = convs.withColumn("base", base).withColumn("h", h).join(heads, "base", "left").withColumn("k", F.least("h", F.coalesce("head_n", F.lit(0))))
    after = lambda x, n, f: F.when(n == 0, 0).otherwise(F.get(x, (n - 1).cast("int"))[f])
    inverse = lambda i: F.element_at(F.array(*(F.lit(pow(pow(BASES[i], -1, primes[i]), s, primes[i])).cast("long") for s in range(most + 1))), (F.col("h") - F.col("k") + 1).cast("int"))
    for i in range(2):
        f, p = f"f{i}", primes[i]
        told = told.withColumn(f"by{i}", inverse(i))
        told = told.withColumn(f"add{i}", F.pmod(after(F.col("head"), F.col("k"), f) - F.coalesce(after(F.col("own"), F.col("h"), f), F.lit(0)) * F.col(f"by{i}"), F.lit(p)))
    told = written(told.select("conv_id", "base", "h", "k", "head", "by0", "by1", "add0", "add1", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "rebuilt")
    mine = seq.join(told.select("conv_id", "h", "k", "by0", "by1", "add0", "add1", "length"), "conv_id").filter("place >= h")
    key = lambda end: packed(*((F.col(f"f{i}{end}") * F.col(f"by{i}") + F.col(f"add{i}")) % primes[i] for i in range(2)))
    depth = F.col("place") - F.col("h") + F.col("k") + 1
    return told, mine.select("conv_id", depth.alias("depth"), key("").alias("key"), key("_before").alias("before"), "n_words", (depth == F.col("length")).alias("is_end"), "row")


def collisions(own: DataFrame, texts: DataFrame) -> DataFrame:
    """(conv_id, depth, sub) of steps that differ from the representative of their (depth, key).

    sub is the smallest conversation with the same step, so that what is equal stays together.
    Only candidates that share a (depth, key) take part; turns taken over from a head are the
    head's own steps, which stand for them.
    """
    shared = own.groupBy("depth", "key").agg(F.min("conv_id").alias("rep"), F.max("conv_id").alias("last")).filter("rep < last").select("depth", "key", "rep")
    members = written(own.join(shared, ["depth", "key"]).select("depth", "key", "rep", "conv_id", "before", "row").join(texts, "row"), "candidates")
    reps = members.filter("conv_id = rep").select("depth", "key", *(F.col(c).alias(f"rep_{c}") for c in ("before", "role", "text")))
    same = F.lit(True)
    for c in ("before", "role", "text"):
        same &= F.col(c) == F.col(f"rep_{c}")
    stray = written(members.filter("conv_id != rep").join(reps, ["depth", "key"]).filter(~same).select("depth", "key", "conv_id", "before", "role", "text"), "strays")
    subs = stray.groupBy("depth", "key", "before", "role", "text").agg(F.min("conv_id").alias("sub"))
    return stray.join(subs, ["depth", "key", "before", "role", "text"]).select("conv_id", "depth", "sub")


def marked(steps: DataFrame, convs: DataFrame, stray: DataFrame) -> DataFrame:
    """Steps with tag and before_tag: the splits at this depth and above, and those above."""
    if stray.isEmpty():
        return steps.withColumns({"tag": F.lit(""), "before_tag": F.lit("")})
    taken = stray.withColumnRenamed("conv_id", "base").join(convs.select("base", "conv_id", "k"), "base").filter("depth <= k and conv_id != base").select("conv_id", "depth", "sub")
    lists = stray.unionByName(taken).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "sub"))).alias("marks"))
    both = steps.join(lists, "conv_id", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<depth:bigint,sub:bigint>>")))
    tag = lambda top: F.array_join(F.transform(F.filter("marks", lambda m: m["depth"] <= top), lambda m: F.concat_ws(":", m["depth"], m["sub"])), ",")
    return both.withColumns({"tag": tag(F.col("depth")), "before_tag": tag(F.col("depth") - 1)}).drop("marks")


NODE = ("depth", "key", "tag")


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, key, tag, ends_sha256) of the sorted conv_ids that end at a node.

    Ranges of (node, conv_id) join their ids into few long strings; a digest, which cannot be
    computed in parts, then reads a node's strings one after the other.
    """

    def join(batches):
        node, ids, size = None, [], 0

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([x]) for x in node), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=[*NODE, "first", "ids"])

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(4)]
            for *own, conv in zip(*columns, strict=True):
                if own != node or size > CHUNK:
                    if ids:
                        yield row()
                    node, ids, size = own, [], 0
                ids.append(conv)
                size += 20
        if ids:
            yield row()

    def digest(batches):
        node, sha, done = None, None, []
        for b in batches:
            for *own, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if own == node:
                    sha.update(b",")
                else:
                    if node:
                        done.append((*node, sha.hexdigest()))
                    node, sha = own, hashlib.sha256()
                sha.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*NODE, "ends_sha256"])
                done = []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, sha.hexdigest())], names=[*NODE, "ends_sha256"])

    parts = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(join, "depth long, key long, tag string, first long, ids string")
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "depth long, key long, tag string, ends_sha256 string")


def prefix_trie(turns: DataFrame, most: int = MOST, block: int = BLOCK, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Every conversation first takes over the first crc32(conv_id) % (most + 1) turns of its
    block's head in place of its own; ``most`` = 0 leaves conversations as they are.
    """
    workers_ready(turns.sparkSession)
    texts, seq = numbered(turns, primes)
    # In blocks of one, every conversation is its own head and stays as it is.
    convs, own = rebuilt(seq, primes, max(most, 1), block if most else 1)
    own = written(own, "steps")
    stray = written(collisions(own, texts), "collisions")
    # Turns taken over from the head, and the root.
    at = F.get(F.col("head"), (F.col("depth") - 1).cast("int"))
    over = F.get(F.col("head"), (F.col("depth") - 2).cast("int"))
    taken = convs.filter("k > 0").withColumn("depth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    taken = taken.select("conv_id", "depth", packed(at["f0"], at["f1"]).alias("key"), F.when(F.col("depth") == 1, 0).otherwise(packed(over["f0"], over["f1"])).alias("before"), at["n_words"].alias("n_words"), (F.col("depth") == F.col("length")).alias("is_end"))
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("key"), zero.alias("before"), zero.alias("n_words"), (F.col("length") == 0).alias("is_end"))
    steps = written(marked(own.drop("row").unionByName(taken).unionByName(root), convs, stray), "marked")

    found = steps.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("before").alias("before"), F.max("before_tag").alias("before_tag"), F.max("n_words").alias("n_words"))
    nodes = written(found, "nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("before").alias("key"), F.col("before_tag").alias("tag")]
    children = nodes.filter("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, [*NODE], "left").withColumn("n_children", F.coalesce("n_children", zero)), "children")

    # A node's own values stand at its smallest member; from the end of each conversation they add up.
    values = nodes.select("conv_id", *NODE, ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"), F.lit(False).alias("step"))
    rows = values.unionByName(steps.select("conv_id", *NODE, zero.alias("saved"), zero.alias("leaves"), F.lit(True).alias("step")))
    below = scanned(rows, "conv_id", [F.col("depth").desc(), F.col("step")], {"saved": None, "leaves": None}, "below").filter("step")
    sums = below.groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("before"), F.col("tag").alias("before_tag"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(sums, [*NODE]).join(parents, ["depth", "before", "before_tag"], "left").join(end_digests(steps.filter("is_end")), [*NODE], "left")
    none = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
