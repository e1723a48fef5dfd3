"""The prefix trie against one that is built turn by turn, also with fingerprints that collide."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import queries as Q
from verdigris.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, order, most=3, block=20):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, order[(r or "", x or "")], r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        whole[c] = tuple(own.get(c - int(math.fmod(c, block)), [])[:h] + v[h:]) if most else tuple(v)
    members, children, below, found = {}, {}, {}, []
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        m, kids = members[p], children.get(p, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below[p] = (sum(below[q][0] for q in kids) if kids else 1, (len(m) - 1) * words + sum(below[q][1] for q in kids))
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        found.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def order_of(df):
    """The hash that orders ties."""
    told = df.select(F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("x")).withColumn("h", F.xxhash64("r", "x")).distinct()
    return {(r["r"], r["x"]): r["h"] for r in told.collect()}


def odd_rows():
    rng, rows = random.Random(1), []
    for c in [*range(-45, 130), 1000, 1007]:
        if c not in (40, 80):
            for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
                rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["u", "a", None]), rng.choice(["x", "y z", "", None, " q\tw ", "x"])))
    return rows + [(60, 2, "u", "x")] * 300 + [(None, 1, "a", "b")]


@pytest.mark.parametrize("primes", [trie.PRIMES, (13, 17)], ids=["fingerprints", "colliding"])
def test_equals_brute_force(spark, primes):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("row", "hash", "depth", "key", "place", "n")})
    got = sorted(map(tuple, trie.prefix_trie(df, primes=primes).collect()), key=str)
    assert got == brute(rows, order_of(df))


def test_as_they_are_and_empty(spark):
    rows = odd_rows()[:120]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, trie.prefix_trie(df, most=0).collect()), key=str) == brute(rows, order_of(df), most=0)
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_one_long_conversation_in_many_ranges(spark):
    """A conversation that spans all partitions is carried on from one to the next."""
    rows = [(7, t, "u", f"w{t % 5} w") for t in range(3000)] + [(9, t, "u", f"w{t % 5} w") for t in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, trie.prefix_trie(df, most=0).collect()), key=str)
    assert got == brute(rows, order_of(df), most=0)


def test_query_on_its_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert sorted(map(tuple, Q.op13_prefix_trie(spark, sf_dir).collect()), key=str) == brute(list(map(tuple, df.collect())), order_of(df))


def test_ends_beyond_one_string(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 50)
    ends = spark.createDataFrame([(1, 5, "", c) for c in range(200)] + [(1, 6, "", 3), (2, 5, "", 4)], "depth long, key long, tag string, conv_id long")
    got = {(r["depth"], r["key"]): r["ends_sha256"] for r in trie.end_digests(ends).collect()}
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 5): digest(range(200)), (1, 6): digest([3]), (2, 5): digest([4])}


def test_scan_across_batches():
    rng = np.random.default_rng(1)
    group = np.sort(rng.integers(0, 9, 400))
    x = rng.integers(-(1 << 62), 1 << 62, 400)
    kind = {"f": (trie.BASES[0], trie.PRIMES[0])}
    whole, _ = trie.scan(group, {"f": x}, kind, (None, 0, {}))
    state, parts = (None, 0, {}), []
    for a in range(0, 400, 37):
        found, state = trie.scan(group[a : a + 37], {"f": x[a : a + 37]}, kind, state)
        parts.append(found["f"])
    assert (np.concatenate(parts) == whole["f"]).all()
    total = {}
    for g, v, got in zip(group.tolist(), x.tolist(), whole["f"].tolist()):
        n, s = total.get(g, (0, 0))
        total[g] = n + 1, (s + v * pow(trie.BASES[0], n, trie.PRIMES[0])) % trie.PRIMES[0]
        assert got == total[g][1]
