"""The hash tree of a log: appends equal a new build, and tampering shows."""

import hashlib

import pytest

from verdigris.operators import hashtree as H


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(lines, width):
    now, found, level = [sha(x or "") for x in lines], {}, 0
    while True:
        found |= {(level, k): h for k, h in enumerate(now)}
        if len(now) <= 1:
            return found
        now, level = [sha(",".join(now[k : k + width])) for k in range(0, len(now), width)], level + 1


def frame(spark, lines, start=0):
    return spark.createDataFrame([(start + k, x) for k, x in enumerate(lines)], "seq long, line string")


def tree(df):
    return {(r["level"], r["node"]): r["hash"] for r in df.collect()}


@pytest.mark.parametrize("n", [0, 1, 3, 4, 17, 64])
def test_build_equals_brute_force(spark, n):
    lines = [f"l{k % 5}" if k % 7 else None for k in range(n)]
    assert tree(H.built(frame(spark, lines), 4)) == brute(lines, 4)


@pytest.mark.parametrize("old, new", [(10, 3), (16, 1), (1, 40), (15, 1), (0, 5), (7, 0)])
def test_append_rehashes_one_branch(spark, old, new):
    lines = [f"line {k}" for k in range(old + new)]
    grown = H.appended(H.built(frame(spark, lines[:old]), 4), frame(spark, lines[old:], old), 4).collect()
    want = brute(lines, 4)
    assert {(r["level"], r["node"]): r["hash"] for r in grown} == want and len(grown) == len(want)
    for r in grown:
        # Hashed anew: exactly the nodes with a new line below.
        assert r["anew"] == ((r["node"] + 1) * 4 ** r["level"] > old)


def test_proof_of_append_only(spark):
    lines = [f"line {k}" for k in range(37)]
    short = H.built(frame(spark, lines[:23]), 4)
    assert H.begins_with(H.built(frame(spark, lines), 4), short, 4)
    assert H.begins_with(short, short, 4) and H.begins_with(short, H.built(frame(spark, []), 4), 4)
    assert not H.begins_with(short, H.built(frame(spark, lines), 4), 4)
    for k in (0, 15, 16, 22):
        changed = [*lines[:k], "other", *lines[k + 1 :]]
        assert not H.begins_with(H.built(frame(spark, changed), 4), short, 4)
    assert H.begins_with(H.built(frame(spark, [*lines[:23], "other"]), 4), short, 4)
