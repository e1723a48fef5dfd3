"""Hash tree over an append-only log: an append rehashes one branch, and a proof reads little.

Lines have a dense number from 0. A leaf is a line's digest; a node of level k is the digest of
up to WIDTH nodes of the level below, joined by commas in order. So no node gathers more than
WIDTH digests, and a log of n lines has log(n) to the base WIDTH levels. Nodes are kept as a
table (level, node, hash, size), size being the lines below. After an append only nodes whose
range holds new lines are hashed again; the others are taken over. That a longer log begins
with a shorter one is seen by comparing the nodes that were full, and the leaves of the last
branch: no line before it is read.

Defined cases: an empty log has no nodes; null lines count as empty ones; equal lines are told
apart by their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Children of a node.
WIDTH = 64


def leaves(lines: DataFrame) -> DataFrame:
    """(level, node, hash, size) of level 0 from (seq, line)."""
    return lines.select(F.lit(0).alias("level"), F.col("seq").cast("long").alias("node"), F.sha2(F.coalesce("line", F.lit("")), 256).alias("hash"), F.lit(1).cast("long").alias("size"))


def above(nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """The nodes of the next level."""
    children = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda c: c["hash"])
    up = nodes.groupBy((F.col("level") + 1).alias("level"), F.expr(f"node div {width}").alias("node"))
    return up.agg(F.sha2(F.array_join(children, ","), 256).alias("hash"), F.sum("size").alias("size"))


def levels(n: int, width: int = WIDTH) -> int:
    """Levels above the leaves of a log of n lines."""
    found = 0
    while n > 1:
        n, found = -(-n // width), found + 1
    return found


def built(lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """All nodes of a log."""
    now = leaves(lines)
    found, n = now, lines.count()
    for _ in range(levels(n, width)):
        now = above(now, width)
        found = found.unionByName(now)
    return found


def appended(nodes: DataFrame, added: DataFrame, width: int = WIDTH) -> DataFrame:
    """The nodes of the log with further lines (seq from its length on), and whether each was hashed anew.

    Of the stored nodes only the last, unfinished ones of each level are replaced.
    """
    old = nodes.filter("level = 0").agg(F.count("*")).first()[0]
    n = old + added.count()
    fresh = leaves(added)
    found = nodes.filter("level = 0").withColumn("anew", F.lit(False)).unionByName(fresh.withColumn("anew", F.lit(True)))
    for level in range(1, levels(n, width) + 1):
        # The first node of this level that has new lines below it.
        first = old // width**level
        below = nodes.filter((F.col("level") == level - 1) & (F.col("node") >= first * width) & (F.col("node") < old // width ** (level - 1)))
        fresh = above(below.unionByName(fresh), width)
        kept = nodes.filter((F.col("level") == level) & (F.col("node") < first))
        found = found.unionByName(kept.withColumn("anew", F.lit(False))).unionByName(fresh.withColumn("anew", F.lit(True)))
    return found


def begins_with(longer: DataFrame, shorter: DataFrame, width: int = WIDTH) -> bool:
    """Whether the log of one tree begins with that of another, by full nodes and the last leaves.

    A node is compared where it is full in the shorter log and its parent is not, so that each
    line lies below one compared node.
    """
    n = shorter.filter("level = 0").agg(F.count("*")).first()[0]
    if longer.filter("level = 0").agg(F.count("*")).first()[0] < n:
        return False
    wanted = None
    for level in range(levels(n, width) + 1):
        full, covered = n // width**level, n // width ** (level + 1) * width
        # The top of the shorter tree has no parent.
        start = covered if level < levels(n, width) else 0
        part = shorter.filter((F.col("level") == level) & (F.col("node") >= start) & (F.col("node") < full))
        wanted = part if wanted is None else wanted.unionByName(part)
    missing = wanted.select("level", "node", "hash").join(longer.select("level", "node", "hash"), ["level", "node", "hash"], "left_anti")
    return missing.isEmpty()
