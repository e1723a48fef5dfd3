"""Many terms at once: one automaton over the vocabulary, instead of a pass for each term.

The automaton (pyahocorasick) is compiled once in each worker and finds all terms of a text in
one pass, however many there are. ``contained`` takes vocabularies of any size: they are cut
into shards of a bounded number of terms, and each text meets each shard. ``substituted``
replaces terms one after another, the longest first (ties by the term), each in the text that
the ones before have left; after a replacement only the places around it are looked at again.
As it needs the whole vocabulary in one place, it refuses more than a bounded number.

Defined cases: null texts give null and no hits; empty and null terms are none; a term that
repeats counts once, for a substitution with its smallest target; terms may overlap.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.session import ship

#: Terms of an automaton at most, and characters of them.
MOST_TERMS, MOST_CHARS = 200_000, 16_000_000


@lru_cache(maxsize=4)
def automaton(terms: tuple[str, ...]):
    """The automaton of a vocabulary, which gives a term's place in it; once for each worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        found.add_word(term, k)
    if terms:
        found.make_automaton()
    return found


def present(text: str, terms: tuple[str, ...]) -> set[int]:
    return {k for _, k in automaton(terms).iter(text)} if terms and text else set()


def replaced(text: str, terms: tuple[str, ...], to: tuple[str, ...]) -> tuple[str, list[str]]:
    """The text with all terms replaced in their order, and the terms that were."""
    import heapq

    known = present(text, terms)
    todo, hits, longest = sorted(known), [], max(map(len, terms), default=0)
    while todo:
        k = heapq.heappop(todo)
        term = terms[k]
        parts = text.split(term)
        if len(parts) == 1:
            continue
        text = to[k].join(parts)
        hits.append(term)
        # A replacement can bring forth later terms, around its own places.
        at, end = 0, -1
        for part in parts[:-1]:
            at += len(part)
            begin, stop = max(0, at - longest), at + len(to[k]) + longest
            at += len(to[k])
            if begin < end:
                begin = max(begin, end - 2 * longest)
            for j in present(text[begin:stop], terms) - known:
                if j > k:
                    known.add(j)
                    heapq.heappush(todo, j)
            end = stop
    return text, hits


def vocabulary(terms: DataFrame, term: str, to: str | None = None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The terms in the order of replacement, and their targets; an error if there are too many."""
    good = terms.filter(F.col(term).isNotNull() & (F.col(term) != "")).groupBy(F.col(term).alias("term")).agg(F.min(to or term).alias("to"))
    n, chars = good.agg(F.count("*"), F.coalesce(F.sum(F.length("term") + F.length("to")), F.lit(0))).first()
    if n > MOST_TERMS or chars > MOST_CHARS:
        raise ValueError(f"{n} terms of {chars} characters; at most {MOST_TERMS} of {MOST_CHARS} can be replaced together")
    rows = sorted(((r["term"], r["to"]) for r in good.collect()), key=lambda x: (-len(x[0]), x[0]))
    return tuple(r[0] for r in rows), tuple(r[1] or "" for r in rows)


def substituted(docs: DataFrame, terms: DataFrame, term: str = "term", to: str = "to") -> DataFrame:
    """(doc_id, text, hits): the texts with the vocabulary's terms replaced, the longest first."""
    known, targets = vocabulary(terms, term, to)
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [replaced(t, known, targets) if t is not None else (None, []) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.string()))], names=["doc_id", "text", "hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, hits array<string>")


def contained(docs: DataFrame, terms: DataFrame, term: str = "term", shard: int = MOST_TERMS, block_chars: int = 16_000_000) -> DataFrame:
    """(doc_id, term): each term that occurs in a text, once, both in lower case.

    A vocabulary of at most ``shard`` terms goes to the tasks whole, and no text is shuffled. A
    larger one is cut into shards: blocks of texts, bounded in characters, meet each of them.
    """
    ship(docs.sparkSession)
    good = terms.select(F.lower(term).alias("term")).filter("term is not null and term != ''").distinct()
    texts = docs.filter("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    n = max(1, -(-good.count() // shard))
    if n == 1:
        known = tuple(sorted(r["term"] for r in good.collect()))

        def run(batches):
            import pyarrow as pa

            for b in batches:
                hits = [(d, known[k]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k in sorted(present(t, known))]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.string())], names=["doc_id", "term"])

        return texts.mapInArrow(run, "doc_id long, term string").distinct()

    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).withColumn("shard", each(n))
    right = good.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")).withColumn("block", each(blocks))

    def tile(a, b):
        import pandas as pd

        known = tuple(sorted(b["term"]))
        hits = [(d, known[k]) for d, t in zip(a["doc_id"], a["text"], strict=True) for k in sorted(present(t, known))]
        return pd.DataFrame(hits, columns=["doc_id", "term"]).astype({"doc_id": "int64", "term": "str"})

    both = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    return both.applyInPandas(tile, "doc_id long, term string").distinct()
