"""Many terms at once against a chain of single replacements, and a scan."""

import random

import pytest

from verdigris.operators import dictionary as D


def chain(text, terms):
    hits = []
    for term, to in sorted(terms.items(), key=lambda x: (-len(x[0]), x[0])):
        if term in text:
            text = text.replace(term, to)
            hits.append(term)
    return text, hits


@pytest.mark.parametrize("seed", range(8))
def test_replacement_equals_the_chain(seed):
    """Overlapping terms, targets that bring forth others, terms within terms."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abc日") for _ in range(rng.randint(1, n)))
    for _ in range(300):
        terms = {word(4): rng.choice([word(5), "", word(2).upper()]) for _ in range(rng.randint(1, 12))}
        order = sorted(terms, key=lambda t: (-len(t), t))
        text = word(60)
        assert D.replaced(text, tuple(order), tuple(terms[t] for t in order)) == chain(text, terms)


def test_ten_thousand_terms_on_documents(spark, sf_dir):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    words = sorted({w for r in rows for w in r.text.split()})
    terms = {w: w.upper() for w in rng.sample(words, min(4000, len(words)))}
    while len(terms) < 10_000:
        terms["".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9)))] = "x"
    vocab = spark.createDataFrame(list(terms.items()), "term string, to string")
    got = {r.doc_id: (r.text, r.hits) for r in D.substituted(docs, vocab).collect()}
    for r in rng.sample(rows, 12):
        assert got[r.doc_id] == chain(r.text, terms)
    assert len(got) == len(rows)
    lowered = {t.lower() for t in terms}
    some = [r for r in rng.sample(rows, 12)]
    for shard in (D.MOST_TERMS, 3000):
        hits: dict = {}
        for r in D.contained(docs, vocab, shard=shard, block_chars=200_000).collect():
            hits.setdefault(r.doc_id, set()).add(r.term)
        for r in some:
            assert hits.get(r.doc_id, set()) == {t for t in lowered if t in r.text.lower()}


def test_odd_cases(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "aa a"), (3, "aa a")], "doc_id long, text string")
    vocab = spark.createDataFrame([("a", "z"), ("a", "b"), ("", "x"), (None, "y"), ("q", None)], "term string, to string")
    assert sorted(((r.doc_id, r.text, r.hits) for r in D.substituted(docs, vocab).collect()), key=str) == [(1, None, []), (2, "", []), (3, "bb b", ["a"]), (3, "bb b", ["a"])]
    assert sorted(map(tuple, D.contained(docs, vocab).collect())) == [(3, "a")]
    none = vocab.limit(0)
    assert D.substituted(docs, none).count() == 4 and D.contained(docs, none).count() == 0
    monkeypatch.setattr(D, "MOST_TERMS", 1)
    with pytest.raises(ValueError):
        D.substituted(docs, vocab)
