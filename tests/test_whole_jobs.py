"""Registered queries over small tables of their own, against brute force over all rows."""

import random
import re
from collections import Counter
from itertools import combinations

from verdigris.plans import registry


def ran(spark, tmp_path, name, **tables):
    """Rows of a query over tables given as (schema, rows)."""
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    return [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]


def test_lines_of_every_document_become_rows(spark, tmp_path):
    docs = [(k, f"a{k}\n \nb{k}", "en") for k in range(25)]
    got = ran(spark, tmp_path, "n7_negatives_as_rows", documents=("doc_id long, text string, lang string", docs))
    assert sorted(got) == sorted((k, x, lang) for k, text, lang in docs for x in text.split("\n") if x.strip(" "))


def test_claims_of_late_turns_are_compared(spark, tmp_path):
    claims = {1: ["costs 10 today"] * 6 + ["costs 20 today"] * 3, 2: ["no"] * 6 + ["one two three four"], 3: ["sold 5 of it", "sold 5 of them"]}
    turns = [(c, k, "user", x) for c, texts in claims.items() for k, x in enumerate(texts)]
    got = dict(ran(spark, tmp_path, "j7_claim_agreement", conversations=("conv_id long, turn int, role string, text string", turns)))

    def brute(texts):
        if all(len(set(x.lower().split(" "))) <= 2 for x in texts):
            return "mixed"
        numbers = [set(re.findall("[0-9]+", x)) for x in texts]
        pairs = [bool(a & b) for a, b in combinations(filter(None, numbers), 2)]
        if pairs:
            rate = sum(pairs) / len(pairs)
            return "high" if rate >= 0.7 else "mixed" if rate >= 0.3 else "low"
        a, b = (set(x.lower().split(" ")) for x in texts[:2])
        share = len(a & b) / min(len(a), len(b))
        return "high" if share >= 0.5 else "mixed" if share >= 0.2 else "low"

    assert got == {c: brute(texts) for c, texts in claims.items()}
    assert got == {1: "mixed", 2: "high", 3: "high"}


def test_novelty_counts_character_4_grams(spark, tmp_path):
    r = random.Random(3)
    docs = [(k, "".join(r.choices("abЖ漢😀\n ", k=r.randrange(12)))) for k in range(0, 13_500, 20)]
    docs += [(k, "same words here") for k in range(13_500, 14_200, 20)]
    got = ran(spark, tmp_path, "h28_h29_novelty", documents=("doc_id long, text string", docs))
    sets = {}
    for k, t in docs:
        sets.setdefault(k // 100, set()).update(t[i : i + 4] for i in range(len(t) - 3))
    rates = {b: (len(s), len(s - sets.get(b - 1, set())) / len(s)) for b, s in sets.items() if s}
    order = sorted(rates)
    want = [(b, *rates[b], max(rates[x][1] for x in order[max(0, k - 2) : k + 1]) < 0.05) for k, b in enumerate(order)]
    assert sorted(got) == want
    assert {x[3] for x in want} == {True, False}


def test_diversity_counts_character_3_grams(spark, tmp_path):
    docs = [("ru", "Привет, мир"), ("ru", "приветы"), ("zh", "漢字漢字漢"), ("en", "ab"), ("en", "a😀b\nabab")]
    got = dict(ran(spark, tmp_path, "h30_gram_diversity", documents=("lang string, text string", docs)))
    counts = {}
    for lang, t in docs:
        counts.setdefault(lang, Counter()).update(t[i : i + 3] for i in range(len(t) - 2))
    assert got == {k: sum(v == 1 for v in c.values()) / c.total() for k, c in counts.items()}


def test_lint_compares_whole_texts(spark, tmp_path):
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choices("abcdefghij漢😀", k=5)) for _ in range(n))
    head, body = words(40), words(300)
    texts = [head + words(200), head + words(200), words(40) + body, words(40) + body, "ab", " \u3000ab\n", "", "abc", "xyz", "[ERROR] of a call", "Sure, here it is", "Of course it is", "surely, it is"]
    texts += ["some words that repeat", "some words that repeat", body + words(20), *(words(9) for _ in range(10)), body + words(20)]
    docs = [(k, "s", t) for k, t in enumerate(texts)] + [(99, "other", texts[2])]
    got = dict(ran(spark, tmp_path, "j6_lint_against_recent", documents=("doc_id long, source string, text string", docs)))
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}

    def similar(a, b):
        return bool(a and b) and len(a & b) / len(a | b) > 0.85

    want = {k: len(t.strip()) <= 2 or t.startswith(("[ERROR", "Sure,", "Of course")) or any(similar(grams(t), grams(p)) for p in texts[max(0, k - 10) : k]) for k, t in enumerate(texts)}
    assert got == want | {99: False}
    assert not want[1] and want[14] and want[4]


def test_layers_after_an_earlier_round(spark, tmp_path):
    """Rows that an earlier round left at 0 come in, and the ones that were latest then go back to 1."""
    r = random.Random(6)
    events = [(k, r.randrange(4), r.choice(["view", "click", "error", None]), r.choice([10.0, 100.0, 150.0, None])) for k in range(150)]
    got = ran(spark, tmp_path, "f10_layers", events=("event_id long, user_id long, event_type string, value double", events))

    def round_(state, due):
        state = {k: (-1 if events[k][2] == "error" else 1) if v == 0 and k in due else v for k, v in state.items()}
        for u in range(4):
            active = sorted((k for k, v in state.items() if v > 0 and events[k][1] == u), reverse=True)
            state |= {k: 2 if n < 5 else 1 for n, k in enumerate(active)}
        return state

    before = round_(dict.fromkeys(range(150), 0), {k for k, _, t, v in events if t == "error" or (v or 0) > 100})
    after = round_(before, set(range(150)))
    assert sorted(got) == sorted((events[k][1], k, before[k], after[k]) for k in before)
    assert {(-1, -1), (0, 1), (0, 2), (1, 1), (2, 1), (2, 2)} <= set(zip(before.values(), after.values()))
