"""Ranked search against plain loops."""

import math
import random
import re
from collections import Counter

from lodestone.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=50):
    found = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, want in asked.items():
        scores = []
        for d, c in found:
            m = 50 + 50 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in want if t in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")


def test_against_plain(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["Ärger", "ärger", "abc", "ABC", "ab", "c", "x1", "日本", "été", "zz", "q"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "_", "\x00", "\n", ". "]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 40]))) for i in range(400)]
    docs += [(7, text(20)), (7, docs[7][1]), (None, "abc abc"), (500, None), (501, "..."), (502, text(3000))] + [(600 + i, "abc zz") for i in range(80)]
    items = [(i, text(rng.choice([0, 1, 4, 9]))) for i in range(12)] + [(3, "abc q"), (None, "abc"), (99, None), (98, "nowhere")]
    d, i = frames(spark, docs, items)
    expected = plain(docs, items)
    assert sorted(map(tuple, lexical.ranked_search(d, i).collect())) == expected
    # several blocks, few texts in a table at a time
    monkeypatch.setattr(lexical, "CELLS", 64)
    assert len(list(lexical.blocks(lexical.item_terms(i), 60))) > 2
    assert sorted(map(tuple, lexical.ranked_search(d, i, most=60).collect())) == expected
    assert sorted(map(tuple, lexical.ranked_search(d, i, top=3).collect())) == plain(docs, items, 3)


def test_best_within_a_partition(spark, monkeypatch):
    """More documents than are held before the best are picked."""
    docs = [(i, " ".join(["abc"] * (i % 7 + 1) + ["zz"] * (i % 3))) for i in range(3000)]
    items = [(1, "abc"), (2, "zz abc")]
    monkeypatch.setattr(lexical, "TEXTS", 16)
    d, i = frames(spark, docs, items)
    assert sorted(map(tuple, lexical.ranked_search(d.coalesce(1), i, top=5).collect())) == plain(docs, items, 5)


def test_empty_tables_and_other_columns(spark):
    d, i = frames(spark, [(1, "abc")], [(1, "abc")])
    assert lexical.ranked_search(d.limit(0), i).collect() == []
    assert lexical.ranked_search(d, i.limit(0)).collect() == []
    extra = d.selectExpr("doc_id", "text", "'x' AS item", "1 AS term", "2 AS score")
    assert [tuple(r)[:3] for r in lexical.ranked_search(extra, i.selectExpr("*", "5 AS rank")).collect()] == [(1, 1, 1)]
