"""Batches of queries over whole texts: answers as plain loops, and exchanges that don't follow the words."""

import re

import pytest

from lodestone.operators import scan
from lodestone.plans import registry

TEXTS = {1: "the cat and the dog", 2: "the dog and the cat the", 3: "", 4: None, 5: "The the cat, and the dog and", 6: "dog " + "the " * 30 + "cat"}
ASKED = {1: "the cat and", 2: "the the", 3: "cat zebra", 4: "and the dog"}


def cut(text):
    return re.findall(r"\w+", (text or "").lower())


def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


def pairs(got, a="qid"):
    return sorted((r[a], r["doc_id"]) for r in got.collect())


def test_phrases_words_and_nearness(spark):
    rows = [(q, i, t) for q, text in ASKED.items() for i, t in enumerate(cut(text))]
    asked = spark.createDataFrame(rows, "qid long, i int, term string")
    has = lambda w, p: any(w[i:i + len(p)] == p for i in range(len(w)))
    assert pairs(scan.phrase(docs(spark), asked)) == sorted((q, d) for q, p in ASKED.items() for d, t in TEXTS.items() if has(cut(t), cut(p)))
    assert pairs(scan.match_all(docs(spark), asked)) == sorted((q, d) for q, p in ASKED.items() for d, t in TEXTS.items() if set(cut(p)) <= set(cut(t)))
    two = [(1, "cat", "dog"), (2, "dog", "cat"), (3, "the", "zebra"), (4, "and", "the")]
    near = lambda w, a, b: any(abs(i - j) <= 10 for i, x in enumerate(w) for j, y in enumerate(w) if x == a and y == b)
    got = scan.near(docs(spark), spark.createDataFrame(two, "qid long, a string, b string"))
    assert pairs(got) == sorted((q, d) for q, a, b in two for d, t in TEXTS.items() if near(cut(t), a, b))


def exchanged(spark, df):
    """Rows that df's stages write to exchanges."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None).iterator()
        n = 0
        while found.hasNext():
            n += found.next().shuffleWriteRecords()
        return n

    before = total()
    df().write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.mark.parametrize("name", ["h1_phrase", "h1_match_all", "h1_near"])
def test_words_stay_where_they_lie(spark, sf, name):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert exchanged(spark, lambda: registry.QUERIES[name](spark, sf)) < sum(len(cut(t)) for t in texts) / 2


def test_match_as_the_index(spark):
    from lodestone import bindings as b
    from lodestone.operators import postings

    asked = spark.createDataFrame([(1, "cat do"), (2, '"the dog" an'), (3, "the-cat dog"), (4, '"the the" the-dog ca'), (5, "zebra"), (6, '"and the"'), (7, "nowhere-cat")], "qid long, text string")
    index = postings.build(b.tokens(docs(spark), ["doc_id"], "text"), buckets=2)
    for any_ in (False, True):
        assert pairs(scan.match(docs(spark), asked, any_)) == pairs(postings.match(index, asked, any_=any_)) != []


def test_texts_give_the_same_postings(spark):
    from lodestone import bindings as b
    from lodestone.operators import postings

    each = lambda index: sorted(map(tuple, index.postings.select("term", "doc_id", "tf", "len").collect()))
    texts, tokens = postings.build_texts(docs(spark), buckets=2), postings.build(b.tokens(docs(spark), ["doc_id"], "text"), buckets=2)
    assert each(texts) == each(tokens) and sorted(map(tuple, texts.terms.collect())) == sorted(map(tuple, tokens.terms.collect()))


def test_prefixes_that_nobody_asks_stay_out(spark):
    from lodestone.operators import postings

    words = spark.createDataFrame([("Cattle", "term", 3), ("cat", "term", 5), ("dog", "part", 1)], "word string, kind string, freq long")
    asked = spark.createDataFrame([("CAT",), ("do",), ("cattle ranch",)], "prefix string")
    some, every = postings.prefix_table(words, longest=6, asked=asked), postings.prefix_table(words, longest=6)
    assert {r["prefix"] for r in some.collect()} == {"cat", "do", "cattle"} and every.count() > some.count()
    assert sorted(map(tuple, postings.suggest(some, asked, longest=6).collect())) == sorted(map(tuple, postings.suggest(every, asked, longest=6).collect()))
