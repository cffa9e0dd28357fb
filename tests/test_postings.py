"""Kept postings: the same answers as plain loops, appended runs, plans without an exchange of the postings."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.operators import postings as p


def frame(spark, texts):
    return b.tokens(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), ["doc_id"], "text")


def made(rng, n, first=0):
    words = ["the"] * 30 + ["a"] * 20 + [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(200)]
    return {first + i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for i in range(n)}


def plain_best(texts, queries, top):
    docs = {d: Counter(t.split()) for d, t in texts.items() if t.split()}
    n, avg = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    out = []
    for q, terms in queries.items():
        scores = {}
        for d, c in docs.items():
            s = [math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) for t in set(terms) if c[t]]
            if s:
                scores[d] = round(math.fsum(s), 6)
        out += [(q, d, s, i + 1) for i, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(7)
    texts = made(rng, 400)
    queries = {1: ["the", "rare3", "w5"], 2: ["the", "a"], 3: ["rare1", "rare2", "rare3", "a", "the"], 4: ["nowhere"], 5: ["nowhere", "w1", "the", "a"]}
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "qid long, term string")
    return texts, queries, asked, p.build(frame(spark, texts), buckets=4)


def rows(df):
    return sorted((r["qid"], r["doc_id"], round(r["score"], 5), r["rank"]) for r in df.collect())


def close(got, expected):
    return [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in expected] and all(abs(a[2] - b_[2]) < 2e-5 for a, b_ in zip(got, expected))


@pytest.mark.parametrize("top", [1, 5, 50])
def test_best_and_bounded(case, top):
    texts, queries, asked, index = case
    expected = plain_best(texts, queries, top)
    assert close(rows(p.best(index, asked, top)), expected)
    assert close(rows(p.best_bounded(index, asked, top)), expected)


def test_common_terms_alone_make_no_candidates(case):
    texts, queries, asked, index = case
    kept = {(r["qid"], r["term"]): r["must"] for r in p.essential_terms(index, asked, 3).collect()}
    assert kept[1, "rare3"] and not kept[1, "the"] and not kept[3, "the"]
    must = p.essential_terms(index, asked, 3).where("must").join(index.postings, "term").count()
    assert must < asked.join(index.postings, "term").count() / 2


def test_no_exchange_of_the_postings(spark, case):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = p.best(case[3], case[2])._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    scan = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, at = [], depth(lines[scan])
    for x in reversed(lines[:scan]):
        if depth(x) < at:
            above.append(x)
            at = depth(x)
    join = next(i for i, x in enumerate(above) if "SortMergeJoin" in x)
    assert not any("Exchange" in x for x in above[:join])
    assert sum("Bucketed: true" in x for x in lines) == 1


def test_appended_run(spark):
    rng = random.Random(1)
    first, more = made(rng, 120), made(rng, 80, 120)
    index = p.build(frame(spark, first), buckets=3)
    # pages that are held already don't count again
    index = p.append(index, frame(spark, {**more, 3: first[3]}))
    whole = {**first, **more}
    queries = {1: ["the", "rare3"], 2: ["w1", "w2", "a"]}
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "qid long, term string")
    assert close(rows(p.best(index, asked, 10)), plain_best(whole, queries, 10))
    assert close(rows(p.best_bounded(index, asked, 10)), plain_best(whole, queries, 10))
    n = index.whole().first()
    assert n["n"] == sum(1 for t in whole.values() if t.split())


def test_prefixes(spark, case):
    texts, _, _, index = case
    count = Counter(w for t in texts.values() for w in t.split())
    asked = spark.createDataFrame([("ra",), ("rare1",), ("w",), ("zzz",)], "prefix string")
    got = defaultdict(set)
    for r in p.with_prefixes(index, asked).collect():
        got[r["prefix"]].add((r["term"], r["tf"]))
    assert dict(got) == {x: {(t, n) for t, n in count.items() if t.startswith(x)} for x in ("ra", "rare1", "w")}
    words = spark.createDataFrame([("Truck", "vehicle", 1), ("truck", "term", 90), ("trunk", "term", 7), ("Trumpet", "part", 3), ("t", "term", 99), ("trucking-company-of-the-north", "term", 2)], "word string, kind string, freq long")
    table = p.prefix_table(words, top=8, longest=6)
    got = {(r["prefix"], r["rank"]): (r["word"], r["kind"]) for r in p.suggest(table, spark.createDataFrame([("TR",), ("trucking-c",), ("t",)], "prefix string"), longest=6).collect()}
    assert got == {("tr", 1): ("Truck", "vehicle"), ("tr", 2): ("Trumpet", "part"), ("tr", 3): ("trunk", "term"), ("tr", 4): ("trucking-company-of-the-north", "term"), ("trucking-c", 1): ("trucking-company-of-the-north", "term")}


def test_boolean(spark):
    texts = {1: "oil filter 5330 01 186 housing", 2: "filter oil 5330 186 01", 3: "oil filters of the housing", 4: "fuel pump", 5: ""}
    index = p.build(frame(spark, texts), buckets=2)
    ask = lambda text, **kw: sorted(r["doc_id"] for r in p.match(index, spark.createDataFrame([(1, text)], "qid long, text string"), **kw).collect())
    assert ask("oil filter") == [1, 2, 3] and ask("filter oil") == [1, 2]
    assert ask('"oil filter" hous') == [1] and ask('"Oil Filter"') == [1]
    assert ask("5330-01-186") == [1] and ask("oil pump") == [] and ask("oil pump", any_=True) == [1, 2, 3, 4]
    assert ask("") == [] and ask('"  "') == []
    other = spark.createDataFrame([("petrol", "fuel")], "word string, alternative string")
    assert ask("petrol pum") == [] and ask("petrol pum", alternatives=other) == [4]


def test_containing(spark):
    rng = random.Random(2)
    names = {"".join(rng.choice("abcé ") for _ in range(rng.randint(0, 9))) for _ in range(300)}
    asked = {"".join(rng.choice("abcé ") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"ABC", "zq"}
    table = p.gram_table(spark.createDataFrame([(x,) for x in names] + [(None,)], "name string"))
    got = {tuple(r) for r in p.containing(table, spark.createDataFrame([(x,) for x in asked], "q string")).collect()}
    assert got == {(q.lower(), n) for q in asked for n in names if n and q.lower() in n}
    plan = p.containing(table, spark.createDataFrame([("abc",)], "q string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
