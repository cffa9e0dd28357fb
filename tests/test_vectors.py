"""Nearest rows: blocks against one nested loop, hyperplanes against the exact result."""

import numpy as np
import pytest

from lodestone.operators import similar, vectors


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 300)] + 0.4 * rng.normal(size=(300, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    return x, rows, rows.where("vec_id % 5 = 0").selectExpr("vec_id AS qid", "embedding AS q")


def test_blocks_give_the_exact_rows(case):
    x, rows, asked = case
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = set()
    for q in range(0, 300, 5):
        s = np.round(u @ u[q], 6)
        s[q] = -9
        expected |= {(q, int(i), r + 1) for r, i in enumerate(sorted(range(300), key=lambda i: (-s[i], i))[:4])}
    one = {(r["qid"], r["vec_id"], r["rank"]) for r in vectors.cosine_top(rows, asked, 4).collect()}
    many = vectors.cosine_top(rows, asked, 4, few=10, block=16)
    assert one == expected and {(r["qid"], r["vec_id"], r["rank"]) for r in many.collect()} == expected
    assert "NestedLoop" not in many._jdf.queryExecution().toString() and "Cartesian" not in many._jdf.queryExecution().toString()


def test_hyperplanes_recall(case):
    _, rows, asked = case
    found = vectors.recall(vectors.hyperplane_top(rows, asked, 16, 5), vectors.cosine_top(rows, asked, 5)).first()
    assert found["queries"] == 60 and found["recall"] >= 0.9
    few = vectors.hyperplane_top(rows, asked, 16, 5, tables=2, planes=12)
    assert vectors.recall(few, vectors.cosine_top(rows, asked, 5)).first()["recall"] < 0.9


def test_hamming_blocks(spark):
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 1 << 32, (80, 2))
    bits[40:] = bits[:40] ^ (1 << rng.integers(0, 32, (40, 2)))
    rows = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(bits)], "id long, hi long, lo long").repartition(3)
    asked = rows.selectExpr("id AS qid", "hi AS qhi", "lo AS qlo")
    one, many = (sorted(map(tuple, vectors.hamming_top(rows, asked, 10, 3, few=f, block=9).collect())) for f in (1000, 5))
    assert one == many and {(q, i) for q, i, d, _ in one if d == 2} >= {(i, i + 40) for i in range(40)}


def test_editions(spark):
    base = "the quick brown fox jumps over the lazy dog while seven other foxes watch from the hill".split()
    docs = spark.createDataFrame([(5, " ".join(base)), (7, " ".join(base)), (9, " ".join([*base[:-1], "valley"])), (11, "nothing like the others at all")], "doc_id long, text string")
    clusters = spark.createDataFrame([(5, 5), (7, 5), (9, 5)], "doc_id long, cluster long")
    found = similar.editions(docs, clusters)
    grams = lambda w: {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    a, c = grams(base), grams([*base[:-1], "valley"])
    assert {r["doc_id"]: r["similarity"] for r in found.collect()} == {5: 1.0, 7: 1.0, 9: round(len(a & c) / len(a | c), 6)}
    got = similar.siblings(found, spark.createDataFrame([(5,), (11,)], "doc_id long")).orderBy("rank").collect()
    assert [(r["doc_id"], r["other"]) for r in got] == [(5, 7), (5, 9)]


def test_vectors_are_compared_as_matrices(case, monkeypatch):
    x, rows, asked = case
    plan = vectors.cosine_top(rows, asked, 4)._jdf.queryExecution().toString()
    assert "aggregate(" not in plan and "NestedLoop" not in plan
    own = vectors.distance_top(rows.selectExpr("vec_id AS id", "embedding"), asked, 3, 0.5).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = set()
    for q in range(0, 300, 5):
        d = np.round(1 - u @ u[q], 6)
        expected |= {(q, int(i), r + 1) for r, i in enumerate(sorted((i for i in range(300) if d[i] <= 0.5), key=lambda i: (d[i], i))[:3])}
    assert {(r["qid"], r["id"], r["rank"]) for r in own} == expected
    monkeypatch.setattr(vectors, "GROUP", 20)
    many = vectors.cosine_top(rows, asked, 4, few=10, block=16).collect()
    assert sorted(map(tuple, many)) == sorted(map(tuple, vectors.cosine_top(rows, asked, 4).collect()))
