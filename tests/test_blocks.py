"""Groups of rows against blocks of queries: the same answers as plain loops and as joins, whatever the groups hold."""

import random

import pytest

from lodestone import bindings as b
from lodestone.operators import blocks, search


@pytest.fixture
def case(spark):
    rng = random.Random(3)
    words = ["the"] * 20 + ["a"] * 10 + [f"w{i}" for i in range(40)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
    rows = [(d, p, ". ".join([line(), line(), "The end of the page."]) if p else "") for d in range(40) for p in range(3)]
    pages = spark.createDataFrame(rows, "doc_id long, page_number int, body_text string").repartition(3)
    asked = [(q, t) for q in range(7) for t in {rng.choice(words) for _ in range(9)} | {"nowhere"}]
    return pages, spark.createDataFrame(asked, "qid long, term string")


@pytest.mark.parametrize("size", [(4_000_000, 10_000), (40, 3)])
def test_groups_and_blocks(case, monkeypatch, size):
    monkeypatch.setattr(blocks, "CELLS", size[0])
    monkeypatch.setattr(blocks, "BLOCK", size[1])
    pages, asked = case
    joined = search.answers(pages.select("doc_id", "body_text"), asked, 4)
    cols = ["qid", "rank", "doc_id", "sentence", "score"]
    rows = lambda df, c: sorted(map(tuple, df.select(*c).collect()))
    got = blocks.answers(pages.select("doc_id", "body_text"), asked, 4)
    assert got.columns == joined.select("qid", "sentence", "score", "doc_id", "rank").columns and rows(got, cols) == rows(joined, cols)
    pages = pages.selectExpr("doc_id * 10 + page_number AS doc_id", "body_text")
    best = search.bm25(b.tokens(pages, ["doc_id"]), asked, 5)
    cols = ["qid", "rank", "doc_id", "score"]
    got = blocks.bm25(pages, asked, 5, ["doc_id"])
    assert rows(got, cols) == rows(best, cols)
    assert "cogroup" in got._jdf.queryExecution().toString().lower()
