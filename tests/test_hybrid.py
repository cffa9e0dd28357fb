"""H15 from texts and from words gives one result, and pages don't meet queries in a join on 384 buckets."""

import random

from lodestone import bindings as b
from lodestone.operators import search


def test_texts_and_words_agree(spark):
    rng = random.Random(9)
    known = ["pump", "valve", "a", "Fuel", "seat", "hose", "brake", "ñu", "42"] + [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(known, k=rng.randint(0, 30)))) for i in range(400)] + [(400, None), (401, "a . a"), (402, "")], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(i, " ".join(rng.choices(known, k=rng.randint(1, 6)))) for i in range(30)] + [(30, "a"), (31, "nowhere"), (32, "")], "qid int, text string")
    queries = b.tokens(asked, ["qid"], "text")
    one, other = search.hybrid_texts(docs, queries, 7), search.hybrid(b.tokens(docs, ["doc_id"], "text"), queries, 7)
    rows = sorted(tuple(r) for r in one.collect())
    assert rows == sorted(tuple(r) for r in other.collect()) and one.schema["qid"].dataType.simpleString() == "int"
    assert {r[0] for r in rows} >= set(range(30)) and max(r[-1] for r in rows) == 7
    for found in (one, other):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "bucket" not in plan and "FlatMapCoGroupsInArrow" in plan
