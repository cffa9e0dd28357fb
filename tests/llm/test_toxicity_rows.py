"""Scores don't depend on how rows lie, and the defined cases of toxicity."""

from pyspark.sql import functions as F

from lodestone.llm import toxicity
from lodestone.llm.common import table


def scores(df):
    return sorted(((r["doc_id"], round(r["score"], 6)) for r in df.collect()), key=repr)


def test_repeated_doc_ids_in_any_order(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    more = docs.where("doc_id % 2 = 0").select("doc_id", F.concat(F.reverse(F.split("text", " "))[0], F.lit(" other words of the same id")).alias("text"))
    both = docs.union(more)
    labels = table(spark, sf, "labels")
    first = scores(toxicity.toxicity(both.repartition(7), labels))
    assert first == scores(toxicity.toxicity(both.orderBy(F.desc("text")).coalesce(2), labels)) and len(first) == both.count()


def test_empty_tables_and_a_long_text(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    odd = spark.createDataFrame([(10**9, "plain words " * 100_000), (10**9 + 1, None), (10**9 + 2, ""), (None, "some text")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs.union(odd), labels).where("doc_id IS NULL OR doc_id >= 1000000000").collect()}
    assert len(got) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
