"""Streams over the events table, run to the end."""

import random
import tempfile
from collections import Counter

from pyspark.sql import functions as F

from lodestone.streaming import jobs


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_daily_usage_and_state(spark, sf):
    src = folder() + "/events"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(src)
    q = jobs.run_to_table(jobs.daily_usage(jobs.event_stream(spark, src)), "daily", "complete", folder())
    q.awaitTermination()
    want = {(r["d"], r["kind"]): r["n"] for r in events.groupBy(F.to_date("ts").alias("d"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {(r["d"], r["kind"]): r["n"] for r in spark.table("daily").select(F.to_date("window.start").alias("d"), "kind", "n").collect()}
    assert got == want


def test_decision_state_over_restarts(spark, tmp_path):
    src, check = str(tmp_path / "events"), str(tmp_path / "checkpoint")
    schema = "key string, id long, action string"
    batches = [
        [("a", 5, "approve"), ("b", 1, "reject"), ("a", 7, "chat"), (None, 9, "approve"), ("c", 2, "like")],
        [("a", 3, "reject"), ("b", 4, "override"), ("d", 1, "approve"), ("a", None, "reject")],
        [("a", 8, "reject"), ("c", 1, "approve")],
    ]
    shown = {}

    def keep(batch, number):
        shown.update({r["key"]: (r["id"], r["status"], r["n"]) for r in batch.collect()})

    for rows in batches:
        # each run goes on from the checkpoint of the one before
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(src)
        stream = jobs.decision_state(spark.readStream.schema(schema).parquet(src))
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    every = [r for rows in batches for r in rows if r[0] and r[1] and r[2] in jobs.ACTIONS]
    last = {k: max((i, jobs.STATUS[a]) for key, i, a in every if key == k) for k in {r[0] for r in every}}
    assert shown == {k: (*v, sum(r[0] == k for r in every)) for k, v in last.items()}
    assert shown["a"] == (8, "rejected", 3) and "n" not in shown


def test_saved_queries_over_arriving_pages(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = [(d, p_, " ".join(rng.choice(words) for _ in range(8))) for d in range(40) for p_ in (1, 2)]
    queries = [(f"q{i}", rng.sample(words, rng.randint(1, 3))) for i in range(10)] + [("none", ["nowhere", "w1"]), ("twice", ["w2", "w2"])]
    pages = spark.createDataFrame(texts, "doc_id long, page_number int, body_text string")
    count = Counter(w for *_, t in texts for w in set(t.split()))
    vocabulary = spark.createDataFrame(list(count.items()), "term string, df long")
    routed = jobs.route(spark.createDataFrame(queries, "qid string, terms array<string>"), vocabulary)
    assert {r["qid"]: r["route"] for r in routed.collect()}["none"] == "nowhere"
    expected = {(q, d, p_) for q, ts in queries for d, p_, t in texts if set(ts) <= set(t.split())}
    hits = jobs.saved_query_hits(pages, routed)
    assert sorted(map(tuple, hits.collect())) == sorted(expected)
    assert "NestedLoop" not in hits._jdf.queryExecution().toString()
    src, out, check = (str(tmp_path / x) for x in ("pages", "members", "checkpoint"))
    for part in ("doc_id < 25", "doc_id >= 25"):
        pages.where(part).coalesce(1).write.mode("append").parquet(src)
        jobs.keep_members(spark.readStream.schema(pages.schema).parquet(src), routed, out, check).awaitTermination()
    members = spark.read.parquet(out)
    assert sorted(map(tuple, members.select("qid", "doc_id", "page_number").collect())) == sorted(expected)
    seen = spark.createDataFrame([("q0", 0), ("q1", 1)], "qid string, batch int")
    got = {r["qid"]: (r["n"], r["new"]) for r in jobs.member_counts(members, seen).collect()}
    for q in {x[0] for x in expected}:
        mine = [x for x in expected if x[0] == q]
        later = [x for x in mine if x[1] >= 25]
        assert got[q] == (len(mine), {"q0": len(later), "q1": 0}.get(q, len(mine)))


def test_page_intake(spark, sf):
    src, out = folder() + "/pages", folder() + "/facts"
    rows = [(1, 1, "Torque to 5 ft-lb."), (1, 2, "nothing"), (2, 1, "2 qt of oil")]
    spark.createDataFrame(rows, "document_id long, page int, body_text string").write.parquet(src)
    from lodestone.operators.facts import measurements

    pages = spark.readStream.schema("document_id long, page int, body_text string").parquet(src)
    jobs.append_facts(pages, measurements, out, folder()).awaitTermination()
    assert spark.read.parquet(out).count() == 2
