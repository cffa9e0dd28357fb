"""Structured Streaming jobs over files that arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, files_a_trigger: int = 64) -> DataFrame:
    """Usage events as they arrive (Parquet, the schema of the events table)."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by kind and day; what comes later than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def append_facts(pages: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Pages that arrive go through an extraction job; each batch replaces its own folder, so a retried batch adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a decision may be.
ACTIONS = ("approve", "reject", "override")
STATUS = {"approve": "approved", "reject": "rejected", "override": "overridden"}


def decision_state(events: DataFrame, key: str = "key") -> DataFrame:
    """Key, id, status, n: the state of each key after a batch, for keys that it changed. events: key, id, action.

    The state is kept here, a row a key: the decision of the highest id, and how many counted. Actions that are no decision are
    left out, and an event with a lower id than the one that decides comes too late to change anything but the count."""

    def update(k, batches, state: GroupState):
        last, status, n = state.get if state.exists else (-1, "", 0)
        was = (last, status, n)
        for rows in batches:
            rows = rows[rows["action"].isin(ACTIONS) & rows["id"].notna()]
            if len(rows):
                top = rows.sort_values(["id", "action"]).iloc[-1]
                n += len(rows)
                if top["id"] > last:
                    last, status = int(top["id"]), STATUS[top["action"]]
        if (last, status, n) != was:
            state.update((last, status, n))
            yield pd.DataFrame({key: [k[0]], "id": [last], "status": [status], "n": [n]})

    kind = events.schema[key].dataType.simpleString()
    out = f"{key} {kind}, id long, status string, n long"
    return events.select(key, F.col("id").cast("long").alias("id"), "action").where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(update, out, "id long, status string, n long", "update", GroupStateTimeout.NoTimeout)


def route(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """qid, terms, route: saved queries with the term that fewest pages have (one that no page has comes first), by which pages are sent to them. vocabulary: term, df."""
    each = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term")).join(vocabulary.select("term", "df"), "term", "left")
    rare = each.groupBy("qid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r"))
    return queries.select("qid", F.array_distinct("terms").alias("terms")).join(rare, "qid").select("qid", "terms", F.col("r.term").alias("route"))


def saved_query_hits(pages: DataFrame, routed: DataFrame) -> DataFrame:
    """Qid, doc_id, page_number: pages with every term of a saved query. A page meets the queries that one of its terms is the
    route of, by an equi-join, and then each of these is held against all of its terms. routed: route()."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("body_text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    each = pages.select("doc_id", "page_number", words.alias("words")).select("doc_id", "page_number", "words", F.explode("words").alias("route"))
    return each.join(routed, "route").where(F.size(F.array_except("terms", "words")) == 0).select("qid", "doc_id", "page_number")


def keep_members(pages: DataFrame, routed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The members of saved queries, as pages arrive: a folder a batch, which a retried batch replaces."""

    def write(batch: DataFrame, number: int) -> None:
        saved_query_hits(batch, routed).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def member_counts(members: DataFrame, seen: DataFrame) -> DataFrame:
    """Qid, n, new: the pages of each saved query, and how many have come since it was looked at. members: qid, doc_id, page_number, batch; seen: qid, batch, the last one looked at."""
    first = members.groupBy("qid", "doc_id", "page_number").agg(F.min("batch").alias("batch"))
    met = first.join(seen.select("qid", F.col("batch").alias("seen")), "qid", "left")
    return met.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seen").isNull() | (F.col("batch") > F.col("seen"))).alias("new"))


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
