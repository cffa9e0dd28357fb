"""Append-only logs, upserts, decisions and usage figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def leaderboard(log: DataFrame, kind: str, top: int = 10, since: str | None = None) -> DataFrame:
    """The most frequent keys of a kind."""
    rows = log.where(F.col("kind") == kind)
    if since:
        rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return rows.groupBy("query").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query").limit(top)


def usage(log: DataFrame, as_of: str) -> DataFrame:
    """Events by kind, and those of the seven days before as_of."""
    recent = F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    return log.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(recent).alias("recent"))


def unanswered(log: DataFrame, kind: str = "error") -> DataFrame:
    """Count and latest time of each query without a result."""
    return log.where(F.col("kind") == kind).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


def hot_documents(log: DataFrame, top: int = 20) -> DataFrame:
    """The documents that are referred to most."""
    return log.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "document_id").limit(top)


def latest(log: DataFrame, key: str = "document_id", order: str = "event_id") -> DataFrame:
    """The last event of each key decides."""
    return log.groupBy(key).agg(F.max_by(F.struct("kind", "query"), order).alias("b"), F.max(order).alias(order)).select(key, order, "b.kind", "b.query")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("n_ = 1").drop("n_")


def popular(items: DataFrame, top: int = 12) -> DataFrame:
    """Requested items by key: count, latest time, and the name of the latest request. `items`: key, name, ts, id."""
    return items.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"), F.max_by("name", F.struct("ts", "id")).alias("name")).orderBy(F.desc("n"), "key").limit(top)


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """M1: new values replace old ones unless they are empty."""
    a, b = old.alias("a"), new.alias("b")
    met = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return met.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.coalesce(F.nullif(F.col(f"b.{c}"), F.lit("")), F.col(f"a.{c}")).alias(c) for c in columns])


def current(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """M2: the current version of each key, and how many there are."""
    w = Window.partitionBy(key)
    ranked = versions.withColumn("n_", F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))).withColumn("n_versions", F.count(F.lit(1)).over(w))
    return ranked.where("n_ = 1").drop("n_")


def import_decisions(local: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M4: (rows to append, conflicts with the local latest). Both have niin, decision, at; rows already held are no-ops."""
    valid = incoming.where(F.col("decision").isin("interchangeable", "distinct", "unsure"))
    fresh = valid.join(local, ["niin", "decision", "at"], "left_anti")
    last = local.groupBy("niin").agg(F.max_by("decision", "at").alias("held"))
    met = fresh.join(last, "niin", "left")
    agrees = F.col("held").isNull() | (F.col("held") == F.col("decision"))
    return met.where(agrees).select("niin", "decision", "at"), met.where(~agrees).select("niin", "decision", "at", "held")


def review_queue(log: DataFrame, status: str) -> DataFrame:
    """M5: subjects whose latest event has a status."""
    return latest(log).where(F.col("kind") == status).select("document_id", "event_id", "query")


def endorsed(notes: DataFrame, endorsements: DataFrame, least: int = 2) -> DataFrame:
    """M6: notes with their distinct endorsers; verified from `least` on. Notes: id, author; endorsements: ref, who, retract."""
    per = endorsements.groupBy("ref").agg(F.count_distinct(F.when(~F.col("retract"), F.col("who"))).alias("n"), F.bool_or("retract").alias("retracted"))
    met = notes.join(per, F.col("id") == F.col("ref"), "left")
    return met.select("id", "author", F.coalesce("n", F.lit(0)).alias("n_endorsers"), F.coalesce("retracted", F.lit(False)).alias("retracted"), (F.coalesce("n", F.lit(0)) >= least).alias("verified"))


def prune(documents: DataFrame, files: DataFrame, most_missing: float = 0.5) -> DataFrame:
    """M7: what becomes of each document whose file is gone: moved when its fingerprint is elsewhere, else deleted; all kept when too many are missing."""
    paths = files.select(F.col("path").alias("p"), F.lit(True).alias("there")).distinct()
    prints = files.select(F.col("fingerprint").alias("f"), F.lit(True).alias("elsewhere")).distinct()
    met = documents.join(paths, F.col("path") == F.col("p"), "left").join(prints, F.col("fingerprint") == F.col("f"), "left")
    share = met.agg((F.count_if(F.col("there").isNull()) / F.count(F.lit(1))).alias("missing"))
    fate = F.when(F.col("there"), "kept").when(F.col("missing") > most_missing, "kept: too many missing").when(F.col("elsewhere"), "moved").otherwise("deleted")
    return met.join(F.broadcast(share)).select("path", fate.alias("fate"))


def intake(found: DataFrame, known: DataFrame) -> DataFrame:
    """Folder intake: duplicate in the folder, already in the corpus, or new. found: path, hash; known: hash."""
    n = F.row_number().over(Window.partitionBy("hash").orderBy("path"))
    held = known.select(F.col("hash").alias("h"), F.lit(True).alias("held")).distinct()
    met = found.withColumn("n", n).join(held, F.col("hash") == F.col("h"), "left")
    return met.select("path", F.when(F.col("held"), "already in corpus").when(F.col("n") > 1, "duplicate in folder").otherwise("new").alias("state"))


def manifest_drift(saved: DataFrame, now: DataFrame) -> DataFrame:
    """Files missing, changed, added or same against a manifest. Both: path, sha256."""
    a, b = saved.alias("a"), now.alias("b")
    state = F.when(F.col("b.path").isNull(), "missing").when(F.col("a.path").isNull(), "added").when(F.col("a.sha256") != F.col("b.sha256"), "changed").otherwise("same")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), state.alias("state"))


def revisions(copies: DataFrame) -> DataFrame:
    """Copies of each manual, newest change first; the first is current. copies: tm, change, date, id."""
    order = Window.partitionBy("tm").orderBy(F.desc("change"), F.desc("date"), "id")
    return copies.withColumn("place", F.row_number().over(order)).withColumn("state", F.when(F.col("place") == 1, "current").otherwise("superseded"))


def coverage(pages: DataFrame, least: int = 15) -> DataFrame:
    """Pages of each vehicle, those with text, and the percentage."""
    with_text = F.count_if(F.length(F.trim("body_text")) >= least)
    return pages.groupBy("vehicle").agg(F.count(F.lit(1)).alias("n_pages"), with_text.alias("n_text")).withColumn("percent", F.round(100.0 * F.col("n_text") / F.col("n_pages"), 1))


def document_state(pages: DataFrame, least: int = 15) -> DataFrame:
    """Text when as many pages hold text as not; indexed when none waits."""
    per = pages.groupBy("doc_id").agg(F.count_if(F.length(F.trim("body_text")) >= least).alias("text"), F.count_if(F.length(F.trim("body_text")) < least).alias("pending"))
    return per.select("doc_id", F.when(F.col("text") >= F.col("pending"), "text").otherwise("scanned").alias("kind"), F.when(F.col("pending") == 0, "indexed").otherwise("partial").alias("status"))


def titles(pages: DataFrame) -> DataFrame:
    """B1: a document's title: the first line of its first three pages that is longer than six characters."""
    lines = pages.where((F.col("page_number") <= 3) & (F.length(F.trim("body_text")) > 6))
    return lines.groupBy("doc_id").agg(F.substring(F.min_by(F.trim("body_text"), "page_number"), 1, 200).alias("title"))


def vehicles(documents: DataFrame, top: int = 250) -> DataFrame:
    """Documents of each vehicle, most first."""
    return documents.groupBy(F.col("source").alias("vehicle")).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("latest")).orderBy(F.desc("n"), "vehicle").limit(top)


def hub(documents: DataFrame) -> DataFrame:
    """Documents of each vehicle by type."""
    return documents.groupBy(F.col("source").alias("vehicle"), F.col("lang").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def banded(results: DataFrame, top: int = 50) -> DataFrame:
    """exact first, approximate last, boosted next, then by rank. results: id, exact, approximate, boosted, rank."""
    order = [F.desc("exact"), F.asc("approximate"), F.desc("boosted"), F.asc("rank"), F.asc("id")]
    return results.orderBy(*order).limit(top)


def page_of(rows: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """one page of a listing, with the total beside each row."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(size).join(F.broadcast(total))


def capped_count(rows: DataFrame, cap: int = 2000) -> DataFrame:
    """a count that stops at a cap, and whether it did."""
    return rows.limit(cap).agg(F.count(F.lit(1)).alias("n")).withColumn("capped", F.col("n") >= cap)
