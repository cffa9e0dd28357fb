"""The registered queries of this folder: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import chat, covertree, decontaminate, jaccard, lexical, linededup, lmscore, mixing, quality, runs, substring, toxicity, urls
from lodestone.llm.common import table, words
from lodestone.llm.sql import ORACLES


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(urls.capture_table(pages), urls.list_entries(pages))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.run_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed_lines")
    return cut.select("doc_id", "n_removed_lines", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(chat.format_chats(turns.unionByName(extra)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id"])
    return judged.select("doc_id", *[f"quality.{c}" for c in (*quality.COUNTS, "base_failed", "kept")])


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id, text: documents of one in ten doc_ids, by their crc32, repeat a piece of theirs from some word on to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w, g = words(F.col("text")), F.expr("h DIV 10")
    cut = docs.select("doc_id", "text", h.alias("h"), F.when((h % 10 == 0) & (F.col("text") != ""), w).alias("w"))
    at = cut.withColumns({"g": g, "n": F.size("w").cast("long")}).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
    at = at.withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    repeated = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return at.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.find_runs(looped(table(spark, sf_dir, "documents"))))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_chat_format": op6_chat_format,
    "op7_quality_rules": op7_quality_rules,
    "op8_lm_score": op8_lm_score,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_ranked_search": op12_ranked_search,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}
