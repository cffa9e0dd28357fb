"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns documents; its result is written as Parquet and read
again as the next one's docs. Everything is decided over all documents that the stage is given, and the
columns of documents are handed on as they are, whatever others there are and whatever they are called.

Rows with a null text fail the quality rules. Rows that repeat a doc_id are told apart by their texts:
line_dedup takes them as parts of one document, near duplicates are judged text by text, and only
decontamination drops all of them for one. An empty table gives an empty mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import decontaminate, jaccard, linededup, mixing, quality
from lodestone.llm.common import BLANKS, spare, table
from lodestone.operators.graph import ensure_checkpoint_dir
from lodestone.sources.scratch import remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host does, go."""
    into = spare(docs, "quality")
    return quality.quality_rules(docs, into).where(F.col(f"{into}.kept")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are cut out; a document of which nothing is left goes."""
    removed = spare(docs, "removed_lines")
    cut = linededup.run_dedup(docs, removed=removed)
    emptied = (F.col(removed) > 0) & (F.btrim(F.col("text"), F.lit(BLANKS)) == "")
    return cut.where(~emptied | F.col("text").isNull()).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; rows without a doc_id or a word stay."""
    return jaccard.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each repetition that the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
]

#: The components of near duplicates have no bounded SQL form; tests/llm checks every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what lies between is written to the session's shared folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, read = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if read:
                remove(spark, read)
            read = f"{folder}/{i}-{name}"
    return docs
