"""Intermediate tables of long jobs, kept in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators.graph import ensure_checkpoint_dir

#: A finished job's shuffle files are deleted at once instead of when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch: what a Python worker and the JVM beside it hold at once follows this, not the number of rows.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Rows of a narrow table up to which it is broadcast; beyond, joins with it exchange both sides.
SMALL = 200_000


def frugal(spark: SparkSession) -> None:
    """Call before building the DataFrames of a job with several steps. Sets both settings for the session."""
    ensure_checkpoint_dir(spark)
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as Parquet under the checkpoint folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables once their last reader has been written."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


def small(df: DataFrame, name: str = "small", limit: int = SMALL) -> DataFrame:
    """df materialized, and marked for a broadcast only if it has been counted to have `limit` rows or fewer."""
    made = materialize(df, name)
    return F.broadcast(made) if made.count() <= limit else made
