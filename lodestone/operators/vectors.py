"""Nearest rows of a batch of queries: exact in blocks, or through random hyperplanes with exact scores.

The exact path compares every query with every row, which is the question itself. Queries and rows are dealt into blocks,
and each pair of blocks meets in one group: a row is sent once for each block of queries. Vectors are compared there as
matrices, and a group gives its first rows only. Hashes are joined; while their queries have been counted to be few, these are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.sources.scratch import materialize

#: Queries that are broadcast, and queries of a block beyond.
FEW, BLOCK = 2_000, 10_000
#: Rows of a group, and queries that are held against it at once.
GROUP, CHUNK = 20_000, 128
#: Hyperplane tables, and planes of each.
TABLES, PLANES = 20, 7


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def meet(rows: DataFrame, queries: DataFrame, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """Every query beside every row. queries is counted."""
    asked = materialize(queries, "asked")
    n = asked.count()
    if n <= few:
        return rows.join(F.broadcast(asked))
    blocks = math.ceil(n / block)
    # as many groups of rows as the rows' own partitions: each meets each block of queries
    parts = max(1, rows.rdd.getNumPartitions())
    asked = asked.withColumn("block_", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = rows.withColumn("part_", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int")).withColumn("block_", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    return dealt.join(asked.hint("shuffle_hash"), ["block_", "part_"]).drop("block_", "part_")


def best_of(scored: DataFrame, top: int, by: list[Column], key: str) -> DataFrame:
    """rank: the first `top` rows of each query; partial limits are taken before the exchange."""
    order = Window.partitionBy("qid").orderBy(*by, key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _compared(dim: int, top: int, own: bool, within: float | None, planes: tuple | None) -> Callable:
    """A group of rows and a block of queries to the first `top` rows of each: by cosine, or by distance (1 - cosine) where `within` limits it."""

    chunk = CHUNK
    normal = np.random.default_rng(planes[2]).normal(size=(dim, planes[0] * planes[1])) if planes else None

    def side(x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table: on which side of its planes it is."""
        return ((x @ normal > 0).reshape(len(x), planes[0], planes[1]) * (1 << np.arange(planes[1]))).sum(axis=2).astype(np.int64).T

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        """Vectors as rows of doubles; nan where one is null, of another length, or holds a null."""
        out = np.full((len(column), dim), np.nan)
        for i, v in enumerate(column.to_pylist()):
            if v is not None and len(v) == dim:
                out[i] = [np.nan if x is None else x for x in v]
        return out

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, qids = rows["id"].to_numpy().astype(np.int64), asked["qid"].to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")  # equal scores by id
        ids, x, q = ids[order], matrix(rows["v"])[order], matrix(asked["q"])
        norm, qnorm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        if planes:
            count = np.array([i.bit_count() for i in range(1 << planes[1])], np.uint8)
            mine, theirs = side(np.nan_to_num(x)), side(np.nan_to_num(q))
        found = [[], [], []]
        for at in range(0, len(qids), chunk):
            with np.errstate(all="ignore"):
                score = (q[at : at + chunk] @ x.T) / (qnorm[at : at + chunk, None] * norm[None, :])
            score = np.round(score if within is None else 1 - score, 6)
            sort = np.nan_to_num(-score if within is None else score, nan=np.inf, posinf=np.inf)
            left = np.ones(score.shape, bool) if within is None else score <= within
            if not own:
                left &= ids[None, :] != qids[at : at + chunk, None]
            if planes:
                met = np.zeros(score.shape, bool)
                for a, b in zip(mine, theirs, strict=True):
                    met |= count[a[None, :] ^ b[at : at + chunk, None]] <= 1
                left &= met
            for i in range(len(score)):
                some = np.flatnonzero(left[i])
                key = sort[i, some]
                if len(some) > top:
                    least = key <= np.partition(key, top - 1)[top - 1]
                    some, key = some[least], key[least]
                some = some[np.argsort(key, kind="stable")[:top]]
                found[0].append(np.full(len(some), qids[at + i]))
                found[1].append(ids[some])
                found[2].append(score[i, some])
        qid, vec, value = (np.concatenate([np.zeros(0, t), *part]) for part, t in zip(found, (np.int64, np.int64, float), strict=True))
        return pa.table({"qid": pa.array(qid, pa.int64()), "id": pa.array(vec, pa.int64()), "value": pa.array(value, pa.float64(), mask=np.isnan(value))})

    return run


def nearest(rows: DataFrame, queries: DataFrame, top: int, own: bool = False, within: float | None = None, planes: tuple | None = None, few: int = FEW, block: int = BLOCK, dim: int | None = None) -> DataFrame:
    """qid, id, value: the first `top` rows of each group of rows for each query, by cosine or, `within` a distance, by 1 - cosine; with `planes`
    (tables, planes, seed) only rows that share a bucket with the query, or are across one plane of it. rows: id, v; queries: qid, q.

    Queries are dealt into blocks and rows into groups of some ten thousand; each group of rows meets each block once, in matrices."""
    kept, asked = materialize(rows.select(F.col("id").cast("long"), "v"), "rows"), materialize(queries.select(F.col("qid").cast("long"), "q"), "asked")
    n, m = kept.count(), asked.count()
    dim = dim or kept.agg(F.max(F.size("v"))).first()[0] or 1
    blocks, parts = 1 if m <= few else math.ceil(m / block), max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / GROUP))
    asked = asked.withColumn("block_", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = kept.withColumn("part_", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block_", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    return dealt.groupBy("block_", "part_").cogroup(asked.groupBy("block_", "part_")).applyInArrow(_compared(dim, top, own, within, planes), "qid long, id long, value double")


def cosine_top(vectors: DataFrame, queries: DataFrame, top: int = 15, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """Qid, vec_id, score, rank: the nearest rows to each query vector by cosine, exactly. vectors: vec_id, embedding; queries: qid, q."""
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return best_of(nearest(rows, queries, top, few=few, block=block).toDF("qid", "vec_id", "score"), top, [F.desc("score")], "vec_id")


def distance_top(vectors: DataFrame, queries: DataFrame, top: int, within: float) -> DataFrame:
    """qid, id, distance, rank: the nearest rows to each query vector within a cosine distance, the query's own among them. vectors: id, embedding; queries: qid, q."""
    rows = vectors.select("id", F.col("embedding").alias("v"))
    return best_of(nearest(rows, queries, top, True, within).toDF("qid", "id", "distance"), top, [F.col("distance")], "id")


def hyperplane_top(vectors: DataFrame, queries: DataFrame, dim: int, top: int = 15, tables: int = TABLES, planes: int = PLANES, seed: int = 7) -> DataFrame:
    """As cosine_top(), among the rows that share a bucket with the query in some table, its neighbours across one plane included.

    Candidates are scored exactly, so only rows that share no bucket are missed; tests hold the recall against the exact result.
    More tables find more, more planes compare less."""
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return best_of(nearest(rows, queries, top, planes=(tables, planes, seed), dim=dim).toDF("qid", "vec_id", "score"), top, [F.desc("score")], "vec_id")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the share of the exact rows that were found."""
    hit = exact.select("qid", "vec_id").join(found.select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    return hit.agg(F.count_distinct("qid").alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def hamming_top(hashes: DataFrame, queries: DataFrame, reach: int = 22, top: int = 12, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """Nearest 64-bit hashes within `reach` bits, kept as two halves: id, hi, lo; queries: qid, qhi, qlo.

    A match may differ in so many bits that no band of them is sure to be untouched, so all are compared."""
    distance = F.bit_count(F.col("hi").bitwiseXOR(F.col("qhi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("qlo")))
    met = meet(hashes.select("id", "hi", "lo"), queries, few, block).where(F.col("id") != F.col("qid")).withColumn("distance", distance).where(F.col("distance") <= reach)
    return best_of(met.select("qid", "id", "distance"), top, [F.col("distance")], "id")
