"""Benchmark decontamination: containment search for short test items inside long documents.

A test item is contained in a document when at least `threshold` of its distinct 5-word shingles are
among the document's. Items are much shorter than documents, so their Jaccard similarity says little;
the search is by containment, with MinHash signatures sized to the item:

1. Items fall into partitions by size (powers of two of their number of shingles). An item's
   signature is its k smallest shingle hashes, k one more than the shingles it may lack. A document
   that contains the item has at least one of them, so the search misses nothing.
2. A partition's bound is the largest hash in its signatures, and a document's sketch for it holds
   the hashes up to that bound: a window is looked up only in the partitions whose bound it keeps to.
   The sketches meet the signatures in an equi-join on partition and hash; the bounds are few, one
   for each power of two.
3. Candidates (document, item) are verified by the words themselves: the shingles as text, distinct,
   counted exactly. Whole texts are exchanged only when the candidates are too many to broadcast.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Defined cases: null or short texts contain
nothing; an item of fewer than five words has no shingle and is never found; a null item text
neither; a null doc_id is a value like any other; repeated rows, and rows that repeat a doc_id, give
one result for each doc_id and item; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.common import ascii_lower, spare, words
from lodestone.sources.scratch import frugal, small

K = 5


def _shingle_at(kind: str, w: str = "w", i: str = "i") -> Column:
    args = ", ".join(f"{w}[{i} + {j}]" for j in range(K))
    return F.expr(f"xxhash64({args})" if kind == "hash" else f"concat_ws(' ', {args})")


def _positions(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each 5-word window: keep, w (the words) and i (where it starts)."""
    # explode of one value: the words are cut once, whatever is filtered later
    cut = df.select(*keep, F.explode(F.array(words(ascii_lower(F.col("text"))))).alias("w"))
    return cut.select(*keep, "w", F.explode(F.when(F.size("w") >= K, F.sequence(F.lit(0), F.size("w") - K))).alias("i"))


def signatures(benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """item_id, n_shingles, part, h: the signature hashes of every item."""
    h = F.array_sort(F.array_distinct(F.expr(f"transform(sequence(0, size(w) - {K}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(K))}))")))
    items = benchmark.select("item_id", words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") >= K).select("item_id", h.alias("hs"))
    n = F.size("hs")
    k = n - F.ceil(n * F.lit(threshold)).cast("int") + 1
    return items.select("item_id", n.alias("n_shingles"), F.floor(F.log2(n)).cast("int").alias("part"), F.explode(F.slice("hs", F.lit(1), k)).alias("h"))


def sketches(keyed: DataFrame, sign: DataFrame) -> DataFrame:
    """doc_id, tkey, part, h: the window hashes of every document, for each partition those within its bound."""
    # a row for each power of two: 32 at most, as an array holds 2^31 words
    bounds = sign.groupBy("part").agg(F.max("h").alias("bound")).orderBy("part").collect()
    windows = _positions(keyed, ["doc_id", "tkey"]).select("doc_id", "tkey", _shingle_at("hash").alias("h"))
    parts = F.array_compact(F.array(*[F.when(F.col("h") <= r["bound"], F.lit(r["part"])) for r in bounds])) if bounds else F.array().cast("array<int>")
    return windows.where(F.col("h") <= max((r["bound"] for r in bounds), default=0)).select("doc_id", "tkey", "h", F.explode(parts).alias("part"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment for every contained item."""
    frugal(docs.sparkSession)
    sign = signatures(benchmark, threshold)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    found = sketches(keyed, sign).join(sign.select("item_id", "part", "h"), ["part", "h"])
    found = small(found.select(F.col("doc_id").alias("found_"), F.col("tkey").alias("tfound_"), "item_id").distinct(), "found")

    mine = _positions(benchmark.select("item_id", "text"), ["item_id"]).select("item_id", _shingle_at("text").alias("s")).distinct()
    sizes = mine.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    same = F.col("doc_id").eqNullSafe(F.col("found_")) & F.col("tkey").eqNullSafe(F.col("tfound_"))
    theirs = _positions(keyed.join(found, same, "left_semi"), ["doc_id", "tkey"]).select("doc_id", "tkey", _shingle_at("text").alias("s")).distinct()
    shared = theirs.join(mine, "s").groupBy("doc_id", "tkey", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    shared = shared.join(found, same & (shared["item_id"] == found["item_id"]), "left_semi")
    met = shared.join(sizes, "item_id").where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item"))
    best = met.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """docs without the documents that contain a test item."""
    leak = spare(docs, "leak")
    leaks = small(contaminated(docs.select("doc_id", "text"), benchmark, threshold).select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col(leak)), "left_anti")
