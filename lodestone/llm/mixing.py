"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Each source asks for a share of the word budget in proportion to its weight. A source may be
repeated `max_epochs` times at most; what it can't use goes to the others, in proportion to their
weights, until none is above its cap. That fixed point is `min(cap, level * weight)` with one
`level` for all, and the level follows from running sums over the sources sorted by cap / weight,
so nothing iterates and only one row for each source is ever sorted together.

A document of a source with rate r = target / size is taken floor(r) whole times and a last,
fractional time. The fractional repetition is a run of the document's words that starts at a seeded
place; its length is r's fraction of the document, rounded up or down by a seeded draw. So the
words taken from a source are within one word a document of its target, and reruns agree. Draws
depend on the doc_id, the text and, where both are repeated, on the number of the copy; copies are
counted from a narrow table, and only rows that have any are numbered.

Defined cases: null text has size 0 and is taken 0 times; a null source is a source of its own,
sorted last; a source without words has target 0; repeated rows are each taken on their own; when
all caps together are below the budget, every source stops at its cap; an empty table gives an
empty result. Columns that the caller has besides `text`, `source` and `doc_id` are kept as they
are, and working columns take names that are free.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.common import n_words, spare, words
from lodestone.sources.scratch import frugal, materialize, small

WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, size) rows to one row a source: source, source_size, weight, target.

    `weights` repeat over the sources in code-point order, null last; `budget` is a multiple of
    all words. The windows sort one row for each source."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.select("source", "source_size", F.get(w, (F.col("rank") - 1) % len(weights)).alias("weight"), F.lit(float(max_epochs)).alias("epochs"), "rank")
    cap = F.col("source_size") * F.col("epochs")
    order = Window.orderBy((cap / F.col("weight")).asc(), "rank")
    before, onward, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(float(budget)) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.col("epochs")) / F.sum("weight").over(onward)
    found = ranked.withColumn("cap", cap).withColumn("level", level)
    # the level of the first source that isn't capped; the later ones are the same but for rounding
    first = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(whole)
    return found.withColumn("first", first).select("source", "source_size", "weight", F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("first") * F.col("weight"))).alias("target"))


def draw(seed: int, key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{salt}:"), key)), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, digest: all that the plan needs, read from the texts once."""
    return materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _digest().alias("digest")), "sizes")


def _draw_key(df: DataFrame, narrow: DataFrame, digest: str, key: str) -> DataFrame:
    """df with the column `key`: doc_id, digest and number of the copy. Copies of one doc_id and text are sorted together."""
    repeats = materialize(narrow.groupBy(F.col("doc_id").alias("r_doc"), F.col("digest").alias("r_digest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeats")
    named = lambda n: F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col(digest), F.lit(":"), n.cast("string"))
    if not repeats.count():
        return df.withColumn(key, named(F.lit(1)))
    of, at = (spare(df, x) for x in ("r_doc", "r_digest"))
    mine = F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(digest) == F.col(at))
    repeats = repeats.withColumnsRenamed({"r_doc": of, "r_digest": at})
    copies = df.join(repeats, mine, "left_semi").withColumn(key, named(F.row_number().over(Window.partitionBy("doc_id", digest).orderBy(digest))))
    return df.join(repeats, mine, "left_anti").withColumn(key, named(F.lit(1))).unionByName(copies)


def mixing_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """Every document with its size, its source's size and target, and the words taken from it.

    Returns doc_id, source, size, source_size, target, taken."""
    frugal(docs.sparkSession)
    narrow = _narrow(docs)
    per = small(source_targets(narrow.select("source", "size"), weights, budget, max_epochs).withColumnRenamed("source", "source_"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    exact = F.floor(rate * F.col("size") + draw(seed, F.col("key"), "round"))
    taken = F.least(exact, F.floor(F.col("size") * F.lit(float(max_epochs)))).cast("long")
    met = _draw_key(narrow, narrow, "digest", "key").join(per, F.col("source").eqNullSafe(F.col("source_")))
    return met.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: one row for each repetition, with the caller's columns and `repetition` and `n_taken`.

    A whole repetition keeps the text as it is. A fractional one holds consecutive words of the
    document, joined by one space, from a seeded start (it wraps to no other document). `n_chars`,
    where the caller has it, follows the text. Where the caller has a column named like one that is
    added, the added one's name ends in underscores."""
    frugal(docs.sparkSession)
    size, taken, total, start, src, goal, digest, key, rep = (spare(docs, x) for x in ("mix_size", "mix_taken", "mix_source_size", "mix_start", "mix_source", "mix_target", "mix_digest", "mix_key", "repetition"))
    narrow = _narrow(docs)
    per = small(source_targets(narrow.select("source", "size"), weights, budget, max_epochs).select(F.col("source").alias(src), F.col("source_size").alias(total), F.col("target").alias(goal)), "targets")
    sized = _draw_key(docs.withColumn(size, n_words(F.col("text"))).withColumn(digest, _digest()), narrow, digest, key)
    rate = F.when(F.col(total) > 0, F.col(goal) / F.col(total)).otherwise(F.lit(0.0))
    count = F.least(F.floor(rate * F.col(size) + draw(seed, F.col(key), "round")), F.floor(F.col(size) * F.lit(float(max_epochs)))).cast("long")
    met = sized.join(per, F.col("source").eqNullSafe(F.col(src))).withColumn(taken, count).where(F.col(taken) > 0)
    met = met.withColumn(rep, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    left = F.least(F.col(size), F.col(taken) - (F.col(rep) - 1) * F.col(size)).cast("int")
    met = met.withColumn(taken, left).withColumn(start, F.floor(draw(seed, F.col(key), "start") * (F.col(size) - F.col(taken) + 1)).cast("int") + 1)
    text = F.when(F.col(taken) == F.col(size), F.col("text")).otherwise(F.array_join(F.slice(words(F.col("text")), F.col(start), F.col(taken)), " "))
    out = met.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns, rep, F.col(taken).cast("long").alias(spare(docs, "n_taken")))
