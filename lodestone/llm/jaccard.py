"""N-gram Jaccard join by prefixes under several global token orders.

A document's set holds its distinct 5-word shingles. If two sets have a Jaccard similarity of t or
more, then under any one order of all shingles the first n - ceil(t n) + 1 shingles of each share at
least one. Candidates must do so under each of three orders; the filters are intersected before any
pair is verified, and none of them loses a pair.

1. Equal sets are one class from here on; its copies never meet each other.
2. First order: by hash. A prefix of `sample` of all shingles (those with the smallest hashes) is
   aggregated by shingle. A similar set lacks (1 - t) n shingles at most, so a class with more than
   that many in the prefix that no other class has is linked with nothing. Most of a corpus ends here.
3. Second order: rarest first, by the number of classes left that have a shingle, then by hash. A pair
   is a candidate at a shingle of both prefixes only if what follows it in both sets is enough for the
   similarity. This place bound is what keeps groups that share a common passage from pairing.
4. Third order: by another hash. The pairs' prefixes must overlap under it too; then whole sets are
   intersected.

Links are only needed until each group is connected. Each shingle's group is first tried as a star
around its most central class (the one whose shingles most others have); then the classes of groups
that the stars left in several components are tried with those of other components that fit. Every
link between different components is tried, so no component is missed; pairs inside one need not be.

Defined cases: words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; with fewer words than five the
whole sequence is the one shingle; without words the set is empty and linked with nothing, itself
its component; a null doc_id has a null component and is compared with nothing; rows that repeat a
doc_id are one node, with the links of all their texts, and each row has the size of its own set.
Shingles and sets are told apart by 64-bit hashes. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from lodestone.llm import tokens as tk
from lodestone.llm.common import n_words, spare
from lodestone.operators.graph import connected_components
from lodestone.operators.similar import similar_links
from lodestone.sources.scratch import discard, frugal, materialize

K, PERCENT, SAMPLE = 5, 75, 0.4


def _sets(words: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles as (row, hash), sorted by row and hash, and the size of each row's set."""
    h = tk.word_hashes(words, lower=True)
    counts = words.counts()
    first = np.cumsum(counts) - counts
    ok = tk.inside(words.row, K)
    short = np.flatnonzero((counts > 0) & (counts < K))
    row = np.concatenate([words.row[: len(ok)][ok], short])
    value = np.concatenate([tk.window_hashes(h, K)[ok], tk.runs_hash(h, first[short], first[short] + counts[short], tk.SECOND)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return row, value, np.bincount(row, minlength=words.rows)


def _class_of(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each row's set; 0 for an empty one."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(tk.mix(value ^ np.uint64(tk.SECOND)), out=total[1:])
    end = np.cumsum(n)
    return tk.signed(np.where(n > 0, tk.mix(total[end] - total[end - n] + n.astype(np.uint64) * np.uint64(tk.FIRST)), np.uint64(0)))


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words in tk.slices(batch.column("text")):
            _, value, n = _sets(words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(_class_of(value, n))], ["doc_id", "n_shingles", "class"])


@F.pandas_udf(LongType())
def class_hash(text: pd.Series) -> pd.Series:
    """The class of each text's set."""
    out = np.zeros(len(text), np.int64)
    for lo, hi, words in tk.slices(pa.array(text, pa.string(), from_pandas=True)):
        _, value, n = _sets(words)
        out[lo:hi] = _class_of(value, n)
    return pd.Series(out)


def _sample_rows(sample: float):
    """The shingles with the smallest hashes and the smallest and largest class of a slice that has them."""
    most = np.uint64(int(sample * 2**64) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in tk.slices(batch.column("text")):
                row, value, n = _sets(words)
                mine = value <= most
                token, of = value[mine], _class_of(value, n)[row[mine]]
                if not len(token):
                    continue
                order = np.argsort(token)
                token, of = token[order], of[order]
                at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(token[at])), pa.array(np.minimum.reduceat(of, at)), pa.array(np.maximum.reduceat(of, at))], ["token", "lo", "hi"])

    return run


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, text) to the sets of texts that are of the class."""
    for batch in batches:
        wanted = batch.column("class").to_numpy(zero_copy_only=False)
        for lo, hi, words in tk.slices(batch.column("text")):
            _, value, n = _sets(words)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tk.signed(value)))
            yield pa.RecordBatch.from_arrays([batch.column("class").slice(lo, hi - lo), lists], ["class", "tokens"]).filter(pa.array(_class_of(value, n) == wanted[lo:hi]))


def _first_order(known: DataFrame, classes: DataFrame, percent: int, sample: float) -> DataFrame:
    """class, tokens: the sets of the classes that the first order leaves."""
    own = known.select("text").mapInArrow(_sample_rows(sample), "token long, lo long, hi long")
    own = own.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo = hi").groupBy(F.col("lo").alias("class")).agg(F.count(F.lit(1)).alias("own"))
    left = classes.join(own, "class", "left").where(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= percent * F.col("n")).select("class", F.col("doc").alias("doc_"))
    texts = known.join(left, F.col("doc_id") == F.col("doc_")).select("class", "text")
    # one row a class: rows that repeat a doc_id and text are dropped here
    return materialize(texts.mapInArrow(_set_rows, "class long, tokens array<long>").groupBy("class").agg(F.first("tokens").alias("tokens")), "sets")


def class_links(docs: DataFrame, percent: int = PERCENT, sample: float = SAMPLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): doc_id, n_shingles, class of every row; class, n, doc (the smallest doc_id) of every
    set with a shingle; and links (a, b) between classes, enough to connect what is similar."""
    frugal(docs.sparkSession)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = every.where(F.col("doc_id").isNotNull())
    rows = materialize(every.mapInArrow(_class_rows, "doc_id long, n_shingles long, class long"), "rows")
    classes = rows.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("class").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("doc"))
    sets = _first_order(known, classes, percent, sample)
    links = similar_links(sets, percent)
    discard(sets)
    return rows, classes, links


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, sample: float = SAMPLE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    rows, classes, links = class_links(docs, percent, sample)
    name = lambda x: classes.select(F.col("class").alias(x), F.col("doc").alias(f"doc_{x}"))
    between = links.join(name("a"), "a").join(name("b"), "b").select("doc_a", "doc_b")
    copies = rows.where("doc_id IS NOT NULL AND n_shingles > 0").join(classes.select("class", "doc"), "class").where("doc_id <> doc").select("doc_id", "doc")
    joined = connected_components(between.union(copies), "doc_a", "doc_b")
    return rows.join(joined, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, sample: float = SAMPLE) -> DataFrame:
    """docs with one row of each group of similar texts: of the smallest doc_id. Rows without a doc_id or a word stay.

    Rows that repeat a doc_id are told apart by their texts here, so that one of two different texts is never dropped for the other."""
    rows, classes, links = class_links(docs.select("doc_id", "text"), percent, sample)
    found = connected_components(links)
    group = classes.join(found, F.col("class") == F.col("node"), "left").groupBy(F.coalesce("component", "class").alias("group")).agg(F.min(F.struct("doc", "class")).alias("first"))
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("several"))
    key, want, many, rank = (spare(docs, x) for x in ("near_doc", "near_class", "near_several", "near_rank"))
    first = group.select("first.doc", "first.class").join(several, F.col("doc") == F.col("doc_id")).select(F.col("doc").alias(key), F.col("class").alias(want), F.col("several").alias(many))
    judged = F.col("doc_id").isNotNull() & (n_words(F.col("text")) > 0)
    met = docs.where(judged).join(first, F.col("doc_id") == F.col(key))
    # texts of a repeated doc_id: the row must be of the class, and the first such
    met = met.withColumn(rank, class_hash(F.when(F.col(many), F.col("text")))).where(~F.col(many) | (F.col(rank) == F.col(want)))
    met = met.withColumn(rank, F.row_number().over(Window.partitionBy(key, want).orderBy(many))).where(F.col(rank) == 1)
    return met.select(*docs.columns).unionByName(docs.where(~judged))
