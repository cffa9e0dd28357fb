"""Ranked lexical search by an Aho-Corasick scan of the documents.

All items' terms make one automaton, each between two guards, and a text's other characters become guards
too; so the automaton finds whole terms only, and each of its outputs is a term's number. A term's
number leads to the items that have it. Nothing is kept for the documents: the texts are scanned twice,
once for the statistics (documents, terms in all, and how many documents have each term) and once for
the scores. A scan gives a row a term and partition at most, the second its best `top` documents an
item and partition, so neither exchange grows with the documents' terms.

Items go in blocks, so that the terms that a task is sent are bounded (`BLOCK` characters, unless one item
alone has more): each block is one automaton and two scans. The memory of a task is the automaton, one
text, and a table of terms by documents of `CELLS` numbers.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, only A-Z lower-cased.
All scores are 64-bit integers but for the weights, which round a logarithm down.

Defined cases: a null or empty text has no term and counts nowhere; an item without terms has no result;
rows that repeat an item_id are one item with all their terms; an item without an id has no result; a row
without a doc_id counts in the statistics and is never returned; rows that repeat a doc_id are judged one by
one, each a document; equal scores go by doc_id; empty tables give an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.llm import tokens as tk
from lodestone.llm.common import ascii_lower

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
#: Characters of the terms of a block of items; numbers in a task's table of terms by documents; texts in it at most.
BLOCK, CELLS, TEXTS = 4_000_000, 1 << 22, 512
#: Groups that a partition's best are ranked in before all are.
GROUPS = 32

GUARD = 32
#: Bytes of terms as they count, all others as the guard. Bytes of characters beyond ASCII stay.
PLAIN = np.full(256, GUARD, np.uint8)
for _lo, _hi, _to in ((48, 58, 48), (65, 91, 97), (97, 123, 97), (128, 256, 128)):
    PLAIN[_lo:_hi] = np.arange(_to, _to + _hi - _lo, dtype=np.uint8)

_automata: dict[str, object] = {}


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each item's terms, once each."""
    found = F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)))
    return items.select("item_id", found.alias("term")).where("item_id IS NOT NULL").distinct()


def blocks(terms: DataFrame, most: int = BLOCK) -> Iterator[DataFrame]:
    """terms cut by item into as many blocks as keep each to `most` characters; only an item with more than that is a larger one."""
    per = terms.groupBy("item_id").agg(F.sum(F.length("term") + 8).alias("size"))
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n))
        over = per.groupBy(block.alias("b")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("items")).where((F.col("size") > most) & (F.col("items") > 1))
        if over.isEmpty():
            break
        n *= 2
    for i in range(n):
        yield terms.where(block == i)


def _automaton(key: str, terms: list[str]):
    """The automaton of a block, made once in each worker."""
    if key not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(terms):
            made.add_word(f" {t} ", i)
        made.make_automaton()
        _automata.clear()
        _automata[key] = made
    return _automata[key]


def _counted(batches: Iterator[pa.RecordBatch], key: str, terms: list[str]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts at a time: their ids, how many terms each has, and the terms of the automaton found: text, term, times."""
    machine, many = _automaton(key, terms), len(terms)
    for batch in batches:
        at, data = tk.column_bytes(batch.column("text"))
        ids = batch.column("doc_id")
        step = max(1, min(TEXTS, CELLS // max(1, many)))
        for lo in range(0, len(ids), step):
            hi = min(lo + step, len(ids))
            plain = PLAIN[data[at[lo] : at[hi]]]
            cut = at[lo : hi + 1] - at[lo]
            after = np.ones(len(plain) + 1, bool)
            after[1:] = plain == GUARD
            after[cut] = True
            begins = (plain != GUARD) & after[:-1]
            total = np.concatenate([[0], np.cumsum(begins)])
            n = total[cut[1:]] - total[cut[:-1]]
            whole, hits = plain.tobytes(), []
            for i in range(hi - lo):
                if n[i]:
                    text = " " + whole[cut[i] : cut[i + 1]].decode() + " "
                    got = np.fromiter(map(itemgetter(1), machine.iter(text)), np.int64)
                    hits.append(got + i * many)
            found, times = np.unique(np.concatenate(hits), return_counts=True) if hits else (np.zeros(0, np.int64),) * 2
            yield ids.slice(lo, hi - lo), n, found // many, found % many, times


def _statistics(key: str, sent):
    """Rows (term, n): documents with each term; at -1 documents with a term, at -2 terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value["terms"]
        df, docs, length = np.zeros(len(terms), np.int64), 0, 0
        for _, n, _, term, _ in _counted(batches, key, terms):
            df += np.bincount(term, minlength=len(terms))
            docs += int((n > 0).sum())
            length += int(n.sum())
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([has, [-1, -2]])), pa.array(np.concatenate([df[has], [docs, length]]))], ["term", "n"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _best(item: np.ndarray, doc: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `top` best rows of each item: highest score, then smallest doc."""
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    first = np.concatenate([[True], item[1:] != item[:-1]]) if len(item) else np.zeros(0, bool)
    rank = np.arange(len(item)) - np.maximum.accumulate(np.where(first, np.arange(len(item)), 0))
    return item[rank < top], doc[rank < top], score[rank < top]


def _scores(key: str, sent, top: int):
    """Rows (item, doc_id, score): the best documents of each item within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        w, n_docs, length, of = v["weights"], v["n_docs"], v["length"], v["items"]
        held = (np.zeros(0, np.int64),) * 3
        least = np.ones(len(of), np.int64)
        for ids, n, text, term, times in _counted(batches, key, v["terms"]):
            m = np.array([50 + 50 * int(x) * n_docs // length for x in n], np.int64)
            table = np.zeros((len(w), len(ids)), np.int64)
            table[term, text] = w[term] * (1_000_000_000 * times // (1000 * times + 20 * m[text]))
            score = np.stack([table[rows].sum(axis=0) for rows in of])
            item, at = np.nonzero((score >= least[:, None]) & ids.is_valid().to_numpy(zero_copy_only=False)[None, :])
            doc = ids.fill_null(0).to_numpy().astype(np.int64)[at]
            held = tuple(np.concatenate([a, b]) for a, b in zip(held, (item, doc, score[item, at]), strict=True))
            if len(held[0]) > 4 * top * len(of):
                held = _best(*held, top)
                full = np.bincount(held[0], minlength=len(of)) >= top
                last = np.full(len(of), np.iinfo(np.int64).max)
                np.minimum.at(last, held[0], held[2])
                least[full] = last[full]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(*held, top)], ["item", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, block: DataFrame, top: int) -> DataFrame | None:
    """item_id, doc_id, score: the best documents of each item and partition; None for a block without terms."""
    spark = docs.sparkSession
    rows = block.collect()
    if not rows:
        return None
    terms, names = sorted({r.term for r in rows}), sorted({r.item_id for r in rows})
    number, place = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(names)}
    of: list[list[int]] = [[] for _ in names]
    for r in rows:
        of[place[r.item_id]].append(number[r.term])
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast({"terms": terms})
    counts = dict(docs.mapInArrow(_statistics(key, sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
    n_docs, length = counts.get(-1, 0), counts.get(-2, 0)
    weights = np.array([weight(n_docs, counts.get(i, 0)) for i in range(len(terms))], np.int64)
    sent = spark.sparkContext.broadcast({"terms": terms, "weights": weights, "n_docs": n_docs, "length": max(1, length), "items": [np.array(sorted(x)) for x in of]})
    found = docs.mapInArrow(_scores(key, sent, top), "item long, doc_id long, score long")
    ids = spark.createDataFrame(list(enumerate(names)), "item long, item_id long")
    return found.join(F.broadcast(ids), "item").select("item_id", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, most: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item with a score above 0."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms = item_terms(items.select(F.col("item_id").cast("long").alias("item_id"), "text"))
    found = None
    for block in blocks(terms, most):
        part = _search_block(texts, block, top)
        if part is not None:
            found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), "doc_id"]
    some = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS))).orderBy(*order)
    kept = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
