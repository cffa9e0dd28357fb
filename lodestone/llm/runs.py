"""Periodic runs of words, by maximal pairs of the suffixes of a text.

A run is a stretch of consecutive words with smallest period q, of max(`least`, 4 q) words or more, that no
neighbouring word extends. If it starts at s and has e words, the suffixes at s and s + q share exactly
e - q words and have different words on their left: they are a maximal pair. The other way round, a
maximal pair at distance p that shares 3 p words or more is the run from the first to the end of what is
shared, as it can't be longer on either side; nothing is extended. Pairs at a multiple of q give the same
stretch, and the smallest distance counts.

1. Suffixes that can't be in such a pair are left out. For lengths 5, 10, 20, ... windows of words are
   hashed; a pair that shares 5 * 2^t words or more, but fewer than twice that, has its suffixes at two thirds
   of 5 * 2^t or less, so a suffix without an equal window that near at any length isn't in a pair. Equal
   windows have equal hashes, so none is lost, and texts without a run mostly end here.
2. The texts that have such suffixes are ordered by prefix doubling over exact word numbers, and the
   shared lengths of neighbours in the order are read off the ranks of each doubling.
3. The tree of LCP intervals is walked bottom-up with a stack. A node holds the suffixes below it in lists by
   left word, kept as one list in text order whose entries carry their word, and whether it is one word for
   all; children of one and the same word have no maximal pair and are only joined. Else the smaller child's
   suffixes ask the larger's for their neighbours: no suffix of the node stands between s and s + q, as q
   would not be the smallest period otherwise, so one look to each side stands for the product of the lists.

The work is n log n in a text's words. Texts are independent, so there is no exchange; a text is never
split, and memory follows the longest text with runs, at about 4 log2(its words) bytes a word.

Defined cases: words are `[^\\x20\\x09-\\x0D]+`, unchanged; a null, empty or blank text has no runs and an
empty collapsed text; repeated rows and null ids are rows like any other; an empty table gives an empty
one; columns besides the text are kept as they are, and result columns get a free name if theirs is taken.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lodestone.llm import tokens as tk
from lodestone.llm.common import spare

#: Words of the shortest run, and how many periods a run has at least.
LEAST, TIMES = 6, 4
#: Words that the two suffixes of the shortest run share.
SHARED = LEAST - 1

RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def _near_suffixes(h: np.ndarray, row: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places of the words whose suffixes may be in a pair. end: for each word, where its text ends."""
    alive, size, kept = np.arange(len(h)), SHARED, []
    while True:
        alive = alive[alive + size <= end[alive]]
        if len(alive) < 2:
            break
        w = tk.tagged(tk.runs_hash(h, alive, alive + size, tk.FIRST), row[alive])
        order = np.argsort(w, kind="stable")
        at, same = alive[order], w[order][1:] == w[order][:-1]
        near = same & (3 * (at[1:] - at[:-1]) <= 2 * size)
        kept += [at[:-1][near], at[1:][near]]
        alive = np.sort(np.union1d(at[:-1][same], at[1:][same]))
        size *= 2
    return np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)


def _numbers(words: tk.Words) -> np.ndarray:
    """Equal numbers for equal words, over the whole slice."""
    size = words.end - words.start
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    solid = np.ascontiguousarray(words.data[~tk.BLANK[words.data]])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(solid)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _ranks(value: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the first 1, 2, 4, ... words of each suffix; the last are all different. end: where each word's text ends."""
    n = len(value)
    place = np.arange(n)
    rank = np.unique(value, return_inverse=True)[1].astype(np.int64)
    out, size = [rank], 1
    while True:
        after = place + size
        inside = after < end
        key = rank * (n + 1)
        key[inside] += rank[after[inside]] + 1
        found, rank = np.unique(key, return_inverse=True)
        if len(found) == n:
            return [*(r.astype(np.int32) for r in out), rank]
        out.append(rank)
        size *= 2


def _shared(a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b share."""
    total = np.zeros(len(a), np.int64)
    stop, n = np.minimum(end[a] - a, end[b] - b), len(end)
    for t in range(len(ranks) - 2, -1, -1):
        ok = (total + (1 << t) <= stop) & (ranks[t][np.minimum(a + total, n - 1)] == ranks[t][np.minimum(b + total, n - 1)])
        total[ok] += 1 << t
    return total


def _merged(one: tuple, other: tuple, depth: int, left: list, found: dict) -> tuple:
    """Two children of an interval of `depth` shared words as one node; the pairs between them go to found."""
    (a, word_a), (b, word_b) = (one, other) if len(one[0]) >= len(other[0]) else (other, one)
    same = word_a is not None and word_a == word_b
    if not same:
        reach = depth // (TIMES - 1)
        for p in b:
            i = bisect(a, p)
            for q in a[max(i - 1, 0) : i + 1]:
                if -reach <= p - q <= reach and left[p] != left[q]:
                    start, period = (p, q - p) if p < q else (q, p - q)
                    span = (start, start + period + depth)
                    found[span] = min(period, found.get(span, period))
    if len(b) * 8 < len(a):
        for p in b:
            insort(a, p)
    elif a[-1] < b[0]:
        a += b
    else:
        a = sorted(a + b)
    return a, word_a if same else None


def maximal_pairs(at: list[int], shared: list[int], left: list[int]) -> dict[tuple[int, int], int]:
    """{(start, end): period}. at: suffixes in their order; shared: words that each shares with the one before it; left: the word before each place, by place."""
    found: dict[tuple[int, int], int] = {}
    stack: list[list] = []
    now = None
    for k, p in enumerate(at):
        depth = shared[k]
        while stack and stack[-1][0] > depth:
            size, node = stack.pop()
            now = _merged(node, now, size, left, found)
        if depth >= SHARED:
            if stack and stack[-1][0] == depth:
                stack[-1][1] = _merged(stack[-1][1], now, depth, left, found)
            else:
                stack.append([depth, now])
        now = ([p], left[p])
    while stack:
        size, node = stack.pop()
        now = _merged(node, now, size, left, found)
    return found


def slice_runs(words: tk.Words) -> np.ndarray:
    """Rows of (row, start, length, period) of every run of a slice of texts, by row, start and period; start is a word's number in its text."""
    none = np.zeros((0, 4), np.int64)
    if len(words.row) < LEAST:
        return none
    counts = words.counts()
    ends = np.cumsum(counts)
    h = tk.word_hashes(words)
    near = _near_suffixes(h, words.row, ends[words.row])
    if not len(near):
        return none
    # the texts with such suffixes, one after the other
    has = np.zeros(words.rows, bool)
    has[words.row[near]] = True
    mine = np.flatnonzero(has[words.row])
    row, number = words.row[mine], _numbers(words)[mine]
    begin = np.zeros(words.rows, np.int64)
    begin[has] = np.concatenate([[0], np.cumsum(counts[has])[:-1]])
    end = (begin + counts)[row]
    kept = np.searchsorted(mine, near)
    ranks = _ranks(row * (int(number.max()) + 1) + number, end)
    kept = kept[np.argsort(ranks[-1][kept])]
    shared = np.zeros(len(kept), np.int64)
    shared[1:] = np.where(row[kept[1:]] == row[kept[:-1]], _shared(kept[:-1], kept[1:], ranks, end), 0)
    left = np.concatenate([[-1], number[:-1]])
    left[begin[has]] = -1
    found = maximal_pairs(kept.tolist(), shared.tolist(), left.tolist())
    if not found:
        return none
    out = np.array([(s, e - s, q) for (s, e), q in found.items()], np.int64)
    out = np.column_stack([row[out[:, 0]], out[:, 0] - begin[row[out[:, 0]]], out[:, 1], out[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _collapsed(words: tk.Words, found: np.ndarray) -> pa.Array:
    """The texts' words joined by one space, each run cut to its first period."""
    counts = words.counts()
    first = np.cumsum(counts) - counts
    edge = np.zeros(len(words.row) + 1, np.int64)
    begin = first[found[:, 0]] + found[:, 1]
    np.add.at(edge, begin + found[:, 3], 1)
    np.add.at(edge, begin + found[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    size = words.end[kept] - words.start[kept] + 1  # and the space after it
    at = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    data = words.data[np.repeat(words.start[kept] - at[:-1], size - 1) + _all_but_last(at)] if len(kept) else np.zeros(0, np.uint8)
    whole = np.full(at[-1], 32, np.uint8)
    whole[_all_but_last(at)] = data
    per = np.bincount(words.row[kept], minlength=words.rows)
    ends = at[np.cumsum(per)]
    # a text's last space goes
    last = ends[per > 0] - 1
    whole = np.delete(whole, last)
    offsets = np.concatenate([[0], ends - np.cumsum(per > 0)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(words.rows, pa.py_buffer(offsets), pa.py_buffer(whole)).cast(pa.string())


def _all_but_last(at: np.ndarray) -> np.ndarray:
    """The places of pieces cut at `at`, without the last of each."""
    places = np.ones(int(at[-1]), bool)
    places[at[1:] - 1] = False
    return np.flatnonzero(places)


def _run_rows(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in tk.slices(batch.column(text)):
                found = slice_runs(words)
                offsets = np.searchsorted(found[:, 0], np.arange(words.rows + 1)).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in (1, 2, 3)], ["start", "length", "period"])
                rest = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(offsets), parts), _collapsed(words, found)], [*batch.schema.names, "runs_", "collapsed_"])

    return run


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `runs`, an array of (start, length, period) by start and period, and `collapsed`, the text with each run cut to its first period."""
    given = docs.columns
    # columns travel by place, so that clashing names don't matter
    plain = docs.toDF(*[f"c{i}" for i in range(len(given))])
    schema = StructType([*plain.schema.fields, StructField("runs_", ArrayType(RUN)), StructField("collapsed_", StringType())])
    made = plain.mapInArrow(_run_rows(f"c{given.index(text)}"), schema)
    return made.toDF(*given, spare(docs, "runs"), spare(docs, "collapsed"))


def longest(runs: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period. Null without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text."""
    best = found.select("doc_id", "runs", "collapsed", longest(F.col("runs")).alias("best"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
