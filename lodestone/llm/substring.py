"""Substring deduplication by compaction of a De Bruijn graph of words.

The edges of the graph are the windows of k consecutive words. A window is repeated if it also
starts in a document with a smaller doc_id; every word that such a window covers is removed. Windows
are judged on the input, and the smallest doc_id that has a window keeps it.

1. Pieces. A window's anchor is the smallest hash of its short grams (a minimizer), so equal windows
   have equal anchors, and consecutive windows under one anchor are handled as one piece, a path of
   the graph. An aggregate by anchor finds anchors of more than one document, and joins back whether
   all their pieces are the same run of words. Everything else of the corpus is left behind here.
2. Graph. Where an anchor has one run of words everywhere, the path under it doesn't branch and is
   compacted to one edge; where it branches, each of its windows is an edge of its own. An aggregate
   over each edge's content (96 bits) gives its first document and place.
3. Compaction. Each occurrence joins its content's row. In a document, neighbouring edges compact to
   one span as long as their first places are neighbours in one text too; spans that follow each other
   with one and the same first place (a phrase over and over) compact to one row with a count.
4. Verification. The words at the span's first place (document, text and position) are read again and
   their 128-bit digest goes with the span; the span is removed only if its own words have it.

Hot windows cost one row for each document; they are aggregated before any shuffle, and the joins
that bring results back have plain exchanges on both sides, which adaptive execution can split.

Defined cases: a null or blank text has no words; a row with a null doc_id is returned unchanged and
is nobody's source; rows that repeat a doc_id are parts of one document, so none removes words of
another, and a first place is one in one of them; texts of fewer than k words have no window. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.llm import tokens as tk
from lodestone.sources.scratch import discard, frugal, materialize

GRAM = 6


def _pieces(words: tk.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; and of each piece its first window, its number of windows and its anchor's hash."""
    h = tk.word_hashes(words)
    ok = tk.inside(words.row, k)
    none = np.zeros(0, np.int64)
    if not ok.any():
        return h, none, none, none.astype(np.uint64)
    grams = min(GRAM, k)
    g, n = tk.window_hashes(h, grams, tk.SECOND), len(ok)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, k - grams + 1):
        less = g[j : j + n] < best
        np.copyto(best, g[j : j + n], where=less)
        at[less] = j
    owner = np.where(ok, at + np.arange(n), -1)
    new = ok.copy()
    new[1:] &= owner[1:] != owner[:-1]
    last = ok.copy()
    last[:-1] &= owner[:-1] != owner[1:]
    start = np.flatnonzero(new)
    return h, start, np.flatnonzero(last) + 1 - start, best[start]


def _anchor_rows(k: int):
    """(doc_id, text) to (doc_id, anchor, content), distinct in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, _, words in tk.slices(batch.column("text")):
                h, start, n, anchor = _pieces(words, k)
                if not len(start):
                    continue
                content = tk.runs_hash(h, start, start + n + k - 1, tk.FIRST)
                row = words.row[start]
                _, keep = np.unique(tk.tagged(anchor ^ (content * np.uint64(3)), row), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + row[keep]]), pa.array(tk.signed(anchor[keep])), pa.array(tk.signed(content[keep]))], ["doc_id", "anchor", "content"])

    return run


def _lists(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of rows lo to hi of a list column, and the place in the slice of each one's row."""
    part = column.slice(lo, hi - lo)
    values = part.flatten().to_numpy(zero_copy_only=False)
    lengths = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return values, np.repeat(np.arange(hi - lo), lengths)


def _edge_rows(k: int):
    """(doc_id, tkey, text, plain, branching anchors) to one row an edge in a repeated place.

    An edge that follows itself (one phrase over and over) is one row with `times`; its n is the phrase's length."""
    names = ["doc_id", "tkey", "pos", "n", "times", "c1", "c2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tkey"))
            for lo, hi, words in tk.slices(batch.column("text")):
                h, start, n, anchor = _pieces(words, k)
                if not len(start):
                    continue
                row = words.row[start]
                mine = tk.tagged(anchor, row)
                has = {}
                for name in ("plain", "branching"):
                    values, at = _lists(batch.column(name), lo, hi)
                    has[name] = np.isin(mine, tk.tagged(values.astype(np.int64).view(np.uint64), at))
                p = np.flatnonzero(has["plain"])
                b = np.flatnonzero(has["branching"])
                each = np.repeat(start[b], n[b]) + (np.arange(n[b].sum()) - np.repeat(np.cumsum(n[b]) - n[b], n[b]))
                s = np.concatenate([start[p], each])
                if not len(s):
                    continue
                m = np.concatenate([n[p], np.ones(len(each), np.int64)])
                order = np.argsort(s, kind="stable")
                s, m = s[order], m[order]
                c1, c2 = (tk.signed(tk.runs_hash(h, s, s + m + k - 1, base)) for base in (tk.FIRST, tk.SECOND))
                r = words.row[s]
                joined = np.zeros(len(s), bool)
                joined[1:] = (s[1:] == s[:-1] + m[:-1]) & (r[1:] == r[:-1])
                again = joined.copy()
                again[1:] &= (c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1])
                heads = np.flatnonzero(~again)
                times = np.diff(np.append(heads, len(s)))
                s, m, c1, c2, r = (x[heads] for x in (s, m, c1, c2, r))
                first = np.zeros(words.rows, np.int64)
                first[1:] = np.cumsum(words.counts())[:-1]
                whole = (ids[lo + r], keys[lo + r], *(x.astype(np.int32) for x in (s - first[r], m, times)), c1, (c2 >> 32).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in whole], names)

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _source_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tkey, text, wanted: pos and words) to the digest of those words."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        out: list[tuple] = []
        for d, key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tkey")), batch.column("text"), batch.column("wanted"), strict=True):
            found = (text.as_py() or "").encode().split()
            for x in wanted.as_py():
                if x["src_pos"] + x["words"] <= len(found):
                    out.append((d, key, x["src_pos"], x["words"], _digest(found[x["src_pos"] : x["src_pos"] + x["words"]])))
        columns = zip(*out, strict=True) if out else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["src_doc", "src_key", "src_pos", "words", "digest"])


def _cut_rows(with_text: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, sums, texts = [], [], [], []
            for text, key, spans in zip(batch.column("text"), batch.column("tkey").to_pylist(), batch.column("spans"), strict=True):
                found = (text.as_py() or "").encode().split()
                gone = np.zeros(len(found), bool)
                for x in spans.as_py() or ():
                    a, b = x["pos"], x["pos"] + x["words"]
                    if x["tkey"] == key and x["digest"] == _digest(found[a:b]):
                        # a row of several times is one edge of words - k + 1 windows: the words repeat with that period
                        n = x["words"] - k + 1
                        more = b + (x["times"] - 1) * n
                        gone[a : more if x["times"] > 1 and more <= len(found) and found[a + n : more] == found[a : more - n] else b] = True
                left = b" ".join(found if not gone.any() else [w for w, out in zip(found, gone.tolist(), strict=True) if not out])
                total.append(len(found))
                removed.append(int(gone.sum()))
                sums.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    texts.append(left.decode())
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())] if with_text else columns, ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return run


def repeated_spans(read: DataFrame, texts: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, tkey, pos, words, times, src_doc, src_key, src_pos, digest: verified spans of repeated words.

    `texts` has doc_id (long, not null), text and tkey, a hash that tells rows of one doc_id apart; `read` has
    the same rows as they were read, for the pass that needs no exchange."""
    anchors = read.select("doc_id", "text").mapInArrow(_anchor_rows(k), "doc_id long, anchor long, content long")
    # one row an anchor; the second join key keeps the join from reusing the aggregate's exchange, so that a hot anchor can be split
    known = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("content").alias("c_lo"), F.max("content").alias("c_hi")).where("lo < hi")
    known = known.select("anchor", F.shiftrightunsigned("anchor", 63).alias("part"), (F.col("c_lo") != F.col("c_hi")).alias("branches"))
    flagged = anchors.select("doc_id", "anchor", F.shiftrightunsigned("anchor", 63).alias("part")).join(known, ["anchor", "part"])
    flagged = materialize(flagged.groupBy(F.col("doc_id").alias("doc_")).agg(F.collect_set(F.when(~F.col("branches"), F.col("anchor"))).alias("plain"), F.collect_set(F.when(F.col("branches"), F.col("anchor"))).alias("branching")), "anchors")

    edges = texts.join(flagged, F.col("doc_id") == F.col("doc_")).select("doc_id", "tkey", "text", "plain", "branching")
    edges = edges.mapInArrow(_edge_rows(k), "doc_id long, tkey int, pos int, n int, times int, c1 long, c2 int")
    # text and position as one number, so that the minimum is one row's and the aggregate works on fixed-width buffers
    place = F.shiftleft(F.col("tkey").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    contents = edges.groupBy("c1", "c2").agg(F.min("n").alias("n"), F.min("doc_id").alias("src_doc"), F.max("doc_id").alias("last_doc"), F.min_by(place, "doc_id").alias("at"))
    contents = contents.where("src_doc < last_doc").select("c1", "c2", "n", "src_doc", F.shiftright("at", 32).cast("int").alias("src_key"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("src_pos"))
    # a job of its own: the edges are made again for the join, and the shuffle files of either go before the other's
    contents = materialize(contents, "contents")
    hits = edges.join(contents, ["c1", "c2", "n"]).where(F.col("doc_id") > F.col("src_doc"))

    order = Window.partitionBy("doc_id", "tkey").orderBy("pos")
    last = lambda c: F.lag(c).over(order)
    same = (last("src_doc") == F.col("src_doc")) & (last("src_key") == F.col("src_key")) & (F.col("times") == 1) & (last("times") == 1)
    numbered = lambda df, goes_on: df.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    runs = hits.select("doc_id", "tkey", "pos", "n", "times", "src_doc", "src_key", "src_pos").repartition("doc_id")
    runs = numbered(runs, same & (last("pos") + last("n") == F.col("pos")) & (last("src_pos") + last("n") == F.col("src_pos")))
    first = [F.min_by(c, "pos").alias(c) for c in ("src_doc", "src_key", "src_pos")]
    spans = runs.groupBy("doc_id", "tkey", "run").agg(F.min("pos").alias("pos"), F.sum("n").cast("int").alias("n"), F.max("times").alias("times"), *first)
    again = numbered(spans, same & (last("pos") + last("n") == F.col("pos")) & (last("src_pos") == F.col("src_pos")) & (last("n") == F.col("n")))
    again = again.groupBy("doc_id", "tkey", "run").agg(F.min("pos").alias("pos"), (F.first("n") + (k - 1)).cast("int").alias("words"), F.sum("times").cast("int").alias("times"), *first)
    spans = materialize(again.drop("run"), "spans")
    discard(flagged, contents)

    place = ["src_doc", "src_key", "src_pos", "words"]
    wanted = spans.select(*place).distinct().groupBy("src_doc", "src_key").agg(F.collect_list(F.struct("src_pos", "words")).alias("wanted"))
    digests = texts.join(wanted, (F.col("doc_id") == F.col("src_doc")) & (F.col("tkey") == F.col("src_key"))).select("doc_id", "tkey", "text", "wanted").mapInArrow(_source_rows, "src_doc long, src_key int, src_pos int, words int, digest binary")
    return spans.join(digests.distinct(), place)


def substring_dedup(docs: DataFrame, k: int = 13, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, where asked for, kept_text (kept words joined by one space)."""
    frugal(docs.sparkSession)
    ours = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # one exchange of the texts, reused by the passes of a job: all of them see the same rows, keyed by doc_id alone
    read = ours.where(F.col("doc_id").isNotNull())
    # tkey tells the rows of one doc_id apart, and is nothing in all the rows that follow where no doc_id is repeated
    repeated = read.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    dealt = read.repartition("doc_id").withColumn("tkey", F.hash("text") if repeated else F.lit(0))
    spans = repeated_spans(read, dealt, k).groupBy(F.col("doc_id").alias("doc_")).agg(F.collect_list(F.struct("tkey", "pos", "words", "times", "digest")).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    known = dealt.join(spans, F.col("doc_id") == F.col("doc_"), "left").select("doc_id", "tkey", "text", "spans").mapInArrow(_cut_rows(with_text, k), schema)
    without = ours.where(F.col("doc_id").isNull()).select("doc_id", F.lit(0).alias("tkey"), "text", F.lit(None).cast("array<struct<tkey:int,pos:int,words:int,times:int,digest:binary>>").alias("spans"))
    return known.union(without.mapInArrow(_cut_rows(with_text, k), schema))
