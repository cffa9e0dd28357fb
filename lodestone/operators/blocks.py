"""Rows with terms against queries with terms, in groups: sums of the shared terms' weights as matrices, and of each group its first rows only.

A group of rows meets a block of queries once. What a task holds is bounded by the group and `CELLS`, and nothing is exchanged for a pair of a
row and a query unless it is among the first of its group.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.operators.scan import B, K1, counted, lookup
from lodestone.sources.scratch import SMALL, frugal, materialize

#: Scores that are held at once, and products that they are summed from; queries of a block; groups of rows for each partition of the input.
CELLS, BLOCK, GROUPS = 2_000_000, 10_000, 4
#: Bytes of rows that are held where they lie.
HELD = 32 << 20
#: Cells of a bit matrix while it is built, queries of its block, and letters up to which words are cut side by side.
BITS, MANY, SHORT = 64_000_000, 40_000, 32


def _first(top: int, order: list[str], once: str | None, covered: bool) -> Callable:
    """A group of rows (order..., terms and weights, tf and len, or n) and a block of queries (term, asked: qid and maybe weight, maybe idf and avg) to the first `top`
    rows of each by score, equal ones by `order`.

    The score is the sum of weights (times those of the query, if it has any), of BM25's shares if rows have `tf`, or with `covered` by the share of the query's and of the row's words;
    of rows with equal `once` the first counts, its words as often as the row with the most of them under one `order[0]` repeats them. Beside its rows and queries, a group holds `CELLS` scores and products."""
    cells = CELLS

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        plain = lambda c: c.to_numpy(zero_copy_only=False)
        index = plain(pc.sort_indices(rows.select(order), sort_keys=[(c, "ascending") for c in order]))
        if once:
            same = plain(one(one(rows[once]).dictionary_encode().indices))[index]
            pairs, n_times = np.unique(np.stack([same, rows[order[0]].to_numpy()[index]], axis=1), axis=0, return_counts=True)
            times, first = np.zeros(same.max(initial=-1) + 1), np.sort(np.unique(same, return_index=True)[1])
            np.maximum.at(times, pairs[:, 0], n_times)
            times, index = times[same[first]], index[first]
        # queries by term
        vocabulary, who = one(asked["term"]), one(asked["asked"])
        start = np.concatenate([[0], np.cumsum(plain(pc.list_value_length(who)))]).astype(np.int64)
        each = pc.list_flatten(who)
        qids, columns = np.unique(plain(each.field("qid")), return_inverse=True)
        need, columns = np.bincount(columns, minlength=len(qids)), columns.astype(np.int32)
        theirs = plain(each.field("weight")) if "weight" in each.type.names else None
        idf, avg = (plain(asked["idf"]), asked["avg"][0].as_py()) if "tf" in rows.column_names and asked.num_rows else (None, None)
        # terms of rows that a query has: as numbers, row by row
        code = [plain(pc.fill_null(pc.index_in(pc.list_flatten(c), value_set=vocabulary), -1)) for c in rows["terms"].chunks]
        code = np.concatenate([np.zeros(0, np.int32), *code])
        known = np.flatnonzero(code >= 0)
        begin = np.concatenate([[0], np.cumsum(plain(pc.list_value_length(one(rows["terms"]))))])
        begin, code = np.searchsorted(known, begin), code[known]
        given = next((c for c in ("weights", "tf") if c in rows.column_names and not covered), None)
        given = np.concatenate([np.zeros(0), *[plain(pc.list_flatten(c)) for c in rows[given].chunks]])[known] if given else None
        length = rows["len"].to_numpy() if idf is not None else None
        n = rows["n"].to_numpy()[index] if covered else None
        floor, held = np.zeros(len(qids)), [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        step = max(1, cells // max(1, len(qids)))
        low, high = 0, max(1, step // 8)
        while low < len(index):
            mine = index[low:high]
            size = begin[mine + 1] - begin[mine]
            at = np.arange(size.sum()) + np.repeat(begin[mine] - np.cumsum(size) + size, size)
            row, t = np.repeat(np.arange(len(mine)), size), code[at]
            weight = np.ones(len(at)) if given is None else given[at]
            if idf is not None:
                weight = idf[t] * weight * (K1 + 1) / (weight + K1 * (1 - B + B * length[mine][row] / avg))
            many = start[t + 1] - start[t]
            ends = np.cumsum(many)
            score = np.zeros(len(mine) * len(qids))
            cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, cells)))
            for a, z in zip(cuts, [*cuts[1:], len(t)], strict=True) if len(cuts) else ():
                m = many[a:z]
                place = np.arange(m.sum()) + np.repeat(start[t[a:z]] - np.cumsum(m) + m, m)
                part = np.repeat(weight[a:z], m)
                # one after the other, so that sums don't depend on the cuts
                np.add.at(score, np.repeat(row[a:z] * len(qids), m) + columns[place], part if theirs is None else part * theirs[place])
            score = score.reshape(len(mine), len(qids))
            met = score > 0
            if once:
                score = score * times[low:high, None]
            if covered:
                score = 2 * score / need[None, :] + score / n[low:high, None]
            score = np.round(score, 6)
            r, q = np.nonzero(met & (score >= floor[None, :]))
            held = [np.concatenate(x) for x in zip(held, (q, r + low, score[r, q]), strict=True)]
            # the first `top` so far of each query; a later row has to reach the last of them
            sort = np.lexsort((held[1], -held[2], held[0]))
            held = [x[sort] for x in held]
            first = np.searchsorted(held[0], np.arange(len(qids)))
            rank = np.arange(len(held[0])) - first[held[0]]
            floor[held[0][rank == top - 1]] = held[2][rank == top - 1]
            held = [x[rank < top] for x in held]
            low, high = high, min(high + min(step, 2 * (high - low)), len(index))
        found = rows.select(order).take(pa.array(index[held[1]]))
        return pa.table([pa.array(qids[held[0]], pa.int64()), *found.columns, pa.array(held[2], pa.float64())], ["qid", *order, "score"])

    return run


def _where_they_lie(first: Callable, asked: pa.Table) -> Callable:
    most = HELD

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.nbytes
            if size >= most:
                yield from first(pa.Table.from_batches(held), asked).to_batches()
                held, size = [], 0
        if held:
            yield from first(pa.Table.from_batches(held), asked).to_batches()

    return run


def first_of(rows: DataFrame, asked: DataFrame, top: int, order: list[str], deal: list[str], parts: int, once: str | None = None, covered: bool = False, few: bool = False) -> DataFrame:
    """qid, order..., score, rank. rows: order..., terms, and weights, tf and len, or n; asked: qid, term, each once, and maybe weight, or idf and avg with the term.

    A block of queries is a row for each of their terms, and so goes to every group once. With `few`, queries of up to `SMALL` rows go to where the rows
    lie, in groups of `HELD` bytes, and rows aren't exchanged."""
    frugal(rows.sparkSession)
    asked = materialize(asked.select(F.col("qid").cast("long"), *asked.drop("qid").columns), "asked")
    blocks = max(1, math.ceil(asked.select("qid").distinct().count() / BLOCK))
    of = [c for c in ("idf", "avg") if c in asked.columns]
    each = F.collect_list(F.struct("qid", *[c for c in ("weight",) if c in asked.columns])).alias("asked")
    every = materialize(asked.groupBy(F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block_"), "term", *of).agg(each), "by_term")
    by_term = every.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = rows.withColumn("part_", F.pmod(F.xxhash64(*deal), F.lit(parts)).cast("int")).withColumn("block_", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*order).dtypes)
    if few and blocks == 1 and asked.count() <= SMALL:
        found = rows.mapInArrow(_where_they_lie(_first(top, order, once, covered), every.drop("block_").toArrow()), f"qid long, {kinds}, score double")
    else:
        found = dealt.groupBy("block_", "part_").cogroup(by_term.groupBy("block_", "part_")).applyInArrow(_first(top, order, once, covered), f"qid long, {kinds}, score double")
    by = Window.partitionBy("qid").orderBy(F.desc("score"), *order)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def parts_of(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, GROUPS * df.rdd.getNumPartitions())


def answers(pages: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """The sentences that cover most of a question's terms. queries: qid, term; pages: doc_id, body_text. Equal sentences lie in one group."""
    sentences = pages.select("doc_id", F.explode(F.split("body_text", r"(?<=[.!?])\s+")).alias("sentence")).where(F.length("sentence") > 12)
    words = F.array_distinct(F.regexp_extract_all(F.lower("sentence"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    rows = sentences.select("doc_id", "sentence", words.alias("terms"), F.regexp_count("sentence", F.lit(r"\S+")).alias("n"))
    return first_of(rows, queries.distinct(), top, ["doc_id", "sentence"], ["sentence"], parts_of(pages), "sentence", True).select("qid", "sentence", "score", "doc_id", "rank")


def bm25(pages: DataFrame, queries: DataFrame, top: int, key: list[str], text: str = "body_text", few: bool = False) -> DataFrame:
    """The best pages of each query by BM25 for many queries with many terms, or for `few`. queries: qid, term."""
    return bm25_counted(materialize(counted(pages, key, text), "counted"), queries, top, key, parts_of(pages), few)


def bm25_counted(post: DataFrame, queries: DataFrame, top: int, key: list[str], parts: int, few: bool = False) -> DataFrame:
    """The rows of bm25() from pages whose words are counted (key..., len, c), which are read several times. A page's words are exchanged in its row, and weighted where they meet the queries."""
    asked = materialize(queries.select("qid", "term").distinct(), "asked")
    whole = post.agg(F.count(F.lit(1)).alias("pages_"), F.avg("len").alias("avg"))
    df = post.select(F.inline_outer("c")).join(lookup(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = df.crossJoin(whole).select("term", "avg", F.log(1 + (F.col("pages_") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    rows = post.select(*key, "len", F.col("c.term").alias("terms"), F.col("c.tf").alias("tf"))
    return first_of(rows, asked.join(known, "term"), top, key, key, parts, few=few)


def _hashed(batches, key: str, dim: int):
    """(key, terms, n) to sparse vectors (key, terms: buckets, weights): words of two letters or more by crc32 modulo dim, counted and scaled to length 1."""
    for batch in batches:
        terms = batch.column("terms")
        flat, parent = pc.list_flatten(terms), pc.list_parent_indices(terms).to_numpy()
        words = pc.unique(flat)
        code = np.array([zlib.crc32(w.encode()) % dim if len(w) >= 2 else -1 for w in words.to_pylist()], np.int64)[pc.index_in(flat, value_set=words).to_numpy()]
        use = code >= 0
        cells, at = np.unique(parent[use] * dim + code[use], return_inverse=True)
        n = np.bincount(at, weights=pc.list_flatten(batch.column("n")).to_numpy()[use], minlength=len(cells))
        row = cells // dim
        weight = n / np.sqrt(np.bincount(row, weights=n * n, minlength=batch.num_rows))[row]
        ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
        buckets = pa.array(cells % dim).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(ends, buckets), pa.ListArray.from_arrays(ends, pa.array(weight, pa.float64()))], [key, "terms", "weights"])


def hashed(post: DataFrame, key: str, dim: int = 384) -> DataFrame:
    """Key, terms (buckets), weights: the sparse vector of each row of post (key, c), where the row lies."""

    def run(batches):
        yield from _hashed(batches, key, dim)

    of = dict(post.dtypes)[key]
    return post.select(key, F.col("c.term").alias("terms"), F.transform("c", lambda x: x["tf"].cast("long")).alias("n")).mapInArrow(run, f"{key} {of}, terms array<string>, weights array<double>")


def hashed_top(post: DataFrame, queries: DataFrame, top: int, key: str, parts: int) -> DataFrame:
    """The nearest rows of post (key, c) to each query by hashed vectors. queries: qid, term, a row for each word."""
    words = queries.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("tf")).groupBy("qid").agg(F.collect_list(F.struct("term", "tf")).alias("c"))
    asked = hashed(words, "qid").select("qid", F.explode(F.arrays_zip("terms", "weights")).alias("t")).select("qid", F.col("t.terms").alias("term"), F.col("t.weights").alias("weight"))
    return first_of(hashed(post, key), asked, top, [key], [key], parts)


def _inside(words: pa.Array, asked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, asked) of every asked term that stands in a word, whole or in part; a pair may come more than once."""
    size, length = pc.utf8_length(words).to_numpy(zero_copy_only=False), pc.utf8_length(asked).to_numpy(zero_copy_only=False)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    long = np.flatnonzero(size > SHORT)
    texts = words.take(pa.array(long)).to_pylist()
    for k in np.unique(length):
        mine = np.flatnonzero(length == k)
        terms = asked.take(pa.array(mine))
        for i in range(SHORT - int(k) + 1):
            at = np.flatnonzero((size >= i + k) & (size <= SHORT))
            if not len(at):
                break
            met = pc.index_in(pc.utf8_slice_codeunits(words.take(pa.array(at)), i, i + int(k)), value_set=terms)
            hit = np.flatnonzero(pc.is_valid(met).to_numpy(zero_copy_only=False))
            found.append((at[hit], mine[met.take(pa.array(hit)).to_numpy(zero_copy_only=False)]))
        known = dict(zip(terms.to_pylist(), mine.tolist(), strict=True))
        for w, text in zip(long.tolist(), texts, strict=True):
            hit = [known[t] for t in {text[i : i + k] for i in range(len(text) - int(k) + 1)} if t in known]
            found.append((np.full(len(hit), w), np.array(hit, np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _any(labelled: bool, inside: bool) -> Callable:
    """A group of rows (label, a, b, terms) and a block of queries (qid, label, terms) to qid, label, n, a, b: of each label the
    number of (a, b) with a term of the query, and the first of them. Only queries of that label are asked if `labelled`.

    A term has a bit for each (a, b), and a query's bits are its terms' together."""
    cells = BITS

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        code = lambda c: one(one(c).dictionary_encode().indices).to_numpy(zero_copy_only=False)
        rows, asked = rows.sort_by([(c, "ascending") for c in ("label", "a", "b")]).combine_chunks(), asked.sort_by("qid").combine_chunks()
        label, mine = code(rows["label"]), code(asked["qid"])
        names = one(one(rows["label"]).dictionary_encode().dictionary).to_pylist()
        edge = np.ones(rows.num_rows, bool)
        edge[1:] = (np.diff(label) != 0) | (np.diff(code(rows["a"])) != 0) | (np.diff(code(rows["b"])) != 0)
        column, first = np.cumsum(edge) - 1, np.flatnonzero(edge)
        flat, parent = pc.list_flatten(one(rows["terms"])), pc.list_parent_indices(one(rows["terms"])).to_numpy()
        want, by = pc.list_flatten(one(asked["terms"])), pc.list_parent_indices(one(asked["terms"])).to_numpy()
        vocabulary = pc.unique(want)
        want = pc.index_in(want, value_set=vocabulary).to_numpy(zero_copy_only=False)
        words = pc.unique(flat)
        if inside:
            w, t = _inside(words, vocabulary)
        else:
            met = pc.index_in(words, value_set=vocabulary)
            w = np.flatnonzero(pc.is_valid(met).to_numpy(zero_copy_only=False))
            t = met.take(pa.array(w)).to_numpy(zero_copy_only=False)
        order = np.argsort(w, kind="stable")
        w, t = w[order], t[order]
        start = np.searchsorted(w, np.arange(len(words) + 1))
        word = pc.index_in(flat, value_set=words).to_numpy(zero_copy_only=False)
        many = start[word + 1] - start[word]
        ends = np.cumsum(many)
        has = t[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[word] - ends + many, many)]
        where = np.repeat(column[parent], many)
        theirs = np.array(asked["label"].to_pylist(), object)[by] if labelled else None
        out = []
        for g, name in enumerate(names):
            pick = theirs == name if labelled else np.ones(len(by), bool)
            terms, keys = np.unique(want[pick], return_inverse=True)
            if not len(terms):
                continue
            queries, starts = np.unique(mine[by[pick]], return_index=True)
            row = np.full(len(vocabulary), -1)
            row[terms] = np.arange(len(terms))
            low, high = np.searchsorted(label[first], [g, g + 1])
            step = max(64, cells // len(terms) // 64 * 64)
            n, least = np.zeros(len(queries), np.int64), np.full(len(queries), -1)
            for lo in range(low, high, step):
                a, z = np.searchsorted(where, [lo, min(lo + step, high)])
                bits = np.zeros((len(terms), step), bool)
                known = row[has[a:z]] >= 0
                bits[row[has[a:z]][known], where[a:z][known] - lo] = True
                bits = np.packbits(bits, axis=1, bitorder="little").view("<u8")
                both = np.bitwise_or.reduceat(bits[keys], starts, axis=0)
                new = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
                fresh = np.flatnonzero((least < 0) & (new > 0))
                at = (both[fresh] != 0).argmax(axis=1)
                last = both[fresh, at]
                least[fresh] = lo + 64 * at + np.bitwise_count((last & (~last + np.uint64(1))) - np.uint64(1))
                n += new
            hit = np.flatnonzero(n)
            ids = asked["qid"].take(pa.array(np.searchsorted(mine, queries[hit])))
            found = rows.select(["a", "b"]).take(pa.array(first[least[hit]]))
            out.append(pa.table([one(ids), pa.array([name] * len(hit), pa.string()), pa.array(n[hit]), one(found["a"]), one(found["b"])], ["qid", "label", "n", "a", "b"]))
        kinds = [asked.schema.field("qid").type, pa.string(), pa.int64(), rows.schema.field("a").type, rows.schema.field("b").type]
        return pa.concat_tables([pa.schema(list(zip(("qid", "label", "n", "a", "b"), kinds, strict=True))).empty_table(), *out])

    return run


def any_of(rows: DataFrame, queries: DataFrame, labelled: bool = False, inside: bool = False) -> DataFrame:
    """qid, label, n, a, b: of each query and label how many different (a, b) have a term of the query, and the first of them; none without.

    rows: label, a, b, terms, all of an (a, b) in one group; queries: qid, label, terms, a qid in one row for each label. With `labelled` a
    query meets the rows of its label, with `inside` a term counts within words. A row is exchanged once for each `MANY` queries; a pair of a row and a query never is."""
    asked = materialize(queries, "asked")
    parts, blocks = parts_of(rows), max(1, math.ceil(asked.count() / MANY))
    asked = asked.withColumn("block_", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = rows.withColumn("part_", F.pmod(F.xxhash64("a", "b"), F.lit(parts)).cast("int")).withColumn("block_", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    of = {**dict(rows.dtypes), **dict(queries.select("qid").dtypes)}
    found = dealt.groupBy("block_", "part_").cogroup(asked.groupBy("block_", "part_")).applyInArrow(_any(labelled, inside), f"qid {of['qid']}, label string, n long, a {of['a']}, b {of['b']}")
    return found.groupBy("qid", "label").agg(F.sum("n").alias("n"), F.min(F.struct("a", "b")).alias("f")).select("qid", "label", "n", "f.a", "f.b")
