"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the two words before it and the two after it, never from itself, and
the conditional log-probabilities of all words are added up. The network is small and trained here,
in numpy, on all documents: an embedding for each (place, word id), added and squashed, then two
softmax layers of 32 (the word's group, and the word in its group), so that a word costs 64
exponentials instead of a whole vocabulary.

1. Words are counted over all documents; the `TOP` commonest have ids of their own, all others share
   the remaining ids by hash. That list, and so the network, has a fixed size; the counts of all
   words stay a table, and a word with a shared id has its own share of that id's count.
2. Training goes in rounds. A round takes the documents whose hash falls to it, so that every document
   is used once; each partition starts from the current parameters, runs over its documents in small
   batches and returns its parameters with the number of words seen. Spark adds them up by
   parameter, and their weighted mean (a few hundred kilobytes, whatever the corpus) starts the next.
3. A last pass scores every word of every whole text. Words with a shared id are joined to the table
   of counts, and log p(word | id) is added to the network's log p(id | context). Every scored word
   is in the counts, so that shares are never 0 and add up to 1.

Defined cases: a null or blank text has no words, log-likelihood 0 and a null mean; repeated rows are
scored each; places beyond a text's ends hold a mark of their own; an empty table gives an empty
result. Only doc_id and text are read. Scores depend on the rows and how they are partitioned, in the
last digits also on the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm import tokens as tk
from lodestone.sources.scratch import frugal, materialize

SIDE, IDS, TOP, DIM, GROUP = 2, 1024, 768, 16, 32
PLACES, EDGE = 2 * SIDE, IDS
ROUNDS, BATCH, RATE = 4, 4096, 0.1
SHAPES = {"e": (PLACES, IDS + 1, DIM), "w1": (DIM, GROUP), "b1": (GROUP,), "w2": (DIM, GROUP), "t": (IDS // GROUP, GROUP)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = (rng.standard_normal(SIZE) * 0.1).astype(np.float32)
    parts = unpack(flat)
    parts["b1"][:] = 0
    parts["t"][:] = 0
    return flat


def word_ids(words: tk.Words, top: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of a slice's words: `top` holds the known hashes, sorted, and their ids."""
    h = tk.word_hashes(words, lower=True)
    ids = (TOP + (h >> np.uint64(20)) % np.uint64(IDS - TOP)).astype(np.int32)
    if len(top[0]):
        at = np.minimum(np.searchsorted(top[0], h), len(top[0]) - 1)
        known = top[0][at] == h
        ids[known] = top[1][at[known]]
    return ids


def contexts(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The ids around each word, EDGE beyond its text."""
    out = np.full((len(ids), PLACES), EDGE, np.int32)
    for p, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        if len(ids) > abs(shift):
            to, at = (slice(-shift, None), slice(None, shift)) if shift < 0 else (slice(None, -shift), slice(shift, None))
            same = row[to] == row[at]
            out[to, p] = np.where(same, ids[at], EDGE)
    return out


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    s = e.sum(axis=1, keepdims=True)
    return e / s, z - np.log(s)


def forward(m: dict, ctx: np.ndarray, ids: np.ndarray):
    x = m["e"][0][ctx[:, 0]]
    for p in range(1, PLACES):
        x = x + m["e"][p][ctx[:, p]]
    h = np.tanh(x)
    p1, l1 = _softmax(h @ m["w1"] + m["b1"])
    p2, l2 = _softmax(h @ m["w2"] + m["t"][ids // GROUP])
    at = np.arange(len(ids))
    return h, p1, p2, l1[at, ids // GROUP] + l2[at, ids % GROUP]


def gradient(m: dict, ctx: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of the mean negative log-probability, as one vector."""
    h, g1, g2, _ = forward(m, ctx, ids)
    n, at = len(ids), np.arange(len(ids))
    g1[at, ids // GROUP] -= 1
    g2[at, ids % GROUP] -= 1
    group = np.zeros((n, IDS // GROUP), np.float32)
    group[at, ids // GROUP] = 1
    dx = (g1 @ m["w1"].T + g2 @ m["w2"].T) * (1 - h * h)
    flat = np.empty(SIZE, np.float32)
    out = unpack(flat)
    dims, weights = np.arange(DIM), dx.ravel()
    for p in range(PLACES):
        out["e"][p] = np.bincount((ctx[:, p, None] * DIM + dims).ravel(), weights, (IDS + 1) * DIM).reshape(IDS + 1, DIM)
    out["w1"][:], out["b1"][:], out["w2"][:], out["t"][:] = h.T @ g1, g1.sum(0), h.T @ g2, group.T @ g2
    return flat / n


def _train_rows(model, top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, seen = model.value.copy(), 0
        squares = np.full(SIZE, 1e-6, np.float32)
        for batch in batches:
            for _, _, words in tk.slices(batch.column("text")):
                ids = word_ids(words, top.value)
                ctx = contexts(ids, words.row)
                order = np.random.default_rng(len(ids)).permutation(len(ids))
                for lo in range(0, len(ids), BATCH):
                    take = order[lo : lo + BATCH]
                    g = gradient(unpack(flat), ctx[take], ids[take])
                    squares += g * g
                    flat -= RATE * g / np.sqrt(squares)
                seen += len(ids)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, SIZE, dtype=np.int32)), pa.array(np.concatenate([[seen], flat.astype(np.float64) * seen]))], ["i", "v"])

    return run


def _score_rows(model, top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpack(model.value)
        for batch in batches:
            for lo, hi, words in tk.slices(batch.column("text")):
                ids = word_ids(words, top.value)
                ctx = contexts(ids, words.row)
                logp = np.concatenate([forward(m, ctx[i : i + BATCH], ids[i : i + BATCH])[3] for i in range(0, len(ids), BATCH)]) if len(ids) else np.zeros(0)
                n = words.counts()
                total = np.bincount(words.row, logp, hi - lo)
                shared = np.bincount(words.row[ids >= TOP], minlength=hi - lo)
                keys = [batch.column(c).slice(lo, hi - lo).cast(pa.int64()) for c in ("doc_id", "tkey")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(n.astype(np.int64)), pa.array(shared.astype(np.int64)), pa.array(total)], ["doc_id", "tkey", "n_words", "n_shared", "network"])

    return run


def _shared_rows(top):
    """(doc_id, tkey, text) to one row a text and distinct word with a shared id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tkey"))
            for lo, _, words in tk.slices(batch.column("text")):
                rare = np.flatnonzero(word_ids(words, top.value) >= TOP)
                if len(rare):
                    h, row = tk.word_hashes(words, lower=True)[rare], words.row[rare]
                    _, at, n = np.unique(tk.tagged(h, row), return_index=True, return_counts=True)
                    where = lo + row[at]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[where]), pa.array(keys[where]), pa.array(tk.signed(h[at])), pa.array(n.astype(np.int32))], ["doc_id", "tkey", "h", "n"])

    return run


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [tk.word_hashes(words, lower=True) for _, _, words in tk.slices(batch.column("text"))]
        if found:
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(h)), pa.array(n.astype(np.int64))], ["h", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """h, n: how often each word of the corpus occurs, by hash."""
    texts = docs.select("text").where(F.col("text").isNotNull())
    return materialize(texts.mapInArrow(_count_rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")


def shares(counts: DataFrame, top) -> DataFrame:
    """h, share: log p(word | shared id) of every word without an id of its own."""
    own = counts.sparkSession.createDataFrame([(int(h),) for h in top.value[0].view(np.int64)], "h long")
    rest = counts.join(F.broadcast(own), "h", "left_anti").withColumn("bucket", F.shiftrightunsigned("h", 20) % F.lit(IDS - TOP))
    totals = rest.groupBy("bucket").agg(F.sum("n").alias("total"))
    return rest.join(F.broadcast(totals), "bucket").select("h", F.log(F.col("n") / F.col("total")).alias("share"))


def train(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS):
    """The trained parameters and the known words, both broadcast."""
    spark = docs.sparkSession
    texts = docs.select("text").where(F.col("text").isNotNull())
    known = [r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(TOP).collect()]
    hashes = np.array(known, np.int64).view(np.uint64)
    order = np.argsort(hashes)
    top = spark.sparkContext.broadcast((hashes[order], order.astype(np.int32)))
    flat = start()
    for i in range(rounds):
        model = spark.sparkContext.broadcast(flat)
        mine = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == i)
        sums = mine.mapInArrow(_train_rows(model, top), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        if sums:
            total = np.zeros(SIZE + 1)
            for r in sums:
                total[r["i"] + 1] = r["v"]
            flat = (total[1:] / total[0]).astype(np.float32)
    return spark.sparkContext.broadcast(flat), top


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over all words) and mean_logp."""
    frugal(docs.sparkSession)
    counts = word_counts(docs)
    model, top = train(docs, counts, rounds)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("tkey"), "text")
    rows = keyed.mapInArrow(_score_rows(model, top), "doc_id long, tkey long, n_words long, n_shared long, network double")
    found = keyed.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))).mapInArrow(_shared_rows(top), "doc_id long, tkey long, h long, n int")
    # a mean, so that rows that repeat a doc_id and text get the same whichever of them it was summed over
    mean = (F.sum(F.col("n") * F.col("share")) / F.sum("n")).alias("mean_share")
    within = found.join(shares(counts, top), "h").groupBy(F.col("doc_id").alias("doc_"), F.col("tkey").alias("tkey_")).agg(mean)
    met = rows.join(within, (F.coalesce("doc_id", F.lit(0)) == F.col("doc_")) & (F.col("tkey") == F.col("tkey_")), "left")
    total = F.col("network") + F.when(F.col("n_shared") > 0, F.col("n_shared") * F.col("mean_share")).otherwise(0.0)
    out = met.select("doc_id", "n_words", total.alias("log_likelihood"))
    return out.withColumn("mean_logp", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
