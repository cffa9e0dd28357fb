"""Toxicity by weak supervision.

1. A bounded sample of labelled rows (`SAMPLE`, one row for each of the doc_ids with the smallest hash) gives each
   word and word beginning (of 3 to 9 bytes: stems differ in length) its log odds between toxic and other texts. The best `FEATURES` are kept.
2. Sixteen voters look at every document: ten lexicons dealt from the best features, and six patterns
   (how many different hits, and how dense). A vote is yes or nothing.
3. A generative label model is fitted by expectation maximisation to the votes of all documents: the
   rate at which each voter votes on toxic and on other texts, and the share of toxic ones. There are
   2^16 vote patterns at most, so the counts that it needs have a fixed size. The labelled sample
   is its starting point and stays in as evidence. From the posteriors follow, for each class, the
   correlations of voters beyond it; a voter's evidence is divided by what it shares with the others.
4. In the sample the label is one more voter, whose rates are estimated from its agreement with the
   posterior. A logistic regression over the features is trained on the posteriors that follow and
   scores every whole text.

Labels are only read for rows outside the held-out fold; labels, lang, source and doc_id are never
inputs of a score. Defined cases: null and empty texts are scored from the intercept and the absence
of votes; where no feature tells the classes apart every score is 0; several labels for one doc_id count as the highest; null labels are ignored; without any
usable label every score is 0; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm import tokens as tk
from lodestone.sources.scratch import frugal, materialize

SAMPLE, FEATURES, LEAST_Z, LEXICON, LEXICONS, VOTERS = 12_000, 1024, 4.0, 240, 10, 16
BEGINNINGS = range(3, 10)
#: Bytes that part words here: every ASCII byte but letters and digits.
_PART = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _cut(column: pa.Array) -> Iterator[tuple[int, int, tk.Words]]:
    at, data = tk.column_bytes(column)
    for lo, hi, words in tk.slices(column):
        part = np.where(_PART[words.data], np.uint8(32), words.data)
        yield lo, hi, tk.split(part, at[lo : hi + 1] - at[lo])


def features(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and of its beginnings."""
    rows, found = [words.row], [tk.word_hashes(words, lower=True)]
    data = tk.LOWER[words.data]
    for n in BEGINNINGS:
        longer = np.flatnonzero(words.end - words.start > n)
        rows.append(words.row[longer])
        found.append(tk.mix(tk.runs_hash(data, words.start[longer], words.start[longer] + n, tk.BYTES) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(found)


def counts(words: tk.Words, chosen: np.ndarray) -> np.ndarray:
    """rows x features: how often each chosen feature (sorted hashes) occurs."""
    row, h = features(words)
    at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
    hit = chosen[at] == h
    return np.bincount(row[hit] * len(chosen) + at[hit], minlength=words.rows * len(chosen)).reshape(words.rows, len(chosen)).astype(np.float32)


def votes(x: np.ndarray, n: np.ndarray, voter: np.ndarray) -> np.ndarray:
    """rows x VOTERS. `voter` has for each feature its lexicon, or -1."""
    out = np.zeros((len(x), VOTERS), bool)
    for j in range(LEXICONS):
        out[:, j] = x[:, voter == j].any(axis=1)
    lexical = x[:, voter >= 0]
    different, all_hits, size = (lexical > 0).sum(axis=1), lexical.sum(axis=1), np.maximum(n, 1)
    out[:, 10], out[:, 11], out[:, 12] = different >= 3, different >= 8, different >= 16
    out[:, 13], out[:, 14], out[:, 15] = all_hits / size > 0.01, all_hits / size > 0.05, all_hits / size > 0.2
    return out


def _pattern(v: np.ndarray) -> np.ndarray:
    return (v * (1 << np.arange(VOTERS))).sum(axis=1).astype(np.int32)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to each text's distinct features."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for lo, _, words in _cut(batch.column("text")):
            row, h = features(words)
            _, keep = np.unique(tk.tagged(h, row), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(h[keep])), pa.array(toxic[lo + row[keep]].astype(np.int64))], ["h", "toxic"])


def _sample_rows(chosen, voter):
    """(toxic, text) to the votes and the features that occur, for the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in _cut(batch.column("text")):
                x, n = counts(words, chosen.value), words.counts()
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(lo, hi - lo).cast(pa.int32()), pa.array(_pattern(votes(x, n, voter.value))), pa.array(n.astype(np.int64)), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(x, at, strict=True)], pa.list_(pa.float32()))],
                    ["toxic", "pattern", "n", "at", "count"],
                )

    return run


def _vote_rows(chosen, voter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in _cut(batch.column("text")):
                x = counts(words, chosen.value)
                pattern, n = np.unique(_pattern(votes(x, words.counts(), voter.value)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n.astype(np.int64))], ["pattern", "n"])

    return run


def shape(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The classifier's inputs: how often each feature occurs, damped, and how dense all of them are."""
    return np.column_stack([np.log1p(x), np.log1p(100 * x.sum(axis=1) / np.maximum(n, 20))]).astype(np.float32)


def _score_rows(chosen, voter, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, evidence, offset = model.value
        for batch in batches:
            for lo, hi, words in _cut(batch.column("text")):
                x, n = counts(words, chosen.value), words.counts()
                v = votes(x, n, voter.value)
                z = shape(x, n) @ w[:-1] + w[-1] * np.clip(v @ evidence + offset, -8, 8) + b
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(1 / (1 + np.exp(-z.astype(np.float64))))], ["doc_id", "score"])

    return run


def label_model(patterns: np.ndarray, n: np.ndarray, known: np.ndarray, toxic: np.ndarray, rounds: int = 30):
    """Accuracies and correlations of the voters.

    Returns (evidence of a yes over nothing, offset): log odds of toxic = votes @ evidence + offset.
    patterns, n: vote patterns of all documents and their counts; known, toxic: the labelled sample's."""
    bits = (patterns[:, None] >> np.arange(VOTERS)) & 1
    mine = (known[:, None] >> np.arange(VOTERS)) & 1
    base = np.stack([(mine[toxic == c].sum(0) + 0.5) / ((toxic == c).sum() + 1.0) for c in (0, 1)])
    share = np.array([(toxic == c).mean() for c in (0, 1)]).clip(0.01, 0.99)
    rate, prior, q = base, share, np.zeros((len(n), 2))
    for _ in range(rounds):
        ll = np.log(prior)[None] + bits @ np.log(rate).T + (1 - bits) @ np.log1p(-rate).T
        q = np.exp(ll - ll.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        mass = q * n[:, None]
        # the labelled sample counts like as many documents
        strength = n.sum()
        rate = np.stack([(mass[:, c] @ bits + strength * share[c] * base[c]) / (mass[:, c].sum() + strength * share[c]) for c in (0, 1)]).clip(1e-4, 1 - 1e-4)
        prior = (mass.sum(0) / mass.sum() + share) / 2
    shared = np.ones(VOTERS)
    for c in (0, 1):
        w = q[:, c] * n
        mean = w @ bits / max(w.sum(), 1e-9)
        cov = (bits * w[:, None]).T @ bits / max(w.sum(), 1e-9) - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        rho = np.abs(cov / np.outer(sd, sd)) * (1 - np.eye(VOTERS))
        shared = np.maximum(shared, 1 + np.where(rho > 0.1, rho, 0).sum(1))
    yes, no = np.log(rate[1] / rate[0]) / shared, np.log((1 - rate[1]) / (1 - rate[0])) / shared
    return yes - no, float(np.log(prior[1] / prior[0]) + no.sum())


def with_label(odds: np.ndarray, toxic: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Posteriors of the sample with its label as one more voter, whose two rates are estimated from its agreement with the posterior."""
    q = 1 / (1 + np.exp(-odds))
    for _ in range(rounds):
        yes, no = (q[toxic == 1].sum() + 1) / (q.sum() + 2), ((1 - q)[toxic == 1].sum() + 1) / ((1 - q).sum() + 2)
        q = 1 / (1 + np.exp(-(odds + np.where(toxic == 1, np.log(yes / no), np.log((1 - yes) / (1 - no))))))
    return q


def fit(x: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        g = 1 / (1 + np.exp(-(x @ w + b))) - target
        grad = np.append(x.T @ g / len(x) + decay * w, g.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return w, b


def deviance(a: Column, n: Column, toxic: float, rows: float) -> Column:
    """Likelihood ratio statistic (the square of a standard score) of a word in n of `rows` texts, a of them among the `toxic` ones."""

    def part(seen: Column, of: Column, share: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (of * share))).otherwise(0.0)

    p, q = toxic / rows, 1 - toxic / rows
    return 2 * (part(a, n, p) + part(n - a, n, q) + part(toxic - a, rows - n, p) + part(rows - toxic - n + a, rows - n, q))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Broadcast (features, their voters, model), or None without labels of both kinds."""
    spark = docs.sparkSession
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 2))
    chosen_rows = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen_rows.withColumnRenamed("doc_id", "id_")), F.col("doc_id") == F.col("id_"))
    # of a repeated doc_id the text with the smallest digest, however the rows lie; written once, as it is read three times
    known = materialize(met.groupBy("id_").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.sha2("text", 256), "text")).alias("text")).select("toxic", "text"), "labelled")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not size["t"] or size["t"] == size["n"]:
        return None
    t, f = float(size["t"]), float(size["n"] - size["t"])
    df = known.mapInArrow(_feature_rows, "h long, toxic long").groupBy("h").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    a, c = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    odds, error = F.log(a / (t + 1 - a)) - F.log(c / (f + 1 - c)), F.sqrt(1 / a + 1 / c)
    # kept by the likelihood ratio, as the error of odds says little where no other text has the word; best first by the lower end of the odds' confidence interval
    ranked = df.where(F.col("n") < t + f).select("h", odds.alias("odds"), error.alias("error"), deviance(F.col("a"), F.col("n"), t, t + f).alias("g")).where((F.col("odds") > 0) & (F.col("g") > LEAST_Z**2))
    best = [r["h"] for r in ranked.orderBy(F.desc(F.col("odds") - 1.64 * F.col("error")), "h").limit(FEATURES).collect()]
    hashes = np.array(best, np.int64).view(np.uint64)
    if not best:
        return None
    order = np.argsort(hashes)
    lexicon = np.where(order < LEXICON, order % LEXICONS, -1)  # order holds each feature's rank
    chosen, voter = spark.sparkContext.broadcast(hashes[order]), spark.sparkContext.broadcast(lexicon)

    rows = known.mapInArrow(_sample_rows(chosen, voter), "toxic int, pattern int, n long, at array<int>, count array<float>").collect()
    rows.sort(key=lambda r: (r["pattern"], r["n"], r["toxic"], list(r["at"]), list(r["count"])))  # sums don't depend on where rows lie
    toxic, pattern, n = (np.array([r[i] for r in rows]) for i in range(3))
    x = np.zeros((len(rows), len(hashes)), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["count"]
    voted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_vote_rows(chosen, voter), "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    evidence, offset = label_model(np.array([r["pattern"] for r in voted]), np.array([float(r["n"]) for r in voted]), pattern, toxic)
    odds = np.clip(((pattern[:, None] >> np.arange(VOTERS)) & 1) @ evidence + offset, -8, 8)
    target = with_label(odds, toxic)
    w, b = fit(np.column_stack([shape(x, n), odds.astype(np.float32)]), target)
    return chosen, voter, spark.sparkContext.broadcast((w, b, evidence.astype(np.float32), offset))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    frugal(docs.sparkSession)
    known = train(docs, labels, sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scored = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score")) if known is None else texts.mapInArrow(_score_rows(*known), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
