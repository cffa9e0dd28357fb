"""Full-text and vector retrieval for batches of queries; every operator joins a query table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.functions import codes
from lodestone.operators import blocks, scan
from lodestone.sources.scratch import materialize

K1, B = 1.2, 0.75


def vocabulary(tokens: DataFrame, least: int = 2) -> DataFrame:
    """Terms of two letters or more with the pages and places they occur at."""
    per = tokens.where(F.length("term") >= 2).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("df"))
    return per.where(F.col("n") >= least)


def match_all(tokens: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """H1: pages with every term of a query. `queries`: qid, term."""
    asked = queries.select("qid", "term").distinct()
    need = asked.groupBy("qid").agg(F.count(F.lit(1)).alias("need"))
    hits = tokens.select(key, "term").distinct().join(asked, "term").groupBy("qid", key).agg(F.count(F.lit(1)).alias("n"))
    return hits.join(need, "qid").where("n = need").select("qid", key)


def phrase(tokens: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """H1: pages with a query's terms one after the other: all have the same place less their number. `queries`: qid, i, term."""
    need = queries.groupBy("qid").agg(F.count(F.lit(1)).alias("need"))
    runs = tokens.join(queries, "term").groupBy("qid", key, (F.col("pos") - F.col("i")).alias("at")).agg(F.count_distinct("i").alias("n"))
    return runs.join(need, "qid").where("n = need").select("qid", key).distinct()


def near(tokens: DataFrame, queries: DataFrame, reach: int = 10, key: str = "doc_id") -> DataFrame:
    """H1: pages where two terms stand within `reach` words. `queries`: qid, a, b.

    Each place of b asks the window of places before and after for a, so nothing is paired."""
    asked = queries.select("qid", "a", "b").distinct()
    both = tokens.join(asked.select("qid", F.explode(F.array("a", "b")).alias("term")), "term").join(asked.select("qid", "a"), "qid")
    w = Window.partitionBy("qid", key).orderBy("pos").rangeBetween(-reach, reach)
    is_a = (F.col("term") == F.col("a")).cast("int")
    return both.withColumn("as_", F.sum(is_a).over(w)).where((F.col("term") != F.col("a")) & (F.col("as_") > 0)).select("qid", key).distinct()


def bm25_scores(tokens: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """H3: BM25 (k1 1.2, b 0.75) of every page that has a term of a query, and how many of its terms. `queries`: qid, term.

    Postings of asked terms only are joined; lengths and frequencies are aggregates."""
    sizes = tokens.groupBy(key).agg(F.count(F.lit(1)).alias("len"))
    whole = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    asked = queries.select("qid", "term").distinct()
    tf = tokens.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    met = tf.join(df, "term").join(asked, "term").join(sizes, key).join(F.broadcast(whole))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return met.groupBy("qid", key).agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("matched"))


def bm25(tokens: DataFrame, queries: DataFrame, top: int = 25, key: str = "doc_id") -> DataFrame:
    """H3: the best pages of each query by BM25. `queries`: qid, term."""
    ranked = bm25_scores(tokens, queries, key).drop("matched").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= top)


def routed(queries: DataFrame, documents: DataFrame, aliases: DataFrame, tokens: DataFrame, top: int = 25) -> DataFrame:
    """H2: each query by its route, best first: four digits to documents by the end of their stock number, a whole stock number to documents
    by it (exact) or an alias of it (alias), any other text to documents with all its terms (exact) and, where fewer than three have, with any (approximate).

    queries: qid, text; documents: doc_id, nsn; aliases: nsn, alias; tokens: doc_id, term."""
    nsn = codes.norm_nsn(F.col("text"))
    route = F.when(F.col("text").rlike(r"^\s*\d{4}\s*$"), "suffix").when(nsn.isNotNull() & F.col("text").rlike(r"^[\d\s-]+$"), "nsn").otherwise("text")
    asked = queries.select("qid", "text", route.alias("route"))
    ends = asked.where("route = 'suffix'").select("qid", F.trim("text").alias("four")).join(documents.select("doc_id", F.right("nsn", F.lit(4)).alias("four")), "four")
    own = asked.where("route = 'nsn'").select("qid", nsn.alias("nsn"), F.lit("exact").alias("mark"))
    other = own.join(aliases.where("nsn <> alias").distinct(), "nsn").select("qid", "alias", F.lit("alias"))
    by_nsn = own.union(other).join(documents.select("doc_id", "nsn"), "nsn")
    terms = asked.where("route = 'text'").select("qid", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("term"))
    need = terms.groupBy("qid").agg(F.count(F.lit(1)).alias("need"))
    hits = bm25_scores(tokens, terms).join(need, "qid").withColumn("all_", F.col("matched") == F.col("need"))
    few = F.count_if("all_").over(Window.partitionBy("qid")) < 3
    by_text = hits.withColumn("few", few).where("all_ OR few").select("qid", "doc_id", F.lit("text"), F.when(F.col("all_"), "exact").otherwise("approximate"), "score")
    none = F.lit(None).cast("double").alias("score")
    every = ends.select("qid", "doc_id", F.lit("suffix").alias("route"), F.lit("exact").alias("mark"), none).union(by_nsn.select("qid", "doc_id", F.lit("nsn"), "mark", none)).union(by_text)
    order = Window.partitionBy("qid").orderBy(F.col("mark") != "exact", F.desc_nulls_last("score"), "doc_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def fuzzy(vocab: DataFrame, words: DataFrame, cap: int = 4) -> DataFrame:
    """H5, H6: terms within one edit of a word of five letters or more, sharing its first two, commonest first. `words`: word."""
    asked = words.select("word", F.substring("word", 1, 2).alias("head")).where(F.length("word") >= 5).distinct()
    met = asked.join(vocab.withColumn("head", F.substring("term", 1, 2)), "head").where((F.abs(F.length("word") - F.length("term")) <= 1) & (F.col("word") != F.col("term")) & (F.levenshtein("word", "term") <= 1))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("df"), "term")))
    return ranked.where(F.col("rank") <= cap).select("word", "term", "df", "rank")


def find_in_documents(pages: DataFrame, asked: DataFrame, most: int = 80, around: int = 40) -> DataFrame:
    """H8: doc_id, q, page_number, n, snippet: the first `most` pages of a document that have a text, how often, without regard to case, and what stands around the first. asked: doc_id, q."""
    want = asked.select("doc_id", F.trim("q").alias("q")).where("q <> ''").distinct()
    low, what = F.lower("body_text"), F.lower("q")
    met = pages.join(want, "doc_id").where(F.contains(low, what))
    n = (F.length("body_text") - F.length(F.replace(low, what, F.lit("")))) / F.length("q")
    at = F.instr(low, what) - 1
    start = F.greatest(F.lit(0), at - around)
    said = F.trim(F.regexp_replace(F.substring("body_text", start + 1, at + F.length("q") + around - start), r"\s+", " "))
    snippet = F.concat(F.when(start > 0, "…").otherwise(""), said, F.lit("…"))
    order = Window.partitionBy("doc_id", "q").orderBy("page_number")
    return met.select("doc_id", "q", "page_number", n.cast("long").alias("n"), snippet.alias("snippet"), F.row_number().over(order).alias("place")).where(F.col("place") <= most).drop("place")


def inverted_name(c):
    """H9: 'BOLT, HEX' and 'HEX BOLT' to one form."""
    return F.upper(F.array_join(F.transform(F.reverse(F.split(c, ",")), lambda x: F.trim(x)), " "))


def parse_operators(queries: DataFrame) -> DataFrame:
    """Tm:, nsn:, vehicle: and side: out of a query text; the last of each wins, the rest is free text. `queries`: qid, text."""
    pattern = r'(?i)\b(tm|nsn|vehicle|side):("[^"]*"|\S+)'
    last = lambda k: F.element_at(F.regexp_extract_all("text", F.lit(rf'(?i)\b{k}:("[^"]*"|\S+)'), F.lit(1)), -1)
    value = lambda k: F.when(F.size(F.regexp_extract_all("text", F.lit(rf"(?i)\b{k}:\S"), F.lit(0))) > 0, F.replace(last(k), F.lit('"'), F.lit("")))
    free = F.trim(F.regexp_replace(F.regexp_replace("text", pattern, " "), r"\s+", " "))
    return queries.select("qid", *[value(k).alias(k) for k in ("tm", "nsn", "vehicle", "side")], free.alias("free"))


def hashed_vectors(tokens: DataFrame, key: str = "doc_id", dim: int = 384) -> DataFrame:
    """Sparse vectors: words of two letters or more by crc32 modulo dim, counted and scaled to length 1."""
    bucket = (F.crc32(F.col("term").cast("binary")) % dim).cast("int")
    counts = tokens.where(F.length("term") >= 2).groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / norm).alias("w"))


def fuse(first: DataFrame, second: DataFrame, k: int = 60, key: str = "doc_id") -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (qid, key, rank)."""
    both = first.select("qid", key, "rank", F.lit("a").alias("signal")).unionByName(second.select("qid", key, "rank", F.lit("b").alias("signal")))
    return both.groupBy("qid", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("signal")), "+").alias("signals"))


def hybrid(tokens: DataFrame, queries: DataFrame, top: int = 25, key: str = "doc_id") -> DataFrame:
    """The best pages of each query by keywords (BM25) and by hashed vectors, fused by their ranks. queries: qid, term, a row for each word."""
    counts = tokens.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return _hybrid(counts.groupBy(key).agg(F.sum("tf").alias("len"), F.collect_list(F.struct("term", "tf")).alias("c")).where(F.col(key).isNotNull()), queries, top, key)


def hybrid_texts(docs: DataFrame, queries: DataFrame, top: int = 25, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of hybrid() from whole texts, whose words are counted in their row. A row is a page: keys are taken to be unique."""
    return _hybrid(scan.counted(docs.where(F.col(key).isNotNull()), [key], text), queries, top, key)


def _hybrid(counted: DataFrame, queries: DataFrame, top: int, key: str) -> DataFrame:
    """Pages meet queries in groups as matrices, and of each group the first are exchanged; counted: key, len, c."""
    post, asked = materialize(counted, "counted"), materialize(queries.select("qid", "term").where("qid IS NOT NULL AND term IS NOT NULL"), "asked")
    parts = blocks.parts_of(counted)
    words = blocks.bm25_counted(post, asked, top, [key], parts).select("qid", key, "rank")
    sense = blocks.hashed_top(post, asked, top, key, parts).select("qid", key, "rank")
    both = fuse(words, sense, key=key).withColumn("qid", F.col("qid").cast(dict(queries.dtypes)["qid"]))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))).where(F.col("rank") <= top)


def answers(pages: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """The sentences that cover most of a question's terms. `queries`: qid, term; pages: doc_id, body_text."""
    sentences = pages.select("doc_id", F.explode(F.split("body_text", r"(?<=[.!?])\s+")).alias("sentence")).where(F.length("sentence") > 12)
    terms = sentences.select("doc_id", "sentence", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("sentence"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("term"), F.regexp_count("sentence", F.lit(r"\S+")).alias("n"))
    asked = queries.distinct()
    need = asked.groupBy("qid").agg(F.count(F.lit(1)).alias("need"))
    hits = terms.join(asked, "term").groupBy("qid", "doc_id", "sentence", "n").agg(F.count(F.lit(1)).alias("hits")).join(need, "qid")
    score = F.round(2 * F.col("hits") / F.col("need") + F.col("hits") / F.col("n"), 6)
    once = hits.withColumn("score", score).groupBy("qid", "sentence").agg(F.max("score").alias("score"), F.min("doc_id").alias("doc_id"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "sentence")))
    return ranked.where(F.col("rank") <= top)
