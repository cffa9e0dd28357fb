"""Kept postings: an inverted index as bucketed tables, and searches that join it without exchanging it.

`build` writes two tables once: postings (term, part, key..., tf, len, pos), bucketed by term and part and sorted by
term, and terms (term, df, tf, most, least), a row for each run. `part` deals a common term's postings over
`PARTS` buckets. New pages are appended as a further run, without touching what is there. A batch of
queries exchanges its own terms only.

Statistics (pages, their mean length, a term's pages) are sums over the runs and so always those of all
pages. A term's upper bound is computed from its largest count and its shortest page, which hold whatever
is appended.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestone.operators.graph import ensure_checkpoint_dir
from lodestone.sources.scratch import SMALL, materialize

K1, B = 1.2, 0.75
#: Buckets of the tables, and parts that a term's postings are dealt over.
BUCKETS, PARTS = 16, 4
WORD = r"[\p{L}\p{N}]+"


class Postings(NamedTuple):
    key: list[str]
    postings: DataFrame
    terms: DataFrame
    name: str
    folder: str

    def dictionary(self) -> DataFrame:
        """term, df, tf, most, least over all runs."""
        return self.terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"), F.max("most").alias("most"), F.min("least").alias("least"))

    def whole(self) -> DataFrame:
        """One row: n pages with a term, and their mean length. Kept with the terms, under the empty term."""
        return self.terms.where("term = ''").agg(F.sum("df").alias("n"), (F.sum("tf") / F.sum("df")).alias("avg"))


def _run(tokens: DataFrame, key: list[str]) -> DataFrame:
    """term, key, tf, len, pos of each page's terms. A page's words are counted where they come together."""
    per = tokens.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("pos"))
    return per.withColumn("len", F.sum("tf").over(Window.partitionBy(*key))).withColumn("part", F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int"))


def _write(rows: DataFrame, key: list[str], name: str, folder: str, buckets: int, mode: str) -> None:
    made = rows.select("term", "part", *key, "tf", "len", "pos").repartition(buckets, "term", "part")
    made.write.mode(mode).bucketBy(buckets, "term", "part").sortBy("term").option("path", f"{folder}/postings").saveAsTable(f"postings_{name}")


def _write_terms(spark: SparkSession, run: DataFrame, key: list[str], name: str, folder: str, mode: str) -> None:
    per = run.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"), F.max("tf").alias("most"), F.min("len").alias("least"))
    sizes = run.select(*key, "len").distinct().agg(F.lit("").alias("term"), F.count(F.lit(1)).alias("df"), F.coalesce(F.sum("len"), F.lit(0)).alias("tf"), F.max("len").alias("most"), F.min("len").alias("least"))
    per.union(sizes).write.mode(mode).parquet(f"{folder}/terms")


def build(tokens: DataFrame, key: list[str] | None = None, buckets: int = BUCKETS) -> Postings:
    """The index of tokens (key..., pos, term), in the session's shared folder. Pages without a term aren't in it."""
    spark, key, name = tokens.sparkSession, key or ["doc_id"], uuid.uuid4().hex
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/index-{name}"
    _write(_run(tokens, key), key, name, folder, buckets, "overwrite")
    kept = spark.table(f"postings_{name}")
    _write_terms(spark, kept, key, name, folder, "overwrite")
    return Postings(key, kept, spark.read.parquet(f"{folder}/terms"), name, folder)


def build_texts(docs: DataFrame, key: list[str] | None = None, text: str = "text", buckets: int = BUCKETS) -> Postings:
    """As build(), from whole texts, for searches that need no places (`pos` is null): words are counted in their row, and the postings
    are exchanged once, into their buckets. A row is a document."""
    from lodestone.operators.scan import counted  # it uses parsed() of this module

    spark, key, name = docs.sparkSession, key or ["doc_id"], uuid.uuid4().hex
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/index-{name}"
    run = counted(docs, key, text).select(*key, "len", F.inline_outer("c")).withColumn("part", F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int"))
    _write(run.withColumn("pos", F.lit(None).cast("array<int>")), key, name, folder, buckets, "overwrite")
    kept = spark.table(f"postings_{name}")
    _write_terms(spark, kept, key, name, folder, "overwrite")
    return Postings(key, kept, spark.read.parquet(f"{folder}/terms"), name, folder)


def append(index: Postings, tokens: DataFrame) -> Postings:
    """The index with the pages of tokens as a further run. Pages that it holds already are left out."""
    spark = tokens.sparkSession
    held = index.postings.select(*index.key).distinct()
    run = _run(tokens.join(held, index.key, "left_anti"), index.key)
    folder = f"{index.folder}/run-{uuid.uuid4().hex}"
    run.write.parquet(folder)
    run = spark.read.parquet(folder)
    buckets = int(spark.sql(f"DESCRIBE FORMATTED postings_{index.name}").where("col_name = 'Num Buckets'").first()[1])
    _write(run, index.key, index.name, index.folder, buckets, "append")
    _write_terms(spark, run, index.key, index.name, index.folder, "append")
    spark.catalog.refreshTable(f"postings_{index.name}")
    return index._replace(postings=spark.table(f"postings_{index.name}"), terms=spark.read.parquet(f"{index.folder}/terms"))


_kept: dict[tuple, Postings] = {}


def kept(spark: SparkSession, name: tuple, make) -> Postings:
    """The index of that name of this application, built on first use by make()."""
    at = (spark.sparkContext.applicationId, *name)
    if at not in _kept:
        _kept[at] = build(*make())
    return _kept[at]


def kept_texts(spark: SparkSession, name: tuple, docs) -> Postings:
    """As kept(), from the whole texts that docs() gives, without places."""
    at = (spark.sparkContext.applicationId, "texts", *name)
    if at not in _kept:
        _kept[at] = build_texts(docs())
    return _kept[at]


def _asked(index: Postings, queries: DataFrame) -> DataFrame:
    """queries with `part`, a row for each part of the postings: what is exchanged is the queries."""
    return queries.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(PARTS)])))


def _share(n: Column, avg: Column, df: Column, tf: Column, length: Column) -> Column:
    """BM25 (k1 1.2, b 0.75) of a term in a page."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))


def _weighted(index: Postings, queries: DataFrame) -> DataFrame:
    """qid, term, df, n, avg and bound, the most that the term adds to any page. queries: qid, term."""
    asked = queries.select("qid", "term").distinct()
    met = asked.join(index.dictionary().where("term <> ''"), "term").join(F.broadcast(index.whole()))
    bound = _share(F.col("n"), F.col("avg"), F.col("df"), F.col("most"), F.col("least")) + 1e-9
    return met.select("qid", "term", "df", "n", "avg", bound.alias("bound"))


def scores(index: Postings, asked: DataFrame) -> DataFrame:
    """qid, key, score, matched of all pages that have a term of a query. asked: _weighted()."""
    met = index.postings.join(_asked(index, asked), ["term", "part"])
    part = _share(F.col("n"), F.col("avg"), F.col("df"), F.col("tf"), F.col("len"))
    return met.groupBy("qid", *index.key).agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("matched"))


def _ranked(found: DataFrame, key: list[str], top: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def best(index: Postings, queries: DataFrame, top: int = 25) -> DataFrame:
    """H3: qid, key, score, rank: the best pages of each query by BM25, from all pages with a term of it."""
    return _ranked(scores(index, _weighted(index, queries)).drop("matched"), index.key, top)


def essential_terms(index: Postings, queries: DataFrame, top: int) -> DataFrame:
    """_weighted() with `must`: whether a page needs one of these terms to be among the best `top`.

    The terms of the highest bounds, as many as it takes for `top` pages, are scored by themselves: the top-th best is a
    score that the answer's last page has at least. Terms of the lowest bounds, as long as their sum is below it,
    can't bring a page there alone."""
    asked = _weighted(index, queries)
    down = Window.partitionBy("qid").orderBy(F.desc("bound"), "term")
    first = asked.withColumn("before", F.coalesce(F.sum("df").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < top).drop("before")
    floor = _ranked(scores(index, first), index.key, top).groupBy("qid").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("held"))
    up = Window.partitionBy("qid").orderBy("bound", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    met = asked.join(floor, "qid", "left").withColumn("upto", F.sum("bound").over(up))
    # the floor is rounded, and so is what it is held against
    least = F.when(F.col("held") >= top, F.col("floor") - 1e-6)
    return met.withColumn("floor", F.coalesce(least, F.lit(0.0))).withColumn("must", F.col("upto") >= F.col("floor")).drop("held", "upto")


def best_bounded(index: Postings, queries: DataFrame, top: int = 25) -> DataFrame:
    """The rows of best(), without scoring every page that has a common term.

    Pages are candidates by their essential terms; those that can't reach the floor with all of the other terms' bounds go.
    The other terms are then looked up for the pages that are left, page by page."""
    asked = essential_terms(index, queries, top)
    must, other = asked.where("must"), asked.where(~F.col("must"))
    rest = other.groupBy("qid").agg(F.sum("bound").alias("rest"))
    part = _share(F.col("n"), F.col("avg"), F.col("df"), F.col("tf"), F.col("len"))
    first = index.postings.join(_asked(index, must), ["term", "part"]).groupBy("qid", *index.key, "part").agg(F.sum(part).alias("s"), F.first("floor").alias("floor"))
    left = first.join(rest, "qid", "left").where(F.col("s") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor"))
    # a page that can be among the best is no worse than the top-th by what is sure, either
    sure = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s")))
    line = left.withColumn("place", sure).where(F.col("place") <= top).groupBy("qid").agg(F.min("s").alias("line"), F.count(F.lit(1)).alias("held")).where(F.col("held") == top).drop("held")
    left = left.join(line, "qid", "left").where(F.col("s") + F.coalesce("rest", F.lit(0.0)) >= F.coalesce("line", F.lit(0.0)) - 1e-6).select("qid", *index.key, "part", "s")
    looked = left.select("qid", *index.key, "part").join(other.select("qid", "term", "df", "n", "avg"), "qid")
    more = index.postings.select("term", "part", *index.key, "tf", "len").join(looked, ["term", "part", *index.key]).select("qid", *index.key, part.alias("s"))
    total = left.select("qid", *index.key, "s").union(more).groupBy("qid", *index.key).agg(F.round(F.sum("s"), 6).alias("score"))
    return _ranked(total, index.key, top)


# prefixes


def with_prefixes(index: Postings, prefixes: DataFrame) -> DataFrame:
    """prefix, term, df, tf of all terms that begin with a prefix. A term gives a row for each length that is asked, joined by equality."""
    asked = prefixes.select("prefix").distinct()
    lengths = asked.select(F.length("prefix").alias("k")).distinct()
    cut = index.dictionary().where("term <> ''").join(F.broadcast(lengths), F.length("term") >= F.col("k")).withColumn("prefix", F.expr("left(term, k)"))
    return asked.join(cut, "prefix").select("prefix", "term", "df", "tf")


def prefix_table(words: DataFrame, top: int = 8, longest: int = 12, asked: DataFrame | None = None) -> DataFrame:
    """prefix, word, kind, freq, rank: the commonest words of each prefix of two letters to `longest`, rolled up once for all prefixes,
    or for those that begin a prefix of `asked`.

    words: word, kind, freq. Each prefix keeps `top` of a kind; window limits are applied before the exchange."""
    cut = words.where(F.length("word") >= 2).select("word", "kind", "freq", F.explode(F.sequence(F.lit(2), F.least(F.length("word"), F.lit(longest)))).alias("k")).withColumn("prefix", F.lower(F.expr("left(word, k)")))
    if asked is not None:
        known = materialize(asked.select(F.lower(F.left("prefix", F.lit(longest))).alias("prefix")).distinct(), "prefixes")
        # a prefix of other words goes no further than where its word lies, while those asked are few
        cut = cut.join(F.broadcast(known) if known.count() <= SMALL else known, "prefix", "left_semi")
    order = Window.partitionBy("prefix", "kind").orderBy(F.desc("freq"), "word")
    return cut.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("prefix", "word", "kind", "freq", "rank")


# The order of kinds of suggestions.
KINDS = ("vehicle", "part", "term", "nsn")


def suggest(table: DataFrame, asked: DataFrame, top: int = 8, longest: int = 12) -> DataFrame:
    """H7: prefix, word, kind, rank: suggestions by kind, then by frequency, each word once whatever its case. table: prefix_table(); asked: prefix, two letters or more.

    A prefix longer than the table's is looked up by its beginning, and the words are held against all of it."""
    want = asked.where(F.length("prefix") >= 2).select("prefix").distinct().select(F.lower("prefix").alias("whole"), F.lower(F.left("prefix", F.lit(longest))).alias("prefix"))
    met = want.join(table, "prefix").where(F.startswith(F.lower("word"), F.col("whole")))
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    once = met.groupBy("whole", F.lower("word").alias("w")).agg(F.min(F.struct(kind.alias("k"), "rank", "word", "kind")).alias("b"))
    order = Window.partitionBy("whole").orderBy("b.k", "b.rank", "b.word")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(F.col("whole").alias("prefix"), "b.word", "b.kind", "rank")


# boolean queries


def parsed(queries: DataFrame, most: int = 6) -> DataFrame:
    """H1: qid, and what a text asks: `groups` (its words outside quotes, the first `most`, the last of which is a prefix), `phrases` (quoted,
    two at most) and `codes` (words joined by hyphens, two at most). queries: qid, text."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    quoted = F.slice(F.regexp_extract_all("text", F.lit('"([^"]{2,80})"'), F.lit(1)), 1, 2)
    rest = F.regexp_replace("text", '"[^"]*"?', " ")
    codes = F.slice(F.regexp_extract_all(rest, F.lit(rf"{WORD}(?:-{WORD})+"), F.lit(0)), 1, 2)
    filled = lambda c: F.filter(F.transform(c, words), lambda w: F.size(w) > 0)
    return queries.select("qid", F.slice(words(rest), 1, most).alias("groups"), filled(quoted).alias("phrases"), filled(codes).alias("codes"))


def _phrase_hits(index: Postings, asked: DataFrame) -> DataFrame:
    """qid, kind, g, key: pages that have a phrase's words one after the other. asked: qid, kind, g, words."""
    need = F.size("words").alias("need")
    terms = asked.select("qid", "kind", "g", need, F.posexplode("words").alias("i", "term"))
    at = index.postings.join(_asked(index, terms), ["term", "part"]).select("qid", "kind", "g", "need", "i", *index.key, F.explode("pos").alias("pos"))
    runs = at.groupBy("qid", "kind", "g", "need", *index.key, (F.col("pos") - F.col("i")).alias("at")).agg(F.count_distinct("i").alias("n"))
    return runs.where("n = need").select("qid", "kind", "g", *index.key).distinct()


def match(index: Postings, queries: DataFrame, alternatives: DataFrame | None = None, any_: bool = False, most: int = 6) -> DataFrame:
    """H1: qid and key of the pages that match: every word (the last as a prefix), every quoted phrase, and one of the hyphenated codes as a phrase, where
    there are such; or with `any_` one word or quoted phrase. queries: qid, text; alternatives: word, alternative, other terms that stand for a word."""
    asked = parsed(queries, most)
    each = asked.select("qid", F.size("groups").alias("n"), F.posexplode("groups").alias("g", "word"))
    ends = each.where("g = n - 1").select("qid", "g", F.col("word").alias("prefix"))
    begun = ends.join(with_prefixes(index, ends), "prefix").select("qid", "g", "term")
    terms = each.select("qid", "g", F.col("word").alias("term")).union(begun)
    if alternatives is not None:
        terms = terms.union(each.join(alternatives, "word").select("qid", "g", "alternative"))
    single = index.postings.join(_asked(index, terms.distinct()), ["term", "part"]).select("qid", F.lit("word").alias("kind"), "g", *index.key)
    phrases = asked.select("qid", F.lit("phrase").alias("kind"), F.posexplode("phrases").alias("g", "words")).union(asked.select("qid", F.lit("code"), F.posexplode("codes").alias("g", "words")))
    hits = single.union(_phrase_hits(index, phrases))
    n = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("g"))).alias(f"n_{kind}")
    per = hits.groupBy("qid", *index.key).agg(n("word"), n("phrase"), n("code"))
    need = asked.select("qid", F.size("groups").alias("words"), F.size("phrases").alias("phrases"), F.size("codes").alias("codes"))
    met = per.join(need, "qid")
    if any_:
        return met.where("n_word > 0 OR n_phrase > 0").select("qid", *index.key)
    return met.where("n_word = words AND n_phrase = phrases AND (codes = 0 OR n_code > 0)").select("qid", *index.key)


# substrings


def _grams(text: Column, k: int = 3) -> Column:
    """The different pieces of a text of k characters, and the shorter ones of one and two for short questions."""
    piece = lambda n: f"transform(sequence(1, greatest(length(t) - {n} + 1, 1)), i -> substr(t, i, {n}))"
    return F.expr(f"array_distinct(filter(concat({', '.join(piece(n) for n in range(1, k + 1))}), x -> x <> ''))")


def gram_table(names: DataFrame, k: int = 3) -> DataFrame:
    """gram, name: each name (distinct, lower case) under its pieces of one to k characters. names: name."""
    known = names.select(F.lower("name").alias("t")).where("t <> ''").distinct()
    return known.select(F.col("t").alias("name"), F.explode(_grams(F.col("t"), k)).alias("gram"))


def containing(table: DataFrame, asked: DataFrame, k: int = 3) -> DataFrame:
    """q, name: the names that contain a question anywhere, without regard to case. table: gram_table(); asked: q.

    The rarest piece of a question picks the candidates, and `contains` decides; a piece that no name has rules the question out."""
    want = asked.select(F.lower("q").alias("t")).where("t <> ''").distinct()
    pieces = F.expr(f"transform(sequence(1, greatest(length(t) - {k} + 1, 1)), i -> substr(t, i, {k}))")
    cut = want.select(F.col("t").alias("q"), F.explode(F.array_distinct(pieces)).alias("gram"))
    sizes = table.join(cut.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = cut.join(sizes, "gram", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("q", "r.gram")
    return rarest.join(table, "gram").where(F.contains("name", "q")).select("q", "name")
