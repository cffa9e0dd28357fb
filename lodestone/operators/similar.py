"""Similar sets: links between classes of equal sets whose Jaccard similarity reaches a bound, enough to connect each group.

If two sets have a similarity of t or more, then under any one order of all tokens the first
n - ceil(t n) + 1 tokens of each share at least one. Two orders are used, and candidates must share a
token under both: rarest first, by the number of classes that have a token, with a bound on what can
follow the place of a common token; and by hash. Tokens that no other class has come first under both.

Links are only needed until each group is connected. Each token's group is first tried as a star around
its most central class (the one whose tokens most others have); then the classes of groups that the
stars left in several components are tried with those of other components that fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.operators.graph import connected_components
from lodestone.sources.scratch import discard, materialize


def _enough(most: Column, n: Column, m: Column, percent: int) -> Column:
    """An intersection of `most` is enough for sets of n and m shingles."""
    return (100 + percent) * most >= percent * (n + m)


def _fit(a: str, b: str, percent: int) -> Column:
    """Two classes can be similar if their first common shingle is at these places. a, b: prefixes of n and place."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & _enough(F.least(n - F.col(f"{a}place"), m - F.col(f"{b}place")), n, m, percent)


def _part(df: DataFrame) -> DataFrame:
    """A second join key, so that a join doesn't reuse an aggregate's exchange and a hot shingle can be split."""
    return df.withColumn("part", F.shiftrightunsigned("token", 63))


def _candidate_sets(sets: DataFrame, percent: int) -> DataFrame:
    """class, n, alone, tokens, prefix, second, score: the classes that enough of whose tokens others have.

    `tokens` are those that other classes have, `prefix` those of the first order's prefix with their counts, and
    `second` those of the second's; `alone` counts the tokens that no other class has."""
    rows = sets.select("class", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    common = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = _part(rows).join(_part(common), ["token", "part"]).groupBy("class").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "token"))).alias("t"))
    met = met.where(100 * F.size("t").cast("long") >= percent * F.col("n"))
    # shingles of no other class come first under both orders, and can't be shared
    alone = F.col("n") - F.size("t")
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1 - alone).cast("int")
    by_hash = F.transform(F.array_sort(F.transform("t", lambda x: F.struct(F.xxhash64(x["token"]).alias("h"), x["token"].alias("token")))), lambda x: x["token"])
    score = F.aggregate("t", F.lit(0.0), lambda s, x: s + F.log2(x["c"])) / F.col("n")
    out = met.select("class", "n", alone.alias("alone"), F.transform("t", lambda x: x["token"]).alias("tokens"), F.slice("t", F.lit(1), length).alias("prefix"), F.slice(by_hash, F.lit(1), length).alias("second"), score.alias("score"))
    return materialize(out, "candidates")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that share a shingle of the second order's prefixes and are similar."""
    side = lambda x: sets.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"), F.col("second").alias(f"p_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("p_a", "p_b"))
    met = met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("t_a", "t_b")).cast("long").alias("both"))
    return materialize(met.where(_enough(F.col("both"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b"), "links")


def similar_links(given: DataFrame, percent: int) -> DataFrame:
    """(class, tokens) with distinct classes and distinct tokens to links (a, b) between classes, a < b."""
    sets = _candidate_sets(given, percent)
    at = sets.select("class", "n", "alone", "score", F.posexplode("prefix").alias("i", "x"))
    groups = at.select(F.col("x.token").alias("token"), "class", "n", (F.col("alone") + F.col("i")).cast("long").alias("place"), "score")
    ends = groups.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), F.max_by(F.struct("class", "n", "place"), F.struct("score", "class")).alias("hub")).where("k > 1")
    # only rows that a set of the group may be large and small enough for
    near = F.greatest(F.ceil(F.col("n") * percent / 100.0), F.col("least"))
    groups = _part(groups).join(_part(ends), ["token", "part"]).where(_enough(F.col("n") - F.col("place"), F.col("n"), near, percent))
    groups = materialize(groups.select("token", "class", "n", "place", F.col("hub.class").alias("hub"), F.col("hub.n").alias("h_n"), F.col("hub.place").alias("h_place")), "groups")

    stars = groups.where(F.col("class") != F.col("hub")).where(_fit("", "h_", percent)).select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()
    links = _verified(stars, sets, percent)

    # groups that the stars left in pieces: pairs across pieces
    found = connected_components(links).withColumnRenamed("node", "class")
    pieces = groups.select("token", "class", "n", "place").join(found, "class", "left").withColumn("piece", F.coalesce("component", "class")).drop("component")
    pieces = materialize(pieces, "pieces")
    split = pieces.groupBy("token").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi")).where("lo < hi").select("token")
    # similar sets are of one size band or of neighbouring ones, each a share of `percent` wide: the smaller set of a pair
    # meets its own band and the next, so a group is joined band by band, not whole with itself
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    rest = _part(pieces).join(_part(split), ["token", "part"]).withColumn("band", band)
    larger = rest.select("token", "part", F.explode(F.array("band", F.col("band") - 1)).alias("band"), *[F.col(c).alias(f"o_{c}") for c in ("class", "n", "place", "piece")])
    smaller = (F.col("n") < F.col("o_n")) | ((F.col("n") == F.col("o_n")) & (F.col("class") < F.col("o_class")))
    across = rest.join(larger, ["token", "part", "band"]).where(smaller & (F.col("piece") != F.col("o_piece")) & _fit("", "o_", percent))
    across = across.select(F.least("class", "o_class").alias("class"), F.greatest("class", "o_class").alias("o_class"))
    more = _verified(across.select(F.col("class").alias("a"), F.col("o_class").alias("b")).distinct(), sets, percent)
    discard(groups, pieces, sets)
    return links.union(more)


def near_duplicates(docs: DataFrame, block: str, k: int = 4, percent: int = 80) -> DataFrame:
    """Clusters of documents of one block whose shingles have a Jaccard similarity of percent or more.

    Words are three letters a-z or more, in lower case; shingles are k of them, or the single words of a shorter
    text. Texts without words are alike; documents without a block share one. Returns doc_id, cluster (the smallest
    doc_id), for clusters of two or more."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))
    gram = f"CASE WHEN size(w) < {k} THEN transform(w, x -> xxhash64(block, x)) ELSE transform(sequence(0, size(w) - {k}), i -> xxhash64(block, {', '.join(f'w[i + {j}]' for j in range(k))})) END"
    cut = docs.select("doc_id", F.coalesce(F.col(block), F.lit("")).alias("block"), F.explode(F.array(words)).alias("w"))
    cut = cut.select("doc_id", "block", F.explode(F.array(F.array_sort(F.array_distinct(F.expr(gram))))).alias("tokens")).withColumn("class", F.xxhash64("block", "tokens"))
    sets = materialize(cut.select("doc_id", "class", "tokens"), "shingles")
    classes = sets.groupBy("class").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n"))
    links = similar_links(materialize(sets.where(F.size("tokens") > 0).groupBy("class").agg(F.first("tokens").alias("tokens")), "sets"), percent)
    name = lambda x: classes.select(F.col("class").alias(x), F.col("doc").alias(f"doc_{x}"))
    between = links.join(name("a"), "a").join(name("b"), "b").select("doc_a", "doc_b")
    copies = sets.select("doc_id", "class").join(classes.where("n > 1"), "class").select("doc_id", "doc").where("doc_id <> doc")
    joined = connected_components(between.union(copies), "doc_a", "doc_b")
    return joined.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))


def editions(docs: DataFrame, clusters: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, cluster, similarity: each member of a cluster with its similarity (Jaccard, 6 decimals) to the cluster's smallest doc_id, 1 for that itself.

    docs: doc_id, text; clusters: doc_id, cluster. A member's shingles meet the anchor's only, not each other's."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))
    gram = f"CASE WHEN size(w) < {k} THEN transform(w, x -> xxhash64(x)) ELSE transform(sequence(0, size(w) - {k}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(k))})) END"
    mine = docs.select("doc_id", "text").join(clusters, "doc_id").select("doc_id", "cluster", F.explode(F.array(words)).alias("w"))
    sets = materialize(mine.select("doc_id", "cluster", F.explode(F.array(F.array_distinct(F.expr(gram)))).alias("g")), "editions")
    sizes = sets.select("doc_id", "cluster", F.size("g").cast("long").alias("n"))
    anchor = sets.where("doc_id = cluster").select("cluster", F.explode("g").alias("s"))
    both = sets.where("doc_id <> cluster").select("doc_id", "cluster", F.explode("g").alias("s")).join(anchor, ["cluster", "s"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("both"))
    met = sizes.join(sizes.where("doc_id = cluster").select("cluster", F.col("n").alias("m")), "cluster").join(both, "doc_id", "left")
    shared = F.coalesce("both", F.lit(0))
    union = F.col("n") + F.col("m") - shared
    similarity = F.when((F.col("doc_id") == F.col("cluster")) | (union == 0), 1.0).otherwise(F.round(shared / union, 6))
    return met.select("doc_id", "cluster", similarity.alias("similarity"))


def siblings(found: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, other, similarity, rank: the other editions of asked documents, those most similar to the cluster's anchor first. found: editions(); asked: doc_id."""
    mine = asked.select("doc_id").distinct().join(found.select("doc_id", "cluster"), "doc_id")
    other = found.select("cluster", F.col("doc_id").alias("other"), "similarity")
    met = mine.join(other, "cluster").where("other <> doc_id")
    return met.select("doc_id", "other", "similarity", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("similarity"), "other")).alias("rank"))
