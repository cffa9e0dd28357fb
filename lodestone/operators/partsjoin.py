"""Joins and aggregates over the parts index and the catalogue."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.sources.scratch import frugal, materialize


def locate(parts: DataFrame, queries: DataFrame) -> DataFrame:
    """Appearances of each query's part, by stock number or part number; the first of each (document, page, fig_no).

    `queries`: qid, key. Two equi-joins instead of one OR, so neither needs a nested loop."""
    found = parts.join(queries, F.col("nsn") == F.col("key")).unionByName(parts.join(queries, F.col("part_number") == F.col("key")))
    return found.groupBy("qid", "document_id", "page", "fig_no").agg(F.min("nsn").alias("nsn"), F.min("part_number").alias("part_number"))


def reference_names(parts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row a stock number, named by the catalogue where it has it, else by the parts list."""
    per = parts.groupBy("nsn").agg(F.max("name").alias("own"), F.max("fig_no").alias("fig_no"), F.count_distinct("vehicle").alias("n_vehicles"))
    ref = catalogue.groupBy("nsn").agg(F.max(F.nullif(F.trim("item_name"), F.lit(""))).alias("item_name"), F.max("characteristics").alias("characteristics"))
    return per.join(ref, "nsn", "left").select("nsn", F.coalesce("item_name", "own").alias("label"), "characteristics", "fig_no", "n_vehicles")


def only_indexed(catalogue: DataFrame, parts: DataFrame) -> DataFrame:
    """Catalogue rows whose stock number occurs in the index."""
    return catalogue.join(parts.select("nsn"), "nsn", "left_semi")


def key_sets(left: DataFrame, right: DataFrame, key: str = "nsn") -> DataFrame:
    """How many keys both sides have, and how many only one."""
    a, b = left.select(F.col(key).alias("a")).distinct(), right.select(F.col(key).alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("linked"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"))


def figure_before(pages: DataFrame, first: str = "fig_no") -> DataFrame:
    """As-of join on a page: each row takes the last figure at or before it. `pages`: document_id, pos, fig (null where none), nsn."""
    upto = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pages.withColumn(first, F.last("fig", ignorenulls=True).over(upto)).where(F.col("nsn").isNotNull())


def fallback_keys(queries: DataFrame, parts: DataFrame) -> DataFrame:
    """The exact part number, else its base without the last dash group. `queries`: qid, pn."""
    rows = parts.select("part_number", "niin").distinct()
    exact = queries.join(rows, F.upper("pn") == F.upper("part_number")).select("qid", F.lit(1).alias("rank"), "niin", "part_number")
    base = lambda c: F.regexp_replace(F.upper(c), "[A-Z]$", "")
    near = queries.join(rows, base("pn") == F.upper("part_number")).select("qid", F.lit(2).alias("rank"), "niin", "part_number")
    best = F.min(F.struct("rank", "niin", "part_number")).alias("b")
    return exact.unionByName(near).groupBy("qid").agg(best).select("qid", "b.rank", "b.niin", "b.part_number")


def recover_niin(rows: DataFrame, catalogue_parts: DataFrame) -> DataFrame:
    """The item number of rows without one, through the normal form of the part number."""
    norm = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    known = catalogue_parts.groupBy(norm("part_number").alias("pn_norm")).agg(F.max("niin").alias("found"))
    return rows.withColumn("pn_norm", norm("part_number")).join(known, "pn_norm", "left")


def key_conflicts(barcodes: DataFrame, page_keys: DataFrame, most: int = 5) -> DataFrame:
    """A decoded key that is not among the at most `most` keys of its page, one row for each of those."""
    on_page = page_keys.groupBy("document_id", "page").agg(F.collect_set("nsn").alias("keys"))
    odd = barcodes.join(on_page, ["document_id", "page"]).where(~F.array_contains("keys", F.col("barcode")) & (F.size("keys") <= most))
    return odd.select("document_id", "page", "barcode", F.explode("keys").alias("page_nsn"))


def supersession(links: DataFrame, held: DataFrame) -> DataFrame:
    """Tokens of `superseded` whose item number is held. `links`: nsn, superseded."""
    token = F.explode(F.split("superseded", r"[,;/ ]+"))
    digits = F.regexp_replace("token", "[^0-9]", "")
    split = links.select("nsn", token.alias("token")).where(F.length(digits) >= 9).withColumn("niin", F.right(digits, F.lit(9)))
    return split.join(held.select("niin"), "niin", "left_semi").select("nsn", "token", "niin")


def siblings(parts: DataFrame, queries: DataFrame) -> DataFrame:
    """Other parts on the same figure of the same document as the queried one. `queries`: nsn."""
    mine = parts.join(queries.select("nsn").distinct(), "nsn").select(F.col("nsn").alias("of"), "document_id", "fig_no").distinct()
    return mine.join(parts, ["document_id", "fig_no"]).where("nsn <> of").select("of", "nsn", "part_number", "name").distinct()


def see_also(parts: DataFrame, queries: DataFrame, most: int = 40) -> DataFrame:
    """Other stock numbers under the same name (without regard to case), not on the same figure; the first `most`.

    A name's numbers are tried in order, as many as there can be others among: the number itself and those on its figures. So a part meets
    a few numbers of its name, whatever their number."""
    frugal(parts.sparkSession)
    asked = queries.select("nsn").distinct()
    named = materialize(parts.where("nsn IS NOT NULL").select("nsn", F.lower("name").alias("title")).where("title IS NOT NULL").distinct(), "named")
    mine = materialize(parts.select("nsn", "document_id", "fig_no").join(asked, "nsn", "left_semi").select(F.col("nsn").alias("of"), "document_id", "fig_no").distinct(), "mine")
    beside = materialize(mine.join(parts.select("nsn", "document_id", "fig_no"), ["document_id", "fig_no"]).where("nsn <> of").select("of", "nsn").distinct(), "beside")
    passed = materialize(beside.groupBy("of").agg((F.count(F.lit(1)) + most + 1).alias("tried")), "passed")
    longest = passed.agg(F.coalesce(F.max("tried"), F.lit(most + 1))).first()[0]
    first = named.withColumn("place", F.row_number().over(Window.partitionBy("title").orderBy("nsn"))).where(F.col("place") <= longest)
    wanted = named.join(asked, "nsn", "left_semi").withColumnRenamed("nsn", "of").join(passed, "of", "left")
    pairs = wanted.join(first, "title").where((F.col("place") <= F.coalesce("tried", F.lit(most + 1))) & (F.col("nsn") != F.col("of"))).select("of", "nsn")
    rest = pairs.distinct().join(beside, ["of", "nsn"], "left_anti")
    return rest.withColumn("n", F.row_number().over(Window.partitionBy("of").orderBy("nsn"))).where(F.col("n") <= most).drop("n")


def on_page(parts: DataFrame) -> DataFrame:
    """C17: distinct parts of every document page, numbered in order."""
    order = Window.partitionBy("document_id", "page").orderBy(F.col("nsn").isNull(), "name", "nsn", "part_number")
    return parts.select("document_id", "page", "nsn", "part_number", "name").distinct().withColumn("place", F.row_number().over(order))


def _beside(lines: DataFrame, side: float, cells: DataFrame | None) -> DataFrame:
    """page, cx, cy and `ends`, the lines of a cell and of the eight around it, of `cells` where they are named."""
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    cell = lambda c: F.floor(F.col(c) / side)
    near = lines.select("page", "line_id", "lx", "ly", cell("lx").alias("x_"), cell("ly").alias("y_"), F.explode(step).alias("dx")).select("*", F.explode(step).alias("dy"))
    near = near.select("page", (F.col("x_") + F.col("dx")).alias("cx"), (F.col("y_") + F.col("dy")).alias("cy"), F.struct("lx", "ly", "line_id").alias("end"))
    if cells is not None:
        near = near.join(cells, ["page", "cx", "cy"], "left_semi")
    return near.groupBy("page", "cx", "cy").agg(F.collect_list("end").alias("ends"))


def nearest(points: DataFrame, lines: DataFrame, reach: float = 60.0) -> DataFrame:
    """For each point of a page the nearest line end within reach.

    Line ends of one place are one. The first cells are as small as the ends are crowded, about one end a cell; a point whose nearest end
    among nine cells is no farther than a cell's side has it for good, and only the others go on to cells twice as large, up to the reach."""
    spark = points.sparkSession
    frugal(spark)
    known = materialize(lines.where("lx IS NOT NULL AND ly IS NOT NULL").groupBy("page", "lx", "ly").agg(F.min("line_id").alias("line_id")), "lines")
    crowds = known.groupBy("page", F.floor(F.col("lx") / reach).alias("cx"), F.floor(F.col("ly") / reach).alias("cy")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    crowd = crowds.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 1.0
    found, left = [], points.select("page", "point_id", "x", "y")
    for halvings in range(math.ceil(math.log(crowd, 4)), -1, -1):
        side = reach / 2**halvings
        asked = left.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
        cells = asked.select("page", "cx", "cy").distinct() if found else None
        square = lambda e: (F.col("x") - e["lx"]) ** 2 + (F.col("y") - e["ly"]) ** 2
        met = asked.join(_beside(known, side, cells).hint("merge"), ["page", "cx", "cy"], "left")
        seen = met.select("page", "point_id", "x", "y", F.array_min(F.transform("ends", lambda e: F.struct(square(e).alias("d2"), e["line_id"].alias("line_id")))).alias("b"))
        # a cell's side is rounded: what is at its very edge is settled by the next cells
        sure = F.col("b.d2") < (reach * reach if halvings == 0 else side * side * (1 - 1e-9))
        seen = materialize(seen.withColumn("sure", F.coalesce(sure, F.lit(False))), "nearest")
        found.append(seen.where("sure").select("page", "point_id", "b"))
        left = seen.where("NOT sure").select("page", "point_id", "x", "y")
        if left.isEmpty():
            break
    best = functools.reduce(DataFrame.union, found).groupBy("page", "point_id").agg(F.min("b").alias("b"))
    return best.select("page", "point_id", "b.line_id", F.round(F.sqrt("b.d2"), 6).alias("distance"))


def in_sections(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """The section of each page; sections are (document_id, side, start, end)."""
    inside = (F.col("page") >= F.col("start")) & (F.col("page") <= F.col("end"))
    return pages.join(sections.withColumnRenamed("document_id", "d"), (F.col("document_id") == F.col("d")) & inside).drop("d")


def part_records(parts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One fused record an item number, with where its name comes from and a confidence."""
    own = parts.groupBy("niin").agg(F.min("part_number").alias("part_number"), F.max("name").alias("own"), F.array_sort(F.collect_set("vehicle")).alias("v"), F.count_distinct("nsn").alias("n_nsn"), F.min("cagec").alias("cagec"))
    met = own.join(catalogue.select("niin", "item_name"), "niin", "left")
    score = 0.3 + F.when(F.col("part_number").isNotNull(), 0.2).otherwise(0.0) + F.when(F.col("item_name").isNotNull(), 0.3).otherwise(0.0) + F.when(F.size("v") > 1, 0.3).otherwise(0.0)
    source = F.when(F.col("item_name").isNotNull(), "catalogue").otherwise("parts list")
    conflict = F.coalesce(F.lower("item_name") != F.lower("own"), F.lit(False))
    return met.select("niin", "part_number", F.coalesce("item_name", "own").alias("name"), source.alias("name_from"), conflict.alias("name_conflict"), F.array_join("v", " | ").alias("vehicles"), (F.col("n_nsn") > 1).alias("drifts"), F.round(F.least(F.lit(1.0), score), 3).alias("confidence"))


def citations(parts: DataFrame) -> DataFrame:
    """Catalogue references of a stock number by vehicle and figure."""
    return parts.groupBy("nsn", "vehicle", "fig_no").agg(F.min("page").alias("page"), F.count(F.lit(1)).alias("n"))


def best_figure(parts: DataFrame) -> DataFrame:
    """The citing row with a figure number and the lowest page."""
    best = F.min(F.struct((F.col("fig_no") == 0).alias("none"), "page", "document_id", "fig_no")).alias("b")
    return parts.groupBy("nsn").agg(best).select("nsn", "b.fig_no", "b.page", "b.document_id")


def family(links: DataFrame) -> DataFrame:
    """Related items one hop away, in either direction."""
    both = links.select(F.col("a").alias("niin"), F.col("b").alias("related")).union(links.select("b", "a"))
    return both.where("niin <> related").distinct()


def common_names(parts: DataFrame, top: int = 25) -> DataFrame:
    """The most common names, with their distinct stock numbers and vehicles."""
    label = F.nullif(F.trim("name"), F.lit(""))
    per = parts.where(label.isNotNull()).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("nsn").alias("n_nsn"), F.count_distinct("vehicle").alias("n_vehicles"))
    return per.orderBy(F.desc("n"), "label").limit(top)


def recurring(parts: DataFrame, top: int = 25) -> DataFrame:
    """The stock numbers that occur most."""
    per = parts.groupBy("nsn").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vehicle").alias("n_vehicles"), F.max("name").alias("label"))
    return per.orderBy(F.desc("n"), "nsn").limit(top)


def platforms(parts: DataFrame, most: int = 40) -> DataFrame:
    """The vehicles and documents of each stock number."""
    per = parts.groupBy("nsn").agg(F.array_sort(F.collect_set("vehicle")).alias("v"), F.count_distinct("document_id").alias("n_docs"))
    return per.select("nsn", F.size("v").alias("n_vehicles"), F.array_join(F.slice("v", 1, most), " | ").alias("vehicles"), "n_docs")


def drift(parts: DataFrame) -> DataFrame:
    """Item numbers written as several stock numbers, and whether their class differs."""
    per = parts.groupBy("niin").agg(F.array_sort(F.collect_set("nsn")).alias("v")).where(F.size("v") > 1)
    classes = F.array_distinct(F.transform("v", lambda x: F.substring(x, 1, 4)))
    return per.select("niin", F.size("v").alias("n"), F.array_join("v", " | ").alias("variants"), (F.size(classes) > 1).alias("class_conflict"))


def commonality(parts: DataFrame) -> DataFrame:
    """How widely each item is used."""
    per = parts.groupBy("niin").agg(F.count_distinct("vehicle").alias("n_vehicles"))
    label = F.when(F.col("n_vehicles") == 0, "unknown").when(F.col("n_vehicles") == 1, "single-platform").when(F.col("n_vehicles") < 10, "shared").otherwise("fleet-common")
    return per.withColumn("label", label)


def congruency(parts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Data-quality counts of the index, one row a metric."""
    per = parts.groupBy("niin").agg(F.count_distinct("nsn").alias("variants"), F.count_distinct("vehicle").alias("spread"), F.count(F.lit(1)).alias("n"))
    held = per.join(catalogue.select("niin").distinct().withColumn("known", F.lit(True)), "niin", "left")
    one = held.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("items"), F.count_if(F.col("known")).alias("linked"), F.count_if(F.col("variants") > 1).alias("drifting"), F.count_if(F.col("spread") > 1).alias("shared"), F.max("spread").alias("max_spread"))
    names = one.columns
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in names])).alias("m")).select("m.metric", "m.value")


def look_alikes(parts: DataFrame) -> DataFrame:
    """Parts that share a name: what tells each stock number apart."""
    fields = ("part_number", "cagec", "uoc", "vehicle")
    per = parts.groupBy("name", "nsn").agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in fields])
    groups = per.groupBy("name").agg(F.count(F.lit(1)).alias("n_nsn"), *[F.size(F.array_distinct(F.flatten(F.collect_set(c)))).alias(f"n_{c}") for c in fields]).where("n_nsn > 1")
    return groups.select("name", "n_nsn", *[(F.col(f"n_{c}") > 1).alias(f"{c}_differs") for c in fields])


def kit(parts: DataFrame) -> DataFrame:
    """Bill of materials of each document: quantities summed by stock number, one where none is given."""
    key = F.upper(F.coalesce(F.nullif("nsn", F.lit("")), "part_number", "name"))
    return parts.groupBy("document_id", key.alias("key")).agg(F.sum(F.coalesce("qty", F.lit(1))).alias("qty"), F.count(F.lit(1)).alias("n_lines"))


#: Pairs of one partition where pairs are judged.
_PAIRS = 100_000


def interchange(pairs: DataFrame, links: DataFrame, replaced: DataFrame, traits: DataFrame) -> DataFrame:
    """Verdict on pairs (a, b): green in one family, amber if one replaces the other or traits agree, else red.

    `traits`: niin, requirement, reply."""
    fam = family(links).select(F.col("niin").alias("a"), F.col("related").alias("b"), F.lit(True).alias("same_family"), F.lit(False).alias("replaces"))
    rep = replaced.select("a", "b").union(replaced.select("b", "a")).select("a", "b", F.lit(False).alias("same_family"), F.lit(True).alias("replaces"))
    known = fam.union(rep).groupBy("a", "b").agg(F.max("same_family").alias("same_family"), F.max("replaces").alias("replaces"))
    # an item's traits are one row: neither pairs nor what they are joined to are multiplied by the traits
    # the partitions follow the pairs: narrow rows are packed so small that adaptive execution would give one task too many of them
    n = pairs.count() // _PAIRS + 1
    own = traits.repartition(n, "niin").groupBy("niin").agg(F.collect_list(F.struct("requirement", "reply")).alias("own"))
    mine = pairs.repartition(n, "a", "b").join(known, ["a", "b"], "left").repartition(n, "a").join(own.select(F.col("niin").alias("a"), F.col("own").alias("mine")), "a", "left")
    both = mine.repartition(n, "b").join(own.select(F.col("niin").alias("b"), F.col("own").alias("theirs")), "b", "left")
    agree = F.flatten(F.transform("mine", lambda x: F.transform(F.filter("theirs", lambda y: y["requirement"] == x["requirement"]), lambda y: x["reply"] == y["reply"])))
    met = both.select("a", "b", "same_family", "replaces", F.explode(F.array(agree)).alias("agree"))
    met = met.select("a", "b", "same_family", "replaces", F.size(F.filter("agree", lambda x: x)).alias("same"), F.size(F.filter("agree", lambda x: ~x)).alias("differ"))
    percent = F.round(100.0 * F.col("same") / (F.col("same") + F.col("differ")))
    verdict = F.when(F.col("same_family"), "green").when(F.col("replaces"), "amber").when((percent >= 90) & (F.col("same") + F.col("differ") >= 3), "amber").otherwise("red")
    return met.select("a", "b", F.coalesce(percent, F.lit(0.0)).alias("similarity"), verdict.alias("verdict"))
