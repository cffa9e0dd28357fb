"""Manuals and their pages: sides, priorities, scopes, saved queries, stitched tables, reviews."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions import codes
from lodestone.operators import facts, postings
from lodestone.sources import scratch

#: Names of collections that are written out at once.
NAMES = 1_000_000
# Name parts of parts lists, and the words of dimensions in characteristics.
PARTS_LIST = "24P|RPSTL|-20P|PARTS"
DIMENSION = "DIAMETER|LENGTH|HEIGHT|WIDTH|THICKNESS"


def is_parts_list(*names: str) -> Column:
    """Any of a document's names is that of a parts list."""
    return F.coalesce(F.greatest(*[F.upper(F.coalesce(F.col(c), F.lit(""))).rlike(PARTS_LIST) for c in names]), F.lit(False))


def bears_dimension(characteristics: str) -> Column:
    """Characteristics mention a dimension."""
    return F.coalesce(F.upper(F.col(characteristics)).rlike(DIMENSION), F.lit(False))


# Words on the first pages of an operator's and of a mechanic's manual.
OPERATOR_COVER = codes.phrases(("operator manual", "operators manual", "operator's manual", "operator instructions", "operators instructions", "operator's instructions"), start="")
MECHANIC_COVER = codes.phrases(("maintenance allocation chart", "unit maintenance", "field maintenance", "direct support", "general support", "repair parts and special"))


def side_map(documents: DataFrame, pages: DataFrame, overrides: DataFrame) -> DataFrame:
    """The documents with operator, mechanic, side (both, operator, mechanic), coverage and confidence: by number and title; where these say nothing,
    by the words of the first two pages (4000 characters); a reviewer's override wins.

    documents: doc_id, tm, title and perhaps path; pages: doc_id, page_number, body_text; overrides: doc_id, override."""
    path = F.col("path") if "path" in documents.columns else F.lit("")
    named = documents.withColumn("own", codes.tm_side(F.col("tm"), F.col("title"), path))
    # pages are read for the unsure ones only
    unsure = named.where("own.confidence = 'low'").select("doc_id")
    head = pages.where("page_number <= 2").join(unsure, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "body_text"))).alias("p"))
    head = head.select("doc_id", F.substring(F.array_join(F.transform("p", lambda x: x["body_text"]), " "), 1, 4000).alias("text"))
    met = named.join(head, "doc_id", "left").join(overrides, "doc_id", "left")
    op, me = F.coalesce(F.col("text").rlike(OPERATOR_COVER), F.lit(False)), F.coalesce(F.col("text").rlike(MECHANIC_COVER), F.lit(False))
    said = op | me
    operator = F.when(F.col("override").isNotNull(), F.col("override").isin("operator", "both")).when(said, op).otherwise(F.col("own.operator"))
    mechanic = F.when(F.col("override").isNotNull(), F.col("override").isin("mechanic", "both")).when(said, me | ~op).otherwise(F.col("own.mechanic"))
    confidence = F.when(F.col("override").isNotNull(), "override").when(said, "medium").otherwise(F.col("own.confidence"))
    out = met.select(*documents.columns, operator.alias("operator"), mechanic.alias("mechanic"), F.col("own.coverage").alias("coverage"), confidence.alias("confidence"))
    return out.withColumn("side", F.when(F.col("operator") & F.col("mechanic"), "both").when(F.col("operator"), "operator").when(F.col("mechanic"), "mechanic").otherwise("none"))


def side_counts(sides: DataFrame) -> DataFrame:
    """Documents, those of each side, of both, and the uncertain ones."""
    return sides.agg(F.count(F.lit(1)).alias("documents"), F.count_if("operator").alias("operator"), F.count_if("mechanic").alias("mechanic"), F.count_if(F.col("operator") & F.col("mechanic")).alias("both"), F.count_if(F.col("confidence") == "low").alias("uncertain"))


def of_side(sides: DataFrame, side: str, needle: str = "", limit: int = 400, offset: int = 0) -> DataFrame:
    """A page of the documents of a side whose number or vehicle has a part, with their total."""
    mine = sides.where((F.col("side") == side) & (F.lower(F.col("tm")).contains(needle.lower()) | F.lower(F.col("vehicle")).contains(needle.lower())))
    total = mine.agg(F.count(F.lit(1))).scalar()
    return mine.withColumn("total", total).orderBy("vehicle", "tm", "doc_id").offset(offset).limit(limit)


def uncertain(sides: DataFrame, limit: int = 200) -> DataFrame:
    """Documents whose side is of low or medium confidence, low first."""
    return sides.where("confidence IN ('low', 'medium')").orderBy(F.col("confidence") != "low", "doc_id").limit(limit)


def priorities(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pending pages in the order of their document's kind: parts, trouble, maintenance, operator, the rest."""
    level = F.when(is_parts_list("tm", "title"), 0).when(F.lower("title").contains("troubleshoot"), 1).when(F.col("tm").rlike("-2[04]$"), 2).when(F.col("tm").endswith("-10"), 3).otherwise(5)
    return pages.where("status = 'pending'").join(documents.select("doc_id", level.alias("priority")), "doc_id").select("doc_id", "page_number", "priority")


def fielded(documents: DataFrame, tm: str | None = None, vehicle: str | None = None, nsn: str | None = None) -> DataFrame:
    """Parts of the number or vehicle in any case; stock numbers by their digits, or by their letters where they have none."""
    out = documents
    for name, part in (("tm", tm), ("vehicle", vehicle)):
        out = out.where(F.lower(F.col(name)).contains(part.lower())) if part else out
    if nsn:
        digits = "".join(c for c in nsn if c.isdigit())
        out = out.where(F.regexp_replace("nsn", "[^0-9]", "").contains(digits) if digits else F.lower("nsn").contains(nsn.lower()))
    return out


def retrieve(index: postings.Postings, asked: DataFrame, documents: DataFrame, top: int = 20, vehicle: str | None = None) -> DataFrame:
    """The best pages of each query by BM25 with their document's columns, of one vehicle's documents (part of its name) where one is named.

    index: postings of pages, its key beginning with doc_id; asked: qid, term. Only pages that can be among the best are scored in full."""
    if vehicle:
        mine = documents.where(F.contains(F.lower("vehicle"), F.lit(vehicle.lower())))
        found = postings.scores(index._replace(postings=index.postings.join(mine.select("doc_id"), "doc_id", "left_semi")), postings._weighted(index, asked)).drop("matched")
        return postings._ranked(found, index.key, top).join(mine, "doc_id")
    return postings.best_bounded(index, asked, top).join(documents, "doc_id")


def _asked_hits(tokens: DataFrame, collections: DataFrame, documents: DataFrame) -> DataFrame:
    """term, v, scope, doc_id, page_number: the pages that each different term and scope asks for."""
    scoped = documents.select("doc_id", F.lower("vehicle").alias("v"), F.upper("tm").alias("t"))
    asked = _slugs(collections).drop("slug").distinct()
    # a page's words go no further unless a collection asks for them
    met = tokens.join(asked.select("term").distinct(), "term", "left_semi").select("doc_id", "page_number", "term").distinct()
    return met.join(scoped, "doc_id").join(asked, ["term", "v"]).where(F.col("t").contains(F.col("scope"))).select("term", "v", "scope", "doc_id", "page_number")


def _slugs(collections: DataFrame) -> DataFrame:
    return collections.select("slug", "term", F.lower("scope_vehicle").alias("v"), F.upper("scope_type").alias("scope"))


def saved_query_hits(tokens: DataFrame, collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages that have a collection's term in its scope: vehicle (any case) and manual type.

    collections: slug, term, scope_vehicle, scope_type; tokens: doc_id, page_number, term."""
    return _asked_hits(tokens, collections, documents).join(_slugs(collections), ["term", "v", "scope"]).select("slug", "doc_id", "page_number")


def saved_query_counts(tokens: DataFrame, collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Slug, n_pages, first_doc of the collections that have a page. Collections that ask the same are counted once, and pages aren't repeated for each."""
    per = _asked_hits(tokens, collections, documents).groupBy("term", "v", "scope").agg(F.count(F.lit(1)).alias("n_pages"), F.min("doc_id").alias("first_doc"))
    return _slugs(collections).join(per, ["term", "v", "scope"]).groupBy("slug").agg(F.sum("n_pages").alias("n_pages"), F.min("first_doc").alias("first_doc"))


def _named(batches):
    """Rows in order of group and kind: of each group those of kind 0 (id, slugs), then those of kind 1 (part, ids, n_pages), to part, slugs, n_pages: the names of a part's ids, each once,
    in order. A group holds all names once, and `NAMES` of them in lists."""
    group, known, names, ranks = None, [], None, {}
    for batch in batches:
        code, kind = batch["group_"].to_numpy(), batch["kind_"].to_numpy()
        for piece in np.split(np.arange(len(code)), np.flatnonzero((np.diff(code) != 0) | (np.diff(kind) != 0)) + 1):
            if not len(piece):
                continue
            rows = batch.slice(piece[0], len(piece))
            if code[piece[0]] != group:
                group, known, names = code[piece[0]], [], None
            if kind[piece[0]] == 0:
                known.append(rows.select(["id", "slugs"]))
                continue
            if names is None:
                every = pa.Table.from_batches(known).combine_chunks()
                lists = every["slugs"].combine_chunks()
                names = pc.unique(pc.list_flatten(lists))
                names = names.take(pc.sort_indices(names))
                rank = pc.index_in(pc.list_flatten(lists), value_set=names).to_numpy()
                ranks = dict(zip(every["id"].to_pylist(), np.split(rank, np.cumsum(pc.list_value_length(lists).to_numpy())[:-1]), strict=True))
                known = []
            ids, start, size, held = rows["ids"].to_pylist(), 0, 0, []
            for i, mine in enumerate(ids):
                held.append(np.unique(np.concatenate([ranks[x] for x in mine])))
                size += len(held[-1])
                if size >= NAMES or i == len(ids) - 1:
                    ends = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, names.take(pa.array(np.concatenate(held))))
                    part = rows.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([part["part"], pc.binary_join(lists, ","), part["n_pages"]], ["part", "slugs", "n_pages"])
                    start, size, held = i + 1, 0, []


def memberships_of(tokens: DataFrame, collections: DataFrame, documents: DataFrame, mentions: DataFrame) -> DataFrame:
    """The collections that hold pages on which a part is mentioned. mentions: part, doc_id, page_number; the others as for saved_query_hits().

    A part meets the numbers of the different terms and scopes of its pages. The names of the collections go once to each group of parts; the answer,
    which may hold each name for each part, is written out there and isn't exchanged."""
    spark = tokens.sparkSession
    scratch.frugal(spark)
    what = ["term", "v", "scope"]
    asked = scratch.materialize(_slugs(collections).groupBy(*what).agg(F.collect_set("slug").alias("slugs")).withColumn("id", F.monotonically_increasing_id()), "asked")
    hits = _asked_hits(tokens, collections, documents).join(asked.drop("slugs"), what).groupBy("doc_id", "page_number").agg(F.collect_set("id").alias("ids"))
    met = mentions.where("part IS NOT NULL").select("part", "doc_id", "page_number").repartition("doc_id", "page_number").distinct().join(hits, ["doc_id", "page_number"])
    # a page counts at the first of its numbers
    per = met.select("part", F.posexplode("ids").alias("at", "id")).groupBy("part", "id").agg(F.count_if(F.col("at") == 0).alias("n")).groupBy("part").agg(F.collect_list("id").alias("ids"), F.sum("n").alias("n_pages"))
    groups = 4 * spark.sparkContext.defaultParallelism
    who = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group_"), F.lit(0).alias("kind_"), "id", "slugs")
    rows = per.select(F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int").alias("group_"), F.lit(1).alias("kind_"), "part", "ids", "n_pages")
    dealt = who.unionByName(rows, allowMissingColumns=True).repartition(groups, "group_").sortWithinPartitions("group_", "kind_")
    return dealt.mapInArrow(_named, f"part {dict(mentions.dtypes)['part']}, slugs string, n_pages long")


def confirmed_aliases(variants: DataFrame, decisions: DataFrame) -> DataFrame:
    """C14: each stock number with the other forms of its item where the latest decision says interchangeable. variants: niin, nsn; decisions: niin, decision, at."""
    last = decisions.groupBy("niin").agg(F.max_by("decision", F.struct("at", "decision")).alias("decision"))
    known = variants.distinct()
    forms = known.groupBy("niin").agg(F.array_sort(F.collect_set("nsn")).alias("forms"))
    met = known.join(forms, "niin").join(last, "niin", "left")
    aliases = F.when(F.col("decision") == "interchangeable", F.col("forms")).otherwise(F.array("nsn"))
    return met.select("nsn", F.array_join(aliases, ",").alias("aliases"))


def correlations(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Of each item its platforms (where there are several), stock number forms, and what supersedes it. links: old, new."""
    per = parts.groupBy("niin").agg(F.count_distinct("vehicle").alias("n_vehicles"), F.array_join(F.array_sort(F.collect_set("nsn")), ",").alias("variants"))
    by = links.groupBy(F.col("old").alias("niin")).agg(F.max("new").alias("superseded_by"))
    met = per.join(by, "niin", "left")
    return met.select("niin", F.when(F.col("n_vehicles") > 1, F.col("n_vehicles")).alias("n_vehicles"), "variants", "superseded_by")


def substitutes(links: DataFrame, replacements: DataFrame, names: DataFrame) -> DataFrame:
    """The family of each item (one link either way) and what replaces it, named. links, replacements: old, new; names: niin, name."""
    family = links.select(F.col("old").alias("niin"), F.col("new").alias("other")).union(links.select("new", "old"))
    every = family.union(replacements.select("old", "new")).distinct()
    return every.join(names.select(F.col("niin").alias("other"), "name"), "other", "left").select("niin", "other", "name")


def drift_review(parts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with several stock numbers, whether their classes differ, and the latest decision on them."""
    per = parts.groupBy("niin").agg(F.array_sort(F.collect_set("nsn")).alias("forms")).where(F.size("forms") > 1)
    last = decisions.groupBy("niin").agg(F.max_by("decision", F.struct("at", "decision")).alias("decision"))
    classes = F.size(F.array_distinct(F.transform("forms", lambda x: F.substring(x, 1, 4))))
    return per.join(last, "niin", "left").select("niin", F.array_join("forms", ",").alias("forms"), (classes > 1).alias("class_conflict"), F.coalesce("decision", F.lit("pending")).alias("decision"))


def observations(page_facts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Measurements of pages and numeric characteristics of the catalogue as rows of one kind, by method."""
    found = facts.measurements(catalogue.select("niin", F.lower("characteristics").alias("body_text")))
    ours = page_facts.select("niin", F.lit("pages").alias("method"), "type", "unit", "value")
    return ours.union(found.select("niin", F.lit("catalogue"), "type", "unit", "value"))


def first_measurement(pages: DataFrame) -> DataFrame:
    return facts.measurements(pages, 1)


def label_values(pages: DataFrame, cap: int = 200, measure: Callable[[DataFrame], DataFrame] = first_measurement) -> DataFrame:
    """I8, U1: 'Label: value' lines, distinct, with the number and unit of values that are measurements, as `measure` finds them: from pages with
    body_text to at most one row a page with its other columns, type, value and unit."""
    keys = [c for c in pages.columns if c != "body_text"]
    pattern = r"(?m)^[ \t]*([A-Z][A-Za-z /-]{1,40}):[ \t]*(\S[^\n]*)$"
    raw = pages.select(*keys, F.explode(F.slice(F.regexp_extract_all("body_text", F.lit(pattern), F.lit(0)), 1, cap)).alias("raw"))
    cut = raw.select(*keys, F.trim(F.regexp_extract("raw", pattern, 1)).alias("label"), F.trim(F.regexp_extract("raw", pattern, 2)).alias("text")).distinct()
    number = measure(cut.withColumn("body_text", F.col("text"))).select(*keys, "label", "text", "type", "value", "unit")
    return cut.join(number, [*keys, "label", "text"], "left")


def mixed_facts(pages: DataFrame) -> DataFrame:
    """Measurements of free text and of labelled lines, by method."""
    keys = [c for c in pages.columns if c != "body_text"]
    free = facts.measurements(pages).select(*keys, F.lit("text").alias("method"), "type", "value", "unit")
    return free.union(label_values(pages).where("value IS NOT NULL").select(*keys, F.lit("label"), "type", "value", "unit"))


def table_types(pages: DataFrame, key: str = "document_id", measure: Callable[[DataFrame], DataFrame] = facts.measurements) -> DataFrame:
    """The dimension types in a table's cells, and whether it is a table of specifications (two types or more)."""
    types = measure(pages).groupBy(key).agg(F.array_sort(F.collect_set("type")).alias("t"))
    return types.select(key, F.array_join("t", ",").alias("types"), (F.size("t") >= 2).alias("is_spec"))


def stitch(tables: DataFrame) -> DataFrame:
    """E5: doc_id, table_no, n_cols, pages, rows: tables that go on over pages, joined.

    tables: doc_id, page, place (order on the page), rows (array of arrays of cells). Going through a document in order, a table goes on
    with the open one if it is as wide and begins with a row of data (a cell of digits alone) or repeats the open table's first row,
    which is dropped then; else it is the open one from there. Tables without rows are passed over, whatever page numbers lie between.
    One fold a document: whether a table goes on depends on how far the ones before it went."""
    number = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[,.]", "").rlike(r"^\p{Nd}+$")
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    shown = tables.where(F.size("rows") > 0).select("doc_id", "page", "place", width.alias("n_cols"), F.exists(F.element_at("rows", 1), number).alias("data"), "rows")
    kind = "array<struct<n_cols:int,pages:array<int>,rows:array<array<string>>>>"
    # the tables are folded in the order of page and place
    ordered = shown.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), "place", "n_cols", "data", "rows"))).alias("t"))

    def step(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        head = F.element_at(last["rows"], 1)
        repeats = F.element_at(t["rows"], 1) == head
        more = F.when(repeats, F.slice(t["rows"], F.lit(2), F.size(t["rows"]))).otherwise(t["rows"])
        grown = F.struct(last["n_cols"].alias("n_cols"), F.concat(last["pages"], F.array(t["page"])).alias("pages"), F.concat(last["rows"], more).alias("rows"))
        fresh = F.struct(t["n_cols"].alias("n_cols"), F.array(t["page"]).alias("pages"), t["rows"].alias("rows"))
        goes_on = (F.size(done) > 0) & (last["n_cols"] == t["n_cols"]) & (t["data"] | repeats)
        return F.when(goes_on, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

    folded = ordered.select("doc_id", F.posexplode(F.aggregate("t", F.array().cast(kind), step)).alias("table_no", "x"))
    return folded.select("doc_id", (F.col("table_no") + 1).cast("long").alias("table_no"), "x.n_cols", "x.pages", "x.rows")


def split_review(heads: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manuals with both sides: where each side begins, or where a reviewer says it does. heads: document_id, page, side; overrides: document_id, side, landing."""
    first = heads.groupBy("document_id", "side").agg(F.min("page").alias("start"), F.count(F.lit(1)).alias("n_pages"))
    both = heads.groupBy("document_id").agg(F.count_distinct("side").alias("n")).where("n > 1").select("document_id")
    met = first.join(both, "document_id").join(overrides, ["document_id", "side"], "left")
    return met.select("document_id", "side", "n_pages", F.coalesce("landing", "start").alias("landing"))


def fold_copies(procedures: DataFrame) -> DataFrame:
    """One row for all copies of a manual's page: the first document and how many have it. procedures: tm, page, doc_id."""
    return procedures.groupBy("tm", "page").agg(F.min("doc_id").alias("doc_id"), F.count_distinct("doc_id").alias("copies"))


def by_intent(procedures: DataFrame, kind: str) -> DataFrame:
    """the asked kind first, else as they were (by `place`)."""
    return procedures.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("kind") != kind, "place")))


def overview(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """D3: one row: documents, pages, pages with text and their share, and the pages' mean length."""
    n = documents.agg(F.count(F.lit(1))).scalar()
    per = pages.agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("n_chars") >= 50).alias("with_text"), F.round(F.avg("n_chars"), 3).alias("mean_chars"))
    return per.select(n.alias("n_documents"), "n_pages", "with_text", F.round(100 * F.col("with_text") / F.col("n_pages"), 2).alias("pct"), "mean_chars")


def completion(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Pages with text of each vehicle, and of each kind of run its count, total and first and last time."""
    vehicles = pages.groupBy("vehicle").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("n_chars") >= 50, 1.0).otherwise(0.0)).alias("total"))
    mine = vehicles.select(F.lit("vehicle").alias("section"), F.col("vehicle").alias("name"), "n", "total", F.lit(None).cast("timestamp").alias("first"), F.lit(None).cast("timestamp").alias("last"))
    of_runs = runs.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return mine.union(of_runs.select(F.lit("run"), "kind", "n", "total", "first", "last"))


def run_history(runs: DataFrame, documents: DataFrame, top: int = 8) -> DataFrame:
    """The latest runs beside the counts of documents and vehicles."""
    n, v = documents.agg(F.count(F.lit(1))).scalar(), documents.agg(F.count_distinct("vehicle")).scalar()
    return runs.orderBy(F.desc("event_id")).limit(top).select("event_id", "kind", n.alias("n_documents"), v.alias("n_vehicles"))


def fresh_lists(rows: DataFrame, as_of: Column, days: int = 45) -> DataFrame:
    """The latest row of each subject that isn't older than `days`, its JSON decoded. rows: subject, props, ts."""
    last = rows.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days))).groupBy("subject").agg(F.max_by("props", F.struct("ts", "id")).alias("props"), F.max("ts").alias("ts"))
    return last.select("subject", F.from_json("props", "k string")["k"].alias("k"), "ts")


def recent(rows: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Rows newer than as_of less so many days, by kind."""
    return rows.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
