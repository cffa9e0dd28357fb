"""Catalogue records, obsolescence, saved queries, reviews and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def record(base: DataFrame, names: DataFrame, links: DataFrame) -> DataFrame:
    """One nested record an item: its row, colloquial names, and what it replaces or is replaced by.

    base: niin, ...; names: niin, name; links: old, new."""
    called = names.groupBy(F.col("niin").alias("k1")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    replaces = links.groupBy(F.col("new").alias("k2")).agg(F.array_sort(F.collect_set("old")).alias("replaces"))
    replaced = links.groupBy(F.col("old").alias("k3")).agg(F.array_sort(F.collect_set("new")).alias("replaced_by"))
    met = base.join(called, F.col("niin") == F.col("k1"), "left").join(replaces, F.col("niin") == F.col("k2"), "left").join(replaced, F.col("niin") == F.col("k3"), "left")
    return met.select(*base.columns, "names", "replaces", "replaced_by")


def by_part_number(queries: DataFrame, parts: DataFrame) -> DataFrame:
    """Part numbers (letters and digits only, upper case) to items. queries: qid, pn."""
    norm = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    known = parts.select(norm("part_number").alias("k"), "niin", "nsn").distinct()
    return queries.join(known, norm("pn") == F.col("k")).select("qid", "niin", "nsn")


def reference_cards(queries: DataFrame, catalogue: DataFrame, versions: DataFrame) -> DataFrame:
    """The reference row of a stock number and how many versions are kept. queries: nsn; versions: nsn."""
    n = versions.groupBy("nsn").agg(F.count(F.lit(1)).alias("n_versions"))
    return queries.join(catalogue, "nsn", "left").join(n, "nsn", "left").withColumn("n_versions", F.coalesce("n_versions", F.lit(0)))


# Acquisition advice codes of items that are no longer bought.
TERMINAL = ("H", "J", "K", "L", "O", "V", "Y", "Z")


def obsolescence(items: DataFrame, links: DataFrame, most: int = 6) -> DataFrame:
    """Obsolete when replaced or with a terminal code, active with another code, else unknown; the items that it is replaced by, and those
    that it replaces, up to `most` of each, smallest first.

    items: niin, aac, place (null aac: none), the code of the smallest place counts; links: old, new."""
    first = items.groupBy("niin").agg(F.upper(F.min_by("aac", F.when(F.trim("aac") != "", F.col("place")))).alias("aac"))
    known = links.distinct()
    side = lambda key, value, name: known.groupBy(F.col(key).alias("niin")).agg(F.array_join(F.slice(F.array_sort(F.collect_set(value)), 1, most), " | ").alias(name))
    met = first.join(side("old", "new", "replaced_by"), "niin", "left").join(side("new", "old", "replaces"), "niin", "left")
    code = F.substring("aac", 1, 1)
    state = F.when(F.col("replaced_by").isNotNull() | F.coalesce(code.isin(*TERMINAL), F.lit(False)), "obsolete").when(F.col("aac").isNotNull(), "active").otherwise("unknown")
    return met.select("niin", "aac", "replaced_by", "replaces", state.alias("state"))


def name_clashes(names: DataFrame) -> DataFrame:
    """Nicknames that more than one item class owns. names: class, name."""
    return names.groupBy(F.lower("name").alias("name")).agg(F.count_distinct("class").alias("n_classes")).where("n_classes > 1")


def technical_documents(rows: DataFrame) -> DataFrame:
    """Distinct technical documents of each item with their first phrase. rows: niin, document, phrase, at."""
    return rows.where(F.trim("document") != "").groupBy("niin", "document").agg(F.min_by("phrase", "at").alias("phrase"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.union(one)
    return out


def memberships(hits: DataFrame, seen: DataFrame, cap: int = 2000) -> DataFrame:
    """Members of each saved query, capped, and how many are new since it was looked at. hits: slug, doc_id; seen: slug, n_seen."""
    n = hits.groupBy("slug").agg(F.count_distinct("doc_id").alias("n"))
    met = n.join(seen, "slug", "left")
    capped = F.col("n") >= cap
    fresh = F.when(capped, 0).otherwise(F.greatest(F.lit(0), F.col("n") - F.coalesce("n_seen", F.lit(0))))
    return met.select("slug", F.least(F.col("n"), F.lit(cap)).alias("n"), capped.alias("capped"), fresh.cast("long").alias("n_new"))


def schematic_queue(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Drawings that need review (nothing found, or low confidence), undecided first. rows: id, n_components, confidence; decisions: id, decision, at."""
    last = decisions.groupBy("id").agg(F.max_by("decision", "at").alias("decision"))
    need = rows.where((F.col("n_components") == 0) | (F.col("confidence") < 0.5))
    order = Window.orderBy(F.col("decision").isNotNull(), "confidence", "id")
    return need.join(last, "id", "left").withColumn("place", F.row_number().over(order)).where("place <= 200")


def digest(reviews: DataFrame, notes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row for a shift: counts, and red, amber or green."""
    counts = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in (("reviews", reviews), ("notes", notes), ("conflicts", conflicts))]
    row = counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # one row each
    return row.withColumn("priority", F.when(F.col("conflicts") > 0, "red").when(F.col("reviews") + F.col("notes") > 0, "amber").otherwise("green"))


def missing_files(documents: DataFrame, files: DataFrame, top: int = 600, sample: int = 12) -> DataFrame:
    """Of the first documents, how many have no file, and some of those. Both: path; documents: doc_id."""
    first = documents.orderBy("doc_id").limit(top)
    met = first.join(files.select(F.col("path").alias("p")).distinct(), F.col("path") == F.col("p"), "left")
    gone = F.array_sort(F.collect_list(F.when(F.col("p").isNull(), F.col("path"))))
    return met.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("p").isNull()).alias("missing"), F.array_join(F.slice(gone, 1, sample), ",").alias("sample"))


def alternatives(terms: DataFrame, aliases: DataFrame, fuzzy: DataFrame, cap: int = 6) -> DataFrame:
    """H4: each query term with its synonyms and near spellings, six at most, and where each comes from.

    terms: qid, term; aliases: term, other; fuzzy: word, term, rank."""
    own = terms.select("qid", "term", F.col("term").alias("alt"), F.lit(0).alias("o"), F.lit("own").alias("origin"))
    syn = terms.join(aliases, "term").select("qid", "term", F.col("other").alias("alt"), F.lit(1).alias("o"), F.lit("synonym").alias("origin"))
    near = terms.join(fuzzy.select(F.col("word").alias("w"), F.col("term").alias("alt")), F.col("term") == F.col("w")).select("qid", "term", "alt", F.lit(2).alias("o"), F.lit("spelling").alias("origin"))
    once = own.union(syn).union(near).groupBy("qid", "term", "alt").agg(F.min(F.struct("o", "origin")).alias("b"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "term").orderBy("b.o", "alt")))
    return ranked.where(F.col("rank") <= cap).select("qid", "term", "alt", "b.origin", "rank")


def schematic_pages(pages: DataFrame, words: tuple[str, ...] = ("schematic", "wiring diagram", "pinout")) -> DataFrame:
    """Pages that name a schematic, with 40 characters either side as a caption."""
    at = F.least(*[F.nullif(F.instr(F.lower("body_text"), w), F.lit(0)) for w in words])
    return pages.withColumn("at", at).where("at IS NOT NULL").withColumn("caption", F.expr("substring(body_text, greatest(1, at - 40), 90)")).drop("at")


def one_time_use(pages: DataFrame) -> DataFrame:
    """Sentences that say a fastener must not be used again, by kind."""
    keys = [c for c in pages.columns if c != "body_text"]
    said = pages.select(*keys, F.explode(F.split("body_text", r"(?<=[.!?])\s+")).alias("sentence"))
    low = F.lower("sentence")
    kinds = F.array(F.when(low.rlike(r"torque[- ]to[- ]yield"), "torque-to-yield"), F.when(low.rlike(r"do not re-?use|discard"), "do not reuse"), F.when(low.rlike(r"one[- ]time[- ]use|replace with new"), "one-time use"))
    return said.select(*keys, "sentence", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def torque_sequence(c: Column) -> Column:
    """Pattern, stages and number of bolts of a tightening instruction."""
    low = F.lower(c)
    pattern = F.when(low.rlike("star"), "star").when(low.rlike("criss-?cross"), "crisscross").when(low.rlike("circular|clockwise"), "circular").when(low.rlike("sequen"), "sequential")
    stages = F.transform(F.regexp_extract_all(low, F.lit(r"(\d+(?:\.\d+)?)\s*ft-lb"), F.lit(1)), lambda x: x.cast("double"))
    return F.struct(pattern.alias("pattern"), stages.alias("stages"), F.nullif(F.regexp_extract(low, r"(\d+)\s+bolts", 1), F.lit("")).cast("int").alias("bolts"))


def consumables(pages: DataFrame) -> DataFrame:
    """Consumables that a page names, hyphens ignored."""
    keys = [c for c in pages.columns if c != "body_text"]
    terms = r"(?i)\b(grease|oil|sealant|adhesive|anti-?seize|thread-?lock(?:er)?|solvent|rags?)\b"
    found = pages.select(*keys, F.explode(F.regexp_extract_all("body_text", F.lit(terms), F.lit(1))).alias("term"))
    return found.select(*keys, F.lower(F.regexp_replace("term", "-", "")).alias("term")).distinct()


def merged_synonyms(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Names and nicknames merged into groups by connected components. pairs: a, b; groups: group, term."""
    from lodestone.operators.graph import connected_components

    inner = groups.withColumn("first", F.min("term").over(Window.partitionBy("group"))).select(F.col("first").alias("a"), F.col("term").alias("b"))
    return connected_components(pairs.select("a", "b").union(inner)).select(F.col("node").alias("term"), F.col("component").alias("group"))


def sampled_text(pages: DataFrame, first: int = 5, cap: int = 20_000) -> DataFrame:
    """The first pages of a document as one text. pages: doc_id, page_number, body_text."""
    few = pages.where(F.col("page_number") <= first).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "body_text"))).alias("p"))
    return few.select("doc_id", F.substring(F.array_join(F.transform("p", lambda x: x["body_text"]), "\n"), 1, cap).alias("text"))


def orphans(children: DataFrame, documents: DataFrame) -> DataFrame:
    """M9: child rows whose document is gone."""
    return children.join(documents.select("doc_id"), "doc_id", "left_anti")


def fill_gaps(gaps: DataFrame, external: DataFrame) -> DataFrame:
    """External rows for the (niin, type) that are gaps, marked with where they come from."""
    return external.join(gaps.where("state = 'gap'").select("niin", "type"), ["niin", "type"], "left_semi").withColumn("source", F.lit("external"))


def add_groups(groups: DataFrame, new: DataFrame) -> DataFrame:
    """Keyword groups of two distinct terms or more, unless an equal set is held. Both: terms (array)."""
    key = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.lower(F.trim(x)))))
    fresh = new.select(key("terms").alias("terms")).where(F.size("terms") >= 2).distinct()
    return fresh.join(groups.select(key("terms").alias("terms")), "terms", "left_anti")
