"""Facts from page text, and what is consolidated from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions import codes, units
from lodestone.sources.scratch import small

#: Mark where a measurement was found, and part it from its numbers and its unit; no characters of text.
_MARK, _PART = "\x01", "\x02"
#: Characters of text on either side that a measurement is kept with, pieces of text that hold as many, and characters kept in all.
_AROUND, _PIECES, _CONTEXT = 45, 40, 160


def _read(at: Column, context: bool) -> Column:
    """The measurement at a place of `parts`, and what stands around it; nothing around it where it is the page's only one and nobody asks."""
    cut = F.split(F.element_at("parts", at), _PART)
    joined = lambda lo, n: F.array_join(F.transform(F.slice("parts", lo, n), lambda p: F.substring_index(p, _PART, 1)), "")
    first = F.greatest(at - _PIECES, F.lit(1))
    near = F.concat(F.right(joined(first, at - first), F.lit(_AROUND)), cut[0], F.left(joined(at + 1, F.lit(_PIECES)), F.lit(_AROUND)))
    around = F.substring(F.trim(F.regexp_replace(near, r"\s+", " ")), 1, _CONTEXT)
    around = around if context else F.when(F.size("parts") > 3, around)
    return F.struct(F.trim(cut[0]).alias("raw"), around.alias("context"), *[cut[i].alias(n) for i, n in enumerate(("value", "value2", "tolerance", "spelling"), 1)])


def _named(x: Column) -> Column:
    return F.struct(x.alias("read"), units.resolve(x["spelling"]).alias("is"))


def _taken(x: Column) -> Column:
    read, unit = x["read"], x["is"]["unit"]
    glued = unit.isin("degF", "degC") & (F.length(read["spelling"]) == 1) & ~read["raw"].rlike(r"\s\w$")
    return unit.isNotNull() & ~(unit.isin(*units.BARE) & read["raw"].contains("\n")) & ~glued


def _same(x: Column) -> Column:
    return F.concat(F.lower(x["read"]["raw"]), F.lit(_MARK), F.substring(x["read"]["context"], 1, 30))


def measurements(pages: DataFrame, cap: int = 200, text: str = "body_text", context: bool = False) -> DataFrame:
    """(document_id, page, ...) to one row a measurement: type, value, value2, tolerance, unit; with `context`, also `raw`, what was
    read, and `context`, what stands around it. The first `cap` of each page.

    A unit of one letter is only taken on the number's own line, and F or C alone only after a blank. What is
    read twice with the same words before it counts once."""
    keys = [c for c in pages.columns if c != text]
    # explode of one value: what it holds is computed once, and filters aren't copied down into it
    step = lambda df, name, value: df.select(*keys, F.explode(F.array(value)).alias(name))
    # one pass over the text: what is between the marks is text, measurement, text, ...; a measurement is itself, its numbers and its unit
    groups = _PART.join(f"${i}" for i in range(5))
    marked = F.regexp_replace(F.translate(F.col(text), _MARK + _PART, ""), units.MEASURE, f"{_MARK}{groups}{_MARK}")
    cut = step(pages, "parts", F.split(marked, _MARK)).where(F.size("parts") > 1)
    found = step(cut, "found", F.transform(F.sequence(F.lit(2), F.size("parts") - 1, F.lit(2)), lambda at: _read(at, context)))
    named = step(found, "named", F.filter(F.transform("found", _named), lambda x: _taken(x)))
    # a page's only measurement is held against no other
    once = step(named, "once", F.struct("named", F.when(F.size("named") > 1, F.transform("named", _same)).alias("keys")))
    different = F.filter("once.named", lambda x, i: F.array_position("once.keys", _same(x)) == i + 1)
    rows = F.slice(F.when(F.size("once.named") > 1, different).otherwise(F.col("once.named")), 1, cap)
    out = once.select(*keys, F.posexplode(rows).alias("place", "r"))
    number = lambda c: F.nullif(F.replace(F.col(f"r.read.{c}"), F.lit(","), F.lit("")), F.lit("")).cast("double").alias(c)
    more = [F.substring("r.read.raw", 1, 60).alias("raw"), F.col("r.read.context").alias("context")] if context else []
    return out.select(*keys, "place", F.col("r.is.type").alias("type"), number("value"), number("value2"), number("tolerance"), F.col("r.is.unit").alias("unit"), *more)


def stated_types(pages: DataFrame, subject: str = "niin", text: str = "body_text") -> DataFrame:
    """subject, type, each once: the types of what measurements() finds on the pages of each subject. Texts that are equal are measured once."""
    digest = F.sha2(text, 256).alias("of_")
    texts = pages.where(F.col(text).isNotNull()).select(text).distinct().select(digest, text)
    known = small(measurements(texts, text=text).select("of_", "type").distinct(), "types")
    return pages.select(subject, digest).join(known, "of_").select(subject, "type").distinct()


def gated(facts: DataFrame) -> DataFrame:
    """Facts with their quality status and why. `raw`, what was read, is judged too where there is such a column."""
    # a number that is written out has no letters and one point at most; only its length can be wrong, and only that of a long one is looked at
    long = F.when(F.abs("value") >= 9_999_999.5, F.format_string("%.0f", "value"))
    given = F.regexp_extract("raw", rf"^({units.NUMBER})", 1) if "raw" in facts.columns else long
    return facts.withColumns({"status": codes.value_gate(F.col("type"), F.col("value"), given), "reason": codes.gate_reason(F.col("type"), F.col("value"), given)})


def consolidate(facts: DataFrame, subject: str = "niin", external: DataFrame | None = None, once_a_page: bool = True) -> DataFrame:
    """One row a subject, type, unit and origin: median, or where nothing is a number the commonest text (`given`, the first of equals),
    with low, high and count. A value counts once for each document and page of the corpus (without `once_a_page`: as often as it is stated);
    external rows, each for itself, only where the corpus has nothing of the type.

    facts: subject, type, unit, document_id, page, value and, where there are texts, given."""
    text = lambda df: F.col("given") if "given" in df.columns else F.lit(None).cast("string")
    once = facts.select(subject, "type", "unit", "document_id", "page", "value", text(facts).alias("given"))
    once = (once.distinct() if once_a_page else once).withColumn("origin", F.lit("corpus"))
    if external is not None:
        once = once.unionByName(external.select(subject, "type", "unit", "value", text(external).alias("given"), F.lit("external").alias("origin")), allowMissingColumns=True)
    group = [subject, "type", "unit", "origin"]
    per = once.groupBy(*group, "value", "given").agg(F.count(F.lit(1)).alias("times"))
    if external is not None:
        # the corpus is read once: whether it has a type is seen among the counted rows
        has = F.max(F.col("origin") == "corpus").over(Window.partitionBy(subject, "type"))
        per = per.withColumn("has", has).where((F.col("origin") == "corpus") | ~F.col("has"))
    numbers = F.when(F.count("value") > 0, F.round(F.expr("percentile(value, 0.5D, times)"), 6))
    kept = per.groupBy(*group).agg(numbers.alias("value"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("times").alias("n"), F.min_by("given", F.struct(-F.col("times"), "given")).alias("text"))
    return kept.withColumn("text", F.when(F.col("value").isNull(), F.col("text")))


def dimension_sheet(master: DataFrame) -> DataFrame:
    """Consolidated rows in both systems of units, with their spread and confidence. What only external sources say is low."""
    wide = (F.col("high") > F.col("low")) & (F.col("high") - F.col("low") > 0.25 * F.abs(F.coalesce(F.nullif("value", F.lit(0.0)), F.lit(1.0)))) & (F.col("n") > 1)
    wide = F.coalesce(wide, F.lit(False))
    confidence = F.when(F.col("origin") != "corpus", "low").when(wide, "review").when(F.col("n") >= 2, "high").otherwise("medium")
    return master.select("*", units.dual(F.col("value"), F.col("unit")).alias("alt"), units.system(F.col("unit")).alias("system"), F.when(wide, "wide").otherwise("").alias("spread"), confidence.alias("confidence"))


def type_coverage(master: DataFrame, subject: str = "niin", types: tuple[str, ...] = units.TYPES) -> DataFrame:
    """Of each subject how many dimension types it has, its corpus and external rows, and the types that it lacks."""
    per = master.groupBy(subject).agg(F.collect_set("type").alias("have"), F.count_if(F.col("origin") == "corpus").alias("corpus"), F.count_if(F.col("origin") != "corpus").alias("external"))
    return per.select(subject, F.size("have").cast("long").alias("n"), "corpus", "external", F.array_join(F.array_except(F.array(*map(F.lit, types)), "have"), ",").alias("missing"))


def gaps(facts: DataFrame, subject: str = "niin", types: tuple[str, ...] = units.TYPES) -> DataFrame:
    """Per subject and type: gap, inconclusive (one value) or present. One aggregate a subject; the types are a fixed list."""
    n = facts.groupBy(subject, "type").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy(subject).agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("has"))
    each = per.select(subject, "has", F.explode(F.array(*map(F.lit, types))).alias("type"))
    had = F.coalesce(F.try_element_at("has", F.col("type")), F.lit(0))
    return each.select(subject, "type", F.when(had == 0, "gap").when(had == 1, "inconclusive").otherwise("present").alias("state"))


#: Types of which a disagreement may be dangerous.
DANGEROUS = ("torque", "pressure", "electrical", "force")


def _disagreement(facts: DataFrame, subject: str) -> DataFrame:
    """Of each subject, type and unit the number of facts, and what those that the gate doesn't quarantine say: low, high, different values and documents. The facts are read once."""
    # explode of one value: the gate judges a fact once
    seen = gated(facts).select(subject, "type", "unit", "document_id", F.explode(F.array(F.when(F.col("status") != "quarantine", F.col("value")))).alias("value"))
    rounded = seen.select(subject, "type", "unit", "value", F.round("value", 6).alias("v"), F.when(F.col("value").isNotNull(), F.col("document_id")).alias("document"))
    return rounded.groupBy(subject, "type", "unit").agg(F.count(F.lit(1)).alias("times"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("v").alias("n_values"), F.count_distinct("document").alias("n_docs"))


def _conflicting(x, tolerance: float, min_docs: int) -> Column:
    """x: a row of `_disagreement`, as a frame or a struct."""
    return (x["n_values"] >= 2) & (x["high"] > 0) & ((x["high"] - x["low"]) / x["high"] > tolerance) & (x["n_docs"] >= min_docs)


def _odd(per: DataFrame, subject: str, tolerance: float, min_docs: int) -> DataFrame:
    return per.where(_conflicting(per, tolerance, min_docs)).select(subject, "type", "unit", "low", "high", "n_values", "n_docs", F.when(F.col("type").isin(*DANGEROUS), "high").otherwise("medium").alias("severity"))


def conflicts(facts: DataFrame, subject: str = "niin", tolerance: float = 0.05, min_docs: int = 2) -> DataFrame:
    """Subjects whose documents disagree on a dimension, for all subjects in one job. What the gate quarantines doesn't count."""
    return _odd(_disagreement(facts, subject), subject, tolerance, min_docs)


def conflict_sweep(facts: DataFrame, most: int = 2000, subject: str = "niin", tolerance: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The conflicts of the `most` subjects that occur most often, and one row for the log: how many were checked, and what was found.

    A subject's row holds its types and units, as many as there are of these, so that facts are read once for their number and for what they say."""
    said = F.collect_list(F.struct("type", "unit", "low", "high", "n_values", "n_docs"))
    top = _disagreement(facts, subject).groupBy(subject).agg(F.sum("times").alias("n"), said.alias("said")).orderBy(F.desc("n"), subject).limit(most)
    found = _odd(top.select(subject, F.inline("said")), subject, tolerance, 2)
    # the log has its row where nothing was found, too: the subjects are counted beside their conflicts
    had = F.filter("said", lambda x: _conflicting(x, tolerance, 2))
    dangerous = F.filter(had, lambda x: x["type"].isin(*DANGEROUS))
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    log = top.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.size(had) > 0).alias("subjects"), total(had).alias("conflicts"), total(dangerous).alias("high"))
    return found, log


def agreement(facts: DataFrame, method: str = "source_id", tolerance: float = 0.03) -> DataFrame:
    """Do methods agree: single method, confirmed or conflict, with the upper median, the counts, and trust.

    A value's times are counted for each method before values come together, so that facts are read once and a group holds its different values and methods only."""
    group = ["niin", "type", "unit"]
    per = facts.groupBy(*group, "value", F.col(method).alias("method")).agg(F.count(F.lit(1)).alias("times"))
    placed = per.withColumn("upto", F.sum("times").over(Window.partitionBy(*group).orderBy("value"))).withColumn("n", F.sum("times").over(Window.partitionBy(*group)))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("value")))
    whole = placed.groupBy(*group).agg(F.count_distinct("method").alias("methods"), F.sum("times").alias("n"), middle.alias("consensus"), F.min("value").alias("low"), F.max("value").alias("high"))
    spread = (F.col("high") - F.col("low")) / F.greatest("high", F.lit(1e-9))
    verdict = F.when(F.col("methods") < 2, "single method").when(spread <= tolerance, "confirmed").otherwise("conflict")
    trust = F.when(verdict == "confirmed", "high").when(verdict == "conflict", "review").otherwise("medium")
    return whole.select(*group, "methods", "n", "consensus", verdict.alias("verdict"), trust.alias("trust"))


def suppressed(external: DataFrame, corpus: DataFrame, by: list[str] | None = None) -> DataFrame:
    """External rows only where the corpus has none for (niin, type)."""
    by = by or ["niin", "type"]
    return external.join(corpus.select(*by), by, "left_anti")


def callouts(pages: DataFrame, text: str = "body_text") -> DataFrame:
    """DANGER, WARNING, CAUTION and NOTE blocks, up to 260 characters each."""
    keys = [c for c in pages.columns if c != text]
    pattern = r"(?s)\b(DANGER|WARNING|CAUTION|NOTE)\b[:\s]*((?:(?!\b(?:DANGER|WARNING|CAUTION|NOTE)\b).){1,260})"
    found = pages.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("raw"))
    body = F.trim(F.regexp_extract("raw", pattern, 2))
    severity = F.regexp_extract("raw", pattern, 1)
    rank = F.array_position(F.array(*map(F.lit, ("NOTE", "CAUTION", "WARNING", "DANGER"))), severity).cast("int")
    return found.select(*keys, severity.alias("severity"), rank.alias("rank"), body.alias("body")).where(F.length("body") >= 4)


def by_severity(found: DataFrame) -> DataFrame:
    """Callouts by severity."""
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def intervals(pages: DataFrame, text: str = "body_text") -> DataFrame:
    """Service intervals as value, unit and days (hours by 24, miles by 30 a day)."""
    keys = [c for c in pages.columns if c != text]
    pattern = r"(?i)\bevery\s+(\d+)\s+(hours?|days?|weeks?|months?|miles?)"
    found = pages.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("raw"))
    value, unit = F.regexp_extract("raw", pattern, 1).cast("double"), F.regexp_replace(F.lower(F.regexp_extract("raw", pattern, 2)), "s$", "")
    days = F.create_map(*[F.lit(x) for p in (("hour", 1 / 24), ("day", 1.0), ("week", 7.0), ("month", 30.0), ("mile", 1 / 30)) for x in p])
    return found.select(*keys, value.alias("value"), unit.alias("unit"), F.round(value * days[unit], 6).alias("days"))


def torques(pages: DataFrame, text: str = "body_text") -> DataFrame:
    """Torque values of sentences that say torque or tighten."""
    keys = [c for c in pages.columns if c != text]
    said = pages.select(*keys, F.explode(F.split(text, r"(?<=[.!?])\s+")).alias(text)).where(F.lower(text).rlike("torque|tighten"))
    return measurements(said, text=text).where("type = 'torque'").drop("place")


def fluids(pages: DataFrame, text: str = "body_text") -> DataFrame:
    """Fluid and capacity of filling instructions."""
    keys = [c for c in pages.columns if c != text]
    pattern = r"(?i)\bfill the ([\w ]+?) with (\d+(?:\.\d+)?) (qt|gal|pt) of (\w+)"
    got = pages.withColumn("hit", F.regexp_extract(text, pattern, 0)).where("hit <> ''")
    part = lambda i: F.regexp_extract("hit", pattern, i)
    return got.select(*keys, part(1).alias("system"), part(2).cast("double").alias("capacity"), part(3).alias("unit"), F.lower(part(4)).alias("fluid"))


def assess(measured: DataFrame, limits: DataFrame, margin: float = 0.03) -> DataFrame:
    """Go, marginal or no-go of each measured value against its limits (low, high), by unit."""
    met = measured.join(limits, ["niin", "type", "unit"])
    out = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    near = (F.col("value") < F.col("lo") * (1 + margin)) | (F.col("value") > F.col("hi") * (1 - margin))
    return met.withColumn("verdict", F.when(out, "no-go").when(near, "marginal").otherwise("go"))


def boilerplate(pages: DataFrame, share: float = 0.4, min_pages: int = 5) -> DataFrame:
    """Line forms (digits as #) that stand on a large share of a document's pages. `pages`: doc_id, page_number, body_text."""
    total = pages.groupBy("doc_id").agg(F.count_distinct("page_number").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    form = F.regexp_replace(F.lower(F.trim("body_text")), r"\d", "#")
    seen = pages.select("doc_id", "page_number", form.alias("form")).where("form <> ''").groupBy("doc_id", "form").agg(F.count_distinct("page_number").alias("n"))
    return seen.join(total, "doc_id").where(F.col("n") >= F.greatest(F.lit(min_pages * share), share * F.col("n_pages"))).select("doc_id", "form", "n", "n_pages")


def sections(heads: DataFrame) -> DataFrame:
    """Headings (document_id, page, side) to ranges: neighbours of one side merged, each up to the next."""
    order = Window.partitionBy("document_id").orderBy("page")
    marked = heads.withColumn("new", F.when(F.lag("side").over(order) == F.col("side"), 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    runs = marked.groupBy("document_id", "island", "side").agg(F.min("page").alias("start"), F.max("page").alias("last"))
    nxt = F.lead("start").over(Window.partitionBy("document_id").orderBy("start"))
    return runs.withColumn("end", F.coalesce(nxt - 1, F.col("last"))).select("document_id", "side", "start", "end")
