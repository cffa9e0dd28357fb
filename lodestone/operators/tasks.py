"""Work by task: headings, procedures, services, standards, status, vendors and the index of parts. Pages are (doc_id, page, body_text)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.functions.codes import phrases
from lodestone.operators import blocks, extract as x

# Words in the headings of an operator's and of a mechanic's part of a manual.
OPERATOR = phrases(("operator", "operating", "operation", "operators instructions", "operators pmcs", "operators controls", "controls and indicators"))
MECHANIC = phrases(("unit maintenance", "organizational maintenance", "field maintenance", "direct support", "general support", "maintenance allocation chart", "repair parts", "rpstl", "troubleshooting", "schematic", "schematics"))
# Meanings of the variation and category codes of a part number's reference.
VARIATION = {"1": "exact", "2": "similar, may differ", "9": "several items"}
CATEGORY = {"1": "maker's part number", "3": "identifying number", "4": "specification or standard", "5": "informational", "6": "vendor design control", "C": "vendor item drawing", "D": "source control drawing"}
# Families of standards with their kind, and the items of common series.
FAMILIES = {
    "MS": "hardware-standard", "AN": "hardware-standard", "NAS": "hardware-standard", "NASM": "hardware-standard", "MIL-PRF": "performance-spec", "MIL-DTL": "detail-spec", "MIL-STD": "standard-practice", "MIL-SPEC": "specification",
    "MIL": "specification", "SAE": "commercial-standard", "ASTM": "material-standard", "AMS": "material-spec", "FED-STD": "standard-practice", "A-A": "commercial-item",
}
SERIES = {
    "AN960": "washer, flat", "AN970": "washer, flat (large OD)", "MS35338": "washer, lock (split)", "MS35340": "washer, lock (external tooth)", "MS51957": "screw, machine, pan head", "MS51922": "nut, self-locking", "MS21044": "nut, self-locking",
    "MS24665": "pin, cotter", "MS16562": "pin, spring", "MIL-PRF-2104": "engine oil (OE/HDO)", "MIL-PRF-2105": "gear oil (GO)", "MIL-PRF-46176": "brake fluid, silicone (BFS)", "MIL-PRF-10924": "grease (GAA)", "MIL-DTL-53072": "CARC coating system",
    "SAE-J429": "bolt/screw mechanical grades",
}
# Words of a fault that say nothing of it.
DULL = ("the", "and", "not", "with", "for", "this", "that", "from", "your", "you", "are", "was", "has", "will", "when", "what", "item", "check", "service", "vehicle", "fault", "faults", "damage", "work", "needed", "its")
# Kinds of procedures by their heading, the first match counts; headers and ends of lists.
KINDS = (("REMOV", "Removal"), ("INSTALL", "Installation"), ("DISASSEMBL", "Disassembly"), ("ASSEMBL", "Assembly"), ("REPLACE", "Replacement"), ("ADJUST", "Adjustment"), ("INSPECT", "Inspection"), ("CLEAN", "Cleaning"), ("REPAIR", "Repair"), ("SERVICE", "Service"))
HEADING = phrases(("removal", "installation", "disassembly", "assembly", "replacement", "adjustment", "repair", "service", "inspection", "cleaning"), start="^")
TOOLS = phrases(("tool required", "tools required", "tool and", "tools and", "special tools", "test equipment", "tmde"))
MATERIALS = phrases(("material parts", "materials parts", "material required", "materials required", "material list", "materials list", "expendable", "consumable", "supplies"), gap=r"[\s/]*", end="")
SECTIONS = ("personnel", "reference", "equipment", "warning", "caution", "note", "step")
AFTER_TOOLS = phrases(("material", "parts", *SECTIONS), start=r"^(?:\d|", end=")")
AFTER_MATERIALS = phrases(("tools", *SECTIONS), start=r"^(?:\d|", end=")")
CHECKS = phrases(("preventive maintenance checks", "checks and services", "pmcs"), gap=" ")
CHECK_VERB = phrases(("check", "inspect", "clean", "service", "lubricat", "tighten", "drain", "fill", "test", "verify", "ensure"))
CADENCE = {"before": ("before",), "during": ("during",), "after": ("after",), "weekly": ("weekly",), "monthly": ("monthly",), "annually": ("annual", "annually")}


def heading_side(body: Column) -> Column:
    """The side that the first 300 characters of a page name in a heading; null where none."""
    head = F.substring(body, 1, 300)
    op, me = head.rlike(OPERATOR), head.rlike(MECHANIC)
    return F.when(op & me, "both").when(op, "operator").when(me, "mechanic")


def status_suggestion(faults: DataFrame, pages: DataFrame, history: DataFrame) -> DataFrame:
    """NMCS where a page of the vehicle says 'mission capable' and has a term of the fault, else the commonest status of past faults with one.

    faults: fault_id, vehicle, text; pages: doc_id, page, vehicle, body_text; history: session, status, text. Terms are a fault's first six
    words of four characters or more; in past faults they count inside words too. Ties go to the first status by name."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))), lambda t: (F.length(t) >= 4) & ~t.isin(*DULL))
    terms = faults.select(F.col("fault_id").alias("qid"), F.col("vehicle").alias("label"), F.slice(words, 1, 6).alias("terms")).where((F.size("terms") > 0) & F.col("fault_id").isNotNull())
    each = lambda by: terms.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))  # noqa: E731 (a fault that is given twice has the terms of both)
    said = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).contains(" mission capable ")
    # the body is looked through before its words are cut
    near = pages.where(F.lower("body_text").contains("mission") & F.lower("body_text").contains("capable") & F.col("vehicle").isNotNull() & F.col("doc_id").isNotNull() & F.col("page").isNotNull())
    cut = near.select("doc_id", "page", "vehicle", F.explode(F.array(F.regexp_extract_all(F.lower("body_text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w")).where(said)
    there = cut.select(F.col("vehicle").alias("label"), F.col("doc_id").alias("a"), F.col("page").alias("b"), F.array_distinct("w").alias("terms"))
    evidence = blocks.any_of(there, each(["qid", "label"]), labelled=True).groupBy(F.col("qid").alias("fault_id")).agg(F.sum("n").alias("n_pages"), F.min(F.struct(F.col("a").alias("doc_id"), F.col("b").alias("page"))).alias("first"))
    past = history.where("trim(status) <> '' AND session IS NOT NULL").select(F.upper(F.trim("status")).alias("label"), F.col("session").alias("a"), F.lit(0).alias("b"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0))).alias("terms"))
    votes = blocks.any_of(past.where("size(terms) > 0"), each(["qid"]).withColumn("label", F.lit("")), inside=True)
    best = votes.groupBy(F.col("qid").alias("fault_id")).agg(F.min(F.struct((-F.col("n")).alias("least"), F.col("label").alias("status"))).alias("b"))
    met = faults.select("fault_id").join(evidence, "fault_id", "left").join(best, "fault_id", "left")
    basis = F.when(F.col("n_pages").isNotNull(), "pages").when(F.col("b").isNotNull(), "history")
    return met.select("fault_id", F.when(F.col("n_pages").isNotNull(), "NMCS").otherwise(F.col("b.status")).alias("suggestion"), basis.alias("basis"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.col("first.doc_id").alias("doc_id"), F.col("first.page").alias("page"))


def reference_confidence(references: DataFrame, makers: DataFrame) -> DataFrame:
    """Each part number of an item with its codes in words, whether it is exact, and whether its maker is active (null: not known).

    references: niin, part_number, cagec, rncc, rnvc; makers: cagec, company, status, the first company by name where there are several."""
    one = makers.groupBy("cagec").agg(F.min(F.struct("company", "status")).alias("m")).select("cagec", "m.*")
    status = F.upper(F.trim("status"))
    met = references.join(one, "cagec", "left")
    return met.select("niin", "part_number", "cagec", "company", x.lookup(VARIATION, F.trim("rnvc")).alias("variation"), x.lookup(CATEGORY, F.trim("rncc")).alias("category"), F.coalesce(F.trim("rnvc") == "1", F.lit(False)).alias("exact"), F.when(status != "", status.isin("A", "H")).alias("active"))


def vendor_status(confidence: DataFrame) -> DataFrame:
    """Of each item the number of its makers, of those active, and whether any is (null: none is known)."""
    known = confidence.where("cagec <> ''").select("niin", "cagec", "active").distinct()
    return known.groupBy("niin").agg(F.count(F.lit(1)).alias("n_vendors"), F.count_if("active").alias("n_active"), F.max("active").alias("any_active"))


def procedures(pages: DataFrame) -> DataFrame:
    """Kind, title, steps, tools, materials, references and cautions of each page that has steps or tools. A page is a row.

    A list runs from its header to a blank line or the start of another section. A page's lines are read in its row, so that none is exchanged or
    sorted; what is carried from line to line is whether a list is open, and what was found, up to its cap."""
    step = lambda df, name, value: df.select("doc_id", "page", F.explode(F.array(value)).alias(name))  # noqa: E731 (explode of one value: it is computed once)
    bare = step(pages.where("body_text IS NOT NULL"), "bare", F.transform(F.split("body_text", "\n"), lambda x: F.trim(x)))
    seen = step(bare, "seen", F.transform("bare", lambda x, i: F.struct(x.alias("line"), F.upper(x).alias("up"), F.coalesce(F.get(F.col("bare"), i + 1), F.lit("")).alias("next"))))

    def heads(x: Column) -> Column:
        return F.struct(x.alias("of"), ((F.length(x["line"]) <= 24) & x["up"].rlike(HEADING)).alias("head"), x["up"].rlike(TOOLS).alias("tools"), x["up"].rlike(MATERIALS).alias("materials"))

    def marks(x: Column) -> Column:
        line, up = x["of"]["line"], x["of"]["up"]
        header = x["tools"] | x["materials"]
        alert = F.regexp_extract(up, r"^(WARNING|CAUTION|NOTE|DANGER)\b", 1)
        said = F.when(line.contains(":"), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1))).otherwise(x["of"]["next"])
        return F.struct(
            F.when(x["head"], line).alias("title"), F.when(~header & (F.length(line) > 2), F.substring(line, 1, 80)).alias("item"),
            F.when(x["tools"], True).when(x["materials"] | (line == "") | up.rlike(AFTER_TOOLS), False).alias("in_tools"),
            F.when(x["tools"], False).when(x["materials"], True).when((line == "") | up.rlike(AFTER_MATERIALS), False).alias("in_materials"),
            F.when(~header, F.nullif(F.substring(F.regexp_extract(line, r"^\d{1,3}[.)]\s+(.{5,})", 1), 1, 300), F.lit(""))).alias("step"),
            F.regexp_extract_all(up, F.lit(r"\b((?:TM|WP|LO|TB|TC)\s?\d[\dA-Z-]{2,})"), F.lit(1)).alias("refs"), F.when(alert != "", F.concat(alert, F.lit(": "), F.substring(said, 1, 160))).alias("caution"),
        )

    marked = step(step(seen, "heads", F.transform("seen", heads)), "marks", F.transform("heads", marks))
    none, texts = F.lit(None).cast("string"), F.array().cast("array<string>")
    start = F.struct(none.alias("title"), F.lit(False).alias("in_tools"), F.lit(False).alias("in_materials"), *[texts.alias(n) for n in ("steps", "tools", "materials", "refs", "cautions")])

    def more(acc: Column, x: Column) -> Column:
        kept = lambda n, what, cap: F.when(what.isNotNull() & (F.size(acc[n]) < cap), F.concat(acc[n], F.array(what))).otherwise(acc[n]).alias(n)
        tools, materials = F.coalesce(x["in_tools"], acc["in_tools"]), F.coalesce(x["in_materials"], acc["in_materials"])
        refs = F.when((F.size(x["refs"]) > 0) & (F.size(acc["refs"]) < 12), F.slice(F.array_distinct(F.concat(acc["refs"], x["refs"])), 1, 12)).otherwise(acc["refs"])
        return F.struct(
            F.coalesce(acc["title"], x["title"]).alias("title"), tools.alias("in_tools"), materials.alias("in_materials"), kept("steps", x["step"], 40),
            kept("tools", F.when(tools, x["item"]), 25), kept("materials", F.when(materials, x["item"]), 20), refs.alias("refs"), kept("cautions", x["caution"], 12),
        )

    per = step(marked, "r", F.aggregate("marks", start, more)).select("doc_id", "page", "r.*")
    kind = F.lit("Procedure")
    for part, label in reversed(KINDS):
        kind = F.when(F.upper("title").contains(part), label).otherwise(kind)
    found = per.where((F.size("steps") > 0) | (F.size("tools") > 0))
    return found.select("doc_id", "page", kind.alias("kind"), F.coalesce("title", F.lit("")).alias("title"), "steps", "tools", "materials", F.col("refs").alias("references"), "cautions")


def service_pages(pages: DataFrame) -> DataFrame:
    """Pages of checks and services: the intervals that they name, up to 12 different check items, and what stands around the first mention."""
    up = F.upper("body_text")
    named = F.filter(F.array(*[F.when(up.rlike(phrases(w)), F.lit(label)) for label, w in CADENCE.items()]), lambda v: v.isNotNull())
    rows = F.filter(F.transform(F.split("body_text", r"[\r\n]+"), lambda v: F.trim(v)), lambda v: (F.length(v) >= 6) & (F.length(v) <= 180) & (v.rlike(r"^\d{1,3}[.)]\s+\S") | v.rlike(CHECK_VERB)))
    items = F.transform(rows, lambda v: F.trim(F.regexp_replace(v, r"^\d{1,3}[.)]\s+", "")))
    key = lambda v: F.lower(F.substring(v, 1, 50))
    first = F.filter("all_items", lambda v, i: F.array_position("keys", key(v)) == i + 1)
    where = F.greatest(F.regexp_instr("body_text", F.lit(CHECKS)) - 41, F.lit(0)) + 1
    hit = pages.where(F.col("body_text").rlike(CHECKS)).withColumn("all_items", items).withColumn("keys", F.transform("all_items", key))
    around = F.trim(F.regexp_replace(F.substring("body_text", where, F.lit(240)), r"\s+", " "))
    return hit.select("doc_id", "page", named.alias("intervals"), F.transform(F.slice(first, 1, 12), lambda v: F.substring(v, 1, 160)).alias("items"), around.alias("snippet"))


def standards(pages: DataFrame, cap: int = 60, items: dict[str, str] = SERIES) -> DataFrame:
    """The different designations of a page, up to `cap`, with family, series, kind and, for the series of `items`, the item.

    A revision letter after a common series names the same item; another digit doesn't."""
    families = "|".join(sorted(FAMILIES, key=len, reverse=True))
    piece = "[0-9A-Z]"
    pattern = rf"\b({families})[-\s]?(\d{piece}*(?:[-/]{piece}+)*)\b"
    found = pages.select("doc_id", "page", F.explode(F.slice(F.array_distinct(F.regexp_extract_all("body_text", F.lit(pattern), F.lit(0))), 1, cap)).alias("token"))
    family, number = F.regexp_extract("token", pattern, 1), F.regexp_extract("token", pattern, 2)
    series = F.when(family.isin("MS", "AN", "NAS", "NASM"), F.concat(family, F.regexp_extract(number, "^[^-/]*", 0))).when(family.startswith("MIL") | family.isin("SAE", "ASTM", "AMS"), F.concat_ws("-", family, F.substring_index(number, "/", 1))).otherwise(F.concat(family, number))
    out = found.select("doc_id", "page", "token", family.alias("family"), series.alias("series"))
    return out.withColumn("kind", x.lookup(FAMILIES, F.col("family"))).withColumn("item", F.coalesce(x.lookup(items, F.col("series")), x.lookup(items, F.regexp_replace("series", "[A-Z]$", ""))))


def abbreviations_used(pages: DataFrame, cap: int = 200, glossaries: DataFrame | None = None) -> DataFrame:
    """Of each document the abbreviations that it explains itself (last explanation wins), with how often it uses them, commonest first.

    glossaries: the pages that explain, where not every page is taken to; a sentence that begins like an explanation is none then."""
    meant = x.glossary(pages if glossaries is None else glossaries).groupBy("doc_id", "abbreviation").agg(F.max_by("meaning", F.struct("page", "line_no")).alias("meaning"))
    used = pages.select("doc_id", F.explode(F.regexp_extract_all("body_text", F.lit(r"\b([A-Z][A-Z0-9]{1,7})\b"), F.lit(1))).alias("abbreviation")).groupBy("doc_id", "abbreviation").agg(F.count(F.lit(1)).alias("n"))
    ranked = meant.join(used, ["doc_id", "abbreviation"]).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "abbreviation")))
    return ranked.where(F.col("rank") <= cap)


def parts_index(pages: DataFrame, barcodes: DataFrame, most: int = 5) -> DataFrame:
    """The stock numbers of parts-list pages with the figure last named before their first mention, and the decoded barcodes of a page.

    barcodes: doc_id, page, nsn. A barcode conflicts with a page that has one to `most` stock numbers, none of them it."""
    marks = F.regexp_extract_all("body_text", F.lit(r"(?i)\bFIG(?:URE)?\.?\s*\d+|\b\d{4}-\d{2}-\d{3}-\d{4}\b"), F.lit(0))
    seen = pages.select("doc_id", "page", F.posexplode(marks).alias("line_no", "mark"))
    fig, nsn = F.nullif(F.regexp_extract("mark", r"(?i)^FIG\D*(\d+)$", 1), F.lit("")), F.when(~F.upper("mark").startswith("FIG"), F.col("mark"))
    run = x.carry(seen.select("doc_id", "page", "line_no", fig.alias("fig_no"), nsn.alias("nsn")), "fig_no").where("nsn IS NOT NULL")
    text = run.groupBy("doc_id", "page", "nsn").agg(F.min(F.struct("line_no", "fig_no")).alias("f")).select("doc_id", "page", "nsn", "f.fig_no")
    per = text.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    mine = barcodes.select("doc_id", "page", "nsn").distinct().join(text.select("doc_id", "page", "nsn", F.lit(True).alias("same")), ["doc_id", "page", "nsn"], "left").join(per, ["doc_id", "page"], "left")
    odd = F.col("same").isNull() & F.coalesce(F.col("n") <= most, F.lit(False))
    return text.select("*", F.lit("text").alias("origin"), F.lit(False).alias("conflict")).union(mine.select("doc_id", "page", "nsn", F.lit(None).cast("string"), F.lit("barcode"), odd))


def task_summary(tasks: DataFrame, parts: DataFrame, found: DataFrame, measured: DataFrame) -> DataFrame:
    """Of each task where its part appears, in how many documents and stock numbers, whether these look alike, and the procedures and dimension types there.

    tasks: task, name; parts: name, nsn, niin, document_id; found: procedures(); measured: niin, type."""
    seen = tasks.join(parts, "name")
    per = seen.groupBy("task").agg(F.count(F.lit(1)).alias("appearances"), F.count_distinct("document_id").alias("documents"), F.count_distinct("nsn").alias("n_nsn"))
    sizes = found.groupBy(F.col("doc_id").alias("document_id")).agg(F.count(F.lit(1)).alias("procedures"), *[F.sum(F.size(c)).alias(c) for c in ("steps", "tools", "materials", "cautions")])
    counts = ("procedures", "steps", "tools", "materials", "cautions")
    there = seen.select("task", "document_id").distinct().join(sizes, "document_id").groupBy("task").agg(*[F.sum(c).alias(c) for c in counts])
    types = seen.select("task", "niin").distinct().join(measured.select("niin", "type").distinct(), "niin").groupBy("task").agg(F.count_distinct("type").alias("dimension_types"))
    met = tasks.select("task").distinct().join(per, "task", "left").join(there, "task", "left").join(types, "task", "left").na.fill(0)
    return met.withColumn("look_alikes", F.col("n_nsn") > 1)


def run_extractors(pages: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]], only: set[str] | None = None) -> DataFrame:
    """The rows of the extractors that are switched on, by the name of their stage; columns that one lacks are null. The caller brings the extractors."""
    chosen = [f(pages).withColumn("stage", F.lit(name)) for name, f in extractors.items() if only is None or name in only]
    if not chosen:
        return pages.limit(0).withColumn("stage", F.lit(""))
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def foreign(pages: DataFrame, extract: Callable[[str], Iterable[tuple]], columns: str, text: str = "body_text") -> DataFrame:
    """An extractor of the caller's own, in plain Python, as a table function: each text (null: empty) to any number of rows of `columns`
    (names and Spark types), beside the page's other columns. Texts reach it in Arrow batches where the pages lie; nothing is exchanged.

    Its result can stand wherever a measurement function is asked for."""
    keys = [c for c in pages.columns if c != text]
    schema = StructType([*pages.select(*keys).schema.fields, *pages.sparkSession.createDataFrame([], columns).schema.fields])
    named = schema.names[len(keys):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                for row in extract(t or ""):
                    at.append(i)
                    rows.append(row)
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys]
            made = [pa.array([r[j] for r in rows], kinds.field(n).type) for j, n in enumerate(named)]
            yield pa.RecordBatch.from_arrays([*own, *made], schema.names)

    return pages.select(*keys, text).mapInArrow(run, schema)
