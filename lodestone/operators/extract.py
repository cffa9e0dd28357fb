"""Facts from lines: glossaries, pinouts, charts, parts lines, limits, codes. Pages are (doc_id, page, body_text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Meanings of source, maintenance and recoverability code letters.
SMR_SOURCE = {"PA": "procured and stocked", "PB": "procured, insurance stock", "PC": "procured, deteriorates", "PD": "support equipment", "KD": "kit, depot", "KF": "kit, field", "MO": "made at unit", "MF": "made at field", "AO": "assembled at unit", "AF": "assembled at field", "XA": "next higher assembly", "XB": "salvage", "XC": "drawing", "XD": "no stock, order"}
SMR_LEVEL = {"C": "crew", "O": "unit", "F": "field", "H": "below depot", "L": "special activity", "D": "depot"}
SMR_RECOVER = {"Z": "discard", "O": "unit", "F": "field", "H": "below depot", "D": "depot", "L": "special activity", "A": "special handling"}
STANDARDS = {"MS": "military standard", "AN": "army-navy", "NAS": "national aerospace standard", "MIL": "military specification", "ASTM": "ASTM", "SAE": "SAE", "ISO": "ISO", "DIN": "DIN"}
COLOURS = {"BLK": "black", "WHT": "white", "RED": "red", "GRN": "green", "BLU": "blue", "YEL": "yellow", "ORN": "orange", "BRN": "brown", "GRY": "gray", "VIO": "violet"}
MATERIALS = (("STAINLESS", "stainless steel"), ("ALUMINUM", "aluminum"), ("BRASS", "brass"), ("RUBBER", "rubber"), ("NYLON", "nylon"), ("STEEL", "steel"), ("COPPER", "copper"))


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def lines(pages: DataFrame) -> DataFrame:
    keys = [c for c in pages.columns if c != "body_text"]
    return pages.select(*keys, F.posexplode(F.split("body_text", "\n")).alias("line_no", "line"))


def carry(found: DataFrame, column: str) -> DataFrame:
    """The last value of a column down the lines of a page."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.withColumn(column, F.last(column, ignorenulls=True).over(w))


def _get(pattern: str, i: int, c: str = "line") -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def glossary(pages: DataFrame) -> DataFrame:
    """I4: 'ABBR - full form' lines."""
    p = r"^\s*([A-Z][A-Z0-9/&]{1,9})\s*[-–.:]+\s*([A-Za-z].{2,80}?)\s*$"
    return lines(pages).select("doc_id", "page", "line_no", _get(p, 1).alias("abbreviation"), _get(p, 2).alias("meaning")).where("abbreviation IS NOT NULL")


def global_glossary(found: DataFrame) -> DataFrame:
    """The first definition of each abbreviation by document, page and line."""
    return found.groupBy("abbreviation").agg(F.min_by("meaning", F.struct("doc_id", "page", "line_no")).alias("meaning"), F.count(F.lit(1)).alias("n"))


def expand(queries: DataFrame, known: DataFrame) -> DataFrame:
    """Queries (qid, text) with the full forms of their abbreviations appended."""
    words = queries.select("qid", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][A-Z0-9]{1,7}\b"), F.lit(0)))).alias("abbreviation"))
    added = words.join(known, "abbreviation").groupBy("qid").agg(F.array_sort(F.collect_set("meaning")).alias("m"))
    return queries.join(added, "qid", "left").select("qid", F.concat_ws(" ", "text", F.array_join("m", " ")).alias("text"))


def pinouts(pages: DataFrame) -> DataFrame:
    """Pins under the connector last named, with their colours (primary/stripe) decoded."""
    head, pin = r"^\s*CONNECTOR\s+([A-Z]+\d+)", r"^\s*PIN\s+(\w+)\s+([\w -]+?)\s+([A-Z]{3}(?:/[A-Z]{3})?)\s*$"
    found = lines(pages).select("doc_id", "page", "line_no", _get(head, 1).alias("connector"), _get(pin, 1).alias("pin"), _get(pin, 2).alias("signal"), _get(pin, 3).alias("code"))
    colour = F.array_join(F.transform(F.split("code", "/"), lambda x: lookup(COLOURS, x)), " with ")
    return carry(found, "connector").where("pin IS NOT NULL").select("doc_id", "page", "connector", "pin", "signal", colour.alias("colour"))


def allocation_chart(pages: DataFrame) -> DataFrame:
    """Maintenance allocation rows: group, component (carried down), function, level and hours."""
    p = r"^\s*(\d{2,4})\s+(?:([A-Z][A-Za-z ,]+?)\s{2,})?(Inspect|Test|Service|Adjust|Replace|Repair|Overhaul)\s+([COFHLD])\s+(\d+(?:\.\d+)?)\s*$"
    found = lines(pages).select("doc_id", "page", "line_no", _get(p, 1).alias("group_no"), _get(p, 2).alias("component"), _get(p, 3).alias("action"), _get(p, 4).alias("level"), _get(p, 5).cast("double").alias("hours"))
    return carry(found, "component").where("group_no IS NOT NULL").withColumn("level", lookup(SMR_LEVEL, F.col("level"))).drop("line_no")


def parts_lines(pages: DataFrame) -> DataFrame:
    """Parts-list lines under the figure last named; confidence is the share of five fields filled."""
    fig = r"^\s*FIG(?:URE)?\.?\s*(\d+)"
    grab = {
        "item": r"^\s*(\d{1,3})\s", "smr": r"\b([A-Z]{2}[A-Z]{2}[A-Z])\b", "nsn": r"\b(\d{4}-\d{2}-\d{3}-\d{4})\b", "cagec": r"\s(\d[A-Z0-9]{3}\d)\s", "part_no": r"\s([A-Z0-9]+-[A-Z0-9-]+)\s+[A-Z]", "nomenclature": r"\s([A-Z][A-Z]+(?:, ?[A-Z ]+)*)\s+\d+\s*$", "qty": r"\s(\d{1,4})\s*$",
    }
    found = lines(pages).select("doc_id", "page", "line_no", "line", _get(fig, 1).alias("fig_no"), *[_get(p, 1).alias(k) for k, p in grab.items()])
    filled = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("smr", "nsn", "cagec", "part_no", "nomenclature"))
    rows = carry(found, "fig_no").where("item IS NOT NULL AND (nsn IS NOT NULL OR part_no IS NOT NULL)").withColumn("confidence", F.round(filled / 5, 2))
    return rows.withColumn("item", F.col("item").cast("int")).withColumn("qty", F.col("qty").cast("int")).drop("line", "line_no")


def limits(pages: DataFrame) -> DataFrame:
    """Minimum, maximum and limit statements with value and unit."""
    p = r"(?i)\b(min(?:imum)?|max(?:imum)?|limit)\b[^.\n]{0,40}?(\d+(?:\.\d+)?)\s*(psi|in|mm|ft-lb|qt)\b"
    keys = [c for c in pages.columns if c != "body_text"]
    found = pages.select(*keys, F.explode(F.regexp_extract_all("body_text", F.lit(p), F.lit(0))).alias("raw"))
    bound = F.lower(F.substring(F.regexp_extract("raw", p, 1), 1, 3))
    return found.select(*keys, bound.alias("bound"), F.regexp_extract("raw", p, 2).cast("double").alias("value"), F.lower(F.regexp_extract("raw", p, 3)).alias("unit")).distinct()


def spec_tokens(pages: DataFrame) -> DataFrame:
    """Thread sizes, standards and their families."""
    keys = [c for c in pages.columns if c != "body_text"]
    thread, standard = r"\b(\d/\d{1,2}-\d{2}|M\d{1,2}(?:x\d(?:\.\d+)?)?)\b", rf"\b(({'|'.join(STANDARDS)})[- ]?\d{{2,}}(?:-\d+)?)\b"
    threads = pages.select(*keys, F.lit("thread").alias("kind"), F.explode(F.regexp_extract_all("body_text", F.lit(thread), F.lit(1))).alias("value"))
    norms = pages.select(*keys, F.lit("standard").alias("kind"), F.explode(F.regexp_extract_all("body_text", F.lit(standard), F.lit(1))).alias("value"))
    found = threads.union(norms).distinct()
    return found.withColumn("family", lookup(STANDARDS, F.regexp_extract("value", "^([A-Z]+)", 1)))


def decode_smr(c: Column) -> Column:
    """A five-letter code to source, use, repair and recovery; null unless every part is known."""
    up = F.upper(F.trim(c))
    parts = F.struct(lookup(SMR_SOURCE, F.substring(up, 1, 2)).alias("source"), lookup(SMR_LEVEL, F.substring(up, 3, 1)).alias("use"), F.when(F.substring(up, 4, 1) == "Z", "none").otherwise(lookup(SMR_LEVEL, F.substring(up, 4, 1))).alias("repair"), lookup(SMR_RECOVER, F.substring(up, 5, 1)).alias("recover"))
    known = (F.length(up) == 5) & parts["source"].isNotNull() & parts["use"].isNotNull() & parts["repair"].isNotNull() & parts["recover"].isNotNull()
    return F.when(known, parts)


def material(c: Column) -> Column:
    """The first material that characteristics name."""
    up, out = F.upper(c), F.lit(None).cast("string")
    for word, label in reversed(MATERIALS):
        out = F.when(up.contains(word), label).otherwise(out)
    return out


def roles(c: Column) -> Column:
    """I32: dimensions of a characteristics text as a map from role to inches; the first of a role wins."""
    pairs = F.transform(F.regexp_extract_all(F.upper(c), F.lit(r"(LENGTH|WIDTH|HEIGHT|DIAMETER|THICKNESS):\s*\d+(?:\.\d+)?\s*(?:IN|MM)"), F.lit(0)),
                        lambda x: F.struct(F.lower(F.regexp_extract(x, r"^(\w+)", 1)).alias("k"), F.round(F.regexp_extract(x, r"(\d+(?:\.\d+)?)", 1).cast("double") * F.when(x.endswith("MM"), 1 / 25.4).otherwise(1.0), 6).alias("v")))
    first = F.filter(pairs, lambda x, i: F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda y: y["k"] == x["k"])) == 0)
    return F.map_from_entries(first)


def steps(pages: DataFrame) -> DataFrame:
    """Numbered steps with their sub-steps, warnings and what they refer to. A page is a row, and its lines stay in it: a step is the slices
    of lines that its number begins, so that no line is exchanged or sorted."""
    step = lambda df, name, value: df.select("doc_id", "page", *[c for c in df.columns if c == "line"], F.explode(F.array(value)).alias(name))  # noqa: E731 (explode of one value: it is computed once)
    cut = step(pages.where("body_text IS NOT NULL"), "line", F.split("body_text", "\n"))
    number = lambda x: F.nullif(F.regexp_extract(x, r"^\s*(\d{1,2})\.\s+\S", 1), F.lit("")).cast("int")
    begun = step(cut, "begun", F.filter(F.transform("line", lambda x, i: F.struct(number(x).alias("step"), (i + 1).alias("at"))), lambda x: x["step"].isNotNull()))
    ends = F.transform("begun", lambda x, i: F.struct(x["step"].alias("step"), F.slice("line", x["at"], F.coalesce(F.get(F.col("begun"), i + 1)["at"], F.size("line") + 1) - x["at"]).alias("lines")))
    parts = step(begun, "parts", ends).drop("line")
    each = parts.select("doc_id", "page", "parts", F.explode(F.array_distinct(F.transform("parts", lambda x: x["step"]))).alias("step"))
    own = each.select("doc_id", "page", "step", F.flatten(F.transform(F.filter("parts", lambda x: x["step"] == F.col("step")), lambda x: x["lines"])).alias("lines"))
    n = lambda p: F.size(F.filter("lines", lambda x: x.rlike(p))).cast("long")
    per = own.select("doc_id", "page", "step", F.array_join(F.transform("lines", lambda x: F.trim(x)), " ").alias("text"), n(r"^\s*(?:\([a-z]\)|[a-z]\.)\s").alias("n_sub"), n(r"\b(WARNING|CAUTION)\b").alias("n_alerts"))
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d{4}-\d{2}-\d{3}-\d{4}"), F.lit(0))))
    return per.withColumn("nsns", refs).withColumn("figures", F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)\bfig(?:ure)?\.?\s*(\d+)"), F.lit(1))))


def fault_tree(pages: DataFrame) -> DataFrame:
    """Malfunctions with their tests and corrective actions, nested; one row a malfunction."""
    head, test = r"^\s*(?:MALFUNCTION|SYMPTOM)[:.]?\s*(.+?)\s*$", r"^\s*(?:STEP|TEST)\s+\d+[:.]?\s*(.+?)\s*$"
    found = lines(pages).select("doc_id", "page", "line_no", "line", _get(head, 1).alias("symptom"), _get(test, 1).alias("test"))
    w = Window.partitionBy("doc_id", "page").orderBy("line_no")
    marked = found.withColumn("tree", F.count("symptom").over(w)).withColumn("node", F.count("test").over(w)).where("tree > 0")
    action = F.when(F.col("symptom").isNull() & F.col("test").isNull() & (F.trim("line") != ""), F.trim("line"))
    per = marked.groupBy("doc_id", "page", "tree", "node").agg(F.max("symptom").alias("symptom"), F.max("test").alias("test"), F.array_sort(F.collect_list(F.when(action.isNotNull(), F.struct("line_no", action.alias("a"))))).alias("a"))
    nodes = F.array_sort(F.collect_list(F.when(F.col("test").isNotNull(), F.struct("node", "test", F.transform("a", lambda x: x["a"]).alias("actions")))))
    return per.groupBy("doc_id", "page", "tree").agg(F.max("symptom").alias("symptom"), nodes.alias("tests")).drop("tree")


def side(c: Column) -> Column:
    """Operator, mechanic or both, from the coverage digits of a manual number, else from its words."""
    digit = F.element_at(F.regexp_extract_all(c, F.lit(r"-(\d)\d(?:\D|$)"), F.lit(1)), -1)
    has = F.size(F.regexp_extract_all(c, F.lit(r"-(\d)\d(?:\D|$)"), F.lit(1))) > 0
    low = F.lower(c)
    return F.when(has & (digit == "1"), "operator").when(has & digit.isin("2", "3", "4"), "mechanic").when(low.contains("operator") & low.contains("maintenance"), "both").when(low.contains("operator"), "operator").otherwise("mechanic")


def trimmed(pages: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """Pages without the lines whose form is boilerplate of their document, in order."""
    form = F.regexp_replace(F.lower(F.trim("line")), r"\d", "#")
    kept = lines(pages).withColumn("form", form).join(boilerplate.select("doc_id", "form"), ["doc_id", "form"], "left_anti")
    return kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body_text"))


def nsn_prefix(queries: DataFrame, catalogue: DataFrame, cap: int = 6) -> DataFrame:
    """Item numbers that share the longest of 7, 6 or 5 leading digits. queries: qid, niin."""
    rows = None
    for p in (7, 6, 5):
        met = queries.withColumn("p", F.substring("niin", 1, p)).join(catalogue.select(F.substring("niin", 1, p).alias("p"), F.col("niin").alias("found")), "p").where("found <> niin").select("qid", F.lit(p).alias("shared"), "found")
        rows = met if rows is None else rows.union(met)
    best = rows.withColumn("most", F.max("shared").over(Window.partitionBy("qid"))).where("shared = most")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("found"))).where(F.col("rank") <= cap).select("qid", "shared", "found", "rank")
