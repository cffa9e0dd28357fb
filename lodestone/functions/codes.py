"""Column functions: normal forms, code decoding, labels and quality rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Fixed values.
#: Hard least and most, usual least and most, and whether a value may be negative.
BANDS = {
    "torque": (0, 200000, 0.5, 3000, False),
    "pressure": (0, 100000, 0, 12000, False),
    "length": (0, 100000, 0.0005, 2000, False),
    "weight": (0, 500000, 0, 120000, False),
    "force": (0, 500000, 0, 100000, False),
    "electrical": (0, 100000, 0, 1500, False),
    "temperature": (-150, 6000, -70, 1600, True),
    "capacity": (0, 100000, 0, 20000, False),
    "flow": (0, 100000, 0, 20000, False),
    "speed": (0, 100000, 0, 20000, False),
    "rotation": (0, 2000000, 0, 200000, False),
    "angle": (-720, 720, 0, 360, True),
    "area": (0, 1000000, 0, 100000, False),
}
MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def norm_nsn(c: Column) -> Column:
    """The dashed form of 13 digits; null for any other number of digits."""
    d = digits(c)
    return F.when(F.length(d) == 13, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 3), F.substring(d, 10, 4)))


def niin_strict(c: Column) -> Column:
    """The item number of 9 or 13 digits; null for ambiguous lengths."""
    d = digits(c)
    return F.when(F.length(d).isin(9, 13), F.right(d, F.lit(9)))


def norm_pn(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s", ""))


def base_pn(c: Column) -> Column:
    """A part number without its variant suffix."""
    return F.regexp_replace(norm_pn(c), r"-\d{1,2}$", "")


def decode_nsn(c: Column) -> Column:
    """Class, group, country code and item number of a stock number."""
    d = digits(c)
    return F.when(F.length(d) == 13, F.struct(F.substring(d, 1, 4).alias("fsc"), F.substring(d, 1, 2).alias("fsg"), F.substring(d, 5, 2).alias("country"), F.right(d, F.lit(9)).alias("niin")))


def cage_reasons(c: Column) -> Column:
    """Every reason why a maker code is not valid; none for a valid one."""
    up = F.upper(F.trim(c))
    checks = [(F.length(up) != 5, "length"), (up.rlike("[^A-Z0-9]"), "character"), (up.rlike("[IO]"), "letter I or O")]
    return F.filter(F.array(*[F.when(bad, F.lit(why)) for bad, why in checks]), lambda x: x.isNotNull())


def revision(c: Column) -> Column:
    """Manual number, change number (0 where none) and date of a title line."""
    number = F.nullif(F.regexp_extract(c, r"\bTM\s*([0-9][0-9A-Z-]+)", 1), F.lit(""))
    change = F.coalesce(F.nullif(F.regexp_extract(F.upper(c), r"\bCHANGE\s+(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    pattern = rf"(\d{{1,2}})\s+({'|'.join(MONTHS)})\s+(\d{{4}})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(F.upper(c), pattern, 2))
    day, year = (F.nullif(F.regexp_extract(F.upper(c), pattern, i), F.lit("")).cast("int") for i in (1, 3))
    return F.struct(number.alias("tm"), change.alias("change"), F.when(day.isNotNull(), F.make_date(year, month.cast("int"), day)).alias("date"))


def file_type(path: Column) -> Column:
    """A3: pdf, image, office or other, by extension."""
    ext = F.lower(F.substring_index(path, ".", -1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif"), "image").when(ext.isin("doc", "docx", "xls", "xlsx", "ppt", "pptx", "rtf"), "office").otherwise("other")


def strip_html(html: Column) -> Column:
    """A5: text of a page: scripts, styles and tags dropped, the five XML entities and hard blanks mapped, blanks squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def phrases(words: tuple[str, ...], gap: str = r"\s+", start: str = r"\b", end: str = r"\b") -> str:
    """A pattern of any of some phrases, without regard to case; longer ones first, their blanks as `gap`."""
    found = "|".join(gap.join(map(re.escape, w.split(" "))) for w in sorted(words, key=len, reverse=True))
    return f"(?i){start}(?:{found}){end}"


# Words of a title that name a side, and of a lubrication order.
OPERATOR_WORDS = ("operator", "operators", "operator's")
MECHANIC_WORDS = ("maintenance", "unit", "organizational", "direct support", "general support", "rpstl", "repair parts")
LUBRICATION_WORDS = ("lo", "lubrication order")


def tm_side(tm: Column, title: Column, path: Column) -> Column:
    """Operator, mechanic, coverage, basis and confidence of a manual, as a struct.

    The last field of two digits that begins with 1 to 4, of the number or else of title and path, is the coverage: 10 the operator's, 11 to 19
    both, the others the mechanic's. A parts list (a P after a digit, RPSTL) and a lubrication order are the mechanic's too. All of these
    are sure (high); words of the title count where none is there (medium); a manual without any is the mechanic's (low)."""
    number, blob = F.coalesce(tm, F.lit("")), F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (tm, title, path)])
    fields = lambda c: F.regexp_extract_all(c, F.lit(r"(?i)(?:^|[-\s])(\d{2,3})(?:&?P)?(?=$|[-\s&])"), F.lit(1))
    found = F.when(F.size(fields(number)) > 0, fields(number)).otherwise(fields(blob))
    code = F.element_at(F.concat(F.array(F.lit("")), F.filter(found, lambda x: x.rlike(r"^[1-4]\d$"))), -1)
    parts = number.rlike(r"(?i)\d&?P\b") | blob.rlike(phrases(("rpstl",)))
    oil = number.rlike(phrases(LUBRICATION_WORDS)) | blob.rlike(phrases(LUBRICATION_WORDS))
    sure = (code != "") | parts | oil
    by_op, by_me = ~sure & blob.rlike(phrases(OPERATOR_WORDS)), ~sure & blob.rlike(phrases(MECHANIC_WORDS))
    named = sure | by_op | by_me
    basis = F.array_join(F.filter(F.array(
        F.when(code != "", F.concat(F.lit("coverage "), code)), F.when(parts, "parts list"), F.when(oil, "lubrication order"), F.when(by_op, "title: operator"), F.when(by_me, "title: maintenance"), F.when(~named, "undetermined"),
    ), lambda x: x.isNotNull()), ", ")
    return F.struct(
        (F.startswith(code, F.lit("1")) | by_op).alias("operator"), (((code != "") & (code != "10")) | parts | oil | by_me | ~named).alias("mechanic"),
        F.when(code != "", code).when(parts, "P").when(oil, "LO").otherwise("").alias("coverage"), basis.alias("basis"), F.when(sure, "high").when(named, "medium").otherwise("low").alias("confidence"),
    )


def document_type(title: Column) -> Column:
    """The first rule that matches."""
    t = F.upper(title)
    rules = (("MWO", "MWO"), ("TROUBLESHOOT", "Troubleshooting"), ("PARTS|RPSTL|24P", "Parts"), ("LUBRICAT", "Lubrication"), ("SCHEMATIC", "Schematics"), ("OPERATOR", "Operator"), ("MAINTENANCE", "Maintenance"))
    out = F.lit("Other")
    for pattern, label in reversed(rules):
        out = F.when(t.rlike(pattern), label).otherwise(out)
    return out


def text_quality(c: Column) -> Column:
    """1 less what looks like bad recognition; 0.5 for short texts."""
    n = F.length(c)
    words = F.greatest(F.regexp_count(c, F.lit(r"\S+")), F.lit(1))
    odd = F.regexp_count(c, F.lit(r"[^A-Za-z0-9\s.,;:()/'\"%&+-]")) / n
    dull = F.regexp_count(F.lower(c), F.lit(r"\b[bcdfghjklmnpqrstvwxz]{4,}\b")) / words
    stray = F.regexp_count(c, F.lit(r"(?<!\S)[^aAI0-9\s](?!\S)")) / words
    return F.when(n < 12, 0.5).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 2.2 * odd - 0.8 * dull - 0.6 * stray)), 3))


def quality_flag(score: Column) -> Column:
    return F.when(score >= 0.85, "clean").when(score >= 0.6, "suspect").otherwise("poor")


def _gate(kind: Column, value: Column, given: Column | None) -> list[tuple[Column, str, Column]]:
    """(condition, status, reason) in order of precedence."""
    out = [] if given is None else [(garbled(given), "quarantine", F.lit("garbled"))]
    for name, (hard_lo, hard_hi, lo, hi, signed) in BANDS.items():
        mine = kind == name
        out.append((mine & value.isNull(), "quarantine", F.lit("no number")))
        if not signed:
            out.append((mine & (value < 0), "quarantine", F.lit("negative")))
        out.append((mine & ((value < hard_lo) | (value > hard_hi)), "quarantine", F.lit("out of physical range")))
        out.append((mine & ((value < lo) | (value > hi)), "suspect", F.lit("outside the usual band")))
    return out


def value_gate(kind: Column, value: Column, given: Column | None = None) -> Column:
    """Ok, suspect (outside the usual band) or quarantine (garbled as it was given, no number, negative where it can't be, outside the hard band); kinds without a band are ok."""
    return F.coalesce(*[F.when(c, status) for c, status, _ in _gate(kind, value, given)], F.lit("ok"))


def gate_reason(kind: Column, value: Column, given: Column | None = None) -> Column:
    """Why; empty for ok."""
    return F.coalesce(*[F.when(c, why) for c, _, why in _gate(kind, value, given)], F.lit(""))


def garbled(value: Column) -> Column:
    """A number as it was read that no number is: letters inside it, two points, eight digits in a run."""
    core = F.regexp_extract(F.trim(value), r"^\S*", 0)
    digits = F.regexp_replace(core, "[,.]", "")
    return F.coalesce(core.rlike(r"\d[A-Za-z]\d") | (F.regexp_count(core, F.lit(r"\.")) > 1) | digits.rlike(r"\d{8,}"), F.lit(False))


def trust(status: Column, n: Column, spread: Column) -> Column:
    """Quarantined, low, review, medium or high."""
    return F.when(status == "quarantine", "quarantined").when(status == "suspect", "low").when(spread > 0.25, "review").when(n < 2, "medium").otherwise("high")


def clean_vehicles(c: Column, most: int = 20) -> Column:
    """Names between pipes, without junk, file names and single letters."""
    names = F.transform(F.split(c, r"\|"), lambda x: F.trim(x))
    good = F.filter(names, lambda x: (F.length(x) >= 2) & ~x.rlike(r"(?i)\.(pdf|docx?|txt)$") & ~F.lower(x).isin("n/a", "none", "unknown", "misc"))
    return F.slice(F.array_distinct(good), 1, most)
