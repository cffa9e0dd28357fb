"""Types of each subject from texts that are measured once, and unit names grouped by their first letter."""

import random
import re

from lodestone.functions import units
from lodestone.operators import facts


def test_equal_texts_are_measured_once(spark):
    texts = ["Torque to 20 ft-lb.", "Use 3 qt at 40 psi, then 3 qt.", "No number", "", None, "5 in and 6 mm"]
    rows = [(i, 1, f"n{i % 7}" if i % 9 else None, texts[i % 5 if i % 11 else 5]) for i in range(200)]
    pages = spark.createDataFrame(rows, "document_id long, page int, niin string, body_text string")
    got = facts.stated_types(pages)
    want = facts.measurements(pages).select("niin", "type").distinct()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 8
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()  # no page is measured for itself


def test_grouped_names_match_as_listed_ones():
    names = sorted({n for u in units.UNITS for n in u.names}, key=lambda n: (-len(n), n))
    flat = re.compile(units.MEASURE.replace(units.PATTERN, "|".join(map(units._pattern, names))))
    grouped, rng = re.compile(units.MEASURE), random.Random(2)
    assert flat.pattern != grouped.pattern
    for _ in range(5000):
        name = rng.choice(names).replace(" per ", rng.choice([" per ", "/", " / "])).replace(" ", rng.choice([" ", "-", ""]))
        text = rng.choice(["5", "1,200 ", "3-5", "4 ± 1 ", ".5\n"]) + rng.choice([name, name.upper(), f"{name}s"]) + rng.choice([" ", ".", "x", "-", "/", ""])
        assert [m.groups() for m in flat.finditer(text)] == [m.groups() for m in grouped.finditer(text)], text
