"""Suggestions against plain loops, with bit matrices cut into several steps, and no row for a pair of a fault and a page."""

import random
import re

from lodestone.operators import blocks, tasks


def test_status_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BITS", 64)  # a step of 64 columns
    rng = random.Random(5)
    known = ["pump", "valve", "gasket", "hose", "fuel", "brake", "seat", "and", "the", "leak"]
    text = lambda n: " ".join(rng.choices(known, k=n))
    faults = [(i, rng.choice(["a", "b", None]), f"rare{i} {text(4)}") for i in range(30)] + [(30, "a", None), (31, "a", "odd"), (32, "b", "x" * 40), (33, "c", "mission pump")]
    ends = [" mission capable", " mission. Capable", " mission not capable", " emission capable", ""]
    pages = [(i % 300, 1 + i % 2, rng.choice(["a", "b", "c", None]), f"rare{i % 40}{rng.choice(['', 's'])} " + text(rng.randint(0, 2)) + rng.choice(ends)) for i in range(600)]
    history = [(i % 90, rng.choice([" fmc", "PMC ", "nmcm", "", None]), f"big{rng.choice(known)}s {'y' * 30}{rng.choice(known)} rare{i % 50} {'x' * rng.choice([39, 41])}") for i in range(200)] + [(91, "PMC", None)]
    said = {}
    for d, p, v, body in pages:
        w = re.findall(r"[^\W_]+", body.lower())
        if v and ("mission", "capable") in zip(w, w[1:], strict=False):
            said.setdefault((v, d, p), set()).update(w)
    want = set()
    for f, v, body in faults:
        terms = [w for w in dict.fromkeys(re.findall("[a-z0-9]+", (body or "").lower())) if len(w) >= 4 and w not in tasks.DULL][:6]
        there = sorted((d, p) for (pv, d, p), w in said.items() if pv == v and w & set(terms))
        votes = {}
        for s, status, past in history:
            if status and any(t in (past or "") for t in terms):
                votes.setdefault(status.strip().upper(), set()).add(s)
        best = min(((-len(s), n) for n, s in votes.items()), default=(0, None))[1]
        want.add((f, "NMCS" if there else best, "pages" if there else "history" if best else None, len(there), *(there[0] if there else (None, None))))
    frame = spark.createDataFrame
    got = tasks.status_suggestion(frame(faults, "fault_id long, vehicle string, text string"), frame(pages, "doc_id long, page int, vehicle string, body_text string").repartition(3), frame(history, "session long, status string, text string"))
    rows = {tuple(r) for r in got.collect()}
    assert rows == want and {r[2] for r in rows} == {"pages", "history", None}
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and all("fault_id" in line for line in joins)
