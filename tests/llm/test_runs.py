"""Repeated runs of lines against plain versions."""

import random

from pyspark.sql import functions as F

from lodestone.llm import linededup
from test_ops import frame


def windows(text):
    """Lines, and of every two lines in a row that have a word: the first, the one after the last, their bytes."""
    lines = text.encode().split(b"\n")
    solid = [i for i, x in enumerate(lines) if x.strip()]
    return lines, [(a, b + 1, b"\n".join(lines[a : b + 1])) for a, b in zip(solid, solid[1:])]


def own_repeats(found):
    gone, seen = set(), {}
    for a, b, body in found:
        if seen.setdefault(body, b) <= a:
            gone.update(range(a, b))
    return gone


def every_window(rows):
    """Lines of each row that go if every window that an earlier document has goes: none else may."""
    first = {}
    for d, t in rows:
        for *_, body in windows(t or "")[1] if d is not None else ():
            first[body] = min(first.get(body, d), d)
    return [own_repeats(w := windows(t or "")[1]) | {i for a, b, body in w if d is not None and first[body] < d for i in range(a, b)} for d, t in rows]


def plain_runs(rows):
    """The rule in loops: which windows are cuts is asked of the operator, nothing else."""
    first, cut_at = {}, []
    for d, t in rows:
        cut_at.append([int(i) for i in linededup.Cuts((t or "").encode()).at])
        lines, found = windows(t or "")
        for i in cut_at[-1] if d is not None else ():
            body, place = found[i][2], (d, i, t)
            if body not in first or place[:2] < first[body][:2]:
                first[body] = place
    out = []
    for (d, t), at in zip(rows, cut_at):
        if d is None or t is None:
            out.append((d, t, 0))
            continue
        lines, found = windows(t)
        gone = own_repeats(found)
        for k, i in enumerate(at):
            e, j, text = first[found[i][2]]
            if e >= d:
                continue
            theirs = windows(text)[1]
            lo, hi = i, i
            while lo > (at[k - 1] if k else 0) and j - (i - lo) > 0 and found[lo - 1][2] == theirs[j - (i - lo) - 1][2]:
                lo -= 1
            while hi < (at[k + 1] if k + 1 < len(at) else len(found) - 1) and j + hi - i + 1 < len(theirs) and found[hi + 1][2] == theirs[j + hi - i + 1][2]:
                hi += 1
            # up to the neighbouring cuts of both
            own = [int(x) for x in linededup.Cuts(text.encode()).at]
            m = own.index(j)
            lo = max(lo, i - (j - (own[m - 1] if m else 0)))
            hi = min(hi, i + ((own[m + 1] if m + 1 < len(own) else len(theirs) - 1) - j))
            gone.update(range(found[lo][0], found[hi][1]))
        out.append((d, "\n".join(x.decode() for i, x in enumerate(lines) if i not in gone), len(gone)))
    return sorted(out, key=repr)


def test_runs_of_three_lines_go_whole(spark):
    """Runs of 2 to 7 lines between other lines; of those of two lines at least some."""
    rows = []
    for n in range(2, 8):
        for i in range(6):
            block = [f"shared {n} {i} {j}" for j in range(n)]
            for d in (2 * (10 * n + i), 2 * (10 * n + i) + 1):
                rows.append((d, "\n".join([f"own {d} a", f"own {d} b", *block, f"own {d} c"])))
    got = {r["doc_id"]: r for r in linededup.run_dedup(frame(spark, rows), removed="gone").collect()}
    assert all(r["gone"] == (0 if d % 2 == 0 else d // 20) for d, r in got.items() if d >= 60)
    assert all(r["text"] == f"own {d} a\nown {d} b\nown {d} c" and r["n_chars"] == len(r["text"]) for d, r in got.items() if d % 2 and d >= 60)
    assert {r["gone"] for d, r in got.items() if d < 60} == {0, 2}


def test_cuts_resist_shifts():
    lines = [f"line {i}" for i in range(200)]
    plain, moved = (linededup.Cuts("\n".join(x).encode()) for x in (lines, ["new"] * 3 + lines[:100] + ["more"] + lines[100:]))
    places = {int(i) for i in plain.at}
    assert {int(i) - 3 for i in moved.at if 3 <= i < 100} ^ {i for i in places if i < 97} <= {0, 96}
    assert {int(i) - 4 for i in moved.at if i > 106} == {i for i in places if i > 102}
    # of two windows in a row one is a cut
    assert all(i in places or i + 1 in places for i in range(198)) and 0 in places and 198 in places and len(places) < 160


def test_runs(spark):
    rng = random.Random(9)
    pool = [f"line {i} é" for i in range(12)] + ["", "  "]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 25)))) for d in range(60)]
    rows += [(70, None), (71, ""), (72, "x\n" * 500), (73, "x\nx\nx"), (None, rows[0][1]), (80, "\n".join(pool + pool)), (81, "a\n\nb"), (82, "a\nb"), (83, "q\na\n\nb\nr")]
    docs = frame(spark, rows)
    got = linededup.run_dedup(docs, removed="gone")
    assert got.columns == [*docs.columns, "gone"]
    assert sorted(((r["doc_id"], r["text"], r["gone"]) for r in got.collect()), key=repr) == plain_runs(rows)
    assert linededup.run_dedup(docs.limit(0)).count() == 0 and got.agg(F.sum("gone")).first()[0] > 100


def test_repeated_doc_ids(spark):
    """Two texts of each doc_id, every one with a run that document 1 has: all of them lose it, and nothing else."""
    block = "\n".join(f"shared {i}" for i in range(4))
    rows = [(1, block)] + [(d, f"{d} first {k}\n{d} then {k}\n{block}\n{d} last {k}") for d in range(2, 302) for k in "ab"]
    got = linededup.run_dedup(frame(spark, rows), removed="gone")
    assert got.groupBy("doc_id", "gone").count().where("doc_id > 1 AND NOT (gone = 4 AND count = 2)").count() == 0
    assert got.where("doc_id > 1 AND text LIKE '%shared%'").count() == 0 and got.where("doc_id = 1 AND gone = 0").count() == 1


def test_query(spark, sf):
    from lodestone.llm.common import table
    from lodestone.llm.queries import QUERIES

    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = {(d, n, len(t or "")) for d, t, n in plain_runs(rows)}
    assert {(r["doc_id"], r["n_removed_lines"], r["kept_chars"] or 0) for r in QUERIES["op4_line_dedup"](spark, sf).collect()} == want
    most = sum(map(len, every_window(rows)))
    assert 0.9 * most <= sum(n for _, n, _ in want) <= most
