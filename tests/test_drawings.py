"""Netlists and stitched tables on small hand-written inputs."""

import random

from pyspark.sql import functions as F

from lodestone.operators import catalog, drawings, manuals


def nets(spark, *segments):
    df = spark.createDataFrame([(1, *map(float, s)) for s in segments], "page int, x1 double, y1 double, x2 double, y2 double")
    found, pages = drawings.netlist(df)
    return sorted((r["n_nodes"], r["n_edges"]) for r in found.collect()), pages.collect()


def test_ends_near_each_other_are_one_node(spark):
    # 0.0002 apart, on both sides of a cell's border; then 0.02 apart
    assert nets(spark, (0.1, 0.1, 0.2104, 0.1), (0.2106, 0.1, 0.4, 0.1))[0] == [(3, 2)]
    assert nets(spark, (0.1, 0.1, 0.2, 0.1), (0.22, 0.1, 0.4, 0.1))[0] == [(2, 1), (2, 1)]


def test_junctions_split_wires(spark):
    got, pages = nets(spark, (0.1, 0.5, 0.9, 0.5), (0.5, 0.5, 0.5, 0.9), (0.7, 0.1, 0.7, 0.497))
    # two taps on the long wire: six nodes, five edges, two junctions
    assert got == [(6, 5)]
    (p,) = pages
    assert (p["n_segments"], p["n_nodes"], p["n_edges"], p["n_nets"], p["n_junctions"]) == (3, 6, 5, 1, 2)
    assert p["confidence"] == round(0.5 * 1 / 5 + 0.2 * 2 / 8 + 0.12, 2)
    # a wire that only crosses another doesn't split it, and a slanted one is split too
    assert nets(spark, (0.1, 0.5, 0.9, 0.5), (0.5, 0.1, 0.5, 0.9))[0] == [(2, 1), (2, 1)]
    assert nets(spark, (0.0, 0.0, 0.8, 0.6), (0.4, 0.3, 0.4, 0.9))[0] == [(4, 3)]


def test_specks_nulls_and_empty(spark):
    assert nets(spark, (0.1, 0.1, 0.1002, 0.1))[0] == []
    assert drawings.netlist(spark.createDataFrame([], "page int, x1 double, y1 double, x2 double, y2 double"))[1].count() == 0


def stitched(tables):
    """The rule in a loop."""
    out = []
    for page, rows in tables:
        if not rows:
            continue
        width, data = max(map(len, rows)), any((c or "").replace(",", "").replace(".", "").isdigit() for c in rows[0])
        if out and out[-1][0] == width and (data or rows[0] == out[-1][2][0]):
            out[-1][1].append(page)
            out[-1][2].extend(rows[1:] if rows[0] == out[-1][2][0] else rows)
        else:
            out.append((width, [page], list(rows)))
    return out


def test_stitch(spark):
    head, data = ["H1", "b", "c"], ["1", "x", "y"]
    cases = {
        # the open table's head decides: a table of another width lies between, and stays a third
        1: [(1, [head, data]), (2, [["q", "b", "c", "d"], ["2", "x", "y", "z"]]), (3, [["H1", "b", "c", "d"], ["3", "x", "y", "z"]])],
        # an empty page between, a repeated head, data at once
        2: [(1, [head, data]), (2, []), (3, [head, data]), (7, [data, [None, "u", "v"]])],
        3: [(1, [["a"]]), (1, [["1,000.5"]]), (2, [["a"], ["b"]]), (3, [["b"]])],
    }
    rng = random.Random(3)
    for d in range(4, 40):
        cases[d] = [(p, [[rng.choice(["H", "1", "2.5", "x", None]) for _ in range(w)] for _ in range(rng.randint(0, 2))]) for p in range(6) for w in [rng.randint(1, 2)]]
    rows = [(d, p, i, r) for d, t in cases.items() for i, (p, r) in enumerate(t)]
    df = spark.createDataFrame(rows, "doc_id int, page int, place int, rows array<array<string>>").repartition(5)
    got = {}
    for r in manuals.stitch(df).orderBy("doc_id", "table_no").collect():
        got.setdefault(r["doc_id"], []).append((r["n_cols"], r["pages"], r["rows"]))
    assert got == {d: stitched(t) for d, t in cases.items() if stitched(t)}
    assert len(got[1]) == 3 and [len(x[2]) for x in got[2]] == [5]
    assert manuals.stitch(df.limit(0)).count() == 0


def test_obsolescence(spark):
    items = spark.createDataFrame([("1", "", 1), ("1", "Z", 2), ("1", "D", 3), ("2", "d", 1), ("3", None, None), ("4", "X", 1), ("5", "D", 1)], "niin string, aac string, place int")
    links = spark.createDataFrame([("5", "2"), ("5", "9"), ("5", "9")], "old string, new string")
    got = {r["niin"]: (r["aac"], r["replaced_by"], r["replaces"], r["state"]) for r in catalog.obsolescence(items, links).collect()}
    assert got == {"1": ("Z", None, None, "obsolete"), "2": ("D", None, "5", "active"), "3": (None, None, None, "unknown"), "4": ("X", None, None, "active"), "5": ("D", "2 | 9", None, "obsolete")}
