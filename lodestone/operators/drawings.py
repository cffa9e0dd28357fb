"""Netlists of drawings. Wires are segments (page, x1, y1, x2, y2) in parts of a page's width and height.

Ends within `snap` of each other are one node, and so are ends that a chain of such ends connects; its place is
its smallest end. A node on the inside of a wire splits it. A page's wires come together once, and many pages are
solved at once as arrays. Pages of more than `LARGE` wires are joins on (page, cell) instead: near ends meet in
neighbouring cells, and a wire is cut into short pieces that each name the few cells they touch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.operators.graph import connected_components
from lodestone.sources.scratch import frugal, materialize

SNAP = 0.007
#: Side of the cells that wires are looked up in.
CELL = 0.05
#: Wires no longer than this, across and down together, are specks.
SPECK = 8e-4
#: Part of a wire on either end where a node doesn't split it.
MARGIN = 0.02
#: Wires of a page that one task holds, wires that are solved at once, and pairs of a wire and a node that are.
LARGE, ROWS, PAIRS = 20_000, 200_000, 4_000_000
#: What a component is labelled with: up to three letters, up to four digits, perhaps a letter.
LABEL = r"^[A-Z]{1,3}\d{1,4}[A-Z]?$"


def _key(page: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("|", page.cast("string"), x.cast("string"), y.cast("string"))


def _wires(segments: DataFrame) -> DataFrame:
    long_enough = F.abs(F.col("x1") - F.col("x2")) + F.abs(F.col("y1") - F.col("y2")) > SPECK
    return segments.select("page", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).where(long_enough)


def nodes_of(wires: DataFrame, snap: float = SNAP) -> DataFrame:
    """page, x, y of each end, with the node (page, nx, ny) that it belongs to."""
    ends = wires.select("page", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select("page", "p.x", "p.y").distinct()
    # ends of one cell are near each other, whatever they are: a star stands for their pairs, and ends alone in a cell need none
    side = snap / 2**0.5
    placed = ends.select("page", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    first = placed.groupBy("page", "cx", "cy").agg(F.min(F.struct("x", "y")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("page", "cx", "cy", F.col("f.x").alias("ox"), F.col("f.y").alias("oy"))
    stars = placed.join(first, ["page", "cx", "cy"]).select("page", "x", "y", "ox", "oy")
    # ends of other cells: half of the neighbours, as a pair needs to meet once, and of these the ones that are near enough
    near = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    moves = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in near]))
    asking = placed.select("page", F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy", moves.alias("m")).select("page", "ox", "oy", (F.col("cx") + F.col("m.dx")).alias("cx"), (F.col("cy") + F.col("m.dy")).alias("cy"))
    gap = lambda o, c: F.greatest(F.lit(0.0), F.col(c) * side - F.col(o), F.col(o) - (F.col(c) + 1) * side)
    asking = asking.where(gap("ox", "cx") ** 2 + gap("oy", "cy") ** 2 <= snap * snap * (1 + 1e-6))
    apart = (F.col("ox") - F.col("x")) ** 2 + (F.col("oy") - F.col("y")) ** 2
    pairs = asking.join(placed, ["page", "cx", "cy"]).where(apart <= snap * snap).select("page", "x", "y", "ox", "oy")
    met = materialize(stars.union(pairs), "near")
    key = lambda x, y: _key(F.col("page"), F.col(x), F.col(y))
    found = connected_components(met.select(key("x", "y").alias("a"), key("ox", "oy").alias("b")))
    # only ends with another one near are named anew; any other is its own node
    linked = met.select("page", "x", "y").union(met.select("page", "ox", "oy")).distinct()
    named = linked.withColumn("node", key("x", "y")).join(found, "node")
    least = named.groupBy("component").agg(F.min(F.struct("x", "y")).alias("n"))
    moved = named.join(least, "component").select("page", "x", "y", "n")
    return ends.join(moved, ["page", "x", "y"], "left").select("page", "x", "y", F.coalesce("n.x", "x").alias("nx"), F.coalesce("n.y", "y").alias("ny"))


def _cells(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    return F.floor(F.col(x) / CELL), F.floor(F.col(y) / CELL)


def edges_of(wires: DataFrame, nodes: DataFrame, snap: float = SNAP) -> DataFrame:
    """page, ax, ay, bx, by: wires between nodes, split where another node is on them. A wire that is drawn twice counts twice."""
    at = lambda i: nodes.select("page", F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"), F.col("nx").alias(f"n{i}x"), F.col("ny").alias(f"n{i}y"))
    # a wire's number is stored with it, and so is the same for both uses below
    known = wires.withColumn("w", F.monotonically_increasing_id()).join(at(1), ["page", "x1", "y1"]).join(at(2), ["page", "x2", "y2"])
    known = materialize(known.where((F.col("n1x") != F.col("n2x")) | (F.col("n1y") != F.col("n2y"))), "wires")
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / CELL)).cast("int")
    piece = known.select("*", steps.alias("steps")).select("*", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("i"))
    part = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / F.col("steps")
    span = lambda a, b: F.sequence(*[F.floor((f(part(a, b, F.col("i")), part(a, b, F.col("i") + 1)) + s) / CELL) for f, s in ((F.least, -snap), (F.greatest, snap))])
    touched = piece.select("page", "w", "x1", "y1", "x2", "y2", "n1x", "n1y", "n2x", "n2y", F.explode(span("x1", "x2")).alias("cx"), span("y1", "y2").alias("cys")).withColumn("cy", F.explode("cys")).drop("cys").distinct()
    cx, cy = _cells("nx", "ny")
    spots = nodes.select("page", "nx", "ny").distinct().select("page", "nx", "ny", cx.alias("cx"), cy.alias("cy"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = ((F.col("nx") - F.col("x1")) * dx + (F.col("ny") - F.col("y1")) * dy) / (dx * dx + dy * dy)
    off = (F.col("x1") + t * dx - F.col("nx")) ** 2 + (F.col("y1") + t * dy - F.col("ny")) ** 2
    other = ~((F.col("nx") == F.col("n1x")) & (F.col("ny") == F.col("n1y"))) & ~((F.col("nx") == F.col("n2x")) & (F.col("ny") == F.col("n2y")))
    on = touched.join(spots, ["page", "cx", "cy"]).where(other & (t > MARGIN) & (t < 1 - MARGIN) & (off <= snap * snap)).select("w", t.alias("t"), F.col("nx").alias("x"), F.col("ny").alias("y")).distinct()
    splits = on.groupBy("w").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("on"))
    end = lambda i: F.array(F.struct(F.col(f"n{i}x").alias("x"), F.col(f"n{i}y").alias("y")))
    way = known.join(splits, "w", "left").select("page", F.concat(end(1), F.coalesce("on", F.slice(end(1), 1, 0)), end(2)).alias("way"))
    hops = way.select("page", F.explode(F.arrays_zip(F.slice("way", F.lit(1), F.size("way") - 1).alias("a"), F.slice("way", F.lit(2), F.size("way") - 1).alias("b"))).alias("h"))
    return hops.select("page", F.col("h.a.x").alias("ax"), F.col("h.a.y").alias("ay"), F.col("h.b.x").alias("bx"), F.col("h.b.y").alias("by")).where("ax <> bx OR ay <> by")


def nets_of(edges: DataFrame) -> DataFrame:
    """page, net, n_nodes, n_edges: connected wires; a net is named by a node of it."""
    keyed = edges.select("page", _key(F.col("page"), F.col("ax"), F.col("ay")).alias("a"), _key(F.col("page"), F.col("bx"), F.col("by")).alias("b"))
    found = connected_components(keyed)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    lines = keyed.join(found, F.col("a") == F.col("node")).groupBy("page", "component").agg(F.count(F.lit(1)).alias("n_edges"))
    return lines.join(sizes, "component").select("page", F.col("component").alias("net"), "n_nodes", "n_edges")


def _linked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (the smallest of each one's component) once a and b are linked, too."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up


def _solved(page: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, snap: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Counts of each page (segments, nodes, edges, those that go on at both ends, junctions), and nets (page, x, y of their smallest node, nodes, edges), by page.

    page: numbers from 0 in order, each with a wire."""
    n, pages = len(page), int(page[-1]) + 1
    p, x, y = np.concatenate([page, page]), np.concatenate([x1, x2]) + 0.0, np.concatenate([y1, y2]) + 0.0
    order = np.lexsort((y, x, p))
    p, x, y = p[order], x[order], y[order]
    same = lambda c: (c[1:] == c[:-1]) | (np.isnan(c[1:]) & np.isnan(c[:-1]))
    first = np.ones(2 * n, bool)
    first[1:] = ~((p[1:] == p[:-1]) & same(x) & same(y))
    end = np.empty(2 * n, np.int64)
    end[order] = np.cumsum(first) - 1
    p, x, y = p[first], x[first], y[first]
    # an end meets the next ones of its page as far as their x is within reach
    root, i, links, held = np.arange(len(p)), np.arange(len(p)), [], 0
    for k in range(1, len(p)):
        i = i[: np.searchsorted(i, len(p) - k)]
        i = i[(p[i + k] == p[i]) & (x[i + k] - x[i] <= snap * (1 + 1e-9))]
        if not len(i):
            break
        near = i[(x[i + k] - x[i]) ** 2 + (y[i + k] - y[i]) ** 2 <= snap * snap]
        links, held = [*links, (near, near + k)], held + len(near)
        if held > PAIRS:
            root, links, held = _linked(root, *map(np.concatenate, zip(*links, strict=True))), [], 0
    if links:
        root = _linked(root, *map(np.concatenate, zip(*links, strict=True)))
    a, b = root[end[:n]], root[end[n:]]
    w = np.flatnonzero(a != b)
    a, b, x1, y1, x2, y2 = a[w], b[w], x1[w], y1[w], x2[w], y2[w]
    # nodes on a wire: those of its page in its span of x or of y, whichever has fewer
    spots = np.flatnonzero(root == np.arange(len(root)))
    n_nodes = np.bincount(p[spots], minlength=pages)
    lists = []
    for c, u, v in ((x, x1, x2), (y, y1, y2)):
        mine = spots[np.isfinite(c[spots])]
        mine = mine[np.lexsort((c[mine], p[mine]))]
        at = p[mine] + 0j
        at.imag = c[mine]
        side = lambda z, low: np.searchsorted(at, low, z)  # noqa: E731, B023
        low, high = p[a] + 0j, p[a] + 0j
        low.imag, high.imag = np.fmin(u, v) - 1.01 * snap, np.fmax(u, v) + 1.01 * snap
        known = np.isfinite(u) & np.isfinite(v)
        low[~known], high[~known] = 0, 0
        begin = side("left", low)
        lists.append((mine, begin, np.where(known, side("right", high) - begin, 0)))
    shorter = lists[0][2] <= lists[1][2]
    taps = [(np.arange(len(w)), np.full(len(w), -1.0), a), (np.arange(len(w)), np.full(len(w), 2.0), b)]
    for (mine, begin, many), chosen in zip(lists, (shorter, ~shorter), strict=True):
        asking = np.flatnonzero(chosen & (many > 0))
        if not len(asking):
            continue
        upto = np.cumsum(many[asking])
        cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1], PAIRS)))
        for lo, hi in zip(cuts, [*cuts[1:], len(asking)], strict=True):
            g, m = asking[lo:hi], many[asking[lo:hi]]
            g, s = np.repeat(g, m), mine[np.arange(m.sum()) + np.repeat(begin[g] - np.cumsum(m) + m, m)]
            other = (s != a[g]) & (s != b[g])
            g, s = g[other], s[other]
            dx, dy = x2[g] - x1[g], y2[g] - y1[g]
            t = ((x[s] - x1[g]) * dx + (y[s] - y1[g]) * dy) / (dx * dx + dy * dy)
            off = (x1[g] + t * dx - x[s]) ** 2 + (y1[g] + t * dy - y[s]) ** 2
            on = (t > MARGIN) & (t < 1 - MARGIN) & (off <= snap * snap)
            taps.append((g[on], t[on], s[on]))
    g, t, s = map(np.concatenate, zip(*taps, strict=True))
    order = np.lexsort((s, t, g))
    g, s = g[order], s[order]
    hop = np.flatnonzero(g[1:] == g[:-1])
    a, b = s[hop], s[hop + 1]
    degree = np.bincount(np.concatenate([a, b]), minlength=len(p))
    count = lambda c: np.bincount(c, minlength=pages)
    net = _linked(np.arange(len(p)), a, b)
    counts = [count(page), n_nodes, count(p[a]), count(p[a[(degree[a] >= 2) & (degree[b] >= 2)]]), count(p[degree >= 3])]
    names, n_edges = np.unique(net[a], return_counts=True)
    return counts, [p[names], x[names], y[names], np.bincount(net[degree > 0], minlength=len(p))[names], n_edges]


COUNTS = ("n_segments", "n_nodes", "n_edges", "going", "n_junctions")


def _by_page(wires: DataFrame, snap: float) -> DataFrame:
    """page, COUNTS, nets (x, y, n_nodes, n_edges): wires of a page come together, and in order of page."""
    of, most = wires.select("page").schema[0].dataType.simpleString(), ROWS

    def solve(rows: pa.Table) -> pa.RecordBatch:
        code = rows["page"].combine_chunks().dictionary_encode()
        counts, nets = _solved(code.indices.to_numpy().astype(np.int64), *[rows[c].to_numpy() for c in ("x1", "y1", "x2", "y2")], snap)
        ends = pa.array(np.searchsorted(nets[0], np.arange(len(code.dictionary) + 1)), pa.int32())
        each = pa.StructArray.from_arrays([pa.array(c) for c in nets[1:]], ["x", "y", "n_nodes", "n_edges"])
        return pa.RecordBatch.from_arrays([code.dictionary, *map(pa.array, counts), pa.ListArray.from_arrays(ends, each)], ["page", *COUNTS, "nets"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n < most:
                continue
            rows = pa.Table.from_batches(held)
            # the last page may go on
            page = rows["page"].combine_chunks()
            whole = pc.index(page, page[-1]).as_py()
            if whole:
                yield solve(rows.slice(0, whole))
            held = rows.slice(whole).combine_chunks().to_batches()
            n = n - whole
        if n:
            yield solve(pa.Table.from_batches(held))

    kinds = f"page {of}, {', '.join(f'{c} long' for c in COUNTS)}, nets array<struct<x:double,y:double,n_nodes:long,n_edges:long>>"
    return wires.repartition("page").sortWithinPartitions("page").mapInArrow(run, kinds)


def _by_cell(wires: DataFrame, snap: float) -> tuple[DataFrame, DataFrame]:
    """(nets, pages with COUNTS and n_nets) of pages of any size."""
    wires = materialize(wires, "segments")
    nodes = materialize(nodes_of(wires, snap), "nodes")
    edges = materialize(edges_of(wires, nodes, snap), "edges")
    nets = materialize(nets_of(edges), "nets")
    ends = edges.select("page", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    degree = ends.groupBy("page", "p").agg(F.count(F.lit(1)).alias("d"))
    end = lambda i: degree.select("page", F.col("p.x").alias(f"{i}x"), F.col("p.y").alias(f"{i}y"), F.col("d").alias(f"d{i}"))
    going = edges.join(end("a"), ["page", "ax", "ay"]).join(end("b"), ["page", "bx", "by"]).groupBy("page").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if((F.col("da") >= 2) & (F.col("db") >= 2)).alias("going"))
    junctions = degree.groupBy("page").agg(F.count_if(F.col("d") >= 3).alias("n_junctions"))
    counted = wires.groupBy("page").agg(F.count(F.lit(1)).alias("n_segments"))
    places = nodes.select("page", "nx", "ny").distinct().groupBy("page").agg(F.count(F.lit(1)).alias("n_nodes"))
    met = counted.join(places, "page").join(going, "page", "left").join(junctions, "page", "left").join(nets.groupBy("page").agg(F.count(F.lit(1)).alias("n_nets")), "page", "left")
    return nets, met.select("page", *COUNTS, "n_nets").na.fill(0, ["n_edges", "going", "n_junctions", "n_nets"])


def netlist(segments: DataFrame, labels: DataFrame | None = None, snap: float = SNAP, digits: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nets, pages) of drawings. segments: page, x1, y1, x2, y2; labels: page, text.

    nets: page, net, n_nodes, n_edges. pages: n_segments, n_nodes, n_edges, n_nets, n_junctions (nodes of three wires or more),
    n_labels and a confidence: half for wires that go on at both ends, the rest for junctions and labels, eight of each being
    enough, and for a sane number of nets, rounded to `digits`. Pages without a wire aren't returned. What is read of the two is computed then."""
    frugal(segments.sparkSession)
    wires = _wires(segments).where("page IS NOT NULL")
    large = materialize(wires.groupBy("page").count().where(F.col("count") > LARGE).select("page"), "large")
    few = large.count()
    solved = _by_page(wires.join(large, "page", "left_anti") if few else wires, snap)
    nets = solved.select("page", F.inline("nets")).select("page", _key(F.col("page"), F.col("x"), F.col("y")).alias("net"), "n_nodes", "n_edges")
    met = solved.select("page", *COUNTS, F.size("nets").cast("long").alias("n_nets"))
    if few:
        more = _by_cell(wires.join(large, "page", "left_semi"), snap)
        nets, met = nets.union(more[0].select(*nets.columns)), met.union(more[1].select(*met.columns))
    if labels is not None:
        named = labels.where(F.upper(F.trim("text")).rlike(LABEL)).groupBy("page").agg(F.count(F.lit(1)).alias("n_labels"))
        met = met.join(named, "page", "left").na.fill(0, ["n_labels"])
    else:
        met = met.withColumn("n_labels", F.lit(0).cast("long"))
    part = lambda c: F.least(F.lit(1.0), F.col(c) / 8)
    score = 0.5 * F.col("going") / F.col("n_edges") + 0.2 * part("n_junctions") + 0.18 * part("n_labels") + F.when(F.col("n_nets").between(1, 200), 0.12).otherwise(0.0)
    confidence = F.when(F.col("n_edges") == 0, 0.0).otherwise(F.round(F.least(F.lit(0.97), score), digits))
    return nets, met.select("page", "n_segments", "n_nodes", "n_edges", "n_nets", "n_junctions", "n_labels", confidence.alias("confidence"))
