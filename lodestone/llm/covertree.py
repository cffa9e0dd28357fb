"""Near duplicates of embeddings by a dual traversal of cover trees.

Vectors of one label and length are unit vectors of one tree. Cosines of `least` or more are distances of
t = sqrt(2 - 2 least) or less. A pair of nodes whose centres are further apart than their covering radii
and t together has no pair below it and is dropped; what is left is compared in double precision.
Covering radii are measured, not assumed, so nothing depends on how well a net fits.

1. Equal vectors are one class with a weight; copies never meet.
2. Top of the tree: the farthest-first order of at most `PIVOTS` vectors, chosen by hash, is a sequence of
   nested nets. A label takes as long a prefix of it as it needs for cells of about a piece each, and its
   vectors go to the nearest centre. A cell that is fuller than a piece, such as that of a group of near
   copies, is dealt over several pieces by hash.
3. Lower levels: within a piece, farthest-first again gives nested nets of radius 1, 1/2, 1/4, ..., each
   centre below its nearest one of the level above. A piece with its tree is one row of bounded size.
4. Traversal: pairs of cells, then pairs of pieces, are joined on their label and level by level pruned by
   the bound; for pairs of pieces that are left the two rows meet, and both trees are descended together,
   a level at a time, only with nodes that still have a partner.

A pair of pieces returns a row for each vector with links: their weight, and one edge to the group that the
vector is connected with there. So a group of m near copies costs m^2 comparisons in blocks, but m rows a
pair of pieces. Vectors without structure, all far apart, leave nothing to prune above single vectors:
every pair of a label's pieces is then read, n / PIECE times the input. That is the price of exact pairs.

Defined cases: a null label, a null, empty or zero vector, or one with a null or non-finite component links with
nothing, nor do vectors of different lengths; a row without a vec_id has no links and a null component, and
isn't kept; rows that repeat a vec_id are vectors of their own for n_links and one node of the components;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.operators.graph import connected_components
from lodestone.sources.scratch import discard, frugal, materialize, small

LEAST = 0.93
#: Vectors that the top of the tree is fitted to, over all labels.
PIVOTS = 512
#: Vectors of a piece at most on average, and numbers in it.
PIECE, NUMBERS = 1024, 1 << 18
#: Radii of the nested nets within a piece.
RADII = (1.0, 0.5, 0.25, 0.125)
#: Slack of the bound, for rounding.
EPS = 1e-9

CLASSES = "label long, dim int, c long, weight long, v array<double>"
META = "label long, dim int, cell int, salt int, centre array<double>, radius double, reach double, size int"


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _good() -> Column:
    """Whether a row may link."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, v, h of the rows that may link: v holds doubles without a negative zero, h is its hash."""
    plain = vectors.where(_good()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    return plain.select("vec_id", "label", F.size("v").alias("dim"), "v", F.xxhash64("label", "v").alias("h"))


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their size."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def farthest_first(x: np.ndarray, least: float = 0.0, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of unit rows so that each is the farthest from all before it, and its distance to them; it ends at `least` or after `most`. Ties go to the smaller row."""
    order, apart = [0], [math.inf]
    away = 2 - 2 * (x @ x[0])
    while len(order) < min(most or len(x), len(x)):
        i = int(away.argmax())
        if away[i] <= least * least:
            break
        order.append(i)
        apart.append(math.sqrt(away[i]))
        np.minimum(away, 2 - 2 * (x @ x[i]), out=away)
    return np.array(order), np.array(apart)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each row the nearest centre; all are unit vectors."""
    return (x @ centres.T).argmax(axis=1)


def tree(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(centres' rows, parent of each in the level above, covering radius) of each level, the last of which are all rows."""
    order, apart = farthest_first(x, RADII[-1])
    levels, above = [], np.zeros(1, np.int64)
    for r in RADII:
        rows = order[: int((apart > r).sum())]
        if levels and len(rows) == len(levels[-1][0]):
            continue
        levels.append((rows, nearest(x[rows], x[above]) if levels else np.zeros(len(rows), np.int64)))
        above = rows
        if len(rows) == len(x):
            break
    levels.append((np.arange(len(x)), nearest(x, x[above])))
    # covering radii, from below: every row's node in each level
    node, out = np.arange(len(x)), []
    for rows, parent in reversed(levels):
        d = np.sqrt(((x - x[rows[node]]) ** 2).sum(axis=1))
        radius = np.zeros(len(rows))
        np.maximum.at(radius, node, d)
        out.append((rows, parent, radius))
        node = parent[node]
    return out[::-1]


def linked(a: np.ndarray, tree_a: list, b: np.ndarray, tree_b: list, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a and of b that may have links, and which pairs of them do: both trees are descended together.

    The shorter tree's last level, single vectors, waits for the other."""
    t = math.sqrt(max(0.0, 2 - 2 * least))
    alive, at_a, at_b = np.ones((1, 1), bool), np.zeros(1, np.int64), np.zeros(1, np.int64)
    before_a = before_b = 1
    for level in range(max(len(tree_a), len(tree_b))):
        if level < len(tree_a):
            rows_a, parent, r_a = tree_a[level]
            place = np.full(before_a, -1)
            place[at_a] = np.arange(len(at_a))
            mine = place[parent]
            at_a, alive, before_a = np.flatnonzero(mine >= 0), alive[mine[mine >= 0]], len(rows_a)
        if level < len(tree_b):
            rows_b, parent, r_b = tree_b[level]
            place = np.full(before_b, -1)
            place[at_b] = np.arange(len(at_b))
            mine = place[parent]
            at_b, alive, before_b = np.flatnonzero(mine >= 0), alive[:, mine[mine >= 0]], len(rows_b)
        dot = a[rows_a[at_a]] @ b[rows_b[at_b]].T
        far = np.sqrt(np.maximum(0, 2 - 2 * dot))
        alive = alive & (far <= r_a[at_a][:, None] + r_b[at_b][None, :] + t + EPS)
        keep_a, keep_b = alive.any(axis=1), alive.any(axis=0)
        at_a, at_b, alive, dot = at_a[keep_a], at_b[keep_b], alive[keep_a][:, keep_b], dot[keep_a][:, keep_b]
        if not len(at_a):
            break
    hit = dot >= least if len(at_a) else np.zeros((0, 0), bool)
    if same:
        hit &= at_a[:, None] != at_b[None, :]
    return at_a, at_b, hit


def groups_of(hit: np.ndarray, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node of its group. rows, columns: the nodes of a table of links, the same ones or others."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, rows, np.where(hit, label[columns][None, :], n).min(axis=1, initial=n))
        np.minimum.at(new, columns, np.where(hit, label[rows][:, None], n).min(axis=0, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _cells(pivots: dict[int, np.ndarray]):
    """Adds the cell to (label, dim, c, weight, v, k): the nearest of the first k pivots of the length, -1 where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "k"))
            cell = np.full(len(dims), -1, np.int32)
            for dim in np.unique(dims):
                if dim in pivots:
                    mine = np.flatnonzero(dims == dim)
                    x = units(_matrix(batch.column("v").take(pa.array(mine)), int(dim)))
                    for k in np.unique(ks[mine]):
                        some = ks[mine] == k
                        cell[mine[some]] = nearest(x[some], pivots[dim][:k])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("label", "dim", "c", "weight", "v")], pa.array(cell)], ["label", "dim", "c", "weight", "v", "cell"])

    return run


def _piece(pivots: dict[int, np.ndarray]):
    """One row for the vectors of a piece: a centre, its radius, how far they are from the pivot, and their numbers."""

    def run(table: pa.Table) -> pa.Table:
        label, dim, cell, salt = (table.column(c)[0].as_py() for c in ("label", "dim", "cell", "salt"))
        table = table.sort_by("c")
        given = _matrix(table.column("v"), dim)
        with np.errstate(over="ignore"):
            x, short = units(given), given.astype(np.float32)
        middle = x.mean(axis=0)
        pivot = pivots[dim][cell] if cell >= 0 else middle
        away = lambda y: float(np.sqrt(((x - y) ** 2).sum(axis=1)).max())
        row = {"label": label, "dim": dim, "cell": cell, "salt": salt, "centre": middle.tolist(), "radius": away(middle), "reach": away(pivot), "size": x.size}
        packed = {"ids": table.column("c").to_numpy().tobytes(), "weights": table.column("weight").to_numpy().tobytes(), "x": (short if (short == given).all() else given).tobytes()}
        return pa.Table.from_pylist([row | packed], _PIECE_SCHEMA)

    return run


_PIECE_SCHEMA = pa.schema([
    ("label", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("salt", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()),
    ("reach", pa.float64()), ("size", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary()), ("x", pa.binary()),
])


def _met(least: float):
    """Pairs of pieces to rows (c, links, other): the weight of a vector's links there, and a vector of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[bytes, list] = {}

        def unpacked(r: dict, side: str) -> tuple:
            ids = np.frombuffer(r[f"ids_{side}"], np.int64)
            key, data, n = r[f"ids_{side}"], r[f"x_{side}"], r[f"size_{side}"]
            x = units(np.frombuffer(data, np.float32 if len(data) == 4 * n else np.float64).astype(float).reshape(len(ids), -1))
            if key not in trees:
                if len(trees) >= 16:
                    trees.clear()
                trees[key] = tree(x)
            return ids, np.frombuffer(r[f"weights_{side}"], np.int64), x, trees[key]

        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                same = r["a"] == r["b"]
                ids_a, w_a, a, tree_a = unpacked(r, "a")
                ids_b, w_b, b, tree_b = unpacked(r, "b")
                at_a, at_b, hit = linked(a, tree_a, b, tree_b, least, same)
                if not hit.any():
                    continue
                # in a piece met with itself, rows and columns are the same vectors
                ids, shift = (ids_a, 0) if same else (np.concatenate([ids_a, ids_b]), len(ids_a))
                other = ids[groups_of(hit, at_a, at_b + shift, len(ids))]
                out = [(ids_a[at_a], hit @ w_b[at_b], other[at_a])]
                if not same:
                    out.append((ids_b[at_b], w_a[at_a] @ hit, other[at_b + shift]))
                for c, n, to in out:
                    has = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(c[has]), pa.array(n[has].astype(np.int64)), pa.array(to[has])], ["c", "links", "other"])

    return run


def _pivots(classes: DataFrame, most: int) -> dict[int, np.ndarray]:
    """The top of the tree: `most` vectors with the smallest hashes, by length, in farthest-first order."""
    some = classes.orderBy(F.xxhash64("v", "label"), "c").limit(most).select("dim", "v").collect()
    by_dim: dict[int, list] = {}
    for r in some:
        by_dim.setdefault(r.dim, []).append(r.v)
    out = {}
    for dim, rows in by_dim.items():
        x = units(np.array(rows))
        out[dim] = x[farthest_first(x)[0]]
    return out


def piece_pairs(pieces: DataFrame, pivots: dict[int, np.ndarray], least: float) -> DataFrame:
    """Pairs (a, b) of pieces with a <= b that may have links. pieces: p and META."""
    t = math.sqrt(max(0.0, 2 - 2 * least))
    spark = pieces.sparkSession
    tops = spark.createDataFrame([(int(d), i, row.tolist()) for d, x in pivots.items() for i, row in enumerate(x)], "dim int, cell int, pivot array<double>")
    cells = pieces.groupBy("label", "dim", "cell").agg(F.max("reach").alias("reach")).join(F.broadcast(tops), ["dim", "cell"], "left")
    side = lambda df, x, *on: df.select(*on, *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in on])
    near_cells = side(cells, "a", "label", "dim").join(side(cells, "b", "label", "dim"), ["label", "dim"]).where("cell_a <= cell_b")
    bound = F.col("reach_a") + F.col("reach_b") + t + EPS
    near_cells = near_cells.where(F.coalesce(_distance("pivot_a", "pivot_b") <= bound, F.lit(True))).select("label", "dim", "cell_a", "cell_b")
    meta = pieces.select("p", "label", "dim", "cell", "centre", "radius")
    met = near_cells.join(side(meta, "a", "label", "dim"), ["label", "dim", "cell_a"]).join(side(meta, "b", "label", "dim"), ["label", "dim", "cell_b"])
    met = met.where((F.col("cell_a") < F.col("cell_b")) | (F.col("p_a") <= F.col("p_b")))
    return met.where(_distance("centre_a", "centre_b") <= F.col("radius_a") + F.col("radius_b") + t + EPS).select(F.col("p_a").alias("a"), F.col("p_b").alias("b"))


def class_links(classes: DataFrame, least: float = LEAST, piece: int = PIECE, most_pivots: int = PIVOTS) -> DataFrame:
    """(c, links, other) for every class with links, several rows a class: sum the links; each `other` is connected with c."""
    pivots = _pivots(classes, most_pivots)
    room = F.greatest(F.lit(1), F.least(F.lit(piece), F.expr(f"{NUMBERS} DIV dim")))
    sizes = small(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.least(F.lit(most_pivots), F.ceil(F.col("n") / room)).cast("int")).drop("n"), "labels")
    dealt = materialize(classes.join(sizes, ["label", "dim"]).select("label", "dim", "c", "weight", "v", "k").mapInArrow(_cells(pivots), f"{CLASSES}, cell int"), "cells")
    over = small(dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias("salts")), "salts")
    salted = dealt.join(over, ["label", "dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("c"), F.col("salts")).cast("int")).drop("salts")
    made = salted.groupBy("label", "dim", "cell", "salt").applyInArrow(_piece(pivots), f"{META}, ids binary, weights binary, x binary")
    pieces = materialize(made.withColumn("p", F.monotonically_increasing_id()), "pieces")
    pairs = piece_pairs(pieces, pivots, least)
    pack = lambda x: pieces.select(F.col("p").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "ids", "weights", "x")])
    met = pairs.join(pack("a"), "a").join(pack("b"), "b").mapInArrow(_met(least), "c long, links long, other long")
    out = materialize(met, "met")
    discard(sizes, dealt, over, pieces)
    return out


def near_vectors(vectors: DataFrame, least: float = LEAST, piece: int = PIECE, most_pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, label, embedding)."""
    frugal(vectors.sparkSession)
    rows = _usable(vectors)
    # a class gets its number when it is written, and keeps it
    grouped = rows.groupBy("label", "dim", "h", "v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"))
    classes = materialize(grouped.withColumn("c", F.monotonically_increasing_id()), "classes")
    met = class_links(classes, least, piece, most_pivots)
    counts = met.groupBy("c").agg(F.sum("links").alias("links"))
    name = lambda c: classes.select(F.col("c").alias(c), F.col("first").alias(f"first_{c}"))
    edges = met.select("c", "other").distinct().join(name("c"), "c").join(name("other"), "other").select("first_c", "first_other")
    # rows to their classes: by hash, then by the numbers themselves
    of = classes.select("h", F.col("v").alias("v_"), "c", "first", "weight")
    placed = materialize(rows.join(of, "h").where(F.col("v") == F.col("v_")).select("vec_id", "c", "first", "weight"), "placed")
    joined = connected_components(edges.union(placed.where("vec_id <> first").select("vec_id", "first")), "first_c", "first_other")
    known = placed.join(counts, "c", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    none = vectors.where(~_good()).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"))
    named = known.union(none.where("vec_id IS NOT NULL")).join(joined, F.col("vec_id") == F.col("node"), "left")
    out = named.select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id")).union(none.where("vec_id IS NULL").select("vec_id", "n_links", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
