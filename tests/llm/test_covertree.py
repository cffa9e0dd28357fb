"""Near vectors against all pairs."""

import math
import random

import numpy as np
import pytest

from brute import components
from lodestone.llm import covertree


def plain(rows, least=0.93):
    def cosine(a, b):
        return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))

    def good(r):
        return None not in r[:2] and r[2] and all(x is not None and math.isfinite(x) for x in r[2]) and any(r[2])

    n, links = [0] * len(rows), []
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if good(a) and good(b) and a[1] == b[1] and len(a[2]) == len(b[2]) and cosine(a[2], b[2]) >= least:
                n[i] += 1
                n[j] += 1
                links.append((a[0], b[0]))
    found = components({r[0] for r in rows if r[0] is not None}, links)
    return sorted(((r[0], k, found.get(r[0]), r[0] is not None and found[r[0]] == r[0]) for r, k in zip(rows, n)), key=repr)


def made(rng, n, dim, label=lambda i: i % 3):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(max(2, n // 12))]
    rows = []
    for i in range(n):
        c = rng.choice(centres) if rng.random() < 0.7 else [rng.gauss(0, 1) for _ in range(dim)]
        s = rng.choice([0, 0.01, 0.1, 0.2, 0.3])
        rows.append((i, label(i), [float(np.float32(x + s * rng.gauss(0, 1))) for x in c]))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    return sorted(map(tuple, covertree.near_vectors(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("piece, pivots, dim", [(1024, 512, 8), (16, 512, 8), (10, 3, 4), (7, 1, 3)])
def test_all_pairs(spark, piece, pivots, dim):
    rng = random.Random(piece)
    rows = made(rng, 240, dim)
    rows += [(500 + i, r[1], r[2]) for i, r in enumerate(rows[:30])] + [(600 + i, 1, rows[1][2]) for i in range(40)]
    rows += [(700, None, rows[0][2]), (701, 0, None), (702, 0, []), (703, 0, [0.0] * dim), (704, 0, [math.nan] * dim), (705, 0, [math.inf] + [1.0] * (dim - 1)), (706, 0, [None] * dim)]
    rows += [(707, 0, rows[0][2][:-1]), (708, 0, rows[3][2][:-1]), (None, 0, rows[0][2]), (710, 0, [-x for x in rows[0][2]]), (711, 0, [x * 1e100 for x in rows[0][2]]), (712, 1, [1 / 3] * dim)]
    assert run(spark, rows, piece=piece, most_pivots=pivots) == plain(rows)


def test_repeated_ids_and_one_label(spark):
    rows = made(random.Random(9), 120, 5, lambda i: 4)
    rows += [(3, 4, rows[50][2]), (3, 4, rows[3][2]), (7, None, [1.0])]
    assert run(spark, rows, piece=20) == plain(rows)


def test_bound_is_kept(spark):
    """Pairs at the bound, in two dimensions, where a cosine is that of an angle."""
    angle = math.acos(0.93)
    rows = [(i, 0, [math.cos(a), math.sin(a)]) for i, a in enumerate([0, angle - 1e-9, 2 * angle, 2 * angle + 1e-6, 3 * angle + 2e-6])]
    assert run(spark, rows, piece=2) == plain(rows)


def test_empty_and_other_columns(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0], 5, "x"), (2, 0, [1.0, 0.01], 6, "y")], "vec_id long, label int, embedding array<double>, c int, v string")
    assert sorted(map(tuple, covertree.near_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert covertree.near_vectors(df.limit(0)).collect() == []


def test_trees_are_nested_and_cover():
    x = covertree.units(np.random.default_rng(1).normal(size=(300, 3)))
    levels = covertree.tree(x)
    for (rows, _, radius), r in zip(levels, covertree.RADII):
        d = np.sqrt(np.maximum(0, 2 - 2 * x[rows] @ x[rows].T)) + 9 * np.eye(len(rows))
        assert d.min() > r and (np.sqrt(np.maximum(0, 2 - 2 * x @ x[rows].T)).min(axis=1) <= r + 1e-9).all()
    for (above, _, _), (rows, parent, _) in zip(levels, levels[1:]):
        assert set(above) <= set(rows) and len(parent) == len(rows)
    # far pairs are dropped above single vectors
    far = covertree.units(np.array([[1, 0.01 * i, 0] for i in range(50)]))
    assert covertree.linked(far, covertree.tree(far), -far, covertree.tree(-far), 0.93, False)[2].size == 0
