"""Periodic runs against a plain version that tries every period."""

import hashlib
import random
import zlib

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from brute import words
from lodestone.llm import runs, tokens as tk
from lodestone.llm.queries import looped, op11_periodic_runs

TEXTS = st.lists(st.lists(st.sampled_from(["a", "b", "é", "日本", "A"]), max_size=60).map(" ".join), max_size=6)


def plain_runs(w):
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def check(texts, limit=1 << 20):
    for lo, hi, cut in tk.slices(pa.array(texts, pa.string()), limit):
        found = runs.slice_runs(cut)
        left = runs._collapsed(cut, found).to_pylist()
        for r in range(hi - lo):
            w = words(texts[lo + r])
            expected = plain_runs(w)
            assert [tuple(x[1:]) for x in found.tolist() if x[0] == r] == expected
            assert left[r] == collapsed(w, expected)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_few_words(texts):
    check(texts)


def test_repeats_in_repeats():
    rng = random.Random(5)
    for _ in range(150):
        texts = [None, "", " \n\t"]
        for _ in range(6):
            w = [rng.choice("abc") for _ in range(rng.choice([0, 5, 6, 40, 150]))]
            if w:
                a, p = rng.randrange(len(w)), rng.randint(1, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w)) if i < a or a + (i - a) % p < len(w)]
            texts.append(rng.choice([" ", "\n", " \t "]).join(w + w[-3:] + w))
        check(texts, rng.choice([40, 1 << 20]))


def test_long_texts():
    for w, expected in ((["a"] * 100_000, (0, 100_000, 1)), (["a", "b"] * 40_000 + ["a"], (0, 80_001, 2)), ([str(i % 1000) for i in range(50_000)], (0, 50_000, 1000))):
        (_, _, cut), = tk.slices(pa.array([" ".join(w)]))
        assert [tuple(x[1:]) for x in runs.slice_runs(cut).tolist()] == [expected]


def test_operator_keeps_columns_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x a a a a a a", "keep", 7), (None, None, None, None), (1, "x a a a a a a", "keep", 7), (3, "", "", 0)], "doc_id long, text string, runs string, collapsed int")
    out = runs.find_runs(docs)
    assert out.columns == ["doc_id", "text", "runs", "collapsed", "runs_", "collapsed_"]
    rows = sorted(map(tuple, out.collect()), key=repr)
    assert [r for r in rows if r[0] == 1] == [(1, "x a a a a a a", "keep", 7, [(1, 6, 1)], "x a")] * 2
    assert (3, "", "", 0, [], "") in rows and (None, None, None, None, [], "") in rows
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.choice([0, 3, 30, 90])))) for i in range(300)] + [(None, "b b b b b b b"), (10**12, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for d, t in rows:
        w = words(t)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append((d, len(found), s, n, q, n and 1000 * n // q, sha(lines), sha(collapsed(w, found))))
    out = op11_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    assert sum(e[1] > 0 for e in expected) > 10 and looped(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() == 302
