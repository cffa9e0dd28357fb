"""Words beyond the network's list have their own probabilities."""

import math

import numpy as np

from lodestone.llm import lmscore, tokens as tk
from test_ops import frame


def bucket(word):
    data = np.frombuffer(word.encode(), np.uint8)
    h = tk.word_hashes(tk.split(data, np.array([0, len(data)])), lower=True)
    return int((h[0] >> np.uint64(20)) % np.uint64(lmscore.IDS - lmscore.TOP))


def test_words_of_one_bucket_differ(spark):
    listed = " ".join(f"k{i}" for i in range(lmscore.TOP))
    real = "real"
    garbled = next(w for w in (f"x{i}" for i in range(100000)) if bucket(w) == bucket(real))
    other = next(w for w in (f"y{i}" for i in range(100000)) if bucket(w) != bucket(real))
    rows = [(i, listed) for i in range(40)] + [(100, f"k1 k2 {real} k3 k4"), (101, f"k1 k2 {garbled} k3 k4"), (102, " ".join([real] * 8)), (103, other), (None, f"k1 k2 {real} k3 k4"), (100, f"k1 k2 {real} k3 k4"), (104, None)]
    got = [(r["doc_id"], r["log_likelihood"]) for r in lmscore.score(frame(spark, rows)).collect()]
    by = dict(got)
    assert len(got) == len(rows) and by[104] == 0
    # real occurs 11 times, garbled once
    assert abs(by[100] - by[101] - math.log(11)) < 1e-3
    assert all(abs(v - by[100]) < 1e-3 for d, v in got if d in (100, None))
