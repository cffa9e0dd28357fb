"""Copies of texts that repeat a phrase throughout."""

import random

import brute
from lodestone.llm import substring
from test_ops import frame


def test_repeated_phrases(spark):
    rng = random.Random(7)
    rows = []
    for period in range(2, 9):
        for i in range(6):
            text = " ".join([f"p{period}x{i}y{rng.randrange(10**6)}" for _ in range(period)] * (240 // period))
            d = 1000 * period + 10 * i
            rows += [(d, text), (d + 1, text), (d + 2, f"before {d} {text} after {d}")]
    got = sorted((tuple(r) for r in substring.substring_dedup(frame(spark, rows)).collect()), key=repr)
    assert got == brute.substring_dedup(rows)
