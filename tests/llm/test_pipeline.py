"""The pipeline's stages against plain versions."""

import brute
import corpus_pipeline as cp
from lodestone.llm import decontaminate
from lodestone.llm.common import table
from test_ops import plain_quality
from test_runs import plain_runs


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = cp.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns
    now = [r for r in rows if not plain_quality(r[1])[-1]]  # no host of this table is rejected
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in now)

    cut = cp.line_dedup(spark, kept, sf)
    want = [(d, t) for d, t, _ in plain_runs(now) if t.strip(brute.BLANKS) or not dict(rows)[d].strip(brute.BLANKS)]
    assert cut.columns == docs.columns and sorted((tuple(r) for r in cut.select("doc_id", "text").collect()), key=repr) == want

    one = cp.near_duplicates(spark, cut, sf)
    classes = brute.jaccard_classes(want)
    assert one.columns == docs.columns and sorted(r[0] for r in one.select("doc_id").collect()) == sorted(d for d, _, c in classes if d == c)

    clean = cp.decontamination(spark, one, sf)
    left = {d: t for d, t in want if d in {d for d, _, c in classes if d == c}}
    items = {r[0]: brute.shingles(r[1]) for r in table(spark, sf, "benchmark").collect()}
    bad = {d for d, t in left.items() if any(len(s & brute.shingles(t)) >= 0.75 * len(s) for s in items.values())}
    assert sorted(r[0] for r in clean.select("doc_id").collect()) == sorted(set(left) - bad)
    assert set(decontaminate.decontaminate(one, table(spark, sf, "benchmark")).columns) == set(docs.columns)

    mixed = cp.mixing_sources(spark, clean, sf)
    total = sum(len(brute.words(t)) for d, t in left.items() if d not in bad)
    got = sum(len(brute.words(r["text"])) for r in mixed.collect())
    assert abs(got - 1.5 * total) <= len(left)


def test_odd_tables(spark, sf):
    """Nulls, repeated rows and ids, and columns named like those that the stages add."""
    a, b = (" ".join(f"{x}{i}" for i in range(70)) for x in "ab")
    names = ["n_words", "kept", "quality", "host_", "host_rate", "leak", "best", "component_id", "mix_size", "repetition", "removed_lines", "near_doc", "key"]
    rows = [(1, a, "s", 9), (1, a, "s", 9), (1, b, "s", 9), (2, a + " x", None, None), (None, a, "s", 9), (3, None, "s", 0), (4, "", None, 0), (None, None, None, None)]
    docs = spark.createDataFrame([(*r, *["keep"] * len(names)) for r in rows], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    want = {"quality_rules": [(None, a), (1, a), (1, a), (1, b), (2, a + " x")], "ngram_jaccard": [(None, a), (1, a), (1, b)]}
    now = docs
    for name, stage in cp.STAGES:
        out = stage(spark, now, sf)
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
        assert name not in want or got == sorted(want[name], key=repr)
        assert out.columns[: len(docs.columns)] == docs.columns and {r[n] for r in out.collect() for n in names} <= {"keep"}
        assert stage(spark, docs.limit(0), sf).count() == 0
        now = spark.createDataFrame(out.collect(), out.schema) if name != "mixing" else now
