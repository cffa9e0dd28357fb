"""The operators against plain versions, with nulls, ties, repeats, empty and long texts and extra columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from lodestone.llm import chat, decontaminate, jaccard, lmscore, mixing, quality, substring, toxicity, urls

DOC = "doc_id long, text string, source string, n_chars long, n_words string, size string"
VOCAB = [f"w{i}" for i in range(40)] + ["the", "of", "É", "Ünï", "A", "b#"]


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    texts = []
    passage = [rng.choice(VOCAB) + str(i) for i in range(60)]
    for _ in range(n):
        kind = rng.random()
        words = [rng.choice(VOCAB) for _ in range(rng.randrange(0, 120))]
        if kind < 0.3 and texts:
            words = rng.choice(texts).split()
            if words:
                words[rng.randrange(len(words))] = "changed"
        elif kind < 0.5:
            at = rng.randrange(len(words) + 1)
            words = words[:at] + passage + words[at:]
        elif kind < 0.6 and texts:
            words = rng.choice(texts).split()
        elif kind < 0.65:
            words = ["same"] * rng.randrange(10, 200)
        texts.append(rng.choice([" ", "  ", "\t"]).join(words))
    texts += ["", "   ", None, "one", "long " * 5000, " ".join(passage)]
    return list(enumerate(texts, 100))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, f"src{(d or 0) % 3}" if d != 101 else None, len(t or ""), "x", "y") for d, t in rows], DOC)


def test_substring(spark):
    rows = corpus() + [(None, "a b c " * 10), (100, corpus()[0][1]), (5, None)]
    got = sorted((tuple(r) for r in substring.substring_dedup(frame(spark, rows)).collect()), key=repr)
    assert got == brute.substring_dedup(rows)
    assert substring.substring_dedup(frame(spark, rows).limit(0)).count() == 0


def test_substring_text(spark):
    words = " ".join(f"x{i}" for i in range(30))
    got = {r["doc_id"]: r["kept_text"] for r in substring.substring_dedup(frame(spark, [(1, words), (2, "p " + words + " q")]), with_text=True).collect()}
    assert got == {1: words, 2: "p q"}


def test_jaccard(spark):
    rows = corpus(5, 80)
    got = sorted(tuple(r) for r in jaccard.jaccard_classes(frame(spark, rows)).collect())
    assert got == brute.jaccard_classes(rows)


def test_jaccard_edges(spark):
    rows = [(3, "A b"), (4, "a B"), (5, ""), (6, None), (None, "a b"), (7, "a b c"), (7, "a b c")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(frame(spark, rows)).collect()}
    assert got == {(3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6), (None, 1, None), (7, 1, 7)}
    assert jaccard.jaccard_classes(frame(spark, rows).limit(0)).count() == 0


def test_chat_grammar():
    rng = random.Random(1)
    signs = ["\\", "#", "##", "###", "### ", "<", "</turn>", ": ", "\n", "a", "é", " "]
    for _ in range(3000):
        role, text = ("".join(rng.choice(signs) for _ in range(rng.randrange(6))) for _ in range(2))
        piece, a, b, escaped = chat.format_turn(role, text)
        assert chat.parse(piece) == [(role, text)]
        assert not escaped or chat.unescape(piece[a:b]) == text
    pieces = [chat.format_turn(r, t)[0] for r, t in (("user", "a"), ("assistant", "### user: x</turn>\n"))]
    assert chat.parse("".join(pieces)) == [("user", "a"), ("assistant", "### user: x</turn>\n")]
    assert chat.parse("no turn") is None


def test_chat(spark):
    rows = [(1, 1, "assistant", "b</turn>"), (1, 0, "user", None), (None, 0, None, "x"), (2, 0, "assistant", "é"), (2, 0, "assistant", "é"), (2, 0, "assistant", "a\\"), (3, None, "user", "")]
    rows += [(4, 0, "a", "x"), (4, 0, "a!", "y"), (5, 0, "u", "x!"), (5, 0, "u", "x"), (6, 0, "u", "\\z"), (6, 0, "u", "z")]
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nb</turn>\n") and got[1]["loss_sha256"] == sha("b</turn>")
    assert got[2]["n_turns"] == 3 and got[2]["loss_sha256"] == sha("a\\éé") and got[2]["loss_chars"] == 4
    assert got[None]["turns_sha256"] == sha("\nx\n") and got[3]["loss_chars"] == 0
    assert got[4]["turns_sha256"] == sha("a\nx\na!\ny\n") and got[5]["turns_sha256"] == sha("u\nx\nu\nx!\n") and got[6]["turns_sha256"] == sha("u\n\\z\nu\nz\n")
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("mine"))
    assert chat.format_chats(turns).columns == ["conv_id", "turn", "piece", "loss_start", "loss_end", "escaped"]
    assert chat.chat_digests(chat.format_chats(turns.limit(0))).count() == 0
    with pytest.raises(Exception, match="grammar"):
        chat.chat_digests(chat.format_chats(turns).withColumn("piece", F.lit("no turn"))).collect()


def plain_quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = brute.words(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + j for v in seen.values() if len(v) > 1 for i in v for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(brute.BLANKS)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(spark):
    rows = corpus() + [(7, "a\n\na\nb# c\n"), (7, "a\n\na\nb# c\n")]
    docs = frame(spark, rows).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit("mine"))
    got = quality.quality_rules(docs)
    assert got.columns == [*docs.columns, "quality"] and got.count() == len(rows)
    for r in got.collect():
        q = r["quality"]
        assert tuple(q[c] for c in (*quality.COUNTS, "base_failed")) == plain_quality(r["text"])
        assert q["kept"] <= (not q["base_failed"]) and r["n_words"] == r["kept"] == "mine"
    assert quality.quality_rules(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality.quality_rules(got)


def test_quality_host(spark):
    """Hosts are rejected by a rule of their own, shrunk towards all hosts; the symbols rule is no base rule."""
    good, bad = " ".join(f"g{i}" for i in range(60)), "short"
    signs = " ".join(f"#{i}" for i in range(60))
    rows = [(i, bad if i < 58 else good, "bad", 0, "", "") for i in range(60)] + [(100 + i, good, "good", 0, "", "") for i in range(60)] + [(200, good, "small", 0, "", ""), (201, bad, "small", 0, "", "")]
    rows += [(300 + i, signs if i < 59 else good, "signs", 0, "", "") for i in range(60)]
    kept = {r[0] for r in quality.quality_rules(spark.createDataFrame(rows, DOC)).where("quality.kept").select("doc_id").collect()}
    assert 58 not in kept and 100 in kept and 200 in kept and 201 not in kept and not kept & set(range(300, 360))
    assert 359 in {r[0] for r in quality.quality_rules(spark.createDataFrame(rows, DOC), host_limit=0.999).where("quality.kept").select("doc_id").collect()}


def test_decontamination(spark):
    item = " ".join(f"t{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, item.upper())], "item_id long, text string")
    rows = [(1, "before " + item + " after"), (2, " ".join(item.split()[:17])), (3, " ".join(item.split()[:12])), (4, None), (5, ""), (None, item), (1, "x " + item)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, rows), items).collect()}
    assert got == {(d, i) for d in (1, 2, None) for i in (1, 4)}
    assert {r["doc_id"] for r in decontaminate.decontaminate(frame(spark, rows), items).collect()} == {3, 4, 5}
    assert decontaminate.decontaminate(frame(spark, rows), items.limit(0)).count() == len(rows)
    assert decontaminate.decontaminate(frame(spark, rows).limit(0), items).count() == 0
    clash = frame(spark, rows).withColumn("leak", F.lit("mine")).withColumn("leak_", F.lit("mine")).withColumn("found_", F.lit(1))
    left = decontaminate.decontaminate(clash, items)
    assert left.columns == clash.columns and {r["doc_id"] for r in left.collect()} == {3, 4, 5}


def test_decontamination_parts(spark):
    """A window is compared only in the partitions of items whose bound it keeps to, and long texts are searched whole."""
    rng = random.Random(8)
    texts = [" ".join(f"i{i}x{j}" for j in range(n)) for i, n in enumerate((6, 9, 20, 40, 90))]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    long = " ".join(f"z{rng.randrange(10**6)}" for _ in range(30000))
    rows = [(i, f"{long} {t}") for i, t in enumerate(texts)] + [(50, long)]
    docs = frame(spark, rows)
    sign = decontaminate.signatures(items)
    bounds = {r["part"]: r["b"] for r in sign.groupBy("part").agg(F.max("h").alias("b")).collect()}
    got = decontaminate.sketches(docs.select("doc_id", "text", F.xxhash64("text").alias("tkey")), sign)
    assert len(bounds) >= 4 and all(r["top"] <= bounds[r["part"]] for r in got.groupBy("part").agg(F.max("h").alias("top")).collect())
    counts = {r["part"]: r["count"] for r in got.groupBy("part").count().collect()}
    assert len(set(counts.values())) > 1 and sorted(bounds, key=bounds.get) == sorted(counts, key=counts.get)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()} == {(i, i) for i in range(len(texts))}


def test_mixing(spark):
    rows = corpus()
    docs = frame(spark, rows)
    plan = mixing.mixing_plan(docs).collect()
    total = sum(r["size"] for r in plan)
    by = {}
    for r in plan:
        assert r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], [0, r["target"], r["source_size"], 0])
        s[0], s[3] = s[0] + r["taken"], s[3] + 1
    assert sum(t for _, t, _, _ in by.values()) == pytest.approx(1.5 * total)
    assert all(abs(a - t) <= n and t <= 2 * s + 1e-6 for a, t, s, n in by.values())
    assert sorted(map(tuple, plan), key=repr) == sorted(map(tuple, mixing.mixing_plan(docs.repartition(7)).collect()), key=repr)
    mixed = mixing.mix(docs).collect()
    assert sum(r["n_taken"] for r in mixed) == sum(r["taken"] for r in plan) == sum(len(brute.words(r["text"])) for r in mixed)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_repeats(spark):
    """Rows without a doc_id, and rows that repeat all they have, are rounded each on their own."""
    rows = [(None, "one")] * 150 + [(None, f"w{i}") for i in range(150)] + [(1, "same")] * 100 + [(i, "a b c") for i in range(2, 60)]
    docs = spark.createDataFrame([(d, t, "src" if i < 300 else "other", "x", "y") for i, (d, t) in enumerate(rows)], "doc_id long, text string, source string, mix_target_of_source string, mix_key string")
    plan = mixing.mixing_plan(docs).collect()
    for source in ("src", "other"):
        mine = [r for r in plan if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) < 0.1 * mine[0]["target"]
    assert sorted(map(tuple, plan), key=repr) == sorted(map(tuple, mixing.mixing_plan(docs.repartition(5)).collect()), key=repr)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "repetition", "n_taken"] and mixed.agg(F.sum("n_taken")).first()[0] == sum(r["taken"] for r in plan)


def test_urls(spark):
    day = lambda d: f"2024-01-{d:02d}"
    entries = spark.createDataFrame([("l", "bad.org", "block", "add", day(5)), ("l", "bad.org", "block", "remove", day(10)), ("l", "bad.org/ok", "allow", "add", day(1)), ("l", None, "block", "add", day(1)), ("l", "x.com", "block", "add", day(5)), ("l", "x.com", "block", "remove", day(5))], "list string, pattern string, verdict string, action string, at string").withColumn("at", F.to_date("at"))
    rows = [("http://a.bad.org/p", day(4), True), ("http://a.bad.org/p", day(5), False), ("https://www.bad.org/", day(9), False), ("http://bad.org/q?z", day(10), True), ("http://u:p@bad.org:80/ok/deep", day(6), True), ("http://notbad.org/", day(6), True), (None, day(6), True), ("nonsense", day(6), True), ("http://bad.org/", None, True), ("http://x.com/", day(7), True), ("http://BAD.org", day(6), False)]
    df = spark.createDataFrame([(u, f, k) for u, f, k in rows], "url string, f string, want boolean").withColumn("fetched_at", F.to_date("f")).withColumn("pattern_", F.lit(1))
    got = urls.filter_urls(df, entries).collect()
    assert len(got) == len(rows) and all(r["kept"] == r["want"] for r in got)
    clash = df.withColumn("best", F.lit("mine")).withColumn("verdict", F.lit("mine")).withColumn("kept", F.lit("mine"))
    out = urls.filter_urls(clash.union(clash), entries)
    assert out.columns == [*clash.columns, "pattern", "verdict_", "kept_"] and out.count() == 2 * len(rows)
    assert all(r["kept_"] == r["want"] and r["verdict"] == "mine" for r in out.collect())
    assert urls.filter_urls(df.limit(0), entries).count() == 0 and urls.filter_urls(df, entries.limit(0)).where("kept").count() == len(rows)


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for d in range(400):
        words = [rng.choice(VOCAB) for _ in range(80)]
        toxic = d % 5 == 0
        if toxic:
            for _ in range(5):
                words[rng.randrange(80)] = rng.choice(["vile", "nasty", "awful", "rotten"])
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    rows += [(900, None), (901, "")]
    truth = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, rows), truth).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert len(got) == len(rows) and len(held) > 50 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held]) > 0.95
    assert {r["predicted"] for r in toxicity.toxicity(frame(spark, rows[:3]), truth.limit(0)).collect()} == {0}


def test_gradient():
    rng = np.random.default_rng(0)
    ids, row = rng.integers(0, lmscore.IDS, 50).astype(np.int32), np.repeat([0, 1], 25)
    ctx = lmscore.contexts(ids, row)
    assert (ctx[0, :2] == lmscore.EDGE).all() and (ctx[24, 2:] == lmscore.EDGE).all() and ctx[24, 1] == ids[23]
    flat = lmscore.start().astype(np.float64)
    loss = lambda x: -lmscore.forward(lmscore.unpack(x), ctx, ids)[3].mean()
    g = lmscore.gradient(lmscore.unpack(flat.copy()), ctx, ids)
    for i in [*np.argsort(-np.abs(g))[:8], lmscore.SIZE - 1]:
        step = np.zeros_like(flat)
        step[i] = 1e-5
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-5 - g[i]) < 1e-4


def test_lm(spark):
    rng = random.Random(4)
    ordered = [" ".join(f"k{(i + j) % 12}" for j in range(60)) for i in range(200)]
    rows = list(enumerate(ordered)) + [(900, " ".join(rng.choice([f"k{i}" for i in range(12)]) for _ in range(60))), (901, None), (902, "")]
    got = {r["doc_id"]: r for r in lmscore.score(frame(spark, rows)).collect()}
    assert got[0]["mean_logp"] > got[900]["mean_logp"] and got[0]["n_words"] == 60
    assert got[901]["n_words"] == 0 and got[901]["log_likelihood"] == 0 and got[902]["mean_logp"] is None
    assert lmscore.score(frame(spark, rows).limit(0)).count() == 0


def test_substring_source_of_two_texts(spark):
    """Windows of one span lie in two texts under one doc_id."""
    p = [f"p{i}" for i in range(14)]
    rows = [(1, " ".join([*p[:13], "zz", "yy"])), (1, " ".join(["qq", *p[1:], "vv"])), (2, " ".join(["s1", "s2", *p, "s3"]))]
    got = {r["doc_id"]: r["n_removed"] for r in substring.substring_dedup(frame(spark, rows)).collect()}
    assert got[2] == 14


def test_jaccard_repeated_ids(spark):
    """A doc_id with two texts is one node; near duplicates are dropped text by text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (3, b), (3, c), (4, c + " end"), (3, b), (None, a), (5, None), (6, " "), (2, a)]
    docs = frame(spark, rows)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == {(1, 26, 1), (2, 27, 1), (2, 26, 1), (3, 26, 3), (4, 27, 3), (None, 26, None), (5, 0, 5), (6, 0, 6)}
    left = jaccard.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(1, a), (3, b), (3, c), (None, a), (5, None), (6, " ")], key=repr)


def test_jaccard_near_groups(spark):
    """A large group of copies of one text that differ in a few words, most pairs of which aren't similar."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for d in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 8)):
            words[rng.randrange(80)] = f"e{rng.randrange(30)}"
        rows.append((d, " ".join(words)))
    got = sorted(tuple(r) for r in jaccard.jaccard_classes(frame(spark, rows)).collect())
    assert got == brute.jaccard_classes(rows) and len({c for *_, c in got}) > 1
