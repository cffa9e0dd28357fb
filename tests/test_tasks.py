"""Routed and hybrid search, procedures, stages and table roll-backs on small cases."""

import math
import re
import zlib
from collections import Counter

import pytest

from lodestone import bindings as b
from lodestone.operators import facts, manuals, search, tasks as t
from lodestone.plans import registry
from lodestone.sources import files


def _words(text):
    return [w for w in re.findall(r"[^\W_]+", text.lower())]


def _best(scores, top):
    return {d: i + 1 for i, (d, _) in enumerate(sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))[:top])}


def test_hybrid_against_plain_loops(spark):
    docs = {1: "the pump drives the fan", 2: "a fan of the pump and a valve", 3: "valve seat grinding", 4: "unrelated words here", 5: "pump pump pump", 6: ""}
    asked = {10: "pump valve", 11: "fan", 12: "nothing known"}
    tokens = b.tokens(spark.createDataFrame(list(docs.items()), "doc_id int, text string"), ["doc_id"], "text")
    queries = b.tokens(spark.createDataFrame(list(asked.items()), "qid int, text string"), ["qid"], "text")
    top = 2
    bags = {d: Counter(_words(x)) for d, x in docs.items() if _words(x)}
    mean = sum(sum(c.values()) for c in bags.values()) / len(bags)

    def vector(text):
        counts = Counter(zlib.crc32(w.encode()) % 384 for w in _words(text) if len(w) >= 2)
        norm = math.sqrt(sum(n * n for n in counts.values()))
        return {k: n / norm for k, n in counts.items()}

    want = set()
    for q, text in asked.items():
        terms, mine = set(_words(text)), vector(text)
        df = {w: sum(w in c for c in bags.values()) for w in terms}
        word = {d: sum(math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in terms if c[w]) for d, c in bags.items()}
        sense = {d: round(sum(v * mine.get(k, 0) for k, v in vector(x).items()), 6) for d, x in docs.items() if set(vector(x)) & set(mine)}
        a, s = _best({d: round(v, 6) for d, v in word.items() if v}, top), _best(sense, top)
        fused = {d: round(sum(1 / (60 + r[d]) for r in (a, s) if d in r), 9) for d in {*a, *s}}
        want |= {(q, d, r, "+".join(n for n, side in (("a", a), ("b", s)) if d in side)) for d, r in _best(fused, top).items()}
    got = search.hybrid(tokens, queries, top).collect()
    assert {(r.qid, r.doc_id, r["rank"], r.signals) for r in got} == want and want


def test_routes(spark):
    docs = spark.createDataFrame([(1, "5305-01-234-5678"), (2, "5306-01-234-5678"), (3, None)], "doc_id int, nsn string")
    words = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a")], "doc_id int, pos int, term string")
    alias = spark.createDataFrame([("5305-01-234-5678", "5306-01-234-5678")], "nsn string, alias string")
    asked = spark.createDataFrame([(1, " 5678 "), (2, "5305 01 234 5678"), (3, "A b"), (4, None), (5, "")], "qid int, text string")
    got = {(r.qid, r.doc_id, r.route, r.mark, r["rank"]) for r in search.routed(asked, docs, alias, words).collect()}
    assert got == {(1, 1, "suffix", "exact", 1), (1, 2, "suffix", "exact", 2), (2, 1, "nsn", "exact", 1), (2, 2, "nsn", "alias", 2), (3, 1, "text", "exact", 1), (3, 2, "text", "approximate", 2)}


def test_procedure_lists_and_empty_pages(spark):
    text = "REPAIR\nTools required\nHammer\nok\nPERSONNEL: one\nMaterials list\nOil\nTOOLS away\nGrease\nSTEP\n1. Open the cap\nDANGER\n"
    rows = spark.createDataFrame([(1, 1, text), (2, 1, None), (3, 1, ""), (4, 1, "1. No\nCLEANING")], "doc_id int, page int, body_text string")
    one = t.procedures(rows).collect()
    assert [(r.doc_id, r.kind, r.tools, r.materials, r.steps, r.cautions) for r in one] == [(1, "Repair", ["Hammer"], ["Oil"], ["Open the cap"], ["DANGER: "])]


def test_stages(spark):
    pages = spark.createDataFrame([(1, 1, "Torque to 5 ft-lb. Use MS51957-2.")], "doc_id int, page int, body_text string")
    stages = {"measures": facts.measurements, "standards": t.standards, "own": lambda p: p.select("doc_id")}
    assert {r.stage for r in t.run_extractors(pages, stages).collect()} == {"measures", "standards", "own"}
    assert {r.stage for r in t.run_extractors(pages, stages, {"own"}).collect()} == {"own"}
    assert t.run_extractors(pages, stages, set()).count() == 0


def test_barcodes(spark):
    a, c = "5305-01-234-5678", "5306-01-234-5678"
    pages = spark.createDataFrame([(1, 1, f"fig. 3 {a} FIGURE 4 {a}"), (2, 1, "none")], "doc_id int, page int, body_text string")
    bars = spark.createDataFrame([(1, 1, a), (1, 1, c), (1, 1, c), (2, 1, c)], "doc_id int, page int, nsn string")
    got = {(r.doc_id, r.nsn, r.fig_no, r.origin, r.conflict) for r in t.parts_index(pages, bars).collect()}
    assert got == {(1, a, "3", "text", False), (1, a, None, "barcode", False), (1, c, None, "barcode", True), (2, c, None, "barcode", False)}


def test_rollback_and_publish(spark, tmp_path):
    spark.range(3).write.mode("overwrite").saveAsTable("derived_rows")
    assert [tuple(r) for r in files.rollback(spark, ["derived_rows", "absent_rows"]).collect()] == [("derived_rows", 3, False), ("absent_rows", None, False)]
    assert spark.catalog.tableExists("derived_rows")
    assert [r.dropped for r in files.rollback(spark, ["derived_rows"], True).collect()] == [True] and not spark.catalog.tableExists("derived_rows")
    path = str(tmp_path / "published")
    for n in (2, 5):
        files.publish(spark.range(n), path)
        assert files.read_published(spark, path).count() == n


def test_readers_see_a_whole_table_at_every_step(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        files.read_published(spark, path)
    files.publish(spark.range(3), path)
    begun = files.read_published(spark, path)
    # a job that fails while it writes, and one that has written and not published yet
    with pytest.raises(Exception):
        files.publish(spark.range(4).selectExpr("assert_true(id < 2)", "id"), path)
    spark.range(9).write.parquet(f"{path}/v00000002-unpublished")
    assert files.read_published(spark, path).count() == 3
    files.publish(spark.range(5), path)
    assert files.read_published(spark, path).count() == 5 and begun.count() == 3
    files.publish(spark.range(6), path)
    files.publish(spark.range(7), path)
    assert files.read_published(spark, path).count() == 7 and len(list((tmp_path / "table").glob("v*"))) == 2


def test_rebuild_touches_changed_documents_only(spark, tmp_path):
    path, built = str(tmp_path / "facts"), []

    def build(docs):
        built.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
        return docs.selectExpr("doc_id", "explode(sequence(1, n_pages)) AS page", f"{len(built)} AS run")

    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, n_pages int")
    assert files.rebuild(docs((1, 2), (2, 1), (3, 1)), build, path, 4).count() == 3
    got = files.rebuild(docs((1, 2), (2, 3), (4, 1)), build, path, 4)
    assert sorted(map(tuple, got.collect())) == [(2, 3), (4, 1)] and built[1] == [2, 4]
    rows = sorted(map(tuple, files.read_published(spark, f"{path}/rows").collect()))
    assert rows == [(1, 1, 1), (1, 2, 1), (2, 1, 2), (2, 2, 2), (2, 3, 2), (4, 1, 2)]
    assert files.rebuild(docs((1, 2), (2, 3), (4, 1)), build, path, 4).count() == 0


def test_foreign_extractors(spark):
    pages = spark.createDataFrame([(1, "a bb"), (2, None), (3, ""), (4, "ccc")], "doc_id long, body_text string")
    out = t.foreign(pages, lambda text: ((w, len(w)) for w in text.split()), "word string, n int")
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1), (1, "bb", 2), (4, "ccc", 3)]
    lines = spark.createDataFrame([(1, "Weight: 12 stone\nColor: red")], "doc_id long, body_text string")
    own = lambda p: t.foreign(p, lambda x: [("weight", 14.0 * int(x.split()[0]), "lb")] if "stone" in x else [], "type string, value double, unit string")
    assert sorted(map(tuple, manuals.label_values(lines, measure=own).collect())) == [(1, "Color", "red", None, None, None), (1, "Weight", "12 stone", "weight", 168.0, "lb")]


def test_new_queries_are_registered():
    assert {"h2_routed", "h15_hybrid", "f4_top_near", "d47_task_summary"} <= set(registry.QUERIES)
