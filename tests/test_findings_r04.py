"""What the fourth review found: whole answers, and memory and disk that are bounded."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from lodestone.operators import blocks, drawings, manuals as m, partsjoin as pj
from lodestone.plans import manual_queries, registry


def test_memberships_of_every_page(spark, sf):
    # words that no page of a hundredth document has are parts, too
    tokens, collections, documents = manual_queries.saved(spark, sf)
    held = m.saved_query_hits(tokens, collections, documents).select("doc_id", "page_number").distinct()
    words = tokens.join(held, ["doc_id", "page_number"], "left_semi")
    want = {r[0] for r in words.select("term").distinct().collect()}
    assert want > {r[0] for r in words.where("doc_id % 100 = 0").select("term").distinct().collect()}
    assert {r["part"] for r in registry.QUERIES["h18_memberships_of"](spark, sf).collect()} == want


def drawn():
    """Pages of a few wires to some hundreds, on a grid that ends nearly keep to, slanted, doubled, in a crowd, and without a page."""
    rng = random.Random(4)
    at = lambda: rng.randrange(12) / 12 + rng.choice((0, 0, 0.0049, -0.0049, 0.009))
    rows = []
    for page in range(60):
        for _ in range(rng.choice((1, 3, 7, 7, 200))):
            x, y, u, v = at(), at(), at(), at()
            rows.append((f"p{page}", x, y, *rng.choice(((u, v), (x, v), (u, y)))))
    rows += [("crowd", rng.random() / 50, rng.random() / 50, rng.random() / 50, rng.random() / 50) for _ in range(300)]
    return [*rows, rows[0], rows[0], (None, 0.1, 0.1, 0.5, 0.5), ("p3", None, 0.1, 0.5, 0.5), ("dot", 0.1, 0.1, 0.1, 0.1), ("one", 0.1, 0.1, 0.105, 0.1)]


def test_netlists_by_page_are_those_by_cell(spark, monkeypatch):
    # a page's wires come together; what needs the rounds of a graph job is a page that is too large for a task
    df = spark.createDataFrame(drawn(), "page string, x1 double, y1 double, x2 double, y2 double")
    rows = lambda found: [sorted(map(tuple, x.collect())) for x in (found[0].drop("net"), found[1])]
    jobs = []
    monkeypatch.setattr(drawings, "connected_components", lambda *a, f=drawings.connected_components: jobs.append(1) or f(*a))
    monkeypatch.setattr(drawings, "ROWS", 150)
    got = drawings.netlist(df)
    whole = rows(got)
    assert not jobs and {r[0] for r in whole[1]} == {p for p, *c in drawn() if p and None not in c and abs(c[0] - c[2]) + abs(c[1] - c[3]) > drawings.SPECK}
    assert len({r["net"] for r in got[0].collect()}) == len(whole[0])
    monkeypatch.setattr(drawings, "LARGE", 100)
    assert rows(drawings.netlist(df)) == whole
    assert len(jobs) == 2


def test_a_group_of_rows_and_a_block_of_queries_is_bounded(monkeypatch):
    # 2,000 rows that share all of their 50 terms with each of 1,000 queries would be 100 million products
    terms = [f"t{i}" for i in range(50)]
    rows = pa.table({"k": pa.array(range(2000), pa.int64()), "len": pa.array([50] * 2000), "terms": [terms] * 2000, "tf": [[1 + k % 7] * 50 for k in range(2000)]})
    asked = pa.table({"term": terms, "asked": [[{"qid": q} for q in range(1000)]] * 50, "idf": [0.1 * i + 0.1 for i in range(50)], "avg": [50.0] * 50})
    tracemalloc.start()
    whole = blocks._first(3, ["k"], None, False)(rows, asked)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400e6
    weight = sum(0.1 * i + 0.1 for i in range(50)) * 7 * 2.2 / (7 + 1.2)
    assert whole.num_rows == 3000 and sorted(set(whole["k"].to_pylist())) == [6, 13, 20] and np.allclose(whole["score"].to_numpy(), weight, atol=1e-6)
    # a row's products may be cut anywhere
    few = rows.slice(0, 40)
    whole = blocks._first(3, ["k"], None, False)(few, asked)
    monkeypatch.setattr(blocks, "CELLS", 1700)
    assert blocks._first(3, ["k"], None, False)(few, asked).equals(whole)


def test_see_also_of_a_crowd(spark):
    # numbers of few names, some of several, with neighbours on the figure that come first; then 4,000 of one name that would be 16 million pairs
    rng = random.Random(7)
    rows = [(f"n{rng.randrange(40):02}", rng.choice(("Bolt", "bolt", "Nut", "Pin")), rng.randrange(30), rng.randrange(2)) for _ in range(150)] + [(None, "bolt", 1, 1), ("n01", None, 1, 1), ("lone", "lone", 99, 0)]
    asked = [f"n{i:02}" for i in range(0, 40, 3)] + ["lone", "none"]
    want = set()
    for of in asked:
        mine = {(d, f) for n, _, d, f in rows if n == of}
        titles = {t.lower() for n, t, _, _ in rows if n == of and t}
        want |= {(of, n) for n in sorted({n for n, t, _, _ in rows if n and t and t.lower() in titles} - {of} - {n for n, _, d, f in rows if (d, f) in mine})[:5]}
    parts = lambda rows: spark.createDataFrame(rows, "nsn string, name string, document_id int, fig_no int")
    queries = spark.createDataFrame([(x,) for x in [*asked, "n00"]], "nsn string")
    assert sorted(map(tuple, pj.see_also(parts(rows), queries, 5).collect())) == sorted(want) and want
    crowd = parts([(f"n{i:04}", "bolt", i, 0) for i in range(4000)])
    got = pj.see_also(crowd, crowd.select("nsn"), 5)
    spark.sparkContext.setJobGroup("crowd", "")
    assert got.count() == 20_000
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    store = spark.sparkContext.statusTracker()
    stages = {s for j in store.getJobIdsForGroup("crowd") for s in store.getJobInfo(j).stageIds}
    jvm = spark.sparkContext._gateway
    held = spark._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
    assert sum(held.apply(i).shuffleWriteRecords() for i in range(held.size()) if held.apply(i).stageId() in stages) < 500_000


def test_few_queries_go_to_the_rows(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(("the", "a", *(f"w{i}" for i in range(30)))) for _ in range(rng.randint(0, 40)))
    docs = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, t) for q in range(9) for t in {"the", "nowhere", *text().split()}], "qid long, term string")
    best = sorted(map(tuple, blocks.bm25(docs, asked, 5, ["doc_id"], "text").collect()))
    monkeypatch.setattr(blocks, "HELD", 2000)
    got = blocks.bm25(docs, asked, 5, ["doc_id"], "text", few=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Exchange") == 1
    assert sorted(map(tuple, got.collect())) == best and len(best) == 45
    # no longer few
    monkeypatch.setattr(blocks, "SMALL", 3)
    got = blocks.bm25(docs, asked, 5, ["doc_id"], "text", few=True)
    assert "CoGroups" in got._jdf.queryExecution().toString() and sorted(map(tuple, got.collect())) == best


def test_names_are_written_where_the_parts_lie(spark, monkeypatch):
    # 50 parts on the page of a term that 2,000 collections ask: their names go to the groups of parts, not to each part
    schema = "slug string, term string, scope_vehicle string, scope_type string"
    collections = spark.createDataFrame([(f"c{i}", "a", "M", "-10") for i in range(2000)] + [("c7", "b", "m", "-10")], schema)
    documents = spark.createDataFrame([(1, "m", "TM-10")], "doc_id int, vehicle string, tm string")
    tokens = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc_id int, page_number int, term string")
    mentions = spark.createDataFrame([(f"p{i}", 1, page) for i in range(50) for page in (1, 2)] + [("q", 1, 2), (None, 1, 1)], "part string, doc_id int, page_number int")
    found = m.memberships_of(tokens, collections, documents, mentions)
    assert found.columns == ["part", "slugs", "n_pages"] and "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    every = ",".join(sorted(f"c{i}" for i in range(2000)))
    assert {r["part"]: (r["slugs"], r["n_pages"]) for r in found.collect()} == {**{f"p{i}": (every, 2) for i in range(50)}, "q": ("c7", 1)}
    # groups that follow each other and end within a batch, names cut into small lists
    monkeypatch.setattr(m, "NAMES", 2)
    rows = [(0, 0, 1, ["b", "a"], None, None, None), (0, 0, 2, ["c", "a"], None, None, None), (0, 1, None, None, "x", [1], 1), (0, 1, None, None, "y", [2, 1], 3), (1, 0, 1, ["d"], None, None, None), (1, 1, None, None, "z", [1], 2)]
    kinds = pa.schema([("group_", pa.int32()), ("kind_", pa.int32()), ("id", pa.int64()), ("slugs", pa.list_(pa.string())), ("part", pa.string()), ("ids", pa.list_(pa.int64())), ("n_pages", pa.int64())])
    table = pa.table(list(map(list, zip(*rows, strict=True))), schema=kinds)
    for size in (1, 3, 6):
        got = pa.Table.from_batches(m._named(table.to_batches(max_chunksize=size))).to_pylist()
        assert [tuple(r.values()) for r in got] == [("x", "a,b", 1), ("y", "a,b,c", 3), ("z", "d", 2)]
