"""What a review found: odd rows, and keys as wide as larger tables have them."""

import datetime
import os
import random

import pytest

from lodestone.operators import extract as x, graph, manuals as m, partsjoin as pj
from lodestone.plans import registry
from lodestone.sources import scratch

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate date"


def line(order, part, supplier, number, quantity, flag="N"):
    return (order, part, supplier, number, quantity, flag, datetime.date(2024, 1, 1))


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables given as name=(rows, schema), and returns their folder."""

    def write(**given):
        for name, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def run(spark, name, sf):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, sf).collect())


def test_standards_of_seven_digits(spark, tables):
    p = spark.createDataFrame([(1, 1, "Use MS1290000 and NAS1234567-12 with M5 bolts")], "doc_id long, page int, body_text string")
    assert {(r["kind"], r["value"]) for r in x.spec_tokens(p).collect()} == {("standard", "MS1290000"), ("standard", "NAS1234567-12"), ("thread", "M5")}
    sf = tables(lineitem=([line(1, 910_000, 2, 1, 5.0)], LINE))
    assert [r["value"] for r in registry.QUERIES["i23_spec_tokens"](spark, sf).orderBy("value").collect()] == ["M5", "MS1000000"]


def test_items_of_the_designations_only(spark, tables):
    # supplier 25338 makes MS35338, which the library's own table knows
    sf = tables(lineitem=([line(1, 0, 25_338, 1, 5.0)], LINE))
    got = registry.QUERIES["i24_standards"](spark, sf).orderBy("token").collect()
    assert [(r["token"], r["series"], r["item"]) for r in got] == [("MS35338-3", "MS35338", None), ("MS51957-63", "MS51957", "screw, machine, pan head")]


def test_sentences_are_no_explanations(spark, tables):
    docs = [(5, "SS. Auf der Seite stehen SS und SS\nT5 - another meaning of it", "de", "web", 20)]
    sf = tables(documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    assert run(spark, "i39_abbreviations_used", sf) == [(5, "T5", "meaning of web de", 3, 1)]


def test_equal_facts_of_a_page_count_each(spark, tables):
    rows = [line(1, 7, 3, 4, 10.0), line(1, 7, 3, 4, 10.0), line(2, 7, 3, 4, 20.0)]
    sf = tables(lineitem=(rows, LINE), part=([(7, "blue ring")], "p_partkey long, p_name string"))
    got = registry.QUERIES["c33_cited_dimensions"](spark, sf).collect()
    assert [(r["niin"], r["type"], r["value"], r["document_id"], r["cited"]) for r in got] == [("000000007", "torque", 10.0, 1, True)]


def cpu_seconds(spark):
    """Seconds of computing that the session's tasks have taken so far."""
    gateway = spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).executorCpuTime() for i in range(stages.size())) / 1e9


def test_nearest_against_all_pairs(spark):
    rng = random.Random(3)
    # a crowd in one corner, a thin rest, ends of one place, points of one number, nothing within reach
    at = lambda: (rng.randrange(40) / 2, rng.randrange(40) / 2) if rng.random() < 0.6 else (rng.randrange(-500, 500), rng.randrange(-500, 500))
    lines = [(rng.randrange(2), i, *map(float, at())) for i in range(900)] + [(0, 5000, 20.0, 20.0), (0, 4999, 20.0, 20.0)]
    points = [(rng.randrange(3), i % 400, *map(float, at())) for i in range(500)] + [(0, 777, 20.0, 21.0), (1, 778, 9000.0, 0.0)]
    want = {}
    for page, point, px, py in points:
        for other, line_id, lx, ly in lines:
            d2 = (px - lx) ** 2 + (py - ly) ** 2
            if page == other and d2 < 3600:
                want[page, point] = min(want.get((page, point), (d2, line_id)), (d2, line_id))
    got = pj.nearest(spark.createDataFrame(points, "page int, point_id int, x double, y double"), spark.createDataFrame(lines, "page int, line_id int, lx double, ly double"))
    assert {(r["page"], r["point_id"]): (r["line_id"], r["distance"]) for r in got.collect()} == {k: (i, round(d2**0.5, 6)) for k, (d2, i) in want.items()}


def test_nearest_of_a_crowd(spark):
    # 40,000 points and lines of one small cell would be 1.6 billion pairs
    grid = spark.range(40_000).selectExpr("0 AS page", "id AS point_id", "cast(id % 200 AS double) / 4 AS x", "floor(id / 200) / 4D AS y")
    before = cpu_seconds(spark)
    got = pj.nearest(grid, grid.selectExpr("page", "point_id AS line_id", "x AS lx", "y AS ly"))
    assert got.where("point_id = line_id AND distance = 0").count() == 40_000
    assert cpu_seconds(spark) - before < 60


@pytest.fixture
def collections(spark):
    """Words of pages, collections of which many ask the same (one of them with two terms), documents, and all hits by plain loops."""
    rng = random.Random(5)
    tokens = [(rng.randrange(20), rng.randrange(3), rng.choice("abcdef")) for _ in range(300)]
    asked = [(f"c{i}", rng.choice("abc"), rng.choice(("M1", "m1", "M2", "M3")), rng.choice(("-10", "-2"))) for i in range(60)] + [("c0", "f", "M1", "-2")]
    documents = [(i, f"m{i % 3}", f"TM 9{('-10', '-20p', '-24')[i % 4 % 3]}") for i in range(20)]
    hits = [(slug, i, page) for slug, term, v, scope in asked for i, page, t in sorted(set(tokens)) for j, vehicle, tm in documents if i == j and t == term and v.lower() == vehicle and scope in tm.upper()]
    frames = spark.createDataFrame(tokens, "doc_id int, page_number int, term string"), spark.createDataFrame(asked, "slug string, term string, scope_vehicle string, scope_type string"), spark.createDataFrame(documents, "doc_id int, vehicle string, tm string")
    return frames, hits


def test_counts_of_saved_queries(collections):
    frames, hits = collections
    want = {slug: (sum(h[0] == slug for h in hits), min(h[1] for h in hits if h[0] == slug)) for slug, _, _ in hits}
    assert {r["slug"]: (r["n_pages"], r["first_doc"]) for r in m.saved_query_counts(*frames).collect()} == want
    assert sorted(tuple(r) for r in m.saved_query_hits(*frames).collect()) == sorted(hits)


def test_memberships_of_parts(spark, collections):
    frames, hits = collections
    rng = random.Random(6)
    mentions = sorted({(f"p{rng.randrange(9)}", rng.randrange(20), rng.randrange(3)) for _ in range(60)})
    want = {}
    for part, i, page in mentions:
        for slug in (h[0] for h in hits if h[1:] == (i, page)):
            slugs, places = want.setdefault(part, (set(), set()))
            slugs.add(slug), places.add((i, page))
    got = m.memberships_of(*frames, spark.createDataFrame(mentions, "part string, doc_id int, page_number int"))
    assert {r["part"]: (r["slugs"], r["n_pages"]) for r in got.collect()} == {k: (",".join(sorted(a)), len(c)) for k, (a, c) in want.items()}


def test_rounds_of_components_replace_each_other(spark):
    scratch.frugal(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    held = set(os.listdir(folder))
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert {tuple(r) for r in graph.connected_components(edges).collect()} == {(i, 0) for i in range(31)}
    assert sorted(n.partition("-")[0] for n in set(os.listdir(folder)) - held) == ["pairs", "stars"]
