"""What reads much text reads it once."""

from pyspark.sql import functions as F

from lodestone.operators import facts


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Range (")


def some(spark):
    return spark.range(400).selectExpr("id AS document_id", "cast(id % 7 as string) AS niin", "'torque' AS type", "'ft-lb' AS unit", "cast(id % 5 + 1 as double) AS value", "id % 3 AS source_id")


def test_facts_are_read_once(spark):
    found, log = facts.conflict_sweep(some(spark), 3)
    assert [scans(d) for d in (facts.conflicts(some(spark)), found, log, facts.agreement(some(spark)))] == [1, 1, 1, 1]
    assert log.collect()[0].asDict() == {"checked": 3, "subjects": 3, "conflicts": 3, "high": 3} and found.count() == 3
    assert {tuple(r) for r in facts.agreement(some(spark)).select("methods", "consensus", "verdict").collect()} == {(3, 3.0, "conflict")}
    none = facts.conflict_sweep(some(spark).where("id IS NULL" if "id" in some(spark).columns else "niin IS NULL"), 3)[1]
    assert none.collect()[0].asDict() == {"checked": 0, "subjects": 0, "conflicts": 0, "high": 0}


def test_measurements_with_one_and_with_several_on_a_page(spark):
    pages = spark.createDataFrame([(1, "Set 1,200 to 1,300 psi."), (2, "Use 5 V, then 5 V, then 1 to 2 +/- 3 mm."), (3, "none"), (4, "5 V 5 V")], "document_id int, body_text string")
    got = facts.measurements(pages).orderBy("document_id", "place").select("document_id", "value", "value2", "tolerance", "unit").collect()
    assert [tuple(r) for r in got] == [(1, 1200.0, 1300.0, None, "psi"), (2, 5.0, None, None, "V"), (2, 1.0, 2.0, 3.0, "mm"), (4, 5.0, None, None, "V")]
    whole = facts.measurements(pages, context=True).where("document_id = 1").select("raw", "context").first()
    assert tuple(whole) == ("1,200 to 1,300 psi", "Set 1,200 to 1,300 psi.")


def test_long_numbers_are_garbled(spark):
    rows = spark.createDataFrame([(9_999_999.0, "length"), (10_000_000.0, "length"), (3.0, "other")], "value double, type string")
    assert [r["reason"] for r in facts.gated(rows).select("value", F.col("reason")).orderBy("value").collect()][2] == "garbled"


def test_nodes_and_neighbours_of_edges_stated_often(spark):
    from lodestone.operators import graph

    rows = [("part|5300-00-100", "used on", "vehicle|chad"), ("part|5300-00-200", "used on", "vehicle|chad"), ("part|x", "used on", "vehicle|chadian"), ("part|x", "in", "part|x")]
    edges = spark.createDataFrame(rows * 3, "src string, rel string, dst string")
    nodes = edges.selectExpr("explode(array(src, dst)) AS node").selectExpr("node", "split_part(node, '|', 2) AS label")
    asked = spark.createDataFrame([("Chad",), ("cha",), ("had",), ("00-1",), ("x",), ("00",), ("nobody",), ("",), (None,)], "q string")
    got = {tuple(r) for r in graph.find_nodes(nodes, asked, 2).collect()}
    assert got == {("chad", "vehicle|chad", "exact"), ("cha", "vehicle|chad", "prefix"), ("cha", "vehicle|chadian", "prefix"), ("had", "vehicle|chad", "substring"), ("had", "vehicle|chadian", "substring"), ("00-1", "part|5300-00-100", "substring"), ("x", "part|x", "exact"), ("00", "part|5300-00-100", "substring"), ("00", "part|5300-00-200", "substring")}
    assert graph.find_nodes(nodes, asked.limit(0)).collect() == []
    met = graph.neighbours(edges, nodes.where("label = 'x'"))
    assert sorted(map(tuple, met.collect())) == [("part|x", "in", "part|x", "in"), ("part|x", "in", "part|x", "out"), ("part|x", "used on", "vehicle|chadian", "out")]
    assert met._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_stay_in_their_page(spark):
    from lodestone.operators import extract as x

    rows = [(1, 1, "intro\n 1. Remove it, fig. 7. \n(a) lift\n2. Next\nWARNING: hot\n1. Again 5305-00-123-4567\nb. turn"), (2, 1, None), (3, 1, "no step")]
    got = x.steps(spark.createDataFrame(rows, "doc_id int, page int, body_text string"))
    assert {(r["doc_id"], r["step"]): tuple(r)[3:] for r in got.collect()} == {
        (1, 1): ("1. Remove it, fig. 7. (a) lift 1. Again 5305-00-123-4567 b. turn", 2, 0, ["5305-00-123-4567"], ["7"]), (1, 2): ("2. Next WARNING: hot", 0, 1, [], [])}
    assert not any(w in plan(got) for w in ("Exchange", "Sort", "Window"))


def test_procedures_stay_in_their_page(spark):
    from lodestone.operators import tasks as t

    text = "x\nREMOVAL\nSpecial tools\nWrench\n" + "\n".join(f"tool {i}" for i in range(30)) + "\n\nMaterials/Parts\nGrease\nNOTE\nSee TM 9-1 and TM 9-2320-10\n" + "\n".join(f"{i}. Loosen bolt {i}" for i in range(50))
    got = t.procedures(spark.createDataFrame([(1, 1, text), (2, 1, None), (3, 1, "nothing")], "doc_id int, page int, body_text string"))
    one = got.collect()
    assert len(one) == 1 and (one[0]["kind"], one[0]["title"], len(one[0]["steps"]), len(one[0]["tools"])) == ("Removal", "REMOVAL", 40, 25)
    assert (one[0]["tools"][:2], one[0]["materials"], one[0]["references"], one[0]["cautions"]) == (["Wrench", "tool 0"], ["Grease"], ["TM 9-1", "TM 9-2320-10"], ["NOTE: See TM 9-1 and TM 9-2320-10"])
    assert not any(w in plan(got) for w in ("Exchange", "Sort", "Window"))


def test_partitions_follow_the_pairs(spark, monkeypatch):
    from lodestone.operators import partsjoin as pj

    monkeypatch.setattr(pj, "_PAIRS", 1)
    pairs = spark.createDataFrame([("1", "2"), ("1", "3"), ("2", "3"), ("1", "9")], "a string, b string")
    traits = spark.createDataFrame([(i, q, r) for i, rs in (("1", "xyz"), ("2", "xyw"), ("3", "xyz")) for q, r in zip("abc", rs)] + [("1", "d", None), ("2", "d", "v")], "niin string, requirement string, reply string")
    one = lambda *r: spark.createDataFrame(r, "a string, b string")
    got = pj.interchange(pairs, one(("2", "1"), ("2", "1")), one(("3", "2"), ("1", "2")), traits)
    assert {tuple(r) for r in got.collect()} == {("1", "2", 67.0, "green"), ("1", "3", 100.0, "amber"), ("2", "3", 67.0, "amber"), ("1", "9", 0.0, "red")}
    assert "REPARTITION_BY_NUM" in plan(got)
