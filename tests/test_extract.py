"""Line extraction and file sources on small hand-written inputs."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from lodestone.operators import extract as x
from lodestone.sources import files


def pages(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, page int, body_text string")


def test_glossary(spark):
    g = x.glossary(pages(spark, "ABBREVIATIONS\nPMCS - preventive maintenance checks\nTM: technical manual", "PMCS - other", None))
    assert {(r["abbreviation"], r["meaning"], r["n"]) for r in x.global_glossary(g).collect()} == {("PMCS", "preventive maintenance checks", 2), ("TM", "technical manual", 1)}
    q = spark.createDataFrame([(1, "PMCS chart"), (2, "plain")], "qid long, text string")
    assert [r["text"] for r in x.expand(q, x.global_glossary(g)).orderBy("qid").collect()] == ["PMCS chart preventive maintenance checks", "plain"]


def test_pinouts(spark):
    got = x.pinouts(pages(spark, "CONNECTOR J12\nPIN A battery plus RED/WHT\nPIN B ground BLK\nCONNECTOR P3\nPIN 1 signal GRN")).collect()
    assert [(r["connector"], r["pin"], r["colour"]) for r in got] == [("J12", "A", "red with white"), ("J12", "B", "black"), ("P3", "1", "green")]


def test_chart(spark):
    got = x.allocation_chart(pages(spark, "01  Engine assembly  Replace F 4.5\n0101 Repair O 1.0\njunk")).collect()
    assert [(r["group_no"], r["component"], r["action"], r["level"], r["hours"]) for r in got] == [("01", "Engine assembly", "Replace", "field", 4.5), ("0101", "Engine assembly", "Repair", "unit", 1.0)]


def test_parts_lines(spark):
    got = x.parts_lines(pages(spark, "FIGURE 7\n 1 PAOZZ 5305-00-123-4567 96906 MS90728-6 SCREW, CAP 12\n 2 text only")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["fig_no"], r["item"], r["smr"], r["nsn"], r["cagec"], r["part_no"], r["qty"], r["confidence"]) == ("7", 1, "PAOZZ", "5305-00-123-4567", "96906", "MS90728-6", 12, 1.0)


def test_limits_and_specs(spark):
    p = pages(spark, "Minimum pressure is 12 psi. The maximum gap: 0.5 in. Use MS90728 or 1/4-20 bolts.")
    assert {(r["bound"], r["value"], r["unit"]) for r in x.limits(p).collect()} == {("min", 12.0, "psi"), ("max", 0.5, "in")}
    assert {(r["kind"], r["value"], r["family"]) for r in x.spec_tokens(p).collect()} == {("standard", "MS90728", "military standard"), ("thread", "1/4-20", None)}


def test_codes(spark):
    df = spark.createDataFrame([("PAOZZ",), ("QQQQQ",), (None,)], "c string").select(x.decode_smr(F.col("c")).alias("d"))
    assert [r["d"] and r["d"]["recover"] for r in df.collect()] == ["discard", None, None]
    df = spark.createDataFrame([("STEEL, LENGTH: 2 IN; LENGTH: 3 IN; WIDTH: 25.4 MM",), ("",)], "c string").select(x.material(F.col("c")), x.roles(F.col("c")))
    assert [tuple(r) for r in df.collect()] == [("steel", {"length": 2.0, "width": 1.0}), (None, {})]
    df = spark.createDataFrame([("TM 9-2320-280-10",), ("TM 9-2320-280-20P",), ("operator and maintenance",), ("guide",)], "c string").select(x.side(F.col("c")))
    assert [r[0] for r in df.collect()] == ["operator", "mechanic", "both", "mechanic"]


def test_steps_and_faults(spark):
    s = x.steps(pages(spark, "intro\n1. Remove bolt 5305-00-123-4567, figure 3.\n(a) lift\nWARNING: hot\n2. Install.")).orderBy("step").collect()
    assert [(r["step"], r["n_sub"], r["n_alerts"], r["nsns"], r["figures"]) for r in s] == [(1, 1, 1, ["5305-00-123-4567"], ["3"]), (2, 0, 0, [], [])]
    t = x.fault_tree(pages(spark, "MALFUNCTION: Engine stalls\nSTEP 1. Check fuel\nRefill tank\nSTEP 2. Check filter\nReplace\nSYMPTOM: Noise\nTEST 1: Listen")).orderBy("symptom").collect()
    assert [(r["symptom"], [(n["test"], n["actions"]) for n in r["tests"]]) for r in t] == [("Engine stalls", [("Check fuel", ["Refill tank"]), ("Check filter", ["Replace"])]), ("Noise", [("Listen", [])])]


def test_prefix(spark):
    q, c = spark.createDataFrame([(1, "001234567")], "qid long, niin string"), spark.createDataFrame([("001234599",), ("001234000",), ("001234567",)], "niin string")
    assert [(r["shared"], r["found"]) for r in x.nsn_prefix(q, c).collect()] == [(7, "001234599")]


def test_files(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.makedirs(f"{root}/corpus/M998")
    for name, body in (("a.txt", "plain text"), ("b.html", "<p>x &amp; y</p>")):
        with open(f"{root}/corpus/M998/{name}", "w") as f:
            f.write(body)
    now = files.listing(spark, f"{root}/corpus")
    assert {r["vehicle"] for r in now.collect()} == {"M998"}
    assert {r["state"] for r in files.changed(now, now.where("path LIKE '%a.txt'").withColumn("size", F.lit(1).cast("long"))).collect()} == {"new", "updated"}
    assert files.fingerprints(spark, f"{root}/corpus").where("fingerprint LIKE '10:%'").count() == 1
    assert {r["body_text"] for r in files.texts(spark, f"{root}/corpus").collect()} == {"plain text", "x & y"}

    with open(f"{root}/r.csv", "w") as f:
        f.write("NSN ,Item Name,Other\n1, bolt ,x\n2,,y\n")
    assert [tuple(r) for r in files.flexible_csv(spark, f"{root}/r.csv", {"nsn": ["nsn"], "name": ["name", "item name", "other"], "gone": ["zzz"]}).collect()] == [("1", "bolt", None), ("2", "y", None)]
    assert [tuple(r) for r in files.positional_csv(spark, f"{root}/r.csv", {"niin": 0, "name": 2}, niin="niin").collect()] == [("000000001", "x"), ("000000002", "y")]
    with open(f"{root}/codes.txt", "w") as f:
        f.write("AAAB BOLT, MACHINE  more\nAAAB second\n1234 no\nX\n")
    assert [tuple(r) for r in files.code_dictionary(spark, f"{root}/codes.txt").collect()] == [("AAAB", "BOLT, MACHINE")]
    with open(f"{root}/log.jsonl", "w") as f:
        f.write(json.dumps({"t": 1.0, "k": "view", "q": "a", "doc": 1}) + "\nbroken\n")
    assert files.event_log(spark, f"{root}/log.jsonl").count() == 1
    with open(f"{root}/alias.json", "w") as f:
        json.dump({"groups": [["Bolt", "screw"], ["bolt", "fastener"]]}, f)
    assert {r["term"]: r["others"] for r in files.alias_map(spark, f"{root}/alias.json").collect()}["bolt"] == ["fastener", "screw"]
    with open(f"{root}/m.xml", "w") as f:
        f.write("<r><dmodule><title>T</title><dmCode>C1</dmCode><warning>hot</warning><step>one</step><step>two</step></dmodule></r>")
    assert [(r["title"], r["code"], r["warnings"], r["steps"], r["notes"]) for r in files.xml_modules(spark, f"{root}/m.xml").collect()] == [("T", "C1", ["hot"], ["one", "two"], [])]


def test_sinks(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "doc_id long, name string, n_pages int")
    files.publish(df, f"{root}/t")
    files.publish(df.where("doc_id = 1"), f"{root}/t")
    assert files.read_published(spark, f"{root}/t").count() == 1
    assert [r["doc_id"] for r in files.to_build(df, df.where("doc_id = 1")).collect()] == [2]
    files.write_buckets(df, f"{root}/b")
    files.write_buckets(df.where("doc_id = 2"), f"{root}/b")
    assert spark.read.parquet(f"{root}/b").count() == 2
    files.write_markdown(df, f"{root}/md")
    assert [r[0] for r in spark.read.text(f"{root}/md").collect()] == ["| 1 | a | 2 |", "| 2 | b | 3 |"]
    files.write_tsv(df, f"{root}/tsv")
    assert spark.read.csv(f"{root}/tsv", sep="\t", header=True).count() == 2
