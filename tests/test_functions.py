"""Column functions on hand-written rows: nulls, blanks, malformed values."""

from pyspark.sql import functions as F

from lodestone.functions import codes
from lodestone.operators import facts, graph, partsjoin, search, similar


def one(spark, expr, *values, schema="c string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expr).collect()]


def test_stock_numbers(spark):
    assert one(spark, codes.norm_nsn(F.col("c")), "5305 00 123 4567", "5305001234567", "12", None) == ["5305-00-123-4567"] * 2 + [None, None]
    assert one(spark, codes.niin_strict(F.col("c")), "00-123-4567", "5305-00-123-4567", "123") == ["001234567", "001234567", None]


def test_revision(spark):
    r = one(spark, codes.revision(F.col("c")), "TM 9-2320-280-10 CHANGE 3, 15 JUNE 2004", "nothing")
    assert (r[0]["tm"], r[0]["change"], str(r[0]["date"])) == ("9-2320-280-10", 3, "2004-06-15")
    assert (r[1]["tm"], r[1]["change"], r[1]["date"]) == (None, 0, None)


def test_cage(spark):
    assert one(spark, codes.cage_reasons(F.col("c")), "19207", "1920", "O92-7") == [[], ["length"], ["character", "letter I or O"]]


def test_vehicles_and_files(spark):
    assert one(spark, codes.clean_vehicles(F.col("c")), "M998 | M998|x|a.pdf|N/A|M35") == [["M998", "M35"]]
    assert one(spark, codes.file_type(F.col("c")), "a/B.PDF", "x.png", "y.docx", "z") == ["pdf", "image", "office", "other"]


def test_html(spark):
    assert one(spark, codes.strip_html(F.col("c")), "<p>a&amp;b</p><script>x<y</script> <b>c</b>") == ["a&b c"]


def test_gate(spark):
    df = spark.createDataFrame([("torque", 50.0), ("torque", 1e6), ("length", -1.0), ("pressure", 0.5), ("other", None), ("torque", 4000.0), ("temperature", -40.0), ("torque", None)], "k string, v double")
    assert [r[0] for r in df.select(codes.value_gate(F.col("k"), F.col("v"))).collect()] == ["ok", "quarantine", "quarantine", "ok", "ok", "suspect", "ok", "quarantine"]


def test_measurements(spark):
    text = "Torque to 35-40 ft-lb, then 1,200 psi. Gap 0.5 inches; 10 inmates, fill 3 qt. None: 5 volts."
    got = facts.measurements(spark.createDataFrame([(1, 1, text), (1, 2, ""), (1, 3, None)], "document_id long, page int, body_text string")).orderBy("place").collect()
    assert [(r["type"], r["value"], r["value2"], r["unit"]) for r in got] == [("torque", 35.0, 40.0, "ft-lb"), ("pressure", 1200.0, None, "psi"), ("length", 0.5, None, "in"), ("capacity", 3.0, None, "qt"), ("electrical", 5.0, None, "V")]


def test_measurements_wide(spark):
    text = "-40 F to 120 F; 854 N•m, .015 in., 12 ±2 lbs, 350000000 ft-lb, 90 °C, 3,000 rpm and 12 VDC. 5W-30 oil, 0.5C rate.\n26\nN 7 sq ft"
    got = facts.measurements(spark.createDataFrame([(1, text)], "page int, body_text string")).orderBy("place").collect()
    assert [(r["type"], r["value"], r["tolerance"], r["unit"]) for r in got] == [
        ("temperature", -40.0, None, "degF"), ("temperature", 120.0, None, "degF"), ("torque", 854.0, None, "N-m"), ("length", 0.015, None, "in"), ("weight", 12.0, 2.0, "lb"),
        ("torque", 350000000.0, None, "ft-lb"), ("temperature", 90.0, None, "degC"), ("rotation", 3000.0, None, "rpm"), ("electrical", 12.0, None, "V"), ("area", 7.0, None, "sq-ft")]


def test_garbled(spark):
    assert one(spark, codes.garbled(F.col("c")), "12", "1O2", "1.2.3", "123456789", "12V", None) == [False, True, True, True, False, False]


def test_callouts(spark):
    got = facts.callouts(spark.createDataFrame([(1, "WARNING: hot surface. CAUTION do not touch NOTE x")], "document_id long, body_text string")).collect()
    assert [(r["severity"], r["body"]) for r in got] == [("WARNING", "hot surface."), ("CAUTION", "do not touch")]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (9, 9), (None, 1), (6, 5), (7, 6), (8, 7)], "a long, b long")
    assert {(r[0], r[1]) for r in graph.connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 4), (8, 4), (9, 9)}
    assert graph.connected_components(edges.where("a > 100")).count() == 0


def test_near_duplicates(spark):
    base = " ".join(f"wo{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    docs = spark.createDataFrame([(1, "x", base), (2, "x", base + " end"), (3, "x", "something else that is quite short"), (4, "y", base), (5, "x", None), (6, "x", ""), (7, None, "tiny text"), (8, None, "text tiny"), (9, None, "tiny other"), (10, "x", base)], "doc_id long, block string, text string")
    assert {(r[0], r[1]) for r in similar.near_duplicates(docs, "block").collect()} == {(1, 1), (2, 1), (10, 1), (5, 5), (6, 5), (7, 7), (8, 7)}


def test_figure_before(spark):
    rows = spark.createDataFrame([(1, 1, None, "a"), (1, 2, "F1", None), (1, 3, None, "b"), (1, 4, None, "c")], "document_id long, pos int, fig string, nsn string")
    assert [r["fig_no"] for r in partsjoin.figure_before(rows).orderBy("pos").collect()] == [None, "F1", "F1"]


def test_parse_operators(spark):
    q = spark.createDataFrame([(1, 'pump tm:9-1 vehicle:"M 35" tm:9-2'), (2, "plain")], "qid long, text string")
    got = search.parse_operators(q).orderBy("qid").collect()
    assert (got[0]["tm"], got[0]["vehicle"], got[0]["free"]) == ("9-2", "M 35", "pump")
    assert (got[1]["tm"], got[1]["free"]) == (None, "plain")


def test_hash_bucket(spark):
    assert one(spark, F.crc32(F.col("c").cast("binary")) % 384, "alternator") == [212]
