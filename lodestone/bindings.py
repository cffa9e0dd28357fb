"""The given tables seen as manuals, parts lists, catalogue and logs; each view in Spark and as a DuckDB CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores where their files have fewer splits than there are cores; as they are, without an exchange, where they have as many.

    For narrow rows that much is computed from, before it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def nsn_of(niin, fsc):
    """The dashed stock number of a 9-digit item number and a 4-digit class."""
    return F.concat_ws("-", fsc.cast("string"), F.substring(niin, 1, 2), F.substring(niin, 3, 3), F.substring(niin, 6, 4))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each mention of a part on a page of a parts list."""
    line, part, supplier, nation = (read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    niin = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    drift = F.when((F.col("p_partkey") % 17 == 0) & (F.col("l_linenumber") % 2 == 0), 1).otherwise(0)
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        niin.alias("niin"), nsn_of(niin, 5300 + F.col("p_partkey") % 100 + drift).alias("nsn"), F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("part_number"),
        F.col("p_name").alias("name"), F.col("n_name").alias("vehicle"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"),
        (F.col("l_linenumber") % 5).alias("fig_no"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("cagec"), F.col("l_returnflag").alias("uoc"), F.col("l_quantity").cast("long").alias("qty"),
    )


PARTS = """parts AS (
  SELECT lpad(p_partkey::VARCHAR, 9, '0') AS niin,
    (5300 + p_partkey % 100 + CASE WHEN p_partkey % 17 = 0 AND l_linenumber % 2 = 0 THEN 1 ELSE 0 END)::VARCHAR || '-' || substr(lpad(p_partkey::VARCHAR, 9, '0'), 1, 2) || '-' || substr(lpad(p_partkey::VARCHAR, 9, '0'), 3, 3) || '-' || substr(lpad(p_partkey::VARCHAR, 9, '0'), 6, 4) AS nsn,
    p_brand || '-' || p_partkey::VARCHAR AS part_number, p_name AS name, n_name AS vehicle, l_orderkey AS document_id, l_linenumber AS page, l_linenumber % 5 AS fig_no,
    lpad(s_suppkey::VARCHAR, 5, '0') AS cagec, l_returnflag AS uoc, l_quantity::BIGINT AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External reference rows: two of three parts, with a length among their characteristics."""
    niin = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    return read(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(
        niin.alias("niin"), nsn_of(niin, 5300 + F.col("p_partkey") % 100).alias("nsn"), F.col("p_name").alias("item_name"), F.concat(F.lit("LENGTH: "), F.col("p_size").cast("string"), F.lit(" IN")).alias("characteristics"),
        F.col("p_retailprice").alias("price"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"),
    )


CATALOGUE = """catalogue AS (
  SELECT lpad(p_partkey::VARCHAR, 9, '0') AS niin,
    (5300 + p_partkey % 100)::VARCHAR || '-' || substr(lpad(p_partkey::VARCHAR, 9, '0'), 1, 2) || '-' || substr(lpad(p_partkey::VARCHAR, 9, '0'), 3, 3) || '-' || substr(lpad(p_partkey::VARCHAR, 9, '0'), 6, 4) AS nsn,
    p_name AS item_name, 'LENGTH: ' || p_size::VARCHAR || ' IN' AS characteristics, p_retailprice AS price, p_type AS kind, p_size AS size
  FROM part WHERE p_partkey % 3 <> 0)"""


def manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one sentence each that states a dimension; the columns hold what an extraction must find."""
    joined = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    q = F.col("l_quantity").cast("long").cast("string")
    kind = F.col("l_linenumber") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("Torque the "), "p_name", F.lit(" to "), q, F.lit(" ft-lb.")))
        .when(kind == 1, F.concat(F.lit("WARNING: keep the "), "p_name", F.lit(" at a pressure of "), q, F.lit(" psi or less.")))
        .when(kind == 2, F.concat(F.lit("The length of the "), "p_name", F.lit(" is "), q, F.lit(" in.")))
        .otherwise(F.concat(F.lit("Every "), q, F.lit(" hours fill the "), "p_name", F.lit(" with "), q, F.lit(" qt of oil.")))
    )
    return joined.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("niin"), text.alias("body_text"), F.col("l_suppkey").alias("source_id"))


#: What the sentences hold, from the columns alone.
FACTS = """facts AS (
  SELECT l_orderkey AS document_id, l_linenumber AS page, lpad(l_partkey::VARCHAR, 9, '0') AS niin, l_suppkey AS source_id, p_name,
    CASE l_linenumber % 4 WHEN 0 THEN 'torque' WHEN 1 THEN 'pressure' WHEN 2 THEN 'length' ELSE 'capacity' END AS type,
    CASE l_linenumber % 4 WHEN 0 THEN 'ft-lb' WHEN 1 THEN 'psi' WHEN 2 THEN 'in' ELSE 'qt' END AS unit, floor(l_quantity)::DOUBLE AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


#: How a reading is written after its number, and what it is; null for what is no measurement.
READINGS = (
    (" ft-lb", "ft-lb", "torque"), (" foot pounds", "ft-lb", "torque"), (" lbs-ft", "ft-lb", "torque"), (" ft. lbs", "ft-lb", "torque"), (" in-lbs", "in-lb", "torque"), (" inch-pounds", "in-lb", "torque"),
    (" N·m", "N-m", "torque"), (" Nm", "N-m", "torque"), (" newton meters", "N-m", "torque"), (" psi", "psi", "pressure"), (" PSIG", "psi", "pressure"), (" lbs per square inch", "psi", "pressure"),
    (" lb/in2", "psi", "pressure"), (" kPa", "kPa", "pressure"), (" megapascals", "MPa", "pressure"), (" bar", "bar", "pressure"), (" inches of mercury", "inHg", "pressure"), (" in-Hg", "inHg", "pressure"),
    (" volts", "V", "electrical"), (" VDC", "V", "electrical"), (" V", "V", "electrical"), (" amperes", "A", "electrical"), (" A", "A", "electrical"), (" mA", "mA", "electrical"), (" ohms", "ohm", "electrical"),
    (" watts", "W", "electrical"), (" Hz", "Hz", "electrical"), (" gallons per min", "gpm", "flow"), (" gal/min", "gpm", "flow"), (" gpm", "gpm", "flow"), (" cu ft/min", "cfm", "flow"), (" rpm", "rpm", "rotation"),
    (" rev/min", "rpm", "rotation"), (" mph", "mph", "speed"), (" miles per hour", "mph", "speed"), (" km/h", "km/h", "speed"), (" gallons", "gal", "capacity"), (" qts", "qt", "capacity"), (" pint", "pt", "capacity"),
    (" fl oz", "fl-oz", "capacity"), (" L", "L", "capacity"), (" millilitres", "mL", "capacity"), (" cc", "mL", "capacity"), (" lbf", "lbf", "force"), (" kN", "kN", "force"), (" N", "N", "force"), (" pounds", "lb", "weight"),
    (" lbs", "lb", "weight"), (" oz", "oz", "weight"), (" kg", "kg", "weight"), (" grams", "g", "weight"), (" tons", "ton", "weight"), (" F", "degF", "temperature"), ("° F", "degF", "temperature"), (" deg C", "degC", "temperature"),
    (" degrees Celsius", "degC", "temperature"), (" sq in", "sq-in", "area"), (" square feet", "sq-ft", "area"), ("°", "deg", "angle"), (" degrees", "deg", "angle"), (" in.", "in", "length"), (" inches", "in", "length"),
    (" feet", "ft", "length"), (" yards", "yd", "length"), (" mm", "mm", "length"), (" centimeters", "cm", "length"), (" m", "m", "length"), (" mils", "mil", "length"),
    ("W-30 oil", None, None), (" inmates", None, None), ("C rate", None, None), (" F-15 jets", None, None), (" volunteers", None, None), (" bolts", None, None),
)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one reading each, in one of many spellings, as a value, a range or a value with a tolerance, and what it is by the columns."""
    rows = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")).join(read(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    spelled = F.element_at(F.array(*[F.lit(s) for s, _, _ in READINGS]), ((F.col("l_partkey") * 5 + F.col("l_linenumber") % 4) % len(READINGS) + 1).cast("int"))
    q = F.col("l_quantity").cast("long")
    number = F.when(q % 3 == 0, q.cast("string")).when(q % 3 == 1, F.concat(q.cast("string"), F.lit(" to "), (q + 5).cast("string"))).otherwise(F.concat(q.cast("string"), F.lit(" +/- 2")))
    text = F.concat(F.lit("Set the "), "p_name", F.lit(" of this vehicle to "), number, spelled, F.lit(" before the next run;\n then go on with the other steps of this procedure."))
    return rows.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("niin"), text.alias("body_text"), F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("grade"))


_CASES = ", ".join("({}, '{}', {}, {})".format(i, s, *("NULL" if x is None else f"'{x}'" for x in (u, k))) for i, (s, u, k) in enumerate(READINGS))
#: What the readings are, from the columns and the table above alone.
READ = f"""cases(i, spelled, unit, type) AS (VALUES {_CASES}),
facts AS (
  SELECT l_orderkey AS document_id, l_linenumber AS page, lpad(l_partkey::VARCHAR, 9, '0') AS niin, l_suppkey AS source_id, l_returnflag AS grade, p_name, spelled, type, unit, floor(l_quantity)::DOUBLE AS value,
    CASE WHEN floor(l_quantity)::BIGINT % 3 = 1 THEN floor(l_quantity) + 5.0::DOUBLE END AS value2, CASE WHEN floor(l_quantity)::BIGINT % 3 = 2 THEN 2.0::DOUBLE END AS tolerance
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN cases ON i = (l_partkey * 5 + l_linenumber % 4) % {len(READINGS)} WHERE unit IS NOT NULL)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events: kind, query (a key), document and time."""
    events = read(spark, sf_dir, "events")
    return events.select("event_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("query"), F.col("user_id").alias("document_id"), "value", "ts")


LOG = """log AS (SELECT event_id, event_type AS kind, json_extract_string(props, '$.k') AS query, user_id AS document_id, value, ts FROM events)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at their newlines: doc_id, vehicle, page_number, body_text."""
    cut = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("vehicle"), F.col("lang").alias("type"), F.posexplode(F.split("text", "\n")).alias("page_number", "body_text"))
    return cut.withColumn("page_number", F.col("page_number") + 1)


PAGES = """pages_v AS (
  SELECT doc_id, source AS vehicle, lang AS type, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_number, unnest(string_split(text, chr(10))) AS body_text FROM documents)"""


def tokens(pages: DataFrame, key: list[str], text: str = "body_text") -> DataFrame:
    """One row a word: key, pos, term (lower case, letters and digits only)."""
    bare = F.lower(F.col(text))
    return pages.select(*key, F.posexplode(F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("pos", "term"))


TOKENS = r"regexp_extract_all(lower(body_text), '[\p{L}\p{N}]+')"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
