"""Registered queries over the parts index, the catalogue and the facts of manual pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.functions import codes, units
from lodestone.operators import facts, partsjoin as pj

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


P, C, FC = b.with_(b.PARTS), b.with_(b.PARTS, b.CATALOGUE), b.with_(b.FACTS)


def asked(spark, sf):
    """Stock numbers that searches ask for: every part whose number is divisible by 100."""
    return b.catalogue(spark, sf).where("cast(niin as long) % 100 = 0").select("nsn")


ASKED = "asked AS (SELECT nsn FROM catalogue WHERE niin::BIGINT % 100 = 0)"


@query("c2_locate", C + """, q AS (SELECT niin::BIGINT AS qid, nsn AS key FROM catalogue WHERE niin::BIGINT % 100 = 0)
SELECT qid, document_id, page, fig_no, min(nsn) AS nsn, min(part_number) AS part_number FROM parts JOIN q ON nsn = key OR part_number = key GROUP BY ALL""")
def _(spark, sf):
    q = b.catalogue(spark, sf).where("cast(niin as long) % 100 = 0").select(F.col("niin").cast("long").alias("qid"), F.col("nsn").alias("key"))
    return pj.locate(b.parts(spark, sf), q)


@query("c3_reference_names", C + """SELECT p.nsn, coalesce(c.item_name, p.own) AS label, c.characteristics, p.fig_no, p.n_vehicles
FROM (SELECT nsn, max(name) AS own, max(fig_no) AS fig_no, count(DISTINCT vehicle) AS n_vehicles FROM parts GROUP BY nsn) p
LEFT JOIN (SELECT nsn, max(nullif(trim(item_name), '')) AS item_name, max(characteristics) AS characteristics FROM catalogue GROUP BY nsn) c USING (nsn)""")
def _(spark, sf):
    return pj.reference_names(b.parts(spark, sf), b.catalogue(spark, sf))


@query("c5_only_indexed", C + "SELECT niin, nsn, item_name, characteristics, price, kind, size FROM catalogue WHERE nsn IN (SELECT nsn FROM parts)")
def _(spark, sf):
    return pj.only_indexed(b.catalogue(spark, sf), b.parts(spark, sf))


@query("c6_suppressed", FC + """, ext AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS niin, 'length' AS type, p_size::DOUBLE AS value FROM part)
SELECT niin, type, value FROM ext WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.niin = ext.niin AND f.type = ext.type)""")
def _(spark, sf):
    ext = b.read(spark, sf, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("niin"), F.lit("length").alias("type"), F.col("p_size").cast("double").alias("value"))
    return facts.suppressed(ext, facts.measurements(b.manual(spark, sf)))


@query("c7_key_sets", C + """SELECT count(*) FILTER (p.nsn IS NOT NULL AND c.nsn IS NOT NULL) AS linked, count(*) FILTER (c.nsn IS NULL) AS left_only, count(*) FILTER (p.nsn IS NULL) AS right_only
FROM (SELECT DISTINCT nsn FROM parts) p FULL JOIN (SELECT DISTINCT nsn FROM catalogue) c ON p.nsn = c.nsn""")
def _(spark, sf):
    return pj.key_sets(b.parts(spark, sf), b.catalogue(spark, sf))


@query("c8_figure_before", """WITH m AS (SELECT l_orderkey AS document_id, l_linenumber AS pos, CASE WHEN l_linenumber % 3 = 1 THEN l_suppkey END AS fig, CASE WHEN l_linenumber % 3 <> 1 THEN l_partkey END AS nsn,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem), one AS (SELECT * FROM m WHERE rn = 1)
SELECT document_id, pos, nsn, last_value(fig IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fig_no FROM one QUALIFY nsn IS NOT NULL""")
def _(spark, sf):
    from pyspark.sql import Window

    rows = b.read(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    one = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    k = F.col("l_linenumber") % 3
    marked = one.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("pos"), F.when(k == 1, F.col("l_suppkey")).alias("fig"), F.when(k != 1, F.col("l_partkey")).alias("nsn"))
    return pj.figure_before(marked).select("document_id", "pos", "nsn", "fig_no")


@query("c9_fallback_keys", P + """, rows AS (SELECT DISTINCT part_number, niin FROM parts), q AS (SELECT p_partkey AS qid, p_brand || '-' || p_partkey::VARCHAR || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE '' END AS pn FROM part),
c AS (SELECT qid, 1 AS rank, niin, part_number FROM q JOIN rows ON upper(pn) = upper(part_number) UNION ALL SELECT qid, 2, niin, part_number FROM q JOIN rows ON regexp_replace(upper(pn), '[A-Z]$', '') = upper(part_number))
SELECT qid, rank, niin, part_number FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank, niin, part_number) = 1""")
def _(spark, sf):
    q = b.read(spark, sf, "part").select(F.col("p_partkey").alias("qid"), F.concat(F.col("p_brand"), F.lit("-"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("")).alias("pn"))
    return pj.fallback_keys(q, b.parts(spark, sf))


@query("c10_recover_niin", P + """, k AS (SELECT upper(regexp_replace(part_number, '[^A-Za-z0-9]', '', 'g')) AS pn_norm, max(niin) AS found FROM parts GROUP BY 1)
SELECT pn_norm, s_suppkey, part_number, found FROM (SELECT s_suppkey, 'brand#1 ' || s_suppkey::VARCHAR AS part_number, upper(regexp_replace('brand#1 ' || s_suppkey::VARCHAR, '[^A-Za-z0-9]', '', 'g')) AS pn_norm FROM supplier) LEFT JOIN k USING (pn_norm)""")
def _(spark, sf):
    rows = b.read(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("brand#1 "), F.col("s_suppkey").cast("string")).alias("part_number"))
    return pj.recover_niin(rows, b.parts(spark, sf))


@query("c12_key_conflicts", P + """, codes AS (SELECT DISTINCT document_id, page, '5300-00-000-0000' AS barcode FROM parts), k AS (SELECT document_id, page, list(DISTINCT nsn) AS keys FROM parts GROUP BY ALL)
SELECT document_id, page, barcode, unnest(keys) AS page_nsn FROM codes JOIN k USING (document_id, page) WHERE NOT list_contains(keys, barcode) AND len(keys) <= 5""")
def _(spark, sf):
    parts = b.parts(spark, sf)
    codes_ = parts.select("document_id", "page", F.lit("5300-00-000-0000").alias("barcode")).distinct()
    return pj.key_conflicts(codes_, parts)


@query("c13_supersession", C + """, l AS (SELECT nsn, unnest(string_split_regex('use ' || lag(nsn) OVER (ORDER BY niin) || '; ' || lpad((niin::BIGINT + 2)::VARCHAR, 9, '0'), '[,;/ ]+')) AS token FROM catalogue),
t AS (SELECT nsn, token, right(regexp_replace(token, '[^0-9]', '', 'g'), 9) AS niin FROM l WHERE length(regexp_replace(token, '[^0-9]', '', 'g')) >= 9)
SELECT nsn, token, niin FROM t WHERE niin IN (SELECT niin FROM parts)""".replace("'use ' || lag(nsn) OVER (ORDER BY niin) || '; ' ||", "'use ' || nsn || '; ' ||"))
def _(spark, sf):
    links = b.catalogue(spark, sf).select("nsn", F.concat(F.lit("use "), "nsn", F.lit("; "), F.lpad((F.col("niin").cast("long") + 2).cast("string"), 9, "0")).alias("superseded"))
    return pj.supersession(links, b.parts(spark, sf))


@query("c15_siblings", C + f""", {ASKED}, mine AS (SELECT DISTINCT nsn AS of, document_id, fig_no FROM parts WHERE nsn IN (SELECT nsn FROM asked))
SELECT DISTINCT of, nsn, part_number, name FROM mine JOIN parts USING (document_id, fig_no) WHERE nsn <> of""")
def _(spark, sf):
    return pj.siblings(b.parts(spark, sf), asked(spark, sf))


@query("c16_see_also", C + f""", {ASKED}, named AS (SELECT DISTINCT nsn, lower(name) AS title FROM parts), mine AS (SELECT DISTINCT nsn AS of, document_id, fig_no FROM parts WHERE nsn IN (SELECT nsn FROM asked)),
sib AS (SELECT DISTINCT of, nsn FROM mine JOIN parts USING (document_id, fig_no) WHERE nsn <> of),
p AS (SELECT DISTINCT a.nsn AS of, n.nsn FROM named a JOIN named n USING (title) WHERE a.nsn IN (SELECT nsn FROM asked) AND a.nsn <> n.nsn)
SELECT of, nsn FROM (SELECT * FROM p EXCEPT SELECT * FROM sib) QUALIFY row_number() OVER (PARTITION BY of ORDER BY nsn) <= 40""")
def _(spark, sf):
    return pj.see_also(b.parts(spark, sf), asked(spark, sf))


@query("c17_on_page", P + """SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY nsn IS NULL, name, nsn, part_number) AS place FROM (SELECT DISTINCT document_id, page, nsn, part_number, name FROM parts)""")
def _(spark, sf):
    return pj.on_page(b.parts(spark, sf))


@query("c18_nearest_line", """WITH pt AS (SELECT l_orderkey % 20 AS page, l_orderkey * 10 + l_linenumber AS point_id, (l_partkey * 37 % 2000)::DOUBLE AS x, (l_suppkey * 91 % 2000)::DOUBLE AS y FROM lineitem),
ln AS (SELECT o_orderkey % 20 AS page, o_orderkey AS line_id, (o_custkey * 53 % 2000)::DOUBLE AS lx, (o_orderkey * 71 % 2000)::DOUBLE AS ly FROM orders),
m AS (SELECT page, point_id, line_id, (x - lx) * (x - lx) + (y - ly) * (y - ly) AS d2 FROM pt JOIN ln USING (page) WHERE (x - lx) * (x - lx) + (y - ly) * (y - ly) < 3600)
SELECT page, point_id, line_id, round(sqrt(d2), 6) AS distance FROM (SELECT DISTINCT * FROM m) QUALIFY row_number() OVER (PARTITION BY page, point_id ORDER BY d2, line_id) = 1""")
def _(spark, sf):
    pt = b.read(spark, sf, "lineitem").selectExpr("l_orderkey % 20 AS page", "l_orderkey * 10 + l_linenumber AS point_id", "cast(l_partkey * 37 % 2000 AS double) AS x", "cast(l_suppkey * 91 % 2000 AS double) AS y")
    ln = b.read(spark, sf, "orders").selectExpr("o_orderkey % 20 AS page", "o_orderkey AS line_id", "cast(o_custkey * 53 % 2000 AS double) AS lx", "cast(o_orderkey * 71 % 2000 AS double) AS ly")
    return pj.nearest(pt, ln)


HEADS = """heads AS (SELECT l_orderkey AS document_id, l_linenumber AS page, CASE WHEN min(l_suppkey) % 2 = 0 THEN 'operator' ELSE 'mechanic' END AS side FROM lineitem GROUP BY ALL),
marked AS (SELECT *, CASE WHEN lag(side) OVER (PARTITION BY document_id ORDER BY page) = side THEN 0 ELSE 1 END AS new FROM heads),
isl AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY page) AS island FROM marked),
runs AS (SELECT document_id, side, min(page) AS start, max(page) AS last FROM isl GROUP BY document_id, island, side),
sections AS (SELECT document_id, side, start, coalesce(lead(start) OVER (PARTITION BY document_id ORDER BY start) - 1, last) AS "end" FROM runs)"""


def heads(spark, sf):
    side = F.when(F.min("l_suppkey") % 2 == 0, "operator").otherwise("mechanic").alias("side")
    return b.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page")).agg(side)


@query("e4_sections", f"WITH {HEADS} SELECT * FROM sections")
def _(spark, sf):
    return facts.sections(heads(spark, sf))


@query("c19_in_sections", f"WITH {HEADS} SELECT h.document_id, h.page, s.side, s.start, s.\"end\" FROM heads h JOIN sections s ON h.document_id = s.document_id AND h.page BETWEEN s.start AND s.\"end\"")
def _(spark, sf):
    h = heads(spark, sf)
    return pj.in_sections(h.select("document_id", "page"), facts.sections(h))


@query("c22_part_records", C + """, own AS (SELECT niin, min(part_number) AS part_number, max(name) AS own, list_sort(list(DISTINCT vehicle)) AS v, count(DISTINCT nsn) AS n_nsn FROM parts GROUP BY niin)
SELECT niin, part_number, coalesce(item_name, own) AS name, CASE WHEN item_name IS NOT NULL THEN 'catalogue' ELSE 'parts list' END AS name_from, coalesce(lower(item_name) <> lower(own), false) AS name_conflict,
array_to_string(v, ' | ') AS vehicles, n_nsn > 1 AS drifts, round(least(1.0::DOUBLE, 0.3::DOUBLE + 0.2 + CASE WHEN item_name IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN len(v) > 1 THEN 0.3 ELSE 0 END), 3) AS confidence
FROM own LEFT JOIN (SELECT niin, item_name FROM catalogue) USING (niin)""")
def _(spark, sf):
    return pj.part_records(b.parts(spark, sf), b.catalogue(spark, sf))


@query("c26_citations", P + "SELECT nsn, vehicle, fig_no, min(page) AS page, count(*) AS n FROM parts GROUP BY ALL")
def _(spark, sf):
    return pj.citations(b.parts(spark, sf))


LINKS = "links AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS a, lpad((p_partkey + 3)::VARCHAR, 9, '0') AS b FROM part WHERE p_partkey % 7 = 0)"


def links(spark, sf):
    return b.read(spark, sf, "part").where("p_partkey % 7 = 0").selectExpr("lpad(cast(p_partkey as string), 9, '0') AS a", "lpad(cast(p_partkey + 3 as string), 9, '0') AS b")


@query("c29_family", f"WITH {LINKS} SELECT a AS niin, b AS related FROM links UNION SELECT b, a FROM links")
def _(spark, sf):
    return pj.family(links(spark, sf))


@query("c32_best_figure", P + "SELECT nsn, fig_no, page, document_id FROM parts QUALIFY row_number() OVER (PARTITION BY nsn ORDER BY fig_no = 0, page, document_id, fig_no) = 1")
def _(spark, sf):
    return pj.best_figure(b.parts(spark, sf))


@query("d4_common_nomenclature", P + "SELECT trim(name) AS label, count(*) AS n, count(DISTINCT nsn) AS n_nsn, count(DISTINCT vehicle) AS n_vehicles FROM parts WHERE trim(name) <> '' GROUP BY 1 ORDER BY n DESC, label LIMIT 25")
def _(spark, sf):
    return pj.common_names(b.parts(spark, sf))


@query("d5_recurring", P + "SELECT nsn, count(*) AS n, count(DISTINCT vehicle) AS n_vehicles, max(name) AS label FROM parts GROUP BY nsn ORDER BY n DESC, nsn LIMIT 25")
def _(spark, sf):
    return pj.recurring(b.parts(spark, sf))


@query("d8_platforms", P + "SELECT nsn, count(DISTINCT vehicle) AS n_vehicles, array_to_string(list_sort(list(DISTINCT vehicle))[1:40], ' | ') AS vehicles, count(DISTINCT document_id) AS n_docs FROM parts GROUP BY nsn")
def _(spark, sf):
    return pj.platforms(b.parts(spark, sf))


@query("d9_drift", P + "SELECT niin, count(DISTINCT nsn) AS n, array_to_string(list_sort(list(DISTINCT nsn)), ' | ') AS variants, count(DISTINCT substr(nsn, 1, 4)) > 1 AS class_conflict FROM parts GROUP BY niin HAVING count(DISTINCT nsn) > 1")
def _(spark, sf):
    return pj.drift(b.parts(spark, sf))


@query("d11_commonality", P + "SELECT niin, count(DISTINCT vehicle) AS n_vehicles, CASE WHEN count(DISTINCT vehicle) = 1 THEN 'single-platform' WHEN count(DISTINCT vehicle) < 10 THEN 'shared' ELSE 'fleet-common' END AS label FROM parts GROUP BY niin")
def _(spark, sf):
    return pj.commonality(b.parts(spark, sf))


@query("d12_congruency", C + """, per AS (SELECT niin, count(DISTINCT nsn) AS variants, count(DISTINCT vehicle) AS spread, count(*) AS n, bool_or(niin IN (SELECT niin FROM catalogue)) AS known FROM parts GROUP BY niin),
one AS (SELECT sum(n)::BIGINT AS rows, count(*)::BIGINT AS items, count(*) FILTER (known)::BIGINT AS linked, count(*) FILTER (variants > 1)::BIGINT AS drifting, count(*) FILTER (spread > 1)::BIGINT AS shared, max(spread)::BIGINT AS max_spread FROM per)
UNPIVOT one ON COLUMNS(*) INTO NAME metric VALUE value""".replace("UNPIVOT one ON COLUMNS(*) INTO NAME metric VALUE value", "SELECT metric, value FROM (UNPIVOT one ON COLUMNS(*) INTO NAME metric VALUE value)"))
def _(spark, sf):
    return pj.congruency(b.parts(spark, sf), b.catalogue(spark, sf))


@query("d27_kit", P + "SELECT document_id, upper(nsn) AS key, sum(qty)::BIGINT AS qty, count(*) AS n_lines FROM parts GROUP BY ALL")
def _(spark, sf):
    return pj.kit(b.parts(spark, sf))


@query("d28_look_alikes", P + """SELECT name, count(DISTINCT nsn) AS n_nsn, count(DISTINCT part_number) > 1 AS part_number_differs, count(DISTINCT cagec) > 1 AS cagec_differs, count(DISTINCT uoc) > 1 AS uoc_differs, count(DISTINCT vehicle) > 1 AS vehicle_differs
FROM parts GROUP BY name HAVING count(DISTINCT nsn) > 1""")
def _(spark, sf):
    return pj.look_alikes(b.parts(spark, sf))


@query("d30_interchange", f"""WITH {LINKS}, traits AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS niin, unnest(['brand', 'type', 'size', 'name']) AS requirement, unnest([p_brand, p_type, (p_size % 3)::VARCHAR, p_name]) AS reply FROM part),
pairs AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS a, lpad((p_partkey + k)::VARCHAR, 9, '0') AS b FROM part, (VALUES (1), (3), (64)) v(k)),
rep AS (SELECT a, lpad((a::BIGINT + 1)::VARCHAR, 9, '0') AS b FROM links),
fam AS (SELECT a, b FROM links UNION SELECT b, a FROM links), r2 AS (SELECT a, b FROM rep UNION SELECT b, a FROM rep),
s AS (SELECT p.a, p.b, count(*) FILTER (x.reply = y.reply) AS same, count(*) FILTER (x.reply <> y.reply) AS differ FROM pairs p JOIN traits x ON x.niin = p.a JOIN traits y ON y.niin = p.b AND y.requirement = x.requirement GROUP BY ALL),
m AS (SELECT p.a, p.b, f.a IS NOT NULL AS fam, r.a IS NOT NULL AS rep, round(100.0::DOUBLE * same / (same + differ)) AS pct, same + differ AS n FROM pairs p LEFT JOIN fam f ON f.a = p.a AND f.b = p.b LEFT JOIN r2 r ON r.a = p.a AND r.b = p.b LEFT JOIN s ON s.a = p.a AND s.b = p.b)
SELECT a, b, coalesce(pct, 0.0)::DOUBLE AS similarity, CASE WHEN fam THEN 'green' WHEN rep THEN 'amber' WHEN pct >= 90 AND n >= 3 THEN 'amber' ELSE 'red' END AS verdict FROM m""")
def _(spark, sf):
    part = b.read(spark, sf, "part").withColumn("niin", F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    traits = part.select("niin", F.explode(F.expr("array(struct('brand' AS requirement, p_brand AS reply), struct('type' AS requirement, p_type AS reply), struct('size' AS requirement, cast(p_size % 3 as string) AS reply), struct('name' AS requirement, p_name AS reply))")).alias("t")).select("niin", "t.requirement", "t.reply")
    pairs = part.select(F.col("niin").alias("a"), F.explode(F.expr("array(1, 3, 64)")).alias("k"), "p_partkey").selectExpr("a", "lpad(cast(p_partkey + k as string), 9, '0') AS b")
    known = links(spark, sf)
    replaced = known.selectExpr("a", "lpad(cast(cast(a as long) + 1 as string), 9, '0') AS b")
    return pj.interchange(pairs, known, replaced, traits)


RD = b.with_(b.READ)


def read_facts(spark, sf):
    return facts.measurements(b.readings(spark, sf))


@query("i1_measurements", RD + """, cut AS (SELECT *, 'Set the ' || p_name || ' of this vehicle to ' AS before, value::BIGINT::VARCHAR || CASE WHEN value2 IS NOT NULL THEN ' to ' || value2::BIGINT::VARCHAR WHEN tolerance IS NOT NULL THEN ' +/- 2' ELSE '' END || spelled AS seen FROM facts),
-- a dot after a unit is not of it
ends AS (SELECT *, rtrim(seen, '.') AS raw, substr(seen, length(rtrim(seen, '.')) + 1) || ' before the next run;' || chr(10) || ' then go on with the other steps of this procedure.' AS after FROM cut)
SELECT document_id, page, niin, source_id, type, value, value2, tolerance, unit, raw, trim(regexp_replace(right(before, 45) || raw || left(after, 45), '\\s+', ' ', 'g')) AS context FROM ends""")
def _(spark, sf):
    return facts.measurements(b.readings(spark, sf), context=True).drop("place", "grade")


@query("b13_value_gate", """WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN 'torque' WHEN 1 THEN 'pressure' WHEN 2 THEN 'temperature' WHEN 3 THEN 'length' WHEN 4 THEN 'torque' WHEN 5 THEN 'serial' ELSE 'weight' END AS type,
  CASE WHEN l_quantity < 5 THEN l_quantity::BIGINT::VARCHAR || 'O' || '2' WHEN l_quantity < 10 THEN '-' || l_quantity::BIGINT::VARCHAR WHEN l_quantity < 15 THEN l_quantity::BIGINT::VARCHAR || '00000' WHEN l_quantity < 20 THEN l_quantity::BIGINT::VARCHAR || '1234567' WHEN l_quantity < 25 THEN 'n/a'
  WHEN l_quantity < 30 THEN l_quantity::BIGINT::VARCHAR || '.5.1' ELSE l_quantity::BIGINT::VARCHAR END AS given, l_quantity AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, type, given, CASE WHEN q < 5 OR q BETWEEN 15 AND 19 OR q BETWEEN 25 AND 29 THEN 'quarantine' WHEN type = 'serial' THEN 'ok' WHEN q BETWEEN 20 AND 24 THEN 'quarantine'
    WHEN q BETWEEN 5 AND 9 THEN CASE WHEN type = 'temperature' THEN 'ok' ELSE 'quarantine' END
    WHEN q BETWEEN 10 AND 14 THEN 'quarantine' ELSE 'ok' END AS status,
  CASE WHEN q < 5 OR q BETWEEN 15 AND 19 OR q BETWEEN 25 AND 29 THEN 'garbled' WHEN type = 'serial' THEN '' WHEN q BETWEEN 20 AND 24 THEN 'no number' WHEN q BETWEEN 5 AND 9 THEN CASE WHEN type = 'temperature' THEN '' ELSE 'negative' END
    WHEN q BETWEEN 10 AND 14 THEN 'out of physical range' ELSE '' END AS reason FROM v""")
def _(spark, sf):
    q = F.col("l_quantity").cast("long")
    kind = F.element_at(F.array(*map(F.lit, ("torque", "pressure", "temperature", "length", "torque", "serial", "weight"))), F.col("l_linenumber") % 7 + 1)
    text = q.cast("string")
    given = F.when(q < 5, F.concat(text, F.lit("O2"))).when(q < 10, F.concat(F.lit("-"), text)).when(q < 15, F.concat(text, F.lit("00000"))).when(q < 20, F.concat(text, F.lit("1234567"))).when(q < 25, "n/a").when(q < 30, F.concat(text, F.lit(".5.1"))).otherwise(text)
    rows = b.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("type"), given.alias("given"))
    value = F.expr("try_cast(given AS double)")
    return rows.select("*", codes.value_gate(F.col("type"), value, F.col("given")).alias("status"), codes.gate_reason(F.col("type"), value, F.col("given")).alias("reason"))


@query("b14_gate_summary", RD + """SELECT type, CASE WHEN type = 'torque' AND value < 0.5 THEN 'suspect' WHEN type = 'length' AND value < 0.0005 THEN 'suspect' ELSE 'ok' END AS status, count(*) AS n, min(value) AS least, max(value) AS most FROM facts GROUP BY ALL""")
def _(spark, sf):
    return facts.gated(read_facts(spark, sf)).groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


MASTER = """corpus AS (SELECT DISTINCT niin, type, unit, document_id, page, value, NULL::VARCHAR AS given FROM facts UNION ALL SELECT DISTINCT niin, 'grade', '', document_id, page, NULL, grade FROM facts),
ext AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS niin, unnest(['length', 'area']) AS type, unnest(['in', 'sq-in']) AS unit, p_size::DOUBLE AS value FROM part),
every AS (SELECT niin, type, unit, value, given, 'corpus' AS origin FROM corpus UNION ALL SELECT niin, type, unit, value, NULL, 'external' FROM ext WHERE NOT EXISTS (SELECT 1 FROM corpus c WHERE c.niin = ext.niin AND c.type = ext.type)),
said AS (SELECT niin, type, unit, origin, first(given ORDER BY n DESC, given) AS given FROM (SELECT niin, type, unit, origin, given, count(*) AS n FROM every GROUP BY ALL) GROUP BY ALL),
master AS (SELECT niin, type, unit, origin, round(median(value), 6) AS value, min(value) AS low, max(value) AS high, count(*) AS n, CASE WHEN count(value) = 0 THEN any_value(said.given) END AS text FROM every JOIN said USING (niin, type, unit, origin) GROUP BY ALL)"""


def master_table(spark, sf):
    found = read_facts(spark, sf)
    grades = found.select("niin", F.lit("grade").alias("type"), F.lit("").alias("unit"), "document_id", "page", F.lit(None).cast("double").alias("value"), F.col("grade").alias("given"))
    both = found.select("niin", "type", "unit", "document_id", "page", "value", F.lit(None).cast("string").alias("given")).union(grades)
    kinds = F.explode(F.array(F.struct(F.lit("length").alias("type"), F.lit("in").alias("unit")), F.struct(F.lit("area").alias("type"), F.lit("sq-in").alias("unit"))))
    ext = b.read(spark, sf, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("niin"), F.col("p_size").cast("double").alias("value"), kinds.alias("k")).select("niin", "k.type", "k.unit", "value")
    return facts.consolidate(both, external=ext)


@query("d14_consolidate", RD + f", {MASTER} SELECT * FROM master")
def _(spark, sf):
    return master_table(spark, sf)


@query("d15_dimension_sheet", RD + f""", {MASTER}, wide AS (SELECT *, coalesce(high > low AND high - low > 0.25 * abs(CASE WHEN value = 0 THEN 1 ELSE value END) AND n > 1, false) AS w FROM master)
SELECT niin, type, unit, origin, value, low, high, n, text, CASE WHEN w THEN 'wide' ELSE '' END AS spread, CASE WHEN origin = 'external' THEN 'low' WHEN w THEN 'review' WHEN n >= 2 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN unit IN ('mm', 'cm', 'm', 'N-m', 'kPa', 'MPa', 'bar', 'L', 'mL', 'kg', 'g', 'N', 'kN', 'km/h', 'degC') THEN 'metric' WHEN unit IN ('', 'V', 'A', 'mA', 'ohm', 'W', 'Hz', 'deg', 'rpm') THEN '' ELSE 'imperial' END AS system FROM wide""")
def _(spark, sf):
    return facts.dimension_sheet(master_table(spark, sf)).drop("alt")


TYPES = "['length', 'area', 'angle', 'weight', 'force', 'torque', 'pressure', 'capacity', 'electrical', 'temperature', 'flow', 'speed', 'rotation']"


@query("d16_type_coverage", RD + f""", {MASTER} SELECT niin, len(have)::BIGINT AS n, corpus, external, array_to_string(list_filter({TYPES}, lambda t: NOT list_contains(have, t)), ',') AS missing
FROM (SELECT niin, list(DISTINCT type) AS have, count(*) FILTER (origin = 'corpus') AS corpus, count(*) FILTER (origin = 'external') AS external FROM master GROUP BY niin)""")
def _(spark, sf):
    return facts.type_coverage(master_table(spark, sf))


@query("d17_gaps", RD + f"""SELECT s.niin, t.type, CASE WHEN count(f.niin) = 0 THEN 'gap' WHEN count(f.niin) = 1 THEN 'inconclusive' ELSE 'present' END AS state
FROM (SELECT DISTINCT niin FROM facts) s CROSS JOIN (SELECT unnest({TYPES}) AS type) t LEFT JOIN facts f ON f.niin = s.niin AND f.type = t.type GROUP BY ALL""")
def _(spark, sf):
    return facts.gaps(read_facts(spark, sf))


CONFLICTS = """per AS (SELECT niin, type, unit, min(value) AS low, max(value) AS high, count(DISTINCT document_id) AS n_docs, count(DISTINCT round(value, 6)) AS n_values FROM facts GROUP BY ALL),
odd AS (SELECT *, CASE WHEN type IN ('torque', 'pressure', 'electrical', 'force') THEN 'high' ELSE 'medium' END AS severity FROM per WHERE n_values >= 2 AND high > 0 AND (high - low) / high > 0.05 AND n_docs >= 2)"""


@query("d18_conflicts", RD + f", {CONFLICTS} SELECT * FROM odd")
def _(spark, sf):
    return facts.conflicts(read_facts(spark, sf))


@query("d19_conflict_sweep", RD + f""", {CONFLICTS}, top AS (SELECT niin FROM facts GROUP BY niin ORDER BY count(*) DESC, niin LIMIT 100)
SELECT (SELECT count(*) FROM top) AS checked, count(DISTINCT niin) AS subjects, count(*) AS conflicts, count(*) FILTER (severity = 'high') AS high FROM odd WHERE niin IN (SELECT niin FROM top)""")
def _(spark, sf):
    return facts.conflict_sweep(read_facts(spark, sf), 100)[1]


@query("d20_agreement", RD + """, per AS (SELECT niin, type, unit, count(DISTINCT source_id) AS methods, count(*) AS n, list_sort(list(value)) AS v FROM facts GROUP BY ALL),
judged AS (SELECT *, CASE WHEN methods < 2 THEN 'single method' WHEN (v[-1] - v[1]) / greatest(v[-1], 1e-9) <= 0.03 THEN 'confirmed' ELSE 'conflict' END AS verdict FROM per)
SELECT niin, type, unit, methods, n, v[len(v) // 2 + 1] AS consensus, verdict, CASE verdict WHEN 'confirmed' THEN 'high' WHEN 'conflict' THEN 'review' ELSE 'medium' END AS trust FROM judged""")
def _(spark, sf):
    return facts.agreement(read_facts(spark, sf))


@query("i3_callouts", FC + "SELECT document_id, page, niin, source_id, 'WARNING' AS severity, 3 AS rank, 'keep the ' || p_name || ' at a pressure of ' || value::BIGINT::VARCHAR || ' psi or less.' AS body FROM facts WHERE type = 'pressure'")
def _(spark, sf):
    return facts.callouts(b.manual(spark, sf))


@query("d39_by_severity", FC + "SELECT 'WARNING' AS severity, count(*) AS n FROM facts WHERE type = 'pressure'")
def _(spark, sf):
    return facts.by_severity(facts.callouts(b.manual(spark, sf)))


@query("i7_intervals", FC + "SELECT document_id, page, niin, source_id, value, 'hour' AS unit, round(value / 24, 6) AS days FROM facts WHERE type = 'capacity'")
def _(spark, sf):
    return facts.intervals(b.manual(spark, sf))


@query("i13_torques", FC + "SELECT document_id, page, niin, source_id, type, value, NULL::DOUBLE AS value2, NULL::DOUBLE AS tolerance, unit FROM facts WHERE type = 'torque'")
def _(spark, sf):
    return facts.torques(b.manual(spark, sf))


@query("i6_fluids", FC + "SELECT document_id, page, niin, source_id, p_name AS system, value AS capacity, 'qt' AS unit, 'oil' AS fluid FROM facts WHERE type = 'capacity'")
def _(spark, sf):
    return facts.fluids(b.manual(spark, sf))


@query("i22_assess", FC + """, lim AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS niin, 'torque' AS type, 'ft-lb' AS unit, p_size::DOUBLE AS lo, p_size + 20.0::DOUBLE AS hi FROM part)
SELECT f.niin, f.type, f.unit, document_id, page, value, lo, hi, CASE WHEN value < lo OR value > hi THEN 'no-go' WHEN value < lo * 1.03 OR value > hi * 0.97 THEN 'marginal' ELSE 'go' END AS verdict FROM facts f JOIN lim USING (niin, type, unit)""")
def _(spark, sf):
    lim = b.read(spark, sf, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("niin"), F.lit("torque").alias("type"), F.lit("ft-lb").alias("unit"), F.col("p_size").cast("double").alias("lo"), (F.col("p_size") + 20.0).alias("hi"))
    return facts.assess(facts.measurements(b.manual(spark, sf)).select("niin", "type", "unit", "document_id", "page", "value"), lim)


@query("i2_dual_units", RD + """, partners(unit, other, factor) AS (VALUES ('ft-lb', 'N-m', 1.3558179483314004), ('in-lb', 'N-m', 0.1129848290276167), ('N-m', 'ft-lb', 0.7375621492772656), ('psi', 'kPa', 6.894757293168361), ('in', 'mm', 25.4), ('ft', 'm', 0.3048), ('m', 'ft', 3.280839895013123),
  ('gal', 'L', 3.785411784), ('qt', 'L', 0.946352946), ('lb', 'kg', 0.45359237), ('kg', 'lb', 2.2046226218487757), ('oz', 'g', 28.349523125), ('mph', 'km/h', 1.609344), ('km/h', 'mph', 0.621371192237334), ('sq-in', 'sq-cm', 6.4516), ('lbf', 'N', 4.4482216152605), ('gpm', 'L/min', 3.785411784), ('bar', 'psi', 14.503773773020923))
SELECT document_id, page, niin, value, unit, other, round(value * factor, 4) AS converted FROM facts JOIN partners USING (unit)
UNION ALL SELECT document_id, page, niin, value, unit, CASE unit WHEN 'degF' THEN 'degC' ELSE 'degF' END, round(CASE unit WHEN 'degF' THEN (value - 32) * 5 / 9 ELSE value * 9 / 5 + 32 END, 4) FROM facts WHERE type = 'temperature'""")
def _(spark, sf):
    shown = ("ft-lb", "in-lb", "N-m", "psi", "in", "ft", "m", "gal", "qt", "lb", "kg", "oz", "mph", "km/h", "sq-in", "lbf", "gpm", "bar", "degF", "degC")
    found = read_facts(spark, sf).where(F.col("unit").isin(*shown)).withColumn("other", units.partner(F.col("unit")))
    return found.select("document_id", "page", "niin", "value", "unit", "other", F.round(units.convert(F.col("value"), F.col("unit"), F.col("other")), 4).alias("converted"))


@query("i25_decode_nsn", P + "SELECT DISTINCT nsn, substr(nsn, 1, 4) AS fsc, substr(nsn, 1, 2) AS fsg, substr(nsn, 6, 2) AS country, niin FROM parts")
def _(spark, sf):
    return b.parts(spark, sf).select("nsn", codes.decode_nsn(F.col("nsn")).alias("d")).select("nsn", "d.fsc", "d.fsg", "d.country", "d.niin").distinct()


@query("i27_cage", """SELECT s_suppkey, array_to_string(list_filter([CASE WHEN length(c) <> 5 THEN 'length' END, CASE WHEN regexp_matches(c, '[^A-Z0-9]') THEN 'character' END, CASE WHEN regexp_matches(c, '[IO]') THEN 'letter I or O' END], lambda x: x IS NOT NULL), ', ') AS reasons
FROM (SELECT s_suppkey, upper(substr(s_name, 1, 4) || s_suppkey::VARCHAR) AS c FROM supplier)""")
def _(spark, sf):
    code = F.concat(F.substring("s_name", 1, 4), F.col("s_suppkey").cast("string"))
    return b.read(spark, sf, "supplier").select("s_suppkey", F.array_join(codes.cage_reasons(code), ", ").alias("reasons"))


@query("i29_normal_forms", P + "SELECT DISTINCT nsn, part_number, niin AS niin_strict, upper(part_number) AS pn, regexp_replace(upper(part_number), '-[0-9]{1,2}$', '') AS base FROM parts")
def _(spark, sf):
    return b.parts(spark, sf).select(codes.norm_nsn(F.replace("nsn", F.lit("-"), F.lit(" "))).alias("nsn"), "part_number", codes.niin_strict(F.col("nsn")).alias("niin_strict"), codes.norm_pn(F.col("part_number")).alias("pn"), codes.base_pn(F.col("part_number")).alias("base")).distinct()
