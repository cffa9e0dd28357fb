"""Registered queries over catalogue records, reviews and saved queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.operators import catalog as k, drawings, facts

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


C = b.with_(b.PARTS, b.CATALOGUE)
LINKS = "links AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS old, lpad((p_partkey + 1)::VARCHAR, 9, '0') AS new FROM part WHERE p_partkey % 9 = 1)"


def links(spark, sf):
    return b.read(spark, sf, "part").where("p_partkey % 9 = 1").selectExpr("lpad(cast(p_partkey as string), 9, '0') AS old", "lpad(cast(p_partkey + 1 as string), 9, '0') AS new")


@query("c23_records", C + f", {LINKS} SELECT c.niin, c.item_name, (SELECT array_to_string(list_sort(list(DISTINCT name)), '|') FROM parts p WHERE p.niin = c.niin) AS names, (SELECT array_to_string(list_sort(list(DISTINCT old)), '|') FROM links WHERE new = c.niin) AS replaces, (SELECT array_to_string(list_sort(list(DISTINCT new)), '|') FROM links WHERE old = c.niin) AS replaced_by FROM catalogue c")
def _(spark, sf):
    got = k.record(b.catalogue(spark, sf).select("niin", "item_name"), b.parts(spark, sf).select("niin", "name"), links(spark, sf))
    return got.select("niin", "item_name", *[F.array_join(c, "|").alias(c) for c in ("names", "replaces", "replaced_by")])


@query("c24_by_part_number", C + ", q AS (SELECT p_partkey AS qid, lower(replace(p_brand, '#', ' ')) || '/' || p_partkey::VARCHAR AS pn FROM part WHERE p_partkey % 100 = 0) SELECT DISTINCT qid, niin, nsn FROM q JOIN parts ON upper(regexp_replace(pn, '[^A-Za-z0-9]', '', 'g')) = upper(regexp_replace(part_number, '[^A-Za-z0-9]', '', 'g'))")
def _(spark, sf):
    q = b.read(spark, sf, "part").where("p_partkey % 100 = 0").selectExpr("p_partkey AS qid", "concat(lower(replace(p_brand, '#', ' ')), '/', p_partkey) AS pn")
    return k.by_part_number(q, b.parts(spark, sf))


#: What each code means for buying, as a table of answers.
CODES = "(VALUES ('B', 'active'), ('C', 'active'), ('D', 'active'), ('G', 'active'), ('H', 'obsolete'), ('J', 'obsolete'), ('K', 'obsolete'), ('L', 'obsolete'), ('O', 'obsolete'), ('V', 'obsolete'), ('Y', 'obsolete'), ('Z', 'obsolete'), ('X', 'active'))"


@query("d31_obsolescence", f"""WITH {LINKS}, codes AS (SELECT row_number() OVER () - 1 AS i, code, meaning FROM {CODES} v(code, meaning)),
i AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS niin, code AS aac, meaning FROM part LEFT JOIN codes ON i = p_partkey % 16),
r AS (SELECT old, array_to_string(list_sort(list(DISTINCT new))[1:6], ' | ') AS replaced_by FROM links GROUP BY old), s AS (SELECT new, array_to_string(list_sort(list(DISTINCT old))[1:6], ' | ') AS replaces FROM links GROUP BY new)
SELECT niin, aac, replaced_by, replaces, CASE WHEN replaced_by IS NOT NULL THEN 'obsolete' ELSE coalesce(meaning, 'unknown') END AS state FROM i LEFT JOIN r ON old = niin LEFT JOIN s ON new = niin""")
def _(spark, sf):
    codes_ = F.element_at(F.array(*map(F.lit, "BCDGHJKLOVYZX"), *[F.lit(None).cast("string")] * 3), (F.col("p_partkey") % 16 + 1).cast("int"))
    items = b.read(spark, sf, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("niin"), codes_.alias("aac"))
    # a later code of the same item, and an empty one before it, don't count
    rows = items.select("niin", F.explode(F.array(F.struct(F.lit("").alias("aac"), F.lit(1).alias("place")), F.struct(F.col("aac").alias("aac"), F.lit(2).alias("place")), F.struct(F.when(F.col("aac").isNotNull(), "D").alias("aac"), F.lit(3).alias("place")))).alias("r")).select("niin", "r.aac", "r.place")
    return k.obsolescence(rows, links(spark, sf))


@query("d32_name_clashes", "SELECT lower(p_name) AS name, count(DISTINCT p_type) AS n_classes FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def _(spark, sf):
    return k.name_clashes(b.read(spark, sf, "part").selectExpr("p_type AS class", "p_name AS name"))


@query("d33_technical_documents", "SELECT l_partkey AS niin, CASE WHEN l_suppkey % 4 = 0 THEN ' ' ELSE 'D' || (l_suppkey % 10)::VARCHAR END AS document, arg_min(l_returnflag, (l_orderkey * 10 + l_linenumber) * 3 + ascii(l_returnflag) % 3) AS phrase FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1, 2")
def _(spark, sf):
    rows = b.read(spark, sf, "lineitem").selectExpr("l_partkey AS niin", "CASE WHEN l_suppkey % 4 = 0 THEN ' ' ELSE concat('D', l_suppkey % 10) END AS document", "l_returnflag AS phrase", "(l_orderkey * 10 + l_linenumber) * 3 + ascii(l_returnflag) % 3 AS at")
    return k.technical_documents(rows)


@query("d34_table_counts", "SELECT 'part' AS \"table\", count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def _(spark, sf):
    return k.table_counts({t: b.read(spark, sf, t) for t in ("part", "supplier", "lineitem")})


@query("d36_memberships", "WITH h AS (SELECT l_returnflag || l_linestatus AS slug, l_orderkey AS doc_id FROM lineitem), n AS (SELECT slug, count(DISTINCT doc_id) AS n FROM h GROUP BY slug) SELECT slug, least(n, 2000) AS n, n >= 2000 AS capped, CASE WHEN n >= 2000 THEN 0 ELSE greatest(0, n - coalesce(n_seen, 0)) END::BIGINT AS n_new FROM n LEFT JOIN (VALUES ('AF', 100), ('NO', 5)) s(slug, n_seen) USING (slug)")
def _(spark, sf):
    hits = b.read(spark, sf, "lineitem").selectExpr("concat(l_returnflag, l_linestatus) AS slug", "l_orderkey AS doc_id")
    return k.memberships(hits, spark.createDataFrame([("AF", 100), ("NO", 5)], "slug string, n_seen long"))


@query("d38_digest", b.with_(b.LOG) + ", c AS (SELECT count(*) FILTER (kind = 'view') AS reviews, count(*) FILTER (kind = 'click') AS notes, count(*) FILTER (kind = 'error') AS conflicts FROM log WHERE ts >= TIMESTAMP '2024-01-30') SELECT *, CASE WHEN conflicts > 0 THEN 'red' WHEN reviews + notes > 0 THEN 'amber' ELSE 'green' END AS priority FROM c")
def _(spark, sf):
    recent = b.log(spark, sf).where(F.col("ts") >= F.lit("2024-01-30").cast("timestamp"))
    return k.digest(*[recent.where(F.col("kind") == x) for x in ("view", "click", "error")])


@query("d45_missing_files", "WITH f AS (SELECT doc_id, 'p' || doc_id::VARCHAR AS path, doc_id % 7 = 0 AS gone FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 600)) SELECT count(*) AS checked, count(*) FILTER (gone) AS missing, array_to_string(list_sort(list(path) FILTER (gone))[1:12], ',') AS sample FROM f")
def _(spark, sf):
    docs = b.read(spark, sf, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"))
    return k.missing_files(docs, docs.where("doc_id % 7 <> 0"))


@query("i10_one_time_use", "SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'Discard the ' || p_name || '.' ELSE 'This is a torque-to-yield bolt.' END AS sentence, CASE p_partkey % 3 WHEN 0 THEN 'do not reuse' ELSE 'torque-to-yield' END AS kind FROM part WHERE p_partkey % 3 < 2")
def _(spark, sf):
    text = F.expr("concat('Open the cover. ', CASE p_partkey % 3 WHEN 0 THEN concat('Discard the ', p_name, '.') WHEN 1 THEN 'This is a torque-to-yield bolt.' ELSE 'Close it.' END, ' Done.')")
    return k.one_time_use(b.read(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("body_text")))


@query("i14_torque_sequence", "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'star' ELSE 'crisscross' END AS pattern, p_size::VARCHAR || ',' || (p_size + 10)::VARCHAR AS stages, p_size % 8 + 2 AS bolts FROM part")
def _(spark, sf):
    text = F.expr("concat('Tighten the ', p_size % 8 + 2, ' bolts in a ', CASE p_partkey % 2 WHEN 0 THEN 'star' ELSE 'criss-cross' END, ' pattern to ', p_size, ' ft-lb, then ', p_size + 10, ' ft-lb.')")
    got = b.read(spark, sf, "part").select("p_partkey", k.torque_sequence(text).alias("s"))
    return got.select("p_partkey", "s.pattern", F.array_join(F.transform("s.stages", lambda x: x.cast("int").cast("string")), ",").alias("stages"), "s.bolts")


@query("i30_consumables", "SELECT DISTINCT l_orderkey AS doc_id, CASE l_partkey % 3 WHEN 0 THEN 'antiseize' WHEN 1 THEN 'grease' ELSE 'oil' END AS term FROM lineitem")
def _(spark, sf):
    text = F.expr("CASE l_partkey % 3 WHEN 0 THEN 'Apply Anti-Seize.' WHEN 1 THEN 'Use grease or greasepaint' ELSE 'boil the oil' END")
    return k.consumables(b.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), text.alias("body_text"))).distinct()


@query("j5_sampled_text", "SELECT doc_id, substr(array_to_string(string_split(text, chr(10))[1:5], chr(10)), 1, 20000) AS text FROM documents")
def _(spark, sf):
    return k.sampled_text(b.pages(spark, sf))


def wires(spark, sf):
    """Drawings of a few wires: ends on a grid of a twentieth, some of them 0.005 or 0.01 off it, so that ends nearly meet and wires end on others."""
    off = lambda c: f"({c} % 3) * 5"
    return b.read(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS page", f"((l_partkey % 7) * 50 + {off('l_suppkey')}) / 1000.0D AS x1", "((l_suppkey % 5) * 50) / 1000.0D AS y1",
        f"((l_partkey % 7) * 50 * (l_linenumber % 2) + {off('l_partkey')}) / 1000.0D AS x2", "((l_suppkey % 5) * 50 * ((l_linenumber + 1) % 2)) / 1000.0D AS y2")


WIRES = """s AS (SELECT row_number() OVER () AS w, l_orderkey AS page, ((l_partkey % 7) * 50 + (l_suppkey % 3) * 5)::BIGINT AS x1, ((l_suppkey % 5) * 50)::BIGINT AS y1, ((l_partkey % 7) * 50 * (l_linenumber % 2) + (l_partkey % 3) * 5)::BIGINT AS x2, ((l_suppkey % 5) * 50 * ((l_linenumber + 1) % 2))::BIGINT AS y2 FROM lineitem),
wires AS (SELECT * FROM s WHERE x1 <> x2 OR y1 <> y2),
p AS (SELECT page, x1 AS x, y1 AS y FROM wires UNION SELECT page, x2, y2 FROM wires),
near AS (SELECT a.page, a.x AS ax, a.y AS ay, b.x AS ox, b.y AS oy FROM p a JOIN p b ON a.page = b.page AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 49),
same AS (SELECT page, ax, ay, ox, oy FROM near UNION SELECT same.page, same.ax, same.ay, near.ox, near.oy FROM same JOIN near ON same.page = near.page AND same.ox = near.ax AND same.oy = near.ay),
node AS (SELECT page, ax AS x, ay AS y, min(ox * 100000 + oy) AS n FROM same GROUP BY ALL),
known AS (SELECT wires.*, a.n AS a, b.n AS b FROM wires JOIN node a ON a.page = wires.page AND a.x = x1 AND a.y = y1 JOIN node b ON b.page = wires.page AND b.x = x2 AND b.y = y2 WHERE a.n <> b.n),
spot AS (SELECT DISTINCT page, n, n // 100000 AS x, n % 100000 AS y FROM node),
tap AS (SELECT w, n, t FROM (SELECT w, n, x1, y1, x2, y2, x, y, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2) AS t FROM known JOIN spot USING (page) WHERE n <> a AND n <> b)
  WHERE t > 0.02 AND t < 0.98 AND (x1 + t * (x2 - x1) - x) ** 2 + (y1 + t * (y2 - y1) - y) ** 2 <= 49),
stop AS (SELECT page, w, a AS n, -1.0 AS t FROM known UNION ALL SELECT page, w, b, 2.0 FROM known UNION ALL SELECT page, w, n, t FROM tap JOIN known USING (w)),
hop AS (SELECT page, n AS a, lead(n) OVER (PARTITION BY w ORDER BY t) AS b FROM stop),
edge AS (SELECT page, a, b FROM hop WHERE a <> b),
ways AS (SELECT page, a, b FROM edge UNION SELECT page, b, a FROM edge),
reach AS (SELECT page, a, b FROM ways UNION SELECT r.page, r.a, e.b FROM reach r JOIN ways e ON r.page = e.page AND r.b = e.a),
net AS (SELECT page, a, min(b) AS net FROM (SELECT page, a, b FROM reach UNION SELECT page, a, a FROM ways) GROUP BY ALL)"""


@query("j11_netlist", f"WITH RECURSIVE {WIRES}, sizes AS (SELECT page, net, count(*) AS n_nodes FROM net GROUP BY ALL) SELECT page, n_nodes, count(*) AS n_edges FROM edge JOIN net USING (page, a) JOIN sizes USING (page, net) GROUP BY page, net, n_nodes")
def _(spark, sf):
    return drawings.netlist(wires(spark, sf))[0].drop("net")


@query("j11_confidence", f"""WITH RECURSIVE {WIRES}, degree AS (SELECT page, n, count(*) AS d FROM (SELECT page, a AS n FROM edge UNION ALL SELECT page, b FROM edge) GROUP BY ALL),
e AS (SELECT edge.page, count(*) AS n_edges, count(*) FILTER (x.d >= 2 AND y.d >= 2) AS going FROM edge JOIN degree x ON x.page = edge.page AND x.n = edge.a JOIN degree y ON y.page = edge.page AND y.n = edge.b GROUP BY ALL),
j AS (SELECT page, count(*) FILTER (d >= 3) AS n_junctions FROM degree GROUP BY page), k AS (SELECT page, count(DISTINCT net) AS n_nets FROM net GROUP BY page),
l AS (SELECT l_orderkey AS page, count(*) FILTER (l_returnflag <> 'N') AS n_labels FROM lineitem GROUP BY ALL),
c AS (SELECT page, n_segments, n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(going, 0) AS going, coalesce(n_nets, 0) AS n_nets, coalesce(n_junctions, 0) AS n_junctions, coalesce(n_labels, 0) AS n_labels
  FROM (SELECT page, count(*) AS n_segments FROM wires GROUP BY page) JOIN (SELECT page, count(*) AS n_nodes FROM spot GROUP BY page) USING (page) LEFT JOIN e USING (page) LEFT JOIN j USING (page) LEFT JOIN k USING (page) LEFT JOIN l USING (page))
SELECT page, n_segments, n_nodes, n_edges, n_nets, n_junctions, n_labels, CASE WHEN n_edges = 0 THEN 0.0 ELSE round(least(0.97, 0.5 * going / n_edges + 0.2 * least(1.0, n_junctions / 8) + 0.18 * least(1.0, n_labels / 8) + CASE WHEN n_nets BETWEEN 1 AND 200 THEN 0.12 ELSE 0 END), 6) END::DOUBLE AS confidence FROM c""")
def _(spark, sf):
    labels = b.read(spark, sf, "lineitem").selectExpr("l_orderkey AS page", "CASE WHEN l_returnflag = 'N' THEN 'note 1' ELSE concat(' r', l_linenumber, lower(l_returnflag)) END AS text")
    return drawings.netlist(wires(spark, sf), labels, digits=6)[1]


@query("m9_orphans", "SELECT l_orderkey AS doc_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM documents)")
def _(spark, sf):
    return k.orphans(b.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber"), b.read(spark, sf, "documents"))


@query("m10_fill_gaps", b.with_(b.FACTS) + """SELECT e.niin, e.type, e.value, 'external' AS source FROM (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS niin, 'length' AS type, p_size::DOUBLE AS value FROM part) e
WHERE e.niin IN (SELECT niin FROM facts) AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.niin = e.niin AND f.type = e.type)""")
def _(spark, sf):
    ext = b.read(spark, sf, "part").selectExpr("lpad(cast(p_partkey as string), 9, '0') AS niin", "'length' AS type", "cast(p_size as double) AS value")
    return k.fill_gaps(facts.gaps(facts.measurements(b.manual(spark, sf))), ext)
