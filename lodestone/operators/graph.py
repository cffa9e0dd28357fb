"""Graph jobs: connected components by alternating large and small stars."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the session names; one of this machine's only where none is named and Spark runs on it alone, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Undirected edges (a, b) to (node, component), component being the smallest node reachable.

    Each round links every larger neighbour of a node to its smallest one (large star), then every
    smaller neighbour (small star), until the edges form stars. Rounds grow with the logarithm of
    the longest path. Minima are aggregated before the shuffle, so hubs are no hot spot, and each
    round ends in a table that replaces the last one's. Self loops give a component of one node; rows with a null are left out.
    An answer that isn't final after max_rounds is an error.
    """
    from lodestone.sources.scratch import discard, materialize  # it uses ensure_checkpoint_dir of this module

    pairs = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL"), "pairs")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    now = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "stars")
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        made = materialize(small.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "stars")
        discard(now)
        now = made
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components aren't found after {max_rounds} rounds")
    return nodes.join(now, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))


def block_key(number):
    """A manual number without its trailing two-digit part."""
    return F.regexp_replace(F.upper(F.trim(number)), r"-\d{2}$", "")


def triples(parts: DataFrame, documents: DataFrame) -> DataFrame:
    """Typed edges of the knowledge graph: documents, vehicles, figures and stock numbers."""
    part = parts.select(F.lit("part").alias("src_type"), F.col("nsn").alias("src"), F.lit("used on").alias("rel"), F.lit("vehicle").alias("dst_type"), F.col("vehicle").alias("dst"))
    fig = parts.select(F.lit("part"), "nsn", F.lit("shown in"), F.lit("figure"), F.concat_ws("/", F.col("document_id").cast("string"), F.col("fig_no").cast("string")))
    doc = documents.select(F.lit("document"), F.col("doc_id").cast("string"), F.lit("belongs to"), F.lit("vehicle"), "source")
    return part.union(fig).union(doc)


def stated_edges(found: DataFrame) -> DataFrame:
    """Edges with node keys type|label, as often as they are stated."""
    key = lambda t, c: F.concat_ws("|", t, F.lower(c))
    return found.select(key("src_type", "src").alias("src"), "rel", key("dst_type", "dst").alias("dst"))


def graph_edges(found: DataFrame) -> DataFrame:
    """Distinct edges with node keys type|label."""
    return stated_edges(found).distinct()


def graph_statistics(edges: DataFrame) -> DataFrame:
    """Nodes by type, and their edges."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    per = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return per.groupBy(F.substring_index("node", "|", 1).alias("type")).agg(F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("ends"), F.max("degree").alias("max_degree"))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges out of and into the asked nodes, each once; edges may be stated often, and are read once. `nodes`: node."""
    from lodestone.sources.scratch import small  # it uses ensure_checkpoint_dir of this module

    ends = F.array(F.struct(F.col("src").alias("end"), F.col("dst").alias("other"), F.lit("out").alias("way")), F.struct(F.col("dst").alias("end"), F.col("src").alias("other"), F.lit("in").alias("way")))
    met = edges.select("rel", F.inline(ends)).join(small(nodes.select("node").distinct(), "nodes"), F.col("end") == F.col("node"))
    return met.select("node", "rel", "other", "way").distinct()


def find_nodes(nodes: DataFrame, asked: DataFrame, most: int = 20) -> DataFrame:
    """Q, node, how: the nodes that a question names: those of that label (exact), else those whose label begins with it (prefix), else
    those that have it inside (substring); the first `most` by label and node. nodes: node, label, as often as they are stated; asked: q.

    A label meets the questions that begin with one of its pieces of three characters, in its row; only nodes that hold a question are exchanged."""
    from lodestone.sources.scratch import small  # it uses ensure_checkpoint_dir of this module

    want = small(asked.select(F.lower("q").alias("q")).where("q <> ''").distinct().withColumn("piece", F.substring("q", 1, 3)), "asked")
    sizes = sorted(r[0] for r in want.select(F.length("piece")).distinct().collect())  # of 1, 2 and 3
    if not sizes:
        return nodes.select(F.lit("").alias("q"), "node", F.lit("").alias("how")).limit(0)
    known = nodes.select("node", F.lower("label").alias("name")).select("node", "name", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    known = known.select("node", "name", "size", F.explode(F.expr("sequence(1, greatest(length(name) - size + 1, 1))")).alias("at")).select("node", "name", F.expr("substr(name, at, size)").alias("piece"))
    how = F.when(F.col("name") == F.col("q"), 1).when(F.startswith("name", "q"), 2).otherwise(3)
    met = known.join(want, "piece").where(F.contains("name", "q")).select("q", "name", "node", how.alias("how")).distinct()
    order = Window.partitionBy("q")
    ranked = met.withColumn("rank", F.row_number().over(order.orderBy("how", "name", "node"))).where(F.col("rank") <= most)
    best = ranked.withColumn("best", F.min("how").over(order)).where("how = best")
    return best.select("q", "node", F.element_at(F.array(*map(F.lit, ("exact", "prefix", "substring"))), F.col("how")).alias("how"))


def nets(pins: DataFrame) -> DataFrame:
    """Pins of one signal, two or more; colours that disagree lower the confidence. pins: document_id, connector, pin, signal, colour."""
    signal = F.upper(F.regexp_replace("signal", r"[\s_-]+", ""))
    per = pins.groupBy("document_id", signal.alias("net")).agg(F.count(F.lit(1)).alias("points"), F.count_distinct("colour").alias("colours"))
    return per.where("points >= 2").withColumn("confidence", F.when(F.col("colours") > 1, 0.6).otherwise(0.9))


def trace(pins: DataFrame, starts: DataFrame) -> DataFrame:
    """Other pins on the nets of given pins. starts: document_id, connector, pin."""
    mine = pins.join(starts, ["document_id", "connector", "pin"]).select("document_id", "signal", F.col("connector").alias("from_connector"), F.col("pin").alias("from_pin"))
    met = mine.join(pins, ["document_id", "signal"])
    return met.where((F.col("connector") != F.col("from_connector")) | (F.col("pin") != F.col("from_pin"))).select("document_id", "from_connector", "from_pin", "connector", "pin")
