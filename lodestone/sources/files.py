"""Readers and writers of a document corpus and its reference extracts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestone.functions import codes
from lodestone.sources.scratch import materialize

HEAD = 65536


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """A1: files below root: path, size, mtime, vehicle (first folder below root)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    below = F.regexp_extract("path", rf"{root.rstrip('/').split('/')[-1]}/([^/]+)/", 1)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), below.alias("vehicle"))


def changed(now: DataFrame, known: DataFrame) -> DataFrame:
    """A1: files that are new, or whose size or time changed, with what happened."""
    fresh = now.join(known.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
    seen = known.select("path").distinct().withColumn("seen", F.lit(True))
    return fresh.join(seen, "path", "left").withColumn("state", F.when(F.col("seen"), "updated").otherwise("new")).drop("seen")


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """A2: size, time and a digest of the first 64 KB, in one string."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    digest = F.substring(F.md5(F.substring("content", 1, HEAD)), 1, 12)
    return files.select("path", F.concat_ws(":", F.col("length").cast("string"), F.unix_timestamp("modificationTime").cast("string"), digest).alias("fingerprint"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Path and sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def texts(spark: SparkSession, root: str, text_cap: int = 2_000_000, html_cap: int = 5_000_000) -> DataFrame:
    """A4: one page a text or HTML file, capped; HTML is reduced to its text."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).withColumn("path", F.input_file_name())
    html = F.lower("path").rlike(r"\.html?$")
    body = F.when(html, codes.strip_html(F.substring("value", 1, html_cap))).otherwise(F.substring("value", 1, text_cap))
    return files.select("path", F.lit(1).alias("page_number"), body.alias("body_text"))


def flexible_csv(spark: SparkSession, path: str, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each field is the first non-empty of its header spellings; a field without any is null."""
    raw = spark.read.csv(path, header=True)
    have = {c.strip().lower(): c for c in raw.columns}

    def pick(names: Sequence[str]) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{have[n.lower()]}`")), F.lit("")) for n in names if n.lower() in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return raw.select(*[pick(names).alias(field) for field, names in fields.items()])


def positional_csv(spark: SparkSession, path: str, columns: Mapping[str, int], niin: str | None = None, sample: int | None = None) -> DataFrame:
    """A headed CSV by column position, trimmed; `niin` names a column to bring to nine digits."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
    out = raw.select(*[F.trim(F.col(f"`{raw.columns[i]}`")).alias(name) for name, i in columns.items()])
    if niin:
        out = out.withColumn(niin, F.lpad(F.right(codes.digits(F.col(niin)), F.lit(9)), 9, "0"))
    return out.limit(sample) if sample else out


def code_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a code in the first five characters (four or more, a letter first) and a name; the first of a code wins."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim(F.substring("value", 1, 5)).alias("code"), F.substring("value", 6, 1_000_000).alias("rest"))
    name = F.get(F.filter(F.split("rest", r"\s{2,}"), lambda x: F.trim(x) != ""), F.lit(0))
    good = lines.withColumn("name", F.trim(name)).where(F.col("code").rlike("^[A-Za-z].{3,4}$") & F.col("name").isNotNull())
    return good.groupBy("code").agg(F.min_by("name", "at").alias("name"))


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {t, k, q, doc}; malformed lines are skipped."""
    return spark.read.schema("t double, k string, q string, doc long").json(path, mode="DROPMALFORMED").where("t IS NOT NULL AND k IS NOT NULL")


def alias_map(spark: SparkSession, path: str) -> DataFrame:
    """A10: groups of terms from JSON files {"groups": [[...]]} to term -> the other terms of its groups."""
    groups = spark.read.json(path, multiLine=True).select(F.explode("groups").alias("g")).select(F.array_distinct(F.transform("g", lambda x: F.lower(F.trim(x)))).alias("g"))
    pairs = groups.select("g", F.explode("g").alias("term")).select("term", F.explode(F.array_except("g", F.array("term"))).alias("other"))
    return pairs.groupBy("term").agg(F.array_sort(F.collect_set("other")).alias("others"))


POINTER = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _at(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that a published table points to; None before the first."""
    fs, _ = _fs(spark, path)
    pointer = _at(spark, path, POINTER)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return f"{path}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def publish(df: DataFrame, path: str, keep: int = 1) -> str:
    """Full rebuild: a new version in a folder of its own, then one file that names it is replaced.

    The rename of that file is the only step that readers can see, and it replaces the old one at once: at any time read_published()
    gives a whole table. Older versions but the last `keep` go afterwards, so that readers that have begun can end. Jobs that fail before
    leave a folder that nothing names."""
    spark = df.sparkSession
    path = path.rstrip("/")
    was = current(spark, path)
    name = f"v{(int(was.rpartition('/v')[2].partition('-')[0]) if was else 0) + 1:08d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    fs, _ = _fs(spark, path)
    fresh, pointer = _at(spark, path, f"{POINTER}.{uuid.uuid4().hex}"), _at(spark, path, POINTER)
    stream = fs.create(fresh, True)
    stream.write(bytearray(name.encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, pointer, options)
    versions = sorted(f.getPath().getName() for f in fs.listStatus(_at(spark, path)) if f.isDirectory() and f.getPath().getName() <= name)
    for old in versions[: -1 - keep]:
        fs.delete(_at(spark, path, old), True)
    return f"{path}/{name}"


def read_published(spark: SparkSession, path: str) -> DataFrame:
    found = current(spark, path.rstrip("/"))
    if found is None:
        raise FileNotFoundError(f"{path} has no published version")
    return spark.read.parquet(found)


def rebuild(documents: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, buckets: int = 64) -> DataFrame:
    """Only the documents whose page count has changed, or that are new, are built again; the rows of all others are carried over, but for
    documents that are gone. The result is published as a new version, with what was done beside it; returns the documents built.

    documents: doc_id, n_pages and what build needs; build gives rows with doc_id. A job that fails between the two publications builds the same documents again."""
    spark = documents.sparkSession
    path = path.rstrip("/")
    done_at = f"{path}/done"
    sizes = documents.select("doc_id", "n_pages")
    fresh = documents if current(spark, done_at) is None else to_build(documents, read_published(spark, done_at))
    # what is built is decided once, before the versions that it is decided by change
    built = materialize(fresh.select("doc_id", "n_pages"), "built")
    rows = build(documents.join(built.select("doc_id"), "doc_id", "left_semi"))
    if current(spark, f"{path}/rows") is not None:
        old = read_published(spark, f"{path}/rows")
        kept = old.join(sizes.join(built.select("doc_id"), "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi")
        rows = kept.unionByName(rows.select(*old.columns))
    publish(rows.repartition(buckets, "doc_id"), f"{path}/rows")
    publish(sizes, done_at)
    return built


def rollback(spark: SparkSession, derived: list[str], confirm: bool = False) -> DataFrame:
    """M8: derived tables with their rows (null where there is none); dropped only where confirmed. No other table is touched."""
    there = [t for t in derived if spark.catalog.tableExists(t)]
    counts = [(t, spark.table(t).count() if t in there else None, confirm and t in there) for t in derived]
    for t in there if confirm else []:
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    return spark.createDataFrame(counts, "name string, n long, dropped boolean")


def to_build(documents: DataFrame, done: DataFrame) -> DataFrame:
    """Documents whose page count isn't the one recorded at their last build."""
    return documents.join(done.select("doc_id", "n_pages"), ["doc_id", "n_pages"], "left_anti")


def write_buckets(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Rows by bucket of their document; only the buckets that occur are replaced."""
    rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_markdown(master: DataFrame, path: str) -> None:
    """A consolidated table as Markdown lines, ordered."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in master.columns]), F.lit(" |"))
    master.orderBy(*master.columns[:3]).select(line.alias("value")).write.mode("overwrite").text(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def xml_modules(spark: SparkSession, path: str, row_tag: str = "dmodule") -> DataFrame:
    """Data modules: title, code, warnings, cautions, notes and steps."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema("title string, dmCode string, warning array<string>, caution array<string>, note array<string>, step array<string>").load(path)
    empty = F.array().cast("array<string>")
    return raw.select("title", F.col("dmCode").alias("code"), *[F.coalesce(c, empty).alias(f"{c}s") for c in ("warning", "caution", "note", "step")])


def last_of(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key by order."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("n_ = 1").drop("n_")
