"""URL filters by a temporal join with dated lists.

A list of blocked (or allowed) patterns changes over time: dated entries add a pattern to a list or
take it off. Each pattern's entries become validity intervals [valid_from, valid_to), and a capture
is judged by the entries that were active when it was fetched, not by today's list.

A pattern is a host (with all hosts below it) or a host with a path prefix. A capture meets only the
few patterns it can match by equality: every parent of its host, alone and with every leading part of
its path. The interval is the rest of the join condition. Among active entries that match, the longest
pattern decides; of equal ones, allow wins. A pattern's entries are as few as its list has changes.

Defined cases: a null or malformed url, or a null fetch time, matches nothing and is kept; of entries
with equal pattern and time the last by action (remove over add) holds; a second add while active, and
a removal of what isn't there, change nothing that a capture sees; entries with a null pattern or time
are ignored; repeated captures are each judged; other columns of the captures are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.common import spare


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without user, port and leading www.; empty where there is none."""
    bare = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(bare, r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def patterns_of(url: Column) -> Column:
    """Every pattern a url can match: each parent of its host, alone and with each leading part of its path."""
    labels = F.split(host_of(url), r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    tails = F.concat(F.array(F.lit("")), paths)
    every = F.flatten(F.transform(hosts, lambda h: F.transform(tails, lambda p: F.concat(h, p))))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def validity(entries: DataFrame) -> DataFrame:
    """(list, pattern, verdict, action, at) to list, pattern, verdict, valid_from, valid_to (null: still valid)."""
    known = entries.where(F.col("pattern").isNotNull() & F.col("at").isNotNull())
    last = known.groupBy("list", "pattern", "verdict", "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "pattern", "verdict").orderBy("at")
    return last.withColumn("valid_to", F.lead("at").over(order)).where("action = 'add'").select("list", "pattern", "verdict", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """captures with `pattern` (the entry that decides, null for none), `verdict` and `kept` added; where captures has such
    a column, the added one's name ends in underscores.

    `entries`: list, pattern, verdict ('block' or 'allow'), action ('add' or 'remove') and at."""
    spans = validity(entries).select("pattern", "verdict", "valid_from", "valid_to")
    # distinct (url, time) pairs are judged, so copies of one capture cost one row
    asked = captures.select(F.col(url).alias("u"), F.col(fetched).alias("f")).where("u IS NOT NULL AND f IS NOT NULL").distinct()
    keys = asked.select("u", "f", F.explode(patterns_of(F.col("u"))).alias("key"))
    active = keys.join(spans, (F.col("key") == F.col("pattern")) & (F.col("f") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("f") < F.col("valid_to"))))
    best = F.max(F.struct(F.length("pattern").alias("n"), (F.col("verdict") == "allow").alias("allow"), F.col("pattern").alias("pattern"), F.col("verdict").alias("verdict")))
    u, f, b = (spare(captures, x) for x in ("url_u", "url_f", "url_best"))
    decided = active.groupBy(F.col("u").alias(u), F.col("f").alias(f)).agg(best.alias(b))
    met = captures.join(decided, (F.col(url) == F.col(u)) & (F.col(fetched) == F.col(f)), "left")
    kept = F.coalesce(F.col(f"{b}.verdict") != "block", F.lit(True))
    return met.select(*captures.columns, F.col(f"{b}.pattern").alias(spare(captures, "pattern")), F.col(f"{b}.verdict").alias(spare(captures, "verdict")), kept.alias(spare(captures, "kept")))


def capture_table(pages: DataFrame) -> DataFrame:
    """pages with a fetch day derived from the url, for tables that have none."""
    day = F.conv(F.substring(F.md5("url"), 1, 4), 16, 10).cast("int") % 365
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries derived from the hosts of pages: a host is blocked from a day on, off the list 90 days later,
    on it again after 200; some of its first path parts are allowed all along. Both follow from a digest of the name."""
    host = host_of(F.col("url"))
    first = F.regexp_extract(path_of(F.col("url")), r"^(/[^/]+)", 1)
    names = pages.select(host.alias("h"), first.alias("p")).where("h <> ''")
    code = lambda c: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int")
    base = F.lit("2024-01-01").cast("date")
    hosts = names.select("h").distinct().withColumn("n", code("h")).where("n % 3 = 0")
    moved = hosts.select("h", "n", F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(d).alias("after")) for a, d in (("add", 0), ("remove", 90), ("add", 200))])).alias("e"))
    blocks = moved.select(F.lit("hosts").alias("list"), F.col("h").alias("pattern"), F.lit("block").alias("verdict"), F.col("e.action").alias("action"), F.date_add(base, (F.col("n") % 150 + F.col("e.after")).cast("int")).alias("at"))
    paths = names.where("p <> ''").select(F.concat("h", "p").alias("pattern")).distinct().where(code("pattern") % 7 == 0)
    allows = paths.select(F.lit("paths").alias("list"), "pattern", F.lit("allow").alias("verdict"), F.lit("add").alias("action"), base.alias("at"))
    return blocks.unionByName(allows)
