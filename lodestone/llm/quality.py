"""Quality rules with a host-level verdict.

Every document gets a few counts, a verdict of each rule and a base verdict. The failures of each rule
are aggregated by host (here the `source` column), and each rule's share of failures is shrunk towards
the share of all hosts by an empirical beta prior, fitted for the rule by the method of moments over
the hosts' own shares, so that a host of three documents isn't condemned by two of them. A host is
rejected with all its documents if any rule's shrunk share is above `host_limit`.

Counting happens inside the row: the 3-word windows of a text are hashed (64 bits, from the three
words) and sorted within the row, so no window is ever shuffled; only one row for each host and
partition is. Windows are compared by hash alone. A row's cost is n log n in its words. The hosts'
verdicts are broadcast when they have been counted to be few; otherwise both sides are exchanged by
host, which adaptive execution splits where one host is hot.

Defined cases: a null text has no words and fails the base rule; a null host is a host of its own;
repeated rows are judged and counted each on their own; with one host, or hosts of equal shares, the
prior is as strong as `flat_prior` documents; an empty table gives an empty result. All that is added
is one struct column with a name of the caller's choice, so no column of the caller's is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.common import BLANKS, spare, words
from lodestone.sources.scratch import frugal, materialize, small

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
HOST_RULES = ("short", "repeats", "symbols")


def _windows(w: str) -> str:
    return f"CASE WHEN size({w}) < 3 THEN array() ELSE transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])) END"


def _covered(t: str) -> str:
    """Words covered by windows whose hash is in t twice or more: the windows sorted by hash, equal neighbours kept."""
    pairs = f"sort_array(transform({t}, (h, i) -> named_struct('h', h, 'i', i)))"
    twice = "filter(s, (x, j) -> (j > 0 AND s[j - 1].h = x.h) OR (j < size(s) - 1 AND s[j + 1].h = x.h))"
    reach = f"flatten(transform(array({pairs}), s -> flatten(transform({twice}, x -> array(x.i, x.i + 1, x.i + 2)))))"
    return f"CASE WHEN size(array_distinct({t})) = size({t}) THEN 0 ELSE size(array_distinct({reach})) END"


def text_counts(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """docs with the struct `into` of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long)."""
    w, t = (spare(docs, x) for x in ("q_words", "q_windows"))
    whole = F.coalesce(F.col(text), F.lit(""))
    # explode of one value: later filters on the counts are not copied down into the array expressions
    kept = docs.select("*", F.explode(F.array(words(F.col(text)))).alias(w))
    kept = kept.select("*", F.explode(F.array(F.expr(_windows(f"`{w}`")))).alias(t))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    values = (F.size(w), F.length(F.translate(whole, BLANKS, "")), F.regexp_count(whole, F.lit("[#*$%&|<>]")), F.size(lines) - F.size(F.array_distinct(lines)), F.expr(_covered(f"`{t}`")))
    made = F.struct(*[v.cast("long").alias(k) for k, v in zip(COUNTS, values, strict=True)])
    return kept.select("*", F.explode(F.array(made)).alias(into)).drop(w, t)


def rule_failures(counts: str, min_words: int = 50, repeat_percent: int = 50, symbol_percent: int = 20) -> dict[str, Column]:
    """Of each rule, whether a document fails it. The first two are the base rules."""
    c = lambda x: F.col(f"{counts}.{x}")
    return {
        "short": c("n_words") < min_words,
        "repeats": 100 * c("n_repeat_words") > repeat_percent * c("n_words"),
        "symbols": 100 * c("n_symbols") > symbol_percent * c("n_words"),
    }


def host_verdicts(failures: DataFrame, flat_prior: float = 10.0, host_limit: float = 0.8) -> DataFrame:
    """(host, a boolean for each rule) to one row a host: host, host_rate (the largest shrunk share of a rule) and host_rejected.

    A rule's beta prior has the mean m and variance v of the hosts' own shares: a + b = m (1 - m) / v - 1."""
    per = failures.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *[F.count_if(F.col(r)).alias(r) for r in HOST_RULES])
    of = lambda r: F.col(r) / F.col("docs")
    spread = per.select(*[F.avg(of(r)).alias(f"{r}_m") for r in HOST_RULES], *[F.var_pop(of(r)).alias(f"{r}_v") for r in HOST_RULES])
    # one row of priors, a scalar beside each host
    made = []
    for r in HOST_RULES:
        m, v = F.col(f"{r}_m"), F.col(f"{r}_v")
        k = F.when((v > 1e-12) & (m * (1 - m) > v), m * (1 - m) / v - 1).otherwise(F.lit(float(flat_prior)))
        made.append(F.struct(m.alias("m"), k.alias("k")).alias(r))
    prior = per.select("*", spread.select(F.struct(*made)).scalar().alias("prior"))
    rate = F.greatest(*[(F.col(r) + F.col(f"prior.{r}.m") * F.col(f"prior.{r}.k")) / (F.col("docs") + F.col(f"prior.{r}.k")) for r in HOST_RULES])
    return prior.select("host", rate.alias("host_rate"), (rate > host_limit).alias("host_rejected"))


def quality_rules(docs: DataFrame, into: str = "quality", host: str = "source", keep: list[str] | None = None, host_limit: float = 0.8, flat_prior: float = 10.0, **limits: int) -> DataFrame:
    """docs with the struct `into` added: the five counts, base_failed, host_rate and kept.

    With `keep`, only those columns of docs go on; the counts are then made once and kept as a narrow table,
    while whole rows are counted again for the second pass rather than copied."""
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {into}")
    frugal(docs.sparkSession)
    counted = text_counts(docs, into)
    if keep is not None:
        counted = materialize(counted.select(*keep, into, *([] if host in keep else [host])), "counts")
    failed = rule_failures(into, **limits)
    hosts = small(host_verdicts(counted.select(F.col(host).alias("host"), *[failed[r].alias(r) for r in HOST_RULES]), flat_prior, host_limit), "hosts")
    key, rate, out = (spare(counted, x) for x in ("q_host", "q_rate", "q_rejected"))
    met = counted.join(hosts.select(F.col("host").alias(key), F.col("host_rate").alias(rate), F.col("host_rejected").alias(out)), F.col(host).eqNullSafe(F.col(key)), "left")
    base = failed["short"] | failed["repeats"]
    made = F.struct(*[F.col(f"{into}.{c}").alias(c) for c in COUNTS], base.alias("base_failed"), F.col(rate).alias("host_rate"), (~base & ~F.col(out)).alias("kept"))
    return met.select(*(docs.columns if keep is None else keep), made.alias(into))
