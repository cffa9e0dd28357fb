"""Line deduplication over content-defined chunks.

A text's lines with a word are hashed, and a rolling hash goes over every two of them in a row. Chunks are
cut where it isn't above both its neighbours; so where a chunk ends depends on four lines only, and a
block that is moved, or follows inserted lines, is cut as before but for its edges. The text's ends cut too.
Of two windows in a row one is a cut in every text that has both, so no repeated block of three lines or
more is without one; of a block of two lines only that holds if both texts cut there.

1. Cuts are the anchors: each gives its window's hash, its place, and short hashes of the lines from the cut
   before to the cut after. Anchors meet by hash; the smallest doc_id that has one is its first document.
2. A document's anchor is extended line by line, in both directions up to its neighbouring cuts, as far as
   its first document goes on likewise. Where that is the whole way, the next cut is an anchor of that block
   too. Stretches that meet in one first document are one run.
3. The first document's bytes of each run are read in a second join and compared line by line; hashes decide
   nothing alone. Lines that are equal go, two or more in a row.

A window that the text itself has before, without overlap, goes too. The first of all occurrences stays. The
blank lines inside a run belong to its bytes.

Anchors are reduced to their smallest doc_id before the shuffle, and the joins back have plain exchanges on
both sides, so that a line pair in a third of all documents is dealt out.

Defined cases: a null text stays null, an empty one empty; a text without newlines is one line and so
never cut; a row with a null doc_id is unchanged and is nobody's earlier document; rows that repeat a
doc_id are told apart by their texts and don't remove each other's lines; columns besides text (and
n_chars, which follows it) are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.common import spare
from lodestone.llm.tokens import mix, signed
from lodestone.sources.scratch import frugal, materialize

MIN_LINES = 2
#: Texts that are cut at a time.
TEXTS = 256
#: Odd multipliers of the rolling hash.
LINE, GAP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _bounds(raw: bytes) -> list[tuple[int, int, int]]:
    """Of each line with a word: its number, its first byte and the byte after its last."""
    at, out = 0, []
    for i, line in enumerate(raw.split(b"\n")):
        if line.strip():
            out.append((i, at, at + len(line)))
        at += len(line) + 1
    return out


def _hashes(parts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x) for x in parts], np.uint64)


class Cuts:
    """The cuts of a text: `lines` with a word, `windows` of two of them by rolling hash, and `at`, the windows where chunks are cut."""

    def __init__(self, raw: bytes):
        self.lines = _bounds(raw)
        line = _hashes([raw[a:b] for _, a, b in self.lines])
        gap = _hashes([raw[x[2] : y[1]] for x, y in zip(self.lines, self.lines[1:])])
        # a line with what lies between it and the next, and one with what lies before it
        self.before = mix(line[:-1] * LINE + gap * GAP)
        self.after = mix(gap * GAP + line[1:] * LINE + GAP)
        self.windows = mix(self.before * LINE + line[1:])
        w = self.windows
        above = np.zeros(len(w), bool)
        if len(w) > 2:
            above[1:-1] = (w[1:-1] > w[:-2]) & (w[1:-1] > w[2:])
        self.at = np.flatnonzero(~above)

    def near(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each cut the lines before its window, nearest first, from the cut before, and those after it to the cut after."""
        short = lambda x: (x >> np.uint64(32)).astype(np.uint32).view(np.int32)
        before, after = short(self.before), short(self.after)
        ends = [0, *self.at[:-1]], [*self.at[1:], len(self.windows) - 1]
        return [(before[lo:i][::-1], after[i + 1 : hi + 1]) for i, lo, hi in zip(self.at, *ends)]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tkey, text) to one row a cut: its hash, its place, and the lines around it. So many texts at a time as `TEXTS`."""
    for batch in batches:
        for lo in range(0, len(batch), TEXTS):
            yield _anchors(batch.slice(lo, TEXTS))


def _anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, keys, places, found, back, on = [], [], [], [], [], []
    for d, k, t in zip(batch.column("doc_id").to_pylist(), batch.column("tkey").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
        cuts = Cuts(t.as_py() or b"")
        if len(cuts.at):
            near = cuts.near()
            ids += [d] * len(near)
            keys += [k] * len(near)
            places.append(cuts.at)
            found.append(cuts.windows[cuts.at])
            back += [x for x, _ in near]
            on += [x for _, x in near]
    joined = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(joined(places, np.int64).astype(np.int32)), pa.array(signed(joined(found, np.uint64))), _lists(back), _lists(on)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "tkey", "pos", "h", "back", "on"])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, wanted: src_pos and n) to the bytes of those runs of lines."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for d, t, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("wanted").to_pylist(), strict=True):
            raw = t.as_py() or b""
            lines = _bounds(raw)
            for x in wanted:
                last = x["src_pos"] + x["n"] - 1
                if last < len(lines):
                    for column, value in zip(out, (d, x["src_pos"], x["n"], raw[lines[x["src_pos"]][1] : lines[last][2]]), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["src_doc", "src_pos", "n", "body"])


def _equal_lines(raw: bytes, lines: list[tuple[int, int, int]], body: bytes, min_lines: int) -> Iterator[tuple[int, int]]:
    """[first, last] of the stretches of min_lines lines or more of raw that are those of body, with what lies between them."""
    theirs = _bounds(body)
    if raw[lines[0][1] : lines[-1][2]] == body:
        yield 0, len(lines) - 1
        return
    start = 0
    for i in range(1, len(lines) + 1):
        equal = i < min(len(lines), len(theirs)) and raw[lines[i - 1][1] : lines[i][2]] == body[theirs[i - 1][1] : theirs[i][2]]
        if not equal:
            if i - start >= min_lines:
                yield start, i - 1
            start = i


def _run_cutter(min_lines: int):
    """(text or null, runs an earlier document has) to the text without them and without windows that repeat its own, and the lines removed."""

    def cut(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        left, removed = [], []
        for t, found in zip(text, runs, strict=True):
            if t is None:
                left.append(None)
                removed.append(0)
                continue
            raw = t.encode()
            lines, gone, seen = _bounds(raw), set(), {}
            for x in () if found is None else found:
                mine = lines[x["pos"] : x["pos"] + x["n"]]
                for a, b in _equal_lines(raw, mine, x["body"], min_lines) if mine else ():
                    gone.update(range(mine[a][0], mine[b][0] + 1))
            for i in range(len(lines) - min_lines + 1):
                last = i + min_lines - 1
                if seen.setdefault(raw[lines[i][1] : lines[last][2]], i) + min_lines <= i:
                    gone.update(range(lines[i][0], lines[last][0] + 1))
            left.append(t if not gone else b"\n".join(x for i, x in enumerate(raw.split(b"\n")) if i not in gone).decode())
            removed.append(len(gone))
        return pd.DataFrame({"text": left, "removed": np.array(removed, np.int64)})

    return F.pandas_udf(cut, "text string, removed long")


def _alike(a: Column | str, b: Column | str) -> Column:
    """How many numbers two arrays have in common from their beginning."""
    other = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(other == 0, F.size(a)).otherwise(other - 1).cast("int")


def repeated_runs(read: DataFrame) -> DataFrame:
    """doc_id, pos, n, src_doc, src_pos: runs of n lines that a document with a smaller doc_id has, by hash. `read`: doc_id (long, not null), text."""
    anchors = read.withColumn("tkey", F.xxhash64("text")).select("doc_id", "tkey", "text").mapInArrow(_anchor_rows, "doc_id long, tkey long, pos int, h long, back array<int>, on array<int>")
    first = anchors.groupBy("h").agg(F.min(F.struct("doc_id", "pos", "back", "on")).alias("src"), F.max("doc_id").alias("last_doc")).where("src.doc_id < last_doc")
    first = first.select("h", F.shiftrightunsigned("h", 63).alias("part"), F.col("src.doc_id").alias("src_doc"), F.col("src.pos").alias("src_pos"), F.col("src.back").alias("src_back"), F.col("src.on").alias("src_on"))
    met = anchors.withColumn("part", F.shiftrightunsigned("h", 63)).join(first, ["h", "part"]).where(F.col("doc_id") > F.col("src_doc"))
    back, on = _alike("back", "src_back"), _alike("on", "src_on")
    stretches = met.select("doc_id", "tkey", "src_doc", (F.col("src_pos") - F.col("pos")).alias("shift"), (F.col("pos") - back).alias("pos"), (F.col("pos") + MIN_LINES + on).alias("end")).distinct()

    # stretches that meet: a text's lines at one distance from those of one first document
    by = Window.partitionBy("doc_id", "tkey", "src_doc", "shift").orderBy("pos", "end")
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = stretches.withColumn("new", F.when(F.col("pos") <= reached, 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    whole = runs.groupBy("doc_id", "tkey", "src_doc", "shift", "run").agg(F.min("pos").alias("pos"), F.max("end").alias("end"))
    return whole.select("doc_id", "pos", (F.col("end") - F.col("pos")).alias("n"), "src_doc", (F.col("pos") + F.col("shift")).alias("src_pos"))


def run_dedup(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """docs with every repeated run of lines cut out of text; `removed` names a column for the number of lines removed."""
    frugal(docs.sparkSession)
    named = docs.where(F.col("doc_id").isNotNull())
    runs = materialize(repeated_runs(named.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "runs")
    key, lost, made = spare(docs, "dedup_doc"), spare(docs, "dedup_runs"), spare(docs, "dedup_made")
    # one exchange of the texts, for the first documents' bytes and for the cut
    dealt = named.withColumn(key, F.col("doc_id").cast("long")).repartition(key)
    wanted = runs.groupBy(F.col("src_doc").alias("src_")).agg(F.collect_set(F.struct("src_pos", "n")).alias("wanted"))
    first = dealt.join(wanted, F.col(key) == F.col("src_")).select(F.col(key).alias("doc_id"), "text", "wanted").mapInArrow(_first_rows, "src_doc long, src_pos int, n int, body binary").distinct()
    met = runs.join(first, ["src_doc", "src_pos", "n"]).groupBy(F.col("doc_id").alias("met_")).agg(F.collect_list(F.struct("pos", "n", "body")).alias(lost))
    cut = dealt.join(met, F.col(key) == F.col("met_"), "left").withColumn(made, _run_cutter(MIN_LINES)("text", lost))
    cut = cut.withColumn("text", F.col(f"{made}.text")).withColumn(made, F.col(f"{made}.removed"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    rest = docs.where(F.col("doc_id").isNull()).withColumn(made, F.lit(0).cast("long"))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.length("text").cast("long"))
    names = [*docs.columns, *([F.col(made).alias(removed)] if removed else [])]
    return cut.select(*names).union(rest.select(*names))
