"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " role ": " body "</turn>" newline
    role, body   := (plain | "\\" any)*

Each turn is rendered as it is, parsed again by a deterministic parser and compared with its source.
Where the parse differs, its conflicting content (escape signs, turn marks and, in a role, the end of
the role) is escaped and it is parsed again; the escaped form is always read back identical, and a
turn that isn't raises an error. The output has one row a turn, so no conversation is ever held as
one value; a conversation's text is its pieces in order, nothing between.

Turns are rendered where they lie. Only the digest of a whole conversation needs its turns in order:
they stream through one task, sorted, one turn in memory at a time, however long the conversation.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own; turns with
equal numbers follow each other by role, then text, and repeated rows are repeated turns; an empty
table gives an empty result; columns besides conv_id, turn, role and text aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
LEARNT = "assistant"
_CONFLICT = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ROLE_CONFLICT = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: One turn of the grammar; possessive, so there is one parse or none.
_TURN = re.compile(r"### ((?:[^\\#<:]++|\\.)*+): ((?:[^\\#<]++|\\.|#(?!##)|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str, escaped: bool) -> tuple[str, int, int]:
    """The piece of a turn, and where its body begins and ends in it."""
    if escaped:
        role, text = _ROLE_CONFLICT.sub(r"\\\g<0>", role), _CONFLICT.sub(r"\\\g<0>", text)
    head = f"{OPEN}{role}{COLON}"
    return f"{head}{text}{CLOSE}", len(head), len(head) + len(text)


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The turns (role, text) of a formatted text; None for what the grammar doesn't have."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            return None
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int, bool]:
    """The first rendering that is read back identical: as it is, else escaped."""
    for escaped in (False, True):
        piece, a, b = render(role, text, escaped)
        if parse(piece) == [(role, text)]:
            return piece, a, b, escaped
    raise ValueError("a turn can't be read back")


def _format_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [format_turn(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        learnt = [(r or "") == LEARNT for r in batch.column("role").to_pylist()]
        columns = [batch.column("conv_id"), batch.column("turn"), pa.array([m[0] for m in made], pa.string())]
        columns += [pa.array([m[i] if x else None for m, x in zip(made, learnt, strict=True)], pa.int32()) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([m[3] for m in made], pa.bool_())], ["conv_id", "turn", "piece", "loss_start", "loss_end", "escaped"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, piece, loss_start, loss_end, escaped: one row a turn.

    loss_start and loss_end are code points in the piece, set for assistant turns: the loss mask."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.mapInArrow(_format_rows, "conv_id long, turn long, piece string, loss_start int, loss_end int, escaped boolean")


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one row a conversation, read back from the pieces alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now: tuple = ()
    n = loss = chars = 0
    said, learnt = hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        out: list[tuple] = []
        for conv, piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
            if (conv,) != now:
                if now:
                    out.append((now[0], n, said.hexdigest(), loss, learnt.hexdigest(), chars))
                now, n, loss, chars, said, learnt = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            turns = parse(piece)
            if turns is None:
                raise ValueError("a piece isn't in the grammar")
            for role, text in turns:
                n += 1
                said.update(f"{role}\n{text}\n".encode())
            chars += len(piece)
            if a is not None:
                under = unescape(piece[a:b])
                loss += len(under)
                learnt.update(under.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now[0], n, said.hexdigest(), loss, learnt.hexdigest(), chars), types, strict=True)], names)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from format_chats' rows."""
    # turns with equal numbers sort by role, then text, as the source would; the keys are cut from the pieces only where two are equal
    head = r"^### ([^\\#<:]*+(?:\\.[^\\#<:]*+)*+): "
    plain = lambda c: F.regexp_replace(c, r"(?s)\\(.)", "$1")
    role = plain(F.regexp_extract("piece", "(?s)" + head, 1))
    text = plain(F.regexp_extract("piece", "(?s)" + head + r"(.*)</turn>\n$", 2))
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", role, text)
    return dealt.mapInArrow(_digest_rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
