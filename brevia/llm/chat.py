"""Chat formatting: a finite-state machine over roles that emits text segments with loss flags.

A template is data: how a turn opens and closes, the names of known roles, which roles are learned from, and which role
may follow which. Texts may hold anything; a backslash goes before each backslash, before each number sign that two more
follow, and before each closing mark, so no control string survives inside a text and read() gives the text back.

Defined results: a null text or role counts as empty; turns are ordered by turn (null first), role and text, so ties and
repeated rows keep a fixed order and all of them are formatted; roles the template doesn't name are written escaped after an @
and learned from by none; a conversation whose order breaks the machine is still formatted, with valid false from the first
turn at fault on; a null conv_id is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_batch


@dataclass(frozen=True)
class Template:
    """Declares a chat format. follows maps a state (the last role, None at the start) to the roles allowed next."""

    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    learned: frozenset[str] = frozenset({"assistant"})
    follows: dict[str | None, frozenset[str]] = field(
        default_factory=lambda: {
            None: frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant", "tool"}),
        }
    )


OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
_IN_TEXT = re.compile(r"\\|#(?=##)|</turn>")
_IN_ROLE = re.compile(r"[\\:#<\n]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _IN_TEXT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segments(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    """The segments of a turn, with loss flags: opening, text, closing."""
    name = template.names.get(role) or "@" + _IN_ROLE.sub(lambda m: "\\" + m[0], role)
    return [(OPEN + name + AFTER_ROLE, False), (escape(text), role in template.learned), (CLOSE, False)]


def read(formatted: str, template: Template) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; ValueError if it isn't one."""
    roles = {v: k for k, v in template.names.items()}
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        name = m[1]
        out.append((unescape(name[1:]) if name[0] == "@" else roles[name], unescape(m[2])))
        at = m.end()
    return out


def walk(rows: Iterable[tuple], template: Template) -> Iterator[tuple]:
    """Drives the machine over (conv_id, role, text) in order: (conv_id, turn_no, segment_no, text, loss, valid)."""
    now, state, number, valid = object(), None, 0, True
    for conv, role, text in rows:
        if conv != now:
            now, state, number, valid = conv, None, 0, True
        valid = valid and role in template.follows.get(state, ())
        state = role
        for i, (piece, loss) in enumerate(segments(role, text, template)):
            yield conv, number, i, piece, loss, valid
        number += 1


SEGMENTS = "conv_id long, turn_no long, segment_no int, text string, loss boolean, valid boolean"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
)


def _batches(rows: Iterable[tuple], schema: T.StructType, weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of bounded weight."""
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += weight(r)
        if held > 16_000_000:
            yield arrow_batch(schema, list(zip(*out, strict=True)))
            out, held = [], 0
    if out:
        yield arrow_batch(schema, list(zip(*out, strict=True)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of all conversations, those of one side by side in order in one partition.

    Rows are dealt by conversation and sorted; the machine streams over them with the state of one turn, so a long
    conversation takes time but no memory.
    """
    template, schema = template or Template(), T.StructType.fromDDL(SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((conv, role or "", text or "") for conv, role, text in _rows(batches))
        return _batches(walk(rows, template), schema, lambda s: 100 + len(s[3]))

    order = ["conv_id", "turn", "role", "text"]
    sorted_ = turns.select(*order).repartition("conv_id").sortWithinPartitions(*order)
    return sorted_.select("conv_id", "role", "text").mapInArrow(run, schema)


def summaries(rows: Iterable[tuple], template: Template) -> Iterator[tuple]:
    """Reads formatted segments back, a turn at a time: one row of DIGESTS per conversation."""
    now: object = template
    n = lost = chars = 0
    turns, loss_text, valid, held = hashlib.sha256(), hashlib.sha256(), True, ""
    for conv, _, segment, text, loss, ok in rows:
        if conv != now:
            if now is not template:
                yield now, n, turns.hexdigest(), lost, loss_text.hexdigest(), chars, valid
            now, n, lost, chars = conv, 0, 0, 0
            turns, loss_text, valid, held = hashlib.sha256(), hashlib.sha256(), True, ""
        chars += len(text)
        held += text
        valid = valid and ok
        if loss:
            plain = unescape(text)
            lost += len(plain)
            loss_text.update(plain.encode("utf-8", "surrogatepass"))
        if segment == 2:
            for role, body in read(held, template):
                n += 1
                turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            held = ""
    if now is not template:
        yield now, n, turns.hexdigest(), lost, loss_text.hexdigest(), chars, valid


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads the segments of format_conversations() back and sums each conversation up. No shuffle."""
    template, schema = template or Template(), T.StructType.fromDDL(DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(summaries(_rows(batches), template), schema, lambda s: 1000)

    return formatted.mapInArrow(run, schema)
