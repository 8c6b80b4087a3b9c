"""Conversations as training texts: rendered by a grammar, parsed again, escaped until both agree.

    conversation = turn*
    turn         = "<<SYS>>" body "<</SYS>>"                system
                 | "[INST]" body "[/INST]"                  user
                 | body "</s>"                              assistant
                 | "[ROLE]" body "[/ROLE]" body "</s>"      any other role, by name

A body holds no control string ("<s>" is one too, for tokenizers that know it). The parser reads from left to right and never looks back:
the next control string either is the one the grammar wants or the text is refused.

Every turn is rendered as it is, parsed, and compared with its source. If it is refused or
comes back differently, one backslash goes behind the first character of every control
string in it, and of every one that holds backslashes there already; parsing takes one
away again. This is repeated until the turn comes back identical, which the first escape
achieves: no control string is left, and none begins with what another one ends with, so
none arises where texts and marks meet.

Because turns end by themselves, a formatted conversation is written as parts of whole
turns. One part holds all of a conversation unless it is very long or stands where two
tasks meet; a conversation with a third of all rows is spread over tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barledger.llm.tables import published

CONTROLS = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
END = "</s>"
#: Opening and closing mark of the roles that have their own.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("", END)}
_OPENS = {"<<SYS>>": ("system", "<</SYS>>"), "[INST]": ("user", "[/INST]")}
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_FIRST = "|".join(f"{re.escape(c)}(?=#(?:{'|'.join(re.escape(x[1:]) for x in CONTROLS if x[0] == c)}))" for c in "<[")
_ESCAPABLE = re.compile("(" + _FIRST.replace("#", r"\\*") + ")")
_ESCAPED = re.compile("(" + _FIRST.replace("#", r"\\+") + r")\\")
#: Characters after which a part ends, at the next turn.
PART_CHARS = 1 << 20


class Refused(ValueError):
    """A text outside the grammar."""


def escape(text: str) -> str:
    return _ESCAPABLE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(turn, start and end of the text in it)."""
    if role in MARKS:
        opening, closing = MARKS[role]
    else:
        opening, closing = f"[ROLE]{role}[/ROLE]", END
    return opening + text + closing, len(opening), len(opening) + len(text)


def parse(turns: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn; `Refused` where the grammar is left."""
    at, control = 0, _CONTROL.finditer(turns)

    def body(closing: str) -> str:
        nonlocal at
        found = next(control, None)
        if found is None or found[0] != closing:
            raise Refused(f"{closing} wanted at {at}")
        text, at = turns[at : found.start()], found.end()
        return unescape(text)

    while at < len(turns):
        if turns.startswith("[ROLE]", at):
            at = next(control).end()
            role = body("[/ROLE]")
            yield role, body(END)
            continue
        for opening, (role, closing) in _OPENS.items():
            if turns.startswith(opening, at):
                at = next(control).end()
                yield role, body(closing)
                break
        else:
            yield "assistant", body(END)


def settled(role: str, text: str) -> tuple[str, int, int]:
    """The turn that parses to exactly (role, text), with the place of its text."""
    name, said = role, text
    for _ in range(3):
        turn, start, end = render(name, said)
        try:
            if list(parse(turn)) == [(role, text)]:
                return turn, start, end
        except Refused:
            pass
        name, said = role if role in MARKS else escape(name), escape(said)
    raise Refused(f"no rendering of a {role!r} turn parses to its source")


def _renderer(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        turns, starts, ends = [], [], []
        for role, text in zip(roles, texts):
            turn, start, end = settled(role or "", text or "")
            turns.append(turn)
            starts.append(start if role == "assistant" else None)
            ends.append(end if role == "assistant" else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(turns, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
            names=["conv_id", "turn", "piece", "loss_from", "loss_to"])


_PARTS = "shard int, conv_id long, part int, whole boolean, formatted string, loss_from array<int>, loss_to array<int>"


def _binder(part_chars: int):
    names = [c.split()[0] for c in _PARTS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        # The conversation at hand. The first and the last one of a task may go on in another.
        conv, part, outer, pieces, size, low, high = None, -1, True, [], 0, [], []
        shard = 0

        def close(whole: bool) -> None:
            nonlocal pieces, size, low, high
            done.append((shard, conv, part, whole, "".join(pieces), low, high))
            pieces, size, low, high = [], 0, [], []

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=names)
            done.clear()
            return out

        for batch in found:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for shard, conv_id, piece, start, end in zip(*columns):
                if part < 0 or conv_id != conv:
                    if part >= 0:
                        close(part == 0 and not outer)
                        outer = False
                    conv, part = conv_id, 0
                elif size >= part_chars:
                    close(False)
                    part += 1
                if start is not None:
                    low.append(size + start)
                    high.append(size + end)
                pieces.append(piece)
                size += len(piece)
            if done:
                yield rows()
        if part >= 0:
            close(False)
            yield rows()

    return batches


def write_conversations(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """turns(conv_id, turn, role, text) -> the published parts of formatted conversations.

    A part is (shard, conv_id, part, whole, formatted, loss_from, loss_to): whole turns in
    order, and the places, in code points, of the assistant's texts that a loss counts.
    `whole` says that it holds its conversation; others are put together in the order of
    (shard, part).

    Turns are ordered by turn, nulls first, equal ones by their rendered text; repeated rows
    are turns of their own. A null text is empty, a null role is the role with the empty name, a null
    conv_id is a conversation. Other columns are ignored; an empty table gives no parts.
    """
    pieces = turns.select("conv_id", "turn", "role", "text").mapInArrow(
        _renderer, "conv_id long, turn long, piece string, loss_from int, loss_to int")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "piece")]
    sorted_pieces = (
        pieces.repartitionByRange("conv_id", "turn").sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("shard"), "conv_id", "piece", "loss_from", "loss_to")
    )
    return published(sorted_pieces.mapInArrow(_binder(part_chars), _PARTS), "conversations")


_ROWS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _reader(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations that follow each other -> one row per conversation."""
    names = [c.split()[0] for c in _ROWS.split(", ")]
    kinds = [pa.string() if c.endswith("256") else pa.int64() for c in names]
    held: list | None = None
    done: list[tuple] = []

    def close() -> None:
        conv, n, turns, loss, text, size = held
        done.append((conv, n, turns.hexdigest(), loss, text.hexdigest(), size))

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=names)
        done.clear()
        return out

    for batch in found:
        for conv, formatted, low, high in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if held is None or conv != held[0]:
                if held:
                    close()
                held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                held[1] += 1
                held[2].update(f"{role}\n{text}\n".encode())
            for a, b in zip(low, high):
                text = unescape(formatted[a:b])
                held[3] += len(text)
                held[4].update(text.encode())
            held[5] += len(formatted)
        if done:
            yield rows()
    if held:
        close()
        yield rows()


def read_conversations(parts: DataFrame) -> DataFrame:
    """The published parts back, parsed: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Conversations in one part are read where they lie; only the others are put in order by
    a shuffle and read part by part, one part in memory at a time.
    """
    columns = ["conv_id", "formatted", "loss_from", "loss_to"]
    whole = parts.where("whole").select(*columns).mapInArrow(_reader, _ROWS)
    split = (
        parts.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "shard", "part")
        .select(*columns).mapInArrow(_reader, _ROWS)
    )
    return whole.unionByName(split)
