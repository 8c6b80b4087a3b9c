"""Keyed state-machine folds as built-in expressions, safe for a hot key.

A rule set over a finite set of states turns every event into a map state -> state,
and maps compose associatively. So a series can be cut anywhere:

* pieces of at most PIECE events, numbered inside (key, chunk), are composed into one
  small integer array each;
* pieces compose to chunks, chunks to spans, spans to the whole key;
* start states then flow back down, and each piece replays its events.

Nothing here collects more than PIECE events, the pieces of a chunk, the chunks of a
span or the spans of a key into one row. No Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Hashable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barledger.operators.ordered import CHUNK, TICK_CHUNK_SECONDS, chunk_window, with_chunk

PIECE = 64
CHUNKS_PER_SPAN = 256


@dataclass(frozen=True)
class Machine:
    """A compiled rule set: state 0 is the start; ``step[e][s]`` is the next state."""

    states: tuple[Hashable, ...]
    events: tuple[str, ...]
    step: tuple[tuple[int, ...], ...]
    labels: Mapping[str, tuple[tuple[str, ...], ...]]

    @property
    def width(self) -> int:
        return len(self.states)


def _ints(values: Sequence[int]) -> Column:
    return F.expr(f"array({', '.join(str(int(v)) for v in values)})")


def _labels(values: Sequence[object]) -> Column:
    """A constant array of strings or booleans, written as one SQL expression."""
    return F.expr(f"array({', '.join(str(v) if isinstance(v, bool) else repr(v) for v in values)})")


def _moves(machine: Machine) -> Column:
    """One row of next states per event code, a constant."""
    rows = (f"array({', '.join(map(str, row))})" for row in machine.step)
    return F.expr(f"array({', '.join(rows)})")


def event_code(machine: Machine, event_type: Column) -> Column:
    """Position of the event type in the rule set; null when it is unknown."""
    at = F.array_position(_labels(machine.events), event_type)
    return F.when(at > 0, (at - 1).cast("int"))


def _compose(maps: Column, width: int) -> Column:
    """One map from an ordered array of maps."""
    return F.aggregate(
        maps, _ints(range(width)), lambda acc, m: F.transform(acc, lambda s: F.get(m, s))
    )


def _starts(maps: Column, start: Column) -> Column:
    """Start state of every element of an ordered array of maps, as an int array."""
    return F.aggregate(
        maps,
        F.struct(F.array().cast("array<int>").alias("out"), start.cast("int").alias("s")),
        lambda acc, m: F.struct(
            F.array_append(acc["out"], acc["s"]).alias("out"), F.get(m, acc["s"]).alias("s")
        ),
        lambda acc: acc["out"],
    )


def fold_events(
    events: DataFrame,
    keys: Sequence[str],
    machine: Machine,
    ts: str = "ts",
    seq: str = "seq",
    event_type: str = "event_type",
    seconds: int = TICK_CHUNK_SECONDS,
) -> DataFrame:
    """Rows (keys, ts, seq, event_type, _before, _after, _event): one per input event."""
    rows = with_chunk(
        events.select(
            *keys,
            F.col(ts).alias("ts"),
            F.col(seq).cast("long").alias("seq"),
            event_code(machine, F.col(event_type)).alias("e"),
        ),
        keys,
        "ts",
        seconds,
    )
    # Joins below need the span set; saying so here keeps one plan, hence one exchange.
    span_no = F.floor(F.col(CHUNK) / F.lit(CHUNKS_PER_SPAN))
    rows = rows.filter(span_no.isNotNull())
    number = F.row_number().over(chunk_window(keys, ["ts", "seq"]))
    pieces = (
        rows.withColumn("piece", F.floor((number - 1) / F.lit(PIECE)).cast("int"))
        .groupBy(*keys, CHUNK, "piece")
        .agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "e"))).alias("ev"))
    )
    # One map per event; an unknown event keeps every state.
    moves = F.transform(
        F.col("ev.e"), lambda e: F.coalesce(F.get(_moves(machine), e), _ints(range(machine.width)))
    )
    piece_map = _compose(moves, machine.width)

    def ordered(position: str, m: Column) -> Column:
        return F.sort_array(F.collect_list(F.struct(F.col(position).alias("at"), m.alias("m"))))

    # The maps are the costly part and both directions of the scan need them. Laying them
    # out by span is an exchange of its own, which Spark computes once and reuses.
    chunks = (
        pieces.groupBy(*keys, CHUNK)
        .agg(F.transform(ordered("piece", piece_map), lambda p: p["m"]).alias("maps"))
        .withColumn("_span", span_no)
        .repartition(*keys, "_span")
    )
    spans = chunks.groupBy(*keys, "_span").agg(
        ordered(CHUNK, _compose(F.col("maps"), machine.width)).alias("chunks")
    )
    span_starts = (
        spans.groupBy(*keys)
        .agg(ordered("_span", _compose(F.col("chunks.m"), machine.width)).alias("spans"))
        .select(*keys, _hand_down("spans", "_span", F.lit(0)))
    )
    chunk_starts = spans.join(span_starts, [*keys, "_span"]).select(
        *keys, _hand_down("chunks", CHUNK, F.col("_s0"))
    )
    piece_starts = chunks.join(chunk_starts, [*keys, CHUNK]).select(
        *keys, CHUNK, _starts(F.col("maps"), F.col("_s0")).alias("_starts")
    )
    replayed = pieces.join(piece_starts, [*keys, CHUNK]).select(
        *keys,
        F.inline(
            F.arrays_zip(
                F.col("ev.ts").alias("ts"),
                F.col("ev.seq").alias("seq"),
                F.col("ev.e").alias("_event"),
                _starts(moves, F.get("_starts", "piece")).alias("_before"),
            )
        ),
    )
    after = F.get(F.get(_moves(machine), F.col("_event")), F.col("_before"))
    return replayed.withColumn("_after", F.coalesce(after, "_before"))


def _hand_down(maps: str, position: str, start: Column) -> Column:
    starts = _starts(F.col(f"{maps}.m"), start)
    return F.inline(F.arrays_zip(F.col(f"{maps}.at").alias(position), starts.alias("_s0")))


def decode(rows: DataFrame, machine: Machine) -> DataFrame:
    """Turn state numbers back into the label columns of the machine."""
    columns = {"event_type": F.get(_labels(machine.events), F.col("_event"))}
    for name, by_event in machine.labels.items():
        flat = _labels([v for row in by_event for v in row])
        if name.endswith("last_action"):
            at = F.col("_event") * F.lit(machine.width) + F.col("_before")
        else:
            at = F.col("_after")
        columns[name] = F.get(flat, at)
    return rows.withColumns(columns).drop("_event", "_before", "_after")
