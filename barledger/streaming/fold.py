"""Streaming twins of the campaign fold: state lives in the state store per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barledger.operators.campaign import compile_machine
from barledger.operators.fold import Machine, decode, event_code
from barledger.streaming.buffer import Buffer


class _FoldProcessor(StatefulProcessor):
    """Carries one small integer (the machine state) and the last position per key."""

    def __init__(self, machine: Machine, keys: Sequence[str], lateness_seconds: float):
        self._step, self._keys, self._lateness = machine.step, list(keys), lateness_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("fold", "state int, ts timestamp, seq bigint")
        self._buffer = Buffer(handle, ["ts", "seq"], self._lateness)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        closed = bool(arrived["closes"].any())
        for batch in self._buffer.add(arrived[~arrived["closes"]].drop(columns="closes"), closed):
            yield self._moved(key, batch)

    def _moved(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        state, last = 0, None
        if self._state.exists():
            state, ts, seq = self._state.get()
            last = (pd.Timestamp(ts), seq)
        out = []
        for ts, seq, code in zip(batch["ts"], batch["seq"], batch["e"]):
            if last is not None and (ts, seq) <= last:
                out.append((ts, seq, code, state, state, True))
                continue
            after = state if pd.isna(code) else self._step[int(code)][state]
            out.append((ts, seq, code, state, after, False))
            state, last = after, (ts, seq)
        self._state.update((state, last[0].to_pydatetime(), int(last[1])))
        frame = pd.DataFrame(out, columns=["ts", "seq", "_event", "_before", "_after", "late"])
        frame["_event"] = frame["_event"].astype("Int32")
        for name, value in zip(self._keys, key):
            frame.insert(0, name, value)
        return frame

    def close(self) -> None:
        pass


def stream_states(
    events: DataFrame,
    keys: Sequence[str],
    rule_sets: Sequence[str] = ("A", "B"),
    lateness_seconds: float = 0.0,
    closing: DataFrame | None = None,
) -> DataFrame:
    """States after every event of a stream (keys, ts timestamp, seq, event_type).

    Events wait until they are ``lateness_seconds`` behind the latest of their key and
    are then taken in order; a row of ``closing`` (keys, closes) releases all that wait.
    Events at or before the last processed one of their key are marked ``late`` and
    leave the state alone (``late_rows`` counts them).
    """
    machine = compile_machine(rule_sets)
    coded = events.select(
        *keys, "ts", F.col("seq").cast("long").alias("seq"), event_code(machine, F.col("event_type")).alias("e"),
        F.lit(False).alias("closes"),
    )
    if closing is not None:
        coded = coded.unionByName(closing.select(*keys, "closes"), allowMissingColumns=True)
    types = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in reversed(list(keys)))
    moved = coded.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_FoldProcessor(machine, keys, lateness_seconds),
        outputStructType=f"{types}, ts timestamp, seq bigint, _event int, _before int, _after int, late boolean",
        outputMode="Append",
        timeMode="None",
    )
    return decode(moved, machine)


def late_rows(trace: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many events of each series came too late to count: to be published with the trace."""
    return trace.groupBy(*keys).agg(F.count_if("late").alias("late_rows"), F.count("*").alias("rows"))
