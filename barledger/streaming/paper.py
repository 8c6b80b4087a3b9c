"""Incremental next-open ledger: one bar at a time, same result as the batch ledger."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barledger.functions.digest import bar_hash
from barledger.operators.ledger import execution_bars
from barledger.streaming.buffer import Buffer

STATE = (
    "last_timestamp timestamp, last_bar_hash string, held_exposure double, "
    "pending_target double, equity double, last_close double"
)


class _PaperProcessor(StatefulProcessor):
    """Per series: the last bar, the exposure held, the target waiting for the next open."""

    def __init__(self, keys: Sequence[str], bps: float, lateness_seconds: float):
        self._keys, self._rate, self._lateness = list(keys), bps / 10000.0, lateness_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("paper", STATE)
        self._buffer = Buffer(handle, ["timestamp"], self._lateness)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Resume from a verified journal: its tail row becomes the state."""
        row = initialState.iloc[0]
        self._state.update(
            (row["last_timestamp"].to_pydatetime(), row["last_bar_hash"], float(row["held_exposure"]),
             float(row["pending_target"]), float(row["equity"]), float(row["lastcloses"]))
        )

    def _advance(self, s: tuple, bar) -> tuple[tuple, str, float]:
        last, last_hash, held, pending, equity, last_close = s
        if last is not None and bar.timestamp < last:
            return s, "LATE", 0.0
        if last is not None and bar.timestamp == last:
            return s, "IDEMPOTENT_NOOP" if bar.bar_hash == last_hash else "CONFLICT", 0.0
        if not bar.usable:
            return s, "REFUSED_INPUT", 0.0
        target = held if pending is None else pending
        turn = abs(target - held)
        gap = 1.0 if last_close is None else 1.0 + held * (bar.open / last_close - 1.0)
        cost = turn * self._rate
        intra = 1.0 + target * (bar.close / bar.open - 1.0)
        if cost >= 1.0 or gap < 0.0 or intra < 0.0:
            return s, "REFUSED_WEALTH", 0.0
        after = (bar.timestamp, bar.bar_hash, target, bar.target_exposure, equity * gap * (1.0 - cost) * intra, bar.close)
        return after, "PROCESSED", turn

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        closed = bool(arrived["closes"].any())
        for batch in self._buffer.add(arrived[~arrived["closes"]].drop(columns="closes"), closed):
            yield self._moved(key, batch)

    def _moved(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        if self._state.exists():
            s = tuple(self._state.get())
            s = (pd.Timestamp(s[0]), *s[1:])
        else:
            s = (None, None, 0.0, None, 1.0, None)
        out = []
        for bar in batch.itertuples(index=False):
            s, status, turn = self._advance(s, bar)
            out.append((bar.timestamp, status, bar.bar_hash, s[2], turn, s[4], s[3]))
        if s[0] is not None:
            self._state.update((s[0].to_pydatetime(), *s[1:]))
        frame = pd.DataFrame(
            out, columns=["timestamp", "status", "bar_hash", "held_exposure", "turnover", "equity", "pending_target"]
        )
        for name, value in zip(self._keys, key):
            frame.insert(0, name, value)
        return frame

    def close(self) -> None:
        pass


def stream_ledger(
    bars: DataFrame,
    keys: Sequence[str],
    fee_bps: float = 7.0,
    slippage_bps: float = 0.0,
    resume: DataFrame | None = None,
    lateness_seconds: float = 0.0,
    closing: DataFrame | None = None,
) -> DataFrame:
    """Action per incoming bar. Retries are no-ops; changed or late bars never enter the state.

    Bars wait until they are ``lateness_seconds`` behind the latest of their series and
    are then taken in order; a row of ``closing`` (keys, closes) releases all that wait.
    Undated bars cannot wait and are refused at once.

    ``resume``: keys plus the STATE columns, from a verified journal (``resume_state``).
    """
    typed = execution_bars(bars, keys)
    usable = (
        (F.col("open") > 0) & (F.col("close") > 0) & F.col("target_exposure").isNotNull() & F.col("timestamp").isNotNull()
    )
    hashed = typed.withColumn(
        "bar_hash", bar_hash(F.col("timestamp"), F.col("open"), F.col("close"), F.col("target_exposure"))
    ).withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("closes", F.lit(False))
    if closing is not None:
        hashed = hashed.unionByName(closing.select(*keys, "closes"), allowMissingColumns=True)
    types = ", ".join(f"{k} {typed.schema[k].dataType.simpleString()}" for k in reversed(list(keys)))
    return hashed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_PaperProcessor(keys, fee_bps + slippage_bps, lateness_seconds),
        outputStructType=(
            f"{types}, timestamp timestamp, status string, bar_hash string, held_exposure double, "
            "turnover double, equity double, pending_target double"
        ),
        outputMode="Append",
        timeMode="None",
        **({"initialState": resume.groupBy(*keys)} if resume is not None else {}),
    )


def resume_state(journal: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state a verified journal ends in, ready for ``stream_ledger(resume=...)``."""
    last = lambda c: F.max_by(c, "seq")
    return journal.groupBy(*keys).agg(
        last("timestamp").cast("timestamp").alias("last_timestamp"),
        last("bar_hash").alias("last_bar_hash"),
        last("held_exposure").alias("held_exposure"),
        last("target_exposure").alias("pending_target"),
        last("equity").alias("equity"),
        last("close").alias("lastcloses"),
    )
