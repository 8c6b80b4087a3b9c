"""Streams in two stages: time chunks settle side by side, series pass on summaries only.

Stage one is keyed by (series, chunk of time). Rows wait in state until the watermark has
passed the end of their chunk; a timer on that event time then hands the chunk on, in
order, as one row of arrays, and forgets it. Rows of a chunk that is gone are handed on
as late. A task holds one chunk at a time, and a hot series is as many keys as it has chunks.

Stage two is keyed by series and follows the table that stage one writes. It reads the
summary of each chunk, a few numbers, and says what a chunk starts from. The rows never
pass through it: they are joined with their start afterwards and replayed, chunk by chunk.

A micro-batch of stage one holds no chunk that is older than one of the batch before, and
stage two sees whole batches only, so sorting the chunks of a batch is order enough. A
chunk that comes out of order stops the stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barledger.checks import IntegrityError
from barledger.functions.clock import micros
from barledger.functions.digest import bar_hash
from barledger.operators.campaign import compile_machine
from barledger.operators.fold import Machine, _compose, _ints, _moves, decode, event_code
from barledger.operators.ledger import execution_bars
from barledger.streaming.buffer import _pack, _unpack
from barledger.streaming.drain import Closing, drain

SETTLED, LATE = "SETTLED", "LATE"


def _types(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _read(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """What arrived for a key, without the beats of the clock."""
    arrived = pd.concat(list(rows))
    return arrived[~arrived["beat"]].drop(columns="beat")


class _Settler(StatefulProcessor):
    """The rows of one (series, chunk) until the watermark has passed its end."""

    def __init__(self, names: list[str], keys: list[str], order: list[str], seconds: int, identity: str | None, usable: str | None):
        self._names, self._keys, self._order, self._seconds = names, keys, order, seconds
        self._identity, self._usable = identity, usable

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getListState("rows", "packed binary")

    def _end(self, key) -> int:
        return (int(key[-1]) + 1) * self._seconds * 1000

    def _out(self, key, status: Sequence[str], columns: list[list]) -> pd.DataFrame:
        frame = pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(self._names, columns)})
        frame.insert(0, "status", list(status))
        for name, value in reversed(list(zip([*self._keys, "chunk"], key))):
            frame.insert(0, name, value)
        return frame

    def _singles(self, key, rows: pd.DataFrame, status: Sequence[str]) -> pd.DataFrame:
        return self._out(key, status, [[[v] for v in rows[n]] for n in self._names])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = _read(rows)
        if self._usable is not None:
            refused = arrived[~arrived[self._usable]]
            if len(refused):
                yield self._singles(key, refused, ["REFUSED_INPUT"] * len(refused))
            arrived = arrived[arrived[self._usable]]
        if not len(arrived):
            return
        if self._end(key) <= timerValues.getCurrentWatermarkInMs():
            yield self._singles(key, arrived, [LATE] * len(arrived))
            return
        self._rows.appendValue((_pack(arrived),))
        self._handle.registerTimer(self._end(key))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pd.concat([_unpack(packed) for (packed,) in self._rows.get()])
        self._rows.clear()
        rows = rows.sort_values(self._order, kind="stable")
        if self._identity is not None:
            again = rows.duplicated(self._order[0]).to_numpy()
            if again.any():
                first = rows[~again].set_index(self._order[0])[self._identity]
                repeats = rows[again]
                same = repeats[self._identity].to_numpy() == first.reindex(repeats[self._order[0]]).to_numpy()
                yield self._singles(key, repeats, np.where(same, "IDEMPOTENT_NOOP", "CONFLICT").tolist())
                rows = rows[~again]
        yield self._out(key, [SETTLED], [[rows[n].to_numpy()] for n in self._names])

    def close(self) -> None:
        pass


def _chunked(stream: DataFrame, keys: Sequence[str], at: str, seconds: int, lateness_seconds: int, beats: DataFrame | None) -> DataFrame:
    """Rows with their chunk, watermarked; the watermarked column itself goes.

    Without it Spark drops no late row of its own accord; the timers still follow the watermark.
    """
    rows = stream.withColumn("beat", F.lit(False))
    if beats is not None:
        rows = rows.unionByName(beats.withColumn("beat", F.lit(True)), allowMissingColumns=True)
    watched = rows.withWatermark(at, f"{int(lateness_seconds)} seconds")
    instant = micros(F.col(at))
    return watched.withColumns({"_chunk": F.floor(instant / F.lit(seconds * 1_000_000)), "_at": instant}).drop(at).withColumnRenamed("_at", at)


def settled_chunks(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: int, lateness_seconds: int,
    beats: DataFrame | None = None, identity: str | None = None, usable: str | None = None,
) -> DataFrame:
    """Stage one: rows (keys, chunk, status, one array per column).

    ``order[0]`` is the instant; arrays hold it as microseconds. A settled chunk is one row
    with status SETTLED. Every row that came after its chunk was handed on is a row of its
    own with status LATE. With ``identity``, further rows of an instant are rows of their
    own: IDEMPOTENT_NOOP if that column equals the first one's, else CONFLICT. With
    ``usable``, rows where it is false are REFUSED_INPUT and enter no chunk. ``beats`` has
    the instant alone and moves the watermark.
    """
    at = order[0]
    rows = _chunked(stream, keys, at, seconds, lateness_seconds, beats)
    names = [c for c in rows.columns if c not in (*keys, "beat", "_chunk", usable)]
    out = ", ".join(f"`{n}` array<{rows.schema[n].dataType.simpleString()}>" for n in names)
    return rows.groupBy(*keys, "_chunk").transformWithStateInPandas(
        statefulProcessor=_Settler(names, list(keys), list(order), seconds, identity, usable),
        outputStructType=f"{_types(rows, keys)}, chunk bigint, status string, {out}",
        outputMode="Append", timeMode="EventTime",
    )


def beats_after(table: DataFrame, at: str, seconds: int, lateness_seconds: int) -> DataFrame:
    """The one beat that settles every chunk of a bounded table: it lies just behind the last one."""
    last = F.max(micros(F.col(at)))
    end = (F.floor(last / F.lit(seconds * 1_000_000)) + 1) * seconds + int(lateness_seconds)
    return table.agg(F.timestamp_seconds(end).alias(at)).where(F.col(at).isNotNull())


def measured_lateness(table: DataFrame, at: str) -> int:
    """Seconds that a row of a table of files can lie behind the files that a stream takes earlier.

    Files are taken by modification time; those of one time in any order. One row per file
    is ordered, and one number reaches the driver.
    """
    files = table.select(micros(F.col(at)).alias("at"), "_metadata.file_path", F.unix_micros("_metadata.file_modification_time").alias("written")).groupBy(
        "file_path", "written").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    earlier = F.max("high").over(Window.orderBy("written").rangeBetween(Window.unboundedPreceding, -1))
    together = Window.partitionBy("written")
    peers = F.when(F.count("*").over(together) > 1, F.max("high").over(together))
    behind = files.select((F.greatest(earlier, peers) - F.col("low")).alias("d")).agg(F.max("d").alias("d")).first()["d"]
    return max(0, math.ceil((behind or 0) / 1_000_000))


# ---------------------------------------------------------------- stage two


class _Passer(StatefulProcessor):
    """Carries a series' state over its chunks; emits what each chunk starts from."""

    def __init__(self, keys: list[str], state: str, start: tuple, step, columns: list[str]):
        self._keys, self._schema, self._first, self._step, self._columns = keys, state, start, step, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("carried", f"chunk bigint, {self._schema}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values("chunk", kind="stable")
        last, *state = self._state.get() if self._state.exists() else (None, *self._first)
        out = []
        for summary in arrived.itertuples(index=False):
            if last is not None and summary.chunk <= last:
                raise ValueError(f"chunk {summary.chunk} of {key} comes after chunk {last}")
            out.append((*key, summary.chunk, *state))
            state, last = self._step(state, summary), int(summary.chunk)
        self._state.update((last, *state))
        frame = pd.DataFrame(out, columns=self._columns)
        yield frame.astype(object).where(frame.notna(), None)

    def close(self) -> None:
        pass


def _passed(summaries: DataFrame, keys: Sequence[str], state: str, start: tuple, step) -> DataFrame:
    """Stage two: (keys, chunk, columns of ``state`` at the start of the chunk)."""
    names = [f.split()[0] for f in state.split(", ")]
    return summaries.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Passer(list(keys), state, start, step, [*keys, "chunk", *names]),
        outputStructType=f"{_types(summaries, keys)}, chunk bigint, {state}",
        outputMode="Append", timeMode="None",
    )


class Stages:
    """The folders of a two-stage stream, below one base: stopped and taken up again at will."""

    def __init__(self, spark: SparkSession, base: str, keys: Sequence[str]):
        self.spark, self.base, self.keys = spark, base, list(keys)

    def settle(self, stream: DataFrame, closing: Closing | None = None, ends: Sequence[DataFrame] = ()) -> DataFrame:
        return drain(stream, "settled", closing, list(ends), base=f"{self.base}/settled")

    def carry(self, make, schema) -> DataFrame:
        """``make`` of the stream of settled chunks, as far as stage one has come."""
        follow = self.spark.readStream.schema(schema).parquet(f"{self.base}/settled/out")
        return drain(make(follow.where(F.col("status") == SETTLED)), "carried", base=f"{self.base}/carried")

    def carried_state(self) -> DataFrame:
        """The state of stage two as its stopped checkpoint holds it: keys, chunk and the state's columns."""
        store = self.spark.read.format("statestore").option("stateVarName", "carried").load(f"{self.base}/carried/checkpoint")
        return store.select("key.*", "value.*")


def none_late(late: DataFrame, what: str) -> None:
    """Stop if a bounded stream with a measured lateness left rows out."""
    found = late.limit(1).collect()
    if found:
        raise IntegrityError(f"{what}: rows entered no chunk, such as {found[0].asDict()}")


def late_of(settled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that entered no chunk, with the reason: the side table to publish."""
    names = [f.name for f in settled.schema.fields if isinstance(f.dataType, T.ArrayType) and f.name not in keys]
    return settled.where(F.col("status") != SETTLED).select(*keys, "chunk", "status", *[F.get(n, F.lit(0)).alias(n) for n in names])


# ---------------------------------------------------------------- states


def _advance_state(state: list, summary) -> list:
    return [int(summary.map[state[0]])]


def _before_each(keys: list[str], machine: Machine):
    """Chunks (keys, ts, seq, e, start) -> their events, each with the state before it: one look-up an event."""
    step, names = machine.step, [*keys, "ts", "seq", "_event", "_before"]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(batch.num_rows):
                chunk = batch.slice(at, 1)
                *_, ts, seq, events, start = chunk.columns
                codes, state = pc.list_flatten(events), start[0].as_py()
                before = np.empty(len(codes), np.int32)
                for i, code in enumerate(codes.to_pylist()):
                    before[i] = state
                    if code >= 0:  # unknown events have code -1 and keep every state
                        state = step[code][state]
                of = pc.list_parent_indices(events)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(of) for c in chunk.columns[: len(keys)]), pc.list_flatten(ts), pc.list_flatten(seq), codes, pa.array(before)], names=names)

    return batches


def settled_states(
    stages: Stages, events: DataFrame, seconds: int, lateness_seconds: int,
    closing: Closing | None = None, ends: Sequence[DataFrame] = (), rule_sets: Sequence[str] = ("A", "B"),
) -> tuple[DataFrame, DataFrame]:
    """(trace, late) of a stream of events (keys, ts, seq, event_type), worked off as far as it has landed.

    The trace has the states after every event of the chunks that have settled and equals
    the batch trace of those events; ``late`` has the events that came after their chunk.
    """
    keys, machine = stages.keys, compile_machine(rule_sets)
    coded = events.select(*keys, "ts", F.col("seq").cast("long").alias("seq"), F.coalesce(event_code(machine, F.col("event_type")), F.lit(-1)).alias("e"))
    beats = closing.stream() if closing is not None else None
    chunks = settled_chunks(coded, keys, ["ts", "seq"], seconds, lateness_seconds, beats)
    # Unknown events have code -1 and keep every state.
    moves = F.transform("e", lambda e: F.coalesce(F.get(_moves(machine), e), _ints(range(machine.width))))
    settled = stages.settle(chunks.withColumn("map", _compose(moves, machine.width)), closing, ends)
    starts = stages.carry(
        lambda s: _passed(s.select(*keys, "chunk", "map"), keys, "start int", (0,), _advance_state), settled.schema)
    replayed = settled.where(F.col("status") == SETTLED).join(starts, [*keys, "chunk"]).select(*keys, "ts", "seq", "e", "start").mapInArrow(
        _before_each(keys, machine), f"{_types(settled, keys)}, ts bigint, seq bigint, _event int, _before int")
    after = F.coalesce(F.get(F.get(_moves(machine), F.col("_event")), F.col("_before")), F.col("_before"))
    coded_rows = replayed.withColumns({"ts": F.timestamp_micros("ts"), "_after": after, "_event": F.when(F.col("_event") >= 0, F.col("_event"))})
    late = late_of(settled, keys).drop("map")
    named = late.withColumns({"ts": F.timestamp_micros("ts"), "_event": F.when(F.col("e") >= 0, F.col("e")), "_before": F.lit(0), "_after": F.lit(0)})
    return decode(coded_rows, machine), decode(named, machine).select(*keys, "ts", "seq", "event_type", "status")


# ---------------------------------------------------------------- ledger

_CARRIED = "held_exposure double, pending_target double, last_close double, equity double, last_timestamp bigint, bars bigint"


def _step_bar(held, pending, last_close, equity, open_, close, target, rate):
    aim = held if pending is None else pending
    gap = 1.0 if last_close is None else 1.0 + held * (open_ / last_close - 1.0)
    intra = 1.0 + aim * (close / open_ - 1.0)
    cost = abs(aim - held) * rate
    if cost >= 1.0 or gap < 0.0 or intra < 0.0:
        raise ValueError("ledger refused: a cost that takes all or negative wealth")
    return aim, target, close, equity * gap * (1.0 - cost) * intra


class _Ledger:
    """How a chunk's summary moves the state of a ledger."""

    def __init__(self, rate: float):
        self._rate = rate

    def __call__(self, state: list, s) -> list:
        held, pending, close, equity, _, bars = state
        pending, close = (None if v is None or math.isnan(v) else v for v in (pending, close))
        for o, c, x in zip(s.head_open, s.head_close, s.head_target):
            held, pending, close, equity = _step_bar(held, pending, close, equity, o, c, x, self._rate)
        if s.n > 2:
            held, pending, close = s.held, s.target, s.close
        return [float(held), float(pending), float(close), float(equity * s.growth), int(s.last_timestamp), int(bars + s.n)]


def _summary(rate: float) -> dict[str, Column]:
    """What the ledger needs of a chunk: its first two bars, the growth over the others, its end."""
    n = F.size("timestamp")
    at = lambda c, i: F.get(F.col(c), i)
    old, new = (lambda i: at("target_exposure", i - 2)), (lambda i: at("target_exposure", i - 1))
    gap = lambda i: 1 + old(i) * (at("open", i) / at("close", i - 1) - 1)
    intra = lambda i: 1 + new(i) * (at("close", i) / at("open", i) - 1)
    cost = lambda i: F.abs(new(i) - old(i)) * F.lit(rate)
    stop = F.raise_error(F.lit("ledger refused: a cost that takes all or negative wealth")).cast("double")
    factor = lambda i: F.when((cost(i) >= 1) | (gap(i) < 0) | (intra(i) < 0), stop).otherwise(gap(i) * (1 - cost(i)) * intra(i))
    others = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    settled = F.col("status") == SETTLED
    return {
        "n": n.cast("bigint"), "growth": F.when(settled, F.aggregate(others, F.lit(1.0), lambda acc, i: acc * factor(i))),
        "head_open": F.slice("open", 1, 2), "head_close": F.slice("close", 1, 2), "head_target": F.slice("target_exposure", 1, 2),
        "held": at("target_exposure", n - 2), "target": at("target_exposure", n - 1), "close_": at("close", n - 1), "last_timestamp": at("timestamp", n - 1),
    }


def _replay(keys: list[str], rate: float):
    def frames(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in found:
            for chunk in frame.itertuples(index=False):
                o, c, x = np.asarray(chunk.open), np.asarray(chunk.close), np.asarray(chunk.target_exposure)
                first = np.isnan(chunk.pending_target)
                aims = np.concatenate([[chunk.held_exposure if first else chunk.pending_target], x[:-1]])
                held = np.concatenate([[chunk.held_exposure], aims[:-1]])
                before = np.concatenate([[chunk.last_close], c[:-1]])
                gap = 1 + held * (o / before - 1)
                if first:
                    gap[0] = 1.0
                turnover = np.abs(aims - held)
                equity = chunk.equity * np.cumprod(gap * (1 - turnover * rate) * (1 + aims * (c / o - 1)))
                out = pd.DataFrame({"timestamp": np.asarray(chunk.timestamp), "status": "PROCESSED", "bar_hash": chunk.bar_hash, "held_exposure": aims,
                                    "turnover": turnover, "equity": equity, "pending_target": x})
                for k in reversed(keys):
                    out.insert(0, k, getattr(chunk, k))
                yield out

    return frames


def settled_ledger(
    stages: Stages, bars: DataFrame, seconds: int, lateness_seconds: int, closing: Closing | None = None,
    ends: Sequence[DataFrame] = (), fee_bps: float = 7.0, slippage_bps: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """(actions, refused) of a stream of execution bars, worked off as far as it has landed.

    Actions equal the batch ledger of the accepted bars of settled chunks. Of the bars of an
    instant the smallest by hash is accepted; refused bars are IDEMPOTENT_NOOP, CONFLICT,
    LATE or REFUSED_INPUT. A cost that takes all or negative wealth stops the stream, as it
    stops the batch ledger.
    """
    keys, rate = stages.keys, (fee_bps + slippage_bps) / 10000.0
    typed = execution_bars(bars, keys)
    usable = (F.col("open") > 0) & (F.col("close") > 0) & F.col("target_exposure").isNotNull() & F.col("timestamp").isNotNull()
    hashed = typed.withColumn("bar_hash", bar_hash(F.col("timestamp"), F.col("open"), F.col("close"), F.col("target_exposure"))).withColumn(
        "usable", F.coalesce(usable, F.lit(False)))
    beats = closing.stream() if closing is not None else None
    chunks = settled_chunks(hashed, keys, ["timestamp", "bar_hash"], seconds, lateness_seconds, beats, "bar_hash", "usable")
    summary = _summary(rate)
    settled = stages.settle(chunks.withColumns(summary), closing, ends)
    step = _Ledger(rate)
    starts = stages.carry(
        lambda s: _passed(s.select(*keys, "chunk", *[F.col(c).alias(c.rstrip("_")) for c in summary]), keys, _CARRIED, (0.0, None, None, 1.0, None, 0), step),
        settled.schema)
    whole = settled.where(F.col("status") == SETTLED).select(*keys, "chunk", "timestamp", "open", "close", "target_exposure", "bar_hash").join(
        starts.drop("last_timestamp", "bars"), [*keys, "chunk"])
    types = ", ".join(f"`{k}` {typed.schema[k].dataType.simpleString()}" for k in keys)
    actions = whole.mapInPandas(_replay(keys, rate), f"{types}, timestamp bigint, status string, bar_hash string, held_exposure double, "
                                "turnover double, equity double, pending_target double")
    refused = late_of(settled, keys).select(*keys, F.timestamp_micros("timestamp").alias("timestamp"), "open", "close", "target_exposure", "bar_hash", "status")
    return actions.withColumn("timestamp", F.timestamp_micros("timestamp")), refused


# ---------------------------------------------------------------- retries


class _Memory(StatefulProcessor):
    """Which (instant, content) a chunk has seen, until the watermark has passed its end."""

    def __init__(self, keys: list[str], seconds: int, names: list[str]):
        self._keys, self._seconds, self._names = keys, seconds, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getMapState("seen", "at bigint", "content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = _read(rows)
        if not len(arrived):
            return
        end = (int(key[-1]) + 1) * self._seconds * 1000
        arrived = arrived.sort_values(["timestamp", "arrival"], kind="stable")
        if end <= timerValues.getCurrentWatermarkInMs():
            status = ["EXPIRED"] * len(arrived)
        else:
            seen = {k[0]: v[0] for k, v in self._seen.iterator()}
            status = []
            for at, content in zip(arrived["timestamp"].tolist(), arrived["content"]):
                if at not in seen:
                    seen[at] = content
                    self._seen.updateValue((at,), (content,))
                    status.append("PROCESSED")
                else:
                    status.append("IDEMPOTENT_NOOP" if seen[at] == content else "CONFLICT")
            self._handle.registerTimer(end)
        yield arrived.assign(status=status, **dict(zip(self._keys, key)))[self._names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._seen.clear()
        yield pd.DataFrame(columns=self._names)

    def close(self) -> None:
        pass


def stream_retries(
    rows: DataFrame, keys: Sequence[str], content: Column, seconds: int, lateness_seconds: int, arrival: str = "arrival", beats: DataFrame | None = None,
) -> DataFrame:
    """Status of every row of a stream (keys, timestamp, arrival) as soon as it comes.

    The first row of an instant is PROCESSED. Later ones are IDEMPOTENT_NOOP if ``content``
    equals that of the first, else CONFLICT. What was seen is remembered until the watermark
    has passed the chunk of the instant, and then forgotten: rows of it are EXPIRED, since
    nobody knows any more whether they are news. Rows of a micro-batch come in the order of
    ``arrival``.
    """
    named = rows.select(*keys, "timestamp", F.col(arrival).cast("long").alias("arrival"), content.alias("content"))
    chunked = _chunked(named, keys, "timestamp", seconds, lateness_seconds, beats)
    names = [*keys, "timestamp", "arrival", "content", "status"]
    out = chunked.groupBy(*keys, "_chunk").transformWithStateInPandas(
        statefulProcessor=_Memory(list(keys), seconds, names),
        outputStructType=f"{_types(chunked, [*keys, 'timestamp', 'arrival', 'content'])}, status string",
        outputMode="Append", timeMode="EventTime",
    )
    return out.withColumn("timestamp", F.timestamp_micros("timestamp"))


def checked_recovery(stages: Stages, journal_tail: DataFrame) -> DataFrame:
    """Rows (keys, check, failures): where the stopped stream's state and the verified journal differ.

    ``journal_tail`` is ``resume_state`` of the journal. The state is read from the
    checkpoint by the state store's own reader; a series that only one side knows is a
    failure too.
    """
    state = stages.carried_state().select(
        *stages.keys, F.timestamp_micros("last_timestamp").alias("s_at"), F.col("held_exposure").alias("s_held"), F.col("pending_target").alias("s_target"),
        F.col("equity").alias("s_equity"), F.col("last_close").alias("s_close"), F.lit(True).alias("_s"))
    tail = journal_tail.select(*stages.keys, "last_timestamp", "held_exposure", "pending_target", "equity", F.col("lastcloses").alias("last_close"), F.lit(True).alias("_j"))
    both = state.join(tail, stages.keys, "full")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(b))
    same = {
        "series": F.col("_s") & F.col("_j"), "last_timestamp": F.col("s_at") == F.col("last_timestamp"), "held_exposure": near("s_held", "held_exposure"),
        "pending_target": near("s_target", "pending_target"), "equity": near("s_equity", "equity"), "last_close": near("s_close", "last_close"),
    }
    counts = both.select(*stages.keys, *[F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1).alias(name) for name, ok in same.items()])
    return counts.unpivot(stages.keys, list(same), "check", "failures")
