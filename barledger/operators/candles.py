"""Building and rolling up bars.

Every roll-up is one ``groupBy``: min/max/sum and ``min_by``/``max_by`` over a single
timestamp combine on the map side, so a hot series sends one row per bin and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barledger.functions.clock import MONDAY_ORIGIN, shift, with_availability


def _ohlcv(at: Column, open_: Column, close: Column) -> list[Column]:
    return [
        F.min_by(open_, at).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by(close, at).alias("close"),
        F.sum("volume").alias("volume"),
    ]


def tick_order(ticks: DataFrame) -> Column:
    """Ticks at one instant are ordered by their seq, where they have one."""
    return F.struct("ts", "seq") if "seq" in ticks.columns else F.col("ts")


def bars_from_ticks(ticks: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Ticks (ts, seq, price, qty) to left-closed bars labelled by open time."""
    at = tick_order(ticks)
    slot = F.window("ts", f"{seconds} seconds")["start"].alias("open_time")
    bars = ticks.groupBy(*keys, slot).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("qty").alias("volume"),
        F.count("*").alias("number_of_trades"),
    )
    return with_availability(bars, seconds)


def causal_bin(at: Column, width: str, origin: str | None = None) -> Column:
    """End of the right-closed bin holding ``at``: (end - width, end].

    Windows are left-closed, so step one microsecond back before binning; off-grid
    instants then land in the bin that closes at or after them.
    """
    back = at - F.expr("interval 1 microsecond")
    if origin:
        return F.window(back, width, width, origin)["end"]
    return F.window(back, width)["end"]


def rollup(
    bars: DataFrame,
    keys: Sequence[str],
    width: str,
    origin: str | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Causal roll-up on availability time; the label is when the new bar is knowable."""
    at = F.col("availability_time")
    end = causal_bin(at, width, origin)
    return (
        bars.groupBy(*keys, end.alias("_end"))
        .agg(*_ohlcv(at, F.col("open"), F.col("close")), F.count("*").alias("bars"), *extra)
        .withColumnRenamed("_end", "availability_time")
    )


def rollup_week(bars: DataFrame, keys: Sequence[str], compat: bool = False) -> DataFrame:
    """Weekly roll-up, (Monday 00:00, next Monday 00:00] by default.

    ``compat`` reproduces the Monday-anchored pandas bins instead: all of Monday
    belongs to the bin labelled with that same Monday, so the label is not causal.
    """
    if not compat:
        return rollup(bars, keys, "7 days", MONDAY_ORIGIN)
    at = F.col("availability_time")
    day = F.date_trunc("day", at).cast(bars.schema["availability_time"].dataType)
    label = F.window(day - F.expr("interval 1 microsecond"), "7 days", "7 days", MONDAY_ORIGIN)["end"]
    return (
        bars.groupBy(*keys, label.alias("_end"))
        .agg(*_ohlcv(at, F.col("open"), F.col("close")), F.count("*").alias("bars"))
        .withColumnRenamed("_end", "availability_time")
    )


def rollup_three_day_of_year(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Three-day bars on open time that restart every 1 January."""
    at = F.col("open_time")
    kind = bars.schema["open_time"].dataType
    into_year = F.floor((F.dayofyear(at) - 1) / 3) * 3
    start = F.date_trunc("year", at).cast(kind) + F.make_dt_interval(days=into_year.cast("int"))
    return _open_time_bins(bars, keys, start, 3 * 86400)


def rollup_week_of_open(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weekly bars on open time: [Monday, next Monday), labelled next Monday."""
    kind = bars.schema["open_time"].dataType
    start = F.date_trunc("week", F.col("open_time")).cast(kind)
    return _open_time_bins(bars, keys, start, 7 * 86400)


def _open_time_bins(bars: DataFrame, keys: Sequence[str], start: Column, seconds: int) -> DataFrame:
    at = F.col("open_time")
    return (
        bars.groupBy(*keys, start.alias("_start"))
        .agg(*_ohlcv(at, F.col("open"), F.col("close")), F.count("*").alias("bars"))
        .withColumn("availability_time", shift(F.col("_start"), seconds))
        .withColumnRenamed("_start", "open_time")
    )


def rollup_traded(bars: DataFrame, keys: Sequence[str], width: str, min_trades: int = 1) -> DataFrame:
    """Roll-up whose open and close come only from bars that really traded.

    Placeholder bars (fewer trades than ``min_trades``) still count for range and volume.
    """
    at = F.col("availability_time")
    traded = F.when(F.col("number_of_trades") >= min_trades, at)
    return (
        bars.groupBy(*keys, causal_bin(at, width).alias("_end"))
        .agg(
            F.min_by("open", traded).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", traded).alias("close"),
            F.sum("volume").alias("volume"),
            F.count("*").alias("bars"),
            F.count(traded).alias("traded_bars"),
        )
        .withColumnRenamed("_end", "availability_time")
    )


def rebuild_complete(
    bars: DataFrame, keys: Sequence[str], seconds: int, inputs: int
) -> DataFrame:
    """Lower clock to base clock, left-closed; only bins with exactly ``inputs`` bars."""
    at = F.col("open_time")
    return (
        bars.groupBy(*keys, F.window(at, f"{seconds} seconds")["start"].alias("_start"))
        .agg(*_ohlcv(at, F.col("open"), F.col("close")), F.count("*").alias("bars"))
        .filter(F.col("bars") == inputs)
        .withColumnRenamed("_start", "open_time")
    )
