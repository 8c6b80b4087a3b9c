"""Clocks, availability time and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds per clock name.
CLOCK_SECONDS = {
    "1m": 60,
    "15m": 900,
    "30m": 1800,
    "1h": 3600,
    "2h": 7200,
    "4h": 14400,
    "8h": 28800,
    "12h": 43200,
    "1d": 86400,
    "3d": 259200,
    "72h": 259200,
    "1w": 604800,
}
# Fixed values. Clocks up to one day publish a file for every day; longer clocks are sparse.
DENSE_LIMIT_SECONDS = 86400
# Epoch integers at or above this magnitude are microseconds, below it milliseconds.
MICROSECOND_EPOCH_FROM = 10**14
# 1970-01-05 is the first Monday after the epoch.
MONDAY_ORIGIN = "4 days"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def shift(ts: Column, seconds: int) -> Column:
    return ts + F.expr(f"interval {seconds} seconds")


def clock_seconds(tf: Column) -> Column:
    """Seconds of a clock-name column; unknown names give null."""
    pairs = [F.lit(v) for kv in CLOCK_SECONDS.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), tf)


def with_availability(df: DataFrame, seconds: int | Column) -> DataFrame:
    """availability_time = open_time + clock length: when a bar becomes knowable."""
    if isinstance(seconds, int):
        at = shift(F.col("open_time"), seconds)
    else:
        at = F.col("open_time") + F.make_dt_interval(secs=seconds)
    return df.withColumn("availability_time", at)


def epoch_to_timestamp(epoch: Column) -> Column:
    """Epoch integer to timestamp, unit chosen by magnitude."""
    return F.when(
        F.abs(epoch) >= MICROSECOND_EPOCH_FROM, F.timestamp_micros(epoch)
    ).otherwise(F.timestamp_millis(epoch))


def eligible_forward(df: DataFrame, freeze: Column, cutoff: Column) -> DataFrame:
    """Forward pool: strictly after the freeze, up to and including the cutoff."""
    at = F.col("availability_time")
    return df.filter((at > freeze) & (at <= cutoff))


def eligible_warmup(df: DataFrame, freeze: Column) -> DataFrame:
    """Warm-up pool: the freeze instant itself still belongs to it."""
    return df.filter(F.col("availability_time") <= freeze)


def request_window(df: DataFrame, start: Column, end: Column, closed: bool = False) -> DataFrame:
    """Rows a request asked for: [start, end), or [start, end] when ``closed``."""
    at = F.col("open_time")
    upper = at <= end if closed else at < end
    return df.filter((at >= start) & upper)


def on_grid(ts: Column, seconds: int) -> Column:
    return F.pmod(micros(ts), F.lit(seconds * 1_000_000)) == 0


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def calendar(spans: DataFrame, step: str = "1 day") -> DataFrame:
    """One row per (columns of ``spans``, period) between its ``first`` and ``last`` dates."""
    return spans.withColumn(
        "period", F.explode(F.expr(f"sequence(first, last, interval {step})"))
    ).drop("first", "last")


def _at(us: Column, like: str) -> Column:
    return F.timestamp_micros(us).cast(like)


def bin_end(ts: Column, seconds: int, like: str, origin_seconds: int = 0) -> Column:
    """End of the right-closed bin of ``ts``, as plain arithmetic.

    ``F.window`` allows one window per query block; this form lets one pass over the
    bars bin them for many clocks at once. ``like`` is the timestamp type to return.
    """
    width, origin = seconds * 1_000_000, origin_seconds * 1_000_000
    us = micros(ts)
    return _at(us + F.pmod(F.lit(origin) - us, F.lit(width)), like)


def week_end_of_day(ts: Column, like: str) -> Column:
    """Monday label of the whole-day weekly bins: Monday belongs to its own label."""
    day, week, monday = 86400_000_000, 604800_000_000, 4 * 86400_000_000
    midnight = micros(ts) - F.pmod(micros(ts), F.lit(day))
    return _at(midnight + F.pmod(F.lit(monday) - midnight, F.lit(week)), like)
