"""Bounded-overlap refresh of a bar table stored by day, and its proof against a rebuild.

A monitor run reads the ticks of the last days only, rebuilds whole day partitions and
overwrites just those; older partitions are not read. Whether that was enough is shown
per series and day: the digest of the stored bars equals that of bars built from all ticks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barledger.checks import IntegrityError
from barledger.functions.digest import instant_text, number_text, plain_text, record_hash, set_digest
from barledger.operators.candles import bars_from_ticks
from barledger.operators.gates import MONITOR_LOOKBACK_DAYS

REFRESHED, KEPT = "REFRESHED", "KEPT"
SECONDS_PER_DAY = 86_400


def first_refreshed_day(end: Column, lookback_days: int = MONITOR_LOOKBACK_DAYS) -> Column:
    """The day that holds the start of the overlap; it is rebuilt whole."""
    return F.to_date(end - F.expr(f"interval {lookback_days} days"))


def bars_by_day(ticks: DataFrame, keys: Sequence[str], seconds: int, end: Column, first_day: Column | None = None) -> DataFrame:
    """Bars known by ``end`` with the day they became available, from ``first_day`` on.

    The ticks of a bar begin one bar width before its day at the earliest, so the bound on
    ``ts`` reaches the scan. A bar still open at ``end`` is left to the next run.
    """
    if SECONDS_PER_DAY % seconds:
        raise IntegrityError(f"bars of {seconds} seconds do not tile a day")
    known = ticks.where(F.col("ts") < end)
    if first_day is not None:
        known = known.where(F.col("ts") >= first_day.cast("timestamp_ntz") - F.expr(f"interval {seconds} seconds"))
    bars = bars_from_ticks(known, keys, seconds).where(F.col("availability_time") <= end)
    bars = bars.withColumn("day", F.to_date("availability_time"))
    return bars if first_day is None else bars.where(F.col("day") >= first_day)


def day_digests(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, day) -> number of bars and digest of their set; a group has one bar a clock tick at most.

    Volumes are sums of doubles, equal to eight decimals in whatever order they were added.
    """
    line = record_hash([
        instant_text(F.col("open_time")), instant_text(F.col("availability_time")),
        *(number_text(F.col(c)) for c in ("open", "high", "low", "close")),
        number_text(F.round("volume", 8)), plain_text(F.col("number_of_trades")),
    ])
    return bars.groupBy(*keys, "day").agg(F.count("*").alias("bars"), set_digest(line).alias("digest"))


def audit_refresh(stored: DataFrame, rebuilt: DataFrame, keys: Sequence[str], first_day: Column) -> DataFrame:
    """Digests of the stored and of the rebuilt table -> per series and day its scope and whether they match.

    A day that only one of them has does not match: a stored partition whose ticks were all
    withdrawn is reported, as an overwrite of partitions doesn't remove it.
    """
    ours = stored.withColumnsRenamed({"bars": "bars_stored", "digest": "digest_stored"})
    full = rebuilt.withColumnsRenamed({"bars": "bars_rebuilt", "digest": "digest_rebuilt"})
    for k in (*keys, "day"):
        ours, full = ours.withColumnRenamed(k, f"_s_{k}"), full.withColumnRenamed(k, f"_r_{k}")
    same = [F.col(f"_s_{k}").eqNullSafe(F.col(f"_r_{k}")) for k in (*keys, "day")]
    both = ours.join(full, same, "full")
    named = [F.coalesce(f"_s_{k}", f"_r_{k}").alias(k) for k in (*keys, "day")]
    return both.select(
        *named, F.coalesce("bars_stored", F.lit(0)).alias("bars_stored"), F.coalesce("bars_rebuilt", F.lit(0)).alias("bars_rebuilt"),
        F.coalesce(F.col("digest_stored") == F.col("digest_rebuilt"), F.lit(False)).alias("matches"),
    ).withColumn("scope", F.when(F.col("day") >= first_day, REFRESHED).otherwise(KEPT))
