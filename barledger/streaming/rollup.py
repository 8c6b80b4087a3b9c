"""Streaming bars and roll-ups: watermarked, append mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barledger.operators.candles import tick_order


def stream_bars(ticks: DataFrame, keys: Sequence[str], width: str, lateness: str) -> DataFrame:
    """Left-closed bars from a tick stream (ts timestamp, seq, price, qty).

    Ticks at one instant are ordered by seq. A bar is emitted once the watermark has
    passed it; ``drain`` stops if a tick comes later than ``lateness`` allows, and a
    closing tick far ahead (``closing_tick``) emits what is still open.
    """
    at = tick_order(ticks)
    slot = F.window("ts", width)
    bars = ticks.withWatermark("ts", lateness).groupBy(*keys, slot.alias("_w")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("qty").alias("volume"),
        F.count("*").alias("number_of_trades"),
    )
    return bars.select(
        *keys, F.col("_w.start").alias("open_time"), F.col("_w.end").alias("availability_time"),
        "open", "high", "low", "close", "volume", "number_of_trades",
    )


def stream_rollup(bars: DataFrame, keys: Sequence[str], width: str, lateness: str) -> DataFrame:
    """Right-closed roll-up of a bar stream on availability time, as ``candles.rollup``.

    The event-time column is shifted by one microsecond so that left-closed windows
    become right-closed bins; the watermark moves with it.
    """
    at = F.col("availability_time")
    shifted = bars.withColumn("_at", at - F.expr("interval 1 microsecond")).withWatermark("_at", lateness)
    rolled = shifted.groupBy(*keys, F.window("_at", width).alias("_w")).agg(
        F.min_by("open", "_at").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "_at").alias("close"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("bars"),
    )
    return rolled.select(
        *keys, F.col("_w.end").alias("availability_time"), "open", "high", "low", "close", "volume", "bars"
    )


CLOSING_INSTANT = "9000-01-01 00:00:00"


def closing_tick(ticks: DataFrame, at: str = "ts") -> DataFrame:
    """One row without a series, far ahead of all others: moves the watermark past every bar."""
    spark = ticks.sparkSession
    return spark.range(1).select(
        *[F.lit(CLOSING_INSTANT).cast("timestamp").alias(f.name) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name)
          for f in ticks.schema.fields]
    )


def real_bars(bars: DataFrame, at: str = "open_time") -> DataFrame:
    """Without the closing tick's own bar.

    A filter on the series would be pushed below the watermark and take the tick away
    before it moves anything; one on the bar's time is not.
    """
    return bars.where(F.col(at) < F.lit("8999-01-01 00:00:00").cast("timestamp"))
