"""Audits of bars: windows, integrity, gaps and parity with native candles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barledger.functions.clock import (
    CLOCK_SECONDS,
    bin_end,
    micros,
    on_grid,
    week_end_of_day,
)
from barledger.functions.predicates import any_nonpositive, envelope_broken
from barledger.operators.dedupe import out_of_order
from barledger.operators.ordered import BAR_CHUNK_SECONDS, previous_row

BASE_SECONDS = 900
AUDIT_CLOCKS = ("30m", "1h", "2h", "4h", "8h", "12h", "1d", "72h", "1w")
PRICE_TOLERANCE = 1e-8
OHLC = ("open", "high", "low", "close")


def window_audit(
    bars: DataFrame, keys: Sequence[str], clocks: Sequence[str] = AUDIT_CLOCKS, base_seconds: int = BASE_SECONDS
) -> DataFrame:
    """Per derived window: inputs seen, expected and on grid; complete? valid?

    Every bar is binned for all clocks in one pass, and the counts combine on the map
    side, so the table is read once instead of once per clock.
    Gaps are a diagnosis; only off-grid inputs make a window invalid.
    """
    at, kind = F.col("availability_time"), bars.schema["availability_time"].dataType.simpleString()
    bins = F.array(
        *[
            F.struct(
                F.lit(tf).alias("tf"),
                (week_end_of_day(at, kind) if tf == "1w" else bin_end(at, CLOCK_SECONDS[tf], kind)).alias("window_end"),
                F.lit(CLOCK_SECONDS[tf] // base_seconds).alias("expected_count"),
            )
            for tf in clocks
        ]
    )
    grid = on_grid(F.col("open_time"), base_seconds)
    return (
        bars.select(*keys, "open_time", grid.alias("_grid"), F.inline(bins))
        .groupBy(*keys, "tf", "window_end", "expected_count")
        .agg(
            F.count("*").alias("observed_count"),
            F.count_if("_grid").alias("on_grid_count"),
            F.min("open_time").alias("first_input_open_time"),
            F.max("open_time").alias("last_input_open_time"),
        )
        .withColumn("complete", F.col("observed_count") == F.col("expected_count"))
        .withColumn("valid", F.col("on_grid_count") == F.col("observed_count"))
    )


def gap_windows(audit: DataFrame) -> DataFrame:
    """Incomplete windows: reported, never excluded."""
    return audit.filter(~F.col("complete")).withColumn("status", F.lit("GAP_COUNT_DIAGNOSTIC_ONLY")).drop("complete", "valid")


def quarantined_windows(audit: DataFrame) -> DataFrame:
    """Windows with off-grid inputs: to be kept out of any roll-up."""
    return audit.filter(~F.col("valid")).withColumn("reason", F.lit("OFF_GRID_INPUT")).drop("complete", "valid")


def without_quarantined(rolled: DataFrame, audit: DataFrame, keys: Sequence[str], tf: str) -> DataFrame:
    bad = quarantined_windows(audit.filter(F.col("tf") == tf)).select(
        *keys, F.col("window_end").alias("availability_time")
    )
    return rolled.join(bad, [*keys, "availability_time"], "left_anti")


def window_summary(audit: DataFrame, keys: Sequence[str]) -> DataFrame:
    return audit.groupBy(*keys, "tf").agg(
        F.count("*").alias("windows"),
        F.count_if("valid").alias("valid_windows"),
        F.count_if(~F.col("valid")).alias("invalid_windows"),
        F.count_if(~F.col("complete")).alias("gap_windows"),
        F.avg(F.col("valid").cast("double")).alias("valid_rate"),
    )


def integrity_audit(
    bars: DataFrame,
    keys: Sequence[str],
    arrival: str = "src_order",
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """One row per series: rows, extent, duplicates, order, envelope, prices, range, verdict.

    Works on raw and on normalised bars alike; run it on both, since duplicates and
    disorder can only be seen before they are repaired.
    """
    at = F.col("open_time")
    outside = F.lit(False)
    if start is not None:
        outside = outside | (at < start)
    if end is not None:
        outside = outside | (at >= end)
    stamps = bars.groupBy(*keys, "open_time").agg(
        F.count("*").alias("n"),
        F.count_if(envelope_broken()).alias("envelope"),
        F.count_if(any_nonpositive()).alias("nonpositive"),
        F.count_if(outside).alias("outside"),
    )
    facts = stamps.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.min(at).alias("first_open"),
        F.max(at).alias("last_open"),
        F.sum(F.col("n") - 1).alias("duplicate_timestamps"),
        F.sum("envelope").alias("envelope_failures"),
        F.sum("nonpositive").alias("nonpositive_rows"),
        F.sum("outside").alias("out_of_range_rows"),
    )
    order = out_of_order(bars.select(*keys, "open_time", arrival), keys, "open_time", arrival)
    failed = ["duplicate_timestamps", "envelope_failures", "nonpositive_rows", "out_of_range_rows"]
    worst = F.greatest(*[F.col(c) for c in failed], F.col("out_of_order"))
    return (
        facts.join(order, list(keys))
        .withColumn("status", F.when(worst > 0, "FAIL").otherwise("PASS"))
        .withColumn("monotonic", F.col("out_of_order") == 0)
        .drop("out_of_order")
    )


def gap_rows(
    bars: DataFrame, keys: Sequence[str], tf_seconds: int = BASE_SECONDS, seconds: int = BAR_CHUNK_SECONDS
) -> DataFrame:
    """Every step between neighbouring bars that is not exactly one clock length."""
    rows = previous_row(bars.select(*keys, "open_time"), keys, ["open_time"], ["open_time"], seconds)
    apart = (micros(F.col("open_time")) - micros(F.col("prev.open_time"))) / F.lit(1e6)
    return (
        rows.withColumn("gap_seconds", apart)
        .filter(F.col("gap_seconds") != tf_seconds)
        .select(
            *keys,
            F.col("prev.open_time").alias("previous_open_time"),
            F.col("open_time").alias("next_open_time"),
            "gap_seconds",
            F.greatest(F.bround(F.col("gap_seconds") / F.lit(float(tf_seconds))).cast("long") - 1, F.lit(0)).alias("missing_bars"),
            on_grid(F.col("open_time"), tf_seconds).alias("next_on_grid"),
        )
    )


def gap_totals(gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return gaps.groupBy(*keys).agg(
        F.count_if(F.col("missing_bars") > 0).alias("gap_events"),
        F.sum("missing_bars").alias("missing_intervals"),
        F.max("gap_seconds").alias("max_gap_seconds"),
    )


def _paired(derived: DataFrame, native: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = derived.select(*keys, "availability_time", F.col("bars").alias("base_count"), *[F.col(c).alias(f"derived_{c}") for c in OHLC])
    n = native.select(*keys, "availability_time", *[F.col(c).alias(f"native_{c}") for c in OHLC])
    both = d.join(n, [*keys, "availability_time"])
    return both.withColumns({f"absdiff_{c}": F.abs(F.col(f"derived_{c}") - F.col(f"native_{c}")) for c in OHLC})


def _differs(tolerance: float) -> Column:
    return F.greatest(*[f"absdiff_{c}" for c in OHLC]) > tolerance


def parity_summary(
    derived: DataFrame, native: DataFrame, keys: Sequence[str], tolerance: float = PRICE_TOLERANCE
) -> DataFrame:
    """Common bars of derived and native candles, and how many disagree."""
    return (
        _paired(derived, native, keys)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("common_bars"),
            F.count_if(_differs(tolerance)).alias("mismatch_bars"),
            F.max(F.greatest(*[f"absdiff_{c}" for c in OHLC])).alias("max_absdiff"),
        )
        .withColumn("match_rate", 1 - F.col("mismatch_bars") / F.col("common_bars"))
    )


def parity_mismatch(
    derived: DataFrame, native: DataFrame, keys: Sequence[str], expected: int, tolerance: float = PRICE_TOLERANCE
) -> DataFrame:
    return (
        _paired(derived, native, keys)
        .filter(_differs(tolerance))
        .withColumn("expected_count", F.lit(expected))
        .withColumn("incomplete", F.col("base_count") != expected)
    )
