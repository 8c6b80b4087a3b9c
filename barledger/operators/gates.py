"""Source coverage, source gates and their roll-up to one verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barledger.checks import IntegrityError
from barledger.functions.clock import DENSE_LIMIT_SECONDS, calendar, clock_seconds
from barledger.functions.predicates import truthy

# The status and scope texts, and how far a monitor looks back.
MONITOR_LOOKBACK_DAYS = 8
WAITING_PUBLICATION = "WAITING_SOURCE_ARCHIVE_PUBLICATION"
WAITING_FIRST_BAR = "WAITING_FIRST_COMPLETED_NATIVE_BAR"
WAITING_NO_DAY = "WAITING_NO_COMPLETED_POST_FREEZE_UTC_DAY"
WAITING_STATE_BAR = "WAITING_FIRST_COMPLETED_STATE_BAR"
PASS_WAITING = "PASS_WITH_EXPECTED_EARLY_WAITING_INTERVALS"
FULL_SCOPE = "FULL_REBUILD_COMPLETE_FORWARD_POOL"
MONITOR_SCOPE = "MONITOR_BOUNDED_OVERLAP_NOT_COMPLETE_FORWARD_POOL"
ELIGIBLE_STATUSES = ("PASS", PASS_WAITING)
WAITING_STATUSES = (WAITING_NO_DAY, WAITING_PUBLICATION, WAITING_STATE_BAR)


def coverage_failures(manifest: DataFrame, keys: Sequence[str], expected: DataFrame, step: str) -> DataFrame:
    """Rows (keys, period, reason) for everything wrong with a source manifest.

    ``manifest``: keys, period, status, remote_sha256, local_sha256.
    ``expected``: keys, first, last; a period absent from the manifest counts as missing.
    """
    ok = F.col("status") == "ok"
    first_good = manifest.groupBy(*keys).agg(F.min(F.when(ok, F.col("period"))).alias("first_good"))
    wanted = calendar(expected, step)
    seen = wanted.join(manifest, [*keys, "period"], "left").join(first_good, list(keys), "left")
    absent = seen.filter(
        F.col("first_good").isNotNull() & (F.col("period") >= F.col("first_good")) & ~F.coalesce(ok, F.lit(False))
    ).select(*keys, "period", F.lit("MISSING_PERIOD_AFTER_FIRST_GOOD").alias("reason"))
    broken = manifest.filter(ok & (F.lower("remote_sha256") != F.lower("local_sha256"))).select(
        *keys, "period", F.lit("CHECKSUM_MISMATCH_IN_MANIFEST").alias("reason")
    )
    no_period = F.lit(None).cast(manifest.schema["period"].dataType).alias("period")
    never = (
        expected.join(first_good, list(keys), "left")
        .filter(F.col("first_good").isNull())
        .select(*keys, no_period, F.lit("NO_DATA_FOR_SERIES").alias("reason"))
    )
    return absent.unionByName(broken).unionByName(never)


def is_dense(interval: Column) -> Column:
    return F.coalesce(clock_seconds(interval) <= DENSE_LIMIT_SECONDS, F.lit(False))


def classify_periods(
    series: DataFrame, manifest: DataFrame, keys: Sequence[str], start: Column, end_day: Column
) -> DataFrame:
    """Status of every (series, day): present, or why its absence is or is not a fault."""
    days = calendar(series.select(*keys, start.alias("first"), end_day.alias("last")))
    seen = days.join(manifest.select(*keys, "period", "rows"), [*keys, "period"], "left")
    status = (
        F.when(F.col("rows").isNotNull(), "OK")
        .when(~is_dense(F.col("interval")), "404_SPARSE_INTERVAL_NO_BAR_OPEN_ON_DAY")
        .when(F.col("period") == end_day, WAITING_PUBLICATION)
        .otherwise("FAIL_MISSING_EXPECTED_DENSE_ARCHIVE")
    )
    return seen.withColumn("status", status)


def series_gate(periods: DataFrame, audit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series. ``audit``: keys, eligible_rows, hard_failures (may lack series).

    A missing last day outranks valid older rows, so stale data cannot look green.
    """
    facts = periods.groupBy(*keys).agg(
        F.count_if(F.col("status") == "OK").alias("files"),
        F.count_if(F.col("status") == WAITING_PUBLICATION).alias("end_day_missing"),
        F.count_if(F.col("status").startswith("FAIL")).alias("hard_source_gaps"),
    )
    both = facts.join(audit, list(keys), "left").fillna(0, ["eligible_rows", "hard_failures"])
    late = F.col("end_day_missing") > 0
    status = (
        F.when(F.col("hard_failures") > 0, "FAIL")
        .when(late, WAITING_PUBLICATION)
        .when((F.col("files") == 0) & is_dense(F.col("interval")), "FAIL_NO_SOURCE_ROWS")
        .when(F.col("eligible_rows") == 0, WAITING_FIRST_BAR)
        .otherwise("PASS")
    )
    return both.withColumn("status", status)


def overall_gate(series: DataFrame, by: Sequence[str], expected_series: int | None = None) -> DataFrame:
    """FAIL before publication waiting before early waiting before PASS."""
    out = series.groupBy(*by).agg(
        F.count("*").alias("series"),
        F.count_if(F.col("status").startswith("FAIL")).alias("hard_failed_series"),
        F.sum("hard_source_gaps").alias("hard_source_gap_count"),
        F.count_if(F.col("end_day_missing") > 0).alias("publication_missing"),
        F.count_if(F.col("status").startswith("WAITING")).alias("waiting_series"),
    )
    short = F.lit(False) if expected_series is None else F.col("series") != expected_series
    status = (
        F.when(short | (F.col("hard_failed_series") > 0) | (F.col("hard_source_gap_count") > 0), "FAIL")
        .when(F.col("publication_missing") > 0, WAITING_PUBLICATION)
        .when(F.col("waiting_series") > 0, PASS_WAITING)
        .otherwise("PASS")
    )
    return out.withColumn("status", status)


def waits_for_first_day(source: str, cutoff: Column, end_day: Column, freeze: Column) -> Column:
    """Each source has its own rule for the freeze day itself."""
    if source == "native":
        return end_day <= F.date_trunc("day", freeze)
    if source == "state":
        return cutoff <= freeze
    raise IntegrityError(f"unknown source kind: {source}")


def integrity_failures(audit: DataFrame, required: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, reason): required series that are absent or failed their audit."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_seen").isNull(), "MISSING_REQUIRED_SERIES"),
            F.when(F.col("duplicate_timestamps") > 0, "DUPLICATE_TIMESTAMPS"),
            F.when(F.col("_seen").isNotNull() & ~truthy(F.coalesce(F.col("monotonic").cast("string"), F.lit("true"))), "NON_MONOTONIC_TIMESTAMPS"),
            F.when(F.col("envelope_failures") > 0, "OHLC_ENVELOPE_FAILURE"),
        )
    )
    return (
        required.select(*keys).distinct()
        .join(audit.withColumn("_seen", F.lit(1)), list(keys), "left")
        .select(*keys, F.explode(reasons).alias("reason"))
    )


def final_gate(hard_failures: DataFrame, parity: DataFrame) -> DataFrame:
    """One row: eligible when nothing hard failed; parity is reported, never blocking."""
    facts = hard_failures.select(F.lit(1).alias("hard"), F.lit(0).cast("long").alias("bars")).unionAll(
        parity.select(F.lit(0).alias("hard"), F.col("mismatch_bars").alias("bars"))
    )
    return (
        facts.agg(
            F.count_if(F.col("hard") == 1).alias("hard_failures"),
            F.count_if(F.col("bars") > 0).alias("parity_mismatch_groups"),
            F.coalesce(F.sum("bars"), F.lit(0)).alias("parity_mismatch_bars"),
        )
        .withColumn("eligible", F.col("hard_failures") == 0)
        .withColumn("status", F.when(F.col("eligible"), "PASS").otherwise("FAIL"))
    )


def _off(flag: str) -> Column:
    return F.coalesce(F.col(flag) == F.lit(False), F.lit(False))


def readiness(gates: DataFrame, state_gates: DataFrame, key: str = "dataset") -> DataFrame:
    """Readiness per dataset from its source gate and its state-only gate.

    Errors come first, then waiting, then blocking, as a row with its reason; a missing
    state-only gate blocks.
    """
    s = state_gates.select(key, *[F.col(c).alias(f"s_{c}") for c in state_gates.columns if c != key], F.lit(True).alias("_has_state"))
    both = gates.join(s, key, "left")
    waiting = lambda c: F.coalesce(F.col(c).isin(*WAITING_STATUSES), F.lit(False))
    eligible = lambda c: F.coalesce(F.col(c).isin(*ELIGIBLE_STATUSES), F.lit(False))
    same = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    reason = (
        F.when(~_off("performance_evaluation_allowed"), "ERROR_PERFORMANCE_NOT_DISABLED")
        .when(~_off("judgement_allowed"), "ERROR_JUDGEMENT_NOT_DISABLED")
        .when(~same("mode", "full"), "ERROR_MODE_NOT_FULL")
        .when(~same("data_scope", FULL_SCOPE), "ERROR_SCOPE_NOT_COMPLETE")
        .when(waiting("status"), "WAITING_SOURCE_DATA")
        .when(~eligible("status"), "ERROR_GATE_NOT_ELIGIBLE")
        .when(F.col("_has_state").isNull(), "BLOCKED_STATE_SOURCE_NOT_BOUND")
        .when(~_off("s_performance_evaluation_allowed"), "ERROR_STATE_PERFORMANCE_NOT_DISABLED")
        .when(~_off("s_judgement_allowed"), "ERROR_STATE_JUDGEMENT_NOT_DISABLED")
        .when(~same("s_mode", "full"), "ERROR_STATE_MODE_NOT_FULL")
        .when(~same("s_data_scope", FULL_SCOPE), "ERROR_STATE_SCOPE_NOT_COMPLETE")
        .when(~same("s_state_only", True), "ERROR_STATE_SOURCE_NOT_STATE_ONLY")
        .when(~_off("s_price_use_allowed"), "ERROR_STATE_PRICE_USE_NOT_DISABLED")
        .when(waiting("s_status"), "WAITING_SOURCE_DATA")
        .when(~eligible("s_status"), "ERROR_STATE_GATE_NOT_ELIGIBLE")
        .otherwise("READY_FOR_FROZEN_PRODUCER")
    )
    out = both.withColumn("reason", reason)
    verdict = F.split("reason", "_")[0]
    return out.select(
        key, "reason", verdict.alias("readiness"), F.lit(True).alias("performance_embargo_active")
    )


def monitor_scope(bars: DataFrame, end: Column, lookback_days: int = MONITOR_LOOKBACK_DAYS) -> DataFrame:
    """The bounded overlap a monitor run reads, tagged so it is never taken for the pool."""
    at = F.col("availability_time")
    recent = at > end - F.expr(f"interval {lookback_days} days")
    return bars.filter(recent & (at <= end)).withColumn("data_scope", F.lit(MONITOR_SCOPE))
