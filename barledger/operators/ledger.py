"""Wealth ledgers. Three of them, which differ in compounding and in when cost falls:

* ``next_open_ledger``: gap, cost and intrabar legs compound; cost at the fill.
* ``execution_rows`` / ``candidate_ledger``: legs add up; cost at the fill; A and B together.
* ``close_ledger``: close to close; cost on the decision bar.

They must not be merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barledger.checks import IntegrityError, require_columns, violations
from barledger.functions.predicates import finite_double, log_return
from barledger.operators.asof import bars_with_history
from barledger.operators.campaign import core_exposure
from barledger.operators.ordered import (
    BAR_CHUNK_SECONDS,
    CHUNK,
    equity_curve,
    previous_row,
    previous_two_rows,
)

STATE_COLUMNS = ("a_side", "b_side", "direction", "at_risk")


def _prior(struct: str, field: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(struct)[field].cast("double"), F.lit(default))


def execution_bars(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Typed execution bars: UTC instant and finite doubles (null where not finite)."""
    require_columns(df, [*keys, "timestamp", "open", "close", "target_exposure"])
    return df.select(
        *keys, "timestamp", *[finite_double(F.col(c)).alias(c) for c in ("open", "close", "target_exposure")]
    )


def ledger_violations(
    df: DataFrame, keys: Sequence[str], fee_bps: float = 7.0, slippage_bps: float = 0.0
) -> DataFrame:
    """Rows (keys, check, failures) for everything that forbids publishing a ledger."""
    if fee_bps < 0 or slippage_bps < 0:
        raise IntegrityError("cost assumptions must be non-negative")
    bars = execution_bars(df, keys)
    values = violations(
        bars,
        keys,
        {
            "invalid_timestamp": F.col("timestamp").isNull(),
            "non_finite_input": F.col("open").isNull() | F.col("close").isNull() | F.col("target_exposure").isNull(),
            "nonpositive_price": (F.col("open") <= 0) | (F.col("close") <= 0),
        },
    )
    copies = (
        bars.groupBy(*keys, "timestamp").agg(F.count("*").alias("n"))
        .groupBy(*keys).agg(F.sum(F.col("n") - 1).alias("duplicate_timestamp"))
        .unpivot(list(keys), ["duplicate_timestamp"], "check", "failures")
    )
    dated = bars.filter(F.col("timestamp").isNotNull())  # undated bars are counted above
    legs = _legs(dated, keys, fee_bps + slippage_bps, BAR_CHUNK_SECONDS)
    wealth = violations(
        legs,
        keys,
        {
            "cost_takes_all": F.col("trade_cost") >= 1,
            "negative_wealth": (1 + F.col("gap_return_component") < 0) | (1 + F.col("intrabar_return_component") < 0),
        },
    )
    return values.unionByName(copies).unionByName(wealth)


def _legs(bars: DataFrame, keys: Sequence[str], bps: float, seconds: int) -> DataFrame:
    rows = previous_two_rows(bars, keys, ["timestamp"], ["timestamp", "target_exposure", "close"], seconds)
    held = _prior("prev", "target_exposure")
    old = _prior("prev2", "target_exposure")
    gap = old * (F.try_divide(F.col("open"), F.col("prev.close")) - 1)
    intra = F.when(F.col("prev").isNull(), 0.0).otherwise(held * (F.try_divide("close", "open") - 1))
    return rows.withColumns(
        {
            "held_exposure": held,
            "turnover": F.abs(held - old),
            "trade_cost": F.abs(held - old) * (bps / 10000.0),
            "gap_return_component": F.coalesce(gap, F.lit(0.0)),
            "intrabar_return_component": intra,
        }
    )


def _refused(legs: DataFrame) -> DataFrame:
    """The legs, or a stop at the first one that no ledger may be built on."""
    faults = {
        "non-finite or missing input": F.col("open").isNull() | F.col("close").isNull() | F.col("target_exposure").isNull(),
        "a price that is not positive": (F.col("open") <= 0) | (F.col("close") <= 0),
        "two bars at one instant": F.coalesce(F.col("prev.timestamp") == F.col("timestamp"), F.lit(False)),
        "a cost that takes all": F.col("trade_cost") >= 1,
        "negative wealth": (1 + F.col("gap_return_component") < 0) | (1 + F.col("intrabar_return_component") < 0),
    }
    turnover = F.col("turnover")
    for fault, found in reversed(faults.items()):  # the first fault named is the one that is reported
        stop = F.raise_error(F.concat(F.lit(f"ledger refused, {fault} at "), F.col("timestamp").cast("string"))).cast("double")
        turnover = F.when(found, stop).otherwise(turnover)
    return legs.withColumn("turnover", turnover)


def next_open_ledger(
    df: DataFrame,
    keys: Sequence[str],
    fee_bps: float = 7.0,
    slippage_bps: float = 0.0,
    seconds: int = BAR_CHUNK_SECONDS,
) -> DataFrame:
    """Targets known at a close fill at the next observed open; wealth legs compound.

    Bad input stops the job: missing or non-finite values, prices that are not positive,
    two bars at one instant, a cost that takes all, and a leg below zero wealth.
    ``ledger_violations`` counts the same faults as rows.
    """
    if fee_bps < 0 or slippage_bps < 0:
        raise IntegrityError("cost assumptions must be non-negative")
    legs = _refused(_legs(execution_bars(df, keys), keys, fee_bps + slippage_bps, seconds))
    gap = 1 + F.col("gap_return_component")
    intra = 1 + F.col("intrabar_return_component")
    first = F.col("prev").isNull()
    stepped = legs.withColumn("gross_factor", gap * intra).withColumn(
        "net_return", F.when(first, 0.0).otherwise(gap * (1 - F.col("trade_cost")) * intra - 1)
    )
    out = equity_curve(stepped, keys, ["timestamp"], 1 + F.col("net_return"), seconds)
    return out.select(
        *keys, "timestamp", "open", "close", "target_exposure", "held_exposure", "turnover", "trade_cost",
        "gap_return_component", "intrabar_return_component", "gross_factor", "net_return", "equity",
    )


def execution_rows(
    bars: DataFrame, timeline: DataFrame, keys: Sequence[str], seconds: int = BAR_CHUNK_SECONDS
) -> DataFrame:
    """One row per bar with held exposure, turnover and gross return of A and of B.

    A and B share bars and events, so they stay side by side in one row: the pair join
    of two ledgers, and half of the shuffle, fall away. Starts of divergences and of
    bear or bull epochs are flagged here too, since they look back the same two bars.
    """
    rows = bars_with_history(bars, timeline, keys, STATE_COLUMNS, seconds)
    gap = F.try_divide("open", F.col("prev.close")) - 1
    intra = F.try_divide("close", "open") - 1
    sides = {}
    for side in "ab":
        new, old = _prior("prev", f"{side}_side"), _prior("prev2", f"{side}_side")
        sides |= {
            f"{side}_target": F.col(f"now.{side}_side").cast("double"),
            f"{side}_held": new,
            f"{side}_turnover": F.abs(new - old),
            f"{side}_gross": F.when(F.col("prev").isNull(), 0.0).otherwise(old * gap + new * intra),
        }
    apart = _prior("prev", "a_side") != _prior("prev", "b_side")
    apart_before = _prior("prev2", "a_side") != _prior("prev2", "b_side")
    bear = F.col("now.direction") == -1
    bear_before = F.coalesce(F.col("prev.direction") == -1, F.lit(False))
    bull = F.col("now.direction") == 1
    bull_before = F.coalesce(F.col("prev.direction") == 1, F.lit(False))
    flags = {
        "direction": F.col("now.direction"),
        "at_risk": F.col("now.at_risk") == 1,
        "divergent": apart,
        "in_segment": apart | apart_before,
        "segment_start": (apart & ~apart_before).cast("int"),
        "bear_start": (bear & ~bear_before).cast("int"),
        "bull_start": (bull & ~bull_before).cast("int"),
    }
    return rows.withColumns(sides | flags).drop("now", "prev", "prev2")


def net_of_cost(side: str, bps: float | Column) -> Column:
    rate = bps / 10000.0 if isinstance(bps, float) else bps / F.lit(10000.0)
    return F.col(f"{side}_gross") - F.col(f"{side}_turnover") * rate


def by_candidate(rows: DataFrame, keys: Sequence[str], costs: Sequence[float]) -> DataFrame:
    """Execution rows as (candidate, cost) scenarios; a fixed number of copies per row."""
    options = F.array(
        *[
            F.struct(
                F.lit(side.upper()).alias("candidate"),
                F.lit(float(bps)).alias("cost_bps"),
                F.col(f"{side}_target").alias("target_exposure"),
                F.col(f"{side}_held").alias("held_exposure"),
                F.col(f"{side}_turnover").alias("turnover"),
                F.col(f"{side}_gross").alias("gross_return"),
                (F.col(f"{side}_turnover") * F.lit(bps / 10000.0)).alias("trade_cost"),
                net_of_cost(side, float(bps)).alias("net_return"),
            )
            for side in "ab"
            for bps in costs
        ]
    )
    shared = ["open_time", "availability_time", "open", "close", "direction", "at_risk"]
    shared += [c for c in ("bear_epoch_id", "bull_epoch_id") if c in rows.columns]
    wide = rows.select(*keys, CHUNK, *shared, F.explode(options).alias("_o"))
    return wide.select(*keys, CHUNK, *shared, "_o.*")


def candidate_ledger(
    bars: DataFrame,
    timeline: DataFrame,
    keys: Sequence[str],
    costs: Sequence[float] = (7.0,),
    seconds: int = BAR_CHUNK_SECONDS,
) -> DataFrame:
    """The additive ledger per (series, candidate, cost) with equity and drawdown."""
    return scenario_ledger(execution_rows(bars, timeline, keys, seconds), keys, costs, seconds)


def scenario_ledger(
    rows: DataFrame, keys: Sequence[str], costs: Sequence[float] = (7.0,), seconds: int = BAR_CHUNK_SECONDS
) -> DataFrame:
    """The same from execution rows that already exist."""
    rows = by_candidate(rows, keys, costs)
    scenario = [*keys, "candidate", "cost_bps"]
    out = equity_curve(rows, scenario, ["availability_time"], 1 + F.col("net_return"), seconds)
    return out.withColumn("log_net", log_return(F.col("net_return"))).drop(CHUNK, "peak")


def close_ledger(
    df: DataFrame, keys: Sequence[str], round_trip_bps: float = 14.0, seconds: int = BAR_CHUNK_SECONDS
) -> DataFrame:
    """Close-to-close ledger of two core columns (timestamp, close, a_core, b_core)."""
    require_columns(df, [*keys, "timestamp", "close", "a_core", "b_core"])
    half = round_trip_bps / 2 / 10000.0
    typed = df.select(
        *keys,
        "timestamp",
        F.col("close").cast("double").alias("close"),
        "a_core",
        "b_core",
        core_exposure(F.col("a_core")).cast("double").alias("a_exposure"),
        core_exposure(F.col("b_core")).cast("double").alias("b_exposure"),
    )
    rows = previous_row(typed, keys, ["timestamp"], ["close", "a_exposure", "b_exposure"], seconds)
    ret = F.coalesce(F.try_divide("close", F.col("prev.close")) - 1, F.lit(0.0))
    out = rows.withColumn("pct_change", ret)
    for side in "ab":
        old = _prior("prev", f"{side}_exposure")
        net = old * ret - F.abs(F.col(f"{side}_exposure") - old) * half
        out = out.withColumn(f"{side}_log_net", log_return(net))
    apart = F.col("a_core") != F.col("b_core")
    apart_before = F.coalesce(F.col("prev.a_exposure") != F.col("prev.b_exposure"), F.lit(False))
    return (
        out.withColumn("divergent", apart)
        .withColumn("segment_start", (apart & ~apart_before).cast("int"))
        .drop("prev")
    )
