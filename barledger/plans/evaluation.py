"""The analytic flow from events and bars to labels.

    events -> A/B states -> (written) timeline -> as-of bars -> execution rows
           -> segments -> epochs -> label per cost

The timeline is a published table: it is written once and read by every later step,
so the event fold never runs twice. Invariants are checked before any performance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barledger.checks import fail_closed
from barledger.operators import evidence
from barledger.operators.asof import asof_states
from barledger.operators.campaign import ab_timeline, ab_trace
from barledger.operators.ledger import (
    STATE_COLUMNS,
    by_candidate,
    execution_rows,
    next_open_ledger,
    scenario_ledger,
)
from barledger.operators.ordered import BAR_CHUNK_SECONDS, suggest_chunk_seconds
from barledger.session import materialise


def published_timeline(events: DataFrame, keys: Sequence[str], seconds: int | None = None) -> DataFrame:
    """Fold the events once and write the numeric state columns.

    Without a given chunk width the event table is measured first.
    """
    width = seconds or suggest_chunk_seconds(events, keys, "ts")
    return materialise(ab_timeline(ab_trace(events, keys, seconds=width), keys), "timeline")


def line_width(timeline: DataFrame, keys: Sequence[str]) -> int:
    """Chunk width for scans over bars and states together: bounded for both."""
    return min(BAR_CHUNK_SECONDS, suggest_chunk_seconds(timeline, keys, "ts"))


def published_rows(bars: DataFrame, timeline: DataFrame, keys: Sequence[str], seconds: int | None = None) -> DataFrame:
    """Numbered execution rows, written once for every report made from them."""
    width = seconds or line_width(timeline, keys)
    rows = execution_rows(bars, timeline, keys, width)
    return materialise(evidence.numbered_rows(rows, keys, width), "execution")


def published_ledger(
    bars: DataFrame, timeline: DataFrame, keys: Sequence[str], costs: Sequence[float] = (7.0,), seconds: int | None = None
) -> DataFrame:
    """The additive ledger of every (series, candidate, cost), from written execution rows."""
    width = seconds or line_width(timeline, keys)
    return scenario_ledger(published_rows(bars, timeline, keys, width), keys, costs, width)


def target_bars(bars: DataFrame, timeline: DataFrame, keys: Sequence[str], seconds: int | None = None) -> DataFrame:
    """Execution bars (candidate, timestamp, open, close, target_exposure) from known states."""
    seconds = seconds or line_width(timeline, keys)
    known = asof_states(bars, timeline, keys, STATE_COLUMNS, seconds=seconds)
    options = F.array(
        *[
            F.struct(
                F.lit(s.upper()).alias("candidate"),
                F.coalesce(F.col(f"{s}_side"), F.lit(0)).cast("double").alias("target_exposure"),
            )
            for s in "ab"
        ]
    )
    return known.select(
        *keys, F.col("availability_time").alias("timestamp"), "open", "close", F.inline(options)
    )


def final_equity(bars: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What did each rule set earn per series? Compounded next-open ledger, 7 bp one way."""
    timeline = published_timeline(events, keys)
    scenario = [*keys, "candidate"]
    ledger = next_open_ledger(target_bars(bars, timeline, keys), scenario)
    return ledger.groupBy(*scenario).agg(
        F.count("*").alias("bars"),
        F.max_by("equity", "timestamp").alias("equity"),
        F.sum("turnover").alias("turnover"),
    )


def evaluate(
    bars: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    costs: Sequence[float] = evidence.COST_GRID,
    event_seconds: int | None = None,
    bar_seconds: int | None = None,
) -> dict[str, DataFrame]:
    """All evidence tables of one venue; raises before performance when an invariant fails."""
    timeline = published_timeline(events, keys, event_seconds)
    states = timeline.select(*keys, "ts", "a_side", "b_side", F.col("direction").alias("a_direction"), F.col("direction").alias("b_direction"))
    fail_closed(evidence.state_invariants(states, keys), "state invariants")
    rows = published_rows(bars, timeline, keys, bar_seconds)
    options = by_candidate(rows, keys, costs[:1])
    a = options.filter("candidate = 'A'")
    b = options.filter("candidate = 'B'")
    checks = evidence.executed_invariants(a, b, keys)
    fail_closed(checks, "executed invariants")
    segments = evidence.divergence_segments(rows, keys, costs)
    by_cost = [*keys, "cost_bps"]
    return {
        "invariants": checks,
        "segments": segments,
        "epochs": evidence.epochs(segments, by_cost),
        "leave_one_out": evidence.leave_one_out(segments, by_cost),
        "labels": evidence.mechanism_label(segments, evidence.bar_spans(bars, keys, costs), by_cost),
    }
