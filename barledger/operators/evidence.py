"""Evidence: invariants, divergence segments, epochs, labels and floors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barledger.checks import require_columns, unpivot_counts, violations
from barledger.functions.predicates import log_return
from barledger.operators.ledger import net_of_cost
from barledger.operators.ordered import BAR_CHUNK_SECONDS, previous_row, running

# The frozen evidence floor, the cost grid and the 15-minute year.
MIN_DAYS, MIN_SEGMENTS, MIN_EPOCHS = 180, 6, 3
COST_GRID = (7.0, 9.0, 12.0)
BARS_PER_YEAR_15M = 96 * 365.25
INSUFFICIENT = "INSUFFICIENT_EXTERNAL_MECHANISM_EVIDENCE"
SUPPORT = "EXTERNAL_MECHANISM_SUPPORT"
ADVERSE = "ADVERSE_EXTERNAL_MECHANISM_EVIDENCE"
MIXED = "MIXED_EXTERNAL_MECHANISM_EVIDENCE"


def _status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))


def _pair_rules(a: Column, b: Column, da: Column, db: Column, names: Sequence[str]) -> dict[str, Column]:
    """Direction equal, long occupancy equal, B never extra short, only A-short / B-flat."""
    rules = (
        da != db,
        (a == 1) != (b == 1),
        (b == -1) & (a != -1),
        (a != b) & ~((a == -1) & (b == 0)),
    )
    return dict(zip(names, rules))


def state_invariants(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Checks on two timelines on their union clock (a_side, b_side, a_direction, b_direction)."""
    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    rules = _pair_rules(
        zero("a_side"), zero("b_side"), zero("a_direction"), zero("b_direction"),
        ["major_direction_identical", "long_core_occupancy_identical", "candidate_b_never_extra_short",
         "only_A_short_B_flat_state_divergence"],
    )
    return _status(violations(aligned, keys, rules))


def executed_invariants(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same checks on two executed ledgers (open_time, held_exposure, direction).

    A full outer join on the clock: rows without a partner are clock failures.
    """
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(
            *keys, "open_time", F.lit(1).alias(f"_{s}"),
            F.col("held_exposure").alias(f"{s}_held"), F.col("direction").alias(f"{s}_dir"),
        )

    both = side(a, "a").join(side(b, "b"), [*keys, "open_time"], "full")
    rules = {"execution_clock_identical": F.col("_a").isNull() | F.col("_b").isNull()}
    rules |= _pair_rules(
        F.col("a_held"), F.col("b_held"), F.col("a_dir"), F.col("b_dir"),
        ["executed_major_direction_identical", "executed_long_occupancy_identical",
         "candidate_b_never_extra_executed_short", "only_A_short_B_flat_executed_divergence"],
    )
    return _status(violations(both, keys, rules))


def flip_violations(timeline: DataFrame, keys: Sequence[str], side: str, seconds: int = BAR_CHUNK_SECONDS) -> DataFrame:
    """Direct long/short flips, and exit plus re-entry at one instant, of one side column."""
    rows = previous_row(timeline, keys, ["ts", "seq"], [side, "ts"], seconds)
    before, here = F.coalesce(F.col(f"prev.{side}"), F.lit(0)), F.col(side)
    changed = here != before
    marked = rows.withColumn("_exit", (changed & (before != 0)).cast("int")).withColumn(
        "_entry", (changed & (here != 0)).cast("int")
    )
    per_instant = marked.groupBy(*keys, "ts").agg(
        F.sum(((before * here) == -1).cast("int")).alias("flips"),
        F.sum("_exit").alias("exits"),
        F.sum("_entry").alias("entries"),
    )
    counts = per_instant.groupBy(*keys).agg(
        F.sum("flips").alias("direct_flip"),
        F.count_if((F.col("exits") > 0) & (F.col("entries") > 0)).alias("exit_and_entry_same_instant"),
    )
    return unpivot_counts(counts, keys, ["direct_flip", "exit_and_entry_same_instant"])


def numbered_rows(rows: DataFrame, keys: Sequence[str], seconds: int = BAR_CHUNK_SECONDS) -> DataFrame:
    """Execution rows with running segment, bear-epoch and bull-epoch numbers."""
    out = running(
        rows, keys, ["availability_time"],
        {
            "segment_no": ("sum", F.col("segment_start")),
            "_bear": ("sum", F.col("bear_start")),
            "_bull": ("sum", F.col("bull_start")),
        },
        seconds,
    )
    numbers = {
        "bear_epoch_id": F.when(F.col("direction") == -1, F.col("_bear")),
        "bull_epoch_id": F.when(F.col("direction") == 1, F.col("_bull")),
    }
    return out.withColumns(numbers).drop("_bear", "_bull")


def bear_epochs(numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extent of every numbered run of bear direction on the execution clock."""
    return (
        numbered.filter(F.col("bear_epoch_id").isNotNull())
        .groupBy(*keys, "bear_epoch_id")
        .agg(F.min("open_time").alias("first_open"), F.max("open_time").alias("last_open"), F.count("*").alias("bars"))
    )


def divergence_segments(
    numbered: DataFrame, keys: Sequence[str], costs: Sequence[float] = (7.0,)
) -> DataFrame:
    """From the first differing bar through the bar where A and B meet again.

    All costs come out of one aggregation: the grid widens the row, not the shuffle. A bar
    where they differ in another way than A short, B flat stops the job.
    """
    legal = (F.col("a_held") == F.col("b_held")) | ((F.col("a_held") == -1) & (F.col("b_held") == 0))
    refused = F.raise_error(F.concat(F.lit("illegal divergence at "), F.col("open_time").cast("string")))
    sums = []
    for i, bps in enumerate(costs):
        for side in "ab":
            sums.append(F.sum(log_return(net_of_cost(side, float(bps)))).alias(f"_{side}{i}"))
    at_start = F.when(F.col("segment_start") == 1, F.col("bear_epoch_id"))
    grouped = (
        numbered.filter(F.col("in_segment") & F.when(F.coalesce(legal, F.lit(False)), True).otherwise(refused))
        .groupBy(*keys, F.col("segment_no").alias("segment_id"))
        .agg(
            F.max(at_start).alias("bear_epoch_id"),
            F.min("open_time").alias("start"),
            F.max("open_time").alias("end"),
            F.count("*").alias("bars"),
            *sums,
        )
    )
    options = F.array(
        *[
            F.struct(
                F.lit(float(bps)).alias("cost_bps"),
                F.col(f"_a{i}").alias("a_log_return"),
                F.col(f"_b{i}").alias("b_log_return"),
                (F.col(f"_b{i}") - F.col(f"_a{i}")).alias("paired_delta_log"),
            )
            for i, bps in enumerate(costs)
        ]
    )
    out = grouped.select(
        *keys, "segment_id", "bear_epoch_id", "start", "end", "bars", F.explode(options).alias("_o")
    )
    return out.select(*[c for c in out.columns if c != "_o"], "_o.*").withColumn(
        "b_better", F.col("paired_delta_log") > 0
    )


def close_segments(ledger: DataFrame, keys: Sequence[str], seconds: int = BAR_CHUNK_SECONDS) -> DataFrame:
    """Segments of a close-to-close ledger: the differing rows only."""
    rows = running(ledger, keys, ["timestamp"], {"segment_id": ("sum", F.col("segment_start"))}, seconds)
    out = (
        rows.filter("divergent")
        .groupBy(*keys, "segment_id")
        .agg(
            F.min("timestamp").alias("start"),
            F.max("timestamp").alias("end"),
            F.sum("a_log_net").alias("a_log_return"),
            F.sum("b_log_net").alias("b_log_return"),
        )
    )
    return out.withColumn("paired_delta_log", F.col("b_log_return") - F.col("a_log_return"))


def epochs(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments summed per bear epoch; segments outside any epoch do not form one."""
    out = (
        segments.filter(F.col("bear_epoch_id").isNotNull())
        .groupBy(*keys, "bear_epoch_id")
        .agg(F.count("*").alias("segments"), F.sum("paired_delta_log").alias("paired_delta_log"))
    )
    return out.withColumn("b_better", F.col("paired_delta_log") > 0)


def _epoch_sums(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (series, epoch) sums, with one row for segments outside any epoch."""
    return segments.groupBy(*keys, "bear_epoch_id").agg(
        F.count("*").alias("segments"), F.sum("paired_delta_log").alias("delta")
    )


def leave_one_out(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total paired delta without each epoch in turn; robust when the least stays positive."""
    sums = _epoch_sums(segments, keys)
    total = sums.groupBy(*keys).agg(F.sum("delta").alias("total"))
    return (
        sums.filter(F.col("bear_epoch_id").isNotNull())
        .join(total, list(keys))
        .select(
            *keys, F.col("bear_epoch_id").alias("dropped_bear_epoch_id"),
            (F.col("total") - F.col("delta")).alias("remaining_paired_delta_log"),
        )
    )


def mechanism_label(
    segments: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    floor: tuple[int, int, int] = (MIN_DAYS, MIN_SEGMENTS, MIN_EPOCHS),
) -> DataFrame:
    """One labelled row per scenario, also for scenarios without any segment.

    ``spans`` (keys, first_at, last_at) lists the scenarios; see ``bar_spans``.
    The smallest leave-one-out remainder is total minus the largest epoch.
    """
    in_epoch = F.col("bear_epoch_id").isNotNull()
    per = _epoch_sums(segments, keys).groupBy(*keys).agg(
        F.sum("segments").alias("divergence_segments"),
        F.count_if(in_epoch).alias("bear_epochs"),
        F.sum("delta").alias("total_paired_delta_log"),
        F.count_if(in_epoch & (F.col("delta") > 0)).alias("positive_epochs"),
        F.max(F.when(in_epoch, F.col("delta"))).alias("_largest"),
    )
    out = spans.join(per, list(keys), "left").fillna(
        0, ["divergence_segments", "bear_epochs", "positive_epochs"]
    ).fillna(0.0, ["total_paired_delta_log"])
    total, n, pos = F.col("total_paired_delta_log"), F.col("bear_epochs"), F.col("positive_epochs")
    days = (F.unix_micros(F.col("last_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / F.lit(86400e6)
    neg = F.col("negative_epochs")
    enough = (F.col("history_days") >= floor[0]) & (F.col("divergence_segments") >= floor[1]) & (n >= floor[2])
    return (
        out.withColumn("history_days", days)
        .withColumn("negative_epochs", n - pos)
        .withColumn(
            "label",
            F.when(~enough, INSUFFICIENT)
            .when((total > 0) & (pos * 3 >= n * 2), SUPPORT)
            .when((total < 0) & (neg * 2 > n), ADVERSE)
            .otherwise(MIXED),
        )
        .withColumn("loeo_min_remaining", total - F.col("_largest"))
        .withColumn(
            "loeo_status",
            F.when(F.col("loeo_min_remaining") > 0, "LOEO_ROBUST_POSITIVE").otherwise("LOEO_CONCENTRATED_OR_SIGN_UNSTABLE"),
        )
        .drop("_largest", "first_at", "last_at")
    )


def bar_spans(bars: DataFrame, keys: Sequence[str], costs: Sequence[float] = ()) -> DataFrame:
    """History extent per series, or per (series, cost) when costs are given."""
    at = F.col("availability_time")
    spans = bars.groupBy(*keys).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    if not costs:
        return spans
    return spans.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs])))


def venue_consistency(labels: DataFrame, locked: Mapping[str, str], key: str) -> DataFrame:
    """Compare labels with the labels locked on another venue (a small fixed lookup)."""
    pairs = [F.lit(v) for kv in locked.items() for v in kv]
    expected = F.try_element_at(F.create_map(*pairs), F.col(key))
    return labels.withColumn("locked_label", expected).withColumn(
        "venue_consistency",
        F.when(F.col("label") == INSUFFICIENT, "VENUE_EVIDENCE_INSUFFICIENT")
        .when(F.col("label") == F.col("locked_label"), "VENUE_CONSISTENT")
        .otherwise("VENUE_SENSITIVE"),
    )


def information_floor(
    ledger: DataFrame,
    keys: Sequence[str],
    freeze: Column,
    floor: tuple[int, int, int] = (MIN_DAYS, MIN_SEGMENTS, MIN_EPOCHS),
    series: DataFrame | None = None,
    seconds: int = BAR_CHUNK_SECONDS,
) -> DataFrame:
    """Counts only, never performance: forward days, segments, distinct epochs.

    ``series`` lists series that must be reported even when they have no row yet.
    """
    require_columns(ledger, [*keys, "timestamp", "a_core", "b_core", "bear_epoch_id"])
    rows = previous_row(
        ledger.select(*keys, "timestamp", (F.col("a_core") != F.col("b_core")).cast("int").alias("apart"),
                      F.col("bear_epoch_id").cast("string").alias("bear_epoch_id")),
        keys, ["timestamp"], ["apart"], seconds,
    )
    start = (F.col("apart") == 1) & (F.coalesce(F.col("prev.apart"), F.lit(0)) == 0)
    counts = (
        rows.groupBy(*keys, F.when(F.col("apart") == 1, F.col("bear_epoch_id")).alias("_epoch"))
        .agg(F.max("timestamp").alias("last_at"), F.count_if(start).alias("n"))
        .groupBy(*keys)
        .agg(
            F.max("last_at").alias("last_observation"),
            F.sum("n").alias("divergence_segments"),
            F.count("_epoch").alias("independent_bear_epochs"),
        )
    )
    if series is not None:
        counts = series.join(counts, list(keys), "left")
    days = (F.unix_micros(F.col("last_observation").cast("timestamp")) - F.unix_micros(freeze.cast("timestamp"))) / F.lit(86400e6)
    out = (
        counts.withColumn("forward_days", F.greatest(F.coalesce(days, F.lit(0.0)), F.lit(0.0)))
        .fillna(0, ["divergence_segments", "independent_bear_epochs"])
        .withColumn("duration_met", F.col("forward_days") >= floor[0])
        .withColumn("segments_met", F.col("divergence_segments") >= floor[1])
        .withColumn("epochs_met", F.col("independent_bear_epochs") >= floor[2])
        .withColumn("performance_release_allowed", F.col("duration_met") & F.col("segments_met") & F.col("epochs_met"))
    )
    allowed = F.col("performance_release_allowed")
    return (
        out.withColumn("min_forward_days", F.lit(floor[0]))
        .withColumn("min_divergence_segments", F.lit(floor[1]))
        .withColumn("min_bear_epochs", F.lit(floor[2]))
        .withColumn("status", F.when(allowed, "ELIGIBLE_FOR_FROZEN_EVALUATOR").otherwise("INSUFFICIENT_FORWARD_EVIDENCE"))
        .withColumn("performance", F.lit(None).cast("double"))
        .withColumn("next_action", F.when(allowed, "RUN_SEPARATELY_FROZEN_EVALUATOR").otherwise("KEEP_PERFORMANCE_EMBARGOED"))
    )


def forward_violations(ledger: DataFrame, keys: Sequence[str], freeze: Column) -> DataFrame:
    """What forbids a forward state ledger from being counted."""
    sides = ("CORE_LONG", "CORE_SHORT", "FLAT")

    def bad(c: str) -> Column:
        return ~F.coalesce(F.col(c).isin(*sides), F.lit(False))

    rows = violations(
        ledger, keys,
        {"invalid_timestamp": F.col("timestamp").isNull(), "at_or_before_freeze": F.col("timestamp") <= freeze,
         "invalid_a_core": bad("a_core"), "invalid_b_core": bad("b_core")},
    )
    copies = (
        ledger.groupBy(*keys, "timestamp").agg(F.count("*").alias("n"))
        .groupBy(*keys).agg(F.sum(F.col("n") - 1).alias("duplicate_timestamp"))
        .unpivot(list(keys), ["duplicate_timestamp"], "check", "failures")
    )
    return rows.unionByName(copies)


def performance_summary(ledger: DataFrame, keys: Sequence[str], bars_per_year: float) -> DataFrame:
    """One row per scenario of an additive ledger."""
    net = F.col("net_return")
    out = ledger.groupBy(*keys).agg(
        F.count("*").alias("bars"),
        (F.max_by("equity", "availability_time") - 1).alias("total_return"),
        F.sum("log_net").alias("log_return"),
        F.avg(net).alias("_mean"),
        F.stddev_samp(net).alias("_std"),
        F.min("drawdown").alias("max_drawdown"),
        F.sum("turnover").alias("turnover_units"),
        F.sum("trade_cost").alias("cost_drag_sum"),
        F.avg((F.col("held_exposure") != 0).cast("double")).alias("active_fraction"),
    )
    vol = F.nullif(F.col("_std") * F.lit(bars_per_year**0.5), F.lit(0.0))
    return out.withColumn("sharpe_0rf", F.col("_mean") * bars_per_year / vol).drop("_mean", "_std")
