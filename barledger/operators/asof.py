"""As-of lookups: the last state known at a bar's availability time.

Spark has no public as-of join, so states and bars are unioned and the last state is
carried forward. The scan is chunked (see ``ordered``): one shuffle by (series, chunk)
plus one summary row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barledger.operators.ordered import (
    BAR_CHUNK_SECONDS,
    CHUNK,
    attach,
    chunk_window,
    earlier_chunks,
    with_chunk,
)

_ORDER = ["_t", "_side", "_seq"]


def _one_line(
    bars: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    at: str,
    bar_cols: Sequence[str],
    state_cols: Sequence[str],
    seconds: int,
) -> DataFrame:
    """Bars and states on one time line; at equal instants states come first."""
    bar = F.struct(*bar_cols)
    state = F.struct(*state_cols)
    left = bars.select(
        *keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_seq"),
        bar.alias("_bar"),
    )
    right = states.select(
        *keys, F.col("ts").alias("_t"), F.lit(0).alias("_side"), F.col("seq").cast("long").alias("_seq"),
        state.alias("_state"),
    )
    line = with_chunk(left.unionByName(right, allowMissingColumns=True), keys, "_t", seconds)
    w = chunk_window(keys, _ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("_known", F.last("_state", ignorenulls=True).over(w))


def asof_states(
    bars: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    state_cols: Sequence[str],
    at: str = "availability_time",
    seconds: int = BAR_CHUNK_SECONDS,
) -> DataFrame:
    """Bars plus ``state_cols`` of the last state with ts <= ``at``; null before the first."""
    bar_cols = [c for c in bars.columns if c not in keys]
    line = _one_line(bars, states, keys, at, bar_cols, state_cols, seconds)
    tails = line.groupBy(*keys, CHUNK).agg(
        F.max_by("_state", F.when(F.col("_side") == 0, F.struct("_t", "_seq"))).alias("_tail")
    )
    inherited = tails.select(
        *keys, CHUNK, F.last("_tail", ignorenulls=True).over(earlier_chunks(keys)).alias("_in")
    )
    bars_only = line.filter(F.col("_side") == 1)
    return (
        attach(bars_only, inherited, keys)
        .withColumn("_now", F.coalesce("_known", "_in"))
        .select(*keys, "_bar.*", *[F.col(f"_now.{c}").alias(c) for c in state_cols])
    )


def bars_with_history(
    bars: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    state_cols: Sequence[str],
    seconds: int = BAR_CHUNK_SECONDS,
) -> DataFrame:
    """Bars with the state known now and at each of the two bars before.

    Adds structs ``now``, ``prev`` and ``prev2``, each (state_cols..., close); ``prev``
    and ``prev2`` are null where there is no such bar, and missing states count as 0.
    One chunked scan yields all three, so ledgers need no further look-back. The chunk
    summary keeps whole bars, so both branches shuffle the same columns and Spark reuses
    one exchange.
    """
    bar_cols = ["open_time", "availability_time", "open", "close"]
    line = _one_line(bars, states, keys, "availability_time", bar_cols, state_cols, seconds)
    before = chunk_window(keys, _ORDER).rowsBetween(Window.unboundedPreceding, -1)
    is_bar = F.col("_side") == 1
    line = line.withColumn(
        "_b1",
        F.last(F.when(is_bar, F.struct(F.col("_known"), F.col("_bar.close").alias("close"))), ignorenulls=True).over(before),
    ).withColumn("_b2", F.last(F.when(is_bar, F.col("_b1")), ignorenulls=True).over(before))

    when_bar = F.when(is_bar, F.col("_t"))
    tails = line.groupBy(*keys, CHUNK).agg(
        F.max_by("_state", F.when(~is_bar, F.struct("_t", "_seq"))).alias("_tail"),
        F.max_by(F.struct("_known", "_bar"), when_bar).alias("_row"),
        F.max_by("_b1", when_bar).alias("_t2"),
    )
    past = earlier_chunks(keys)

    def settled(bar: Column) -> Column:
        """A bar's state once the state inherited by its chunk is known."""
        return F.when(
            bar.isNotNull(),
            F.struct(F.coalesce(bar["_known"], F.col("_in")).alias("_known"), bar["close"].alias("close")),
        )

    inherited = (
        tails.withColumn("_in", F.last("_tail", ignorenulls=True).over(past))
        .withColumn(
            "_t1",
            F.when(F.col("_row").isNotNull(), F.struct(F.col("_row._known"), F.col("_row._bar.close").alias("close"))),
        )
        .withColumn("_s1", settled(F.col("_t1")))
        .withColumn("_c1", F.last("_s1", ignorenulls=True).over(past))
        .withColumn("_s2", F.when(F.col("_t1").isNotNull(), F.struct(F.coalesce(settled(F.col("_t2")), F.col("_c1")).alias("v"))))
        .withColumn("_c2", F.last("_s2", ignorenulls=True).over(past)["v"])
        .select(*keys, CHUNK, "_in", "_c1", "_c2")
    )

    def plain(bar: Column) -> Column:
        fields = [F.coalesce(bar["_known"][c], F.lit(0)).alias(c) for c in state_cols]
        return F.when(bar.isNotNull(), F.struct(*fields, bar["close"].alias("close")))

    rows = attach(line.filter(is_bar), inherited, keys)
    here = F.struct(F.coalesce("_known", "_in").alias("_known"), F.col("_bar.close").alias("close"))
    one = F.coalesce(settled(F.col("_b1")), F.col("_c1"))
    two = (
        F.when(F.col("_b2").isNotNull(), settled(F.col("_b2")))
        .when(F.col("_b1").isNotNull(), F.col("_c1"))
        .otherwise(F.col("_c2"))
    )
    return rows.select(
        *keys, CHUNK, "_bar.*", plain(here).alias("now"), plain(one).alias("prev"), plain(two).alias("prev2")
    )


def align_timelines(
    a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], seconds: int = BAR_CHUNK_SECONDS
) -> DataFrame:
    """Two timelines on the union of their clocks: a_<col> and b_<col> at every instant.

    Each side keeps its last row per instant; values are carried forward, null before
    the first. Both sides share one scan.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys, F.col("ts").alias("_t")).agg(
            F.max_by(F.struct(*cols), "seq").alias(name)
        )

    instants = (
        side(a, "_a").unionByName(side(b, "_b"), allowMissingColumns=True)
        .groupBy(*keys, "_t")
        .agg(F.first("_a", ignorenulls=True).alias("_a"), F.first("_b", ignorenulls=True).alias("_b"))
    )
    line = with_chunk(instants, keys, "_t", seconds)
    w = chunk_window(keys, ["_t"]).rowsBetween(Window.unboundedPreceding, 0)
    local = line.withColumns({f"_l{s}": F.last(f"_{s}", ignorenulls=True).over(w) for s in "ab"})
    tails = line.groupBy(*keys, CHUNK).agg(
        *[F.max_by(f"_{s}", F.when(F.col(f"_{s}").isNotNull(), F.col("_t"))).alias(f"_t{s}") for s in "ab"]
    )
    past = earlier_chunks(keys)
    inherited = tails.select(
        *keys, CHUNK, *[F.last(f"_t{s}", ignorenulls=True).over(past).alias(f"_i{s}") for s in "ab"]
    )
    out = attach(local, inherited, keys)
    return out.select(
        *keys,
        F.col("_t").alias("ts"),
        *[F.coalesce(f"_l{s}", f"_i{s}")[c].alias(f"{s}_{c}") for s in "ab" for c in cols],
    )
