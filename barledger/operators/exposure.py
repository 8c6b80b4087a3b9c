"""Risk allocation: state rows and policies to exposure legs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barledger.checks import IntegrityError

LEGS = (
    "core_long", "core_short", "hedge_short", "gross_exposure",
    "net_exposure", "gross_scale", "applied_reduce_fraction", "authorized_hedge_fraction",
)


@dataclass(frozen=True)
class Policy:
    """One capital policy: how much to hold, to cut and to hedge."""

    policy_id: str
    core_unit: float = 1.0
    reduce_fraction: float = 0.0
    hedge_fractions: Mapping[str, float] = field(default_factory=dict)
    gross_cap: float | None = None

    def __post_init__(self) -> None:
        within = [0 <= x <= 1 for x in (self.reduce_fraction, *self.hedge_fractions.values())]
        if not 0 < self.core_unit <= 1 or not all(within) or "" in self.hedge_fractions:
            raise IntegrityError(f"policy outside its limits: {self}")
        if self.gross_cap is not None and self.gross_cap <= 0:
            raise IntegrityError(f"gross cap must be positive: {self}")

    def as_column(self) -> Column:
        pairs = [F.lit(v) for kv in self.hedge_fractions.items() for v in kv]
        return F.struct(
            F.lit(self.policy_id).alias("policy_id"),
            F.lit(float(self.core_unit)).alias("core_unit"),
            F.lit(float(self.reduce_fraction)).alias("reduce_fraction"),
            F.create_map(*pairs).cast("map<string,double>").alias("hedge_fractions"),
            F.lit(self.gross_cap).cast("double").alias("gross_cap"),
        )


def policy_violations(policies: DataFrame) -> DataFrame:
    """Policies that break their own limits, with reasons."""
    unit, cut, cap = F.col("core_unit"), F.col("reduce_fraction"), F.col("gross_cap")
    fractions = F.coalesce(F.map_values("hedge_fractions"), F.array().cast("array<double>"))
    names = F.coalesce(F.map_keys("hedge_fractions"), F.array().cast("array<string>"))
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce((unit > 0) & (unit <= 1), F.lit(False)), "core_unit"),
            F.when(~F.coalesce((cut >= 0) & (cut <= 1), F.lit(False)), "reduce_fraction"),
            F.when(cap.isNotNull() & (cap <= 0), "gross_cap"),
            F.when(F.exists(names, lambda n: n == ""), "hedge_reason_name"),
            F.when(F.exists(fractions, lambda x: ~F.coalesce((x >= 0) & (x <= 1), F.lit(False))), "hedge_fraction"),
        )
    )
    return policies.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def _authorized(reasons: Column, fractions: Column) -> Column:
    granted = F.array_max(F.transform(F.array_distinct(reasons), lambda r: F.try_element_at(fractions, r)))
    return F.coalesce(granted, F.lit(0.0))


def allocate(states: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """Every state under every policy; unknown hedge reasons or sides mark the row refused.

    Policies are parameters, so they widen each row in place: nothing is joined.
    """
    rows = states.select("*", F.inline(F.array(*[p.as_column() for p in policies])))
    side = F.upper("core_side")
    fractions = F.coalesce(F.col("hedge_fractions"), F.create_map().cast("map<string,double>"))
    reasons = F.coalesce(F.col("hedge_reasons"), F.array().cast("array<string>"))
    is_long, is_short = side == "LONG", side == "SHORT"
    unknown = is_long & F.exists(reasons, lambda r: ~F.map_contains_key(fractions, r))
    refused = F.when(~side.isin("LONG", "SHORT", "FLAT") | side.isNull(), "unknown_side").when(unknown, "unknown_hedge_reason")
    cut = F.when(is_long & F.col("reduced"), F.col("reduce_fraction")).otherwise(0.0)
    asked = F.when(is_long, _authorized(reasons, fractions)).otherwise(0.0)
    core = F.when(is_long, F.col("core_unit") * (1 - F.col("applied_reduce_fraction"))).otherwise(0.0)
    hedge = F.least(F.col("authorized_hedge_fraction"), F.col("_core"))
    gross = F.col("_core") + F.col("_hedge")
    capped = is_long & F.col("gross_cap").isNotNull() & (gross > F.col("gross_cap"))
    scale = F.when(capped, F.col("gross_cap") / gross).otherwise(1.0)
    legs = (
        rows.withColumn("refused", refused)
        .withColumn("applied_reduce_fraction", cut)
        .withColumn("authorized_hedge_fraction", asked)
        .withColumn("_core", core)
        .withColumn("_hedge", hedge)
        .withColumn("gross_scale", scale)
        .withColumn("core_long", F.col("_core") * F.col("gross_scale"))
        .withColumn("hedge_short", F.col("_hedge") * F.col("gross_scale"))
        .withColumn("core_short", F.when(is_short, F.col("core_unit")).otherwise(0.0))
        .withColumn("gross_exposure", F.when(is_short, F.col("core_unit")).when(capped, F.col("gross_cap")).otherwise(gross))
        .withColumn(
            "net_exposure",
            F.when(is_short, -F.col("core_unit")).otherwise(F.greatest(F.col("core_long") - F.col("hedge_short"), F.lit(0.0))),
        )
    )
    for leg in LEGS:
        legs = legs.withColumn(leg, F.when(F.col("refused").isNull(), F.col(leg)))
    return legs.drop("_core", "_hedge")


def allocation_columns(extra: Sequence[str]) -> list[str]:
    return [*extra, *LEGS, "refused"]
