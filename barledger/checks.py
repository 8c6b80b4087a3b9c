"""Fail-closed checks: schema checks on the driver, row checks as one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """Input that must not be used was refused."""


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise IntegrityError(f"missing columns: {missing}")
    return df


def violations(
    df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]
) -> DataFrame:
    """Rows (keys, check, failures): how many rows of each key break each rule."""
    counts = df.groupBy(*keys).agg(
        *[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in rules.items()]
    )
    return unpivot_counts(counts, keys, list(rules))


def unpivot_counts(
    counts: DataFrame, keys: Sequence[str], names: Sequence[str]
) -> DataFrame:
    return counts.unpivot(list(keys), list(names), "check", "failures")


def fail_closed(found: DataFrame, what: str) -> None:
    """Run the check now; raise with a bounded sample of reasons when any rule fired."""
    bad = found.filter(F.col("failures") > 0)
    sample = bad.limit(20).collect()
    if sample:
        reasons = "; ".join(str(r.asDict()) for r in sample)
        raise IntegrityError(f"{what}: {reasons}")
