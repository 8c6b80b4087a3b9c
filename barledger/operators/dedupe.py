"""Keep-last, duplicates and arrival order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barledger.operators.ordered import previous_row, with_ordinal_chunk


def dedupe_last(df: DataFrame, keys: Sequence[str], arrival: str = "src_order") -> DataFrame:
    """The last row in arrival order for every key.

    An aggregate, not a ranking window: copies of one key combine on the map side, so a
    key with very many copies never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("_last"))
    return kept.select(*keys, "_last.*").select(*df.columns)


def union_periods(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate per-period tables of one shape, keeping which period a row came from."""
    tagged = [f.withColumn("period_no", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for nxt in tagged[1:]:
        out = out.unionByName(nxt, allowMissingColumns=True)
    return out


def out_of_order(df: DataFrame, keys: Sequence[str], ts: str, arrival: str) -> DataFrame:
    """Rows per key whose timestamp is before that of the row arriving just before."""
    seen = previous_row(with_ordinal_chunk(df, keys, arrival), keys, [arrival], [ts], name="_before")
    return seen.groupBy(*keys).agg(
        F.count_if(F.coalesce(F.col(ts) < F.col(f"_before.{ts}"), F.lit(False))).alias("out_of_order")
    )
