"""Ordered scans that never put a whole series into one task.

A window over ``partitionBy(series)`` sends a series that holds a third of all rows
to a single task. Every scan here works in two phases instead:

1. each series is cut into time chunks of a fixed width, and the scan runs inside
   ``(series, chunk)``, which is also the shuffle key;
2. each chunk leaves a one-row summary; the summaries of a series (time span divided
   by chunk width, so a few thousand rows) are scanned in order and what a chunk
   inherits from earlier ones is joined back on ``(series, chunk)``.

The join side is one row per chunk. Rows already lie by ``(series, chunk)``, so the
join moves only the summaries, and Spark broadcasts them when they are small.
The chunk number depends on the row alone, so a recomputed task agrees with the
first attempt.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barledger.functions.clock import micros

CHUNK = "_chunk"
DAY = 86400
# A series has one bar per clock tick: 30 days hold 2,880 bars of 15 minutes and at most
# 2.6 million of one second.
BAR_CHUNK_SECONDS = 30 * DAY
# Events have no clock; plans measure their table (``suggest_chunk_seconds``) and pass the
# width on. This is only the default of the bare operators.
TICK_CHUNK_SECONDS = DAY
# Most rows one (series, chunk) may hold when the width is measured.
CHUNK_ROWS = 65_536


def chunk_of(ts: Column, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000))


def strict(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Refuse rows without a series or an instant: the job stops, no row is dropped.

    The filter after it never removes anything; it tells the optimizer the columns are
    set, so both branches of a scan keep the same plan and share one exchange.
    """
    whole = df.withColumns(
        {n: F.coalesce(F.col(n), F.raise_error(F.lit(f"null {n} in an ordered scan"))) for n in names}
    )
    return whole.filter(reduce(and_, [F.col(n).isNotNull() for n in names]))


def with_chunk(df: DataFrame, keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """Add the chunk number unless an earlier scan of the same plan already did."""
    if CHUNK in df.columns:
        return df
    chunked = strict(df, [*keys, ts]).withColumn(CHUNK, chunk_of(F.col(ts), seconds))
    return chunked.filter(F.col(CHUNK).isNotNull())


def with_ordinal_chunk(df: DataFrame, keys: Sequence[str], ordinal: str, rows: int = 1_000_000) -> DataFrame:
    """Chunks for scans in arrival order: a bounded number of rows each.

    A struct ordinal (file, block, row) is chunked by everything but its last field,
    that is by file block, whose size Spark bounds when it splits files.
    """
    if CHUNK in df.columns:
        return df
    kind = df.schema[ordinal].dataType
    df = strict(df, [*keys, ordinal])
    if isinstance(kind, StructType):
        return df.withColumn(CHUNK, F.struct(*[F.col(ordinal)[n] for n in kind.names[:-1]]))
    return df.withColumn(CHUNK, F.floor(F.col(ordinal) / F.lit(rows)))


def suggest_chunk_seconds(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    max_rows: int = CHUNK_ROWS,
    widths: Sequence[int] = (365 * DAY, 30 * DAY, DAY, 3600, 900, 60, 1),
) -> int:
    """Widest chunk whose fullest (series, chunk) stays within ``max_rows``.

    One scan: rows are counted at the finest width, combining on the map side, and the
    counts are rolled up to every other width; one number per width reaches the driver.
    Below one second the width stops: instants are microseconds and a valid event table
    holds each (series, instant, type) once.
    """
    at = chunk_of(F.col(ts), min(widths)).alias("_fine")
    fine = df.groupBy(*keys, at).agg(F.count("*").alias("_n"))
    tops = None
    for width in widths:
        chunk = F.floor(F.col("_fine") * min(widths) / F.lit(width)).alias("_w")
        top = fine.groupBy(*keys, chunk).agg(F.sum("_n").alias("_n")).agg(F.lit(width).alias("width"), F.max("_n").alias("rows"))
        tops = top if tops is None else tops.unionByName(top)
    fits = [r["width"] for r in tops.collect() if r["rows"] is None or r["rows"] <= max_rows]
    return max(fits, default=min(widths))


def _order_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _last_of(cols: Sequence[str], order: Sequence[str], prefix: str = "") -> list[Column]:
    """One max_by per column: fixed-width buffers keep the aggregate on the hash path."""
    key = _order_key(order)
    return [F.max_by(F.col(c), key).alias(f"{prefix}{c}") for c in cols]


def chunk_window(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def earlier_chunks(keys: Sequence[str]) -> Window:
    return (
        Window.partitionBy(*keys)
        .orderBy(CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def attach(rows: DataFrame, inherited: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join chunk inheritance back. Every chunk has a summary row, so no row is lost."""
    return rows.join(inherited, [*keys, CHUNK])


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    seconds: int = BAR_CHUNK_SECONDS,
    name: str = "prev",
) -> DataFrame:
    """Add struct ``name`` with ``cols`` of the row before, null on the first row.

    The chunk summary (its last row) is taken from the input before any shuffle, so
    only one row per map task and chunk travels for it.
    """
    rows = with_chunk(df, keys, order[0], seconds)
    tails = rows.groupBy(*keys, CHUNK).agg(*_last_of(cols, order))
    inherited = tails.select(
        *keys,
        CHUNK,
        F.lag(F.struct(*cols)).over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_carry"),
    )
    local = rows.withColumn("_local", F.lag(F.struct(*cols)).over(chunk_window(keys, order)))
    return (
        attach(local, inherited, keys)
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry")
    )


def previous_two_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    seconds: int = BAR_CHUNK_SECONDS,
) -> DataFrame:
    """Add structs ``prev`` and ``prev2``: the row before and the one before that.

    A chunk's summary is its whole last row, so that the summary branch reads the very
    columns the main branch shuffles and Spark reuses that exchange.
    """
    w = chunk_window(keys, order)
    here = F.struct(*cols)
    rows = with_chunk(df, keys, order[0], seconds)
    row = F.struct(*[c for c in rows.columns if c not in keys and c != CHUNK])
    local = rows.withColumn("_p1", F.lag(here, 1).over(w)).withColumn("_p2", F.lag(here, 2).over(w))
    key = _order_key(order)
    tails = local.groupBy(*keys, CHUNK).agg(
        F.max_by(row, key).alias("_row"), F.max_by(F.col("_p1"), key).alias("_t2")
    )
    tails = tails.withColumn("_t1", F.struct(*[F.col(f"_row.{c}").alias(c) for c in cols]))
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    inherited = (
        tails.withColumn("_c1", F.lag("_t1").over(by_chunk))
        .withColumn("_t2", F.coalesce("_t2", "_c1"))
        .select(*keys, CHUNK, "_c1", F.lag("_t2").over(by_chunk).alias("_c2"))
    )
    return (
        attach(local, inherited, keys)
        .withColumn(
            "prev2",
            F.when(F.col("_p2").isNotNull(), F.col("_p2"))
            .when(F.col("_p1").isNotNull(), F.col("_c1"))
            .otherwise(F.col("_c2")),
        )
        .withColumn("prev", F.coalesce("_p1", "_c1"))
        .drop("_p1", "_p2", "_c1", "_c2")
    )


_START = {"sum": 0, "product": 1.0}


def _fold(kind: str, col: Column) -> Column:
    return {"sum": F.sum, "product": F.product, "max": F.max}[kind](col)


def _join_parts(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + here
    if kind == "product":
        return F.coalesce(before, F.lit(1.0)) * here
    return F.greatest(before, here)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Mapping[str, tuple[str, Column]],
    seconds: int = BAR_CHUNK_SECONDS,
) -> DataFrame:
    """Add running ``sum`` / ``product`` / ``max`` columns up to and including each row."""
    rows = with_chunk(df, keys, order[0], seconds)
    totals = rows.groupBy(*keys, CHUNK).agg(
        *[_fold(kind, col).alias(f"_tot_{name}") for name, (kind, col) in specs.items()]
    )
    past = earlier_chunks(keys)
    inherited = totals.select(
        *keys,
        CHUNK,
        *[_fold(kind, F.col(f"_tot_{name}")).over(past).alias(f"_in_{name}") for name, (kind, _) in specs.items()],
    )
    w = chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns(
        {f"_here_{name}": _fold(kind, col).over(w) for name, (kind, col) in specs.items()}
    )
    joined = attach(local, inherited, keys)
    out = joined.withColumns(
        {
            name: _join_parts(kind, F.col(f"_in_{name}"), F.col(f"_here_{name}"))
            for name, (kind, _) in specs.items()
        }
    )
    return out.drop(*[f"_in_{n}" for n in specs], *[f"_here_{n}" for n in specs])


def equity_curve(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    factor: Column,
    seconds: int = BAR_CHUNK_SECONDS,
) -> DataFrame:
    """Add ``equity`` (running product), ``peak`` (its running maximum) and ``drawdown``.

    One pass gives all three: a chunk is summed up by its product and the highest
    partial product inside it, which scale with whatever equity the chunk starts from.
    """
    w = chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = (
        with_chunk(df, keys, order[0], seconds)
        .withColumn("_eq", F.product(factor).over(w))
        .withColumn("_pk", F.max("_eq").over(w))
    )
    past = earlier_chunks(keys)
    inherited = (
        local.groupBy(*keys, CHUNK)
        .agg(F.max_by("_eq", _order_key(order)).alias("_all"), F.max("_eq").alias("_top"))
        .withColumn("_eq_in", F.coalesce(F.product("_all").over(past), F.lit(1.0)))
        .withColumn("_pk_in", F.max(F.col("_eq_in") * F.col("_top")).over(past))
        .select(*keys, CHUNK, "_eq_in", "_pk_in")
    )
    eq_in = F.coalesce("_eq_in", F.lit(1.0))
    return (
        attach(local, inherited, keys)
        .withColumn("equity", eq_in * F.col("_eq"))
        .withColumn("peak", F.greatest(F.col("_pk_in"), eq_in * F.col("_pk")))
        .withColumn("drawdown", F.try_divide("equity", "peak") - 1)
        .drop("_eq", "_pk", "_eq_in", "_pk_in")
    )
