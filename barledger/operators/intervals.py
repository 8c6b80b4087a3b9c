"""Points in windows of any width, as an equi-join.

A window belongs to the class of the power of two that its length reaches, and lies in at
most two bins of that width. A point lies in one bin of each class that occurs, of which
there are at most 63. Points and windows meet on (keys, class, bin), and the test of the
ends is all that is left to do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barledger.functions.clock import micros


def points_in_windows(points: DataFrame, windows: DataFrame, keys: Sequence[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Every point with every window [start, end) of its series that holds it: columns of both.

    Ends lie on no grid and windows may overlap, nest or repeat. A window that ends before
    or where it starts, or lacks an end, holds nothing. Columns of ``windows`` but the keys
    must be named otherwise than those of ``points``.
    """
    length = micros(F.col(end)) - micros(F.col(start))
    classed = windows.where(length > 0).withColumn("_class", F.length(F.bin(length - 1)))
    classes = [r["_class"] for r in classed.select("_class").distinct().collect()]
    at_bin = lambda c: F.expr(f"shiftright({c}, _class)")
    held = (
        classed.withColumns({"_a": micros(F.col(start)), "_b": micros(F.col(end)) - 1})
        .withColumn("_bin", F.explode(F.array_distinct(F.array(at_bin("_a"), at_bin("_b"))))).drop("_a", "_b")
    )
    spread = (
        points.withColumns({"_at": micros(F.col(at)), "_class": F.explode(F.array(*map(F.lit, classes)).cast("array<int>"))})
        .withColumn("_bin", at_bin("_at")).drop("_at")
    )
    met = spread.join(held, [*keys, "_class", "_bin"])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_class", "_bin")


def bars_in_windows(bars: DataFrame, windows: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Bars that open inside any of the windows, each once."""
    found = points_in_windows(bars, windows.select(*keys, start, end).distinct(), keys, "open_time", start, end)
    return found.drop(start, end).dropDuplicates([*keys, "open_time"])
