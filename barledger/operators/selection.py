"""Exact order statistics of groups of any size, in bounded memory.

Each pass counts the values of a group in BINS equal parts of the range that holds the
wanted rank, combined per task, and goes on in the part where the rank lies, between the
smallest and the largest value there. A range that holds at most FEW values is settled by
sorting them. No buffer ever holds a group, and a group with most of the rows is spread
over SALTS keys wherever rows meet its range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barledger.session import materialise

BINS = 1024
FEW = 4096
SALTS = 16


def exact_medians(rows: DataFrame, keys: Sequence[str], value: str, name: str = "median", few: int = FEW) -> DataFrame:
    """(keys, median) of the values that are not null: the middle one, or the mean of the two in the middle.

    Values are finite doubles; a group of nulls has a null median. Keys may be null.
    """
    keys = list(keys)
    typed = rows.select(*keys, F.col(value).cast("double").alias("_x"))
    written = materialise(typed.withColumn("_s", F.pmod(F.xxhash64("_x"), F.lit(SALTS))), "selection")
    groups = written.groupBy(*keys).agg(F.count("_x").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    # Two wanted ranks a group, counted from 0; the same one when the number is odd.
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("_n") - 1) / 2).alias("rank")),
                              F.struct(F.lit(1).alias("which"), F.floor(F.col("_n") / 2).alias("rank"))))
    wanted = materialise(groups.select(*keys, "_n", "_low", "_high", ranks.alias("_r")).select(
        *keys, F.col("_r.which").alias("_which"), F.col("_r.rank").alias("_rank"), F.col("_n").alias("_count"), "_low", "_high"), "ranks")

    def near(state: DataFrame) -> DataFrame:
        """Values within the range of each wanted rank."""
        spread = state.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        w = spread.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_which", "_rank", "_low", "_high", F.col("_s").alias("_t"))
        same = [written[k].eqNullSafe(w[f"_k{i}"]) for i, k in enumerate(keys)]
        on = (written["_s"] == w["_t"]) & written["_x"].between(w["_low"], w["_high"])
        for c in same:
            on = on & c
        return written.join(w, on).select(*keys, "_which", "_rank", "_low", "_high", "_x")

    settled = (F.col("_low") == F.col("_high")) | (F.col("_count") <= few) | F.col("_low").isNull()
    open_ = wanted.where(~settled)
    done = wanted.where(settled)
    while open_.limit(1).collect():
        part = F.least(F.lit(BINS - 1), F.floor((F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS))
        bins = near(open_).groupBy(*keys, "_which", "_rank", part.alias("_bin")).agg(F.count("*").alias("_count"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        upto = F.sum("_count").over(Window.partitionBy(*keys, "_which").orderBy("_bin"))  # at most BINS rows
        found = bins.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_count")))
        narrowed = materialise(found.select(*keys, "_which", (F.col("_rank") - (F.col("_upto") - F.col("_count"))).alias("_rank"), "_count", "_low", "_high"), "narrowed")
        done, open_ = done.unionByName(narrowed.where(settled)), narrowed.where(~settled)
    flat = F.col("_low").isNull() | (F.col("_low") == F.col("_high"))
    sorted_few = near(done.where(~flat)).groupBy(*keys, "_which", "_rank").agg(F.sort_array(F.collect_list("_x")).alias("_v"))
    values = done.where(flat).select(*keys, "_which", F.col("_low").alias("_v")).unionByName(
        sorted_few.select(*keys, "_which", F.get("_v", F.col("_rank").cast("int")).alias("_v")))
    return values.groupBy(*keys).agg(F.avg("_v").alias(name))
