"""Attribution and robustness figures on top of the ledgers and segments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barledger.operators.ordered import BAR_CHUNK_SECONDS, previous_row, running
from barledger.operators.selection import exact_medians
from barledger.session import materialise

#: 2^22 half sums are 32 MB.
MAX_SIGNFLIP_EPOCHS = 44


def venue_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "paired_delta_log") -> DataFrame:
    """Correlation and sign concordance of deltas two venues give to the same unit.

    ``keys`` end with the unit (segment or epoch id); the rest are the series.
    """
    on = list(keys)
    both = a.select(*on, F.col(value).alias("x")).join(b.select(*on, F.col(value).alias("y")), on)
    return both.groupBy(*on[:-1]).agg(
        F.count("*").alias("common"),
        F.corr("x", "y").alias("correlation"),
        F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("sign_concordance"),
    )


def _count_flips(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Share of sign patterns whose absolute sum reaches the observed one, from two half sums.

    Patterns come in opposite pairs, so those with a sum of at least t are counted and
    doubled. For every sum of one half, a binary search in the sorted sums of the other
    half counts its partners: 2^(n/2) work instead of 2^n.
    """
    deltas = np.sort(rows["paired_delta_log"].to_numpy(float))
    observed = deltas.sum()
    halves = []
    for part in (deltas[::2], deltas[1::2]):
        sums = np.zeros(1)
        for d in part:
            sums = np.concatenate([sums + d, sums - d])
        halves.append(np.sort(sums))
    least = abs(observed) - 1e-12
    reached = sum(len(halves[1]) - np.searchsorted(halves[1], least - halves[0], side="left"))
    total = 2.0 ** len(deltas)
    share = 1.0 if least <= 0 else min(1.0, 2.0 * reached / total)
    return pd.DataFrame([[*key, len(deltas), observed, share]])


def sign_flip_p(epochs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact two-sided sign-flip p over the epochs of each series.

    All 2^n patterns of n epochs count, met in the middle. A series with more than
    ``MAX_SIGNFLIP_EPOCHS`` epochs stops the job: half its patterns would not fit into a
    task, and a p from anything less would not be exact.
    """
    counts = epochs.groupBy(*keys).agg(F.count("*").alias("_n"))
    few = F.when(F.col("_n") <= MAX_SIGNFLIP_EPOCHS, F.col("paired_delta_log")).otherwise(
        F.raise_error(F.concat(F.lit("too many epochs for an exact sign flip: "), F.col("_n").cast("string"))).cast("double"))
    # The check stands before the grouping, so no group larger than that is ever built.
    rows = epochs.select(*keys, "paired_delta_log").join(counts, list(keys)).select(*keys, few.alias("paired_delta_log"))
    types = ", ".join(f"{k} {epochs.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(_count_flips, f"{types}, epochs bigint, observed double, p_value double")


def campaigns(ledger: DataFrame, keys: Sequence[str], seconds: int = BAR_CHUNK_SECONDS) -> DataFrame:
    """Runs of one unchanged non-zero held exposure, with their summed log return."""
    at = "availability_time"
    rows = previous_row(ledger, keys, [at], ["held_exposure"], seconds)
    fresh = (F.col("held_exposure") != 0) & (
        F.col("held_exposure") != F.coalesce(F.col("prev.held_exposure"), F.lit(0.0))
    )
    numbered = running(rows, keys, [at], {"campaign_id": ("sum", fresh.cast("int"))}, seconds)
    last_bar = ledger.groupBy(*keys).agg(F.max(at).alias("_series_end"))
    epoch = [F.min_by("bull_epoch_id", at).alias("bull_epoch_id")] if "bull_epoch_id" in ledger.columns else []
    runs = numbered.filter(F.col("held_exposure") != 0).groupBy(*keys, "campaign_id").agg(
        *epoch,
        F.max("held_exposure").alias("side"),
        F.min("open_time").alias("first_open"),
        F.max(at).alias("last_at"),
        F.count("*").alias("bars"),
        F.sum("log_net").alias("log_return"),
    )
    return runs.join(last_bar, list(keys)).withColumn("completed", F.col("last_at") < F.col("_series_end")).drop("_series_end")


def campaign_summary(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per side: how many campaigns, mean, exact median and share of winners."""
    written = materialise(runs.select(*keys, "side", "log_return"), "campaigns")
    plain = written.groupBy(*keys, "side").agg(
        F.count("*").alias("campaigns"),
        F.avg("log_return").alias("mean_log_return"),
        F.avg((F.col("log_return") > 0).cast("double")).alias("win_rate"),
    )
    medians = exact_medians(written, [*keys, "side"], "log_return", "median_log_return")
    return plain.join(medians, [*keys, "side"], "left")


def side_attribution(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    side = F.when(F.col("held_exposure") > 0, "LONG").when(F.col("held_exposure") < 0, "SHORT").otherwise("FLAT")
    return ledger.groupBy(*keys, side.alias("side")).agg(
        F.count("*").alias("bars"), F.sum("log_net").alias("log_return"), F.sum("trade_cost").alias("cost_drag")
    )


def yearly(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ledger.groupBy(*keys, F.year("open_time").alias("year")).agg(
        F.count("*").alias("bars"), F.sum("log_net").alias("log_return"), F.sum("turnover").alias("turnover_units")
    )


# Floor of the sparse-trend long gate.
LONG_GATE = {"days": 365, "campaigns": 6, "epochs": 3}


def long_gate(runs: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gate for sparse long campaigns: enough of them, positive, and not carried by one.

    ``runs``: campaigns with the bull epoch they started in; ``spans``: keys, first_at,
    last_at. Open campaigns are no completed evidence.
    """
    long_done = runs.filter((F.col("side") > 0) & F.col("completed"))
    bull_epochs = (
        long_done.filter(F.col("bull_epoch_id").isNotNull())
        .groupBy(*keys, "bull_epoch_id").agg(F.sum("log_return").alias("log_return"))
    )
    done = long_done.groupBy(*keys).agg(
        F.count("*").alias("completed_campaigns"),
        F.sum("log_return").alias("total"),
        (F.sum("log_return") - F.max("log_return")).alias("total_without_best"),
    )
    per_epoch = bull_epochs.groupBy(*keys).agg(
        F.count("*").alias("bull_epochs"), F.count_if(F.col("log_return") > 0).alias("positive_epochs")
    )
    days = (F.unix_micros(F.col("last_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / F.lit(86400e6)
    out = (
        spans.join(done, list(keys), "left").join(per_epoch, list(keys), "left")
        .fillna(0, ["completed_campaigns", "bull_epochs", "positive_epochs"])
        .fillna(0.0, ["total", "total_without_best"])
        .withColumn("history_days", days)
    )
    n = F.col("bull_epochs")
    passed = (
        (F.col("history_days") >= LONG_GATE["days"])
        & (F.col("completed_campaigns") >= LONG_GATE["campaigns"])
        & (n >= LONG_GATE["epochs"])
        & (F.col("total") > 0)
        & (F.col("total_without_best") > 0)
        & (F.col("positive_epochs") * 3 >= n * 2)
    )
    return out.withColumn("passed", passed).drop("first_at", "last_at")
