"""Chunked scans against plain pandas, with chunks so narrow that borders are everywhere."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barledger.operators import asof, ordered

KEYS = ["series"]


def frame(seed: int, rows: int = 240) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    # One hot series holds most rows, one holds a single row.
    series = np.where(rng.random(rows) < 0.7, "hot", np.where(rng.random(rows) < 0.5, "a", "b"))
    series[0] = "single"
    seconds = rng.choice(200_000, size=rows, replace=False)
    return pd.DataFrame(
        {
            "series": series,
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds, unit="s"),
            "x": rng.normal(size=rows).round(6),
            "f": (1 + rng.normal(scale=0.05, size=rows)).round(6),
        }
    )


@pytest.mark.parametrize("seed,width", [(1, 60), (2, 3600), (3, 10_000_000)])
def test_scans_match_pandas(spark, seed, width):
    pdf = frame(seed)
    df = spark.createDataFrame(pdf)
    out = ordered.previous_two_rows(df, KEYS, ["ts"], ["x"], width)
    out = ordered.running(out, KEYS, ["ts"], {"sum_x": ("sum", F.col("x")), "max_x": ("max", F.col("x")),
                                              "prod_f": ("product", F.col("f"))}, width)
    out = ordered.equity_curve(out, KEYS, ["ts"], F.col("f"), width)
    one = ordered.previous_row(df, KEYS, ["ts"], ["x"], width).select("series", "ts", F.col("prev.x").alias("one"))
    got = (
        out.join(one, ["series", "ts"])
        .select("series", "ts", F.col("prev.x").alias("p1"), F.col("prev2.x").alias("p2"), "one", "sum_x", "max_x", "prod_f", "equity", "peak", "drawdown")
        .toPandas().sort_values(["series", "ts"]).reset_index(drop=True)
    )
    want = pdf.sort_values(["series", "ts"]).reset_index(drop=True)
    g = want.groupby("series")
    want["p1"], want["p2"] = g["x"].shift(1), g["x"].shift(2)
    want["one"] = want["p1"]
    want["sum_x"], want["max_x"], want["prod_f"] = g["x"].cumsum(), g["x"].cummax(), g["f"].cumprod()
    want["equity"] = want["prod_f"]
    want["peak"] = want.groupby("series")["equity"].cummax()
    want["drawdown"] = want["equity"] / want["peak"] - 1
    assert len(got) == len(want)
    for c in ("p1", "p2", "one", "sum_x", "max_x", "prod_f", "equity", "peak", "drawdown"):
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-9, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("width", [300, 50_000])
def test_asof_and_history_match_pandas(spark, width):
    rng = np.random.default_rng(7)
    bars = frame(11, 150).rename(columns={"ts": "availability_time", "x": "open", "f": "close"})
    bars["open_time"] = bars["availability_time"] - pd.Timedelta(minutes=15)
    states = frame(12, 60)[["series", "ts"]]
    # Some states fall exactly on a bar, and some instants carry two states.
    states.loc[states.index[:15], "ts"] = bars["availability_time"].sample(15, random_state=1).to_numpy()
    states = pd.concat([states, states.head(10)], ignore_index=True)
    states["seq"] = np.arange(len(states))
    states["side"] = rng.integers(-1, 2, len(states))
    b, s = spark.createDataFrame(bars), spark.createDataFrame(states)

    last = states.sort_values(["ts", "seq"]).drop_duplicates(["series", "ts"], keep="last")
    want = pd.merge_asof(bars.sort_values("availability_time"), last.sort_values("ts"), left_on="availability_time",
                         right_on="ts", by="series").sort_values(["series", "availability_time"]).reset_index(drop=True)
    got = asof.asof_states(b, s, KEYS, ["side"], seconds=width).toPandas().sort_values(["series", "availability_time"]).reset_index(drop=True)
    np.testing.assert_array_equal(got["side"].astype(float), want["side"].astype(float))

    history = (
        asof.bars_with_history(b, s, KEYS, ["side"], width)
        .select("series", "availability_time", "now.side", F.col("prev.side").alias("s1"), F.col("prev.close").alias("c1"), F.col("prev2.side").alias("s2"))
        .toPandas().sort_values(["series", "availability_time"]).reset_index(drop=True)
    )
    want["side"] = want["side"].fillna(0)
    g = want.groupby("series")
    np.testing.assert_array_equal(history["side"].astype(float), want["side"])
    np.testing.assert_array_equal(history["s1"].astype(float), g["side"].shift(1))
    np.testing.assert_array_equal(history["s2"].astype(float), g["side"].shift(2))
    np.testing.assert_array_equal(history["c1"].astype(float), g["close"].shift(1))


def test_align_timelines_carries_both_sides(spark):
    a = spark.createDataFrame(pd.DataFrame({"series": "s", "ts": pd.to_datetime(["2024-01-01", "2024-02-01"]), "seq": [0, 1], "side": [1, -1]}))
    b = spark.createDataFrame(pd.DataFrame({"series": "s", "ts": pd.to_datetime(["2024-01-15", "2024-02-01", "2024-02-01"]), "seq": [0, 1, 2], "side": [1, 5, 0]}))
    got = asof.align_timelines(a, b, KEYS, ["side"], seconds=86400).orderBy("ts").select("a_side", "b_side").collect()
    assert [tuple(r) for r in got] == [(1, None), (1, 1), (-1, 0)]


def test_null_series_stops_the_job(spark):
    df = spark.createDataFrame([(None, datetime(2024, 1, 1), 1.0)], "series string, ts timestamp, x double")
    with pytest.raises(PySparkException):
        ordered.previous_row(df, KEYS, ["ts"], ["x"]).collect()


def test_suggested_chunk_respects_the_limit(spark):
    df = spark.range(4000).select(F.lit("hot").alias("series"), F.timestamp_seconds(F.col("id")).alias("ts"))
    assert ordered.suggest_chunk_seconds(df, KEYS, "ts", max_rows=100) == 60
    assert ordered.suggest_chunk_seconds(df, KEYS, "ts", max_rows=10_000) == 365 * 86400
