from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from barledger.checks import IntegrityError, fail_closed
from barledger.operators import attribution, evidence, ledger
from pyspark.sql import functions as F

K = ["s"]


def bars(rows):
    return pd.DataFrame([("s", pd.Timestamp(t), float(o), float(c), float(x)) for t, o, c, x in rows],
                        columns=["s", "timestamp", "open", "close", "target_exposure"])


def run(spark, pdf, **kw):
    return ledger.next_open_ledger(spark.createDataFrame(pdf), K, **kw).toPandas().sort_values("timestamp").reset_index(drop=True)


def plain(pdf, bps):
    """The same ledger as a loop over rows."""
    held = old_target = 0.0
    equity, last_close, out = 1.0, None, []
    for r in pdf.sort_values("timestamp").itertuples():
        new = old_target
        if last_close is not None:
            equity *= (1 + held * (r.open / last_close - 1)) * (1 - abs(new - held) * bps / 1e4) * (1 + new * (r.close / r.open - 1))
        held, old_target, last_close = new, r.target_exposure, r.close
        out.append(equity)
    return out


def test_no_fill_on_the_decision_bar(spark):
    got = run(spark, bars([("2024-01-01", 100, 100, 1), ("2024-01-02", 110, 121, 1)]), fee_bps=0.0)
    # The jump from 100 to 110 belongs to the old, empty exposure.
    assert got["held_exposure"].tolist() == [0.0, 1.0]
    assert got["equity"].tolist() == pytest.approx([1.0, 1.1])


def test_old_exposure_owns_the_gap_and_legs_compound(spark):
    got = run(spark, bars([("2024-01-01", 100, 100, 1), ("2024-01-02", 100, 100, -1), ("2024-01-03", 120, 90, 0)]), fee_bps=10.0)
    gap, intra, cost = 1.2, 1 + (-1) * (90 / 120 - 1), 1 - 2 * 10 / 1e4
    assert got["equity"].iloc[-1] == pytest.approx((1 - 1e-3) * gap * cost * intra)
    assert got["turnover"].tolist() == [0.0, 1.0, 2.0]


def test_matches_a_plain_loop_over_irregular_gaps(spark):
    rng = np.random.default_rng(3)
    n = 300
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(60, 90_000, n)), unit="s")
    pdf = pd.DataFrame({"s": "s", "timestamp": at, "open": rng.uniform(90, 110, n), "close": rng.uniform(90, 110, n),
                        "target_exposure": rng.choice([-1.0, 0.0, 0.5, 1.0], n)})
    for width in (3600, 86400 * 5, 86400 * 365):
        got = run(spark, pdf, fee_bps=9.0, slippage_bps=2.0, seconds=width)
        np.testing.assert_allclose(got["equity"], plain(pdf, 11.0), rtol=1e-10)


def test_bad_input_is_refused(spark):
    pdf = bars([("2024-01-01", 100, 100, 1), ("2024-01-01", 0, 100, 1), ("2024-01-02", 100, float("inf"), 1)])
    found = ledger.ledger_violations(spark.createDataFrame(pdf), K)
    bad = {r.check for r in found.filter("failures > 0").collect()}
    assert {"duplicate_timestamp", "nonpositive_price", "non_finite_input"} <= bad
    with pytest.raises(IntegrityError):
        fail_closed(found, "ledger")
    with pytest.raises(IntegrityError):
        ledger.next_open_ledger(spark.createDataFrame(pdf), K, fee_bps=-1.0)


def candles(spark, opens):
    at = pd.to_datetime([t for t, *_ in opens])
    return spark.createDataFrame(pd.DataFrame({
        "s": "s", "open_time": at, "availability_time": at + pd.Timedelta(minutes=15),
        "open": [float(o) for _, o, _ in opens], "close": [float(c) for _, _, c in opens]}))


def line(spark, rows):
    return spark.createDataFrame(pd.DataFrame(
        [("s", pd.Timestamp(t), i, a, b, d, 0) for i, (t, a, b, d) in enumerate(rows)],
        columns=["s", "ts", "seq", "a_side", "b_side", "direction", "at_risk"]))


def test_missing_bar_makes_no_phantom_fill(spark):
    # The 00:30 bar is missing: the 100 -> 80 move is a gap on the exposure held before.
    src = candles(spark, [("2024-01-01 00:00", 100, 100), ("2024-01-01 00:15", 100, 100), ("2024-01-01 00:45", 80, 80)])
    states = line(spark, [("2024-01-01 00:30", 1, 1, 1)])
    rows = ledger.execution_rows(src, states, K).orderBy("open_time").toPandas()
    assert rows["a_held"].tolist() == [0.0, 0.0, 1.0]
    assert rows["a_gross"].tolist() == [0.0, 0.0, 0.0]


def test_segment_runs_through_the_convergence_bar(spark):
    t = [f"2024-01-01 {h:02d}:{m:02d}" for h in range(3) for m in (0, 15, 30, 45)]
    src = candles(spark, [(x, 100 + i, 101 + i) for i, x in enumerate(t)])
    states = line(spark, [("2024-01-01 00:15", -1, -1, -1), ("2024-01-01 00:45", -1, 0, -1), ("2024-01-01 01:15", 0, 0, 1),
                          ("2024-01-01 02:00", -1, 0, -1)])
    rows = evidence.numbered_rows(ledger.execution_rows(src, states, K), K)
    seg = evidence.divergence_segments(rows, K).orderBy("segment_id").toPandas()
    # Decided at 00:45, filled on the bar opening 00:45; A and B meet on the bar opening 01:15.
    assert [str(x)[11:16] for x in seg["start"]] == ["00:45", "02:00"]
    assert [str(x)[11:16] for x in seg["end"]] == ["01:15", "02:45"]
    assert seg["bear_epoch_id"].tolist() == [1, 2]
    r = rows.filter("open_time between '2024-01-01 00:45' and '2024-01-01 01:15'").toPandas()
    want = np.log1p(r.b_gross - r.b_turnover * 7e-4).sum() - np.log1p(r.a_gross - r.a_turnover * 7e-4).sum()
    assert seg["paired_delta_log"].iloc[0] == pytest.approx(want)
    assert bool(seg["b_better"].iloc[0]) == (want > 0)


def test_close_ledger_charges_the_decision_bar(spark):
    pdf = pd.DataFrame({"s": "s", "timestamp": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-03"]), "close": [100.0, 110.0, 110.0],
                        "a_core": ["CORE_SHORT", "CORE_SHORT", "FLAT"], "b_core": ["FLAT", "FLAT", "FLAT"]})
    led = ledger.close_ledger(spark.createDataFrame(pdf), K)
    got = led.orderBy("timestamp").toPandas()
    assert got["a_log_net"].iloc[0] == pytest.approx(np.log1p(-7e-4))
    assert got["a_log_net"].iloc[1] == pytest.approx(np.log1p(-0.1))
    seg = evidence.close_segments(led, K).collect()
    assert len(seg) == 1 and seg[0].paired_delta_log > 0
    assert seg[0].end == pd.Timestamp("2024-01-02")


def test_sign_flip_is_exact(spark):
    df = spark.createDataFrame([("s", i, d) for i, d in enumerate([-0.3, 0.1, -0.2])], "s string, bear_epoch_id int, paired_delta_log double")
    got = attribution.sign_flip_p(df, K).first()
    assert (got.epochs, got.p_value) == (3, 0.5)


def test_label_rules(spark):
    seg = spark.createDataFrame([("s", i, i % 4, 0.1) for i in range(8)], "s string, segment_id int, bear_epoch_id int, paired_delta_log double")
    spans = lambda days: spark.createDataFrame([("s", datetime(2024, 1, 1), datetime(2024, 1, 1) + timedelta(days=days))], "s string, first_at timestamp, last_at timestamp")
    label = lambda s, d: evidence.mechanism_label(s, spans(d), K).first()
    assert label(seg, 180).label == evidence.SUPPORT
    assert label(seg, 180).loeo_status == "LOEO_ROBUST_POSITIVE"
    assert label(seg, 179).label == evidence.INSUFFICIENT
    down = seg.withColumn("paired_delta_log", -F.col("paired_delta_log"))
    assert label(down, 365).label == evidence.ADVERSE
    no_epoch = seg.withColumn("bear_epoch_id", F.when(F.col("bear_epoch_id") < 2, F.col("bear_epoch_id")))
    got = label(no_epoch, 365)
    # Segments outside any epoch stay in the total but form no epoch.
    assert (got.bear_epochs, got.divergence_segments) == (2, 8) and got.total_paired_delta_log == pytest.approx(0.8)


def forward(spark, days, close=None):
    at = pd.Timestamp("2026-01-02") + pd.to_timedelta(np.linspace(0, days, 13), unit="D")
    apart = [i % 2 == 1 for i in range(13)]
    pdf = pd.DataFrame({"s": "s", "timestamp": at, "a_core": ["CORE_SHORT" if d else "FLAT" for d in apart], "b_core": "FLAT",
                        "bear_epoch_id": [f"e{i % 3}" for i in range(13)]})
    if close is not None:
        pdf["close"] = close
    return spark.createDataFrame(pdf)


def test_information_floor_counts_only(spark):
    freeze = F.lit("2026-01-01").cast("timestamp")
    floor = lambda df: evidence.information_floor(df, K, freeze).first()
    long = floor(forward(spark, 190))
    assert (long.divergence_segments, long.independent_bear_epochs, long.performance_release_allowed) == (6, 3, True)
    assert long.performance is None
    assert not floor(forward(spark, 100)).performance_release_allowed
    up = floor(forward(spark, 190, np.arange(13.0)))
    down = floor(forward(spark, 190, np.arange(13.0)[::-1]))
    assert up == down
    empty = evidence.information_floor(forward(spark, 190).limit(0), K, freeze, series=spark.createDataFrame([("s",)], "s string")).first()
    assert (empty.forward_days, empty.divergence_segments, empty.status) == (0.0, 0, "INSUFFICIENT_FORWARD_EVIDENCE")


def test_forward_violations(spark):
    freeze = F.lit("2026-01-02").cast("timestamp")
    bad = {r.check: r.failures for r in evidence.forward_violations(forward(spark, 190).unionAll(forward(spark, 190)), K, freeze).collect()}
    assert bad["at_or_before_freeze"] == 2 and bad["duplicate_timestamp"] == 13


def test_sign_flip_beyond_twenty_epochs(spark):
    rng = np.random.default_rng(2)
    deltas = rng.normal(0.1, 1, 22)
    df = spark.createDataFrame([("s", float(d)) for d in deltas], "symbol string, paired_delta_log double")
    got = attribution.sign_flip_p(df, ["symbol"]).first()
    sums = np.zeros(1)
    for d in np.sort(deltas):
        sums = np.concatenate([sums + d, sums - d])
    assert got.epochs == 22
    assert abs(got.p_value - (np.abs(sums) >= abs(deltas.sum()) - 1e-12).mean()) < 1e-9
    many = spark.createDataFrame([("s", float(k)) for k in range(45)], "symbol string, paired_delta_log double")
    with pytest.raises(Exception, match="too many epochs"):
        attribution.sign_flip_p(many, ["symbol"]).collect()


@pytest.mark.parametrize("bad, fault", [
    ({"open": 0.0}, "not positive"), ({"close": -1.0}, "not positive"), ({"close": None}, "missing input"), ({"open": float("nan")}, "missing input"),
    ({"target_exposure": float("inf")}, "missing input"), ({"timestamp": "2024-01-01 00:01:00"}, "one instant"), ({"target_exposure": 5000.0}, "takes all"),
])
def test_the_next_open_ledger_refuses_bad_bars(spark, bad, fault):
    rows = [dict(symbol="s", timestamp=f"2024-01-01 00:0{k}:00", open=10.0, close=10.0, target_exposure=1.0) for k in range(5)]
    rows[2] |= bad
    bars = spark.createDataFrame(rows, "symbol string, timestamp string, open double, close double, target_exposure double").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    with pytest.raises(Exception, match=fault):
        ledger.next_open_ledger(bars, ["symbol"]).collect()


def test_a_lost_return_is_not_skipped(spark):
    from barledger.functions.predicates import log_return

    for net in (-1.0, -2.5, None):
        with pytest.raises(Exception, match="no log return"):
            spark.createDataFrame([(net,)], "net double").select(log_return(F.col("net"))).collect()
