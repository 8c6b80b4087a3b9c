from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barledger.checks import IntegrityError
from barledger.functions import clock, predicates
from barledger.operators import candles, dedupe, exposure, gates, quality, reconcile

K = ["symbol"]
BAR = "symbol string, open_time timestamp, availability_time timestamp, open double, high double, low double, close double, volume double, number_of_trades bigint"


def at(text):
    return datetime.fromisoformat(text)


def bars(spark, rows, minutes=15):
    """(open time, open, high, low, close[, trades]) rows of one symbol."""
    df = spark.createDataFrame(
        [("X", at(r[0]), *map(float, r[1:5]), 1.0, int(r[5]) if len(r) > 5 else 1) for r in rows],
        "symbol string, open_time timestamp, open double, high double, low double, close double, volume double, number_of_trades bigint",
    )
    return clock.with_availability(df, minutes * 60)


def test_rollup_is_right_closed_and_causal(spark):
    rows = [("2024-01-01 00:00", 1, 2, 1, 2), ("2024-01-01 01:45", 2, 9, 2, 3), ("2024-01-01 02:00", 5, 5, 5, 5)]
    got = candles.rollup(bars(spark, rows), K, "2 hours").orderBy("availability_time").collect()
    # The bar closing exactly at 02:00 still belongs to the bin that closes then.
    assert [(str(r.availability_time)[11:16], r.open, r.high, r.close, r.bars) for r in got] == [("02:00", 1.0, 9.0, 3.0, 2), ("04:00", 5.0, 5.0, 5.0, 1)]


def test_weekly_default_is_causal_and_compat_is_not(spark):
    # 2024-01-08 is a Monday; this bar closes at 12:15 on it.
    b = bars(spark, [("2024-01-08 12:00", 1, 1, 1, 1)])
    assert candles.rollup_week(b, K).first().availability_time == at("2024-01-15")
    assert candles.rollup_week(b, K, compat=True).first().availability_time == at("2024-01-08")


def test_three_day_bars_restart_every_year(spark):
    b = bars(spark, [("2023-12-31 00:00", 1, 1, 1, 1), ("2024-01-01 00:00", 2, 2, 2, 2), ("2024-01-03 00:00", 3, 3, 3, 3)], 1440)
    got = candles.rollup_three_day_of_year(b, K).orderBy("open_time").collect()
    assert [str(r.open_time)[:10] for r in got] == ["2023-12-30", "2024-01-01"]
    assert got[1].bars == 2 and got[1].availability_time == at("2024-01-04")


def test_rebuild_needs_every_input(spark):
    rows = [(f"2024-01-01 00:{m:02d}", 1, 1, 1, 1) for m in range(15)] + [("2024-01-01 00:15", 1, 1, 1, 1)]
    got = candles.rebuild_complete(bars(spark, rows, 1), K, 900, 15).collect()
    assert [r.open_time for r in got] == [at("2024-01-01")]


def test_placeholder_bars_do_not_set_open_or_close(spark):
    rows = [("2024-01-01 00:00", 1, 1, 1, 1, 0), ("2024-01-01 00:15", 2, 3, 2, 3, 5), ("2024-01-01 00:30", 9, 9, 9, 9, 0)]
    r = candles.rollup_traded(bars(spark, rows), K, "2 hours").first()
    assert (r.open, r.close, r.high, r.traded_bars) == (2.0, 3.0, 9.0, 1)


def test_gaps_are_diagnosed_but_only_off_grid_is_invalid(spark):
    b = bars(spark, [("2024-01-01 00:00", 1, 1, 1, 1), ("2024-01-01 03:07", 1, 1, 1, 1)])
    audit = quality.window_audit(b, K, clocks=["2h"])
    assert quality.gap_windows(audit).count() == 2
    bad = quality.quarantined_windows(audit).collect()
    assert [r.window_end for r in bad] == [at("2024-01-01 04:00")]
    left = quality.without_quarantined(candles.rollup(b, K, "2 hours"), audit, K, "2h").collect()
    assert [r.availability_time for r in left] == [at("2024-01-01 02:00")]
    gap = quality.gap_rows(b, K).first()
    assert (gap.gap_seconds, gap.missing_bars, gap.next_on_grid) == (11220.0, 11, False)


def test_integrity_audit_sees_raw_faults(spark):
    rows = [("2024-01-01 00:15", 5, 4, 1, 2), ("2024-01-01 00:00", 1, 2, 1, -1), ("2024-01-01 00:15", 1, 1, 1, 1)]
    raw = bars(spark, rows).withColumn("src_order", F.monotonically_increasing_id())
    got = quality.integrity_audit(raw.coalesce(1), K).first()
    assert (got.rows, got.duplicate_timestamps, got.monotonic, got.envelope_failures, got.nonpositive_rows, got.status) == (3, 1, False, 2, 1, "FAIL")
    clean = dedupe.dedupe_last(raw.coalesce(1), [*K, "open_time"])
    assert clean.filter("open_time = '2024-01-01 00:15'").first().open == 1.0


def test_finite_values_and_flags(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("Infinity",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(predicates.finite_double(F.col("v"))).collect()] == [1.5, None, None, None, None]
    flags = spark.createDataFrame([(" Yes",), ("TRUE",), ("1",), ("no",), (None,)], "v string")
    assert [r[0] for r in flags.select(predicates.truthy(F.col("v"))).collect()] == [True, True, True, False, False]
    sums = spark.createDataFrame([("ABC123 *file.zip\nnext",), ("*DEAD  x",)], "v string")
    assert [r[0] for r in sums.select(predicates.checksum_token(F.col("v"))).collect()] == ["abc123", "dead"]


def test_freeze_boundary_is_exclusive_forward_and_inclusive_for_warmup(spark):
    b = bars(spark, [("2024-01-01 00:00", 1, 1, 1, 1), ("2024-01-01 00:15", 1, 1, 1, 1)])
    freeze, cutoff = F.lit("2024-01-01 00:15").cast("timestamp"), F.lit("2024-01-01 00:30").cast("timestamp")
    assert [r.open_time for r in clock.eligible_forward(b, freeze, cutoff).collect()] == [at("2024-01-01 00:15")]
    assert [r.open_time for r in clock.eligible_warmup(b, freeze).collect()] == [at("2024-01-01 00:00")]


def test_patch_adds_and_replaces_but_never_touches_the_base(spark):
    base = bars(spark, [("2024-01-01 00:00", 1, 1, 1, 1), ("2024-01-01 00:15", 2, 2, 2, 2)])
    new = bars(spark, [("2024-01-01 00:15", 2, 2, 2, 2.5), ("2024-01-01 00:30", 3, 3, 3, 3)])
    log = {str(r.open_time)[11:16]: r.action for r in reconcile.patch_log(base, new, K).collect()}
    assert log == {"00:15": "replace", "00:30": "add"}
    assert [r.close for r in reconcile.patched_bars(base, new, K, 900).orderBy("open_time").collect()] == [1.0, 2.5, 3.0]
    windows = spark.createDataFrame([("X", at("2024-01-01 00:30"))], "symbol string, window_end timestamp")
    hit = reconcile.affected_bars(base.unionByName(new), windows, K, 1800)
    assert {str(r.open_time)[11:16] for r in hit.collect()} == {"00:00", "00:15"}


def gate(spark, interval, days, eligible=5, hard=0):
    key = ["series", "interval"]
    series = spark.createDataFrame([("s", interval)], "series string, interval string")
    manifest = spark.createDataFrame([("s", interval, at(d), 1) for d in days], "series string, interval string, period timestamp, rows bigint")
    periods = gates.classify_periods(series, manifest, key, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-03").cast("timestamp"))
    audit = spark.createDataFrame([("s", interval, eligible, hard)], "series string, interval string, eligible_rows bigint, hard_failures bigint")
    per = gates.series_gate(periods, audit, key)
    return per.first().status, gates.overall_gate(per, ["series"]).first().status


def test_missing_days_by_clock_and_precedence(spark):
    all_days = ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert gate(spark, "15m", all_days) == ("PASS", "PASS")
    # Yesterday's rows cannot hide today's missing file.
    assert gate(spark, "15m", all_days[:2]) == (gates.WAITING_PUBLICATION,) * 2
    assert gate(spark, "15m", all_days[::2])[1] == "FAIL"
    assert gate(spark, "1w", all_days[:1]) == ("PASS", "PASS")
    assert gate(spark, "1w", [], eligible=0) == (gates.WAITING_FIRST_BAR, gates.PASS_WAITING)
    assert gate(spark, "15m", all_days, hard=1) == ("FAIL", "FAIL")
    assert gate(spark, "15m", [])[0] == gates.WAITING_PUBLICATION


def test_freeze_day_rule_per_source(spark):
    day, freeze = F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-02 02:00").cast("timestamp")
    cutoff = F.lit("2024-01-03").cast("timestamp")
    one = spark.range(1)
    assert one.select(gates.waits_for_first_day("native", cutoff, day, freeze)).first()[0] is True
    assert one.select(gates.waits_for_first_day("state", cutoff, day, freeze)).first()[0] is False


def legs(spark, side, reduced, reasons, **policy):
    df = spark.createDataFrame([(side, reduced, reasons)], "core_side string, reduced boolean, hedge_reasons array<string>")
    return exposure.allocate(df, [exposure.Policy("p", **policy)]).first()


def test_risk_allocation(spark):
    fractions = {"a": 0.3, "b": 0.5}
    r = legs(spark, "LONG", False, ["a", "b", "a"], hedge_fractions=fractions)
    assert (r.hedge_short, r.net_exposure) == (0.5, 0.5)  # the maximum, not the sum
    r = legs(spark, "LONG", True, ["b"], hedge_fractions={"b": 1.0}, reduce_fraction=0.6)
    assert (r.core_long, r.hedge_short, r.net_exposure) == (pytest.approx(0.4), pytest.approx(0.4), 0.0)
    r = legs(spark, "LONG", False, ["b"], hedge_fractions=fractions, gross_cap=0.75)
    assert (r.core_long, r.hedge_short, r.gross_exposure) == (pytest.approx(0.5), pytest.approx(0.25), 0.75)
    r = legs(spark, "SHORT", True, ["b"], hedge_fractions=fractions, reduce_fraction=0.5, core_unit=0.8)
    assert (r.core_short, r.net_exposure, r.hedge_short) == (0.8, -0.8, 0.0)
    assert legs(spark, "FLAT", True, ["a"], hedge_fractions=fractions).gross_exposure == 0.0
    assert legs(spark, "LONG", False, ["x"], hedge_fractions=fractions).refused == "unknown_hedge_reason"
    for bad in ({"core_unit": 0.0}, {"reduce_fraction": 1.5}, {"gross_cap": 0.0}, {"hedge_fractions": {"": 0.1}}):
        with pytest.raises(IntegrityError):
            exposure.Policy("p", **bad)
