from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barledger.operators import campaign, fold
from barledger.operators.campaign import EVENT_TYPES, RULES_A, RULES_B, CampaignState, step


def run(rules, events):
    s, actions = CampaignState(), []
    for e in events:
        s, action = step(rules, s, e)
        actions.append(action)
    return s, actions


def test_b_only_suppresses_the_short_reentry():
    events = ["MAJOR_BEAR_CONFIRMED", "LOCAL_SHORT_ENTRY", "LOCAL_SHORT_INVALIDATION", "LOCAL_SHORT_REENTRY"]
    a, actions_a = run(RULES_A, events)
    b, actions_b = run(RULES_B, events)
    assert (a.core, a.watch) == ("CORE_SHORT", "")
    assert (b.core, b.watch) == ("FLAT", "SHORT")
    assert actions_a[:3] == actions_b[:3] and actions_a[3] == "REENTER_SHORT"
    assert actions_b[3] == "PROBE_SHORT_REENTRY_SUPPRESSED"


def test_opposite_confirmation_flattens():
    s, _ = run(RULES_A, ["MAJOR_BULL_CONFIRMED", "LOCAL_LONG_ENTRY", "MAJOR_BEAR_CONFIRMED"])
    assert (s.core, s.regime) == ("FLAT", "BEAR_CONFIRMED")


def test_reachable_states():
    assert campaign.compile_machine(["A"]).width == 14
    assert campaign.compile_machine(["B"]).width == 14
    for a, b in campaign.compile_machine(["A", "B"]).states:
        assert a.regime == b.regime
        assert a.core == b.core or (a.core, b.core) == ("CORE_SHORT", "FLAT")


@pytest.mark.parametrize("seconds", [30, 7200, 10**7])
def test_fold_matches_a_plain_loop(spark, monkeypatch, seconds):
    # Tiny pieces and spans, so that every level of the scan has several members.
    monkeypatch.setattr(fold, "PIECE", 3)
    monkeypatch.setattr(fold, "CHUNKS_PER_SPAN", 4)
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({
        "key": np.where(rng.random(n) < 0.8, "hot", "cold"),
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 20_000, n), unit="s"),
        "seq": rng.permutation(n),
        "event_type": rng.choice([*EVENT_TYPES, "UNKNOWN"], n),
    })
    got = campaign.ab_trace(spark.createDataFrame(pdf), ["key"], seconds=seconds).toPandas().set_index("seq")
    assert len(got) == n
    for _, group in pdf.sort_values(["ts", "seq"]).groupby("key"):
        a = b = CampaignState()
        for row in group.itertuples():
            a, act_a = step(RULES_A, a, row.event_type)
            b, act_b = step(RULES_B, b, row.event_type)
            r = got.loc[row.seq]
            assert (r.a_regime, r.a_core, r.a_at_risk, r.a_watch) == (a.regime, a.core, a.at_risk, a.watch)
            assert (r.b_regime, r.b_core, r.b_at_risk, r.b_watch) == (b.regime, b.core, b.at_risk, b.watch)
            if row.event_type != "UNKNOWN":
                assert (r.a_last_action, r.b_last_action) == (act_a, act_b)


def test_event_violations_and_split(spark):
    at = datetime.fromisoformat("2024-01-02")
    rows = [("k", at, "LOCAL_LONG_ENTRY"), ("k", at, "LOCAL_LONG_ENTRY"), ("k", at, "NOISE"), ("k", None, "LOCAL_LONG_ENTRY"),
            ("k", datetime.fromisoformat("2024-01-01"), "MAJOR_BULL_RISK"), ("k", datetime.fromisoformat("2024-01-01 00:00:01"), "MAJOR_BULL_RISK")]
    df = spark.createDataFrame(rows, "key string, ts timestamp, event_type string")
    freeze = F.lit("2024-01-01").cast("timestamp")
    got = {r.check: r.failures for r in campaign.event_violations(df, ["key"], freeze).collect()}
    # A row exactly on the freeze is refused, one second later is fine.
    assert got == {"invalid_timestamp": 1, "unknown_event_type": 1, "at_or_before_freeze": 1, "duplicate_event": 1}
    ok, bad = campaign.split_events(df, ["key"], freeze)
    assert (ok.count(), bad.count()) == (3, 3)
