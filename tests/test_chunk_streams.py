"""Streams in two stages, retries, recovery from a checkpoint, and the journal sink."""

import os
import shutil
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barledger.checks import IntegrityError, fail_closed
from barledger.operators import campaign, journal, ledger
from barledger.operators.campaign import EVENT_TYPES
from barledger.sources import journal_sink
from barledger.streaming.chunks import (
    SETTLED, Stages, beats_after, checked_recovery, late_of, measured_lateness, none_late, settled_chunks, settled_ledger, settled_states, stream_retries,
)
from barledger.streaming.drain import Closing, drain
from barledger.streaming.paper import resume_state

START = pd.Timestamp("2024-01-01")
STATES = ["key", "seq", "a_core", "b_core", "a_regime", "a_at_risk", "a_watch", "a_last_action", "b_last_action"]


def land(spark, pdf, folder, files=1):
    schema = spark.createDataFrame(pdf).schema
    for part in np.array_split(np.arange(len(pdf)), files):
        spark.createDataFrame(pdf.iloc[part], schema).coalesce(1).write.mode("append").parquet(folder)
    return schema


def follow(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def event_rows(n=90):
    rng = np.random.default_rng(6)
    types = rng.choice([*EVENT_TYPES, "UNHEARD_OF"], n)
    return pd.DataFrame({"key": rng.choice(["a", "b"], n), "ts": START + pd.to_timedelta(rng.integers(0, 40, n) * 997, unit="s"),
                         "seq": rng.permutation(n), "event_type": types})


def test_two_stages_equal_the_batch_fold_in_any_file_order(spark, tmp_path):
    pdf = event_rows().sort_values("ts", ascending=False, kind="stable")
    folder = str(tmp_path / "in")
    schema = land(spark, pdf, folder, 4)
    table = spark.read.schema(schema).parquet(folder)
    lateness = measured_lateness(table, "ts")
    assert 0 < lateness <= 40 * 997
    closing = Closing(spark, "ts timestamp", "t")
    trace, late = settled_states(Stages(spark, str(tmp_path / "s"), ["key"]), follow(spark, schema, folder), 3600, lateness, closing,
                                 [beats_after(table, "ts", 3600, lateness)])
    none_late(late, "t")
    want = campaign.ab_trace(spark.createDataFrame(pdf), ["key"])
    assert trace.select(STATES).orderBy("seq").collect() == want.select(STATES).orderBy("seq").collect()


def test_late_events_are_published_and_the_others_keep_their_states(spark, tmp_path):
    pdf = event_rows().sort_values("ts", ascending=False, kind="stable")  # newest files first, too little lateness
    folder = str(tmp_path / "in")
    schema = land(spark, pdf, folder, 3)
    closing = Closing(spark, "ts timestamp", "t")
    trace, late = settled_states(Stages(spark, str(tmp_path / "s"), ["key"]), follow(spark, schema, folder), 3600, 3600, closing,
                                 [beats_after(spark.createDataFrame(pdf), "ts", 3600, 3600)])
    lost = {r.seq for r in late.collect()}
    assert lost and trace.count() + len(lost) == len(pdf)
    with pytest.raises(IntegrityError, match="entered no chunk"):
        none_late(late, "t")
    want = campaign.ab_trace(spark.createDataFrame(pdf[~pdf["seq"].isin(lost)]), ["key"])
    assert trace.select(STATES).orderBy("seq").collect() == want.select(STATES).orderBy("seq").collect()


def test_a_chunk_of_many_events_is_replayed_in_time_that_grows_with_their_number(spark, tmp_path):
    n = 200_000
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"key": rng.choice(["a", "b"], n, p=[0.99, 0.01]), "ts": START + pd.to_timedelta(rng.integers(0, 3600, n), unit="s"),
                        "seq": rng.permutation(n), "event_type": rng.choice([*EVENT_TYPES, "UNHEARD_OF"], n)})
    folder = str(tmp_path / "in")
    schema = land(spark, pdf, folder)
    closing = Closing(spark, "ts timestamp", "t")
    trace, late = settled_states(Stages(spark, str(tmp_path / "s"), ["key"]), follow(spark, schema, folder), 3600, 0, closing,
                                 [beats_after(spark.read.schema(schema).parquet(folder), "ts", 3600, 0)])
    none_late(late, "t")
    began = time.monotonic()
    got = trace.select(STATES).toPandas().sort_values("seq", ignore_index=True)
    assert time.monotonic() - began < 30  # an array copied for every event takes minutes
    want = campaign.ab_trace(spark.read.schema(schema).parquet(folder), ["key"], seconds=60).select(STATES).toPandas()
    pd.testing.assert_frame_equal(got, want.sort_values("seq", ignore_index=True))


def bars(n=40):
    rng = np.random.default_rng(9)
    return pd.DataFrame({"s": np.where(np.arange(n) % 3 == 0, "x", "y"), "timestamp": START + pd.to_timedelta(np.arange(n) * 17, unit="m"),
                         "open": rng.uniform(90, 110, n), "close": rng.uniform(90, 110, n), "target_exposure": rng.choice([-1.0, 0.0, 1.0], n)})


def test_two_stage_ledger_equals_batch_and_names_what_it_refuses(spark, tmp_path):
    pdf = bars()
    broken = pdf.iloc[[39]].assign(timestamp=START + pd.Timedelta(days=2), open=0.0)
    folder = str(tmp_path / "in")
    schema = land(spark, pd.concat([pdf, pdf.iloc[[5]], broken]).sample(frac=1, random_state=1), folder)
    closing = Closing(spark, "timestamp timestamp", "t")
    actions, refused = settled_ledger(Stages(spark, str(tmp_path / "s"), ["s"]), follow(spark, schema, folder), 3600, 0, closing,
                                      [beats_after(spark.createDataFrame(pdf), "timestamp", 3600, 0)])
    want = ledger.next_open_ledger(spark.createDataFrame(pdf), ["s"]).orderBy("s", "timestamp").toPandas()
    got = actions.orderBy("s", "timestamp").toPandas()
    for column in ("equity", "held_exposure", "turnover"):
        np.testing.assert_allclose(got[column], want[column], rtol=1e-12)
    assert sorted(r.status for r in refused.collect()) == ["IDEMPOTENT_NOOP", "REFUSED_INPUT"]


def test_ruin_stops_the_stream(spark, tmp_path):
    pdf = bars(12).assign(s="x", target_exposure=1.0)
    pdf.loc[6, "close"] = 1e-3
    pdf.loc[5, "target_exposure"] = 3.0  # a leveraged bar that loses more than all
    folder = str(tmp_path / "in")
    schema = land(spark, pdf, folder)
    closing = Closing(spark, "timestamp timestamp", "t")
    with pytest.raises(Exception, match="ledger refused"):
        settled_ledger(Stages(spark, str(tmp_path / "s"), ["s"]), follow(spark, schema, folder), 86400, 0, closing,
                       [beats_after(spark.createDataFrame(pdf), "timestamp", 86400, 0)])


def test_recovery_is_checked_from_the_checkpoint(spark, tmp_path):
    pdf = bars()
    cut = START + pd.Timedelta(hours=6)
    early, later = pdf[pdf["timestamp"] < cut], pdf[pdf["timestamp"] >= cut]
    folder = str(tmp_path / "in")
    schema = land(spark, early, folder)
    closing, stages = Closing(spark, "timestamp timestamp", "t"), Stages(spark, str(tmp_path / "s"), ["s"])
    stream = follow(spark, schema, folder)
    settled_ledger(stages, stream, 3600, 0, closing, [spark.createDataFrame([(cut.to_pydatetime(),)], "timestamp timestamp")])
    tail = spark.createDataFrame(resume_state(journal.build_journal(spark.createDataFrame(early), ["s"]), ["s"]).collect())
    fail_closed(checked_recovery(stages, tail), "checkpoint")
    for wrong in (tail.withColumn("equity", F.col("equity") * 1.001), tail.where("s = 'x'"), tail.withColumn("last_timestamp", F.expr("last_timestamp + interval 1 second"))):
        with pytest.raises(IntegrityError):
            fail_closed(checked_recovery(stages, wrong), "checkpoint")
    # A checkpoint of other bars doesn't pass for the one of these.
    other = Stages(spark, str(tmp_path / "o"), ["s"])
    land(spark, early.assign(close=early["close"] + 1), str(tmp_path / "forged"))
    settled_ledger(other, follow(spark, schema, str(tmp_path / "forged")), 3600, 0, closing)
    with pytest.raises(IntegrityError):
        fail_closed(checked_recovery(other, tail), "checkpoint")
    land(spark, later, folder)
    actions, refused = settled_ledger(stages, stream, 3600, 0, closing, [beats_after(spark.createDataFrame(pdf), "timestamp", 3600, 0)])
    none_late(refused, "t")
    want = ledger.next_open_ledger(spark.createDataFrame(pdf), ["s"]).orderBy("s", "timestamp").toPandas()
    np.testing.assert_allclose(actions.orderBy("s", "timestamp").toPandas()["equity"], want["equity"], rtol=1e-12)


def test_retries_are_told_apart_until_they_are_forgotten(spark, tmp_path):
    at = lambda h: START + pd.Timedelta(hours=h)
    first = pd.DataFrame([("x", at(1), 0, "p"), ("x", at(1), 1, "p"), ("x", at(1), 2, "q"), ("x", at(30), 3, "r"), ("y", at(1), 4, "q")],
                         columns=["s", "timestamp", "arrival", "c"])
    second = pd.DataFrame([("x", at(1), 5, "p"), ("x", at(30), 6, "r"), ("x", at(30), 7, "z"), ("y", at(2), 8, "new but too late"), ("y", at(29), 9, "n")],
                          columns=first.columns)
    folder = str(tmp_path / "in")
    schema = land(spark, first, folder)
    for _ in range(2):
        out = drain(stream_retries(follow(spark, schema, folder), ["s"], F.col("c"), 3600, 7200), "t", base=str(tmp_path / "r"))
        if len(os.listdir(folder)) < 6:
            land(spark, second, folder)
    got = {r.arrival: r.status for r in out.collect()}
    assert got == {0: "PROCESSED", 1: "IDEMPOTENT_NOOP", 2: "CONFLICT", 3: "PROCESSED", 4: "PROCESSED",
                   5: "EXPIRED", 6: "IDEMPOTENT_NOOP", 7: "CONFLICT", 8: "EXPIRED", 9: "PROCESSED"}


def test_a_stream_of_nothing_settles_nothing(spark, tmp_path):
    spark.createDataFrame([], "key string, ts timestamp, seq bigint, event_type string").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    assert measured_lateness(spark.read.parquet(str(tmp_path / "in")), "ts") == 0
    chunks = drain(settled_chunks(follow(spark, schema, str(tmp_path / "in")), ["key"], ["ts", "seq"], 3600, 0), "t")
    assert chunks.where(F.col("status") == SETTLED).count() == 0 and late_of(chunks, ["key"]).count() == 0


# ---- the journal sink ---------------------------------------------------------

ROWS = "series string, segment bigint, timestamp bigint, body_hash string, body string"


def journal_rows(times, series="ab"):
    return [(s, t // 10, t, f"h{s}{t}", f"b{t}") for s in series for t in times]


def feed(spark, tmp_path, rows=None):
    folder = str(tmp_path / "in")
    if rows is not None:
        spark.createDataFrame(rows, ROWS).repartition(3).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(ROWS).parquet(folder)
    journal_sink.chain_journal(stream, str(tmp_path / "journal"), str(tmp_path / "ck")).awaitTermination()
    return journal_sink.read_journal(spark, str(tmp_path / "journal"))


def chain_by_hand(times, series):
    out, previous, segment = [], None, None
    for n, t in enumerate(times, 1):
        previous = previous if t // 10 == segment else journal.genesis(series, t // 10)
        segment = t // 10
        link = journal.next_link(previous, f"h{series}{t}")
        out.append((series, n, t, previous, link))
        previous = link
    return out


def check_journal(found, times, series="ab"):
    got = sorted(tuple(r) for r in found.select("series", "seq", "timestamp", "previous_record_hash", "record_hash").collect())
    assert got == sorted(r for s in series for r in chain_by_hand(times, s))
    assert journal_sink.verify_chains(found).count() == 0


def test_chains_go_on_from_their_stored_tails(spark, tmp_path):
    feed(spark, tmp_path, journal_rows([1, 5, 9, 11]))
    feed(spark, tmp_path)  # nothing new
    feed(spark, tmp_path, journal_rows([12, 25], "a"))
    found = feed(spark, tmp_path, journal_rows([13, 14, 31], "b"))
    assert journal_sink.verify_chains(found).count() == 0
    check_journal(found.where("series = 'a'"), [1, 5, 9, 11, 12, 25], "a")
    check_journal(found.where("series = 'b'"), [1, 5, 9, 11, 13, 14, 31], "b")


def test_a_kill_between_write_and_commit_leaves_no_gap_and_no_copy(spark, tmp_path):
    feed(spark, tmp_path, journal_rows([1, 2]))
    commits = tmp_path / "journal" / "commits"
    shutil.move(commits, tmp_path / "aside")
    (tmp_path / "journal" / "commits").write_text("not a folder: the manifest can't be written")
    with pytest.raises(Exception):
        feed(spark, tmp_path, journal_rows([3, 15]))
    assert len(list((tmp_path / "journal" / "records").glob("*.parquet"))) >= 1
    os.replace(commits, tmp_path / "blocked")
    shutil.move(tmp_path / "aside", commits)
    check_journal(feed(spark, tmp_path), [1, 2, 3, 15])


def test_a_kill_after_the_manifest_leaves_one_copy(spark, tmp_path):
    feed(spark, tmp_path, journal_rows([1, 2]))
    feed(spark, tmp_path, journal_rows([3, 15]))
    last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for name in (last.name, f".{last.name}.crc"):  # Spark didn't get to note that the batch is done
        os.replace(last.parent / name, tmp_path / f"lost{name}")
    check_journal(feed(spark, tmp_path), [1, 2, 3, 15])


def test_late_records_stop_the_journal(spark, tmp_path):
    feed(spark, tmp_path, journal_rows([1, 20]))
    with pytest.raises(Exception, match="not behind|comes after"):
        feed(spark, tmp_path, journal_rows([5]))
    assert journal_sink.read_journal(spark, str(tmp_path / "journal")).count() == 4


def test_the_journal_runs_in_a_session_that_names_no_state_store(spark, tmp_path):
    from barledger.plans.queries import QUERIES
    from barledger.streaming.drain import STATE_STORE

    start = pd.Timestamp("2024-01-19 22:00")
    pd.DataFrame({"event_id": range(200), "ts": [start + pd.Timedelta(minutes=3 * k) for k in range(200)], "user_id": 1,
                  "event_type": ["view", "click"] * 100, "value": [10.0 + k % 7 for k in range(200)], "props": "{}"}).to_parquet(
        tmp_path / "events.parquet", coerce_timestamps="us")
    store = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")  # Spark's default
    try:
        found = QUERIES["stream_journal"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(STATE_STORE, store)
    bars = {(r, (start + pd.Timedelta(minutes=3 * k)).floor("15min")) for k in range(200) for r in (["view", "click"][k % 2],)}
    assert {(r.symbol, pd.Timestamp(r.timestamp)) for r in found} == bars and len(found) == len(bars)


def test_damage_is_found(spark, tmp_path):
    found = feed(spark, tmp_path, journal_rows([1, 2, 3, 11, 12]))
    problems = lambda df: {r.problem for r in journal_sink.verify_chains(df).collect()}
    assert problems(found.where("timestamp <> 2")) == {"GAP", "CHAIN"}
    assert problems(found.withColumn("body_hash", F.when(F.col("timestamp") == 3, "x").otherwise(F.col("body_hash")))) == {"RECORD_HASH"}
