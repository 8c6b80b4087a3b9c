import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barledger.operators import campaign, candles, journal, ledger
from barledger.operators.campaign import EVENT_TYPES
from barledger.sources.sinks import append_journal
from barledger.checks import IntegrityError
from barledger.streaming.drain import Closing, drain, series_of
from barledger.streaming.fold import late_rows, stream_states
from barledger.streaming.paper import resume_state, stream_ledger
from barledger.streaming.rollup import closing_tick, real_bars, stream_bars, stream_rollup


def run(spark, make, source, tmp_path, batches, mode="append", name="q"):
    """Feed parquet batches one by one through a query kept by one checkpoint."""
    out = tmp_path / f"{name}-out"
    schema = batches[0].schema
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.parquet(str(source / f"b{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
        q = (make(stream).writeStream.format("parquet").option("path", str(out))
             .option("checkpointLocation", str(tmp_path / f"{name}-ck")).outputMode(mode).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(str(out))


def test_stream_states_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 120
    pdf = pd.DataFrame({"key": rng.choice(["a", "b"], n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="m"),
                        "seq": np.arange(n), "event_type": rng.choice(EVENT_TYPES, n)})
    late = pdf.iloc[:1].assign(event_type="MAJOR_BULL_CONFIRMED")
    parts = [spark.createDataFrame(x) for x in (pdf.iloc[:70], pd.concat([pdf.iloc[70:], late]))]
    got = run(spark, lambda s: stream_states(s, ["key"]), tmp_path / "src", tmp_path, parts)
    assert got.filter("late").count() == 1
    cols = ["key", "seq", "a_core", "b_core", "a_regime", "a_at_risk", "a_watch", "a_last_action", "b_last_action"]
    batch = campaign.ab_trace(spark.createDataFrame(pdf), ["key"])
    a = got.filter("not late").select(cols).orderBy("seq").collect()
    assert a == batch.select(cols).orderBy("seq").collect()


def paper_bars(n=40):
    rng = np.random.default_rng(9)
    return pd.DataFrame({"s": np.where(np.arange(n) % 3 == 0, "x", "y"), "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 17, unit="m"),
                         "open": rng.uniform(90, 110, n), "close": rng.uniform(90, 110, n), "target_exposure": rng.choice([-1.0, 0.0, 1.0], n)})


def test_stream_ledger_equals_batch_and_refuses_what_it_must(spark, tmp_path):
    pdf = paper_bars()
    again = pdf.iloc[[24]]  # the last y bar of the first batch, unchanged
    changed = again.assign(close=1.0)
    late = pdf.iloc[[1]]
    broken = pdf.iloc[[39]].assign(timestamp=pd.Timestamp("2025-01-01"), open=0.0)
    parts = [spark.createDataFrame(x) for x in (pdf.iloc[:25], pd.concat([again, changed, late]), pd.concat([pdf.iloc[25:], broken]))]
    got = run(spark, lambda s: stream_ledger(s, ["s"]), tmp_path / "src", tmp_path, parts)
    seen = {r.status: r["count"] for r in got.groupBy("status").count().collect()}
    # Row 24 belongs to series x; rows arrive sorted, so the late y bar is refused too.
    assert seen == {"PROCESSED": 40, "IDEMPOTENT_NOOP": 1, "CONFLICT": 1, "LATE": 1, "REFUSED_INPUT": 1}
    want = ledger.next_open_ledger(spark.createDataFrame(pdf), ["s"]).orderBy("s", "timestamp").toPandas()
    done = got.filter("status = 'PROCESSED'").orderBy("s", "timestamp").toPandas()
    np.testing.assert_allclose(done["equity"], want["equity"], rtol=1e-12)
    np.testing.assert_allclose(done["held_exposure"], want["held_exposure"])


def test_resume_from_a_verified_journal(spark, tmp_path):
    pdf = paper_bars()
    head, tail = spark.createDataFrame(pdf.iloc[:20]), spark.createDataFrame(pdf.iloc[20:])
    records = journal.build_journal(head, ["s"])
    assert journal.verify_journal(records, ["s"]).filter(F.size("problems") > 0).count() == 0
    state = spark.createDataFrame(resume_state(records, ["s"]).collect())
    got = run(spark, lambda s: stream_ledger(s, ["s"], resume=state), tmp_path / "src", tmp_path, [tail])
    want = ledger.next_open_ledger(spark.createDataFrame(pdf), ["s"])
    both = got.alias("g").join(want.alias("w"), ["s", "timestamp"])
    assert both.count() == 20
    assert both.filter(F.abs(F.col("g.equity") - F.col("w.equity")) > 1e-12).count() == 0


def test_stream_rollup_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    ticks = spark.createDataFrame([("x", start + timedelta(minutes=7 * i), float(i % 13 + 1), 1.0) for i in range(200)], "s string, ts timestamp, price double, qty double")
    # A closing tick far ahead moves the watermark past every bin.
    close = spark.createDataFrame([("x", start + timedelta(days=9), 1.0, 1.0)], ticks.schema)
    got = run(spark, lambda s: stream_bars(s, ["s"], "15 minutes", "1 minute"), tmp_path / "t", tmp_path, [ticks, close, close], name="bars")
    want = candles.bars_from_ticks(ticks, ["s"], 900)
    assert got.select("open_time", "open", "close", "volume").orderBy("open_time").collect() == want.select("open_time", "open", "close", "volume").orderBy("open_time").collect()
    end = want.limit(1).withColumn("open_time", F.lit(start + timedelta(days=9))).withColumn("availability_time", F.lit(start + timedelta(days=9, minutes=15)))
    rolled = run(spark, lambda s: stream_rollup(s, ["s"], "2 hours", "1 minute"), tmp_path / "r", tmp_path, [want, end, end], name="roll")
    cols = ["availability_time", "open", "high", "low", "close", "bars"]
    assert rolled.select(cols).orderBy(cols[0]).collect() == candles.rollup(want, ["s"], "2 hours").select(cols).orderBy(cols[0]).collect()


def test_journal_sink_appends_once(spark, tmp_path):
    src = tmp_path / "j"
    spark.range(3).selectExpr("id as seq", "'h' as record_hash").coalesce(1).write.json(str(src / "b0"))
    for _ in range(2):
        stream = spark.readStream.schema("seq bigint, record_hash string").option("recursiveFileLookup", True).json(str(src))
        append_journal(stream, str(tmp_path / "journal"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.json(str(tmp_path / "journal")).count() == 3


# ---- any order of files, any number of micro-batches --------------------------


def drained(spark, make, closing, ends, rows, tmp_path, files):
    """Rows landed as so many files in descending time, one file per micro-batch."""
    at = "ts" if "ts" in rows.columns else "timestamp"
    pdf = rows.sort_values(at, ascending=False, kind="stable")
    schema = spark.createDataFrame(pdf).schema
    folder = str(tmp_path / f"in{files}")
    for part in np.array_split(np.arange(len(pdf)), files):
        spark.createDataFrame(pdf.iloc[part], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return drain(make(stream), "t", closing, ends)


def event_rows(n=90):
    rng = np.random.default_rng(6)
    return pd.DataFrame({"key": rng.choice(["a", "b"], n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 40, n) * 997, unit="s"),
                         "seq": rng.permutation(n), "event_type": rng.choice(EVENT_TYPES, n)})


@pytest.mark.parametrize("files", [1, 6])
def test_states_do_not_depend_on_file_order(spark, tmp_path, files):
    pdf = event_rows()
    closing = Closing(spark, "key string, closes boolean", "t")
    ends = [series_of(spark.createDataFrame(pdf), ["key"])]
    got = drained(spark, lambda s: stream_states(s, ["key"], lateness_seconds=math.inf, closing=closing.stream()), closing, ends, pdf, tmp_path, files)
    assert got.filter("late").count() == 0
    assert {(r.key, r.late_rows) for r in late_rows(got, ["key"]).collect()} == {("a", 0), ("b", 0)}
    cols = ["key", "seq", "a_core", "b_core", "a_regime", "a_at_risk", "a_watch", "a_last_action", "b_last_action"]
    want = campaign.ab_trace(spark.createDataFrame(pdf), ["key"])
    assert got.select(cols).orderBy("seq").collect() == want.select(cols).orderBy("seq").collect()


def test_events_beyond_the_lateness_are_published_as_late(spark, tmp_path):
    pdf = event_rows()
    closing = Closing(spark, "key string, closes boolean", "t")
    ends = [series_of(spark.createDataFrame(pdf), ["key"])]
    got = drained(spark, lambda s: stream_states(s, ["key"], lateness_seconds=3600.0, closing=closing.stream()), closing, ends, pdf, tmp_path, 5)
    counts = late_rows(got, ["key"]).agg(F.sum("late_rows").alias("late"), F.sum("rows").alias("rows")).first()
    assert counts.rows == len(pdf) and counts.late > 0


@pytest.mark.parametrize("files", [1, 7])
def test_the_ledger_does_not_depend_on_file_order(spark, tmp_path, files):
    pdf = paper_bars()
    closing = Closing(spark, "s string, closes boolean", "t")
    ends = [series_of(spark.createDataFrame(pdf), ["s"])]
    got = drained(spark, lambda s: stream_ledger(s, ["s"], lateness_seconds=math.inf, closing=closing.stream()), closing, ends, pdf, tmp_path, files)
    assert {r.status for r in got.select("status").distinct().collect()} == {"PROCESSED"}
    want = ledger.next_open_ledger(spark.createDataFrame(pdf), ["s"]).orderBy("s", "timestamp").toPandas()
    np.testing.assert_allclose(got.orderBy("s", "timestamp").toPandas()["equity"], want["equity"], rtol=1e-12)


def tied_ticks(n=120):
    rng = np.random.default_rng(12)
    return pd.DataFrame({"s": "x", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 30, n) * 300, unit="s"),
                         "seq": rng.permutation(n), "price": rng.uniform(1, 9, n), "qty": 1.0})


@pytest.mark.parametrize("files", [1, 6])
def test_bars_do_not_depend_on_file_order_or_ties(spark, tmp_path, files):
    pdf = tied_ticks()
    types = "s string, ts timestamp, seq bigint, price double, qty double"
    closing = Closing(spark, types, "t")
    tick = closing_tick(spark.createDataFrame([], types))
    make = lambda s: real_bars(stream_bars(s.unionByName(closing.stream()), ["s"], "15 minutes", "3 hours"))
    got = drained(spark, make, closing, [tick, tick], pdf, tmp_path, files)
    cols = ["open_time", "open", "high", "low", "close", "number_of_trades"]
    want = candles.bars_from_ticks(spark.createDataFrame(pdf), ["s"], 900)
    assert got.select(cols).orderBy("open_time").collect() == want.select(cols).orderBy("open_time").collect()
    first = pdf.sort_values(["ts", "seq"]).iloc[0]
    assert want.orderBy("open_time").first().open == first.price


def test_a_drain_that_drops_rows_stops(spark, tmp_path):
    pdf = tied_ticks()
    with pytest.raises(IntegrityError, match="later than the watermark"):
        drained(spark, lambda s: stream_bars(s, ["s"], "15 minutes", "1 second"), None, [], pdf, tmp_path, 6)
