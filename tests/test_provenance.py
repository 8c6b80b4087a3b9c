import json
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barledger.checks import IntegrityError
from barledger.operators import journal, provenance
from barledger.sources import files, readers, sinks

def freeze():
    return F.lit("2024-01-01").cast("timestamp")


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_manifest_notices_every_byte(spark, tmp_path):
    write(tmp_path / "a/x.csv", "one")
    write(tmp_path / "b/x.csv", "two")  # the same base name elsewhere is another file
    run = F.lit("run1").alias("run_id")
    scan = lambda: files.scan_files(spark, str(tmp_path)).select(run, "path", "sha256", "bytes")
    declared = spark.createDataFrame(scan().collect())
    assert {r.path for r in declared.collect()} == {"a/x.csv", "b/x.csv"}
    head = spark.createDataFrame(provenance.build_manifest(declared, ["run_id"]).collect())
    check = lambda h, d: {(r.path, r.problem) for r in provenance.verify_manifest(h, d, scan(), ["run_id"]).collect()}
    assert check(head, declared) == set()
    assert check(head.withColumn("files", F.lit(9).cast("bigint")), declared) == {(None, "SELF_HASH_MISMATCH")}
    write(tmp_path / "b/x.csv", "twO")
    write(tmp_path / "c.csv", "new")
    assert check(head, declared) == {("b/x.csv", "MISMATCH"), ("c.csv", "EXTRA")}
    with pytest.raises(IntegrityError):
        provenance.build_manifest(declared.unionAll(declared), ["run_id"])


def test_seed(spark):
    files = spark.createDataFrame([("s", "a.csv", "aa"), ("s", "b.csv", "bb")], "seed string, path string, sha256 string")
    root = provenance.set_root(files, ["seed"]).first().root_sha256
    contract = spark.createDataFrame(
        [("s", "PASS", datetime(2024, 1, 1), False, False, 0, root)],
        "seed string, status string, freeze_inclusive timestamp, performance_evaluation_allowed boolean, judgement_allowed boolean, evidence_rows bigint, seed_root_sha256 string")
    assert provenance.verify_seed(contract, files, files, ["seed"], freeze()).count() == 0
    wrong = contract.withColumn("evidence_rows", F.lit(3).cast("bigint"))
    got = provenance.verify_seed(wrong, files, files.filter("path = 'a.csv'"), ["seed"], freeze())
    assert {r.problem for r in got.collect()} == {"EVIDENCE_ROWS", "MISSING"}


def facts(spark, **change):
    row = dict(
        artifact="x", artifact_kind="ab_forward_states", artifact_name="states.csv", artifact_sha256="1" * 64, artifact_bytes=10,
        rows=3, first_timestamp=datetime(2024, 1, 2), last_timestamp=datetime(2024, 1, 4), columns="timestamp,a_core,b_core", acceptable=True,
        source_snapshot_id="snap", source_manifest_sha256="2" * 64, gate_sha256="3" * 64, gate_status="PASS", gate_mode="full",
        gate_scope="FULL_REBUILD_COMPLETE_FORWARD_POOL", gate_freeze=datetime(2024, 1, 1), performance_evaluation_allowed=False,
        judgement_allowed=False, producer_name="p", producer_version="1", producer_code_sha256="A" * 64, parent_sha256=None,
    )
    row.update(change)
    kinds = {"artifact_bytes": "bigint", "rows": "bigint", "first_timestamp": "timestamp", "last_timestamp": "timestamp", "gate_freeze": "timestamp",
             "acceptable": "boolean", "performance_evaluation_allowed": "boolean", "judgement_allowed": "boolean"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row))


def test_contract_is_bound_to_its_facts(spark):
    built = spark.createDataFrame(provenance.build_contracts(facts(spark), freeze()).collect(), provenance.build_contracts(facts(spark), freeze()).schema)
    assert built.first().refused is None
    check = lambda c, f, **kw: provenance.verify_contracts(c, f, ["artifact"], freeze(), **kw).first()
    assert check(built, facts(spark)).verified
    assert check(built, facts(spark, artifact_sha256="9" * 64)).problems == ["ARTIFACT_SHA256"]
    assert "SELF_HASH" in check(built.withColumn("rows", F.lit(4).cast("bigint")), facts(spark)).problems
    assert "GATE_PERFORMANCE" in check(built, facts(spark, performance_evaluation_allowed=True)).problems
    parents = spark.createDataFrame([("x", "4" * 64)], "artifact string, expected_parent_sha256 string")
    assert check(built, facts(spark), parents=parents).problems == ["PARENT"]


@pytest.mark.parametrize("change,reason", [
    ({"gate_status": "FAIL"}, "GATE_NOT_ELIGIBLE"), ({"gate_mode": "monitor"}, "GATE_MODE_NOT_FULL"), ({"acceptable": False}, "CONTENT_REFUSED"),
    ({"gate_freeze": datetime(2023, 1, 1)}, "GATE_FREEZE_MISMATCH"), ({"producer_code_sha256": "zz"}, "PRODUCER_DIGEST_INVALID"), ({"artifact_kind": "other"}, "UNSUPPORTED_KIND"),
])
def test_contract_refusals(spark, change, reason):
    got = provenance.build_contracts(facts(spark, **change), freeze()).first()
    assert (got.refused, got.contract_sha256) == (reason, None)


def test_artifact_profile_refuses_performance_columns(spark):
    df = spark.createDataFrame([("x", datetime(2024, 1, 1), "FLAT", "LONG", 1)], "artifact string, timestamp timestamp, a_core string, b_core string, src_order bigint")
    got = provenance.artifact_profile(df, ["artifact"], "ab_forward_states", freeze()).first()
    assert (got.at_or_before_freeze, got.invalid_a_core, got.invalid_b_core, got.acceptable) == (1, 0, 1, False)
    with pytest.raises(IntegrityError):
        provenance.artifact_profile(df.withColumn("daily_return", F.lit(0.1)), ["artifact"], "ab_forward_states", freeze())


@pytest.fixture(scope="module")
def chain(spark):
    rng = np.random.default_rng(2)
    n = 60
    pdf = pd.DataFrame({"s": np.where(rng.random(n) < 0.7, "hot", "b"), "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 5, unit="h"),
                        "open": rng.uniform(90, 110, n), "close": rng.uniform(90, 110, n), "target_exposure": rng.choice([-1.0, 0.0, 1.0], n)})
    built = journal.build_journal(spark.createDataFrame(pdf), ["s"], seconds=86400)
    return spark.createDataFrame(built.toPandas(), built.schema).cache()


def problems(df):
    rows = journal.verify_journal(df, ["s"], seconds=86400).filter(F.size("problems") > 0).collect()
    return {p for r in rows for p in r.problems}


def test_journal_verifies_and_seals(spark, chain):
    assert chain.count() == 60 and problems(chain) == set()
    links = chain.filter("s = 'hot'").orderBy("seq").collect()
    assert links[0].previous_record_hash == journal.genesis("hot", links[0].segment)
    seals = spark.createDataFrame(journal.seal_segments(chain, ["s"]).collect())
    assert journal.verify_seals(chain, seals, ["s"]).count() == 0
    cut = chain.filter("seq < 20")
    assert journal.verify_seals(cut, seals, ["s"]).count() > 0


@pytest.mark.parametrize("column,value,expected", [
    ("open", "50.0D", {"BODY_HASH", "BAR_HASH"}), ("equity", "7.0D", {"EQUITY", "STATE_AFTER"}),
    ("schema_version", "2", {"SCHEMA_VERSION", "BODY_HASH"}), ("record_hash", "'00'", {"RECORD_HASH", "CHAIN"}),
    ("seq", "99L", {"SEQUENCE"}),
])
def test_journal_tampering_is_seen(chain, column, value, expected):
    edited = chain.withColumn(column, F.when((F.col("s") == "hot") & (F.col("seq") == 7), F.expr(value)).otherwise(F.col(column)))
    assert expected <= problems(edited)


def test_dropped_record_is_seen(chain):
    assert "SEQUENCE" in problems(chain.filter("not (s = 'hot' and seq = 7)"))


def test_public_view_has_no_performance(spark, chain):
    status = journal.public_view(journal.journal_status(chain.withColumn("profit", F.lit(1.0)), ["s"]), ["s"])
    assert set(status.columns) == {"s", "seq", "last_timestamp", "held_exposure", "pending_target", "tail_hash"}
    assert provenance.embargoed_columns(status.columns) == []


def test_readers_and_sinks(spark, tmp_path):
    write(tmp_path / "k/a.csv", "open_time,open,high,low,close,volume,c,q,n,t,u,i\n1704067200000,1,2,0.5,1.5,10,0,0,7,0,0,0\n1704068100000000,1,2,1,1.5,10,0,0,8,0,0,0\n")
    bars = readers.read_klines(spark, str(tmp_path / "k"), 900).orderBy("open_time").collect()
    assert [str(r.availability_time) for r in bars] == ["2024-01-01 00:15:00", "2024-01-01 00:30:00"]
    write(tmp_path / "bad/a.csv", "1704067200000,1,2\n")
    with pytest.raises(Exception, match="12 fields"):
        readers.read_klines(spark, str(tmp_path / "bad"), 900).collect()

    lo, hi = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")
    doc = lambda *c: json.dumps({"data": {"pair": "p", "ohlc": [dict(zip(("timestamp", "open", "high", "low", "close", "volume"), map(str, x))) for x in c]}})
    payloads = spark.createDataFrame([("p", 0, doc((1704067200, 1, 2, 1, 1, 5))), ("p", 1, doc((1704067200, 3, 3, 3, 3, 5), (1704240000, 9, 9, 9, 9, 9)))], "pair string, src_order int, payload string")
    got = readers.parse_ohlc_payloads(payloads, ["pair"], lo, hi).collect()
    assert [(r.open, r.high) for r in got] == [(3.0, 3.0)]
    arrays = spark.createDataFrame([("p", 0, "[[1704067200, 1, 4, 2, 3, 9]]")], "pair string, src_order int, payload string")
    r = readers.parse_candle_arrays(arrays, ["pair"], lo, hi, 900).first()
    assert (r.low, r.high, r.open, r.close, r.volume) == (1.0, 4.0, 2.0, 3.0, 9.0)

    write(tmp_path / "t.csv", "timestamp,core_side,major_direction\n2024-01-01T00:00:00Z,1,1\n2024-01-01 00:00:00+00:00,-1,1\n")
    t = readers.read_timeline(spark, str(tmp_path / "t.csv")).collect()
    assert [(r.core_side, r.major_at_risk) for r in t] == [(-1, False)]

    write(tmp_path / "e.jsonl", '{"timestamp": "2024-01-01T00:00:00Z", "open": 1, "close": 2, "target_exposure": 0}\n')
    assert readers.read_execution_bars(spark, str(tmp_path / "e.jsonl")).count() == 1
    write(tmp_path / "f.jsonl", '{"open": 1}\n\n[1]\n')
    with pytest.raises(IntegrityError):
        readers.read_execution_bars(spark, str(tmp_path / "f.jsonl"))
    with pytest.raises(IntegrityError):
        readers.read_state_ledger(spark, str(tmp_path / "x.txt"))
    write(tmp_path / "g/gate.json", json.dumps({"status": "PASS", "state_only": True}, indent=1))
    assert readers.read_gates(spark, str(tmp_path / "g")).first().state_only is True

    series = spark.createDataFrame([("v", "X", "15m", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 15), 1.0, 1.0, 1.0, 1.0, 1.0, 1)],
                                   "venue string, symbol string, tf string, open_time timestamp, availability_time timestamp, open double, high double, low double, close double, volume double, number_of_trades bigint")
    for fmt in ("parquet", "csv"):
        sinks.write_bars(series, str(tmp_path / f"out-{fmt}"), fmt=fmt)
        assert (tmp_path / f"out-{fmt}/venue=v/symbol=X/tf=15m").is_dir()
    back = readers.read_bars(spark, str(tmp_path / "out-csv/venue=v/symbol=X/tf=15m/*.csv.gz")).first()
    assert (back.open_time, back.close) == (datetime(2024, 1, 1), 1.0)
    sinks.write_record(spark.createDataFrame([("PASS",)], "status string"), str(tmp_path / "gate_out"))
    with pytest.raises(IntegrityError):
        sinks.write_record(spark.range(2), str(tmp_path / "two"))
    sinks.write_table(series, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1


def test_no_two_records_share_an_encoding(spark):
    from barledger.functions.digest import record_hash

    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), ("a", "null"), ("a", "-"), ("a", ""), ("", "a"), (None, "a"), ("1:a", ""), ("a1:", "b")]
    got = spark.createDataFrame(rows, "x string, y string").select(record_hash([F.col("x"), F.col("y")]).alias("h")).collect()
    assert len({r.h for r in got}) == len(rows)


def test_copies_of_an_event_are_rejected_with_a_reason(spark):
    from barledger.operators import campaign

    at = datetime(2024, 1, 1)
    rows = [("k", at, 1, "MAJOR_BULL_CONFIRMED"), ("k", at, 5, "MAJOR_BULL_CONFIRMED"), ("k", at, 3, "MAJOR_BULL_RISK"), ("k", at, 9, "NEWS")]
    ok, bad = campaign.split_events(spark.createDataFrame(rows, "key string, ts timestamp, seq bigint, event_type string"), ["key"])
    assert sorted(r.seq for r in ok.collect()) == [1, 3]
    assert {r.seq: r.reasons for r in bad.collect()} == {5: ["duplicate_event"], 9: ["unknown_event_type"]}


def test_a_timeline_knows_one_word_for_risk(spark, tmp_path):
    lines = ["timestamp,core_side,major_direction,major_at_risk"]
    lines += [f"2024-01-01 00:0{k}:00,1,1,{flag}" for k, flag in enumerate(("TRUE", "true", "1", "yes", "false", ""))]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    got = readers.read_timeline(spark, str(tmp_path / "t.csv")).orderBy("timestamp").collect()
    assert [r.major_at_risk for r in got] == [True, True, False, False, False, False]


def test_a_state_ledger_may_have_no_close(spark, tmp_path):
    (tmp_path / "s.csv").write_text("timestamp,a_core,b_core,bear_epoch_id\n2024-01-01 00:00:00,FLAT,FLAT,e1\n")
    (tmp_path / "c.csv").write_text("timestamp,a_core,b_core,bear_epoch_id,close\n2024-01-01 00:00:00,FLAT,FLAT,e1,2.5\n")
    assert readers.read_state_ledger(spark, str(tmp_path / "s.csv")).first().close is None
    assert readers.read_state_ledger(spark, str(tmp_path / "c.csv")).first().close == 2.5
