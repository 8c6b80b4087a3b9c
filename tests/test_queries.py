"""A few registered queries against DuckDB, and the evaluation flow end to end."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from oracle import ORACLE
from barledger.plans.queries import QUERIES
from barledger.plans import testbed as tb
from barledger.plans.evaluation import evaluate

SF = "/root/testdata/sf0.001"
NAMES = ["bars_15m", "rollup_1w_compat", "window_summary", "integrity_audit", "gap_rows", "coverage_audit", "monitor_refresh", "executed_apart", "segments_exec", "ab_trace", "risk_allocation"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(oracle_sql()[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall()
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in got.select(*cols).collect()) == order(want)


def test_evaluation_flow(spark):
    out = evaluate(tb.bars_1d(spark, SF), tb.day_events(spark, SF), ["symbol"])
    assert out["invariants"].filter("status <> 'PASS'").count() == 0
    assert out["labels"].count() == 15  # five symbols, three costs
    segments, epochs = out["segments"], out["epochs"]
    assert segments.filter("bear_epoch_id is not null").count() == (epochs.agg({"segments": "sum"}).first()[0] or 0)
