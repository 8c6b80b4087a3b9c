"""Medians by selection, windows of any width, parent chains, digest trees and file digests."""

import hashlib
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barledger.checks import IntegrityError
from barledger.operators import evidence, intervals, provenance, refresh, selection
from barledger.sources import files, sinks

START = datetime(2024, 1, 1)


def test_medians_are_exact_at_every_size_and_shape(spark):
    rng = random.Random(2)
    groups = {
        "hot": [rng.gauss(0, 1) for _ in range(6001)], "even": [rng.gauss(5, 2) for _ in range(500)], "one": [4.25], "two": [1.0, 2.0],
        "same": [7.0] * 400, "clusters": [1e-9 * rng.random() for _ in range(300)] + [1e9 + rng.random() for _ in range(300)],
        "ties": [float(rng.randint(0, 3)) for _ in range(999)], None: [3.0, 9.0, 4.0],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("none", None), ("even", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for few in (1, 50, 4096):
        got = {r.k: r.median for r in selection.exact_medians(df, ["k"], "v", few=few).collect()}
        assert got.pop("none") is None
        assert got.keys() == groups.keys()
        for k, values in groups.items():
            assert got[k] == pytest.approx(statistics.median(values), rel=1e-15, abs=1e-300), k
    assert selection.exact_medians(df.limit(0), ["k"], "v").count() == 0


def test_points_meet_windows_of_any_width(spark):
    rng = random.Random(3)
    at = lambda us: START + timedelta(microseconds=us)
    points = [(rng.choice("ab"), at(rng.randint(-10**7, 10**7)), n) for n in range(150)]
    windows = []
    for w in range(120):
        begin = rng.randint(-10**7, 10**7)
        windows.append((rng.choice("ab"), at(begin), at(begin + rng.choice([-5, 0, 1, 2, 3, 900, 10**4, 2**20, 2**20 + 1, 3 * 10**6])), w))
    windows += [("a", points[0][1], points[0][1] + timedelta(microseconds=1), 500), ("b", None, at(5), 501), ("b", at(5), None, 502)]
    p = spark.createDataFrame(points, "s string, t timestamp, n int")
    w = spark.createDataFrame(windows, "s string, start timestamp, end timestamp, w int")
    got = sorted((r.n, r.w) for r in intervals.points_in_windows(p, w, ["s"], "t").collect())
    want = sorted((n, k) for s, t, n in points for z, a, b, k in windows if s == z and a and b and a <= t < b)
    assert got == want and want
    assert intervals.points_in_windows(p, w.limit(0), ["s"], "t").count() == 0
    bars = p.withColumnRenamed("t", "open_time").dropDuplicates(["s", "open_time"])
    held = {(r.s, r.open_time) for r in intervals.bars_in_windows(bars, w, ["s"]).collect()}
    assert held == {(s, t) for s, t, n in points if any(n == m for m, _ in want)}


def test_parent_chains_of_any_depth(spark):
    rows = [("x", f"{n:03d}", f"{n - 1:03d}" if n else None) for n in range(100)]
    rows += [("x", "b1", "gone"), ("x", "b2", "B1"), ("x", "c1", "c3"), ("x", "c2", "c1"), ("x", "c3", "c2"), ("x", "d", "c2"), ("x", "e", "e"), ("y", "099", None)]
    df = spark.createDataFrame(rows, "k string, contract_sha256 string, parent_sha256 string")
    got = {(r.k, r.digest): (r.depth, r.end, r.status) for r in provenance.parent_chains(df, ["k"]).collect()}
    assert len(got) == len(rows)
    assert all(got["x", f"{n:03d}"] == (n, "000", "OK") for n in range(100)) and got["y", "099"] == (0, "099", "OK")
    assert got["x", "b1"] == (1, "gone", "MISSING_ANCESTOR") and got["x", "b2"] == (2, "gone", "MISSING_ANCESTOR")
    assert all(got["x", c] == (None, None, "CYCLE") for c in ("c1", "c2", "c3", "d", "e"))
    # Broken in the middle: everything above the break ends there.
    cut = {r.digest: (r.depth, r.status) for r in provenance.parent_chains(df.where("contract_sha256 <> '050' and k = 'x'"), ["k"]).collect()}
    assert cut["049"] == (49, "OK") and cut["099"] == (49, "MISSING_ANCESTOR")
    with pytest.raises(IntegrityError, match="one digest"):
        provenance.parent_chains(df.unionAll(df), ["k"])


def test_trees_find_what_a_full_comparison_finds(spark):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ours = [("r", f"d/{n}.csv", digest(f"{n}")) for n in range(300)] + [("q", "only.csv", digest("q"))]
    theirs = [("r", f"d/{n}.csv", digest(f"{n}" + "!" * (n == 7))) for n in range(1, 301)] + [("s", "new.csv", digest("s"))]
    a, b = (spark.createDataFrame(x, "k string, path string, sha256 string") for x in (ours, theirs))
    ta, tb = (provenance.digest_tree(x, ["k"]).persist() for x in (a, b))
    full = provenance.compare_files(a, b, ["k"]).where("problem <> 'OK'")
    found = provenance.compare_trees(a, b, ta, tb, ["k"])
    assert sorted(map(str, found.collect())) == sorted(map(str, full.select(*found.columns).collect())) and found.count() == 5
    assert provenance.unlike_leaves(ta, tb, ["k"]).count() <= 5 and provenance.unlike_leaves(ta, ta, ["k"]).count() == 0
    assert ta.where("level = 0 and k = 'r'").first().files == 300


def test_files_are_digested_block_by_block(spark, tmp_path, monkeypatch):
    bodies = {"a.bin": b"", "sub/b.bin": random.Random(1).randbytes(9 << 20), "sub/c.txt": b"text", "sub/deep/é x.bin": b"\x00" * 70}
    for name, body in bodies.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    (tmp_path / "in" / "_SUCCESS").write_text("")
    for root in (str(tmp_path / "in"), f"file:{tmp_path}/in", f"file://{tmp_path}/in"):
        got = {r.path: (r.sha256, r.bytes) for r in files.scan_files(spark, root).collect()}
        assert got == {n: (hashlib.sha256(b).hexdigest(), len(b)) for n, b in bodies.items()}
    assert files.scan_files(spark, str(tmp_path / "in"), "*.txt").count() == 1
    assert files.packed([("a", 5), ("b", 6), ("c", 50), ("d", 1), ("e", 9)], 10) == [["a"], ["b"], ["c"], ["d", "e"]]


def day_ticks(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, price double, qty double")


def test_a_refresh_replaces_its_days_and_reports_what_it_cannot_reach(spark, tmp_path):
    rng = random.Random(23)
    path, keys = str(tmp_path / "bars"), ["symbol"]
    end = F.lit(START + timedelta(days=20)).cast("timestamp_ntz")
    ticks = [(s, START + timedelta(minutes=7 * k), k, 10 + rng.random(), rng.random()) for s in "AB" for k in range(4300) if s == "A" or k % 5]
    known = [t for t in ticks if t[2] % 3 or t[1] < START + timedelta(days=13)]
    first = refresh.first_refreshed_day(end)

    def rebuilt(rows, at=end):
        return refresh.day_digests(refresh.bars_by_day(day_ticks(spark, rows), keys, 900, at), keys)

    def stored():
        return refresh.day_digests(spark.read.parquet(path), keys)

    sinks.write_days(refresh.bars_by_day(day_ticks(spark, known), keys, 900, end - F.expr("interval 30 hours")), path)
    stale = refresh.audit_refresh(stored(), rebuilt(ticks), keys, first).collect()
    assert {r.day.day for r in stale if not r.matches} == set(range(14, 22))
    sinks.write_days(refresh.bars_by_day(day_ticks(spark, ticks), keys, 900, end, first), path)
    fresh = refresh.audit_refresh(stored(), rebuilt(ticks), keys, first).collect()
    assert all(r.matches and r.bars_stored == r.bars_rebuilt for r in fresh)
    assert {(r.day.day, r.scope) for r in fresh} == {(d, "REFRESHED" if d >= 13 else "KEPT") for d in range(1, 22)}
    # A change before the overlap and a day whose ticks are withdrawn are reported, and nothing else.
    other = [(s, t, q, p + (s == "A" and t.day == 4), n) for s, t, q, p, n in ticks if (s, t.day) != ("B", 17)]
    sinks.write_days(refresh.bars_by_day(day_ticks(spark, other), keys, 900, end, first), path)
    wrong = {(r.symbol, r.day.day) for r in refresh.audit_refresh(stored(), rebuilt(other), keys, first).collect() if not r.matches}
    assert wrong == {("A", 4), ("A", 5)}
    only = [t for t in ticks if t[1] < START + timedelta(days=18)]
    sinks.write_days(refresh.bars_by_day(day_ticks(spark, only), keys, 900, end, first), path)
    gone = [r for r in refresh.audit_refresh(stored(), rebuilt(only), keys, first).collect() if not r.matches and r.day.day > 5]
    assert {(r.symbol, r.day.day, r.bars_rebuilt) for r in gone} == {(s, d, 0) for s in "AB" for d in (20, 21)}


def test_an_empty_table_is_refreshed_and_odd_bar_widths_are_refused(spark, tmp_path):
    end, none = F.lit(START).cast("timestamp_ntz"), day_ticks(spark, [])
    bars = refresh.bars_by_day(none, ["symbol"], 900, end, refresh.first_refreshed_day(end))
    sinks.write_days(bars, str(tmp_path / "none"))
    found = refresh.day_digests(bars, ["symbol"])
    assert refresh.audit_refresh(found, found, ["symbol"], refresh.first_refreshed_day(end)).count() == 0
    with pytest.raises(IntegrityError):
        refresh.bars_by_day(none, ["symbol"], 7000, end)


def held_rows(spark, pairs):
    rows = [("A", START + timedelta(days=k), a, b, a != b, 1, int(k == 0), 1, 0.01, 0.02, 0.0, 1.0) for k, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, a_held double, b_held double, in_segment boolean, segment_no long, "
                                       "segment_start int, bear_epoch_id long, a_gross double, b_gross double, a_turnover double, b_turnover double")


def test_segments_refuse_any_divergence_but_a_short_b_flat(spark):
    found = evidence.divergence_segments(held_rows(spark, [(-1.0, 0.0), (-1.0, 0.0), (1.0, 1.0)]), ["symbol"], (7.0,)).collect()
    assert [(r.segment_id, r.bars) for r in found] == [(1, 2)]
    for pair in ((0.0, -1.0), (1.0, 0.0), (-1.0, 1.0)):
        bad = evidence.divergence_segments(held_rows(spark, [(-1.0, 0.0), pair]), ["symbol"], (7.0,))
        with pytest.raises(Exception, match="illegal divergence"):
            bad.select("segment_id").collect()
    assert evidence.divergence_segments(held_rows(spark, [(0.0, 0.0)]), ["symbol"]).count() == 0
