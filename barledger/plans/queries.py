"""Named queries over the driver's tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barledger import schemas
from barledger.functions import clock, predicates
from barledger.functions.digest import bar_hash
from barledger.operators import (
    asof, attribution, campaign, candles, dedupe, evidence, exposure, gates, intervals, journal, ledger,
    ordered, provenance, quality, reconcile, refresh,
)
from barledger.plans import evaluation, testbed as tb
from barledger.checks import fail_closed
from barledger.operators.candles import bars_from_ticks
from barledger.session import checkpoint_root, materialise
from barledger.sources import files, journal_sink, readers, sinks
from barledger.streaming import rollup
from barledger.streaming.chunks import (
    SETTLED, Stages, beats_after, checked_recovery, measured_lateness, none_late, settled_chunks, settled_ledger, settled_states, stream_retries,
)
from barledger.streaming.drain import Closing, drain
from barledger.streaming.paper import resume_state
from barledger.streaming.rollup import closing_tick, real_bars, stream_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
K = ["symbol"]
FREEZE = "timestamp_ntz'2024-01-10 02:00:00'"
CUTOFF = "timestamp_ntz'2024-01-20 00:00:00'"
DAY_FREEZE = "timestamp_ntz'1998-06-01 00:00:00'"
LOCKED = {
    "1-URGENT": evidence.ADVERSE, "2-HIGH": evidence.MIXED, "3-MEDIUM": evidence.SUPPORT,
    "4-NOT SPECIFIED": evidence.MIXED, "5-LOW": evidence.ADVERSE,
}
DAYS_PER_YEAR = 365.25


def tidy(df: DataFrame) -> DataFrame:
    """Published form: doubles to 8 decimals without negative zero, whole numbers as bigint."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 8) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.drop(ordered.CHUNK).select(*[c for c, f in zip(cols, df.schema.fields) if f.name != ordered.CHUNK])


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(fn(spark, sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# ---- flagship ---------------------------------------------------------------


@query
def ab_final_equity(spark, sf):
    """Final equity per symbol and rule set, from ticks and events."""
    return evaluation.final_equity(tb.bars_15m(spark, sf), tb.tick_events(spark, sf), K)


# ---- bars, clocks and row checks --------------------------------------------


@query
def bars_15m(spark, sf):
    return tb.bars_15m(spark, sf)


@query
def bars_1d(spark, sf):
    return tb.bars_1d(spark, sf)


@query
def epoch_normalise(spark, sf):
    at = clock.epoch_to_timestamp(F.col("epoch")).cast("timestamp_ntz")
    return tb.mixed_epochs(spark, sf).select("event_id", at.alias("open_time"))


@query
def eligible_forward(spark, sf):
    return clock.eligible_forward(tb.bars_15m(spark, sf), F.expr(FREEZE), F.expr(CUTOFF))


@query
def eligible_warmup(spark, sf):
    return clock.eligible_warmup(tb.bars_15m(spark, sf), F.expr(FREEZE))


@query
def request_window(spark, sf):
    inside = clock.request_window(tb.bars_15m(spark, sf), F.expr(FREEZE), F.expr(CUTOFF))
    return inside.groupBy(*K, clock.month_key(F.col("open_time")).alias("month")).agg(F.count("*").alias("bars"))


@query
def finite_check(spark, sf):
    n = F.col("seq")
    text = F.when(n % 11 == 0, "n/a").when(n % 13 == 0, "NaN").when(n % 17 == 0, "Infinity").otherwise(F.col("price").cast("string"))
    rows = tb.ticks(spark, sf).withColumn("finite", predicates.finite_double(text))
    return rows.groupBy(*K).agg(F.count("*").alias("rows"), F.count("finite").alias("finite_rows"), F.max("finite").alias("max_finite"))


@query
def canonical_bars(spark, sf):
    at = F.col("availability_time")
    return tb.bars_15m(spark, sf).select(
        *K, at, "open", "close", bar_hash(at, F.col("open"), F.col("close"), F.lit(1.0)).alias("bar_hash")
    )


@query
def dedupe_last(spark, sf):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    rows = tb.ticks(spark, sf).select(*K, hour.alias("open_time"), "price", F.col("seq").alias("src_order"))
    return dedupe.dedupe_last(rows, [*K, "open_time"])


@query
def union_periods(spark, sf):
    bars = tb.venue_bars(spark, sf)
    parts = [bars.filter(F.col("venue") == v).select(*K, "open_time", "close") for v in ("V1", "V2")]
    return dedupe.union_periods(parts)


@query
def event_violations(spark, sf):
    return campaign.event_violations(tb.dirty_events(spark, sf), K, F.expr(FREEZE))


# ---- roll-ups ---------------------------------------------------------------


@query
def rollup_2h(spark, sf):
    return candles.rollup(tb.bars_15m(spark, sf), K, "2 hours")


@query
def rollup_1d(spark, sf):
    return candles.rollup(tb.bars_15m(spark, sf), K, "1 day")


@query
def rollup_72h(spark, sf):
    return candles.rollup(tb.bars_15m(spark, sf), K, "72 hours")


@query
def rollup_1w(spark, sf):
    return candles.rollup_week(tb.bars_1d(spark, sf), K)


@query
def rollup_1w_compat(spark, sf):
    return candles.rollup_week(tb.bars_15m(spark, sf), K, compat=True)


@query
def rollup_3d_year(spark, sf):
    return candles.rollup_three_day_of_year(tb.bars_1d(spark, sf), K)


@query
def rollup_week_open(spark, sf):
    return candles.rollup_week_of_open(tb.bars_1d(spark, sf), K)


@query
def rollup_traded(spark, sf):
    return candles.rollup_traded(tb.bars_15m(spark, sf), K, "2 hours", min_trades=2)


@query
def rebuild_complete(spark, sf):
    return candles.rebuild_complete(tb.bars_15m(spark, sf), K, 3600, 4)


# ---- data quality -----------------------------------------------------------


@query
def window_audit(spark, sf):
    return quality.window_audit(tb.off_grid_bars(spark, sf), K)


@query
def gap_windows(spark, sf):
    return quality.gap_windows(quality.window_audit(tb.off_grid_bars(spark, sf), K))


@query
def quarantined_windows(spark, sf):
    return quality.quarantined_windows(quality.window_audit(tb.off_grid_bars(spark, sf), K))


@query
def window_summary(spark, sf):
    return quality.window_summary(quality.window_audit(tb.off_grid_bars(spark, sf), K), K)


@query
def rollup_quarantined(spark, sf):
    """Roll-up with quarantined windows kept out."""
    bars = tb.off_grid_bars(spark, sf)
    audit = quality.window_audit(bars, K, clocks=["2h"])
    return quality.without_quarantined(candles.rollup(bars, K, "2 hours"), audit, K, "2h")


@query
def integrity_audit(spark, sf):
    return quality.integrity_audit(tb.dirty_bars(spark, sf), K, start=F.expr(FREEZE), end=F.expr(CUTOFF))


@query
def gap_rows(spark, sf):
    return quality.gap_rows(tb.bars_15m(spark, sf), K)


@query
def gap_totals(spark, sf):
    return quality.gap_totals(quality.gap_rows(tb.bars_15m(spark, sf), K), K)


def _native_2h(spark, sf):
    return tb.native_bars_2h(spark, sf)


def _derived_2h(spark, sf):
    return candles.rollup(tb.bars_15m(spark, sf), K, "2 hours")


@query
def parity_summary(spark, sf):
    return quality.parity_summary(_derived_2h(spark, sf), _native_2h(spark, sf), K)


@query
def parity_mismatch(spark, sf):
    return quality.parity_mismatch(_derived_2h(spark, sf), _native_2h(spark, sf), K, 8)


def _patch_inputs(spark, sf):
    """A damaged hourly tape, and complete hours rebuilt from 15-minute bars."""
    truth = candles.rebuild_complete(tb.bars_15m(spark, sf), K, 3600, 4)
    return tb.damaged_hours(spark, sf), truth


@query
def affected_bars(spark, sf):
    wrong = quality.parity_mismatch(_derived_2h(spark, sf), _native_2h(spark, sf), K, 8)
    windows = wrong.select(*K, F.col("availability_time").alias("window_end"))
    return reconcile.affected_bars(tb.bars_15m(spark, sf), windows, K, 7200)


@query
def patched_bars(spark, sf):
    return reconcile.patched_bars(*_patch_inputs(spark, sf), K, 3600)


@query
def patch_log(spark, sf):
    return reconcile.patch_log(*_patch_inputs(spark, sf), K)


def _reconciled(spark, sf):
    base, truth = _patch_inputs(spark, sf)
    native = candles.bars_from_ticks(tb.ticks(spark, sf), K, 7200)
    before = candles.rollup(base, K, "2 hours")
    wrong = quality.parity_mismatch(before, native, K, 2)
    return reconcile.reconcile_result(reconcile.patched_bars(base, truth, K, 3600), native, wrong, K, "2 hours")


@query
def reconcile_result(spark, sf):
    return _reconciled(spark, sf)


@query
def reconcile_accept(spark, sf):
    return reconcile.reconcile_accept(_reconciled(spark, sf), K)


# ---- coverage and gates -----------------------------------------------------


def _expected_hours(spark, sf):
    m = tb.hourly_manifest(spark, sf)
    spans = m.groupBy("symbol", "interval").agg(F.min("period").alias("first"), F.max("period").alias("last"))
    return m, spans


@query
def coverage_audit(spark, sf):
    m, spans = _expected_hours(spark, sf)
    return gates.coverage_failures(m, ["symbol", "interval"], spans, "1 hour")


USER_START, USER_END = "timestamp_ntz'2024-01-01'", "timestamp_ntz'2024-01-30'"


def _series_gate(spark, sf):
    series, manifest = tb.user_series(spark, sf)
    keys = ["user_id", "interval"]
    periods = gates.classify_periods(series, manifest, keys, F.expr(USER_START), F.expr(USER_END))
    audit = manifest.groupBy(*keys).agg(
        F.sum(F.when(F.col("period") > F.expr("timestamp_ntz'2024-01-10'"), F.col("rows")).otherwise(0)).alias("eligible_rows"),
        F.count_if(F.col("rows") > 8).alias("hard_failures"),
    )
    return gates.series_gate(periods, audit, keys)


@query
def source_gate(spark, sf):
    return _series_gate(spark, sf)


@query
def overall_gate(spark, sf):
    return gates.overall_gate(_series_gate(spark, sf), ["interval"])


@query
def final_gate(spark, sf):
    audit = quality.integrity_audit(tb.dirty_bars(spark, sf), K)
    required = audit.select(*K)
    hard = gates.integrity_failures(audit, required, K)
    return gates.final_gate(hard, quality.parity_summary(_derived_2h(spark, sf), _native_2h(spark, sf), K))


@query
def readiness(spark, sf):
    return gates.readiness(*tb.user_gates(spark, sf))


@query
def monitor_scope(spark, sf):
    return gates.monitor_scope(tb.bars_15m(spark, sf), F.expr(CUTOFF))


@query
def monitor_refresh(spark, sf):
    """A table landed before its last days were known, refreshed by overlap, against a rebuild from all ticks."""
    path = os.path.join(checkpoint_root(spark), f"monitor-bars-{uuid.uuid4().hex}")
    ticks, end = tb.ticks(spark, sf), F.expr(CUTOFF)
    landed_at, late_from = end - F.expr("interval 71 hours"), end - F.expr("interval 6 days")
    in_time = (F.col("ts") < late_from) | (F.col("seq") % 7 != 0)
    sinks.write_days(refresh.bars_by_day(ticks.where(in_time), K, 900, landed_at), path)
    schema = refresh.bars_by_day(ticks, K, 900, end).schema
    stored = spark.read.schema(schema).parquet(path)
    before = materialise(refresh.day_digests(stored, K), "refresh-before")
    first = refresh.first_refreshed_day(end)
    sinks.write_days(refresh.bars_by_day(ticks, K, 900, end, first), path)
    after = refresh.day_digests(spark.read.schema(schema).parquet(path), K)
    rebuilt = refresh.day_digests(refresh.bars_by_day(ticks, K, 900, end), K)
    landed = before.select(F.col("symbol"), F.col("day"), F.col("digest").alias("landed"))
    changed = after.join(landed, ["symbol", "day"], "left").select("symbol", "day", (~F.col("digest").eqNullSafe(F.col("landed"))).alias("changed"))
    return refresh.audit_refresh(after, rebuilt, K, first).join(changed, ["symbol", "day"], "left")


@query
def checksum_audit(spark, sf):
    return provenance.compare_files(*tb.day_files(spark, sf), K)


# ---- states -----------------------------------------------------------------


@query
def campaign_states_a(spark, sf):
    events = tb.tick_events(spark, sf)
    return campaign.campaign_states(events, K, "A", seconds=ordered.suggest_chunk_seconds(events, K, "ts"))


@query
def campaign_states_b(spark, sf):
    events = tb.tick_events(spark, sf)
    return campaign.campaign_states(events, K, "B", seconds=ordered.suggest_chunk_seconds(events, K, "ts"))


@query
def ab_trace(spark, sf):
    events = tb.tick_events(spark, sf)
    return campaign.ab_trace(events, K, seconds=ordered.suggest_chunk_seconds(events, K, "ts"))


@query
def ab_trace_users(spark, sf):
    """Many short series instead of a few long ones."""
    events = tb.tick_events(spark, sf, "user_id")
    return campaign.ab_trace(events, ["user_id"], seconds=ordered.suggest_chunk_seconds(events, ["user_id"], "ts"))


def _tick_timeline(spark, sf):
    return evaluation.published_timeline(tb.tick_events(spark, sf), K)


def _day_timeline(spark, sf):
    return evaluation.published_timeline(tb.day_events(spark, sf), K)


@query
def asof_states(spark, sf):
    line = _tick_timeline(spark, sf)
    known = asof.asof_states(tb.bars_15m(spark, sf), line, K, ledger.STATE_COLUMNS, seconds=evaluation.line_width(line, K))
    return known.select(*K, "open_time", "availability_time", *ledger.STATE_COLUMNS)


@query
def state_invariants(spark, sf):
    """Timeline A at every event against timeline B listing only its changes."""
    line = _tick_timeline(spark, sf)
    a = line.select(*K, "ts", "seq", F.col("a_side").alias("side"), "direction")
    b = line.select(*K, "ts", "seq", F.col("b_side").alias("side"), "direction")
    width = evaluation.line_width(line, K)
    seen = ordered.previous_row(b, K, ["ts", "seq"], ["side", "direction"], width)
    changed = ~F.struct("side", "direction").eqNullSafe(F.col("prev"))
    b_changes = seen.filter(changed).drop("prev", ordered.CHUNK)
    return evidence.state_invariants(asof.align_timelines(a, b_changes, K, ["side", "direction"], width), K)


@query
def flip_violations(spark, sf):
    line = _tick_timeline(spark, sf)
    return evidence.flip_violations(line, K, "a_side", evaluation.line_width(line, K))


# ---- ledgers ----------------------------------------------------------------


def _tick_targets(spark, sf):
    return evaluation.target_bars(tb.bars_15m(spark, sf), _tick_timeline(spark, sf), K)


@query
def next_open_ledger(spark, sf):
    return ledger.next_open_ledger(_tick_targets(spark, sf), [*K, "candidate"])


@query
def ledger_violations(spark, sf):
    return ledger.ledger_violations(_tick_targets(spark, sf), [*K, "candidate"])


@query
def exec_ledger(spark, sf):
    line = _day_timeline(spark, sf)
    return ledger.candidate_ledger(tb.bars_1d(spark, sf), line, K, seconds=evaluation.line_width(line, K))


@query
def drawdown(spark, sf):
    full = evaluation.published_ledger(tb.bars_15m(spark, sf), _tick_timeline(spark, sf), K)
    return full.groupBy(*K, "candidate").agg(F.min("drawdown").alias("max_drawdown"), F.max("equity").alias("peak"))


def _core(side: str):
    return F.when(F.col(side) == 1, "CORE_LONG").when(F.col(side) == -1, "CORE_SHORT").otherwise("FLAT")


def _closes(spark, sf):
    line = _day_timeline(spark, sf)
    known = asof.asof_states(tb.bars_1d(spark, sf), line, K, ledger.STATE_COLUMNS, seconds=evaluation.line_width(line, K))
    return known.select(
        *K, F.col("availability_time").alias("timestamp"), "close",
        _core("a_side").alias("a_core"), _core("b_side").alias("b_core"), "direction",
    )


@query
def paired_close(spark, sf):
    return ledger.close_ledger(_closes(spark, sf), K).drop("segment_start", "divergent")


@query
def segments_close(spark, sf):
    return evidence.close_segments(ledger.close_ledger(_closes(spark, sf), K), K)


# ---- evidence ---------------------------------------------------------------


def _day_rows(spark, sf):
    return evaluation.published_rows(tb.bars_1d(spark, sf), _day_timeline(spark, sf), K)


def _day_segments(spark, sf, costs=(7.0,)):
    return evidence.divergence_segments(_day_rows(spark, sf), K, costs)


@query
def executed_invariants(spark, sf):
    both = ledger.by_candidate(_day_rows(spark, sf), K, (7.0,))
    return evidence.executed_invariants(both.filter("candidate = 'A'"), both.filter("candidate = 'B'"), K)


@query
def executed_apart(spark, sf):
    """The same checks on ledgers that two venues computed apart, each with bars the other lacks."""
    line, bars = _day_timeline(spark, sf), tb.bars_1d(spark, sf)
    day = F.dayofmonth("open_time")
    a, b = (
        ledger.by_candidate(evaluation.published_rows(bars.where(day != lacking), line, K), K, (7.0,)).filter(F.col("candidate") == side)
        for side, lacking in (("A", 27), ("B", 13))
    )
    return evidence.executed_invariants(a, b, K)


@query
def segments_exec(spark, sf):
    return _day_segments(spark, sf)


@query
def bear_epochs(spark, sf):
    return evidence.bear_epochs(_day_rows(spark, sf), K)


@query
def epochs(spark, sf):
    return evidence.epochs(_day_segments(spark, sf), K)


@query
def loeo(spark, sf):
    return evidence.leave_one_out(_day_segments(spark, sf), K)


@query
def mechanism_label(spark, sf):
    spans = evidence.bar_spans(tb.bars_1d(spark, sf), K)
    return evidence.mechanism_label(_day_segments(spark, sf), spans, K)


@query
def cost_stress(spark, sf):
    spans = evidence.bar_spans(tb.bars_1d(spark, sf), K, evidence.COST_GRID)
    return evidence.mechanism_label(_day_segments(spark, sf, evidence.COST_GRID), spans, [*K, "cost_bps"])


@query
def venue_consistency(spark, sf):
    spans = evidence.bar_spans(tb.bars_1d(spark, sf), K)
    labels = evidence.mechanism_label(_day_segments(spark, sf), spans, K)
    return evidence.venue_consistency(labels, LOCKED, "symbol").select(*K, "label", "locked_label", "venue_consistency")


@query
def venue_agreement(spark, sf):
    """Both venues trade the same decisions; compare their deltas epoch by epoch."""
    line = _day_timeline(spark, sf)
    days = tb.venue_days(spark, sf)
    states = line.withColumn("venue", F.explode(F.array(F.lit("V1"), F.lit("V2"))))
    rows = evaluation.published_rows(days, states, ["venue", *K])
    per = evidence.epochs(evidence.divergence_segments(rows, ["venue", *K]), ["venue", *K])
    per = per.withColumnRenamed("bear_epoch_id", "unit")
    return attribution.venue_agreement(per.filter("venue = 'V1'"), per.filter("venue = 'V2'"), [*K, "unit"])


@query
def signflip(spark, sf):
    """Exact sign-flip p per symbol over all its divergence epochs."""
    return attribution.sign_flip_p(evidence.epochs(_day_segments(spark, sf), K), K)


@query
def information_floor(spark, sf):
    rows = _day_rows(spark, sf)
    forward = rows.select(
        *K, F.col("availability_time").alias("timestamp"), _core("a_target").alias("a_core"),
        _core("b_target").alias("b_core"), F.col("bear_epoch_id").cast("string").alias("bear_epoch_id"),
    ).filter(F.col("timestamp") > F.expr(DAY_FREEZE))
    return evidence.information_floor(forward, K, F.expr(DAY_FREEZE)).drop("performance")


@query
def perf_summary(spark, sf):
    full = evaluation.published_ledger(tb.bars_1d(spark, sf), _day_timeline(spark, sf), K, evidence.COST_GRID)
    return evidence.performance_summary(full, [*K, "candidate", "cost_bps"], DAYS_PER_YEAR)


def _day_ledger(spark, sf):
    return materialise(ledger.scenario_ledger(_day_rows(spark, sf), K), "ledger")


@query
def campaigns(spark, sf):
    return attribution.campaigns(_day_ledger(spark, sf), [*K, "candidate"])


@query
def campaign_summary(spark, sf):
    keys = [*K, "candidate"]
    return attribution.campaign_summary(attribution.campaigns(_day_ledger(spark, sf), keys), keys)


@query
def yearly(spark, sf):
    return attribution.yearly(_day_ledger(spark, sf), [*K, "candidate"])


@query
def side_attr(spark, sf):
    return attribution.side_attribution(_day_ledger(spark, sf), [*K, "candidate"])


@query
def long_gate(spark, sf):
    keys = [*K, "candidate"]
    full = _day_ledger(spark, sf)
    spans = full.groupBy(*keys).agg(F.min("availability_time").alias("first_at"), F.max("availability_time").alias("last_at"))
    return attribution.long_gate(attribution.campaigns(full, keys), spans, keys)


@query
def risk_allocation(spark, sf):
    out = exposure.allocate(tb.risk_states(spark, sf), tb.POLICIES)
    return out.select(*exposure.allocation_columns(["event_id", "policy_id"]))


# ---- provenance and journal -------------------------------------------------


@query
def seed_root(spark, sf):
    _, current = tb.day_files(spark, sf)
    return provenance.set_root(current, K)


@query
def manifest_verify(spark, sf):
    declared, current = tb.day_files(spark, sf)
    head = provenance.build_manifest(declared, K)
    return provenance.verify_manifest(head, declared, current, K)


@query
def artifact_profile(spark, sf):
    rows = tb.ticks(spark, sf).select(
        *K, F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("timestamp"),
        F.col("price").alias("open"), (F.col("price") - 1000.5).alias("close"),
        F.when(F.col("seq") % 9 == 0, F.lit(float("nan"))).otherwise(1.0).alias("target_exposure"),
        F.col("seq").alias("src_order"),
    )
    return provenance.artifact_profile(rows, K, "paper_bars", F.expr(FREEZE))


def _journal(spark, sf):
    return materialise(journal.build_journal(_tick_targets(spark, sf), [*K, "candidate"]), "journal")


@query
def journal_verify(spark, sf):
    """Every record of a freshly built journal is checked; clean records have no problems."""
    keys = [*K, "candidate"]
    checked = journal.verify_journal(_journal(spark, sf), keys)
    return checked.groupBy(*keys).agg(F.count("*").alias("records"), F.count_if(F.size("problems") > 0).alias("bad_records"))


@query
def journal_tampered(spark, sf):
    """A journal damaged by record number: what its verification finds, per kind of problem."""
    keys = [*K, "candidate"]
    n = F.col("seq")
    damaged = _journal(spark, sf).withColumns({
        "equity": F.when(n % 97 == 0, F.col("equity") * 2).otherwise(F.col("equity")),
        "record_hash": F.when(n % 101 == 0, F.sha2("record_hash", 256)).otherwise(F.col("record_hash")),
        "segment": F.when(n % 103 == 0, F.col("segment") + 1).otherwise(F.col("segment")),
    })
    found = journal.verify_journal(damaged, keys).select(*keys, F.explode("problems").alias("problem"))
    kinds = ("BODY_HASH", "EQUITY", "STATE_AFTER", "RECORD_HASH", "SEGMENT")
    return found.where(F.col("problem").isin(*kinds)).groupBy(*keys, "problem").agg(F.count("*").alias("records"))


@query
def journal_status(spark, sf):
    keys = [*K, "candidate"]
    status = journal.journal_status(_journal(spark, sf), keys)
    return journal.public_view(status, keys).drop("tail_hash")


@query
def contract_verify(spark, sf):
    """Contracts signed over yesterday's facts, checked against today's changed files."""
    declared, current = tb.day_files(spark, sf)
    freeze = F.expr(FREEZE)
    keys = [*K, "path"]
    digest = F.sha2(F.lit("producer"), 256)

    def facts(files):
        return files.select(
            *keys, F.lit("paper_bars").alias("artifact_kind"), F.col("path").alias("artifact_name"),
            F.col("sha256").alias("artifact_sha256"), F.length("path").cast("bigint").alias("artifact_bytes"),
            F.lit(1).cast("bigint").alias("rows"), freeze.alias("first_timestamp"), freeze.alias("last_timestamp"),
            F.lit("timestamp,open,close,target_exposure").alias("columns"), F.lit(True).alias("acceptable"),
            F.lit("snapshot").alias("source_snapshot_id"), digest.alias("source_manifest_sha256"), digest.alias("gate_sha256"),
            F.when(F.col("sha256") < "2", "FAIL").otherwise("PASS").alias("gate_status"), F.lit("full").alias("gate_mode"),
            F.lit(gates.FULL_SCOPE).alias("gate_scope"), freeze.alias("gate_freeze"),
            F.lit(False).alias("performance_evaluation_allowed"), F.lit(False).alias("judgement_allowed"),
            F.lit("producer").alias("producer_name"), F.lit("v1").alias("producer_version"),
            digest.alias("producer_code_sha256"), F.lit(None).cast("string").alias("parent_sha256"),
        )

    signed = provenance.build_contracts(facts(declared), freeze)
    checked = provenance.verify_contracts(signed, facts(current), keys, freeze)
    return checked.select(*keys, F.concat_ws(",", "problems").alias("problems"), "verified")


# ---- streams: the incremental twins, drained to a table ----------------------


def _live(df, *stamps):
    """Stateful processors keep session-zone instants; convert at the border."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in stamps})


def _plain(df, *stamps):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


def _stages(spark, label, keys=K):
    return Stages(spark, _folder(spark, label), keys)


@query
def stream_ab_trace(spark, sf):
    """A/B states from a stream of events, in two stages; equals the batch trace."""
    table = tb.tick_events(spark, sf)
    lateness = measured_lateness(tb.table(spark, sf, "events"), "ts")
    closing = Closing(spark, "ts timestamp", "trace")
    events = _live(tb.tick_events(spark, sf, source=tb.stream_table), "ts")
    trace, late = settled_states(_stages(spark, "trace"), events, ordered.TICK_CHUNK_SECONDS, lateness, closing,
                                 [beats_after(table, "ts", ordered.TICK_CHUNK_SECONDS, lateness)])
    none_late(late, "trace")
    return _plain(trace, "ts")


LATE_ONE_IN, LATE_LIMIT, LATE_CHUNK = 50, 6 * 3600, 3600


@query
def stream_late(spark, sf):
    """One event in fifty lands after all others: which of them still count, and the states either way."""
    written = materialise(_live(tb.tick_events(spark, sf), "ts"), "punctual")
    held = F.col("seq") % LATE_ONE_IN == 0
    closing = Closing(spark, "ts timestamp", "late")
    landing = _folder(spark, "late-landing")
    written.where(~held).write.parquet(landing)
    stages = _stages(spark, "late")
    events = spark.readStream.schema(written.schema).parquet(landing)
    settled_states(stages, events, LATE_CHUNK, LATE_LIMIT, closing)
    written.where(held).write.mode("append").parquet(landing)
    trace, late = settled_states(stages, events, LATE_CHUNK, LATE_LIMIT, closing, [beats_after(written, "ts", LATE_CHUNK, LATE_LIMIT)])
    columns = [*K, "ts", "seq", "event_type", "a_core", "b_core", "late"]
    counted = trace.withColumn("late", F.lit(False)).select(*columns)
    return _plain(counted.unionByName(late.withColumn("late", F.lit(True)), allowMissingColumns=True).select(*columns), "ts")


RETRY_LIMIT, RETRY_CHUNK = 2 * 86400, 3600


@query
def stream_retry(spark, sf):
    """Bars and, landed after them, repeats and changed copies: recent ones are told apart, old ones are forgotten."""
    bars = materialise(_live(tb.bars_15m(spark, sf).select(*K, "open_time", "open", "close", "number_of_trades"), "open_time"), "bars")
    news = bars.select(*K, F.col("open_time").alias("timestamp"), "open", "close", F.lit(0).cast("bigint").alias("arrival"))
    n = F.col("number_of_trades")
    again = bars.where(n % 2 == 0).select(*K, F.col("open_time").alias("timestamp"), "open", "close", F.lit(1).cast("bigint").alias("arrival"))
    changed = bars.where(n % 3 == 0).select(*K, F.col("open_time").alias("timestamp"), "open", (F.col("close") + 1).alias("close"), F.lit(2).cast("bigint").alias("arrival"))
    landing, base = _folder(spark, "retry-landing"), _folder(spark, "retry")
    content = bar_hash(F.col("timestamp"), F.col("open"), F.col("close"), F.lit(0.0))
    for rows in (news, again.unionByName(changed)):
        rows.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        out = drain(stream_retries(stream, K, content, RETRY_CHUNK, RETRY_LIMIT), "retry", base=base)
    return _plain(out.select(*K, "timestamp", "arrival", "status"), "timestamp")


@query
def stream_bars_15m(spark, sf):
    """Bars from a stream of ticks. Nothing is late within the span of the table."""
    ends = tb.ticks(spark, sf).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    lateness = f"{int((ends.b - ends.a).total_seconds()) + 1 if ends.a else 0} seconds"
    live = _live(tb.ticks(spark, sf, source=tb.stream_table), "ts")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in live.schema.fields)
    closing = Closing(spark, types, "bars")
    bars = real_bars(stream_bars(live.unionByName(closing.stream()), K, "15 minutes", lateness))
    # The second one lets the stream see the watermark that the first has moved.
    tick = closing_tick(live)
    return _plain(drain(bars, "bars", closing, [tick, tick]), "open_time", "availability_time")


@query
def stream_ledger(spark, sf):
    """The incremental ledger fed with landed execution bars in any order, in two stages; equals the batch ledger."""
    keys = [*K, "candidate"]
    targets = materialise(_live(_tick_targets(spark, sf), "timestamp"), "targets")
    lateness = measured_lateness(targets, "timestamp")
    closing = Closing(spark, "timestamp timestamp", "paper")
    actions, refused = settled_ledger(_stages(spark, "paper", keys), tb.follow(targets), ordered.DAY, lateness, closing,
                                      [beats_after(targets, "timestamp", ordered.DAY, lateness)])
    none_late(refused, "paper")
    return _plain(actions, "timestamp").select(*keys, "timestamp", "status", "held_exposure", "turnover", "equity", "pending_target")


@query
def stream_journal(spark, sf):
    """A journal fed by a stream that is stopped and taken up again: every record, linked behind the stored tails."""
    bars = materialise(_live(tb.bars_15m(spark, sf).select(*K, "open_time", "open", "close"), "open_time"), "bars")
    landing, base = _folder(spark, "journal-landing"), _folder(spark, "chained")
    lateness = measured_lateness(bars, "open_time")
    closing = Closing(spark, "open_time timestamp", "chained")
    cutoff = F.expr(CUTOFF).cast("timestamp")
    early = F.col("open_time") < cutoff
    stop = spark.range(1).select((cutoff + F.make_dt_interval(secs=F.lit(lateness))).alias("open_time"))
    for rows, beat in ((bars.where(early), stop), (bars.where(~early), beats_after(bars, "open_time", ordered.DAY, lateness))):
        rows.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(bars.schema).parquet(landing)
        hashed = stream.withColumn("body_hash", bar_hash(F.col("open_time"), F.col("open"), F.col("close"), F.lit(1.0)))
        chunks = settled_chunks(hashed, K, ["open_time"], ordered.DAY, lateness, closing.stream()).where(F.col("status") == SETTLED)
        one = F.inline(F.arrays_zip("open_time", "open", "close", "body_hash"))
        records = chunks.select(F.col("symbol").alias("series"), F.col("chunk").alias("segment"), one).select(
            "series", "segment", F.col("open_time").alias("timestamp"), "body_hash", F.to_json(F.struct("open", "close")).alias("body"))
        journal_sink.chain_journal(records, f"{base}/journal", f"{base}/checkpoint").awaitTermination()
        closing.end(beat)
        journal_sink.chain_journal(records, f"{base}/journal", f"{base}/checkpoint").awaitTermination()
    written = materialise(journal_sink.read_journal(spark, f"{base}/journal"), "chained")
    fail_closed(journal_sink.verify_chains(written).select("series", "problem", F.col("records").alias("failures")), "journal")
    return written.select(F.col("series").alias("symbol"), "segment", "seq", F.timestamp_micros("timestamp").cast("timestamp_ntz").alias("timestamp"), "record_hash")


# ---- landed files: written into the shared folder, read back by the readers ---


def _folder(spark, name):
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


@query
def src_bars(spark, sf):
    """Bars written as compressed csv by series, and read back."""
    path = _folder(spark, "landed") + "/bars.csv"
    names = [f.split()[0] for f in schemas.BAR.split(", ")]
    sinks.write_bars(tb.bars_15m(spark, sf).select(*K, *names), path, K, "csv")
    return _plain(readers.read_bars(spark, path), "open_time", "availability_time").drop("src_order")


@query
def src_klines(spark, sf):
    """Kline lines of the whole tape, read as bars."""
    path = _folder(spark, "klines")
    bars = bars_from_ticks(tb.ticks(spark, sf), [], 900)
    epoch = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1000).cast("bigint")
    fields = [epoch("open_time"), *[F.col(c) for c in readers.NUMBERS], epoch("availability_time"), F.lit(0.0), F.col("number_of_trades"),
              F.lit(0.0), F.lit(0.0), F.lit("0")]
    bars.select(F.concat_ws(",", *[f.cast("string") for f in fields]).alias("value")).write.text(path)
    return _plain(readers.read_klines(spark, path, 900), "open_time", "availability_time").drop("src_order")


def _candle_text(spark, sf, candle):
    """One payload per symbol and day; the 96 candles of a day at most."""
    return tb.bars_15m(spark, sf).groupBy(*K, F.date_trunc("day", "open_time").alias("src_order")).agg(
        F.sort_array(F.collect_list(candle)).alias("candles"))


@query
def src_ohlc_payloads(spark, sf):
    """OHLC payloads of the days before the cutoff."""
    seconds = F.unix_seconds(F.col("open_time").cast("timestamp")).cast("string").alias("timestamp")
    days = _candle_text(spark, sf, F.struct(seconds, *[F.col(c).cast("string").alias(c) for c in readers.NUMBERS]))
    payload = F.to_json(F.struct(F.struct(F.col("symbol").alias("pair"), F.col("candles").alias("ohlc")).alias("data")))
    start, end = F.lit("2024-01-03").cast("timestamp"), F.expr(CUTOFF).cast("timestamp")
    return _plain(readers.parse_ohlc_payloads(days.select(*K, "src_order", payload.alias("payload")), K, start, end), "open_time")


@query
def src_candle_arrays(spark, sf):
    """Candle arrays of the days before the cutoff."""
    seconds = F.unix_seconds(F.col("open_time").cast("timestamp")).cast("double")
    days = _candle_text(spark, sf, F.array(seconds, "low", "high", "open", "close", "volume"))
    rows = days.select(*K, "src_order", F.to_json("candles").alias("payload"))
    start, end = F.lit("2024-01-03").cast("timestamp"), F.expr(CUTOFF).cast("timestamp")
    return _plain(readers.parse_candle_arrays(rows, K, start, end, 900), "open_time", "availability_time")


@query
def src_events(spark, sf):
    """Events written as csv and read back with the declared schema."""
    path = _folder(spark, "events")
    events = tb.tick_events(spark, sf).select(
        F.col("symbol").alias("key"), F.col("ts").cast("timestamp").alias("timestamp"), "event_type", F.col("seq").cast("string").alias("note"))
    events.write.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
    return _plain(readers.read_events(spark, path), "timestamp").drop("src_order")


@query
def src_execution_bars(spark, sf):
    """Execution bars of all series written as JSON lines and read back."""
    path = _folder(spark, "landed") + "/execution.jsonl"
    sinks.write_table(_live(_tick_targets(spark, sf), "timestamp").select("timestamp", "open", "close", "target_exposure"), path, "json")
    return _plain(readers.read_execution_bars(spark, path), "timestamp")


@query
def src_files(spark, sf):
    """Digests and sizes of the files of a landed tape: all ticks as lines, a file per symbol and day."""
    path = _folder(spark, "files")
    day = F.date_format("ts", "yyyy-MM-dd")
    line = F.concat_ws("|", F.col("seq").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string"))
    lines = tb.ticks(spark, sf).select(*K, day.alias("day"), "seq", line.alias("value"))
    lines.repartition(*K, "day").sortWithinPartitions(*K, "day", "seq").drop("seq").write.partitionBy(*K, "day").text(path)
    found = files.scan_files(spark, path, "*.txt")
    named = lambda c: F.regexp_extract("path", f"{c}=([^/]*)", 1).alias(c)
    return found.select(named("symbol"), named("day"), "sha256", "bytes")


@query
def mixed_windows(spark, sf):
    """Bars in windows of many widths that lie on no grid: from the first to the last tick of hours, six-hour spans and days."""
    ticks = tb.ticks(spark, sf)
    windows = None
    for width, divisor in (("1 hour", 2), ("6 hours", 3), ("1 day", 1)):
        one = ticks.groupBy(*K, F.window("ts", width).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
        one = one.where(F.col("n") % divisor == 0).select(*K, "start", "end")
        windows = one if windows is None else windows.unionByName(one)
    bars = tb.bars_15m(spark, sf).select(*K, "open_time", "number_of_trades")
    met = intervals.points_in_windows(bars, windows, K, "open_time")
    return met.groupBy(*K, "start", "end").agg(
        F.count("*").alias("bars"), F.min("open_time").alias("first_open"), F.max("open_time").alias("last_open"), F.sum("number_of_trades").alias("trades"))


@query
def contract_chains(spark, sf):
    """Contracts that build on those of the day before: some build on a lost one, and one symbol's run in a circle."""
    day = F.to_date("ts")
    days = tb.ticks(spark, sf).groupBy(*K, day.alias("day")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*K).orderBy("day")  # one row per symbol and day
    name = lambda c: F.sha2(F.concat_ws("|", "symbol", c.cast("string")), 256)
    ends = Window.partitionBy(*K)
    first = F.when(F.col("symbol").startswith("s"), F.max("day").over(ends))
    parent = F.when(F.col("n") % 7 == 0, F.sha2(F.lit("lost"), 256)).otherwise(name(F.coalesce(F.lag("day").over(before), first)))
    whole = F.coalesce(F.lag("day").over(before), first).isNotNull() | (F.col("n") % 7 == 0)
    signed = days.select(*K, name(F.col("day")).alias("contract_sha256"), F.when(whole, parent).alias("parent_sha256"))
    return provenance.parent_chains(signed, K)


@query
def tree_diff(spark, sf):
    """What differs between two file sets, found by descending their digest trees."""
    declared, current = (materialise(files_, "files") for files_ in tb.day_files(spark, sf))
    trees = [materialise(provenance.digest_tree(files_, K), "tree") for files_ in (declared, current)]
    return provenance.compare_trees(declared, current, *trees, K)


@query
def stream_rollup_2h(spark, sf):
    """The two-hour roll-up from a stream of bars; equals the batch roll-up."""
    written = materialise(_live(tb.bars_15m(spark, sf), "open_time", "availability_time"), "bars")
    ends = written.agg(F.min("availability_time").alias("a"), F.max("availability_time").alias("b")).first()
    lateness = f"{int((ends.b - ends.a).total_seconds()) + 1 if ends.a else 0} seconds"
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in written.schema.fields)
    closing = Closing(spark, types, "rollup")
    rolled = rollup.real_bars(rollup.stream_rollup(tb.follow(written).unionByName(closing.stream()), K, "2 hours", lateness), "availability_time")
    last = rollup.closing_tick(written, "availability_time")
    return _plain(drain(rolled, "rollup", closing, [last, last]), "availability_time")


@query
def stream_resume(spark, sf):
    """A ledger stopped at the cutoff: its checkpoint is held against the verified journal, then it goes on."""
    keys = [*K, "candidate"]
    targets = materialise(_live(_tick_targets(spark, sf), "timestamp"), "targets")
    cutoff = F.expr(CUTOFF).cast("timestamp")
    early = F.col("timestamp") <= cutoff
    landing = _folder(spark, "resume-landing")
    targets.where(early).write.parquet(landing)
    written = spark.read.schema(targets.schema).parquet(landing)
    lateness = measured_lateness(written, "timestamp")
    closing, stages = Closing(spark, "timestamp timestamp", "resume"), _stages(spark, "resume", keys)
    bars = spark.readStream.schema(targets.schema).parquet(landing)
    stop = spark.range(1).select((cutoff + F.make_dt_interval(secs=F.lit(lateness))).alias("timestamp"))
    settled_ledger(stages, bars, ordered.DAY, lateness, closing, [stop])

    records = materialise(journal.build_journal(written.where(F.col("timestamp") < cutoff), keys), "journal")
    fail_closed(journal.verify_journal(records, keys).select(
        *keys, F.lit("journal").alias("check"), F.size("problems").alias("failures")), "journal")
    fail_closed(checked_recovery(stages, resume_state(records, keys)), "checkpoint")

    targets.where(~early).write.mode("append").parquet(landing)
    actions, refused = settled_ledger(stages, bars, ordered.DAY, lateness, closing, [beats_after(targets, "timestamp", ordered.DAY, lateness)])
    none_late(refused, "resume")
    out = actions.where(F.col("timestamp") > cutoff)
    return _plain(out, "timestamp").select(*keys, "timestamp", "status", "held_exposure", "turnover", "equity", "pending_target")
