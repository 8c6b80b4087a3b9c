"""DuckDB SQL with the same answers as the registered queries."""

from __future__ import annotations

EVENT_NAMES = (
    "MAJOR_BULL_CONFIRMED", "MAJOR_BEAR_CONFIRMED", "MAJOR_BULL_RISK", "MAJOR_BEAR_RISK",
    "LOCAL_LONG_ENTRY", "LOCAL_SHORT_ENTRY", "LOCAL_LONG_RISK", "LOCAL_SHORT_INVALIDATION",
    "LOCAL_LONG_RECOVERY", "LOCAL_SHORT_RECOVERY", "LOCAL_LONG_REENTRY", "LOCAL_SHORT_REENTRY",
)
FREEZE = "TIMESTAMP '2024-01-10 02:00:00'"
CUTOFF = "TIMESTAMP '2024-01-20 00:00:00'"
DAY_FREEZE = "TIMESTAMP '1998-06-01 00:00:00'"
EPOCH0 = "TIMESTAMP '1970-01-01'"
MONDAY0 = "TIMESTAMP '1970-01-05'"


def r(x: str, name: str) -> str:
    return f"round({x}, 8) + 0.0::DOUBLE AS {name}"


def names_sql(extra: str = "") -> str:
    return "[" + ", ".join(f"'{n}'" for n in EVENT_NAMES) + extra + "]"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, event_id AS seq, value + 1000.0 AS price, value AS qty
  FROM events)"""


def bars(name: str, seconds: int, source: str = "ticks", keys: str = "symbol", where: str = "") -> str:
    return f"""{name} AS (
  SELECT {keys}, time_bucket(INTERVAL {seconds} SECOND, ts, {EPOCH0}) AS open_time,
    time_bucket(INTERVAL {seconds} SECOND, ts, {EPOCH0}) + INTERVAL {seconds} SECOND AS availability_time,
    first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close,
    sum(qty) AS volume, count(*) AS number_of_trades
  FROM {source} {where} GROUP BY ALL)"""


B15 = bars("b15", 900)
B1D = """b1d AS (
  SELECT o_orderpriority AS symbol, o_orderdate AS open_time, o_orderdate + INTERVAL 1 DAY AS availability_time,
    arg_min(o_totalprice + 1000000.0, o_orderkey) AS open, max(o_totalprice + 1000000.0) AS high,
    min(o_totalprice + 1000000.0) AS low, arg_max(o_totalprice + 1000000.0, o_orderkey) AS close,
    count(*)::DOUBLE AS volume, count(*) AS number_of_trades
  FROM orders GROUP BY ALL)"""
BAR_COLS = ", ".join(["symbol", "open_time", "availability_time", r("open", "open"), r("high", "high"),
                      r("low", "low"), r("close", "close"), r("volume", "volume"), "number_of_trades"])


def rolled(source: str, end: str, label: str = "availability_time", at: str = "availability_time") -> str:
    return f"""SELECT symbol, {end} AS {label}, {r(f'arg_min(open, {at})', 'open')}, {r('max(high)', 'high')},
  {r('min(low)', 'low')}, {r(f'arg_max(close, {at})', 'close')}, {r('sum(volume)', 'volume')}, count(*) AS bars
  FROM {source} GROUP BY symbol, {end}"""


def right_closed(width: str, origin: str = EPOCH0, at: str = "availability_time") -> str:
    return f"time_bucket(INTERVAL {width}, {at} - INTERVAL 1 MICROSECOND, {origin}) + INTERVAL {width}"


# ---- campaign states: the plain fold, event by event -------------------------


def _events(name: str) -> str:
    if name == "tick":
        src = f"SELECT event_type AS symbol, ts, event_id AS seq, ({names_sql()})[event_id % 12 + 1] AS event_type FROM events"
    elif name == "user":
        src = f"SELECT user_id AS symbol, ts, event_id AS seq, ({names_sql()})[event_id % 12 + 1] AS event_type FROM events"
    else:
        src = (f"SELECT o_orderpriority AS symbol, o_orderdate + to_seconds(o_orderkey % 86400) AS ts, o_orderkey AS seq, "
               f"({names_sql()})[o_orderkey % 12 + 1] AS event_type FROM orders")
    return f"""ev AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM ({src}))"""


def _moves(p: str, probe: bool) -> str:
    e, bull, bear = "e.event_type", f"s.{p}_regime LIKE 'BULL%'", f"s.{p}_regime LIKE 'BEAR%'"
    flat, lng, short = f"s.{p}_core = 'FLAT'", f"s.{p}_core = 'CORE_LONG'", f"s.{p}_core = 'CORE_SHORT'"
    re_short = f"{e} = 'LOCAL_SHORT_REENTRY' AND {flat} AND s.{p}_watch = 'SHORT' AND {bear}"
    re_long = f"{e} = 'LOCAL_LONG_REENTRY' AND {flat} AND s.{p}_watch = 'LONG' AND {bull}"
    confirm = f"{e} IN ('MAJOR_BULL_CONFIRMED', 'MAJOR_BEAR_CONFIRMED')"
    return f"""
  CASE WHEN {e} = 'MAJOR_BULL_CONFIRMED' THEN 'BULL_CONFIRMED' WHEN {e} = 'MAJOR_BEAR_CONFIRMED' THEN 'BEAR_CONFIRMED'
    WHEN {e} = 'MAJOR_BULL_RISK' AND {bull} THEN 'BULL_AT_RISK' WHEN {e} = 'MAJOR_BEAR_RISK' AND {bear} THEN 'BEAR_AT_RISK'
    WHEN {e} = 'LOCAL_LONG_RECOVERY' AND {bull} THEN 'BULL_CONFIRMED'
    WHEN {e} = 'LOCAL_SHORT_RECOVERY' AND {bear} THEN 'BEAR_CONFIRMED' ELSE s.{p}_regime END,
  CASE WHEN {e} = 'MAJOR_BULL_CONFIRMED' AND {short} THEN 'FLAT' WHEN {e} = 'MAJOR_BEAR_CONFIRMED' AND {lng} THEN 'FLAT'
    WHEN {e} = 'LOCAL_LONG_ENTRY' AND {flat} AND {bull} THEN 'CORE_LONG'
    WHEN {e} = 'LOCAL_SHORT_ENTRY' AND {flat} AND {bear} THEN 'CORE_SHORT'
    WHEN {e} = 'LOCAL_SHORT_INVALIDATION' AND {short} THEN 'FLAT' WHEN {re_long} THEN 'CORE_LONG'
    {'' if probe else f"WHEN {re_short} THEN 'CORE_SHORT'"} ELSE s.{p}_core END,
  CASE WHEN {confirm} THEN false WHEN ({e} = 'MAJOR_BULL_RISK' AND {bull}) OR ({e} = 'MAJOR_BEAR_RISK' AND {bear}) THEN true
    WHEN {e} = 'LOCAL_LONG_RISK' AND {lng} THEN true
    WHEN ({e} = 'LOCAL_LONG_RECOVERY' AND {bull}) OR ({e} = 'LOCAL_SHORT_RECOVERY' AND {bear}) THEN false ELSE s.{p}_at_risk END,
  CASE WHEN {confirm} THEN '' WHEN {e} = 'LOCAL_SHORT_INVALIDATION' AND {short} THEN 'SHORT' WHEN {re_long} THEN ''
    {'' if probe else f"WHEN {re_short} THEN ''"} ELSE s.{p}_watch END,
  CASE WHEN {confirm} THEN {e} WHEN ({e} = 'MAJOR_BULL_RISK' AND {bull}) OR ({e} = 'MAJOR_BEAR_RISK' AND {bear}) THEN 'RISK_DOWNGRADE'
    WHEN {e} = 'LOCAL_LONG_ENTRY' AND {flat} AND {bull} THEN 'ENTER_LONG'
    WHEN {e} = 'LOCAL_SHORT_ENTRY' AND {flat} AND {bear} THEN 'ENTER_SHORT'
    WHEN {e} = 'LOCAL_SHORT_INVALIDATION' AND {short} THEN 'EXIT_SHORT' WHEN {e} = 'LOCAL_LONG_RISK' AND {lng} THEN 'LONG_RISK'
    WHEN {e} = 'LOCAL_LONG_RECOVERY' AND {bull} THEN 'LONG_RECOVERY' WHEN {e} = 'LOCAL_SHORT_RECOVERY' AND {bear} THEN 'SHORT_RECOVERY'
    WHEN {re_long} THEN 'REENTER_LONG'
    WHEN {re_short} THEN '{'PROBE_SHORT_REENTRY_SUPPRESSED' if probe else 'REENTER_SHORT'}' ELSE 'HOLD' END"""


_FIELDS = ("regime", "core", "at_risk", "watch", "last_action")
_COLS = [f"{p}_{f}" for p in "ab" for f in _FIELDS]
FOLD = f"""st(symbol, rn, ts, seq, event_type, {', '.join(_COLS)}) AS (
  SELECT DISTINCT symbol, 0::BIGINT, NULL::TIMESTAMP, NULL::BIGINT, NULL::VARCHAR,
    'NEUTRAL', 'FLAT', false, '', '', 'NEUTRAL', 'FLAT', false, '', '' FROM ev
  UNION ALL
  SELECT e.symbol, e.rn, e.ts, e.seq, e.event_type, {_moves('a', False)}, {_moves('b', True)}
  FROM st s JOIN ev e ON e.symbol = s.symbol AND e.rn = s.rn + 1)"""
SIDE = "CASE {} WHEN 'CORE_LONG' THEN 1 WHEN 'CORE_SHORT' THEN -1 ELSE 0 END"
LINE = f"""line AS (
  SELECT symbol, ts, seq, {SIDE.format('a_core')} AS a_side, {SIDE.format('b_core')} AS b_side,
    CASE WHEN a_regime LIKE 'BULL%' THEN 1 WHEN a_regime LIKE 'BEAR%' THEN -1 ELSE 0 END AS direction,
    a_at_risk::INT AS at_risk
  FROM st WHERE rn > 0)"""
LAST_LINE = """lastline AS (
  SELECT * FROM line QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) = 1)"""


def states_on(source: str) -> str:
    """Bars with the last state at or before their availability time."""
    return f"""known AS (
  SELECT b.*, l.a_side, l.b_side, l.direction, l.at_risk
  FROM {source} b ASOF LEFT JOIN lastline l ON b.symbol = l.symbol AND b.availability_time >= l.ts)"""


def fold_of(kind: str) -> list[str]:
    return [_events(kind), FOLD, LINE, LAST_LINE]


# Execution rows: held exposure is the target one bar back, old exposure two bars back.
EXEC = """pos AS (
  SELECT *, coalesce(a_side, 0)::DOUBLE AS a_target, coalesce(b_side, 0)::DOUBLE AS b_target,
    coalesce(direction, 0) AS dir FROM known),
lagged AS (
  SELECT *, lag(a_target, 1, 0.0) OVER w AS a_held, lag(b_target, 1, 0.0) OVER w AS b_held,
    lag(a_target, 2, 0.0) OVER w AS a_old, lag(b_target, 2, 0.0) OVER w AS b_old,
    lag(close) OVER w AS pc, coalesce(lag(dir) OVER w, 0) AS dir_before
  FROM pos WINDOW w AS (PARTITION BY {keys} ORDER BY availability_time)),
x0 AS (
  SELECT *, abs(a_held - a_old) AS a_turnover, abs(b_held - b_old) AS b_turnover,
    CASE WHEN pc IS NULL THEN 0.0 ELSE a_old * (open / pc - 1) + a_held * (close / open - 1) END AS a_gross,
    CASE WHEN pc IS NULL THEN 0.0 ELSE b_old * (open / pc - 1) + b_held * (close / open - 1) END AS b_gross,
    a_held <> b_held AS divergent, a_held <> b_held OR a_old <> b_old AS member,
    (a_held <> b_held AND a_old = b_old)::INT AS seg_start,
    (dir = -1 AND dir_before <> -1)::INT AS bear_start, (dir = 1 AND dir_before <> 1)::INT AS bull_start
  FROM lagged),
x AS (
  SELECT *, sum(seg_start) OVER w AS seg_no,
    CASE WHEN dir = -1 THEN sum(bear_start) OVER w END AS bear_epoch_id,
    CASE WHEN dir = 1 THEN sum(bull_start) OVER w END AS bull_epoch_id
  FROM x0 WINDOW w AS (PARTITION BY {keys} ORDER BY availability_time))"""


def execs(keys: str = "symbol") -> str:
    return EXEC.format(keys=keys)


def seg(costs=(7.0,), keys: str = "symbol") -> str:
    grid = ", ".join(f"({c}::DOUBLE)" for c in costs)
    return f"""seg AS (
  SELECT {keys}, seg_no::BIGINT AS segment_id,
    max(CASE WHEN seg_start = 1 THEN bear_epoch_id END)::BIGINT AS bear_epoch_id, min(open_time) AS start, max(open_time) AS "end",
    count(*) AS bars, cost_bps,
    sum(ln(1 + (a_gross - a_turnover * cost_bps / 10000))) AS a_log_return,
    sum(ln(1 + (b_gross - b_turnover * cost_bps / 10000))) AS b_log_return,
    sum(ln(1 + (b_gross - b_turnover * cost_bps / 10000))) - sum(ln(1 + (a_gross - a_turnover * cost_bps / 10000))) AS paired_delta_log
  FROM x, (VALUES {grid}) c(cost_bps) WHERE member GROUP BY {keys}, seg_no, cost_bps)"""


def epochs_cte(keys: str = "symbol, cost_bps") -> str:
    return f"""ep AS (
  SELECT {keys}, bear_epoch_id, count(*) AS segments, sum(paired_delta_log) AS paired_delta_log
  FROM seg WHERE bear_epoch_id IS NOT NULL GROUP BY ALL)"""


def label(costs=(7.0,)) -> str:
    grid = ", ".join(f"({c}::DOUBLE)" for c in costs)
    return f"""per_seg AS (SELECT symbol, cost_bps, count(*) AS n, sum(paired_delta_log) AS total FROM seg GROUP BY ALL),
per_ep AS (SELECT symbol, cost_bps, count(*) AS n, count(*) FILTER (paired_delta_log > 0) AS pos, max(paired_delta_log) AS top FROM ep GROUP BY ALL),
span AS (SELECT symbol, cost_bps, date_diff('second', min(availability_time), max(availability_time)) / 86400.0::DOUBLE AS days
  FROM b1d, (VALUES {grid}) c(cost_bps) GROUP BY ALL),
lab AS (
  SELECT span.symbol, span.cost_bps, coalesce(per_seg.n, 0) AS divergence_segments, coalesce(per_ep.n, 0) AS bear_epochs,
    coalesce(total, 0.0) AS total_paired_delta_log, coalesce(pos, 0) AS positive_epochs, days AS history_days,
    coalesce(per_ep.n, 0) - coalesce(pos, 0) AS negative_epochs, total - top AS loeo_min_remaining
  FROM span LEFT JOIN per_seg USING (symbol, cost_bps) LEFT JOIN per_ep USING (symbol, cost_bps)),
labelled AS (
  SELECT *, CASE WHEN NOT (history_days >= 180 AND divergence_segments >= 6 AND bear_epochs >= 3) THEN 'INSUFFICIENT_EXTERNAL_MECHANISM_EVIDENCE'
      WHEN total_paired_delta_log > 0 AND positive_epochs / bear_epochs >= 2 / 3 THEN 'EXTERNAL_MECHANISM_SUPPORT'
      WHEN total_paired_delta_log < 0 AND negative_epochs > bear_epochs / 2 THEN 'ADVERSE_EXTERNAL_MECHANISM_EVIDENCE'
      ELSE 'MIXED_EXTERNAL_MECHANISM_EVIDENCE' END AS label,
    CASE WHEN loeo_min_remaining > 0 THEN 'LOEO_ROBUST_POSITIVE' ELSE 'LOEO_CONCENTRATED_OR_SIGN_UNSTABLE' END AS loeo_status
  FROM lab)"""


LABEL_COLS = f"""divergence_segments, bear_epochs, {r('total_paired_delta_log', 'total_paired_delta_log')}, positive_epochs,
  {r('history_days', 'history_days')}, negative_epochs, label, {r('loeo_min_remaining', 'loeo_min_remaining')}, loeo_status"""


def ledger(costs=(7.0,), keys: str = "symbol") -> str:
    grid = ", ".join(f"({c}::DOUBLE)" for c in costs)
    return f"""net AS (
  SELECT {keys}, 'A' AS candidate, cost_bps, open_time, availability_time, open, close, dir AS direction, coalesce(at_risk, 0) = 1 AS at_risk,
    bull_epoch_id, a_target AS target_exposure, a_held AS held_exposure, a_turnover AS turnover, a_gross AS gross_return,
    a_turnover * cost_bps / 10000 AS trade_cost, a_gross - a_turnover * cost_bps / 10000 AS net_return
  FROM x, (VALUES {grid}) c(cost_bps)
  UNION ALL
  SELECT {keys}, 'B', cost_bps, open_time, availability_time, open, close, dir, coalesce(at_risk, 0) = 1,
    bull_epoch_id, b_target, b_held, b_turnover, b_gross, b_turnover * cost_bps / 10000, b_gross - b_turnover * cost_bps / 10000
  FROM x, (VALUES {grid}) c(cost_bps)),
eq AS (SELECT *, product(1 + net_return) OVER w AS equity, ln(1 + net_return) AS log_net
  FROM net WINDOW w AS (PARTITION BY {keys}, candidate, cost_bps ORDER BY availability_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
led AS (SELECT *, equity / max(equity) OVER w - 1 AS drawdown
  FROM eq WINDOW w AS (PARTITION BY {keys}, candidate, cost_bps ORDER BY availability_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


NEXT_OPEN = """tgt AS (
  SELECT symbol, 'A' AS candidate, availability_time AS timestamp, open, close, coalesce(a_side, 0)::DOUBLE AS target_exposure FROM known
  UNION ALL SELECT symbol, 'B', availability_time, open, close, coalesce(b_side, 0)::DOUBLE FROM known),
n1 AS (SELECT *, lag(target_exposure, 1, 0.0) OVER w AS held_exposure, lag(target_exposure, 2, 0.0) OVER w AS old, lag(close) OVER w AS pc
  FROM tgt WINDOW w AS (PARTITION BY symbol, candidate ORDER BY timestamp)),
n2 AS (SELECT *, abs(held_exposure - old) AS turnover, abs(held_exposure - old) * 7.0 / 10000 AS trade_cost,
    CASE WHEN pc IS NULL THEN 0.0 ELSE old * (open / pc - 1) END AS gap,
    CASE WHEN pc IS NULL THEN 0.0 ELSE held_exposure * (close / open - 1) END AS intra FROM n1),
n3 AS (SELECT *, (1 + gap) * (1 + intra) AS gross_factor,
    CASE WHEN pc IS NULL THEN 0.0 ELSE (1 + gap) * (1 - trade_cost) * (1 + intra) - 1 END AS net_return FROM n2),
n4 AS (SELECT *, product(1 + net_return) OVER (PARTITION BY symbol, candidate ORDER BY timestamp
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM n3)"""

TICK_X = [TICKS, B15, *fold_of("tick"), states_on("b15")]
DAY_X = [B1D, *fold_of("day"), states_on("b1d")]

GRID = """off_grid AS (
  SELECT symbol, CASE WHEN n % 5 = 0 THEN first_ts ELSE slot END AS open_time,
    CASE WHEN n % 5 = 0 THEN first_ts ELSE slot END + INTERVAL 900 SECOND AS availability_time, open, high, low, close, volume
  FROM (SELECT symbol, time_bucket(INTERVAL 900 SECOND, ts, TIMESTAMP '1970-01-01') AS slot, min(ts) AS first_ts,
    first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, sum(qty) AS volume, count(*) AS n
    FROM ticks GROUP BY ALL))"""
_CLOCKS = (("30m", 1800), ("1h", 3600), ("2h", 7200), ("4h", 14400), ("8h", 28800), ("12h", 43200), ("1d", 86400), ("72h", 259200))
WINDOWS = "bins AS (" + " UNION ALL ".join(
    f"SELECT symbol, open_time, '{tf}' AS tf, {right_closed(f'{s} SECOND')} AS window_end, {s // 900} AS expected_count FROM off_grid"
    for tf, s in _CLOCKS
) + f""" UNION ALL SELECT symbol, open_time, '1w', time_bucket(INTERVAL 7 DAY, date_trunc('day', availability_time)::TIMESTAMP - INTERVAL 1 MICROSECOND, {MONDAY0}) + INTERVAL 7 DAY, 672 FROM off_grid),
audit AS (
  SELECT symbol, tf, window_end, expected_count::BIGINT AS expected_count, count(*) AS observed_count,
    count(*) FILTER (epoch_us(open_time) % 900000000 = 0) AS on_grid_count,
    min(open_time) AS first_input_open_time, max(open_time) AS last_input_open_time,
    count(*) = expected_count AS complete, count(*) FILTER (epoch_us(open_time) % 900000000 = 0) = count(*) AS valid
  FROM bins GROUP BY symbol, tf, window_end, expected_count)"""
AUDIT = [TICKS, GRID, WINDOWS]
AUDIT_COLS = "symbol, tf, window_end, expected_count, observed_count, on_grid_count, first_input_open_time, last_input_open_time"

DIRTY_BARS = """dirty AS (
  SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS open_time, price AS open, price + qty - 2 AS high, price - qty AS low,
    CASE WHEN qty < 0.5 THEN -qty ELSE price END AS close, seq * 2 + CASE WHEN seq % 10 = 0 THEN 31 ELSE 0 END AS src_order
  FROM ticks)"""


def integrity(outside: str) -> str:
    return f"""audited AS (
  SELECT symbol, count(*) AS rows, min(open_time) AS first_open, max(open_time) AS last_open,
    count(*) - count(DISTINCT open_time) AS duplicate_timestamps,
    count(*) FILTER (high < greatest(open, close, low) OR low > least(open, high, close)) AS envelope_failures,
    count(*) FILTER (least(open, high, low, close) <= 0) AS nonpositive_rows,
    count(*) FILTER ({outside}) AS out_of_range_rows,
    count(*) FILTER (open_time < before) = 0 AS monotonic
  FROM (SELECT *, lag(open_time) OVER (PARTITION BY symbol ORDER BY src_order) AS before FROM dirty) GROUP BY symbol)"""


GAPS = """gaps AS (
  SELECT symbol, before AS previous_open_time, open_time AS next_open_time, date_diff('second', before, open_time)::DOUBLE AS gap_seconds,
    greatest(round_even(date_diff('second', before, open_time) / 900.0::DOUBLE, 0)::BIGINT - 1, 0) AS missing_bars,
    epoch_us(open_time) % 900000000 = 0 AS next_on_grid
  FROM (SELECT symbol, open_time, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS before FROM b15)
  WHERE date_diff('second', before, open_time) <> 900)"""

NATIVE2H = bars("raw2h", 7200) + """,
n2h AS (SELECT symbol, availability_time, open, high, low, close + CASE WHEN number_of_trades % 7 = 0 THEN 0.01 ELSE 0.0 END AS close FROM raw2h)"""


def derived(name: str, source: str) -> str:
    return f"""{name} AS (SELECT symbol, {right_closed('2 HOUR')} AS availability_time, arg_min(open, availability_time) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, availability_time) AS close, count(*) AS bars FROM {source} GROUP BY symbol, {right_closed('2 HOUR')})"""


def paired(d: str, n: str) -> str:
    diffs = ", ".join(f"d.{c} AS derived_{c}, n.{c} AS native_{c}, abs(d.{c} - n.{c}) AS absdiff_{c}" for c in ("open", "high", "low", "close"))
    return f"""pair AS (SELECT symbol, availability_time, d.bars AS base_count, {diffs} FROM {d} d JOIN {n} n USING (symbol, availability_time))"""


WORST = "greatest(absdiff_open, absdiff_high, absdiff_low, absdiff_close)"
PATCH = bars("raw1h", 3600) + """,
base AS (SELECT symbol, open_time, availability_time, open, high, low,
  close + CASE WHEN number_of_trades % 5 = 0 THEN 0.25 ELSE 0.0 END AS close, volume FROM raw1h WHERE number_of_trades >= 3),
truth AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, open_time, TIMESTAMP '1970-01-01') AS start, arg_min(open, open_time) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, open_time) AS close, sum(volume) AS volume, count(*) AS bars FROM b15 GROUP BY ALL HAVING count(*) = 4),
sides AS (SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.open_time, n.start) AS open_time,
  o.open AS old_open, o.high AS old_high, o.low AS old_low, o.close AS old_close, o.volume AS old_volume,
  n.open AS new_open, n.high AS new_high, n.low AS new_low, n.close AS new_close, n.volume AS new_volume,
  CASE WHEN o.symbol IS NULL THEN 'add' WHEN n.symbol IS NOT NULL AND greatest(abs(o.open - n.open), abs(o.high - n.high), abs(o.low - n.low),
    abs(o.close - n.close), abs(o.volume - n.volume)) > 1e-10 THEN 'replace' ELSE 'keep' END AS action
  FROM base o FULL JOIN truth n ON o.symbol = n.symbol AND o.open_time = n.start),
patched AS (SELECT symbol, open_time, open_time + INTERVAL 1 HOUR AS availability_time,
  """ + ", ".join(f"CASE WHEN action = 'keep' THEN old_{c} ELSE new_{c} END AS {c}" for c in ("open", "high", "low", "close", "volume")) + """, action FROM sides)"""
RECONCILE = [TICKS, B15, PATCH, bars("n2h", 7200), derived("before", "base"), paired("before", "n2h"), derived("again", "patched"), f"""checked AS (
  SELECT p.symbol, p.availability_time, greatest(abs(a.open - n.open), abs(a.high - n.high), abs(a.low - n.low), abs(a.close - n.close)) AS max_absdiff,
    a.symbol IS NULL OR n.symbol IS NULL AS missing
  FROM (SELECT * FROM pair WHERE {WORST} > 1e-8) p
  LEFT JOIN again a USING (symbol, availability_time) LEFT JOIN n2h n USING (symbol, availability_time)),
result AS (SELECT symbol, availability_time, max_absdiff,
  CASE WHEN missing THEN 'MISSING_AFTER_RECONCILIATION' WHEN max_absdiff <= 1e-8 THEN 'MATCH' ELSE 'STILL_MISMATCH' END AS status FROM checked)"""]

HOURS = """mani AS (
  SELECT symbol, '1h' AS interval, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS period, count(*) AS rows FROM ticks GROUP BY ALL),
first_good AS (SELECT symbol, min(period) AS g FROM mani WHERE rows >= 2 GROUP BY symbol)"""

USERS = """files AS (SELECT user_id, (['1h', '1d', '3d', '1w'])[user_id % 4 + 1] AS interval, date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS rows
  FROM events GROUP BY ALL),
series AS (SELECT DISTINCT user_id, interval FROM files),
days AS (SELECT s.user_id, s.interval, d.period, f.rows,
    CASE WHEN f.rows IS NOT NULL THEN 'OK' WHEN s.interval NOT IN ('1h', '1d') THEN '404_SPARSE_INTERVAL_NO_BAR_OPEN_ON_DAY'
      WHEN d.period = TIMESTAMP '2024-01-30' THEN 'WAITING_SOURCE_ARCHIVE_PUBLICATION' ELSE 'FAIL_MISSING_EXPECTED_DENSE_ARCHIVE' END AS status
  FROM series s CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS period) d
  LEFT JOIN files f ON f.user_id = s.user_id AND f.period = d.period),
facts AS (SELECT user_id, interval, count(*) FILTER (status = 'OK') AS files, count(*) FILTER (status = 'WAITING_SOURCE_ARCHIVE_PUBLICATION') AS end_day_missing,
  count(*) FILTER (status LIKE 'FAIL%') AS hard_source_gaps FROM days GROUP BY ALL),
aud AS (SELECT user_id, interval, sum(CASE WHEN period > TIMESTAMP '2024-01-10' THEN rows ELSE 0 END)::BIGINT AS eligible_rows,
  count(*) FILTER (rows > 8) AS hard_failures FROM files GROUP BY ALL),
gate AS (SELECT user_id, interval, files, end_day_missing, hard_source_gaps, coalesce(eligible_rows, 0) AS eligible_rows, coalesce(hard_failures, 0) AS hard_failures,
  CASE WHEN coalesce(hard_failures, 0) > 0 THEN 'FAIL' WHEN end_day_missing > 0 THEN 'WAITING_SOURCE_ARCHIVE_PUBLICATION'
    WHEN files = 0 AND interval IN ('1h', '1d') THEN 'FAIL_NO_SOURCE_ROWS' WHEN coalesce(eligible_rows, 0) = 0 THEN 'WAITING_FIRST_COMPLETED_NATIVE_BAR'
    ELSE 'PASS' END AS status FROM facts LEFT JOIN aud USING (user_id, interval))"""


def gate_row(k: int) -> str:
    return f"""(['PASS', 'PASS_WITH_EXPECTED_EARLY_WAITING_INTERVALS', 'WAITING_SOURCE_ARCHIVE_PUBLICATION', 'FAIL'])[(n * {k}) % 4 + 1] AS status,
  CASE WHEN n % 11 = {k} THEN 'monitor' ELSE 'full' END AS mode, n % 13 <> {k} AS complete, n % 17 = {k} AS perf, n % 19 = {k} AS judged,
  n % 7 <> 0 AS state_only, n % 9 = 0 AS price"""


READY = f"""cnt AS (SELECT user_id AS dataset, count(*) AS n, bool_or(event_type = 'signup' AND ts >= TIMESTAMP '2024-01-29') AS has_state FROM events GROUP BY user_id),
g AS (SELECT dataset, {gate_row(1)} FROM cnt), s AS (SELECT dataset, {gate_row(3)} FROM cnt WHERE has_state),
verdict AS (SELECT g.dataset, CASE WHEN g.perf THEN 'ERROR_PERFORMANCE_NOT_DISABLED' WHEN g.judged THEN 'ERROR_JUDGEMENT_NOT_DISABLED'
  WHEN g.mode <> 'full' THEN 'ERROR_MODE_NOT_FULL' WHEN NOT g.complete THEN 'ERROR_SCOPE_NOT_COMPLETE'
  WHEN g.status LIKE 'WAITING%' THEN 'WAITING_SOURCE_DATA' WHEN g.status = 'FAIL' THEN 'ERROR_GATE_NOT_ELIGIBLE'
  WHEN s.dataset IS NULL THEN 'BLOCKED_STATE_SOURCE_NOT_BOUND' WHEN s.perf THEN 'ERROR_STATE_PERFORMANCE_NOT_DISABLED'
  WHEN s.judged THEN 'ERROR_STATE_JUDGEMENT_NOT_DISABLED' WHEN s.mode <> 'full' THEN 'ERROR_STATE_MODE_NOT_FULL'
  WHEN NOT s.complete THEN 'ERROR_STATE_SCOPE_NOT_COMPLETE' WHEN NOT s.state_only THEN 'ERROR_STATE_SOURCE_NOT_STATE_ONLY'
  WHEN s.price THEN 'ERROR_STATE_PRICE_USE_NOT_DISABLED' WHEN s.status LIKE 'WAITING%' THEN 'WAITING_SOURCE_DATA'
  WHEN s.status = 'FAIL' THEN 'ERROR_STATE_GATE_NOT_ELIGIBLE' ELSE 'READY_FOR_FROZEN_PRODUCER' END AS reason
  FROM g LEFT JOIN s USING (dataset))"""

DAY_FILES = """perday AS (SELECT symbol, strftime(ts, '%Y-%m-%d') AS name, count(*) AS n FROM ticks GROUP BY ALL),
declared AS (SELECT symbol, name AS path, sha256(symbol || '|' || name || '|' || n) AS sha256 FROM perday),
current_ AS (SELECT symbol, CASE WHEN n % 8 = 3 THEN 'moved/' || name ELSE name END AS path,
  sha256(symbol || '|' || name || '|' || n || CASE WHEN n % 5 = 0 THEN '*' ELSE '' END) AS sha256 FROM perday),
compared AS (SELECT coalesce(d.symbol, c.symbol) AS symbol, coalesce(d.path, c.path) AS path, d.sha256 AS declared_sha256, c.sha256 AS current_sha256,
  CASE WHEN c.path IS NULL THEN 'MISSING' WHEN d.path IS NULL THEN 'EXTRA' WHEN d.sha256 <> c.sha256 THEN 'MISMATCH' ELSE 'OK' END AS problem
  FROM declared d FULL JOIN current_ c ON d.symbol = c.symbol AND d.path = c.path)"""

CAMPAIGNS = """c1 AS (SELECT *, (held_exposure <> 0 AND held_exposure <> lag(held_exposure, 1, 0.0) OVER w)::INT AS fresh FROM led
  WINDOW w AS (PARTITION BY symbol, candidate ORDER BY availability_time)),
c2 AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol, candidate ORDER BY availability_time) AS campaign_id,
  max(availability_time) OVER (PARTITION BY symbol, candidate) AS series_end FROM c1),
runs AS (SELECT symbol, candidate, campaign_id::BIGINT AS campaign_id, arg_min(struct_pack(v := bull_epoch_id), availability_time).v::BIGINT AS bull_epoch_id,
  max(held_exposure) AS side, min(open_time) AS first_open, max(availability_time) AS last_at, count(*) AS bars, sum(log_net) AS log_return,
  max(availability_time) < max(series_end) AS completed FROM c2 WHERE held_exposure <> 0 GROUP BY symbol, candidate, campaign_id)"""
DAY_LED = [*DAY_X, execs(), ledger()]

CLOSES = """cl AS (SELECT symbol, availability_time AS timestamp, close,
    CASE coalesce(a_side, 0) WHEN 1 THEN 'CORE_LONG' WHEN -1 THEN 'CORE_SHORT' ELSE 'FLAT' END AS a_core,
    CASE coalesce(b_side, 0) WHEN 1 THEN 'CORE_LONG' WHEN -1 THEN 'CORE_SHORT' ELSE 'FLAT' END AS b_core,
    direction, coalesce(a_side, 0)::DOUBLE AS a_exposure, coalesce(b_side, 0)::DOUBLE AS b_exposure FROM known),
cl2 AS (SELECT *, coalesce(close / lag(close) OVER w - 1, 0.0) AS pct_change, lag(a_exposure, 1, 0.0) OVER w AS a_old, lag(b_exposure, 1, 0.0) OVER w AS b_old
  FROM cl WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
cl3 AS (SELECT *, ln(1 + (a_old * pct_change - abs(a_exposure - a_old) * 7.0 / 10000)) AS a_log_net,
  ln(1 + (b_old * pct_change - abs(b_exposure - b_old) * 7.0 / 10000)) AS b_log_net, a_core <> b_core AS divergent,
  (a_core <> b_core AND a_old = b_old)::INT AS start FROM cl2)"""

_A, _B = "coalesce(a_side, 0)", "coalesce(b_side, 0)"


def _checks(source: str, pairs: list[tuple[str, str]]) -> str:
    parts = [f"SELECT symbol, '{n}' AS \"check\", count(*) FILTER ({c}) AS failures FROM {source} GROUP BY symbol" for n, c in pairs]
    return "SELECT *, CASE WHEN failures = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (" + " UNION ALL ".join(parts) + ")"


POLICY = """pol(policy_id, core_unit, reduce_fraction, major, minor, gross_cap) AS (VALUES
  ('plain', 1.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE, NULL::DOUBLE), ('halving', 1.0, 0.5, 0.75, 0.4, NULL), ('capped', 0.8, 0.25, 1.0, 0.1, 0.9)),
rs AS (SELECT event_id, policy_id, core_unit AS u, gross_cap AS cap, (['LONG', 'SHORT', 'FLAT', 'LONG'])[event_id % 4 + 1] AS side,
  CASE WHEN event_id % 2 = 0 THEN reduce_fraction ELSE 0.0 END AS cut,
  greatest(CASE WHEN event_id % 3 = 0 THEN major ELSE 0.0 END, CASE WHEN event_id % 5 = 0 THEN minor ELSE 0.0 END) AS asked,
  event_id % 101 = 0 AS odd FROM events, pol),
r1 AS (SELECT *, side = 'LONG' AS lng, side = 'SHORT' AS sht, u * (1 - cut) AS c0, least(asked, u * (1 - cut)) AS h0 FROM rs),
r2 AS (SELECT *, CASE WHEN lng AND cap IS NOT NULL AND c0 + h0 > cap THEN cap / (c0 + h0) ELSE 1.0 END AS scale FROM r1)"""


def leg(expr: str, name: str) -> str:
    return f"round(CASE WHEN lng AND odd THEN NULL ELSE {expr} END, 8) + 0.0::DOUBLE AS {name}"


ARTIFACT = f"""art AS (SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS t, price AS open, price - 1000.5 AS close, seq % 9 = 0 AS bad, seq,
  lag(date_trunc('minute', ts)::TIMESTAMP) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM ticks),
prof AS (SELECT symbol, count(*) AS rows, min(t) AS first_timestamp, max(t) AS last_timestamp, count(*) - count(DISTINCT t) AS duplicate_timestamp,
  0::BIGINT AS invalid_timestamp, count(*) FILTER (t <= {FREEZE}) AS at_or_before_freeze, 0::BIGINT AS non_finite_open, 0::BIGINT AS non_finite_close,
  count(*) FILTER (bad) AS non_finite_target_exposure, count(*) FILTER (open <= 0 OR close <= 0) AS nonpositive_price,
  count(*) FILTER (t < before) AS out_of_order FROM art GROUP BY symbol)"""

TRACE_COLS = "ts, seq, event_type, " + ", ".join(_COLS)
HASH_LINE = " || ".join(f"length({x}) || ':' || {x}" for x in (
    "epoch_us(availability_time)::VARCHAR", "open::DECIMAL(38,12)::VARCHAR", "close::DECIMAL(38,12)::VARCHAR", "'1.000000000000'"))
SEG_COLS = f"""symbol, segment_id, bear_epoch_id, start, "end", bars, {r('cost_bps', 'cost_bps')}, {r('a_log_return', 'a_log_return')},
  {r('b_log_return', 'b_log_return')}, {r('paired_delta_log', 'paired_delta_log')}, paired_delta_log > 0 AS b_better"""
VDAYS = """vb AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'V1' ELSE 'V2' END AS venue, o_orderpriority AS symbol, o_orderdate AS open_time,
  o_orderdate + INTERVAL 1 DAY AS availability_time, arg_min(o_totalprice + 1000000.0, o_orderkey) AS open,
  arg_max(o_totalprice + 1000000.0, o_orderkey) AS close FROM orders GROUP BY ALL)"""

ORACLE: dict[str, str] = {
    "ab_final_equity": with_(*TICK_X, NEXT_OPEN) + f"""SELECT symbol, candidate, count(*) AS bars, {r('arg_max(equity, timestamp)', 'equity')},
      {r('sum(turnover)', 'turnover')} FROM n4 GROUP BY symbol, candidate""",
    "bars_15m": with_(TICKS, B15) + f"SELECT {BAR_COLS} FROM b15",
    "bars_1d": with_(B1D) + f"SELECT {BAR_COLS} FROM b1d",
    "epoch_normalise": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE make_timestamp(epoch_us(ts) // 1000 * 1000) END AS open_time FROM events""",
    "eligible_forward": with_(TICKS, B15) + f"SELECT {BAR_COLS} FROM b15 WHERE availability_time > {FREEZE} AND availability_time <= {CUTOFF}",
    "eligible_warmup": with_(TICKS, B15) + f"SELECT {BAR_COLS} FROM b15 WHERE availability_time <= {FREEZE}",
    "request_window": with_(TICKS, B15) + f"""SELECT symbol, strftime(open_time, '%Y-%m') AS month, count(*) AS bars FROM b15
      WHERE open_time >= {FREEZE} AND open_time < {CUTOFF} GROUP BY ALL""",
    "finite_check": with_(TICKS) + f"""SELECT symbol, count(*) AS rows, count(*) FILTER (seq % 11 <> 0 AND seq % 13 <> 0 AND seq % 17 <> 0) AS finite_rows,
      {r('max(price) FILTER (seq % 11 <> 0 AND seq % 13 <> 0 AND seq % 17 <> 0)', 'max_finite')} FROM ticks GROUP BY symbol""",
    "canonical_bars": with_(TICKS, B15) + f"SELECT symbol, availability_time, {r('open', 'open')}, {r('close', 'close')}, sha256({HASH_LINE}) AS bar_hash FROM b15",
    "dedupe_last": with_(TICKS) + f"""SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS open_time, {r('arg_max(price, seq)', 'price')},
      max(seq) AS src_order FROM ticks GROUP BY ALL""",
    "union_periods": with_(TICKS, "vt AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS v FROM ticks)", bars("vb", 900, "vt", "v, symbol"))
      + f"SELECT symbol, open_time, {r('close', 'close')}, v::BIGINT AS period_no FROM vb",
    "event_violations": with_(f"""d AS (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS t, ({names_sql(", 'UNHEARD_OF'")})[event_id % 13 + 1] AS e FROM events),
      c AS (SELECT symbol, t, e, count(*) AS n FROM d GROUP BY ALL)""") + f"""
      SELECT symbol, 'invalid_timestamp' AS "check", 0::BIGINT AS failures FROM c GROUP BY symbol UNION ALL
      SELECT symbol, 'unknown_event_type', coalesce(sum(n) FILTER (e = 'UNHEARD_OF'), 0)::BIGINT FROM c GROUP BY symbol UNION ALL
      SELECT symbol, 'at_or_before_freeze', coalesce(sum(n) FILTER (t <= {FREEZE}), 0)::BIGINT FROM c GROUP BY symbol UNION ALL
      SELECT symbol, 'duplicate_event', sum(n - 1)::BIGINT FROM c GROUP BY symbol""",
    "rollup_2h": with_(TICKS, B15) + rolled("b15", right_closed("2 HOUR")),
    "rollup_1d": with_(TICKS, B15) + rolled("b15", right_closed("1 DAY")),
    "rollup_72h": with_(TICKS, B15) + rolled("b15", right_closed("72 HOUR")),
    "rollup_1w": with_(B1D) + rolled("b1d", right_closed("7 DAY", MONDAY0)),
    "rollup_1w_compat": with_(TICKS, B15) + rolled("b15", right_closed("7 DAY", MONDAY0, "date_trunc('day', availability_time)::TIMESTAMP")),
    "rollup_3d_year": with_(B1D, """k AS (SELECT *, date_trunc('year', open_time)::TIMESTAMP + to_days(((dayofyear(open_time) - 1) // 3 * 3)::INT) AS s FROM b1d)""")
      + "SELECT * RENAME (s AS open_time), s + INTERVAL 3 DAY AS availability_time FROM (" + rolled("k", "s", "s", "open_time") + ")",
    "rollup_week_open": with_(B1D, "k AS (SELECT *, date_trunc('week', open_time)::TIMESTAMP AS s FROM b1d)")
      + "SELECT * RENAME (s AS open_time), s + INTERVAL 7 DAY AS availability_time FROM (" + rolled("k", "s", "s", "open_time") + ")",
    "rollup_traded": with_(TICKS, B15) + f"""SELECT symbol, {right_closed('2 HOUR')} AS availability_time,
      {r('arg_min(open, availability_time) FILTER (number_of_trades >= 2)', 'open')}, {r('max(high)', 'high')}, {r('min(low)', 'low')},
      {r('arg_max(close, availability_time) FILTER (number_of_trades >= 2)', 'close')}, {r('sum(volume)', 'volume')}, count(*) AS bars,
      count(*) FILTER (number_of_trades >= 2) AS traded_bars FROM b15 GROUP BY symbol, {right_closed('2 HOUR')}""",
    "rebuild_complete": with_(TICKS, B15) + f"""SELECT symbol, time_bucket(INTERVAL 1 HOUR, open_time, {EPOCH0}) AS open_time, {r('arg_min(open, b15.open_time)', 'open')},
      {r('max(high)', 'high')}, {r('min(low)', 'low')}, {r('arg_max(close, b15.open_time)', 'close')}, {r('sum(volume)', 'volume')}, count(*) AS bars
      FROM b15 GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, b15.open_time, {EPOCH0}) HAVING count(*) = 4""",
    "window_audit": with_(*AUDIT) + f"SELECT {AUDIT_COLS}, complete, valid FROM audit",
    "gap_windows": with_(*AUDIT) + f"SELECT {AUDIT_COLS}, 'GAP_COUNT_DIAGNOSTIC_ONLY' AS status FROM audit WHERE NOT complete",
    "quarantined_windows": with_(*AUDIT) + f"SELECT {AUDIT_COLS}, 'OFF_GRID_INPUT' AS reason FROM audit WHERE NOT valid",
    "window_summary": with_(*AUDIT) + f"""SELECT symbol, tf, count(*) AS windows, count(*) FILTER (valid) AS valid_windows, count(*) FILTER (NOT valid) AS invalid_windows,
      count(*) FILTER (NOT complete) AS gap_windows, {r('avg(valid::INT)', 'valid_rate')} FROM audit GROUP BY ALL""",
    "rollup_quarantined": with_(*AUDIT) + "SELECT * FROM (" + rolled("off_grid", right_closed("2 HOUR")) + """) k WHERE NOT EXISTS
      (SELECT 1 FROM audit a WHERE a.tf = '2h' AND NOT a.valid AND a.symbol = k.symbol AND a.window_end = k.availability_time)""",
    "integrity_audit": with_(TICKS, DIRTY_BARS, integrity(f"open_time < {FREEZE} OR open_time >= {CUTOFF}")) + """SELECT *,
      CASE WHEN duplicate_timestamps + envelope_failures + nonpositive_rows + out_of_range_rows > 0 OR NOT monotonic THEN 'FAIL' ELSE 'PASS' END AS status FROM audited""",
    "gap_rows": with_(TICKS, B15, GAPS) + f"SELECT symbol, previous_open_time, next_open_time, {r('gap_seconds', 'gap_seconds')}, missing_bars, next_on_grid FROM gaps",
    "gap_totals": with_(TICKS, B15, GAPS) + f"""SELECT symbol, count(*) FILTER (missing_bars > 0) AS gap_events, sum(missing_bars)::BIGINT AS missing_intervals,
      {r('max(gap_seconds)', 'max_gap_seconds')} FROM gaps GROUP BY symbol""",
    "parity_summary": with_(TICKS, B15, NATIVE2H, derived("d2h", "b15"), paired("d2h", "n2h")) + f"""SELECT symbol, count(*) AS common_bars,
      count(*) FILTER ({WORST} > 1e-8) AS mismatch_bars, {r(f'max({WORST})', 'max_absdiff')},
      {r(f'1 - count(*) FILTER ({WORST} > 1e-8) / count(*)', 'match_rate')} FROM pair GROUP BY symbol""",
    "parity_mismatch": with_(TICKS, B15, NATIVE2H, derived("d2h", "b15"), paired("d2h", "n2h")) + "SELECT symbol, availability_time, base_count, "
      + ", ".join(r(f"{p}_{c}", f"{p}_{c}") for p in ("derived", "native", "absdiff") for c in ("open", "high", "low", "close"))
      + f", 8::BIGINT AS expected_count, base_count <> 8 AS incomplete FROM pair WHERE {WORST} > 1e-8",
    "affected_bars": with_(TICKS, B15, NATIVE2H, derived("d2h", "b15"), paired("d2h", "n2h")) + f"""SELECT DISTINCT {BAR_COLS.replace('symbol', 'b.symbol AS symbol', 1).replace('availability_time', 'b.availability_time AS availability_time', 1)}
      FROM b15 b JOIN pair p ON b.symbol = p.symbol AND b.open_time >= p.availability_time - INTERVAL 2 HOUR AND b.open_time < p.availability_time WHERE {WORST} > 1e-8""",
    "patched_bars": with_(TICKS, B15, PATCH) + f"""SELECT symbol, open_time, availability_time, {', '.join(r(c, c) for c in ('open', 'high', 'low', 'close', 'volume'))}, action FROM patched""",
    "patch_log": with_(TICKS, B15, PATCH) + "SELECT symbol, open_time, " + ", ".join(r(f"{p}_{c}", f"{p}_{c}") for p in ("old", "new") for c in ("open", "high", "low", "close", "volume"))
      + ", action FROM sides WHERE action <> 'keep'",
    "reconcile_result": with_(*RECONCILE) + f"SELECT symbol, availability_time, {r('max_absdiff', 'max_absdiff')}, status FROM result",
    "reconcile_accept": with_(*RECONCILE) + """SELECT symbol, count(*) AS bins_checked, count(*) FILTER (status = 'MATCH') AS bins_matched,
      bool_and(status = 'MATCH') AS accepted FROM result GROUP BY symbol""",
    "coverage_audit": with_(TICKS, HOURS, """want AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS period FROM
      (SELECT symbol, min(period) AS lo, max(period) AS hi FROM mani GROUP BY symbol))""") + """
      SELECT w.symbol AS symbol, '1h' AS interval, w.period AS period, 'MISSING_PERIOD_AFTER_FIRST_GOOD' AS reason FROM want w JOIN first_good g ON g.symbol = w.symbol
        LEFT JOIN mani m ON m.symbol = w.symbol AND m.period = w.period WHERE w.period >= g.g AND coalesce(m.rows, 0) < 2
      UNION ALL SELECT symbol, '1h', period, 'CHECKSUM_MISMATCH_IN_MANIFEST' FROM mani WHERE rows >= 2 AND rows % 7 = 0""",
    "source_gate": with_(USERS) + "SELECT * FROM gate",
    "overall_gate": with_(USERS, """o AS (SELECT interval, count(*) AS series, count(*) FILTER (status LIKE 'FAIL%') AS hard_failed_series,
      sum(hard_source_gaps)::BIGINT AS hard_source_gap_count, count(*) FILTER (end_day_missing > 0) AS publication_missing,
      count(*) FILTER (status LIKE 'WAITING%') AS waiting_series FROM gate GROUP BY interval)""") + """SELECT *, CASE WHEN hard_failed_series > 0 OR hard_source_gap_count > 0 THEN 'FAIL'
      WHEN publication_missing > 0 THEN 'WAITING_SOURCE_ARCHIVE_PUBLICATION' WHEN waiting_series > 0 THEN 'PASS_WITH_EXPECTED_EARLY_WAITING_INTERVALS' ELSE 'PASS' END AS status FROM o""",
    "final_gate": with_(TICKS, B15, DIRTY_BARS, integrity("false"), NATIVE2H, derived("d2h", "b15"), paired("d2h", "n2h"), f"""
      ps AS (SELECT symbol, count(*) FILTER ({WORST} > 1e-8) AS m FROM pair GROUP BY symbol),
      h AS (SELECT sum((duplicate_timestamps > 0)::INT + (NOT monotonic)::INT + (envelope_failures > 0)::INT)::BIGINT AS hard_failures FROM audited)""")
      + """SELECT hard_failures, (SELECT count(*) FILTER (m > 0) FROM ps) AS parity_mismatch_groups, (SELECT sum(m)::BIGINT FROM ps) AS parity_mismatch_bars,
      hard_failures = 0 AS eligible, CASE WHEN hard_failures = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM h""",
    "readiness": with_(READY) + "SELECT dataset, reason, split_part(reason, '_', 1) AS readiness, true AS performance_embargo_active FROM verdict",
    "monitor_scope": with_(TICKS, B15) + f"""SELECT {BAR_COLS}, 'MONITOR_BOUNDED_OVERLAP_NOT_COMPLETE_FORWARD_POOL' AS data_scope FROM b15
      WHERE availability_time > {CUTOFF} - INTERVAL 8 DAY AND availability_time <= {CUTOFF}""",
    "monitor_refresh": with_(TICKS) + f"""SELECT symbol, day, count(DISTINCT slot) AS bars_stored, count(DISTINCT slot) AS bars_rebuilt, true AS matches,
      CASE WHEN day >= ({CUTOFF} - INTERVAL 8 DAY)::DATE THEN 'REFRESHED' ELSE 'KEPT' END AS scope, bool_or(late OR slot > {CUTOFF} - INTERVAL 71 HOUR) AS changed
      FROM (SELECT symbol, time_bucket(INTERVAL 900 SECOND, ts, {EPOCH0}) + INTERVAL 900 SECOND AS slot, slot::DATE AS day,
        seq % 7 = 0 AND ts >= {CUTOFF} - INTERVAL 6 DAY AS late FROM ticks WHERE ts < {CUTOFF}) WHERE slot <= {CUTOFF} GROUP BY symbol, day""",
    "checksum_audit": with_(TICKS, DAY_FILES) + "SELECT * FROM compared",
    "campaign_states_a": with_(*fold_of("tick")) + "SELECT symbol, ts, seq, event_type, " + ", ".join(f"a_{f} AS {f}" for f in _FIELDS) + " FROM st WHERE rn > 0",
    "campaign_states_b": with_(*fold_of("tick")) + "SELECT symbol, ts, seq, event_type, " + ", ".join(f"b_{f} AS {f}" for f in _FIELDS) + " FROM st WHERE rn > 0",
    "ab_trace": with_(*fold_of("tick")) + f"SELECT symbol, {TRACE_COLS} FROM st WHERE rn > 0",
    "ab_trace_users": with_(*fold_of("user")) + f"SELECT symbol AS user_id, {TRACE_COLS} FROM st WHERE rn > 0",
    "asof_states": with_(*TICK_X) + "SELECT symbol, open_time, availability_time, a_side::BIGINT AS a_side, b_side::BIGINT AS b_side, direction::BIGINT AS direction, at_risk::BIGINT AS at_risk FROM known",
    "state_invariants": with_(*fold_of("tick")) + _checks("line", [
        ("major_direction_identical", "false"), ("long_core_occupancy_identical", f"({_A} = 1) <> ({_B} = 1)"),
        ("candidate_b_never_extra_short", f"{_B} = -1 AND {_A} <> -1"),
        ("only_A_short_B_flat_state_divergence", f"{_A} <> {_B} AND NOT ({_A} = -1 AND {_B} = 0)")]),
    "flip_violations": with_(*fold_of("tick"), """f0 AS (SELECT symbol, ts, a_side AS s, lag(a_side, 1, 0) OVER (PARTITION BY symbol ORDER BY ts, seq) AS p FROM line),
      f1 AS (SELECT symbol, ts, count(*) FILTER (s * p = -1) AS flips, count(*) FILTER (s <> p AND p <> 0) AS exits, count(*) FILTER (s <> p AND s <> 0) AS entries FROM f0 GROUP BY ALL)""")
      + """SELECT symbol, 'direct_flip' AS "check", sum(flips)::BIGINT AS failures FROM f1 GROUP BY symbol
      UNION ALL SELECT symbol, 'exit_and_entry_same_instant', count(*) FILTER (exits > 0 AND entries > 0) FROM f1 GROUP BY symbol""",
    "next_open_ledger": with_(*TICK_X, NEXT_OPEN) + "SELECT symbol, candidate, timestamp, " + ", ".join(r(a, b) for a, b in (
        ("open", "open"), ("close", "close"), ("target_exposure", "target_exposure"), ("held_exposure", "held_exposure"), ("turnover", "turnover"),
        ("trade_cost", "trade_cost"), ("gap", "gap_return_component"), ("intra", "intrabar_return_component"), ("gross_factor", "gross_factor"),
        ("net_return", "net_return"), ("equity", "equity"))) + " FROM n4",
    "ledger_violations": with_(*TICK_X, NEXT_OPEN) + " UNION ALL ".join(
        f"SELECT symbol, candidate, '{n}' AS \"check\", {c}::BIGINT AS failures FROM n4 GROUP BY symbol, candidate" for n, c in (
            ("invalid_timestamp", "count(*) FILTER (timestamp IS NULL)"), ("non_finite_input", "count(*) FILTER (open IS NULL OR close IS NULL)"),
            ("nonpositive_price", "count(*) FILTER (open <= 0 OR close <= 0)"), ("duplicate_timestamp", "count(*) - count(DISTINCT timestamp)"),
            ("cost_takes_all", "count(*) FILTER (trade_cost >= 1)"), ("negative_wealth", "count(*) FILTER (1 + gap < 0 OR 1 + intra < 0)"))),
    "exec_ledger": with_(*DAY_LED) + "SELECT symbol, candidate, open_time, availability_time, direction::BIGINT AS direction, at_risk, " + ", ".join(
        r(c, c) for c in ("cost_bps", "open", "close", "target_exposure", "held_exposure", "turnover", "gross_return", "trade_cost", "net_return", "equity", "drawdown", "log_net")) + " FROM led",
    "drawdown": with_(*TICK_X, execs(), ledger()) + f"SELECT symbol, candidate, {r('min(drawdown)', 'max_drawdown')}, {r('max(equity)', 'peak')} FROM led GROUP BY symbol, candidate",
    "paired_close": with_(*DAY_X, CLOSES) + f"""SELECT symbol, timestamp, {r('close', 'close')}, a_core, b_core, {r('a_exposure', 'a_exposure')}, {r('b_exposure', 'b_exposure')},
      {r('pct_change', 'pct_change')}, {r('a_log_net', 'a_log_net')}, {r('b_log_net', 'b_log_net')} FROM cl3""",
    "segments_close": with_(*DAY_X, CLOSES, "cl4 AS (SELECT *, sum(start) OVER (PARTITION BY symbol ORDER BY timestamp) AS sid FROM cl3)") + f"""SELECT symbol, sid::BIGINT AS segment_id,
      min(timestamp) AS start, max(timestamp) AS "end", {r('sum(a_log_net)', 'a_log_return')}, {r('sum(b_log_net)', 'b_log_return')},
      {r('sum(b_log_net) - sum(a_log_net)', 'paired_delta_log')} FROM cl4 WHERE divergent GROUP BY symbol, sid""",
    "executed_invariants": with_(*DAY_X, execs()) + _checks("x", [
        ("execution_clock_identical", "false"), ("executed_major_direction_identical", "false"),
        ("executed_long_occupancy_identical", "(a_held = 1) <> (b_held = 1)"), ("candidate_b_never_extra_executed_short", "b_held = -1 AND a_held <> -1"),
        ("only_A_short_B_flat_executed_divergence", "a_held <> b_held AND NOT (a_held = -1 AND b_held = 0)")]),
    "executed_apart": with_(*DAY_X, *(f"""tape_{s} AS (SELECT * FROM known WHERE day(open_time) <> {d}),
      apart_{s} AS (WITH {execs().replace("FROM known", f"FROM tape_{s}")} SELECT symbol, open_time, a_held, b_held, dir FROM x)""" for s, d in (("a", 27), ("b", 13))),
      """both_sides AS (SELECT symbol, open_time, a.a_held, b.b_held, a.dir AS a_dir, b.dir AS b_dir
      FROM apart_a a FULL JOIN apart_b b USING (symbol, open_time))""") + _checks("both_sides", [
        ("execution_clock_identical", "a_held IS NULL OR b_held IS NULL"), ("executed_major_direction_identical", "a_dir <> b_dir"),
        ("executed_long_occupancy_identical", "(a_held = 1) <> (b_held = 1)"), ("candidate_b_never_extra_executed_short", "b_held = -1 AND a_held <> -1"),
        ("only_A_short_B_flat_executed_divergence", "a_held <> b_held AND NOT (a_held = -1 AND b_held = 0)")]),
    "segments_exec": with_(*DAY_X, execs(), seg()) + f"SELECT {SEG_COLS} FROM seg",
    "bear_epochs": with_(*DAY_X, execs()) + """SELECT symbol, bear_epoch_id::BIGINT AS bear_epoch_id, min(open_time) AS first_open, max(open_time) AS last_open, count(*) AS bars
      FROM x WHERE bear_epoch_id IS NOT NULL GROUP BY ALL""",
    "epochs": with_(*DAY_X, execs(), seg(), epochs_cte()) + f"SELECT symbol, bear_epoch_id, segments, {r('paired_delta_log', 'paired_delta_log')}, paired_delta_log > 0 AS b_better FROM ep",
    "loeo": with_(*DAY_X, execs(), seg(), epochs_cte()) + f"""SELECT symbol, bear_epoch_id AS dropped_bear_epoch_id, {r('total - paired_delta_log', 'remaining_paired_delta_log')}
      FROM ep JOIN (SELECT symbol, sum(paired_delta_log) AS total FROM seg GROUP BY symbol) t USING (symbol)""",
    "mechanism_label": with_(*DAY_X, execs(), seg(), epochs_cte(), label()) + f"SELECT symbol, {LABEL_COLS} FROM labelled",
    "cost_stress": with_(*DAY_X, execs(), seg((7.0, 9.0, 12.0)), epochs_cte(), label((7.0, 9.0, 12.0))) + f"SELECT symbol, {r('cost_bps', 'cost_bps')}, {LABEL_COLS} FROM labelled",
    "venue_consistency": with_(*DAY_X, execs(), seg(), epochs_cte(), label(), """locked(symbol, locked_label) AS (VALUES ('1-URGENT', 'ADVERSE_EXTERNAL_MECHANISM_EVIDENCE'),
      ('2-HIGH', 'MIXED_EXTERNAL_MECHANISM_EVIDENCE'), ('3-MEDIUM', 'EXTERNAL_MECHANISM_SUPPORT'), ('4-NOT SPECIFIED', 'MIXED_EXTERNAL_MECHANISM_EVIDENCE'),
      ('5-LOW', 'ADVERSE_EXTERNAL_MECHANISM_EVIDENCE'))""") + """SELECT symbol, label, locked_label, CASE WHEN label LIKE 'INSUFFICIENT%' THEN 'VENUE_EVIDENCE_INSUFFICIENT'
      WHEN label = locked_label THEN 'VENUE_CONSISTENT' ELSE 'VENUE_SENSITIVE' END AS venue_consistency FROM labelled JOIN locked USING (symbol)""",
    "venue_agreement": with_(VDAYS, *fold_of("day"), states_on("vb"), execs("venue, symbol"), seg(keys="venue, symbol"), epochs_cte("venue, symbol")) + f"""
      SELECT p.symbol AS symbol, count(*) AS common, {r("nullif(corr(p.paired_delta_log, q.paired_delta_log), 'nan'::DOUBLE)", 'correlation')},
      {r('avg((sign(p.paired_delta_log) = sign(q.paired_delta_log))::INT)', 'sign_concordance')}
      FROM ep p JOIN ep q ON p.symbol = q.symbol AND p.bear_epoch_id = q.bear_epoch_id AND p.venue = 'V1' AND q.venue = 'V2' GROUP BY p.symbol""",
    "signflip": with_(*DAY_X, execs(), seg(), """em AS (SELECT symbol, bear_epoch_id, sum(paired_delta_log) AS d
        FROM seg WHERE bear_epoch_id IS NOT NULL GROUP BY ALL),
      el AS (SELECT symbol, count(*) AS n, list(d ORDER BY d) AS ds, sum(d) AS obs FROM em GROUP BY ALL),
      pt AS (SELECT *, unnest(range(0, (1 << n::INT)::BIGINT)) AS pat FROM el),
      fl AS (SELECT symbol, n, obs, list_sum(list_transform(ds, lambda v, i: CASE WHEN (pat >> (i - 1)::INT) & 1 = 1 THEN -v ELSE v END)) AS tot FROM pt)""") + f"""
      SELECT symbol, any_value(n) AS epochs, {r('any_value(obs)', 'observed')}, {r('avg((abs(tot) >= abs(obs) - 1e-12)::INT)', 'p_value')} FROM fl GROUP BY symbol""",
    "information_floor": with_(*DAY_X, execs(), f"""fw AS (SELECT symbol, availability_time AS t, a_target <> b_target AS apart, bear_epoch_id FROM x WHERE availability_time > {DAY_FREEZE}),
      fw2 AS (SELECT *, coalesce(lag(apart) OVER (PARTITION BY symbol ORDER BY t), false) AS was FROM fw),
      fl AS (SELECT symbol, max(t) AS last_observation, count(*) FILTER (apart AND NOT was) AS divergence_segments,
        count(DISTINCT CASE WHEN apart THEN bear_epoch_id END) AS independent_bear_epochs,
        date_diff('second', {DAY_FREEZE}, max(t)) / 86400.0::DOUBLE AS forward_days FROM fw2 GROUP BY symbol),
      fm AS (SELECT *, forward_days >= 180 AS duration_met, divergence_segments >= 6 AS segments_met, independent_bear_epochs >= 3 AS epochs_met FROM fl)""") + f"""
      SELECT symbol, last_observation, divergence_segments, independent_bear_epochs, {r('forward_days', 'forward_days')}, duration_met, segments_met, epochs_met,
      duration_met AND segments_met AND epochs_met AS performance_release_allowed, 180::BIGINT AS min_forward_days, 6::BIGINT AS min_divergence_segments, 3::BIGINT AS min_bear_epochs,
      CASE WHEN duration_met AND segments_met AND epochs_met THEN 'ELIGIBLE_FOR_FROZEN_EVALUATOR' ELSE 'INSUFFICIENT_FORWARD_EVIDENCE' END AS status,
      CASE WHEN duration_met AND segments_met AND epochs_met THEN 'RUN_SEPARATELY_FROZEN_EVALUATOR' ELSE 'KEEP_PERFORMANCE_EMBARGOED' END AS next_action FROM fm""",
    "perf_summary": with_(*DAY_X, execs(), ledger((7.0, 9.0, 12.0))) + f"""SELECT symbol, candidate, {r('cost_bps', 'cost_bps')}, count(*) AS bars,
      {r('arg_max(equity, availability_time) - 1', 'total_return')}, {r('sum(log_net)', 'log_return')}, {r('min(drawdown)', 'max_drawdown')}, {r('sum(turnover)', 'turnover_units')},
      {r('sum(trade_cost)', 'cost_drag_sum')}, {r('avg((held_exposure <> 0)::INT)', 'active_fraction')},
      {r('avg(net_return) * 365.25 / nullif(stddev_samp(net_return) * sqrt(365.25), 0)', 'sharpe_0rf')} FROM led GROUP BY symbol, candidate, cost_bps""",
    "campaigns": with_(*DAY_LED, CAMPAIGNS) + f"SELECT symbol, candidate, campaign_id, bull_epoch_id, {r('side', 'side')}, first_open, last_at, bars, {r('log_return', 'log_return')}, completed FROM runs",
    "campaign_summary": with_(*DAY_LED, CAMPAIGNS) + f"""SELECT symbol, candidate, {r('side', 'side')}, count(*) AS campaigns, {r('avg(log_return)', 'mean_log_return')},
      {r('quantile_cont(log_return, 0.5)', 'median_log_return')}, {r('avg((log_return > 0)::INT)', 'win_rate')} FROM runs GROUP BY symbol, candidate, runs.side""",
    "yearly": with_(*DAY_LED) + f"SELECT symbol, candidate, year(open_time) AS year, count(*) AS bars, {r('sum(log_net)', 'log_return')}, {r('sum(turnover)', 'turnover_units')} FROM led GROUP BY ALL",
    "side_attr": with_(*DAY_LED) + f"""SELECT symbol, candidate, CASE WHEN held_exposure > 0 THEN 'LONG' WHEN held_exposure < 0 THEN 'SHORT' ELSE 'FLAT' END AS side,
      count(*) AS bars, {r('sum(log_net)', 'log_return')}, {r('sum(trade_cost)', 'cost_drag')} FROM led GROUP BY symbol, candidate, 3""",
    "long_gate": with_(*DAY_LED, CAMPAIGNS, """done AS (SELECT * FROM runs WHERE side > 0 AND completed),
      dsum AS (SELECT symbol, candidate, count(*) AS c, sum(log_return) AS total, sum(log_return) - max(log_return) AS nobest FROM done GROUP BY ALL),
      be AS (SELECT symbol, candidate, bull_epoch_id, sum(log_return) AS d FROM done WHERE bull_epoch_id IS NOT NULL GROUP BY ALL),
      bs AS (SELECT symbol, candidate, count(*) AS n, count(*) FILTER (d > 0) AS pos FROM be GROUP BY ALL),
      sp AS (SELECT symbol, candidate, date_diff('second', min(availability_time), max(availability_time)) / 86400.0::DOUBLE AS days FROM led GROUP BY ALL),
      lg AS (SELECT sp.symbol, sp.candidate, coalesce(c, 0) AS completed_campaigns, coalesce(total, 0.0) AS total, coalesce(nobest, 0.0) AS nobest, coalesce(n, 0) AS bull_epochs,
        coalesce(pos, 0) AS positive_epochs, days FROM sp LEFT JOIN dsum USING (symbol, candidate) LEFT JOIN bs USING (symbol, candidate))""") + f"""
      SELECT symbol, candidate, completed_campaigns, {r('total', 'total')}, {r('nobest', 'total_without_best')}, bull_epochs, positive_epochs, {r('days', 'history_days')},
      days >= 365 AND completed_campaigns >= 6 AND bull_epochs >= 3 AND lg.total > 0 AND nobest > 0 AND positive_epochs * 3 >= bull_epochs * 2 AS passed FROM lg""",
    "risk_allocation": with_(POLICY) + "SELECT event_id, policy_id, " + ", ".join(leg(e, n) for e, n in (
        ("CASE WHEN lng THEN c0 * scale ELSE 0.0 END", "core_long"), ("CASE WHEN sht THEN u ELSE 0.0 END", "core_short"),
        ("CASE WHEN lng THEN h0 * scale ELSE 0.0 END", "hedge_short"),
        ("CASE WHEN sht THEN u WHEN NOT lng THEN 0.0 WHEN scale < 1 THEN cap ELSE c0 + h0 END", "gross_exposure"),
        ("CASE WHEN sht THEN -u WHEN lng THEN greatest((c0 - h0) * scale, 0.0) ELSE 0.0 END", "net_exposure"), ("scale", "gross_scale"),
        ("CASE WHEN lng THEN cut ELSE 0.0 END", "applied_reduce_fraction"), ("CASE WHEN lng THEN asked ELSE 0.0 END", "authorized_hedge_fraction")))
      + ", CASE WHEN lng AND odd THEN 'unknown_hedge_reason' END AS refused FROM r2",
    "seed_root": with_(TICKS, DAY_FILES, """leaf AS (SELECT symbol, substr(sha256(path), 1, 3) AS l, sha256(string_agg(path || ' ' || sha256, chr(10) ORDER BY path || ' ' || sha256) || chr(10)) AS d,
      count(*) AS n FROM current_ GROUP BY ALL)""") + """SELECT symbol, sha256(string_agg(l || ' ' || d, chr(10) ORDER BY l || ' ' || d) || chr(10)) AS root_sha256, sum(n)::BIGINT AS files
      FROM leaf GROUP BY symbol""",
    "manifest_verify": with_(TICKS, DAY_FILES) + "SELECT symbol, path, problem FROM compared WHERE problem <> 'OK'",
    "artifact_profile": with_(TICKS, ARTIFACT) + """SELECT *, duplicate_timestamp + at_or_before_freeze + non_finite_target_exposure + nonpositive_price + out_of_order = 0 AS acceptable FROM prof""",
    "journal_verify": with_(*TICK_X, NEXT_OPEN) + "SELECT symbol, candidate, count(*) AS records, 0::BIGINT AS bad_records FROM n4 GROUP BY symbol, candidate",
    "journal_tampered": with_(*TICK_X, NEXT_OPEN, """jn AS (SELECT symbol, candidate, count(*) AS n FROM n4 GROUP BY ALL),
      js AS (SELECT symbol, candidate, unnest(range(1, n + 1)) AS q FROM jn),
      jp AS (SELECT symbol, candidate, unnest([CASE WHEN q % 97 = 0 OR q % 103 = 0 THEN 'BODY_HASH' END, CASE WHEN q % 97 = 0 OR (q > 1 AND (q - 1) % 97 = 0) THEN 'EQUITY' END,
        CASE WHEN q % 97 = 0 THEN 'STATE_AFTER' END, CASE WHEN q % 101 = 0 THEN 'RECORD_HASH' END, CASE WHEN q % 103 = 0 THEN 'SEGMENT' END]) AS problem FROM js)""")
      + "SELECT symbol, candidate, problem, count(*) AS records FROM jp WHERE problem IS NOT NULL GROUP BY ALL",
    "journal_status": with_(*TICK_X, NEXT_OPEN) + f"""SELECT symbol, candidate, count(*) AS seq, max(timestamp) AS last_timestamp, {r('arg_max(held_exposure, timestamp)', 'held_exposure')},
      {r('arg_max(target_exposure, timestamp)', 'pending_target')} FROM n4 GROUP BY symbol, candidate""",
    "contract_verify": with_(TICKS, DAY_FILES, f"""cv AS (SELECT d.symbol, d.path, d.sha256 AS said, c.sha256 AS now FROM declared d LEFT JOIN current_ c ON d.symbol = c.symbol AND d.path = c.path),
      cw AS (SELECT symbol, path, concat_ws(',', CASE WHEN said < '2' THEN 'SELF_HASH' END, CASE WHEN now IS NULL THEN 'ARTIFACT_MISSING' END,
        CASE WHEN now <> said THEN 'ARTIFACT_SHA256' END, CASE WHEN (now < '2') <> (said < '2') THEN 'GATE_STATUS' END,
        CASE WHEN now IS NULL THEN 'CONTENT_REFUSED,GATE_FREEZE,GATE_PERFORMANCE,GATE_JUDGEMENT' END) AS problems FROM cv)""")
      + "SELECT symbol, path, problems, problems = '' AS verified FROM cw",
    "stream_ab_trace": with_(*fold_of("tick")) + f"SELECT symbol, {TRACE_COLS} FROM st WHERE rn > 0",
    "stream_bars_15m": with_(TICKS, B15) + f"SELECT {BAR_COLS} FROM b15",
    "stream_journal": with_(TICKS, B15) + f""",
      body AS (SELECT symbol, open_time, epoch_us(open_time) // 86400000000 AS segment, sha256({HASH_LINE.replace('availability_time', 'open_time')}) AS h,
        row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS seq FROM b15),
      link(symbol, segment, seq, timestamp, record_hash) AS (
        SELECT symbol, segment, seq, open_time, sha256(sha256(symbol || '|' || segment || '|genesis') || '|' || h) FROM body WHERE seq = 1
        UNION ALL SELECT b.symbol, b.segment, b.seq, b.open_time,
          sha256(CASE WHEN b.segment = l.segment THEN l.record_hash ELSE sha256(b.symbol || '|' || b.segment || '|genesis') END || '|' || h)
        FROM link l JOIN body b ON b.symbol = l.symbol AND b.seq = l.seq + 1)
      SELECT symbol, segment, seq, timestamp, record_hash FROM link""",
    "stream_late": "WITH RECURSIVE " + ",\n".join([
        f"""said AS (SELECT event_type AS symbol, ts, event_id AS seq, ({names_sql()})[event_id % 12 + 1] AS event_type, event_id % 50 = 0 AS held FROM events),
mark AS (SELECT max(ts) - INTERVAL 6 HOUR AS w FROM said WHERE NOT held),
judged AS (SELECT said.*, held AND time_bucket(INTERVAL 1 HOUR, ts, {EPOCH0}) + INTERVAL 1 HOUR <= w AS late FROM said, mark),
ev AS (SELECT symbol, ts, seq, event_type, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM judged WHERE NOT late)""", FOLD]) + """
SELECT symbol, ts, seq, event_type, a_core, b_core, false AS late FROM st WHERE rn > 0
UNION ALL SELECT symbol, ts, seq, event_type, NULL, NULL, true FROM judged WHERE late""",
    "stream_retry": with_(TICKS, B15) + """, mark AS (SELECT max(open_time) - INTERVAL 2 DAY AS w FROM b15),
      known AS (SELECT b15.*, time_bucket(INTERVAL 1 HOUR, open_time, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR > w AS known FROM b15, mark)
      SELECT symbol, open_time AS timestamp, 0::BIGINT AS arrival, 'PROCESSED' AS status FROM known
      UNION ALL SELECT symbol, open_time, 1, CASE WHEN known THEN 'IDEMPOTENT_NOOP' ELSE 'EXPIRED' END FROM known WHERE number_of_trades % 2 = 0
      UNION ALL SELECT symbol, open_time, 2, CASE WHEN known THEN 'CONFLICT' ELSE 'EXPIRED' END FROM known WHERE number_of_trades % 3 = 0""",
    "stream_ledger": with_(*TICK_X, NEXT_OPEN) + f"""SELECT symbol, candidate, timestamp, 'PROCESSED' AS status, {r('held_exposure', 'held_exposure')}, {r('turnover', 'turnover')},
      {r('equity', 'equity')}, {r('target_exposure', 'pending_target')} FROM n4""",
    "src_bars": with_(TICKS, B15) + f"SELECT {BAR_COLS} FROM b15",
    "src_klines": with_(TICKS, bars("b", 900, keys="0 AS z")) + f"""SELECT open_time, availability_time, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')},
      {r('volume', 'volume')}, number_of_trades FROM b""",
    "src_ohlc_payloads": with_(TICKS, B15) + f"""SELECT symbol, open_time, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, {r('volume', 'volume')}
      FROM b15 WHERE open_time >= TIMESTAMP '2024-01-03' AND open_time < TIMESTAMP '2024-01-20'""",
    "src_candle_arrays": with_(TICKS, B15) + f"""SELECT symbol, open_time, availability_time, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')},
      {r('volume', 'volume')} FROM b15 WHERE open_time >= TIMESTAMP '2024-01-03' AND open_time < TIMESTAMP '2024-01-20'""",
    "src_events": "WITH e AS (SELECT event_type AS key, ts AS timestamp, " + "CASE event_id % " + str(len(EVENT_NAMES)) + "".join(f" WHEN {k} THEN '{t}'" for k, t in enumerate(EVENT_NAMES))
      + " END AS event_type, event_id::VARCHAR AS note FROM events) SELECT * FROM e",
    "src_execution_bars": with_(*TICK_X, NEXT_OPEN) + f"SELECT timestamp, {r('open', 'open')}, {r('close', 'close')}, {r('target_exposure', 'target_exposure')} FROM n4",
    "src_files": """WITH l AS (SELECT event_type AS symbol, strftime(ts, '%Y-%m-%d') AS day, event_id AS seq, event_id || '|' || epoch_us(ts) AS line FROM events),
      f AS (SELECT symbol, day, string_agg(line, chr(10) ORDER BY seq) || chr(10) AS body FROM l GROUP BY ALL)
      SELECT symbol, day, sha256(body) AS sha256, strlen(body)::BIGINT AS bytes FROM f""",
    "mixed_windows": with_(TICKS, B15, """wide AS (
      SELECT symbol, min(ts) AS start, max(ts) AS "end", count(*) AS n, 2 AS divisor FROM ticks GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')
      UNION ALL SELECT symbol, min(ts), max(ts), count(*), 3 FROM ticks GROUP BY symbol, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')
      UNION ALL SELECT symbol, min(ts), max(ts), count(*), 1 FROM ticks GROUP BY symbol, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'))""") + """
      SELECT w.symbol, start, "end", count(*) AS bars, min(open_time) AS first_open, max(open_time) AS last_open, sum(number_of_trades)::BIGINT AS trades
      FROM wide w JOIN b15 b ON b.symbol = w.symbol AND b.open_time >= w.start AND b.open_time < w."end" WHERE n % divisor = 0 GROUP BY w.symbol, start, "end" """,
    "contract_chains": """WITH RECURSIVE days AS (SELECT event_type AS symbol, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL),
      placed AS (SELECT *, coalesce(lag(day) OVER (PARTITION BY symbol ORDER BY day), CASE WHEN symbol LIKE 's%' THEN max(day) OVER (PARTITION BY symbol) END) AS above FROM days),
      con AS (SELECT symbol, sha256(symbol || '|' || day) AS id, CASE WHEN n % 7 = 0 THEN sha256('lost') WHEN above IS NOT NULL THEN sha256(symbol || '|' || above) END AS parent FROM placed),
      walk(symbol, id, cur, steps) AS (SELECT symbol, id, id, 0 FROM con
        UNION ALL SELECT w.symbol, w.id, c.parent, w.steps + 1 FROM walk w JOIN con c ON c.symbol = w.symbol AND c.id = w.cur WHERE c.parent IS NOT NULL AND w.steps < 200),
      far AS (SELECT symbol, id, max(steps) AS steps, arg_max(cur, steps) AS cur FROM walk GROUP BY symbol, id)
      SELECT f.symbol, f.id AS digest, CASE WHEN steps < 200 THEN steps::BIGINT END AS depth, CASE WHEN steps < 200 THEN cur END AS "end",
        CASE WHEN steps = 200 THEN 'CYCLE' WHEN c.id IS NULL THEN 'MISSING_ANCESTOR' ELSE 'OK' END AS status
      FROM far f LEFT JOIN con c ON c.symbol = f.symbol AND c.id = f.cur""",
    "tree_diff": with_(TICKS, DAY_FILES) + "SELECT * FROM compared WHERE problem <> 'OK'",
    "stream_rollup_2h": with_(TICKS, B15) + rolled("b15", right_closed("2 HOUR")),
    "stream_resume": with_(*TICK_X, NEXT_OPEN) + f"""SELECT symbol, candidate, timestamp, 'PROCESSED' AS status, {r('held_exposure', 'held_exposure')}, {r('turnover', 'turnover')},
      {r('equity', 'equity')}, {r('target_exposure', 'pending_target')} FROM n4 WHERE timestamp > TIMESTAMP '2024-01-20'""",
}
