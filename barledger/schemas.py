"""Explicit schemas of every landed or published table."""

from __future__ import annotations

BAR = (
    "open_time timestamp, availability_time timestamp, open double, high double, low double, "
    "close double, volume double, number_of_trades bigint"
)
# Header-less exchange klines, in column order.
KLINE = (
    "open_time_epoch bigint, open double, high double, low double, close double, volume double, "
    "close_time_epoch bigint, quote_asset_volume double, number_of_trades bigint, "
    "taker_buy_base_asset_volume double, taker_buy_quote_asset_volume double, ignore string"
)
KLINE_FIELDS = 12
EVENT = "key string, timestamp timestamp, event_type string, note string"
TIMELINE = "timestamp timestamp, core_side int, major_direction int, major_at_risk string"
STATE_LEDGER = "timestamp timestamp, a_core string, b_core string, bear_epoch_id string, close double"
EXECUTION_BAR = "timestamp timestamp, open double, close double, target_exposure double"
# One request of the OHLC endpoint; numbers arrive as text.
OHLC_PAYLOAD = (
    "data struct<pair: string, ohlc: array<struct<timestamp: string, open: string, high: string, "
    "low: string, close: string, volume: string>>>"
)
# One request of the candle endpoint: [time, low, high, open, close, volume].
CANDLE_ARRAYS = "array<array<double>>"
GATE = (
    "status string, mode string, data_scope string, classification string, "
    "freeze_boundary_utc_exclusive timestamp, completed_source_day_end_utc string, "
    "performance_evaluation_allowed boolean, judgement_allowed boolean, "
    "state_only boolean, price_use_allowed boolean"
)
