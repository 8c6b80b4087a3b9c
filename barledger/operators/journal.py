"""Hash-chained ledgers of processed bars.

A single chain over a whole series can only be built one record after another. Here a
series is cut into segments of fixed time width: records chain inside their segment,
starting from a segment genesis, and segment tails chain into seals. Changing any
record still breaks its chain, its seal and every later seal, yet segments are built
in parallel and no task ever holds more than one of them.

Everything a record states and the links themselves are computed by built-in expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barledger.functions.digest import bar_hash, instant_text, number_text, plain_text, record_hash
from barledger.operators.ledger import next_open_ledger
from barledger.operators.ordered import BAR_CHUNK_SECONDS, CHUNK, chunk_of, previous_row, running
from barledger.session import materialise

SCHEMA_VERSION = 1
TOLERANCE = 1e-9
_STATE = ["last_timestamp", "last_bar_hash", "held_exposure", "pending_target", "equity", "last_close"]
_BODY = [
    "schema_version", "segment", "seq", "timestamp", "open", "close", "target_exposure", "bar_hash",
    "fee_bps", "slippage_bps", "state_before_hash", "held_exposure", "turnover", "equity", "state_after_hash",
]


def genesis(series: str, segment: int) -> str:
    return hashlib.sha256(f"{series}|{segment}|genesis".encode()).hexdigest()


def next_link(previous: str, body: str) -> str:
    return hashlib.sha256(f"{previous}|{body}".encode()).hexdigest()


def _genesis_column(keys: Sequence[str]) -> Column:
    name = F.concat_ws("/", *keys)
    return F.sha2(F.concat_ws("|", name, F.col("segment").cast("string"), F.lit("genesis")), 256)


def state_hash(ts: Column, bar: Column, held: Column, target: Column, equity: Column, close: Column) -> Column:
    return record_hash(
        [instant_text(ts), plain_text(bar), number_text(held), number_text(target), number_text(equity), number_text(close)]
    )


def _start_state_hash() -> Column:
    none = F.lit(None)
    return state_hash(none.cast("timestamp"), none.cast("string"), F.lit(0.0), none.cast("double"), F.lit(1.0), none.cast("double"))


def _after_hash() -> Column:
    return state_hash(
        F.col("timestamp"), F.col("bar_hash"), F.col("held_exposure"), F.col("target_exposure"), F.col("equity"), F.col("close")
    )


def _body_hash() -> Column:
    numbers = {"open", "close", "target_exposure", "fee_bps", "slippage_bps", "held_exposure", "turnover", "equity"}
    parts = []
    for c in _BODY:
        if c == "timestamp":
            parts.append(instant_text(F.col(c)))
        else:
            parts.append(number_text(F.col(c)) if c in numbers else plain_text(F.col(c)))
    return record_hash(parts)


def build_journal(
    bars: DataFrame, keys: Sequence[str], fee_bps: float = 7.0, slippage_bps: float = 0.0, seconds: int = BAR_CHUNK_SECONDS
) -> DataFrame:
    """Journal records, one per bar, with chained ``record_hash``."""
    ledger = next_open_ledger(bars, keys, fee_bps, slippage_bps, seconds)
    rows = ledger.select(*keys, "timestamp", "open", "close", "target_exposure", "held_exposure", "turnover", "equity")
    # Numbering and look-back each read the ledger twice; write it once instead.
    rows = materialise(rows, "journal-ledger")
    rows = rows.withColumn("bar_hash", bar_hash(F.col("timestamp"), F.col("open"), F.col("close"), F.col("target_exposure")))
    rows = running(rows, keys, ["timestamp"], {"seq": ("sum", F.lit(1))}, seconds)
    rows = previous_row(rows.withColumn("state_after_hash", _after_hash()), keys, ["timestamp"], ["state_after_hash"], seconds)
    records = (
        rows.withColumn("segment", F.col(CHUNK))
        .withColumn("schema_version", F.lit(SCHEMA_VERSION))
        .withColumn("fee_bps", F.lit(float(fee_bps)))
        .withColumn("slippage_bps", F.lit(float(slippage_bps)))
        .withColumn("state_before_hash", F.coalesce(F.col("prev.state_after_hash"), _start_state_hash()))
        .withColumn("body_hash", _body_hash())
        .withColumn("previous_record_hash", _genesis_column(keys))
        .withColumn("record_hash", F.lit(None).cast("string"))
        .select(*keys, *_BODY, "body_hash", "previous_record_hash", "record_hash")
    )

    return _linked(records, keys)


def _linked(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records with their links: one segment is one sorted array, hashed along by built-in functions."""
    held = [c for c in records.columns if c not in (*keys, "segment", "previous_record_hash", "record_hash")]
    segments = records.groupBy(*keys, "segment").agg(
        F.sort_array(F.collect_list(F.struct("seq", *[c for c in held if c != "seq"]))).alias("r"),
        F.min("previous_record_hash").alias("genesis"),  # the same in all records of a segment
    )
    links = F.aggregate(
        F.col("r.body_hash"), F.array("genesis"),
        lambda out, body: F.array_append(out, F.sha2(F.concat_ws("|", F.element_at(out, -1), body), 256)))
    n = F.size("r")
    rows = segments.withColumn("links", links).select(
        *keys, "segment", F.inline(F.arrays_zip("r", F.slice("links", 1, n).alias("before"), F.slice("links", 2, n).alias("link"))))
    return rows.select(
        *[F.col("before").alias(c) if c == "previous_record_hash" else F.col("link").alias(c) if c == "record_hash"
          else F.col(c) if c in (*keys, "segment") else F.col(f"r.{c}").alias(c) for c in records.columns])


def _chain_seals(tails: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seals over the segment tails of a series: one short row list per series."""
    ordered = F.sort_array(F.collect_list(F.struct("segment", "tail", "records")))
    seals = F.expr(
        "aggregate(t, struct(cast(array() as array<string>) as out, '' as s), (acc, x) -> struct("
        "array_append(acc.out, sha2(concat_ws('|', acc.s, x.segment, x.tail), 256)) as out,"
        "sha2(concat_ws('|', acc.s, x.segment, x.tail), 256) as s), acc -> acc.out)"
    )
    return tails.groupBy(*keys).agg(ordered.alias("t")).select(
        *keys, F.inline(F.arrays_zip(F.col("t.segment").alias("segment"), F.col("t.records").alias("records"),
                                     F.col("t.tail").alias("tail"), seals.alias("seal")))
    )


def seal_segments(journal: DataFrame, keys: Sequence[str]) -> DataFrame:
    tails = journal.groupBy(*keys, "segment").agg(
        F.max_by("record_hash", "seq").alias("tail"), F.count("*").alias("records")
    )
    return _chain_seals(tails, keys)


def verify_journal(journal: DataFrame, keys: Sequence[str], seconds: int = BAR_CHUNK_SECONDS) -> DataFrame:
    """Every record with the list of what is wrong with it. Fully parallel, no Python.

    Stored hashes let each record be checked against the one before it alone.
    """
    carried = ["record_hash", "seq", "segment", "state_after_hash", "timestamp", "held_exposure", "target_exposure", "equity", "close"]
    # Ordered by seq in chunks by time; the record before is taken within the series.
    rows = previous_row(journal, keys, ["timestamp", "seq"], carried, seconds)
    p = {c: F.col(f"prev.{c}") for c in carried}
    same_segment = F.coalesce(p["segment"] == F.col("segment"), F.lit(False))
    expected_prev = F.when(same_segment, p["record_hash"]).otherwise(_genesis_column(keys))
    old = F.coalesce(p["held_exposure"], F.lit(0.0))
    new = F.coalesce(p["target_exposure"], F.lit(0.0))
    turn = F.abs(new - old)
    rate = (F.col("fee_bps") + F.col("slippage_bps")) / 10000.0
    grown = (
        F.coalesce(p["equity"], F.lit(1.0))
        * F.coalesce(1 + old * (F.try_divide("open", p["close"]) - 1), F.lit(1.0))
        * (1 - turn * rate)
        * (1 + new * (F.try_divide("close", "open") - 1))
    )

    def off(cond: Column, name: str) -> Column:
        return F.when(~F.coalesce(cond, F.lit(False)), name)

    near = lambda a, b: F.abs(a - b) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(b))
    problems = F.array_compact(
        F.array(
            off(F.col("schema_version") == SCHEMA_VERSION, "SCHEMA_VERSION"),
            off(F.col("body_hash") == _body_hash(), "BODY_HASH"),
            off(F.col("record_hash") == F.sha2(F.concat_ws("|", "previous_record_hash", "body_hash"), 256), "RECORD_HASH"),
            off(F.col("seq") == F.coalesce(p["seq"], F.lit(0)) + 1, "SEQUENCE"),
            off(F.col("previous_record_hash") == expected_prev, "CHAIN"),
            off(F.col("state_before_hash") == F.coalesce(p["state_after_hash"], _start_state_hash()), "STATE_BEFORE"),
            off(F.col("bar_hash") == bar_hash(F.col("timestamp"), F.col("open"), F.col("close"), F.col("target_exposure")), "BAR_HASH"),
            off(p["timestamp"].isNull() | (F.col("timestamp") > p["timestamp"]), "DUPLICATE_OR_LATE_BAR"),
            off(near(F.col("held_exposure"), new), "HELD_EXPOSURE"),
            off(near(F.col("turnover"), turn), "TURNOVER"),
            off(near(F.col("equity"), grown), "EQUITY"),
            off(F.col("state_after_hash") == _after_hash(), "STATE_AFTER"),
            off(F.col("segment") == chunk_of(F.col("timestamp"), seconds), "SEGMENT"),
        )
    )
    return rows.select(*keys, "segment", "seq", "timestamp", problems.alias("problems"))


def verify_seals(journal: DataFrame, seals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments whose stored seal does not follow from the records now present."""
    now = seal_segments(journal, keys).select(*keys, "segment", F.col("seal").alias("_seal"), F.col("records").alias("_records"))
    both = seals.join(now, [*keys, "segment"], "full")
    same = F.col("seal").eqNullSafe(F.col("_seal")) & F.col("records").eqNullSafe(F.col("_records"))
    return both.filter(~same).select(*keys, "segment", F.lit("SEAL_MISMATCH").alias("problem"))


def journal_status(journal: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where each journal stands; operational columns only, no equity."""
    return journal.groupBy(*keys).agg(
        F.max("seq").alias("seq"),
        F.max_by("timestamp", "seq").alias("last_timestamp"),
        F.max_by("held_exposure", "seq").alias("held_exposure"),
        F.max_by("target_exposure", "seq").alias("pending_target"),
        F.max_by("record_hash", "seq").alias("tail_hash"),
    )


# The columns that may be published while performance is embargoed.
PUBLIC_COLUMNS = (
    "status", "seq", "segment", "timestamp", "last_timestamp", "held_exposure", "pending_target",
    "turnover", "bar_hash", "record_hash", "tail_hash", "state_after_hash",
)


def public_view(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only allow-listed columns; anything not named stays inside."""
    return df.select(*[c for c in df.columns if c in keys or c in PUBLIC_COLUMNS])
