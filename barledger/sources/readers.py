"""Readers for landed files. Schemas are declared, bad input stops the job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barledger import schemas
from barledger.checks import IntegrityError, require_columns
from barledger.functions.clock import epoch_to_timestamp, with_availability
from barledger.operators.dedupe import dedupe_last

NUMBERS = ("open", "high", "low", "close", "volume")


def with_arrival(df: DataFrame) -> DataFrame:
    """Arrival order: file by file in name order, rows of a file in file order.

    ``_metadata`` gives the file and the block; the row counter grows inside a block.
    No shuffle and no global sort is needed, only a comparable value.
    """
    return df.withColumn(
        "src_order",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def _suffix(path: str) -> str:
    name = path.rstrip("/").lower()
    name = name[:-3] if name.endswith(".gz") else name
    return name.rsplit(".", 1)[-1] if "." in name.rsplit("/", 1)[-1] else "parquet"


def read_bars(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Normalised OHLCV from csv(.gz) or parquet; mixed-precision timestamps, strict numbers."""
    first = path if isinstance(path, str) else path[0]
    if _suffix(first) == "parquet":
        raw = spark.read.parquet(*([path] if isinstance(path, str) else path))
    else:
        text = ", ".join(f"{f.split()[0]} string" for f in schemas.BAR.split(", "))
        raw = with_arrival(spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path))
    require_columns(raw, ["open_time", "availability_time", *NUMBERS])
    trades = {"number_of_trades": F.col("number_of_trades").cast("bigint")} if "number_of_trades" in raw.columns else {}
    return raw.withColumns(
        trades
        | {
            "open_time": F.col("open_time").cast("timestamp"),
            "availability_time": F.col("availability_time").cast("timestamp"),
            **{c: F.col(c).cast("double") for c in NUMBERS},
        }
    )


def read_klines(spark: SparkSession, path: str | Sequence[str], seconds: int) -> DataFrame:
    """Header-less klines to bars; a header row is skipped, a wrong column count stops the job."""
    lines = with_arrival(spark.read.text(path))
    parts = F.split("value", ",", -1)
    names = [f.split() for f in schemas.KLINE.split(", ")]
    fields = lines.withColumn("_p", parts).filter(~F.coalesce(F.lower(F.trim(F.col("_p")[0])).startswith("open"), F.lit(False)))
    sized = F.when(F.size("_p") == schemas.KLINE_FIELDS, F.col("_p")).otherwise(
        F.raise_error(F.concat(F.lit("kline row without 12 fields: "), F.col("value")))
    )
    typed = fields.withColumn("_p", sized).select(
        "src_order", *[F.get("_p", i).cast(kind).alias(name) for i, (name, kind) in enumerate(names)]
    )
    bars = typed.withColumn("open_time", epoch_to_timestamp(F.col("open_time_epoch")))
    return with_availability(bars, seconds).select(
        "open_time", "availability_time", *NUMBERS, "number_of_trades", "src_order"
    )


def parse_ohlc_payloads(payloads: DataFrame, keys: Sequence[str], start: Column, end: Column, arrival: str = "src_order") -> DataFrame:
    """Rows with one JSON payload each (column ``payload``) to candles in [start, end).

    The last candle per timestamp wins: by arrival, then by position in the payload.
    """
    doc = F.from_json("payload", schemas.OHLC_PAYLOAD, {"mode": "FAILFAST"})
    rows = payloads.select(*keys, F.col(arrival).alias("_arrival"), F.posexplode(doc["data"]["ohlc"]).alias("_pos", "_c"))
    candles = rows.select(
        *keys,
        F.timestamp_seconds(F.col("_c.timestamp").cast("bigint")).alias("open_time"),
        *[F.col(f"_c.{c}").cast("double").alias(c) for c in NUMBERS],
        F.struct("_arrival", "_pos").alias("src_order"),
    ).filter((F.col("open_time") >= start) & (F.col("open_time") < end))
    return dedupe_last(candles, [*keys, "open_time"]).drop("src_order")


def parse_candle_arrays(payloads: DataFrame, keys: Sequence[str], start: Column, end: Column, seconds: int, arrival: str = "src_order") -> DataFrame:
    """JSON arrays [time, low, high, open, close, volume] to candles in [start, end)."""
    doc = F.from_json("payload", schemas.CANDLE_ARRAYS, {"mode": "FAILFAST"})
    rows = payloads.select(*keys, F.col(arrival).alias("_arrival"), F.posexplode(doc).alias("_pos", "_c"))
    at = {"low": 1, "high": 2, "open": 3, "close": 4, "volume": 5}
    candles = rows.select(
        *keys,
        F.timestamp_seconds(F.element_at("_c", 1)).alias("open_time"),
        *[F.element_at("_c", at[c] + 1).alias(c) for c in NUMBERS],
        F.struct("_arrival", "_pos").alias("src_order"),
    ).filter((F.col("open_time") >= start) & (F.col("open_time") < end))
    return with_availability(dedupe_last(candles, [*keys, "open_time"]).drop("src_order"), seconds)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return with_arrival(spark.read.schema(schemas.EVENT).option("header", True).option("mode", "FAILFAST").csv(path))


# Keyed state handles the rows of one key per micro-batch together, so micro-batches are
# bounded by size; a backlog is worked off batch by batch.
MICRO_BATCH_BYTES = 256 * 1024 * 1024


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.readStream.schema(schemas.EVENT)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("maxBytesPerTrigger", MICRO_BATCH_BYTES)
        .csv(path)
    )


def normalise_timeline(raw: DataFrame, keys: Sequence[str], arrival: str = "src_order") -> DataFrame:
    """State timeline: integer sides, risk flag from text, last row per instant.

    Only the text true, in any case, is a risk; anything else, 1 and yes included, is none.
    """
    risk = F.coalesce(F.lower(F.col("major_at_risk").cast("string")) == "true", F.lit(False)) if "major_at_risk" in raw.columns else F.lit(False)
    typed = raw.withColumns(
        {
            "core_side": F.col("core_side").cast("int"),
            "major_direction": F.col("major_direction").cast("int"),
            "major_at_risk": risk,
        }
    )
    return dedupe_last(typed, [*keys, "timestamp"], arrival)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, ["timestamp", "core_side", "major_direction"])
    return normalise_timeline(with_arrival(raw.withColumn("timestamp", F.col("timestamp").cast("timestamp"))), [])


def _read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    kind = _suffix(path)
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    if kind == "csv":
        return reader.option("header", True).option("enforceSchema", False).csv(path)
    if kind in ("jsonl", "ndjson", "json"):
        return reader.json(path)
    raise IntegrityError(f"unsupported file type: {path}")


def read_state_ledger(spark: SparkSession, path: str) -> DataFrame:
    """State ledger from csv or JSON lines; a csv may leave out the close, which is then null."""
    if _suffix(path) == "csv" and "close" not in spark.read.option("header", True).csv(path).columns:
        fields = [f for f in schemas.STATE_LEDGER.split(", ") if not f.startswith("close ")]
        return _read_rows(spark, path, ", ".join(fields)).withColumn("close", F.lit(None).cast("double"))
    return _read_rows(spark, path, schemas.STATE_LEDGER)


def read_execution_bars(spark: SparkSession, path: str) -> DataFrame:
    """Execution bars from csv or JSON lines; blank lines and empty input are refused."""
    if _suffix(path) != "csv":
        text = spark.read.text(path)
        bad = text.filter(~F.trim("value").startswith("{")).limit(1).count()
        if bad:
            raise IntegrityError("every JSON line must hold one object")
    bars = _read_rows(spark, path, schemas.EXECUTION_BAR)
    if bars.isEmpty():
        raise IntegrityError("input contains no rows")
    return bars


def read_gates(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One-object JSON gates, one row per file."""
    return (
        spark.read.schema(schemas.GATE).option("multiLine", True).option("mode", "FAILFAST").json(path)
        .withColumn("gate_file", F.col("_metadata.file_path"))
    )
