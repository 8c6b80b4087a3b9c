"""The driver's tables seen as this package's inputs.

``events`` supplies ticks and campaign events for 15-minute bars over 30 days;
``orders`` supplies daily bars and campaign events over six years. Every row of both
tables is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barledger.functions.clock import with_availability
from barledger.operators.campaign import EVENT_TYPES
from barledger.operators.candles import bars_from_ticks
from barledger.operators.exposure import Policy
from barledger.session import pin_runtime, ship_package
from barledger.sources.readers import MICRO_BATCH_BYTES

TICK_BASE = 1000.0
DAY_BASE = 1_000_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(pin_runtime(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream."""
    schema = table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", MICRO_BATCH_BYTES)
    return reader.parquet(f"{sf_dir}/{name}.parquet*")  # a glob: one file or a folder


def follow(written: DataFrame) -> DataFrame:
    """The folder of a written table as a stream of its files."""
    folder = written.inputFiles()[0].rsplit("/", 1)[0]
    return written.sparkSession.readStream.schema(written.schema).option("maxBytesPerTrigger", MICRO_BATCH_BYTES).parquet(folder)


def ticks(spark: SparkSession, sf_dir: str, source=table) -> DataFrame:
    e = source(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        (F.col("value") + TICK_BASE).alias("price"),
        F.col("value").alias("qty"),
    )


def venue_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ticks as two independent tapes."""
    venue = F.when(F.col("seq") % 2 == 0, "V1").otherwise("V2")
    return ticks(spark, sf_dir).withColumn("venue", venue)


def bars_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), ["symbol"], 900)


def bars_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), ["symbol"], 60)


def tick_events(spark: SparkSession, sf_dir: str, key: str = "event_type", source=table) -> DataFrame:
    e = source(spark, sf_dir, "events")
    return e.select(
        F.col(key).alias("symbol" if key == "event_type" else key),
        "ts",
        F.col("event_id").alias("seq"),
        _type_by_number(F.col("event_id")).alias("event_type"),
    )


def _type_by_number(n):
    names = F.array(*[F.lit(t) for t in EVENT_TYPES])
    return F.get(names, (n % len(EVENT_TYPES)).cast("int"))


def day_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").alias("day"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_totalprice") + DAY_BASE).alias("price"),
    )


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = day_ticks(spark, sf_dir)
    daily = t.groupBy("symbol", F.col("day").alias("open_time")).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.count("*").cast("double").alias("volume"),
        F.count("*").alias("number_of_trades"),
    )
    return with_availability(daily, 86400)


def day_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    second = F.make_dt_interval(secs=(F.col("o_orderkey") % 86400))
    return o.select(
        F.col("o_orderpriority").alias("symbol"),
        (F.col("o_orderdate") + second).alias("ts"),
        F.col("o_orderkey").alias("seq"),
        _type_by_number(F.col("o_orderkey")).alias("event_type"),
    )


def mixed_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event instants as epoch integers, half in microseconds and half in milliseconds."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        "event_id", F.when(F.col("event_id") % 2 == 0, us).otherwise(F.floor(us / F.lit(1000))).alias("epoch")
    )


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign events with unknown types and repeated (instant, type) pairs."""
    e = table(spark, sf_dir, "events")
    names = F.array(*[F.lit(t) for t in (*EVENT_TYPES, "UNHEARD_OF")])
    return e.select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_id").alias("seq"),
        F.get(names, (F.col("event_id") % 13).cast("int")).alias("event_type"),
    )


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw bar per tick with duplicates, disorder, broken envelopes and bad prices."""
    t = ticks(spark, sf_dir)
    q = F.col("qty")
    return t.select(
        "symbol",
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("open_time"),
        F.col("price").alias("open"),
        (F.col("price") + q - 2).alias("high"),
        (F.col("price") - q).alias("low"),
        F.when(q < 0.5, -q).otherwise(F.col("price")).alias("close"),
        (F.col("seq") * 2 + F.when(F.col("seq") % 10 == 0, 31).otherwise(0)).alias("src_order"),
    )


def off_grid_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15-minute bars in which those with a multiple of five trades open at their first tick."""
    bars = ticks(spark, sf_dir).groupBy("symbol", F.window("ts", "900 seconds")["start"].alias("slot")).agg(
        F.min("ts").alias("first_ts"),
        F.min_by("price", F.struct("ts", "seq")).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "seq")).alias("close"),
        F.sum("qty").alias("volume"),
        F.count("*").alias("number_of_trades"),
    )
    at = F.when(F.col("number_of_trades") % 5 == 0, F.col("first_ts")).otherwise(F.col("slot"))
    return with_availability(bars.withColumn("open_time", at), 900).drop("slot", "first_ts")


def venue_bars(spark: SparkSession, sf_dir: str, seconds: int = 900) -> DataFrame:
    return bars_from_ticks(venue_ticks(spark, sf_dir), ["venue", "symbol"], seconds)


def venue_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of two venues, each from its own half of the orders."""
    t = day_ticks(spark, sf_dir).withColumn("venue", F.when(F.col("seq") % 2 == 0, "V1").otherwise("V2"))
    daily = t.groupBy("venue", "symbol", F.col("day").alias("open_time")).agg(
        F.min_by("price", "seq").alias("open"), F.max_by("price", "seq").alias("close")
    )
    return with_availability(daily, 86400)


def native_bars_2h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second publisher's 2-hour bars, whose close is off where trades divide by seven."""
    bars = bars_from_ticks(ticks(spark, sf_dir), ["symbol"], 7200)
    off = F.when(F.col("number_of_trades") % 7 == 0, 0.01).otherwise(0.0)
    return bars.withColumn("close", F.col("close") + off)


def damaged_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of a tape that lost its thin hours and whose close is off at times."""
    bars = bars_from_ticks(ticks(spark, sf_dir), ["symbol"], 3600).filter("number_of_trades >= 3")
    off = F.when(F.col("number_of_trades") % 5 == 0, 0.25).otherwise(0.0)
    return bars.withColumn("close", F.col("close") + off)


def hourly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source manifest per (symbol, interval, hour): thin hours are not ok, some digests differ."""
    t = ticks(spark, sf_dir).groupBy("symbol", F.window("ts", "1 hour")["start"].alias("period")).agg(F.count("*").alias("rows"))
    text = F.concat_ws("|", "symbol", F.col("rows").cast("string"))
    remote = F.sha2(text, 256)
    return t.select(
        "symbol", F.lit("1h").alias("interval"), "period", "rows",
        F.when(F.col("rows") >= 2, "ok").otherwise("short").alias("status"),
        remote.alias("remote_sha256"),
        F.when(F.col("rows") % 7 == 0, F.sha2(F.concat(text, F.lit("!")), 256)).otherwise(F.upper(remote)).alias("local_sha256"),
    )


def user_series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(series, manifest): every user is a series on one of four clocks, one file per active day."""
    e = table(spark, sf_dir, "events")
    clocks = F.array(*[F.lit(c) for c in ("1h", "1d", "3d", "1w")])
    interval = F.get(clocks, (F.col("user_id") % 4).cast("int"))
    keyed = e.select("user_id", interval.alias("interval"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("period"))
    manifest = keyed.groupBy("user_id", "interval", "period").agg(F.count("*").alias("rows"))
    return manifest.select("user_id", "interval").distinct(), manifest


def user_gates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(gates, state_gates): one source gate per user from its event count; users with a late signup also have a state gate."""
    n = F.col("n")
    late_signup = (F.col("event_type") == "signup") & (F.col("ts") >= F.expr("timestamp_ntz'2024-01-29'"))
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("dataset")).agg(
        F.count("*").alias("n"), F.bool_or(late_signup).alias("has_state")
    )
    statuses = F.array(*[F.lit(s) for s in (
        "PASS", "PASS_WITH_EXPECTED_EARLY_WAITING_INTERVALS", "WAITING_SOURCE_ARCHIVE_PUBLICATION", "FAIL")])

    def gate(df: DataFrame, k: int) -> DataFrame:
        return df.select(
            "dataset",
            F.get(statuses, ((n * k) % 4).cast("int")).alias("status"),
            F.when(n % 11 == k, "monitor").otherwise("full").alias("mode"),
            F.when(n % 13 == k, "PARTIAL").otherwise("FULL_REBUILD_COMPLETE_FORWARD_POOL").alias("data_scope"),
            (n % 17 == k).alias("performance_evaluation_allowed"),
            (n % 19 == k).alias("judgement_allowed"),
            (n % 7 != 0).alias("state_only"),
            (n % 9 == 0).alias("price_use_allowed"),
        )

    return gate(counts, 1), gate(counts.filter("has_state"), 3)


def day_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(declared, current) file digests per symbol and day; some changed, some moved."""
    t = ticks(spark, sf_dir).groupBy("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    path = F.date_format("day", "yyyy-MM-dd")
    body = F.concat_ws("|", "symbol", path, F.col("n").cast("string"))
    base = t.select("symbol", "n", path.alias("name"), body.alias("body"))
    moved = F.when(F.col("n") % 8 == 3, F.concat(F.lit("moved/"), F.col("name"))).otherwise(F.col("name"))
    changed = F.when(F.col("n") % 5 == 0, F.concat("body", F.lit("*"))).otherwise(F.col("body"))
    declared = base.select("symbol", F.col("name").alias("path"), F.sha2("body", 256).alias("sha256"))
    current = base.select("symbol", moved.alias("path"), F.sha2(changed, 256).alias("sha256"))
    return declared, current


def risk_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk state rows from events; reasons by number, one of them unknown to every policy."""
    n = F.col("event_id")
    sides = F.array(*[F.lit(s) for s in ("LONG", "SHORT", "FLAT", "LONG")])
    reasons = F.array_compact(
        F.array(F.when(n % 3 == 0, "major_risk"), F.when(n % 5 == 0, "local_risk"), F.when(n % 101 == 0, "rumour"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", F.get(sides, (n % 4).cast("int")).alias("core_side"), (n % 2 == 0).alias("reduced"), reasons.alias("hedge_reasons")
    )


# Scenario parameters, like the cost grid.
POLICIES = (
    Policy("plain", 1.0, 0.0, {"major_risk": 0.5, "local_risk": 0.25}),
    Policy("halving", 1.0, 0.5, {"major_risk": 0.75, "local_risk": 0.4}),
    Policy("capped", 0.8, 0.25, {"major_risk": 1.0, "local_risk": 0.1}, 0.9),
)
