"""Writers for published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barledger.checks import IntegrityError


def write_bars(bars: DataFrame, path: str, keys: Sequence[str] = ("venue", "symbol", "tf"), fmt: str = "parquet") -> None:
    """Bars laid out by series, sorted by availability time inside each file.

    A series is spread over writers by month, however many months it has, so a hot or
    long series is not written by one task.
    """
    part = [k for k in keys if k in bars.columns]
    spread = F.year("availability_time") * 12 + F.month("availability_time")
    laid = bars.repartition(*part, spread).sortWithinPartitions(*part, "availability_time")
    writer = laid.write.partitionBy(*part)
    if fmt == "csv":
        writer.option("header", True).option("compression", "gzip").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise IntegrityError(f"unsupported format: {fmt}")


def write_days(bars: DataFrame, path: str) -> None:
    """Bars by their ``day``; of a table that is there, only the days that come are replaced.

    A day of many series is written by as many tasks as its size asks for. Spark stages the
    files and swaps the partitions at commit, so a failed run can simply be repeated.
    """
    laid = bars.hint("rebalance", "day").sortWithinPartitions("day")
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_record(one_row: DataFrame, path: str) -> None:
    """A gate, summary or contract: exactly one JSON record."""
    rows = one_row.limit(2).collect()
    if len(rows) != 1:
        raise IntegrityError(f"expected one record, got {len(rows)} or more")
    # What was counted is what is written: the plan runs once.
    one_row.sparkSession.createDataFrame(rows, one_row.schema).coalesce(1).write.json(path)


def append_journal(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only JSON lines; the checkpoint makes each micro-batch land once."""
    return (
        records.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
