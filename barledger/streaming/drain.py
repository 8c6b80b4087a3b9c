"""Run a stream over everything that has landed and read what it wrote."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barledger.checks import IntegrityError
from barledger.session import ROCKSDB_STORE, checkpoint_root, ship_package

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


class Closing:
    """A second input of a bounded stream: rows that say what has come to its end.

    The folder is empty while the data are worked off. Once they are, ``end`` writes the
    closing rows, and the same query goes on from its checkpoint and empties its state.
    """

    def __init__(self, spark: SparkSession, schema: str, label: str):
        self._spark, self._schema = spark, schema
        self._path = os.path.join(checkpoint_root(spark), f"{label}-closing-{uuid.uuid4().hex}")
        spark.createDataFrame([], schema).write.parquet(self._path)

    def stream(self) -> DataFrame:
        schema = self._spark.createDataFrame([], self._schema).schema
        return self._spark.readStream.schema(schema).parquet(self._path)

    def end(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._path)


def drain(
    stream: DataFrame, label: str, closing: Closing | None = None, ends: list[DataFrame] = (), base: str | None = None
) -> DataFrame:
    """Process all available input into files in the shared checkpoint folder.

    With ``base``, output and checkpoint lie there, and a later drain goes on from them.

    Each of ``ends`` is then given to ``closing`` and worked off in turn. Rows that a
    watermark dropped stop the drain: they would be missing without a trace.
    """
    spark = ship_package(stream.sparkSession)
    base = base or os.path.join(checkpoint_root(spark), f"{label}-{uuid.uuid4().hex}")
    spark.conf.set(STATE_STORE, ROCKSDB_STORE)  # keyed state needs it; no other query is running
    for rows in (None, *ends):
        if rows is not None:
            closing.end(rows)
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
        if dropped:
            raise IntegrityError(f"{label}: {dropped} rows came later than the watermark allows")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def series_of(table: DataFrame, keys: list[str]) -> DataFrame:
    """The series that a bounded input holds, as rows that close them."""
    return table.select(*keys).distinct().select(*keys, F.lit(True).alias("closes"))
