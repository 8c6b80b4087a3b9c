"""Reading the given tables and publishing intermediate ones."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from barledger.session import checkpoint_root, ship_package

_open: list[str] | None = None
_finished: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def published(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), f"llm-{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if _open is not None:
        _open.append(path)
    return spark.read.schema(df.schema).parquet(path)


def concluded(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Publish what `make` returns; within a stage, what `make` has published on its way is deleted."""
    before = len(_open or [])
    result = published(make(), label)
    if _open is not None:
        discard(result.sparkSession, _open[before:-1])
        del _open[before:-1]
    return result


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete published tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


@contextmanager
def stage(spark: SparkSession) -> Iterator[None]:
    """Around one stage of a pipeline whose result is written before the next stage begins.

    What the stage publishes on its way is deleted when the next one begins: its result may
    still be lazy until then, and not afterwards.
    """
    global _open, _finished
    discard(spark, _finished)
    _open, _finished = [], []
    try:
        yield
    finally:
        _open, _finished = None, _open


def free_name(df: DataFrame, base: str) -> str:
    """A column name like `base` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
