"""Session settings every plan in this package relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_STORE = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

# Runtime settings: safe to apply to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(
    app: str = "barledger", master: str | None = None, **conf: str
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME_CONF,
        "spark.ui.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_STORE,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package's source to the Python workers, once per application.

    Functions that run in workers are found there by name, so workers need the package
    wherever the driver was started.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        source = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="barledger-src-"), "barledger_src.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(source.rglob("*.py")):
                out.write(path, path.relative_to(source.parent))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def pin_runtime(spark: SparkSession) -> SparkSession:
    """Apply UTC and ANSI to a session created elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch one only in local mode.

    A folder on the driver's machine is shared with all tasks only when they run there
    too, so any other master has to name a folder in spark.checkpoint.dir.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    scratch = tempfile.mkdtemp(prefix="barledger-ckpt-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a columnar table into the shared checkpoint folder.

    Survives executor loss (the files are on shared storage), is written once and
    keeps column pruning, which a row-wise checkpoint does not.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
