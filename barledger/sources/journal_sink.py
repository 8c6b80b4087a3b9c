"""An append-only journal as the sink of a stream: hash chains that go on from their stored tails.

    records/   files of linked records, one per task; a file nobody committed is not part of the journal
    tails/     the last record of every series, one file per shard of series and batch
    commits/   one small manifest per micro-batch: its record files and the tail files now valid

A task links the rows of its series behind the tails it reads, writes records and new
tails under names of their own, and hands their names to the driver in its commit message.
The manifest is written last, by one rename: a batch is in the journal if and only if its
manifest is. A batch that was killed before that is simply run again. One that was killed
later comes once more, too: its rows lie at or before the tails they wrote, are linked again
from the tails before, to the same records, and its manifest stays as it is.

Series are spread over SHARDS, and a shard is written by one task of a batch, so a task
reads the tails of its own shards only and the driver sees file names only.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from barledger.operators.journal import genesis, next_link
from barledger.operators.ordered import previous_row
from barledger.session import ROCKSDB_STORE, ship_package
from barledger.streaming.drain import STATE_STORE

FORMAT = "barledger-journal"
SHARDS = 64
INPUT = "series string, segment bigint, timestamp bigint, body_hash string, body string, shard int"
RECORD = (
    "series string, segment bigint, seq bigint, timestamp bigint, body_hash string, body string, previous_record_hash string, record_hash string"
)
_RECORD = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RECORD.split(", ")])
_TAIL_FIELDS = ("segment", "seq", "timestamp", "record_hash")
_TAIL = pa.schema([
    ("series", pa.string()),
    *[(f"{p}{c}", pa.string() if c == "record_hash" else pa.int64()) for p in ("", "before_") for c in _TAIL_FIELDS],
])


def shard_of(series: Column) -> Column:
    return (F.crc32(series.cast("binary")) % SHARDS).cast("int")


@dataclass
class _Written(WriterCommitMessage):
    records: str | None
    tails: dict[int, str]
    again: bool  # the rows lie behind tails that were read: a batch that is in the journal, or late records


class _Folder:
    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    def at(self, *parts: str) -> str:
        return posixpath.join(self.root, *parts)

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self.at(folder), allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == pafs.FileType.File)

    def exists(self, *parts: str) -> bool:
        return self.fs.get_file_info(self.at(*parts)).type == pafs.FileType.File

    def manifests(self) -> list[str]:
        return [n for n in self.names("commits") if n.endswith(".json")]

    def manifest(self, name: str) -> dict:
        with self.fs.open_input_stream(self.at("commits", name)) as f:
            return json.loads(f.read())

    def valid_tails(self) -> dict[int, str]:
        """Tail file of each shard after the last committed batch."""
        found = self.manifests()
        return {int(k): v for k, v in self.manifest(found[-1])["tails"].items()} if found else {}

    def write(self, table: pa.Table, folder: str) -> str:
        name = f"{uuid.uuid4().hex}.parquet"
        self.fs.create_dir(self.at(folder))
        with self.fs.open_output_stream(self.at(folder, name)) as out:
            pq.write_table(table, out)
        return name

    def read(self, folder: str, name: str) -> pa.Table:
        with self.fs.open_input_file(self.at(folder, name)) as f:
            return pq.read_table(f)


class JournalWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self._path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """Links one task's rows. They are held in memory: a micro-batch's share of its shards."""
        rows = sorted((r.series, r.segment, r.timestamp, r.body_hash, r.body, r.shard) for r in iterator)
        if not rows:
            return _Written(None, {}, False)
        folder = _Folder(self._path)
        valid = folder.valid_tails()
        shards = {r[5] for r in rows}
        tails: dict[int, dict[str, dict]] = {
            s: {t["series"]: t for t in folder.read("tails", valid[s]).to_pylist()} if s in valid else {} for s in shards}
        again: set[bool] = set()
        out, current, name = [], None, None
        for series, segment, timestamp, body_hash, body, shard in rows:
            stored = tails[shard].get(series)
            if series != name:
                name, current = series, stored and {c: stored[c] for c in _TAIL_FIELDS}
                replayed = current is not None and timestamp <= current["timestamp"]
                if replayed:  # the rows of the batch that wrote this tail, or rows that are late
                    current = {c: stored[f"before_{c}"] for c in _TAIL_FIELDS} if stored["before_seq"] is not None else None
                again.add(replayed)
                before = current
            if current is not None and (timestamp <= current["timestamp"] or segment < current["segment"]):
                raise ValueError(f"journal of {series}: a record at {timestamp} comes after one at {current['timestamp']}")
            same = current is not None and current["segment"] == segment
            previous = current["record_hash"] if same else genesis(series, segment)
            link = next_link(previous, body_hash)
            seq = current["seq"] + 1 if current else 1
            out.append((series, segment, seq, timestamp, body_hash, body, previous, link))
            current = {"segment": segment, "seq": seq, "timestamp": timestamp, "record_hash": link}
            empty = dict.fromkeys(_TAIL_FIELDS)
            tails[shard][series] = {"series": series, **current, **{f"before_{c}": v for c, v in (before or empty).items()}}
        if len(again) > 1:
            raise ValueError("journal: late records beside new ones")
        records = folder.write(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RECORD)], schema=_RECORD), "records")
        named = {s: folder.write(pa.Table.from_pylist(list(t.values()), schema=_TAIL), "tails") for s, t in tails.items()}
        return _Written(records, named, again.pop())

    def commit(self, messages: list, batchId: int) -> None:
        folder = _Folder(self._path)
        name = f"{batchId:012d}.json"
        done = [m for m in messages if m is not None and m.records is not None]
        if folder.exists("commits", name):
            return  # this batch is in the journal; what was written again is left aside
        if any(m.again for m in done):
            raise ValueError(f"journal: batch {batchId} holds records that are not behind those in the journal")
        tails = folder.valid_tails()
        for m in done:
            tails.update(m.tails)
        manifest = {"batch": batchId, "records": [m.records for m in done], "tails": {str(k): v for k, v in sorted(tails.items())}}
        folder.fs.create_dir(folder.at("commits"))
        passing = folder.at("commits", f"{uuid.uuid4().hex}.tmp")
        with folder.fs.open_output_stream(passing) as f:
            f.write(json.dumps(manifest).encode())
        folder.fs.move(passing, folder.at("commits", name))

    def abort(self, messages: list, batchId: int) -> None:
        """Nothing to undo: files without a manifest are not part of the journal."""


class JournalSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return INPUT

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return JournalWriter(self.options["path"])


def chain_journal(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream (series, segment, timestamp in microseconds, body_hash, body) to the journal at ``path``.

    Records of a series come in order of their instants from one micro-batch to the next,
    as settled chunks do; within a batch any order will do. A record at or before the tail
    of its series stops the stream. Restarted from its checkpoint, a stream that was killed
    at any moment leaves each record in the journal once.
    """
    spark = ship_package(records.sparkSession)
    spark.conf.set(STATE_STORE, ROCKSDB_STORE)  # as drain does: records may come out of keyed state
    spark.dataSource.register(JournalSink)
    laid = records.withColumn("shard", shard_of(F.col("series"))).repartition("shard")
    return (
        laid.select(*[c.split()[0] for c in INPUT.split(", ")]).writeStream.format(FORMAT)
        .option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The records of all committed batches."""
    folder = _Folder(path)
    files = [n for m in folder.manifests() for n in folder.manifest(m)["records"]]
    if not files:
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).parquet(*[posixpath.join(path, "records", n) for n in files])


def verify_chains(journal: DataFrame) -> DataFrame:
    """Rows (series, problem, records) of a journal: gaps, broken links, wrong hashes. No row for a sound one."""
    rows = previous_row(
        journal.withColumn("at", F.timestamp_micros("timestamp")), ["series"], ["at", "seq"], ["seq", "segment", "record_hash", "timestamp"])
    same = F.coalesce(F.col("prev.segment") == F.col("segment"), F.lit(False))
    start = F.sha2(F.concat_ws("|", "series", F.col("segment").cast("string"), F.lit("genesis")), 256)
    checks = {
        "GAP": F.col("seq") == F.coalesce(F.col("prev.seq"), F.lit(0)) + 1,
        "CHAIN": F.col("previous_record_hash") == F.when(same, F.col("prev.record_hash")).otherwise(start),
        "RECORD_HASH": F.col("record_hash") == F.sha2(F.concat_ws("|", "previous_record_hash", "body_hash"), 256),
        "ORDER": F.coalesce(F.col("timestamp") > F.col("prev.timestamp"), F.col("prev").isNull()),
    }
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))
    return rows.select("series", F.explode(found).alias("problem")).groupBy("series", "problem").agg(F.count("*").alias("records"))
