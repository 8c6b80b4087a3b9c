"""Digests of files of any size, read block by block.

A file is never held: a task streams it through SHA-256 in blocks. Small files share a
task, up to PACK_BYTES together; the driver sees names and sizes only.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import posixpath
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "barledger-files"
PACK_BYTES = 128 << 20
BLOCK_BYTES = 4 << 20
SCHEMA = "path string, sha256 string, bytes bigint"


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + root[5:] if root.startswith("file:/") and not root.startswith("file://") else root)
    return pafs.LocalFileSystem(), root


def packed(files: list[tuple[str, int]], limit: int = PACK_BYTES) -> list[list[str]]:
    """Names in groups of at most ``limit`` bytes; a larger file is a group of its own."""
    out: list[list[str]] = []
    room = 0
    for name, size in files:
        if not out or size > room:
            out.append([])
            room = limit
        out[-1].append(name)
        room -= size
    return out


class _Reader(DataSourceReader):
    def __init__(self, root: str, pattern: str):
        self._root, self._pattern = root, pattern

    def partitions(self) -> list[InputPartition]:
        fs, base = opened(self._root)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        visible = lambda p: not any(x[:1] in "._" for x in posixpath.relpath(p, base).split("/"))
        files = sorted((posixpath.relpath(f.path, base), f.size) for f in found
                       if f.type == pafs.FileType.File and visible(f.path) and fnmatch.fnmatch(f.base_name, self._pattern))
        return [InputPartition(json.dumps(names)) for names in packed(files)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, base = opened(self._root)
        for name in json.loads(partition.value):
            digest, size = hashlib.sha256(), 0
            with fs.open_input_stream(posixpath.join(base, name)) as stream:
                while block := stream.read(BLOCK_BYTES):
                    digest.update(block)
                    size += len(block)
            yield name, digest.hexdigest(), size


class FileDigests(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("pattern", "*"))


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, bytes) of every file under ``root``, path relative to it.

    Names that begin with a dot or an underscore are left out, as Spark's readers do; a
    folder without files gives no rows.
    """
    spark.dataSource.register(FileDigests)
    return spark.read.format(FORMAT).option("pattern", pattern).load(root)
