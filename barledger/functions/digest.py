"""Content hashes. One own encoding, version 2, used everywhere in this package.

A record is its fields one after the other, each as its length in characters, a colon and
its text; a missing value is a single '-'. No two different records have one encoding,
whatever characters their fields hold. Instants are microseconds since the epoch, numbers
decimal(38,12): the twelfth decimal is the finest difference between prices that counts
here, and a number that doesn't fit stops the job. The same text can be produced in any
SQL engine, so hashes can be checked outside Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from barledger.functions.clock import micros

ENCODING_VERSION = 2


def instant_text(ts: Column) -> Column:
    return micros(ts).cast("string")


def number_text(x: Column) -> Column:
    return x.cast("decimal(38,12)").cast("string")


def plain_text(x: Column) -> Column:
    return x.cast("string")


def record_hash(parts: Sequence[Column]) -> Column:
    fields = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*fields), 256)


def bar_hash(ts: Column, open_: Column, close: Column, target: Column) -> Column:
    return record_hash([instant_text(ts), number_text(open_), number_text(close), number_text(target)])


def set_digest(lines: Column) -> Column:
    """Hash of a set of lines, independent of arrival order (an aggregate)."""
    joined = F.array_join(F.array_sort(F.collect_list(lines)), "\n")
    return F.sha2(F.concat(joined, F.lit("\n")), 256)
