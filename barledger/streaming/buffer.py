"""Rows of a keyed stream held back until their order is settled.

A series' rows may arrive in any order and in any number of micro-batches. They are kept
in state by time slot until they lie ``lateness`` behind the latest instant seen, or until
a closing row says that the series has ended, and are then handed on in order, slot by
slot, so that memory holds one slot at a time. With a lateness of 0 every micro-batch is
settled at once; with ``math.inf`` only the end settles. Rows at or before the settled
part are handed on as late, never dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessorHandle

SLOT_SECONDS = 3600


def _pack(rows: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class Buffer:
    def __init__(self, handle: StatefulProcessorHandle, order: Sequence[str], lateness_seconds: float):
        self._order, self._lateness = list(order), lateness_seconds
        self._parts = handle.getMapState("parts", "slot bigint, part int", "rows binary")
        self._seen = handle.getValueState("seen", "latest bigint, part int")

    def add(self, rows: pd.DataFrame, closed: bool) -> Iterator[pd.DataFrame]:
        """Take rows in; hand on what is settled now, in order."""
        at = self._order[0]
        latest, part = self._seen.get() if self._seen.exists() else (None, 0)
        if len(rows):
            micros = rows[at].astype("datetime64[us]").astype("int64")
            newest = int(micros.max())
            latest = newest if latest is None else max(latest, newest)
            if self._lateness > 0:
                for slot, some in rows.groupby(micros // (SLOT_SECONDS * 1_000_000)):
                    self._parts.updateValue((int(slot), part), (_pack(some),))
                part += 1
            self._seen.update((latest, part))
        if self._lateness <= 0:
            if len(rows):
                yield rows.sort_values(self._order, kind="stable")
            return
        upto = math.inf if closed else -math.inf if latest is None else latest - self._lateness * 1_000_000
        slots: dict[int, list[int]] = {}
        for slot, number in list(self._parts.keys()):
            if slot * SLOT_SECONDS * 1_000_000 <= upto:
                slots.setdefault(slot, []).append(number)
        for slot in sorted(slots):
            numbers = sorted(slots[slot])
            held = pd.concat([_unpack(self._parts.getValue((slot, n))[0]) for n in numbers])
            held = held.sort_values(self._order, kind="stable")
            ready = held[at].astype("datetime64[us]").astype("int64") <= upto
            for n in numbers:
                self._parts.removeKey((slot, n))
            if not ready.all():
                self._parts.updateValue((slot, numbers[0]), (_pack(held[~ready]),))
            if ready.any():
                yield held[ready]
