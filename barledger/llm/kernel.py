"""Vectorised text helpers that run inside tasks, on one Arrow batch at a time.

Hashes here are fixed functions of the bytes: they do not depend on the process, the
batch or the partition, so a recomputed task gives the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Texts of a batch are worked on in groups of about this many bytes (one long text alone).
GROUP_BYTES = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if "up" in _powers and len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    up, down = np.full(n, _BASE), np.full(n, _BASE_INV)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if n <= 4 * GROUP_BYTES:
        _powers.update(up=up, down=down)
    return up, down


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes[start:end], the same wherever those bytes stand."""
    _, down = _power_table(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes and their offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] :], offsets - offsets[0]


def groups(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of texts of about GROUP_BYTES together."""
    out, at = [], 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, side="right")) - 1
        to = max(to, at + 1)
        out.append((at, to))
        at = to
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def solid(data: np.ndarray) -> np.ndarray:
    """Bytes of words: all but space and the ASCII controls 9 to 13."""
    return (data != 32) & (data - np.uint8(9) > 4)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for every text the number of words before it."""
    text = solid(data)
    left = text.copy()
    left[1:] &= ~text[:-1]
    right = text.copy()
    right[:-1] &= ~text[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    left[inner] |= text[inner]
    right[inner - 1] |= text[inner - 1]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    return start, end, np.searchsorted(start, offsets)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... for length[i] places, for all i one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - begin, length)
