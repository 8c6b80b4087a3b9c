"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A benchmark item of m characters that stands in a document with at most e edits shares at
least m + 1 - q - q * e of its q-grams with it, all on diagonals (document position minus
item position) that lie within e of each other. Documents are read once; their q-grams
that occur in the benchmark are counted per item in overlapping bands of diagonals, and
only bands with enough of them are verified by an alignment that stays inside the band.

The benchmark's index goes to every task. Its size is checked: beyond `CHUNK_CHARS` the
benchmark is cut into chunks by hash, the documents are scanned once for each, and a
chunk's index is released before the next one is built. An index holds about 24 bytes a
character and a table of at most 64 MB, so a chunk takes about 170 MB of a worker.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barledger.llm import kernel
from barledger.llm.tables import published

Q = 12
EDIT_RATE = 0.07
CHUNK_CHARS = 1 << 22


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower-case form, and whether it is a letter or digit."""
    low, alnum = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for code in range(0x110000):
        char = chr(code)
        alnum[code] = char.isalnum()
        if len(small := char.lower()) == 1:
            low[code] = ord(small)
    return low, alnum


_cache: dict[str, np.ndarray] = {}


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts: lower case, every run of other characters one space, trimmed."""
    if not _cache:
        _cache["low"], _cache["alnum"] = _tables()
    size = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    solid = _cache["alnum"][code]
    keep = solid.copy()
    # A separator stays if it follows a solid character of its text and another one comes.
    keep[1:] |= solid[:-1] & (text[1:] == text[:-1])
    low = np.where(solid, _cache["low"][code], 32)[keep].astype(np.uint32)
    text = text[keep]
    last = np.ones(len(low), bool)
    last[:-1] = text[1:] != text[:-1]
    trim = ~(last & (low == 32))
    low, text = low[trim], text[trim]
    return low, np.searchsorted(text, np.arange(len(texts) + 1))


def gram_codes(code: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q characters from each place on (also across texts)."""
    n = len(code) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, out, done = 1, np.zeros(n, np.uint64), 0
    block = kernel.mix(code.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    factor = 0x9E3779B97F4A7C15
    # Blocks of 1, 2, 4, ... characters; the binary digits of q choose which to put together.
    while True:
        if q & have:
            out = out * np.uint64(factor) + block[done : done + n]
            done += have
        if have * 2 > q:
            return kernel.mix(out)
        factor = factor * factor % (1 << 64)
        block = block[:-have] * np.uint64(factor) + block[have:]
        have *= 2


def budget(m: int) -> int:
    """Edits allowed for an item of m normalised characters; the lemma's bound stays positive."""
    q = min(Q, m)
    return min(int(EDIT_RATE * m), (m - q) // q) if m else 0


@dataclass
class Index:
    """One chunk of the benchmark, ready for scanning."""

    ids: np.ndarray
    texts: list[np.ndarray]
    size: np.ndarray
    edits: np.ndarray
    grams: dict[int, tuple[np.ndarray, ...]]


def build_index(items: list[tuple[int, str]]) -> Index:
    code, first = normalised([text for _, text in items])
    texts = [code[a:b] for a, b in zip(first[:-1], first[1:])]
    by_q: dict[int, list[int]] = {}
    for k, text in enumerate(texts):
        if len(text):
            by_q.setdefault(min(Q, len(text)), []).append(k)
    grams = {}
    for q, members in by_q.items():
        codes = [gram_codes(texts[k], q) for k in members]
        value = np.concatenate(codes)
        item = np.repeat(np.array(members, np.int32), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes])
        order = np.argsort(value, kind="stable")
        value, item, place = value[order], item[order], place[order]
        unique, begin = np.unique(value, return_index=True)
        # A table over the hashes' leading bits answers most lookups of absent q-grams.
        shift = np.uint64(64 - min(max(len(unique).bit_length() + 6, 16), 26))
        known = np.zeros(1 << int(64 - shift), bool)
        known[unique >> shift] = True
        grams[q] = (shift, known, unique, np.append(begin, len(value)).astype(np.int32), item, place)
    size = np.array([len(t) for t in texts], np.int64)
    return Index(np.array([i for i, _ in items], np.int64), texts, size, np.array([budget(m) for m in size], np.int64), grams)


def banded_distance(item: np.ndarray, window: np.ndarray, low: int, high: int, limit: int) -> int:
    """Fewest edits that turn the item into some part of the window.

    Cells are item position i and diagonal d with low <= d <= high, where the window
    position is i + d. Returns limit + 1 when more than `limit` edits are needed.
    """
    m, width = len(item), high - low + 1
    far = limit + 1
    d = np.arange(low, high + 1)
    row = np.where((d >= 0) & (d <= len(window)), 0, far)
    steps = np.arange(width)
    for i in range(1, m + 1):
        j = i + d
        inside = (j >= 0) & (j <= len(window))
        at = np.clip(j - 1, 0, max(len(window) - 1, 0))
        differs = (window[at] != item[i - 1]) if len(window) else np.ones(width, bool)
        new = np.where(j >= 1, row + differs, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where(inside, np.minimum(new, far), far)
        row = np.minimum.accumulate(new - steps) + steps
        row = np.where(inside, np.minimum(row, far), far)
        if row.min() >= far:
            return far
    return int(row.min())


def find_items(index: Index, code: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(text number, item number, edits) for every item found in every text."""
    best: dict[tuple[int, int], int] = {}
    size, edits = index.size, index.edits
    for q, (shift, known, unique, begin, item, place) in index.grams.items():
        grams = gram_codes(code, q)
        at = np.flatnonzero(known[grams >> shift])
        if not len(at):
            continue
        slot = np.minimum(np.searchsorted(unique, grams[at]), len(unique) - 1)
        match = unique[slot] == grams[at]
        at, slot = at[match], slot[match]
        text = np.searchsorted(first, at, side="right") - 1
        inner = at + q <= first[text + 1]
        at, slot, text = at[inner], slot[inner], text[inner]
        many = begin[slot + 1] - begin[slot]
        posting = kernel.ragged(begin[slot], many)
        text, at = np.repeat(text, many), np.repeat(at, many)
        which = item[posting]
        diagonal = at - first[text] - place[posting] + size[which]  # not negative
        step = edits[which] + 1
        # Bands of 2 * step diagonals that begin every step: e edits stay inside one of them.
        band = diagonal // step
        key_text, key_item = np.concatenate([text, text]), np.concatenate([which, which])
        key_band = np.concatenate([band, band - 1])
        order = np.lexsort((key_band, key_item, key_text))
        key_text, key_item, key_band = key_text[order], key_item[order], key_band[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(key_text) != 0) | (np.diff(key_item) != 0) | (np.diff(key_band) != 0)
        start = np.flatnonzero(fresh)
        count = np.diff(np.append(start, len(order)))
        need = (size + 1 - q - q * edits)[key_item[start]]
        for k in start[count >= need]:
            t, i, e = int(key_text[k]), int(key_item[k]), int(edits[key_item[k]])
            if best.get((t, i), e + 1) == 0:
                continue
            low = int(key_band[k]) * (e + 1) - int(size[i])
            high = low + 2 * (e + 1) - 1
            text_code = code[first[t] : first[t + 1]]
            distance = banded_distance(index.texts[i], text_code[max(low, 0) : max(high + int(size[i]) + 1, 0)],
                                       low - max(low, 0), high - max(low, 0), e)
            if distance <= e:
                best[t, i] = min(best.get((t, i), distance), distance)
    return [(t, i, d) for (t, i), d in sorted(best.items())]


def _scan(index):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = index.value
        for batch in found:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = batch.column(0)
            rows, items, edits = [], [], []
            size = np.cumsum([0] + [len(t) for t in texts])
            for a, b in kernel.groups(size):
                code, first = normalised(texts[a:b])
                for t, i, d in find_items(chunk, code, first):
                    rows.append(a + t)
                    items.append(int(chunk.ids[i]))
                    edits.append(d)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(edits, pa.int64())],
                names=["doc_id", "item_id", "edits"],
            )

    return batches


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits): benchmark items that stand in documents with few edits.

    Both sides are compared in lower case with every run of characters other than letters
    and digits as one space. An item of m such characters may differ by int(0.07 * m)
    edits (never more than the lemma allows: (m - 12) // 12) and is found anywhere in the
    whole text; items under 24 characters match exactly. Null or empty texts, and items without letters or digits, match nothing; a
    null item_id is left out. Rows that repeat a doc_id or an item_id are compared like
    any other and their findings merge, with the fewest edits. Other columns are ignored;
    if either table is empty there are no rows.
    """
    spark = docs.sparkSession
    items = (
        benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
        .where("item_id is not null and length(text) > 0").distinct()
    )
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(chars / CHUNK_CHARS))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for chunk in range(chunks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == chunk)
        index = spark.sparkContext.broadcast(build_index([tuple(r) for r in part.collect()]))
        hits = texts.mapInArrow(_scan(index), "doc_id long, item_id long, edits long")
        if chunks > 1:
            hits = published(hits, "benchmark-hits")
            index.unpersist()
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, items (ids, ascending), least_edits.

    Documents without a finding, those with a null doc_id included, are not contaminated.
    """
    found = contaminations(docs, benchmark).where("doc_id is not null").groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.min("edits").alias("least_edits"))
    return (
        docs.select(F.col("doc_id").cast("long")).join(found, "doc_id", "left")
        .select("doc_id", F.col("items").isNotNull().alias("contaminated"),
                F.coalesce("items", F.array().cast("array<long>")).alias("items"), "least_edits")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those in which a benchmark item stands; null ids stay."""
    bad = contaminations(docs, benchmark).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["bad_id"], "left_anti")
