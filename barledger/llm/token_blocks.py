"""Token ids on disk: frequency ranks in a byte-aligned code with separate control bytes.

1. Whole texts are encoded once; ids are kept as little-endian words of two bytes, or of
   four for vocabularies that need them.
2. Ids are counted over all documents and ranked, most frequent first, so that common ids
   get small numbers. The rank table is as long as the vocabulary, never longer.
3. Each document's ranks become control bytes with four two-bit lengths each, and the data
   bytes those lengths say (one to four per rank). A block holds the two byte streams of a
   run of documents in id order, each document beginning with a control byte of its own.
4. Reading looks a control byte up in a table of 256 rows: four lengths and their sum.

White space never joins two words of the tokenizer used here: a text's ids are those of
its white-space separated parts, one after the other. Letters and punctuation marks never
share a word either and case is dropped, so parts are cut between the two and lower-cased
first where that can't change an id. Each distinct part is given to the tokenizers library
once as long as a worker remembers it.
"""

from __future__ import annotations

import functools
import os
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from barledger.llm import kernel
from barledger.llm.tables import published

END_ID = 1
#: Ids in a block, as far as whole documents allow.
BLOCK_IDS = 1 << 18
#: Parts whose ids a worker remembers.
CACHED_PARTS = 250_000
_PARTS_AT_ONCE = 4096
_WORDS_BYTES = 2 << 20
_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


#: Lower-case Latin letters, which no normalisation changes and no pattern cuts.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: The byte-level alphabet of those letters beyond ASCII: both UTF-8 bytes as characters.
_ALPHABET = {c: "".join(chr(b if 0xA1 <= b <= 0xAC or b >= 0xAE else 0x100 + b - 0x5E if b < 0xA1 else 0x143) for b in chr(c).encode())
             for c in range(0xDF, 0x100)}
_PROBES = (
    "the of and a", "Don't it's, we're... x'tis' a.b,c;d \"e\"(f)[g]", "\u00e9t\u00e9 na\u00efve stra\u00dfe \u00ff\u00fe", "12ab34!! ***a*** \u00df$$",
    "abcdefghijklmnopqrstuvwxyz", "\u00e0\u00e1\u00e2\u00e3\u00e4\u00e5\u00e6\u00e7\u00e8\u00e9\u00ea\u00eb\u00ec\u00ed\u00ee\u00ef\u00f0\u00f1\u00f2\u00f3\u00f4\u00f5\u00f6\u00f8\u00f9\u00fa\u00fb\u00fc\u00fd\u00fe",
)


class PartCache:
    """Ids of the parts met so far by this worker; begins anew when it is full."""

    def __init__(self, path: str):
        self.model = _tokenizer(path)
        self.clear()
        whole = [self.model.encode(p, add_special_tokens=False).ids for p in _PROBES]
        for probe, ids in zip(_PROBES, whole):
            parts = loosened(pa.array([probe], pa.large_string()))[0].as_py().split()
            if [i for p in parts for i in self.encoded([p])[0]] != ids:
                raise ValueError(f"{path} does not encode a text part by part: {probe!r}")

    def encoded(self, parts: list[str]) -> list[list[int]]:
        """Ids of every part; plain words skip the normaliser and the splitting pattern."""
        out: list[list[int] | None] = [None] * len(parts)
        other = []
        tokenize = self.model.model.tokenize
        for k, part in enumerate(parts):
            if _PLAIN.fullmatch(part):
                out[k] = [t.id for t in tokenize(part if part.isascii() else part.translate(_ALPHABET))]
            else:
                other.append(k)
        for k, found in zip(other, self.model.encode_batch_fast([parts[k] for k in other], add_special_tokens=False)):
            out[k] = found.ids
        return out

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.size = array("i"), array("i")

    def slots(self, parts: list[str]) -> np.ndarray:
        if len(self.slot) > CACHED_PARTS:
            self.clear()
        new = [p for p in parts if p not in self.slot]
        for at in range(0, len(new), _PARTS_AT_ONCE):
            some = new[at : at + _PARTS_AT_ONCE]
            found = self.encoded(some)
            self.slot.update(zip(some, range(len(self.size), len(self.size) + len(some))))
            self.size.extend(map(len, found))
            self.ids.extend(chain.from_iterable(found))
        return np.fromiter(map(self.slot.__getitem__, parts), np.int64, len(parts))


_caches: dict[str, PartCache] = {}


#: A letter and the ASCII marks after it, the apostrophe excepted: it can begin a word.
_LETTER_MARKS = r"(\pL)([!-&(-/:-@\[-`{-~])"


@functools.cache
def _left_alone() -> str:
    """A pattern for special tokens and for letters that the normaliser ends in a mark, such as U+0130 and U+0958."""
    letters = (c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalpha())
    return r"<\||[" + "".join(c for c in letters if not unicodedata.normalize("NFC", c).lower()[-1].isalpha()) + "]"


def loosened(texts: pa.Array) -> pa.Array:
    """The same words for the tokenizer, in fewer distinct parts.

    Left alone are texts with combining marks, which compose before case is dropped, texts
    with letters that end in such a mark once they are composed and case is dropped, and
    texts that might hold a special token, which is matched before anything else.
    """
    data, _ = kernel.text_bytes(texts)
    if ((data == 0xCC) | (data == 0xCD)).any() or pc.any(pc.match_substring_regex(texts, _left_alone())).as_py():
        return texts
    return pc.replace_substring_regex(pc.ascii_lower(texts), _LETTER_MARKS, r"\1 \2")


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids one after the other, and each text's number of ids."""
    texts = loosened(texts)
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    if path not in _caches:
        _caches[path] = PartCache(path)
    cache = _caches[path]
    slot = cache.slots(coded.dictionary.to_pylist())
    ids, size = np.array(cache.ids, np.int64), np.array(cache.size, np.int64)
    begin = np.cumsum(size) - size
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    which = slot[which] if len(slot) else which
    out = ids[kernel.ragged(begin[which], size[which])] if len(which) else ids[:0]
    upto = np.concatenate([[0], np.cumsum(size[which])]).astype(np.int64)
    return out, np.diff(upto[np.asarray(split.offsets)])


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of one byte array as an Arrow column."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def _joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's numbers one after the other, and each row's first."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind) if len(data) else np.zeros(0, kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def _encoder(path: str, end_id: int, kind: str):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        width = np.dtype(kind).itemsize
        for batch in found:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            bounds = np.cumsum(np.concatenate([[0], np.asarray(pc.binary_length(texts))]))
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _WORDS_BYTES, side="right")) - 1)
                ids, count = encode_texts(path, texts[at:to])
                ids = np.insert(ids, np.cumsum(count), end_id).astype(kind)
                ends = np.concatenate([[0], np.cumsum(count + 1)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at:to], pa.array(count + 1), _binary(ids.view(np.uint8), ends * width)], names=["doc_id", "n_tokens", "ids"])
                at = to

    return batches


def id_kind(tokenizer: str, end_id: int = END_ID) -> str:
    """The narrowest of the two widths that holds every id."""
    return "<u2" if max(_tokenizer(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids (little-endian, `id_kind` wide, end id last)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _encoder(tokenizer, end_id, id_kind(tokenizer, end_id)), "doc_id long, n_tokens long, ids binary")


def _counter(kind: str):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in found:
            part = np.bincount(_joined(batch.column(0), kind)[0])
            if len(part) > len(total):
                total = np.concatenate([total, np.zeros(len(part) - len(total), np.int64)])
            total[: len(part)] += part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return batches


def id_ranks(tokens: DataFrame, kind: str) -> np.ndarray:
    """Ids by falling frequency in all documents, equal ones by id. At most the vocabulary."""
    counts = tokens.select("ids").mapInArrow(_counter(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])
    return rows["id"].to_numpy(np.int64)


def pack(numbers: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(control, data, data bytes of each list) of lists that follow each other.

    Two bits a number for its length in bytes less one, four numbers a control byte;
    numbers little-endian. Every list begins with a control byte of its own.
    """
    size = 1 + (numbers >= 1 << 8).astype(np.uint8) + (numbers >= 1 << 16) + (numbers >= 1 << 24)
    slots = -(-count // 4) * 4
    padded = np.zeros(int(slots.sum()), np.uint8)
    padded[kernel.ragged(np.cumsum(slots) - slots, count)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    raw = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    ends = np.concatenate([[0], np.cumsum(count)])
    return control, raw[np.arange(4, dtype=np.uint8) < size[:, None]], np.diff(upto[ends])


_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def unpack(control: bytes, data: bytes, count: np.ndarray) -> np.ndarray:
    """The lists' numbers, by table lookup of each control byte's four lengths."""
    slots = -(-count // 4) * 4
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[kernel.ragged(np.cumsum(slots) - slots, count)]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(size, dtype=np.int64) - size
    if int(size.sum(dtype=np.int64)) != len(raw):
        raise ValueError("control and data bytes disagree")
    out = np.zeros(len(size), np.uint32)
    for k in range(4):
        has = np.flatnonzero(size > k)
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_BLOCKS = "shard int, block long, start_in_shard long, n_ids long, doc_ids array<bigint>, counts array<bigint>, control binary, data binary"


def _cutter(ranked, kind: str, block_ids: int):
    names = [f.split()[0] for f in _BLOCKS.split(", ")]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = ranked.value
        rank_of = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
        rank_of[order] = np.arange(len(order))
        before, block = 0, 0
        for batch in found:
            # A partition is one shard; blocks end with documents and with batches.
            ids, first = _joined(batch.column(2), kind)
            shard, at = batch.column(0).cast(pa.int32()), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(first, first[at] + block_ids, side="right")) - 1)
                count = np.diff(first[at : to + 1])
                control, data, _ = pack(rank_of[ids[first[at] : first[to]]], count)
                held = int(count.sum())
                yield pa.RecordBatch.from_arrays([
                    shard[at : at + 1], pa.array([block]), pa.array([before]), pa.array([held]),
                    pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), batch.column(1)[at:to]),
                    pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), pa.array(count)),
                    pa.array([control.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=names)
                before, block, at = before + held, block + 1, to

    return batches


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> the published (blocks, ranks).

    Blocks are in ascending doc_id order by (shard, block): shards are ranges of doc_id,
    and the documents of a block are listed in order with their counts. Null ids come
    first; rows that repeat a doc_id are ordered by their ids' bytes. A null or empty
    text has the end id alone. Other columns are ignored; an empty table gives no blocks.
    """
    spark = docs.sparkSession
    kind = id_kind(tokenizer, end_id)
    tokens = published(tokenised(docs, tokenizer, end_id), "tokens")
    order = id_ranks(tokens, kind)
    ranked = spark.sparkContext.broadcast(order)
    tie = F.xxhash64("ids")
    sorted_docs = (
        tokens.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "ids")
        .select(F.spark_partition_id().alias("shard"), "doc_id", "ids")
    )
    blocks = published(sorted_docs.mapInArrow(_cutter(ranked, kind, block_ids), _BLOCKS), "token-blocks")
    ranks = spark.createDataFrame([(int(i), k) for k, i in enumerate(order)], "id long, rank long")
    return blocks, published(ranks, "token-ranks")


def _unpacker(ranked, with_ids: bool):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = ranked.value.astype("<u4")
        for batch in found:
            for k in range(batch.num_rows):
                start, doc_ids, counts, control, data = (batch.column(c)[k] for c in range(5))
                count = counts.values.to_numpy(zero_copy_only=False).astype(np.int64)
                ids = order[unpack(control.as_py(), data.as_py(), count)]
                upto = np.concatenate([[0], np.cumsum(count)])
                raw = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto[:-1], upto[1:])]
                columns = [doc_ids.values, pa.array(upto[:-1] + start.as_py()), pa.array(count), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, _binary(ids.view(np.uint8), upto * 4)], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return batches


def read_blocks(blocks: DataFrame, ranks: DataFrame, with_ids: bool = True) -> DataFrame:
    """The published tables back: doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids.

    Every block is decoded; `with_ids` says whether the ids are handed on or only their
    number and checksum.
    """
    spark = blocks.sparkSession
    order = np.array([r["id"] for r in ranks.orderBy("rank").collect()], np.int64)
    # One row of three numbers per shard; there are as many shards as shuffle partitions,
    # so sending the table to all tasks is bounded and the blocks need no shuffle.
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    placed = blocks.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("start_in_shard"))
    return placed.select("start", "doc_ids", "counts", "control", "data").mapInArrow(
        _unpacker(spark.sparkContext.broadcast(order), with_ids),
        "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
