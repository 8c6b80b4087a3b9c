"""Sampled SentencePiece segmentations, and lossless decoding.

Every space becomes the model's space mark (one more is put in front, as the model does),
and every other character stays as it is. All pieces of the vocabulary that match make a
lattice. Forward filtering sums the weight of all segmentations up to each position;
backward sampling walks from the end and draws each piece by its share. A character
without a piece of its own falls back to byte pieces.

Pieces start at a space mark or lie inside a word, so the lattice of a text is a chain of
one lattice per word: forward sums are computed once for each distinct word of a group of
texts and shared by its occurrences, while every occurrence draws for itself. (Pieces of
several space marks would span words; they are left out.)

The number drawn at a place is a hash of seed, row key and place, so segmentations do not
depend on partitions, batches or retries. The model ranks pieces but has no probabilities:
the weight of the piece of rank r is (r + 2.7) ** -alpha.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from barledger.llm import kernel

#: Sharpness: 0 draws all segmentations alike, larger values prefer few common pieces.
ALPHA = 0.2
SEED = 20240601
MARK = 0x2581
#: Stands for a space mark that is in the text itself, which only byte pieces can say.
_LITERAL_MARK = 0x110000
_FILTER_BITS = 20
GROUP_CHARS = 1 << 20


class Pieces:
    """Lookup tables of one model file."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1, np.int32)
        plain, raw = [], [b""] * n
        for i, text in enumerate(texts):
            if model.is_byte(i):
                self.byte[int(text[3:5], 16)] = i
                raw[i] = bytes([int(text[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                raw[i] = text.replace(chr(MARK), " ").encode()
                if chr(MARK) not in text[1:]:
                    plain.append(i)
        if (self.byte < 0).any():
            raise ValueError(f"{path} has no byte pieces: decoding would not be lossless")
        code = [np.array([ord(c) for c in texts[i]], np.uint32) for i in plain]
        bounds = np.cumsum([0] + [len(c) for c in code])
        value = kernel.span_hash(kernel.prefix_sums(np.concatenate(code)), bounds[:-1], bounds[1:])
        order = np.argsort(value)
        self.value, self.id = value[order], np.array(plain, np.int32)[order]
        if len(np.unique(value)) < len(value):
            raise ValueError("two pieces share a hash")
        self.log_weight = -alpha * np.log(np.arange(len(plain)) + 2.7)[order]
        self.byte_weight = -alpha * np.log(len(plain) + 2.7)
        self.longest = max(map(len, code))
        # Slot of the first piece whose hash begins with given bits; few pieces share them.
        lead = (self.value >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
        held = np.bincount(lead, minlength=1 << _FILTER_BITS)
        self.bucket = (np.cumsum(held) - held).astype(np.int32)
        self.known, self.deepest = held > 0, int(held.max())
        self.size = np.array([len(r) for r in raw])
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are a piece's, and that piece's slot."""
        lead = value >> np.uint64(64 - _FILTER_BITS)
        maybe = np.flatnonzero(self.known[lead])
        slot, wanted = self.bucket[lead[maybe]], value[maybe]
        hit = self.value[slot] == wanted
        for k in range(1, self.deepest):
            more = np.flatnonzero(~hit)
            near = np.minimum(slot[more] + k, len(self.value) - 1)
            same = self.value[near] == wanted[more]
            slot[more[same]] = near[same]
            hit[more[same]] = True
        return maybe[hit], slot[hit]


_loaded: dict[tuple[str, float], Pieces] = {}


def pieces(path: str, alpha: float = ALPHA) -> Pieces:
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Pieces(path, alpha)
    return _loaded[path, alpha]


class Lattices:
    """The edges of many words' lattices, sorted by the node they end in."""

    def __init__(self, table: Pieces, words: list[str]):
        size = np.array([len(w) + 1 for w in words], np.int64)
        text = chr(MARK) + chr(MARK).join(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        begin = np.cumsum(size) - size
        marked = code == MARK
        marked[begin] = False
        code[marked] = _LITERAL_MARK
        n = len(code)
        sums = kernel.prefix_sums(code)
        left = np.repeat(begin + size, size) - np.arange(n)  # characters to the word's end
        starts, ends, slots = [], [], []
        at = np.arange(n)
        single = np.zeros(n, bool)
        for length in range(1, table.longest + 1):
            at = at[left[at] >= length]
            if not len(at):
                break
            value = kernel.span_hash(sums, at, at + length)
            found, slot = table.find(value)
            found = at[found]
            if length == 1:
                single[found] = True
            starts.append(found)
            ends.append(found + length)
            slots.append(slot)
        alone = np.flatnonzero(~single)
        starts.append(alone)
        ends.append(alone + 1)
        start, end = np.concatenate(starts), np.concatenate(ends)
        slot = np.concatenate(slots)
        weight = np.concatenate([table.log_weight[slot], np.full(len(alone), table.byte_weight)])
        # A piece's id, or a character for the byte pieces as -1 - code point.
        self.say = np.concatenate([table.id[slot].astype(np.int64), -1 - code[alone].astype(np.int64)])
        # Node of a place: its character's index plus one for every earlier word.
        word = np.repeat(np.arange(len(words)), size)
        self.base = begin + np.arange(len(words))
        start_node = start + word[start]
        end_node = end + word[start]
        order = np.argsort(end_node, kind="stable")
        start_node, end_node, weight = start_node[order], end_node[order], weight[order]
        nodes = n + len(words)
        many = np.bincount(end_node, minlength=nodes)
        first = np.cumsum(many) - many
        alpha = np.full(nodes, -np.inf)
        alpha[self.base] = 0.0
        share = np.empty(len(order))
        # Place by place, for all words that are long enough.
        open_words = np.arange(len(words))
        for place in range(1, int(size.max()) + 1):
            open_words = open_words[size[open_words] >= place]
            node = self.base[open_words] + place
            length = many[node]
            at = kernel.ragged(first[node], length)
            begins = np.cumsum(length) - length
            value = alpha[start_node[at]] + weight[at]
            top = np.maximum.reduceat(value, begins)
            scaled = np.exp(value - np.repeat(top, length))
            upto = np.cumsum(scaled)
            upto -= np.repeat(upto[begins] - scaled[begins], length)
            total = upto[begins + length - 1]
            alpha[node] = top + np.log(total)
            upto /= np.repeat(total, length)
            upto[begins + length - 1] = 1.0
            share[at] = upto
        self.start_node = start_node
        self.say = self.say[order]
        self.reach = end_node + share
        self.size = size


def encode(table: Pieces, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sampled ids one after the other, and each text's number of ids."""
    split = pc.split_pattern(texts, pattern=" ")
    flat = split.flatten()
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    parts = np.diff(np.asarray(split.offsets))
    blank = np.asarray(pc.binary_length(texts)) == 0
    if not words or blank.all():
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    net = Lattices(table, words)
    owner = np.repeat(np.arange(len(texts)), parts)
    alive = ~blank[owner]
    which, owner = which[alive], owner[alive]
    parts = np.where(blank, 0, parts)
    size = net.size[which]
    upto = np.cumsum(size) - size
    first = (np.cumsum(parts) - parts)[owner]
    offset = upto - upto[first]  # characters of the text before this word
    key = kernel.mix(keys[owner] ^ kernel.mix(np.full(len(owner), SEED, np.uint64)))
    base = net.base[which]
    node = base + size
    # Drawn from the back: rows still inside their word, their pieces so far, and the piece.
    # Rows are taken word by word, so that lookups move through the lattice in order.
    rows, drawn = np.argsort(which, kind="stable"), []
    count = np.zeros(len(which), np.int64)
    while len(rows):
        place = (offset[rows] + node[rows] - base[rows]).astype(np.uint64)
        bits = kernel.mix(key[rows] + place * np.uint64(0x9E3779B97F4A7C15))
        edge = np.searchsorted(net.reach, node[rows] + (bits >> np.uint64(11)) * (1.0 / (1 << 53)), side="right")
        drawn.append((rows, count[rows], edge))
        count[rows] += 1
        node[rows] = net.start_node[edge]
        rows = rows[node[rows] > base[rows]]
    last = np.cumsum(count) - 1
    say = np.empty(int(count.sum()), np.int64)
    for row, nth, edge in drawn:
        say[last[row] - nth] = net.say[edge]
    many = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
    fallback = np.flatnonzero(say < 0)
    if len(fallback):
        char = -1 - say[fallback]
        char[char == _LITERAL_MARK] = MARK
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in char]
        width = np.ones(len(say), np.int64)
        width[fallback] = [len(r) for r in raw]
        text_of = np.repeat(np.arange(len(texts)), many)
        at = np.cumsum(width) - width
        out = np.repeat(say, width)
        out[kernel.ragged(at[fallback], width[fallback])] = table.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return out.astype(np.int32), np.bincount(text_of, weights=width, minlength=len(texts)).astype(np.int64)
    return say.astype(np.int32), many


def decode(table: Pieces, ids: np.ndarray, count: np.ndarray) -> list[str]:
    size = table.size[ids]
    data = table.bytes[kernel.ragged(table.start[ids], size)].tobytes()
    upto = np.concatenate([[0], np.cumsum(size)])
    bounds = upto[np.concatenate([[0], np.cumsum(count)])]
    return [data[a + 1 : b].decode() if b > a else "" for a, b in zip(bounds[:-1], bounds[1:])]


def row_keys(ids: pa.Array) -> np.ndarray:
    """64-bit keys of the rows; all null ids share one."""
    return kernel.mix(np.asarray(ids.fill_null(-1)).astype(np.int64).view(np.uint64))


def _groups(batch: pa.RecordBatch, table: Pieces) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with their ids and numbers of ids."""
    texts = batch.column(1).cast(pa.large_string()).fill_null("")
    keys = row_keys(batch.column(0))
    bounds = np.cumsum(np.concatenate([[0], np.asarray(pc.binary_length(texts))]))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + GROUP_CHARS, side="right")) - 1)
        yield batch.slice(at, to - at), *encode(table, texts[at:to], keys[at:to])
        at = to


def _lists(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), pa.array(ids))


def _encoder(path: str, alpha: float):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path, alpha)
        for batch in found:
            for rows, ids, count in _groups(batch, table):
                yield pa.RecordBatch.from_arrays([*rows.columns, _lists(ids, count)], names=["doc_id", "text", "ids"])

    return batches


def _round_tripper(path: str, alpha: float):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path, alpha)
        for batch in found:
            for rows, ids, count in _groups(batch, table):
                same = pc.equal(pa.array(decode(table, ids, count), pa.string()), rows.column(1).fill_null(""))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), _lists(ids, count), pa.array(count), same], names=["doc_id", "ids", "n_ids", "lossless"])

    return batches


def _decoder(path: str, alpha: float):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path, alpha)
        for batch in found:
            lists = batch.column(1)
            count = np.asarray(pc.list_value_length(lists).fill_null(0)).astype(np.int64)
            texts = decode(table, np.asarray(lists.flatten()), count)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return batches


def encode_sampled(docs: DataFrame, model: str, alpha: float = ALPHA) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, ids: one sampled segmentation of each whole text.

    A null or empty text has no ids. The sample depends on seed, doc_id and text alone;
    rows with a null doc_id share one key, repeated rows get equal ids. Other columns are
    ignored; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _encoder(model, alpha), "doc_id long, text string, ids array<int>")


def decode_ids(encoded: DataFrame, model: str, alpha: float = ALPHA) -> DataFrame:
    """encoded(doc_id, ids, ...) -> doc_id, ids, decoded: exactly the text that was encoded ('' if null)."""
    return encoded.select("doc_id", "ids").mapInArrow(
        _decoder(model, alpha), "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, model: str, alpha: float = ALPHA) -> DataFrame:
    """doc_id, ids, n_ids, lossless: every row encoded, decoded from its ids, and compared."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _round_tripper(model, alpha), "doc_id long, ids array<int>, n_ids long, lossless boolean")
