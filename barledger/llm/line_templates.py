"""Line dedup with a log-template tree of fixed depth.

A line is a run of words up to a newline or a word that ends a sentence, so passages that
recur inside a longer line count as well. Its path through the tree is its number of
words, then its leading words; words with a digit are variable fields and count as one
placeholder. Below that path a long line also stands for four more general templates, in
each of which one quarter of the remaining words is a variable field. Two lines follow
one template when they share any of these paths, however the fields are filled.

A template that occurs in several documents recurs: the document with the smallest id
keeps its lines, all others lose theirs. Lines of fewer than five words are too common by
chance to be templates and are only lost as part of a run.

Then runs of RUN or more words that are left whole and also stand in an earlier document
go, wherever they begin and end. Winnowing picks, from every window of RUN words, the
short gram with the least hash; documents that share a picked gram are compared on the
hashes of all windows around it, so a run is found exactly and to the word.

Only 64-bit hashes, ids and numbers of places are shuffled until the rewrite. A hash is
aggregated to its smallest and largest document before it is shuffled. Places are joined
with what was found only if a bit table of fixed size lets them through, and those of very
common hashes know their owner from a list of bounded length, so a template that fills a
third of the corpus is no more work for one task than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from barledger.llm import kernel
from barledger.llm.tables import free_name, published

MIN_WORDS = 5
LEADING = 2
LONG_WORDS = 16
PARTS = 4
RUN = 51
GRAM = 16
#: Grams in a window of RUN words.
PICKS = RUN - GRAM + 1
#: Leading bits of a hash that a task looks up before it hands a place on: 4 MB.
FILTER_BITS = 25
#: Hashes at more than one in so many places, and at more than so many places, stay out of joins.
HOT_SHARE, HOT_LEAST = 10_000, 1_000

_MASK = np.uint64(0x5851F42D4C957F2D)
_SALT = [np.uint64(pow(0xA0761D6478BD642F, k, 1 << 64)) for k in range(1, PARTS + 4)]
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words' starts and ends, each line's first word (plus a last sentinel), each text's first line."""
    start, end, first = kernel.words(data, offsets)
    if not len(start):
        return start, end, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    breaks = np.zeros(len(start), bool)
    breaks[first[:-1][np.diff(first) > 0]] = True
    after = np.searchsorted(start, np.flatnonzero(data == 10))
    breaks[after[after < len(start)]] = True
    breaks[1:] |= _ENDS[data[end[:-1] - 1]]
    at = np.flatnonzero(breaks)
    return start, end, np.append(at, len(start)), np.searchsorted(at, first)


def template_paths(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, line number in the text, path hash) for every template of every line."""
    start, end, at, of_text = lines(data, offsets)
    size = np.diff(at)
    chosen = np.flatnonzero(size >= MIN_WORDS)
    empty = np.zeros(0, np.int64)
    if not len(chosen):
        return empty, empty, np.zeros(0, np.uint64)
    word = kernel.span_hash(kernel.prefix_sums(data), start, end)
    word[np.searchsorted(start, np.flatnonzero((data >= 48) & (data <= 57)), side="right") - 1] = _MASK
    # A position-bound sum: the hash of words a..b of a line starting at s is the sum of
    # word * odd power of the position in the line.
    place = np.arange(len(word)) - np.repeat(at[:-1], size)
    bound = kernel.mix(word ^ (place.astype(np.uint64) * _SALT[-1]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bound, dtype=np.uint64)])
    first, n = at[chosen], size[chosen]
    count = n.astype(np.uint64) * _SALT[-2]
    path = [kernel.mix(sums[first + n] - sums[first] + count)]
    owner = [chosen]
    long = np.flatnonzero(n >= LONG_WORDS)
    if len(long):
        f, m, c = first[long], n[long], count[long]
        whole, rest = sums[f + m] - sums[f], m - LEADING
        for k in range(PARTS):
            a, b = f + LEADING + rest * k // PARTS, f + LEADING + rest * (k + 1) // PARTS
            path.append(kernel.mix(whole - (sums[b] - sums[a]) + c + _SALT[k]))
            owner.append(chosen[long])
    line, path = np.concatenate(owner), np.concatenate(path)
    text = np.searchsorted(of_text, line, side="right") - 1
    return text, line - of_text[text], path


_FOUND = "hash long, doc_id long, row long, place int, open boolean"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _path_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = kernel.text_bytes(batch.column(2))
        for a, b in kernel.groups(offsets):
            text, line, path = template_paths(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays(
                [pa.array(path.view(np.int64)), pa.array(ids[a + text]), pa.array(rows[a + text]), pa.array(line.astype(np.int32)),
                 pa.array(np.ones(len(path), bool))], names=_NAMES)


def _earlier(found: DataFrame) -> DataFrame:
    """Hashes that an open place of some document shares with an earlier document, the first such, and how many places."""
    return (
        found.groupBy("hash").agg(F.min("doc_id").alias("owner"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("last"), F.count("*").alias("n"))
        .where("owner < last").select("hash", "owner", "n")
    )


_PLACES = "hash long, doc_id long, row long, place int, places array<int>"


def _marked(finder, known, lost: bool):
    """Places whose hash may be known: one row each, or, where very many places share it, one row for a text's.

    With `lost`, only open places, and none of the first document that has them: that
    document is known for very common hashes, and found by the join for others.
    """
    names = [c.split()[0] for c in _PLACES.split(", ")]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hot, owner = known.value
        for batch in finder(found):
            key = batch.column(0).to_numpy()
            bit = key.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            may = (words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
            if lost:
                may &= batch.column(4).to_numpy(zero_copy_only=False)
            yes = np.flatnonzero(may)
            at = np.minimum(np.searchsorted(hot, key[yes]), len(hot) - 1)
            common = hot[at] == key[yes] if len(hot) else np.zeros(len(yes), bool)
            rest = pa.array(yes[~common])
            yield pa.RecordBatch.from_arrays([*(c.take(rest) for c in batch.columns[:4]), pa.nulls(len(rest), pa.list_(pa.int32()))], names=names)
            ids, rows, place = (batch.column(k).to_numpy()[yes[common]] for k in (1, 2, 3))
            if lost and len(hot):
                theirs = ids != owner[at[common]]
                ids, rows, place = ids[theirs], rows[theirs], place[theirs]
            if not len(ids):
                continue
            order = np.lexsort((place, rows, ids))
            ids, rows, place = ids[order], rows[order], place[order]
            text = np.append(True, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]))
            first = text | np.append(True, place[1:] != place[:-1])
            ids, rows, place, text = ids[first], rows[first], place[first], np.flatnonzero(text[first])
            places = pa.ListArray.from_arrays(pa.array(np.append(text, len(place)).astype(np.int32)), pa.array(place))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(text), pa.int64()), pa.array(ids[text]), pa.array(rows[text]), pa.nulls(len(text), pa.int32()), places], names=names)

    return batches


def _known(shared: DataFrame):
    """What a task needs to tell most places apart without a shuffle, of bounded size at any number of hashes.

    A bit for the leading FILTER_BITS bits of every shared hash, and the shared hashes that
    stand at more than one in HOT_SHARE of all places, with their owners.
    """
    bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    filled = shared.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63 as int))")).alias("bits"))
    found = filled.toPandas()
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = shared.where(F.col("n") > max(HOT_LEAST, total // HOT_SHARE)).select("hash", "owner").orderBy("hash").toPandas()
    return shared.sparkSession.sparkContext.broadcast((words.view(np.uint64), hot["hash"].to_numpy(np.int64), hot["owner"].to_numpy(np.int64)))


def _counted(finder):
    """What counting needs of the finder's places: hash, doc_id, open."""
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in finder(found):
            yield batch.select([0, 1, 4])

    return batches


def _shared_places(docs: DataFrame, finder, label: str, name: str, lost: bool) -> DataFrame:
    """(doc_id, row, name): the finder's places whose hash an earlier document has too; with `lost`, those that go for it.

    Without a finder, `docs` holds the places. Places are found twice: once to count hashes, combined per task before the shuffle, and
    once to keep those that may be shared. Only these are written and joined by hash; places
    of very common hashes know their owner already, stay out of the join and are written as one list for each text.
    """
    counted = docs.mapInArrow(_counted(finder), "hash long, doc_id long, open boolean") if finder else docs
    shared = published(_earlier(counted), f"shared-{label}")
    places = published(docs.mapInArrow(_marked(finder or iter, _known(shared), lost), _PLACES), f"places-{label}")
    others = places.where("places is null").join(shared.select("hash", "owner"), "hash")
    if lost:
        others = others.where("doc_id <> owner")
    held = ["doc_id", "row", "place", "places"]
    return others.select(held).unionByName(places.where("places is not null").select(held)).groupBy("doc_id", "row").agg(
        F.array_union(F.collect_set("place"), F.flatten(F.collect_set("places"))).alias(name))


def _rows(docs: DataFrame, *columns) -> DataFrame:
    """doc_id, a number that tells rows of one doc_id apart by their text, text."""
    text = F.col("text").cast("string")
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("row"), text.alias("text"), *columns)


def recurring_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, row, lines): the numbers of the lines each row loses."""
    return published(_shared_places(_rows(docs), _path_batches, "lines", "lines", lost=True), "recurring-lines")


def _sequences(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """A function that hashes the n words from each given word on."""
    word = kernel.span_hash(kernel.prefix_sums(data), start, end)
    up, down = kernel._power_table(len(word) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * up[: len(word)], dtype=np.uint64)])
    return lambda first, n: kernel.mix((sums[first + n] - sums[first]) * down[first])


def _whole_windows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """For each group of texts: its first text, hash function, windows' first words and texts, which of
    all words begin a window that has lost nothing, and each text's first word."""
    data, offsets = kernel.text_bytes(batch.column(2))
    of_row, lost = pc.list_parent_indices(batch.column(3)).to_numpy(), pc.list_flatten(batch.column(3)).to_numpy()
    for a, b in kernel.groups(offsets):
        part, inner = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, at, of_text = lines(part, inner)
        first = np.searchsorted(start, inner)
        windows = np.maximum(np.diff(first) - RUN + 1, 0)
        begin = kernel.ragged(first[:-1], windows)
        if not len(begin):
            continue
        mine = (of_row >= a) & (of_row < b)
        gone = np.zeros(len(at) - 1, bool)
        gone[of_text[of_row[mine] - a] + lost[mine]] = True
        before = np.concatenate([[0], np.cumsum(np.repeat(gone, np.diff(at)))])
        whole = np.zeros(len(start), bool)
        whole[begin] = before[begin + RUN] == before[begin]
        yield a, _sequences(part, start, end), begin, np.repeat(np.arange(b - a), windows), whole, first


def _leftmost_least(values: np.ndarray, n: int) -> np.ndarray:
    """For each n values in a row, the place of the least of them, the first of equal ones; it never falls."""
    place, width = np.arange(len(values)), 1
    while width < n:
        step = min(width, n - width)
        place = np.where(values[step:] < values[:-step], place[step:], place[:-step])
        values = np.minimum(values[step:], values[:-step])
        width += step
    return place


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, text, lost lines) -> picked grams; `open` when a window that has lost nothing holds it."""
    for batch in batches:
        ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, hashed, begin, text, whole, first in _whole_windows(batch):
            gram = hashed(np.arange(len(whole) - GRAM + 1), GRAM)
            picked = _leftmost_least(gram, PICKS)[begin]
            nth = np.flatnonzero(np.append(True, picked[1:] != picked[:-1]))
            place, text = picked[nth], text[nth]
            count = np.concatenate([[0], np.cumsum(whole)])
            is_open = count[place + 1] > count[np.maximum(place - PICKS + 1, first[text])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[place].view(np.int64)), pa.array(ids[a + text]), pa.array(rows[a + text]),
                 pa.array((place - first[text]).astype(np.int32)), pa.array(is_open)], names=_NAMES)


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, text, lost lines, places of grams) -> every window that holds one of the grams."""
    for batch in batches:
        ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        of_row, near = pc.list_parent_indices(batch.column(4)).to_numpy(), pc.list_flatten(batch.column(4)).to_numpy()
        for a, hashed, begin, text, whole, first in _whole_windows(batch):
            mine = (of_row >= a) & (of_row < a + len(first) - 1)
            marked = np.zeros(len(whole) + 1, np.int64)
            at = first[of_row[mine] - a] + near[mine]
            np.add.at(marked, np.maximum(at - PICKS + 1, first[of_row[mine] - a]), 1)
            np.add.at(marked, np.minimum(at + 1, len(whole)), -1)
            chosen = np.cumsum(marked)[begin] > 0
            begin, text = begin[chosen], text[chosen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashed(begin, RUN).view(np.int64)), pa.array(ids[a + text]), pa.array(rows[a + text]),
                 pa.array((begin - first[text]).astype(np.int32)), pa.array(whole[begin])], names=_NAMES)


def recurring_runs(docs: DataFrame, lost: str) -> DataFrame:
    """docs(doc_id, text, lines lost) -> (doc_id, row, runs): first words of the windows each row loses as well."""
    rows = _rows(docs, F.col(lost))
    near = published(_shared_places(rows, _gram_batches, "grams", "near", lost=False), "near-runs")
    windows = published(rows.join(near, ["doc_id", "row"]).select(*rows.columns, "near").mapInArrow(_window_batches, _FOUND), "windows")
    return published(_shared_places(windows, None, "windows", "runs", lost=True), "recurring-runs")


def _marks(lists: pa.Array, a: int, b: int, base: np.ndarray) -> np.ndarray:
    """The numbers that rows a..b hold, each plus its row's base."""
    lists = lists.slice(a, b - a)
    return base[pc.list_parent_indices(lists).to_numpy()] + pc.list_flatten(lists).to_numpy()


def _rewritten(data: np.ndarray, offsets: np.ndarray, gone: pa.Array, runs: pa.Array, a: int) -> tuple[np.ndarray, ...]:
    """Texts a.. without their gone lines and runs: bytes, lengths, numbers of lines and of lines that lost words."""
    b = a + len(offsets) - 1
    start, end, at, of_text = lines(data, offsets)
    first = np.searchsorted(start, offsets)
    keep = np.ones(len(at) - 1, bool)
    keep[_marks(gone, a, b, of_text)] = False
    keep = np.repeat(keep, np.diff(at))
    cut = _marks(runs, a, b, first)
    keep[kernel.ragged(cut, np.full(len(cut), RUN))] = False
    lost = np.logical_or.reduceat(~keep, at[:-1]) if len(keep) else np.zeros(0, bool)
    # A text that loses words loses its bytes from the end of the last kept word before
    # them to the next kept word, but for one that becomes the newline or space between.
    drop = np.zeros(len(data) + 1, np.int64)
    words = np.repeat(np.arange(b - a), np.diff(first))
    gap = np.flatnonzero(~keep & np.append(True, keep[:-1] | (words[1:] != words[:-1])))
    if not len(gap):
        return data, np.diff(offsets), np.diff(of_text), np.zeros(b - a, np.int64)
    kept = np.flatnonzero(keep)
    text, next_kept = words[gap], np.append(kept, len(keep))[np.searchsorted(kept, gap)]
    leads, trails = gap == first[text], next_kept >= first[text + 1]
    begin = np.where(leads, offsets[text], end[np.maximum(gap, 1) - 1])
    until = np.where(trails, offsets[text + 1], start[np.minimum(next_kept, len(start) - 1)])
    np.add.at(drop, begin, 1)
    np.add.at(drop, until, -1)
    gone_bytes = np.cumsum(drop[:-1]) > 0
    inner = np.flatnonzero(~leads & ~trails)
    newlines = np.flatnonzero(data == 10)
    broken = np.searchsorted(newlines, begin[inner]) < np.searchsorted(newlines, until[inner])
    data = data.copy()
    data[begin[inner]] = np.where(broken, 10, 32)
    gone_bytes[begin[inner]] = False
    left = np.diff(np.concatenate([[0], np.cumsum(~gone_bytes)])[offsets])
    lost = np.concatenate([[0], np.cumsum(lost)])
    return data[~gone_bytes], left, np.diff(of_text), lost[of_text[1:]] - lost[of_text[:-1]]


def _rewrite(schema: T.StructType, text_at: int):
    names = [f.name for f in schema.fields]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            columns = list(batch.columns[:-2])
            texts, gone, runs = batch.column(text_at), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            data, offsets = kernel.text_bytes(texts)
            parts = [_rewritten(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], gone, runs, a) for a, b in kernel.groups(offsets)]
            out, size, count, lost = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in (np.uint8, np.int64, np.int64, np.int64))
            ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            valid = pa.array(texts.is_valid()).buffers()[1] if texts.null_count else None
            new = pa.Array.from_buffers(pa.large_string(), len(texts), [valid, pa.py_buffer(ends), pa.py_buffer(out)])
            columns[text_at] = new.cast(texts.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count), pa.array(lost)], names=names)

    return batches


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """docs with recurring lines and runs taken out of `text`, plus n_lines and n_dropped.

    n_dropped counts the lines that lost words: all of them, or those in a recurring run.
    Documents that lose nothing keep their text byte for byte, nulls included. Where
    lines go, the kept ones stay in order, apart by a newline if one stood between them,
    else by a space; a document may end up empty but never goes. A null doc_id neither
    owns nor loses a line. Rows that repeat a doc_id own their lines together and lose
    them each from its own text. An empty table gives no rows. Other columns are kept as
    they are, also when they are named like the new ones, which then win.
    """
    docs = docs.drop("n_lines", "n_dropped")
    key, row, gone_at, runs_at = (free_name(docs, n) for n in ("lost_by", "lost_row", "lost_lines", "lost_runs"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def with_lost(rows: DataFrame, found: DataFrame, name: str, to: str) -> DataFrame:
        found = found.select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col(name).alias(to))
        same = (rows["doc_id"].cast("long") == found[key]) & (F.xxhash64(rows["text"].cast("string")) == found[row])
        return rows.join(found, same, "left").drop(key, row)

    held = published(with_lost(docs, recurring_lines(docs), "lines", gone_at), "lined")
    runs = recurring_runs(held, gone_at)
    return with_lost(held, runs, "runs", runs_at).mapInArrow(_rewrite(schema, docs.columns.index("text")), schema)
