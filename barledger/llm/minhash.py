"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact sets.

1. One pass over whole texts gives each document's shingle count, a 128-bit key of its
   shingle set and a MinHash signature. Equal sets become one class, so copies, however
   many, are never paired.
2. Bands of the signature put classes into buckets. Every member of a bucket is paired
   with the bucket's smallest class only (a star), not with every other member.
3. A pair's signatures are compared batch by batch. After each batch the posterior
   probability that the similarity reaches the threshold is bounded; below `miss` the
   pair is dropped. Survivors are verified on their full shingle sets.
4. Members that a star leaves outside their bucket's main component are then held against
   all members of other components. Prefix filtering finds these pairs exactly: with all
   shingles ordered from rare to common, linked sets share one of the first quarter of
   each. A text whose own changes fill that quarter therefore meets nobody. Nothing is
   capped.

The probability that a link at exactly 0.75 shares none of the 32 bands of four values
is (1 - 0.75^4)^32, five in a million; the miss probability of the pruning comes on top.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barledger.llm import kernel
from barledger.llm.components import connected_components
from barledger.llm.tables import published

WORDS = 5
PERCENT = 75
HASHES = 128
BAND_ROWS = 4
BATCH = 32
MISS = 1e-7

_seed = np.random.Generator(np.random.PCG64(20240601))
_MUL = _seed.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _seed.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(1, 64)]


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, and where each text's begin.

    Letters A-Z count as a-z. A text with fewer words than `width` has its whole word
    sequence as its one shingle; a text without words has none.
    """
    data = kernel.LOWER[data]
    start, end, first = kernel.words(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = kernel.span_hash(kernel.prefix_sums(data), start, end)
    count = np.diff(first)
    many = np.maximum(count - width + 1, 0)
    at = kernel.ragged(first[:-1], many)
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        value += word[at + k] * _STEP[k]
    text = np.repeat(np.arange(len(count)), many)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            own[has] += word[first[short[has]] + k] * _STEP[k]
        own += _STEP[width] * count[short].astype(np.uint64)
        value, text = np.concatenate([value, own]), np.concatenate([text, short])
    value = kernel.mix(value)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[fresh], text[fresh]
    return value, np.searchsorted(text, np.arange(len(count) + 1))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_SIGNATURES = "doc_id long, row long, n_shingles long, set_a long, set_b long, sig binary"


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = kernel.text_bytes(batch.column(2))
        n = batch.num_rows
        size, set_a, set_b = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        sig = np.zeros((n, HASHES), np.uint32)
        for a, b in kernel.groups(offsets):
            value, first = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            size[a:b] = np.diff(first)
            has = np.flatnonzero(size[a:b])
            if not len(has):
                continue
            at = first[has]
            set_a[a + has] = np.add.reduceat(kernel.mix(value ^ _STEP[0]), at)
            set_b[a + has] = np.add.reduceat(kernel.mix(value ^ _STEP[1]), at)
            for j in range(HASHES):
                sig[a + has, j] = np.minimum.reduceat((value * _MUL[j] + _ADD[j]) >> np.uint64(32), at)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size), pa.array(_signed(set_a)), pa.array(_signed(set_b)),
             pa.array([row.tobytes() for row in sig], pa.binary())],
            names=["doc_id", "row", "n_shingles", "set_a", "set_b", "sig"],
        )


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, a number that tells rows of one doc_id apart by their text, text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("row"), text.alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, row, n_shingles, set key (set_a, set_b), MinHash signature."""
    return _rows(docs).mapInArrow(_signature_batches, _SIGNATURES)


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = HASHES // BAND_ROWS
    for batch in batches:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, bands, BAND_ROWS).astype(np.uint64)
        key = np.arange(bands, dtype=np.uint64)[None, :] * _STEP[5]
        for k in range(BAND_ROWS):
            key = kernel.mix(key ^ (sig[:, :, k] + _STEP[k]))
        rep = np.repeat(batch.column(0).to_numpy(), bands)
        yield pa.RecordBatch.from_arrays([pa.array(_signed(np.ascontiguousarray(key)).reshape(-1)), pa.array(rep)], names=["key", "rep"])


@lru_cache
def least_matches(percent: int = PERCENT, miss: float = MISS) -> tuple[int, ...]:
    """For each batch end n: fewest equal values m at which the pair stays.

    With a uniform prior the posterior after m of n equal values is Beta(m+1, n-m+1), and
    P(similarity >= t) is the probability that a Binomial(n+1, t) is at most m.
    """
    t = percent / 100
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _prune_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least = least_matches()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        left = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(n, HASHES)
        right = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(n, HASHES)
        alive, same = np.arange(n), np.zeros(n, np.int64)
        for k, need in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            same[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
            alive = alive[same[alive] >= need]
        keep = pa.array(alive)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(keep), batch.column(1).take(keep), pa.array(same[alive])], names=["a", "b", "same"]
        )


def plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs(a, b) that the sequential comparison of signatures doesn't rule out, with equal values."""
    sig = reps.select("rep", "sig")
    return (
        pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        .select("a", "b", "sig_a", "sig_b").mapInArrow(_prune_batches, "a long, b long, same long")
    )


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))

    def members(text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return shingles(data, np.array([0, len(data)]))[0]

    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            left, right = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
            if right != last[0]:
                last = (right, members(right))
            one, two = members(left), last[1]
            shared = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * shared >= PERCENT * (len(one) + len(two) - shared):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b) whose full shingle sets reach the similarity; texts(rep, text) has both ends."""
    return (
        pairs.select("a", "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("left")), "a")
        .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("right")), "b")
        .select("a", "b", "left", "right").mapInArrow(_verify_batches, "a long, b long")
    )


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = kernel.text_bytes(batch.column(1))
        for a, b in kernel.groups(offsets):
            value, first = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            size = np.diff(first)
            rep = np.repeat(batch.column(0).to_numpy()[a:b], size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(value)), pa.array(rep), pa.array(np.repeat(size, size))], names=["shingle", "rep", "size"])


def prefix_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a > b) of an outside member and a member of another component that can be linked.

    members(rep, component, outside) are unique; texts(rep, text) has them all. Two sets
    of similarity t or more share one of the first n - ceil(t n) + 1 shingles of each in any
    order that is the same for all; here rarest first, by number of members. They have at
    least t / (1 + t) * (n + m) shingles in common, and after a first common one at the
    i-th and j-th place at most min(n - i, m - j) more.
    """
    held = texts.join(members, "rep", "left_semi").select("rep", "text").mapInArrow(
        _shingle_batches, "shingle long, rep long, size long")
    held = published(held, "shingles")
    common = held.groupBy("shingle").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("n", "shingle"))
    prefix = (
        held.join(common, "shingle").withColumn("nth", nth)
        .where(F.col("nth") <= F.col("size") - F.ceil(F.col("size") * PERCENT / F.lit(100)) + 1).where("n > 1")
        .join(members, "rep").select("shingle", "rep", "component", "outside", "size", "nth")
    )
    prefix = published(prefix, "prefixes")
    x, y = (
        rows.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("rep", "component", "size", "nth")))
        for rows, side in ((prefix.where("outside"), "x"), (prefix, "y"))
    )
    most = F.least(F.col("size_x") - F.col("nth_x"), F.col("size_y") - F.col("nth_y")) + 1
    enough = most * (100 + PERCENT) >= (F.col("size_x") + F.col("size_y")) * PERCENT
    return (
        x.join(y, "shingle").where((F.col("component_x") != F.col("component_y")) & enough)
        .select(F.col("rep_x").alias("x"), F.col("rep_y").alias("y"))
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    )


def _called(classes: DataFrame) -> DataFrame:
    """classes(doc_id, set_a, set_b, ...) with `rep`, a number of each class's own.

    That is its smallest document's id, unless the same document, by rows of other texts,
    is the smallest of several classes: then a 64-bit hash.
    """
    several = published(classes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("several")), "several")
    rep = F.when(F.col("several"), F.xxhash64("doc_id", "set_a", "set_b")).otherwise(F.col("doc_id"))
    return classes.join(several, "doc_id", "left").withColumn("rep", rep).drop("several")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components so far."""
    for end in ("a", "b"):
        pairs = pairs.join(comps.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    apart = F.coalesce("ca", "a") != F.coalesce("cb", "b")
    return pairs.where(apart).drop("ca", "cb")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept, row, one row per input row.

    Texts are linked when 100 * |A and B| >= 75 * |A or B| on sets of distinct five-word
    shingles. A null or empty text, or one without words, has no shingles and is linked
    with nothing. A null doc_id is linked with nothing and its component_id is null, kept
    is true. Rows that repeat an id are compared each by its own text, and `row`, the
    text's hash, tells them apart; those with the same text come back with the same answer.
    Other columns are ignored; an empty table gives no rows.
    """
    sigs = published(signatures(docs), "signatures")
    reps = _called(published(
        sigs.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b")
        .agg(F.min(F.struct("doc_id", "row")).alias("least"), F.first("sig").alias("sig"))
        .select("set_a", "set_b", "least.doc_id", "least.row", "sig"),
        "classes",
    ))
    bands = reps.select("rep", "sig").mapInArrow(_band_batches, "key long, rep long")
    shared = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    buckets = published(bands.join(shared.select("key", "pivot"), "key"), "buckets")

    star = buckets.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = published(plausible(star, reps), "stars")
    # Documents in a shared bucket are all that can need their texts again.
    named = reps.select("rep", "doc_id", "row").join(buckets.select("rep").distinct(), "rep", "left_semi")
    texts = published(
        _rows(docs).join(named, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("rep", "text"), "texts")
    # First the most alike pivot of each class, then what still lies apart.
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("same", -F.col("b"))).alias("b"))
    links = published(verified(best, texts), "links")
    comps = connected_components(links)
    rest = _apart(stars.join(best, ["a", "b"], "left_anti"), comps)
    links = published(links.unionByName(verified(rest, texts)), "links")
    comps = connected_components(links)

    # For what stars leave apart: members outside a bucket's main component against all
    # members of mixed buckets that lie in another component.
    placed = buckets.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    mixed = published(placed.join(mixed.select("key", "main"), "key"), "mixed")
    crossing = prefix_pairs(
        mixed.groupBy("rep").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("outside")),
        texts,
    )
    more = verified(published(plausible(crossing.join(star, ["a", "b"], "left_anti"), reps), "crossing"), texts)
    comps = connected_components(links.unionByName(more))

    # A component is named by its smallest document, whatever its classes are called.
    renamed = reps.where("rep <> doc_id").select(F.col("rep").alias("node"), "doc_id")
    least = comps.join(renamed, "node", "left").groupBy("component").agg(F.min(F.coalesce("doc_id", "node")).alias("least"))
    comps = comps.join(least, "component").select(F.col("node").alias("rep"), "least")
    classes = reps.select("set_a", "set_b", "rep", "doc_id").join(comps, "rep", "left").select(
        "set_a", "set_b", F.coalesce("least", "doc_id").alias("component"))
    linked = F.col("n_shingles") > 0
    component = F.when(linked & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return (
        sigs.select("doc_id", "row", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
        .select("doc_id", "row", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .select("doc_id", "n_shingles", "component_id", "kept", "row")
    )


def gone_rows(found: DataFrame) -> DataFrame:
    """near_duplicates' answer -> gone_id of all that aren't kept, and gone_row, the hash of the text, where the id has several.

    A null gone_row stands for every row of the id: few ids have several texts, and the list stays short.
    """
    several = found.groupBy("doc_id").agg((F.min("row") < F.max("row")).alias("several")).where("several")
    gone = found.where("not kept").join(several, "doc_id", "left")
    return gone.select(F.col("doc_id").alias("gone_id"), F.when(F.col("several"), F.col("row")).alias("gone_row")).distinct()


def same_row(docs: DataFrame, gone: DataFrame) -> Column:
    """Whether a row of docs is one that gone_id and gone_row name."""
    same_text = gone["gone_row"].isNull() | (F.xxhash64(docs["text"].cast("string")) == gone["gone_row"])
    return (docs["doc_id"] == gone["gone_id"]) & same_text


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that near-duplicate a document with a smaller id."""
    gone = gone_rows(near_duplicates(docs))
    return docs.join(gone, same_row(docs, gone), "left_anti")
