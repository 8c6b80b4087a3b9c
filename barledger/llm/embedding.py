"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so cosine >= 0.95 means a distance of
at most epsilon. Vectors are turned to principal directions (fitted on a bounded sample;
any orthonormal turn keeps distances), put into grid cells of that width and sorted by the
cells of the leading directions. The sorted sequence is cut into blocks, blocks into ever
larger intervals. Starting from the whole sequence with itself, pairs of intervals are
split into pairs of their parts, and a pair whose bounding boxes are farther apart than
epsilon in the turned directions is skipped with all that lies below it. Down to blocks
these are joins of bounding boxes; the data of a pair of blocks that is left go to one
task, which splits them further by the same rule and compares what remains by exact
cosines in double precision.

Equal vectors are one class before that. Classes count for each other with all their
members, so a vector that many rows share costs one comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barledger.llm.components import connected_components
from barledger.llm.tables import published

LEAST = 0.95
#: Rows the principal directions are fitted on at most.
SAMPLE = 20_000
#: Leading directions that order the sequence, and those that bound boxes.
ORDERED = 6
BOXED = 24
#: Vectors in a block that is sent to a task, and in the runs that a task splits it into.
BLOCK = 2048
RUN = 128
FAN_OUT = 8


def usable(embedding: str = "embedding"):
    """Not null, not empty, only finite components, and not all zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither vanish nor overflow.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def principal_directions(classes: DataFrame) -> np.ndarray:
    """Columns: orthonormal directions of one dimension, widest spread first."""
    total = classes.count()
    rows = classes
    if total > SAMPLE:
        rows = rows.where(F.shiftrightunsigned(F.xxhash64("rep"), 11) / float(1 << 53) < SAMPLE / total)
    sample = np.array([r[0] for r in rows.select("embedding").toLocalIterator()], np.float64)
    if not len(sample):
        return np.zeros((0, 0))
    _, turn = np.linalg.eigh(np.cov(_unit(sample).T) if len(sample) > 1 else np.eye(sample.shape[1]))
    return np.ascontiguousarray(turn[:, ::-1])


def _turner(turn: np.ndarray, epsilon: float):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if not batch.num_rows:
                continue
            turned = _unit(_matrix(batch.column(2))) @ turn
            cells = np.floor(turned[:, :ORDERED] / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([r.tobytes() for r in _matrix(batch.column(2)).astype("<f4")], pa.binary()),
                 pa.array(list(cells), pa.list_(pa.int32())),
                 pa.array(list(turned[:, :BOXED]), pa.list_(pa.float64()))],
                names=["rep", "copies", "raw", "cells", "box"])

    return batches


def _block_batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, shard, block = [], None, 0

    def cut() -> pa.RecordBatch:
        box = np.array([r[4] for r in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([block]),
             pa.array([[r[1] for r in rows]], pa.list_(pa.int64())), pa.array([[r[2] for r in rows]], pa.list_(pa.int64())),
             pa.array([b"".join(r[3] for r in rows)], pa.binary()),
             pa.array([list(box.min(axis=0))], pa.list_(pa.float64())), pa.array([list(box.max(axis=0))], pa.list_(pa.float64()))],
            names=["shard", "block", "reps", "copies", "raw", "low", "high"])

    for batch in found:
        for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if rows and (row[0] != shard or len(rows) == BLOCK):
                yield cut()
                rows, block = [], block + 1
            if row[0] != shard:
                shard, block = row[0], 0
            rows.append(row)
    if rows:
        yield cut()


def _boxes(blocks: DataFrame, level: int) -> DataFrame:
    """Bounding boxes of the intervals of FAN_OUT ** level blocks."""
    size = FAN_OUT**level
    edges = [F.array(*(f(F.get(c, F.lit(k))) for k in range(BOXED))).alias(c) for c, f in (("low", F.min), ("high", F.max))]
    return blocks.groupBy(F.floor(F.col("seq") / size).alias("interval")).agg(*edges)


def _near(pairs: DataFrame, epsilon: float) -> DataFrame:
    gaps = F.zip_with(
        F.zip_with("low_b", "high_a", lambda x, y: x - y), F.zip_with("low_a", "high_b", lambda x, y: x - y),
        lambda x, y: F.greatest(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0)), F.lit(0.0)))
    square = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)
    return pairs.where(square <= epsilon**2 * (1 + 1e-9) + 1e-12)


def block_pairs(blocks: DataFrame, n_blocks: int, epsilon: float) -> DataFrame:
    """Pairs (a <= b) of block numbers that are not provably farther apart than epsilon."""
    level = max(1, math.ceil(math.log(max(n_blocks, 2), FAN_OUT) - 1e-9))
    top = blocks.groupBy().agg(F.count("*").alias("n")).where("n > 0")
    pairs = top.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for below in range(level - 1, -1, -1):
        boxes = _boxes(blocks, below).withColumn("parent", F.floor(F.col("interval") / FAN_OUT))
        left = boxes.select(F.col("parent").alias("a"), F.col("interval").alias("child_a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
        right = boxes.select(F.col("parent").alias("b"), F.col("interval").alias("child_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
        pairs = _near(pairs.join(left, "a").join(right, "b").where("child_a <= child_b"), epsilon).select(
            F.col("child_a").alias("a"), F.col("child_b").alias("b"))
    return pairs


def _forest(one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the edges (one, two)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[one], root[two])
        new = root.copy()
        np.minimum.at(new, root[one], least)
        np.minimum.at(new, root[two], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _runs(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, low and high corner of every run of a block."""
    begin = np.arange(0, len(turned), RUN)
    return begin, np.minimum.reduceat(turned, begin), np.maximum.reduceat(turned, begin)


def block_links(one: np.ndarray, two: np.ndarray, turn: np.ndarray, least: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of unit vectors with a cosine of at least `least`."""
    begin_a, low_a, high_a = _runs(one @ turn)
    begin_b, low_b, high_b = _runs(two @ turn)
    rows, columns = [], []
    place = np.arange(len(two))
    for k, begin in enumerate(begin_a):
        gap = np.maximum(np.maximum(low_b - high_a[k], low_a[k] - high_b), 0)
        near = (gap * gap).sum(axis=1) <= epsilon**2 * (1 + 1e-9) + 1e-12
        if near.any():
            chosen = place[np.repeat(near, RUN)[: len(two)]]
            i, j = np.nonzero(one[begin : begin + RUN] @ two[chosen].T >= least)
            rows.append(i + begin)
            columns.append(chosen[j])
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (none, none)


def _joiner(turn: np.ndarray, least: float, epsilon: float):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in batch.to_pylist():
                left, right = np.array(row["reps_a"], np.int64), np.array(row["reps_b"], np.int64)
                one = _unit(np.frombuffer(row["raw_a"], "<f4").reshape(len(left), -1).astype(float))
                two = _unit(np.frombuffer(row["raw_b"], "<f4").reshape(len(right), -1).astype(float))
                i, j = block_links(one, two, turn, least, epsilon)
                same = row["a"] == row["b"]
                if same:
                    i, j = i[i != j], j[i != j]
                if not len(i):
                    continue
                # Nodes are numbered by rising id, so that the smallest number is the smallest id.
                ids = np.unique(np.concatenate([left, right]))
                a, b = np.searchsorted(ids, left), np.searchsorted(ids, right)
                n = np.bincount(a[i], np.array(row["copies_b"], float)[j], len(ids))
                if not same:
                    n += np.bincount(b[j], np.array(row["copies_a"], float)[i], len(ids))
                root = _forest(a[i], b[j], len(ids))
                linked = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[linked]), pa.array(n[linked].astype(np.int64)), pa.array(ids[root[linked]])], names=["rep", "links", "root"])

    return batches


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept, one row per input row.

    Two rows are linked when the cosine of their vectors, in double precision, is at least
    `least`. Null, empty or all-zero vectors and those with null, NaN or infinite
    components have no links. A null vec_id has no links and counts for nobody; its
    component_id is null and it is kept. Vectors of different lengths are compared within
    their length only. Rows that repeat a vec_id count as one vector each. Other columns,
    labels among them, are ignored; an empty table gives no rows.
    """
    epsilon = math.sqrt(2 - 2 * least)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"))
    good = rows.where(usable() & F.col("vec_id").isNotNull())
    classes = published(
        good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    counted, edges = None, None
    for length in sorted(r[0] for r in classes.select(F.size("embedding")).distinct().collect()):
        links, forest = _linked(classes.where(F.size("embedding") == length), least, epsilon)
        counted = links if counted is None else counted.unionByName(links)
        edges = forest if edges is None else edges.unionByName(forest)
    own = classes.select("embedding", "rep", "copies")
    if counted is not None:
        own = own.join(counted, "rep", "left").join(connected_components(edges).withColumnRenamed("node", "rep"), "rep", "left")
    else:
        own = own.withColumn("links", F.lit(0)).withColumn("component", F.col("rep"))
    own = own.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component"))
    linked = usable() & F.col("vec_id").isNotNull()
    joined = rows.withColumn("key", F.when(linked, F.col("embedding"))).drop("embedding").join(
        own.withColumnRenamed("embedding", "key"), "key", "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _linked(classes: DataFrame, least: float, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """Links of every class with others, counted by rows, and edges that span its component."""
    turn = principal_directions(classes)
    dims = len(turn)
    turned = classes.select("rep", "copies", "embedding").mapInArrow(
        _turner(turn, epsilon), "rep long, copies long, raw binary, cells array<int>, box array<double>")
    keys = [F.col("cells")[k] for k in range(min(ORDERED, dims))] + [F.col("rep")]
    blocks = published(
        turned.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .select(F.spark_partition_id().alias("shard"), "rep", "copies", "raw", "box")
        .mapInArrow(_block_batches, "shard int, block long, reps array<bigint>, copies array<bigint>, raw binary, low array<double>, high array<double>"),
        "vector-blocks",
    )
    # One row per shard: few, however many vectors.
    sizes = blocks.groupBy("shard").agg(F.count("*").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    numbered = blocks.join(before, "shard").withColumn("seq", F.col("before") + F.col("block"))
    bounds = published(numbered.select("seq", "shard", "block", "low", "high"), "vector-boxes")
    pairs = published(block_pairs(bounds, bounds.count(), epsilon), "vector-block-pairs")
    data = bounds.select("seq", "shard", "block").join(blocks.select("shard", "block", "reps", "copies", "raw"), ["shard", "block"])
    sides = [data.select(*(F.col(c).alias(f"{c}_{side}") for c in ("reps", "copies", "raw")), F.col("seq").alias(side)) for side in "ab"]
    found = published(
        pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_joiner(turn, least, epsilon), "rep long, links long, root long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    return links, found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
