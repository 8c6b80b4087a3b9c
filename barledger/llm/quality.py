"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good, at most MAX_POSITIVE of them;
unlabelled text is the whole corpus but its held-out part, with labels ignored. No
negative label is ever read. One pass over whole texts gives numeric features; on them

* the class prior is estimated with the best-bin estimator: of all score thresholds of a
  positive-versus-unlabelled model, the least ratio of unlabelled to positive mass above;
* an additive model minimises the non-negative unbiased risk under the sigmoid loss,
  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) by full-batch Adam steps.

Bin edges, prior and every gradient are aggregates over all unlabelled rows, summed by
Spark as whole numbers: no row is left out, and the order of summing changes nothing.
Scoring reads only the features of each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barledger.llm import kernel
from barledger.llm.minhash import shingles
from barledger.llm.tables import published

#: Bound of the labelled sample; beyond it rows are chosen by a hash of id and features.
MAX_POSITIVE = 6_000
THRESHOLD = 0.3
#: Bin edges of every feature, as quantiles of the corpus and of the positives, which may be
#: rare in it: close together at both ends.
QUANTILES = (0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.2, 0.4, 0.6, 0.8, 0.9, 0.93, 0.96, 0.98, 0.99, 0.995, 0.998)
BINS = 2 * len(QUANTILES)
#: Steps of a fit, each one pass over the cells, and their length: for the prior, for the model.
PRIOR_STEPS, PRIOR_RATE = 20, 0.4
STEPS, RATE = 60, 0.3
#: Parts of one in which scores and slopes are summed.
UNIT = float(1 << 24)
FEATURES = (
    "log_words", "word_bytes", "upper", "digit", "mark", "pipe", "mark_ended",
    "repeats_last", "distinct_words", "distinct_fives", "line_words",
)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers per text; a text without words has all zeros."""
    start, end, first = kernel.words(data, offsets)
    n_words = np.diff(first)
    n = np.maximum(n_words, 1)

    def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[bounds[1:]] - total[bounds[:-1]]

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    mark = (data > 32) & (data < 127) & ~upper & ~lower & ~digit
    solid = np.maximum(per_text(kernel.solid(data), offsets), 1)
    cased = np.maximum(per_text(upper | lower, offsets), 1)
    word = kernel.span_hash(kernel.prefix_sums(data), start, end) if len(start) else np.zeros(0, np.uint64)
    again = np.zeros(len(start), bool)
    again[1:] = word[1:] == word[:-1]
    begins = first[:-1][n_words > 0]
    again[begins] = False
    text = np.repeat(np.arange(len(n_words)), n_words)
    order = np.lexsort((word, text))
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (text[order][1:] != text[order][:-1])
    fives = np.diff(shingles(data, offsets)[1])
    out = np.stack([
        np.log1p(n_words), solid / n, per_text(upper, offsets) / cased, per_text(digit, offsets) / solid,
        per_text(mark, offsets) / solid, per_text(data == 124, offsets) / solid,
        per_text(mark[end - 1] if len(end) else np.zeros(0, bool), first) / n, per_text(again, first) / n,
        np.bincount(text[order][fresh], minlength=len(n_words)) / n, fives / np.maximum(n_words - 4, 1),
        n / (1 + per_text(data == 10, offsets)),
    ], axis=1)
    out[n_words == 0] = 0
    return out


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = kernel.text_bytes(batch.column(1))
        out = np.zeros((batch.num_rows, len(FEATURES)))
        for a, b in kernel.groups(offsets):
            out[a:b] = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(out[:, k]) for k in range(len(FEATURES)))], names=["doc_id", *FEATURES])


def text_features(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id and the numeric features of the whole text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _feature_batches, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


class Model:
    """Additive logistic model: each feature's quantile bin has a weight."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray | None = None):
        self.edges = edges
        self.weights = np.zeros(len(edges) * (BINS + 1) + 1) if weights is None else weights

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([
            np.searchsorted(self.edges[k], x[:, k], side="right") + k * (BINS + 1) for k in range(x.shape[1])
        ], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return _margin(self.bins(x), self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _margin(at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[at].sum(axis=1) + weights[-1]


#: What is summed over rows: from their bins and how often each row stands, whole numbers.
Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: The sum of a measure over all unlabelled rows, or over one half (0 or 1) of them.
Sums = Callable[[Measure, int | None], np.ndarray]


def _slopes(weights: np.ndarray, sigmoid_loss: bool) -> Measure:
    """Gradient of the loss of calling rows negative, then the sum of scores and the number of rows.

    Each row's part is rounded to 1 / UNIT, so sums are exact in any order and a result
    depends neither on partitions nor on what was computed twice.
    """
    def measure(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        score = _sigmoid(_margin(at, weights))
        slope = np.rint((score * (1 - score) if sigmoid_loss else score) * UNIT) * n
        out = np.bincount(at.ravel(), np.repeat(slope, at.shape[1]), len(weights) + 2)
        out[-3:] = slope.sum(), (np.rint(score * UNIT) * n).sum(), n.sum()
        return out

    return measure


def _reaching(weights: np.ndarray, thresholds: np.ndarray) -> Measure:
    """How many rows have a margin of at least the first 0, 1, 2, ... of the ascending thresholds."""
    def measure(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        reached = np.searchsorted(thresholds, _margin(at, weights), side="right")
        return np.bincount(reached, n, len(thresholds) + 1)[::-1].cumsum()[::-1]

    return measure


def _fit(at_p: np.ndarray, edges: np.ndarray, sums: Sums, half: int | None, prior: float | None) -> Model:
    """Minimise the non-negative risk over positives and all unlabelled rows of the half.

    Without a prior, tell positive from unlabelled. Every step sums over all the rows.
    """
    model = Model(edges)
    size = len(model.weights)
    first, second = np.zeros(size), np.zeros(size)
    count = np.ones(len(at_p))

    def means(total: np.ndarray) -> tuple[np.ndarray, float, float]:
        return total[:-2] / UNIT / total[-1], total[-2] / UNIT / total[-1], total[-1]

    bounded = prior is not None
    steps, rate = (STEPS, RATE) if bounded else (PRIOR_STEPS, PRIOR_RATE)
    for step in range(1, steps + 1):
        w = model.weights
        measure = _slopes(w, bounded)
        pull_p, s_p, _ = means(measure(at_p, count))
        pull_u, s_u, rows = means(sums(measure, half))
        if not bounded:
            s = _sigmoid(_margin(at_p, w)) - 1
            grad = np.bincount(at_p.ravel(), np.repeat(s, at_p.shape[1]), size) / len(at_p) + pull_u
            grad[-1] = s.mean() + pull_u[-1]
        else:
            # Sigmoid loss: 1 - s for a positive, s for a negative. It is bounded, so sampling
            # noise in how sure the positives are doesn't use up the negative part.
            rest = pull_u - prior * pull_p
            grad = rest - prior * pull_p if s_u - prior * s_p >= 0 else -rest
        # A bin that a single unlabelled text falls into can't earn much of a weight.
        grad = grad + 0.5 / rows * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        model.weights = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return model


def _prior(positive: np.ndarray, edges: np.ndarray, sums: Sums) -> float:
    """Best-bin estimate of the share of positives in unlabelled text, on held-back halves.

    The lower end of a 95 % interval is taken: a prior that is too high makes the negative
    part of the risk vanish while low-quality text still scores like the rest.
    """
    at_p = Model(edges).bins(positive)
    held_p = at_p[1::2]
    if not len(held_p) or not sums(_slopes(Model(edges).weights, False), 0)[-1]:
        return 0.5
    model = _fit(at_p[::2], edges, sums, 0, None)
    s_p = np.sort(_margin(held_p, model.weights))
    reaching = sums(_reaching(model.weights, s_p), 1)
    if not reaching[0]:
        return 0.5
    above_p = 1 - np.searchsorted(s_p, s_p, side="left") / len(s_p)
    above_u = (reaching[1:] / reaching[0])[np.searchsorted(s_p, s_p, side="left")]
    slack = np.sqrt(np.log(40) / (2 * reaching[0])) + np.sqrt(np.log(40) / (2 * len(s_p)))
    best = int(np.argmin((above_u + slack) / above_p))
    share = above_u[best] - 1.96 * np.sqrt(above_u[best] * (1 - above_u[best]) / reaching[0])
    return float(np.clip(share / above_p[best], 0.01, 0.99))


def _array_sums(at: np.ndarray) -> Sums:
    """Sums over rows in an array; every second one is of half 1."""
    def sums(measure: Measure, half: int | None) -> np.ndarray:
        part = at if half is None else at[half::2]
        return measure(part, np.ones(len(part)))

    return sums


def _edges(positive: np.ndarray, of_corpus: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate([of_corpus, np.quantile(positive, QUANTILES, axis=0).T], axis=1), axis=1)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior for features held in arrays."""
    edges = _edges(positive, np.quantile(unlabelled, QUANTILES, axis=0).T)
    return _prior(positive, edges, _array_sums(Model(edges).bins(unlabelled)))


def train(positive: np.ndarray, edges: np.ndarray, sums: Sums) -> Model:
    return _fit(Model(edges).bins(positive), edges, sums, None, _prior(positive, edges, sums))


def _cell_batches(edges: np.ndarray):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            x = np.stack([batch.column(k + 1).to_numpy() for k in range(len(FEATURES))], axis=1)
            cell = Model(edges).bins(x) - np.arange(len(FEATURES)) * (BINS + 1)
            flat = cell.astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([flat[i : i + len(FEATURES)] for i in range(0, len(flat), len(FEATURES))], pa.binary())],
                names=["half", "cell"])

    return batches


def _measured(measure: Measure):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in found:
            cell = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, len(FEATURES))
            part = measure(cell + np.arange(len(FEATURES)) * (BINS + 1), batch.column(1).to_numpy().astype(float))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int64)], pa.list_(pa.int64()))], names=["total"])

    return batches


def corpus_sums(rows: DataFrame, edges: np.ndarray) -> Sums:
    """Sums over all rows of a table of features.

    Rows become cells, a byte a feature; equal cells are counted once with their number,
    and that table is what every sum reads. A task answers with one row of fixed length.
    """
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    cells = rows.select(half.alias("half"), *FEATURES).mapInArrow(_cell_batches(edges), "half int, cell binary")
    counted = published(cells.groupBy("half", "cell").agg(F.count("*").alias("n")), "cells")

    def sums(measure: Measure, half: int | None) -> np.ndarray:
        part = counted if half is None else counted.where(F.col("half") == half)
        found = part.select("cell", "n").mapInArrow(_measured(measure), "total array<long>").collect()
        empty = measure(np.zeros((0, len(FEATURES)), np.int64), np.zeros(0))
        return sum((np.array(r.total, float) for r in found), empty)

    return sums


def corpus_quantiles(rows: DataFrame) -> np.ndarray:
    """Quantiles of every feature over all rows, to one rank in 10,000."""
    found = rows.agg(*(F.percentile_approx(f, list(QUANTILES), 10_000).alias(f) for f in FEATURES)).first()
    return np.array([found[f] for f in FEATURES], float)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Features of at most `most` rows, those with the smallest hashes of id and features."""
    lot = F.xxhash64("doc_id", *FEATURES, F.lit("sample"))
    found = rows.orderBy(lot, "doc_id", *FEATURES).limit(most).select("doc_id", *FEATURES).toPandas()
    return found.sort_values(["doc_id", *FEATURES])[list(FEATURES)].to_numpy(float)


def _scorer(model: Model | None):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            x = np.stack([batch.column(k + 1).to_numpy() for k in range(len(FEATURES))], axis=1)
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return batches


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.3), one row per document row.

    Labels are used only where crc32 of the id's text mod 5 is not 0, and only quality 1;
    rows with a null id or quality teach nothing, repeated label rows count once. A null
    or empty text has zero features and is scored like any other; a null doc_id is not
    held out. Without any trusted positive every score is 0.5. Other columns, lang and
    source among them, are ignored; an empty table gives no rows.
    """
    rows = published(text_features(docs), "features")
    trusted = (
        labels.select(F.col("doc_id").cast("long"), "quality").where("doc_id is not null and quality = 1")
        .where(~held_out()).select("doc_id").distinct()
    )
    positive = _sample(rows.join(trusted, "doc_id", "left_semi"), MAX_POSITIVE)
    unlabelled = rows.where(F.col("doc_id").isNotNull() & ~held_out())
    model = None
    if len(positive) and not unlabelled.isEmpty():
        edges = _edges(positive, corpus_quantiles(unlabelled))
        model = train(positive, edges, corpus_sums(unlabelled, edges))
    return rows.mapInArrow(_scorer(model), "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted to be of low quality; a null doc_id stays."""
    bad = score_quality(docs, labels).where("predicted = 0").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["bad_id"], "left_anti")
