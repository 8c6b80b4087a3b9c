"""Periodic runs of words: Lyndon roots extended both ways by suffix-tree LCE.

A run is a stretch of consecutive words with smallest period q and at least
max(LEAST_WORDS, LEAST_TURNS * q) words that no neighbouring word extends.

1. Every word of a run of four turns stands four times in it. A word that stands fewer
   times in its stretch therefore lies in no run and parts the stretch; this is repeated
   while it helps. It works on word hashes, and can only keep too much.
2. The stretches that are left are joined, each pair by a symbol of its own, to one string
   over exact words. Ukkonen's algorithm builds the suffix tree of the string and that of
   its reversal.
3. An Euler tour gives the order of the leaves and, between neighbouring leaves, the
   shallowest node the tour meets. A sparse table over those answers "how far do two
   suffixes agree" in constant time; on the reversed tree, how far two prefixes do.
4. The longest Lyndon word at i ends where the next smaller suffix begins. Under the order
   of the symbols and under its reverse these words hold a root of every run; each is
   extended to both sides with the two trees.

A task works on one Arrow batch, in groups of about a megabyte of text; documents are never
cut. Memory is bounded by the longest stretch that is left of one document, at about 0.6 KB
a word of it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barledger.llm import kernel

LEAST_WORDS = 6
LEAST_TURNS = 4
#: Words of stretches that share a tree; a longer stretch has one alone.
TREE_WORDS = 1 << 15


# ---------------------------------------------------------------- suffix tree


def suffix_tree(text: list[int], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, first symbol, length) of the edge into every node but the root, by Ukkonen.

    `text` ends with a symbol that stands nowhere else, so every suffix has a leaf; a leaf's
    edge length is that to the end of the text. Nodes are numbered from 1, the root is 0.
    """
    n = len(text)
    start, end, link = [0], [0], [0]  # of the edge into a node; leaves end at n
    child: dict[int, int] = {}
    node, edge, depth, waiting = 0, 0, 0, 0
    for i, symbol in enumerate(text):
        waiting += 1
        last = 0
        while waiting:
            if not depth:
                edge = i
            key = node * symbols + text[edge]
            down = child.get(key)
            if down is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                last = node
            else:
                begin = start[down]
                span = end[down] - begin
                if span > i - begin:
                    span = i - begin + 1
                if depth >= span:
                    node = down
                    depth -= span
                    edge += span
                    continue
                if text[begin + depth] == symbol:
                    if last and node:
                        link[last] = node
                    depth += 1
                    break
                split = len(start)
                child[key] = split
                start += (begin, i)
                end += (begin + depth, n)
                link += (0, 0)
                start[down] = begin + depth
                child[split * symbols + text[begin + depth]] = down
                child[split * symbols + symbol] = split + 1
                if last:
                    link[last] = split
                last = split
            waiting -= 1
            if not node and depth:
                depth -= 1
                edge = i - waiting + 1
            elif node:
                node = link[node]
    key = np.fromiter(child.keys(), np.int64, len(child))
    into = np.fromiter(child.values(), np.int64, len(child))
    parent, first = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    parent[into], first[into] = key // symbols, key % symbols
    return parent, first, np.array(end, np.int64) - np.array(start, np.int64)


def _children(parent: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children of all nodes in rising order of symbol: (first child, end, children)."""
    nodes = np.arange(1, len(parent))
    children = nodes[np.lexsort((first[1:], parent[1:]))]
    bounds = np.searchsorted(parent[children], np.arange(len(parent) + 1))
    return bounds[:-1], bounds[1:], children


class Lce:
    """How many symbols the suffixes at two places of a text have in common."""

    def __init__(self, text: list[int], symbols: int):
        n = len(text)
        parent, first, length = suffix_tree(text, symbols)
        low, high, children = _children(parent, first)
        low, high, children, span = low.tolist(), high.tolist(), children.tolist(), length.tolist()
        # The Euler tour, kept at its leaves: between two of them only the shallowest visit counts.
        leaves, between = [], []
        shallow, stack = 0, [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if node < 0:  # back at an inner node, before its next child
                if depth < shallow:
                    shallow = depth
                continue
            depth += span[node]
            if low[node] == high[node]:
                leaves.append(n - depth)
                between.append(shallow)
                shallow = depth
                continue
            for at in range(high[node] - 1, low[node] - 1, -1):
                stack.append((children[at], depth))
                stack.append((-1, depth))
        self.place = np.empty(n, np.int64)  # of each suffix among all in rising order
        self.place[leaves] = np.arange(n)
        table = [np.array(between, np.int32)]
        while 2 << (len(table) - 1) <= n:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.table = table

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places a != b."""
        x, y = self.place[a], self.place[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For every place the next one to the right with a smaller rank; the length where there is none."""
    n = len(rank)
    out, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(text: np.ndarray, least_words: int = LEAST_WORDS, least_turns: int = LEAST_TURNS) -> np.ndarray:
    """Rows (start, length, period) of all runs of a text of symbols from 1 on, by start and period."""
    n = len(text)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    symbols = int(text.max()) + 1
    forward = Lce([*text.tolist(), 0], symbols)
    backward = Lce([*text[::-1].tolist(), 0], symbols)
    found = []
    # Where a run ends before the text does, the end's own place in the order plays no part;
    # a run up to the end is found under the first order, where the end comes before all.
    for rank in (forward.place, -forward.place):
        following = _next_smaller(rank[:n].tolist())
        i = np.flatnonzero(following < n)
        j = following[i]
        period = j - i
        right = forward(i, j)
        left = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        left[inner] = backward(n - i[inner], n - j[inner])
        length = left + period + right
        is_run = length >= np.maximum(least_words, least_turns * period)
        found.append(np.column_stack([i - left, length, period])[is_run])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


# ---------------------------------------------------------------- documents


def stretches(words: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_turns: int = LEAST_TURNS) -> tuple[np.ndarray, np.ndarray]:
    """(places, bounds) of the stretches of word hashes that may hold a run.

    `first` gives where each document begins. A word that stands fewer times in its stretch
    than any run repeats it is dropped, for as long as a round drops a sixteenth of what is left.
    """
    at = np.arange(len(words))
    stretch = np.searchsorted(first, at, side="right")
    while True:
        held = len(at)
        key = kernel.mix(words[at] + kernel.mix(stretch.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if held else np.zeros(0, np.int64)
        size = np.diff(np.append(new, held))
        often = np.zeros(held, bool)
        often[order] = np.repeat(size >= least_turns, size)
        at, stretch = at[often], stretch[often]
        begins = np.append(True, (at[1:] != at[:-1] + 1) | (stretch[1:] != stretch[:-1])) if len(at) else np.zeros(0, bool)
        bounds = np.append(np.flatnonzero(begins), len(at))
        long = np.diff(bounds) >= least_words
        at = at[np.repeat(long, np.diff(bounds))]
        size = np.diff(bounds)[long]
        stretch = np.repeat(np.arange(len(size)), size)
        if not len(at) or len(at) * 16 > held * 15:
            return at, np.append(0, np.cumsum(size))


def periodic_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from a on are made to repeat with period p, for one in ten documents."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    return None if h % 10 else (a := g % n, 1 + (n - a) // (3 + g % 8))


def _group(data: np.ndarray, offsets: np.ndarray, ids: list[int | None], planted: bool, least_words: int, least_turns: int):
    start, end, first = kernel.words(data, offsets)
    source = np.arange(len(start))
    for k, doc_id in enumerate(ids):
        tail = periodic_tail(doc_id, int(first[k + 1] - first[k])) if planted else None
        if tail:
            a, p = tail
            here = source[first[k] + a : first[k + 1]]
            here[:] = first[k] + a + np.arange(len(here)) % p
    hashes = kernel.span_hash(kernel.prefix_sums(data), start, end)[source]
    at, bounds = stretches(hashes, first, least_words, least_turns)
    found, raw = [], data.tobytes() if len(at) else b""
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + TREE_WORDS, side="right")) - 1)
        places = at[bounds[lo] : bounds[hi]]
        known: dict[bytes, int] = {}
        spans = zip(start[source[places]].tolist(), end[source[places]].tolist())
        names = [known.setdefault(raw[a:b], len(known) + 1) for a, b in spans]
        # One symbol of its own after each stretch.
        cut = bounds[lo + 1 : hi + 1] - bounds[lo]
        text = np.insert(np.array(names, np.int64), cut, len(known) + 1 + np.arange(len(cut)))
        back = np.insert(places, cut, -1)
        rows = runs_of(text, least_words, least_turns)
        rows[:, 0] = back[rows[:, 0]]
        found.append(rows)
        lo = hi
    rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
    doc = np.searchsorted(first, rows[:, 0], side="right") - 1
    # Words after the first period of a run.
    change = np.zeros(len(source) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    # Kept words, each followed by one space, as bytes of one buffer.
    a, b = start[source[kept]], end[source[kept]]
    size = b - a + 1
    joined = data[np.minimum(kernel.ragged(a, size), len(data) - 1)]
    stop = np.cumsum(size)
    joined[stop - 1] = 32
    upto = np.append(0, stop)[np.searchsorted(kept, first)]
    collapsed = memoryview(np.ascontiguousarray(joined))
    by_doc = np.searchsorted(doc, np.arange(len(ids) + 1))
    for k in range(len(ids)):
        mine = rows[by_doc[k] : by_doc[k + 1]].copy()
        mine[:, 0] -= first[k]
        text = collapsed[upto[k] : max(upto[k], upto[k + 1] - 1)]
        yield mine, int(first[k + 1] - first[k]), hashlib.sha256(text).hexdigest(), text


def _finder(planted: bool, least_words: int, least_turns: int, with_text: bool):
    names = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            data, offsets = kernel.text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            rows = []
            for lo, hi in kernel.groups(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                for runs, n, sha, text in _group(part, at, ids[lo:hi], planted, least_words, least_turns):
                    best = None
                    if len(runs):
                        best = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                        best.append(1000 * best[1] // best[2])
                    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
                    row = (n, len(runs), *(best or (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), sha)
                    rows.append((*row, bytes(text).decode()) if with_text else row)
            fields = [pa.field(c, pa.string() if c.endswith("256") else pa.int64()) for c in names]
            fields += [pa.field("collapsed", pa.string())] * with_text
            columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", *(f.name for f in fields)])

    return batches


def periodic_runs(docs: DataFrame, planted: bool = False, least_words: int = LEAST_WORDS, least_turns: int = LEAST_TURNS,
                  with_text: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_runs, the longest run, digests of all runs and of the text without repeats.

    Words are stretches of bytes other than space and the controls 9 to 13. The longest run
    (ties: smallest start, then period) gives start, length, period and exponent_milli, four
    nulls where there is none. A word that any run holds after its first period goes;
    `collapsed` is what is left, joined by single spaces, and comes with `with_text`.
    `planted` first makes the tail of one document in ten repeat itself (`periodic_tail`).

    A null or empty text, or one of white space, has no words and no runs; the digests are
    those of nothing. Rows that repeat a doc_id are judged each on its own, a null doc_id is
    kept and its text never planted. Other columns are ignored; an empty table gives no rows.
    """
    if least_turns < 2 or least_words < 1:
        raise ValueError("a run repeats its period at least twice")
    schema = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
              "runs_sha256 string, collapsed_sha256 string" + ", collapsed string" * with_text)
    return docs.select("doc_id", "text").mapInArrow(_finder(planted, least_words, least_turns, with_text), schema)
