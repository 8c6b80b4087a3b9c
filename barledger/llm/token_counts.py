"""Token counts of the sections of a document, by offsets of one encoding.

The whole document is encoded once; encoding sections on their own would give other
tokens at their edges. The tokenizer is byte-level, so its tokens cut the text's bytes
into spans without gaps. An interval join of token spans and section spans, by binary
search of the sorted ends, attributes each token; one that crosses a boundary is given to
a section by an explicit rule:

* `majority`: the section with most of the token's bytes, the earlier one of equals;
* `start`: the section with the token's first byte;
* `shared`: every section it overlaps, by its share of the token's bytes.

Under every rule the tokens that fall into no section count as uncovered, so sections and
uncovered together make the document's tokens. Sections may not overlap.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barledger.llm import kernel

RULES = ("majority", "start", "shared")
_encodings: dict = {}


def encoding(path: str):
    """The byte-level tokenizer of a ranks file, and each token's length in bytes."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        _encodings[path] = (
            tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size)
    return _encodings[path]


def attributed(ends: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section.

    ends are the tokens' last positions plus one; sections are sorted and don't overlap.
    A token counts as crossing in every section that it overlaps but isn't inside of.
    """
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    # Interval join: the tokens that overlap section k are first[k] .. past[k] - 1.
    first = np.searchsorted(ends, start, side="right")
    past = np.maximum(np.searchsorted(begins, stop, side="left"), first)
    past = np.where(stop > start, past, first)
    section = np.repeat(np.arange(len(start)), past - first)
    token = kernel.ragged(first, past - first)
    overlap = np.minimum(ends[token], stop[section]) - np.maximum(begins[token], start[section])
    crossing = overlap < ends[token] - begins[token]
    if rule == "shared":
        given = overlap / (ends[token] - begins[token])
    elif rule == "start":
        given = (begins[token] >= start[section]).astype(float)
    else:
        best = np.full(len(ends), 0)
        np.maximum.at(best, token, overlap)
        full = overlap == best[token]
        owner = np.full(len(ends), len(start))
        np.minimum.at(owner, token[full], section[full])
        rest = ends[token] - begins[token]
        # Most bytes of the token may lie in no section.
        covered = np.bincount(token, overlap, len(ends))
        given = ((owner[token] == section) & (overlap >= rest - covered[token])).astype(float)
    return np.bincount(section, given, len(start)), np.bincount(section[crossing], minlength=len(start))


_COUNTS = "doc_id long, section long, start long, stop long, n_tokens double, crossing long, doc_tokens long, uncovered double"


def line_bounds(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every line with the newline that ends it; n newlines make n + 1 lines."""
    cut = np.flatnonzero(code == 10) + 1
    return np.concatenate([[0], cut]).astype(np.int64), np.concatenate([cut, [len(code)]]).astype(np.int64)


def _counter(path: str, rule: str, lines: bool):
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, token_bytes = encoding(path)
        names = [c.split()[0] for c in _COUNTS.split(", ")]
        for batch in found:
            out: list[list] = [[] for _ in names]
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                tokens = model.encode_ordinary(text)
                ends = np.cumsum(token_bytes[tokens]) if tokens else np.zeros(0, np.int64)
                code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                if lines:
                    start, stop = line_bounds(code)
                else:
                    start, stop = (np.array(batch.column(c)[i].as_py() or [], np.int64) for c in (2, 3))
                # Sections are in characters, tokens in bytes.
                width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
                at = np.concatenate([[0], np.cumsum(width)])
                first, last = at[np.clip(start, 0, len(code))], at[np.clip(stop, 0, len(code))]
                if (np.diff(first) < 0).any() or (first[1:] < last[:-1]).any():
                    raise ValueError(f"sections of document {ids[i]} are not sorted or overlap")
                n, crossing = attributed(ends, first, last, rule)
                k = len(start)
                for column, values in zip(out, (
                    [ids[i].as_py()] * k, range(k), start.tolist(), stop.tolist(), n.tolist(), crossing.tolist(),
                    [len(tokens)] * k, [float(len(tokens) - n.sum())] * k,
                )):
                    column.extend(values)
            kinds = {"double": pa.float64(), "long": pa.int64()}
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kinds[f.split()[1]]) for c, f in zip(out, _COUNTS.split(", "))], names=names)

    return batches


def count_sections(docs: DataFrame, tokenizer: str, rule: str = "majority") -> DataFrame:
    """docs(doc_id, text, sections array<struct<start, stop>>) -> one row per section.

    Positions are characters; sections are sorted, may leave gaps and be empty, and stop
    the job when they overlap; parts beyond the text count as nothing. Columns: doc_id,
    section (number from 0), start, stop, n_tokens (fractions under `shared`), crossing,
    and the document's doc_tokens and uncovered. A null or empty text has no tokens; a
    document without sections (null or none) gives no rows. Null and repeated doc_ids are
    counted row by row. Other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    starts = F.transform("sections", lambda s: s["start"].cast("long")).alias("starts")
    stops = F.transform("sections", lambda s: s["stop"].cast("long")).alias("stops")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), starts, stops).mapInArrow(
        _counter(tokenizer, rule, False), _COUNTS)


def count_lines(docs: DataFrame, tokenizer: str, rule: str = "majority") -> DataFrame:
    """count_sections with each line of the text as a section, an empty text being one line."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _counter(tokenizer, rule, True), _COUNTS)
