"""Passages that line ends do not cut out: in mid-sentence, and made of short lines."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from barledger.llm import line_templates
from test_text_operators import DOCS


def test_runs_of_over_50_words_go_wherever_they_begin(spark):
    rng = random.Random(17)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=9)) for _ in range(n)]
    run, short, fifty = words(60), words(60), words(50)
    items = "\n".join(" ".join(short[k : k + 3]) for k in range(0, 60, 3))
    own = {i: (words(30), words(40)) for i in range(1, 9)}
    rows = [(i, " ".join([*own[i][0], *run, *own[i][1]])) for i in (1, 2, 3)]
    rows += [(i, " ".join(own[i][0]) + "\n" + items + "\n" + " ".join(own[i][1])) for i in (4, 5)]
    rows += [(i, " ".join([*own[i][0], *fifty, *own[i][1]])) for i in (6, 7)]
    rows += [(8, " ".join([*own[8][0], *run[5:56]])), (None, rows[0][1])]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, DOCS)).collect()}
    for i in (1, 4, 6, 7, None):
        assert (got[i].text, got[i].n_dropped) == (dict(rows)[i], 0)
    for i in (2, 3):
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == (" ".join([*own[i][0], *own[i][1]]), 1, 1)
    assert got[5].text == " ".join(own[5][0]) + "\n" + " ".join(own[5][1]) and got[5].n_dropped == 20
    assert got[8].text == " ".join(own[8][0])


def test_rows_that_repeat_an_id_lose_their_own_lines_only(spark):
    rng = random.Random(18)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(8)) + "."
    shared, run = line(), " ".join("".join(rng.choices("klmnop", k=9)) for _ in range(70))
    own = [line() for _ in range(50)]
    rows = [(7, shared), (7, f"{own[0]}\n{own[1]}"), (7, "\n".join([*own[2:], shared])), (3, f"{line()}\n{shared}"),
            (9, f"start {run} end"), (9, own[0]), (4, f"other {run} words"), (9, f"start {run} end")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"nth int, {DOCS}").repartition(3)
    got = {r.nth: (r.text, r.n_lines, r.n_dropped) for r in line_templates.drop_recurring_lines(df).collect()}
    assert got[0] == ("", 1, 1) and got[1] == (rows[1][1], 2, 0) and got[2] == ("\n".join(own[2:]), 49, 1)
    assert got[3] == (rows[3][1], 2, 0) and got[6] == (rows[6][1], 1, 0)
    assert got[5] == ("", 1, 1) and got[4] == got[7] == ("start end", 1, 1)


def test_very_common_hashes_stay_out_of_the_join(spark, monkeypatch):
    rng = random.Random(19)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(9)) + "."
    hot, warm = line(), line()
    rows = [(i, "\n".join([line(), hot, *([warm] if i % 10 == 3 else [])])) for i in range(60)]
    plain = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, DOCS)).collect()}
    monkeypatch.setattr(line_templates, "HOT_LEAST", 20)
    monkeypatch.setattr(line_templates, "HOT_SHARE", 10)
    split = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert split == plain
    assert sum(hot in t for t in split.values()) == 1 and sum(warm in t for t in split.values()) == 1


def test_places_of_very_common_hashes_are_one_row_for_each_text(spark, monkeypatch):
    rng = random.Random(20)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(n))
    run = words(300)
    rows = [(i, f"{words(8)} {run} {words(8)}") for i in range(40)]
    written, keep = {}, line_templates.published

    def published(df, label):
        written[label] = keep(df, label)
        return written[label]

    monkeypatch.setattr(line_templates, "published", published)
    monkeypatch.setattr(line_templates, "HOT_LEAST", 20)
    monkeypatch.setattr(line_templates, "HOT_SHARE", 10_000)
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, DOCS).repartition(2)).collect()}
    assert got == {i: text if i == 0 else text.replace(f" {run}", "") for i, text in rows}
    assert written["places-grams"].count() == 40 and written["places-windows"].count() == 39


def brute_rewrite(text, gone, runs):
    """Words with their bytes, word by word; between kept words a newline if one stood in what went, else a space."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    line, lines = 0, []
    for k, (start, _) in enumerate(words):
        if k and ("\n" in text[words[k - 1][1] : start] or text[words[k - 1][1] - 1] in ".!?"):
            line += 1
        lines.append(line)
    away = [lines[k] in gone or any(r <= k < r + line_templates.RUN for r in runs) for k in range(len(words))]
    if not any(away):
        return text, len(set(lines)), 0
    kept = [k for k in range(len(words)) if not away[k]]
    out = text[: words[0][0]] if kept and kept[0] == 0 else ""
    for before, k in zip([None, *kept], kept):
        between = text[words[before][1] : words[k][0]] if before is not None else ""
        out += ("\n" if "\n" in between else " ") * (before is not None) if before != k - 1 else between * (before is not None)
        out += text[words[k][0] : words[k][1]]
    out += text[words[-1][1] :] if kept and kept[-1] == len(words) - 1 else ""
    return out, len(set(lines)), len({lines[k] for k in range(len(words)) if away[k]})


def test_rewritten_texts_equal_a_walk_over_words():
    rng, texts, gone, runs = random.Random(20), [], [], []
    for _ in range(400):
        n = rng.choice([0, 1, 3, 20, 70, 200])
        pieces = [rng.choice(["a", "bé.", "c!", "Ωd", "7"]) + rng.choice([" ", "  ", "\n", " \n", "\t"]) for _ in range(n)]
        texts.append(rng.choice([None, "", " \n "]) if not n else rng.choice(["", " ", "\n"]) + "".join(pieces).rstrip(rng.choice(["", " \n\t"])))
        _, n_lines, _ = brute_rewrite(texts[-1] or "", set(), [])
        gone.append(rng.choice([None, list(range(n_lines)), [k for k in range(n_lines) if rng.random() < 0.3]]))
        runs.append([rng.randrange(n - 50)] if n > 50 and rng.random() < 0.5 else None)
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    places = pa.list_(pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(gone, places), pa.array(runs, places)], names=["text", "gone", "runs"])
    for part in (batch, batch.slice(7)):
        got = next(line_templates._rewrite(schema, 0)(iter([part]))).to_pylist()
        assert len(got) == part.num_rows
        for row, text, lost, cut in zip(got, *(c.to_pylist() for c in part.columns)):
            new, n_lines, n_dropped = brute_rewrite(text or "", set(lost or ()), cut or ())
            assert tuple(row.values()) == (None if text is None else new, n_lines, n_dropped)


def test_leftmost_least_equals_a_walk():
    rng = np.random.default_rng(21)
    for n, width in ((1, 1), (36, 36), (500, 36), (300, 5)):
        values = rng.integers(0, 40, n).astype(np.uint64)
        want = [k + min(range(width), key=lambda j: (values[k + j], j)) for k in range(n - width + 1)]
        assert line_templates._leftmost_least(values, width).tolist() == want
