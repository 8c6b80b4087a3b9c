"""Whitening, chat grammar and word periods on small tables, each against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from barledger.llm import chat_grammar, whitening, word_periods

# ---------------------------------------------------------------- whitening


def brute_whitening(rows, components=16):
    """{row number: (n, deviation, [(whitened, explained)])}, with numpy's eigenvectors."""
    good = {k: [int(np.floor(64.0 * float(c))) + 1_000_000 for c in v] for k, v in enumerate(rows)
            if v and all(c is not None and np.isfinite(c) for c in v)}
    unique = sorted({tuple(x) for x in good.values()})
    if not unique:
        return {}, None
    n, sums = len(unique), [sum(c) for c in zip(*unique)]
    z = np.array([[c - s / n for c, s in zip(x, sums)] for x in unique])
    cov = z.T @ z / n
    value, vector = np.linalg.eigh(cov)
    keep = [k for k in np.argsort(-value) if value[k] > 1e-9 * max(value.max(), 1e-300)][:components]
    out = {}
    for k, x in good.items():
        centred = np.array([c - s / n for c, s in zip(x, sums)])
        out[k] = (n, sum((n * c - s) ** 2 for c, s in zip(x, sums)),
                  [(float(centred @ vector[:, c]) / np.sqrt(value[c]), value[c] / np.trace(cov)) for c in keep])
    return out, keep


def check_whitening(spark, rows, kind="float", components=16):
    if kind == "float":
        rows = [v and [c if c is None else float(np.float32(c)) for c in v] for v in rows]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"vec_id long, embedding array<{kind}>")
    df = df.selectExpr("*", "1 as packed", "2 as n", "3 as component", "4 as whitened").repartition(3)
    got = {}
    for r in whitening.whitened(df, components).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    want, keep = brute_whitening(rows, components)
    assert set(got) == (set(want) if keep else set())
    flips = {}
    for k, found in got.items():
        n, deviation, parts = want[k]
        assert sorted(found) == list(range(1, len(parts) + 1))
        for c, (w, explained) in enumerate(parts, 1):
            r = found[c]
            assert (r.n, int(r.deviation)) == (n, deviation)
            assert abs(r.explained - explained) <= 1e-9 * explained and r.identity_error <= 1e-9
            if abs(w) > 1e-6:
                assert flips.setdefault(c, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
            assert abs(abs(r.whitened) - abs(w)) < 1e-6
    return got


def test_whitening_equals_numpy(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(300, 7)) * [9, 6, 4, 2.5, 1, 0.5, 0.2] @ np.linalg.qr(r.normal(size=(7, 7)))[0]
    rows = base.tolist()
    rows += [rows[3]] * 40 + [None, [], [1.0] * 6 + [None], [float("nan")] * 7, [float("inf")] + [0.0] * 6]
    assert len(check_whitening(spark, rows)) == 340
    check_whitening(spark, rows, "double", components=3)


def test_whitening_of_other_widths(spark):
    r = np.random.default_rng(6)
    rows = [[float(v) for v in (2e4 * a, 400.0 * b, 9.0 * c)] for a, b, c in r.normal(size=(60, 3))]
    check_whitening(spark, rows, "double")


def test_whitening_leaves_out_flat_directions(spark):
    rows = [[float(k), 2.0 * k, 5.0] for k in range(10)]
    assert all(set(found) == {1} for found in check_whitening(spark, rows).values())
    assert check_whitening(spark, [[1.0, 2.0]] * 5) == {}
    assert check_whitening(spark, [None, []]) == {}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened(empty).count() == 0


def test_whitening_refuses_unlike_vectors(spark):
    for rows in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1e300, 1.0]), (2, [1.0, 2.0])]):
        with pytest.raises(Exception, match="vectors of|entries beyond"):
            whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


def test_null_and_repeated_ids_keep_a_row_each(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [0.0, 3.0]), (4, [2.0, 2.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i, _ in rows for c in (1, 2))
    assert {r.n for r in got} == {3}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.integers(0, 10_000))
def test_eigenvalues_by_cholesky_and_jacobi(d, rows, seed):
    z = np.random.default_rng(seed).integers(-9, 9, size=(rows, d)).astype(float)
    a = z.T @ z
    value, vector = whitening.eigen_of(a)
    want = np.linalg.eigvalsh(a)[::-1]
    assert np.allclose(value, want[: len(value)], rtol=1e-9, atol=1e-9 * max(1.0, want[0]))
    assert np.all(want[len(value):] <= 1e-9 * max(1.0, want[0]))
    assert np.allclose(vector.T @ vector, np.eye(len(value)), atol=1e-9)
    assert np.allclose(a @ vector, vector * value, atol=1e-8 * max(1.0, want[0]))


# ---------------------------------------------------------------- chat grammar

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", "<", "[", "/s>", "s>", "INST]", "SYS>>", "ok", "é🙂", "\n", " ", ">", "]"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), st.lists(st.sampled_from(PARTS), max_size=4).map("".join)),
                          st.lists(st.sampled_from(PARTS), max_size=12).map("".join)), max_size=5))
def test_every_text_comes_back(turns):
    pieces = [chat_grammar.settled(role, text) for role, text in turns]
    assert list(chat_grammar.parse("".join(p for p, _, _ in pieces))) == turns
    for (piece, a, b), (role, text) in zip(pieces, turns):
        assert chat_grammar.unescape(piece[a:b]) == text
        if not any(re.search(re.escape(c[0]) + r"\\*" + re.escape(c[1:]), text) for c in chat_grammar.CONTROLS):
            assert piece[a:b] == text  # nothing is escaped without need


def test_texts_outside_the_grammar_are_refused():
    for text in ("[INST]a", "[INST]a</s>", "<<SYS>>[/INST]", "a", "[ROLE]x</s>", "a<s></s>", "[/INST]"):
        with pytest.raises(chat_grammar.Refused):
            list(chat_grammar.parse(text))


TURNS = [
    (1, 0, "system", "be kind"), (1, 2, "assistant", "a</s>b"), (1, 1, "user", "[INST] \\[/INST] <\\/s>"), (1, 3, "assistant", None), (1, 4, None, "no role"),
    (2, 0, "user", ""), (2, 0, "user", ""), (2, None, "assistant", "first"), (2, 1, "tool [/ROLE]", "x" * 300), (None, 0, "assistant", "no id"), (None, 1, "user", "é漢🙂"),
    (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (7, 5, "user", "only the user"),
    *[(9, k, "assistant" if k % 2 else "user", f"turn {k} " + "word " * (k % 17)) for k in range(400)],
]


def brute_turns(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(r[1], chat_grammar.settled(r[2] or "", r[3] or "")[0], r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        said = "".join(t for _, _, role, t in mine if role == "assistant")
        out[conv] = (len(mine), hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in mine).encode()).hexdigest(),
                     len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len(p) for _, p, _, _ in mine))
    return out


@pytest.mark.parametrize("part_chars", [1 << 20, 200, 1])
def test_conversations_come_back_from_their_parts(spark, part_chars):
    rows = TURNS[:]
    random.Random(part_chars).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as piece", "2 as part", "3 as whole").repartition(5)
    parts = chat_grammar.write_conversations(df, part_chars)
    got = chat_grammar.read_conversations(parts).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_turns(TURNS) and len(got) == len({r[0] for r in TURNS})
    if part_chars == 200:
        assert parts.where("conv_id = 9").count() > 10


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_grammar.read_conversations(chat_grammar.write_conversations(empty)).count() == 0


# ---------------------------------------------------------------- word periods


def brute_runs(t, least_words=6, least_turns=4):
    out = {}
    for q in range(1, len(t) // least_turns + 1):
        i = 0
        while i + q < len(t):
            s = i
            while i + q < len(t) and t[i] == t[i + q]:
                i += 1
            if i - s and i - s + q >= max(least_words, least_turns * q):
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, size, q) for (s, size), q in out.items())


def brute_document(doc_id, text, planted):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    return (len(w), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(), left)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=1, max_size=5), st.integers(1, 8)), max_size=8), st.integers(2, 4))
def test_runs_equal_brute_force(blocks, turns):
    t = [x for block, times in blocks for x in block * times]
    assert [tuple(r) for r in word_periods.runs_of(np.array(t, np.int64), 6, turns).tolist()] == brute_runs(t, 6, turns)


def test_documents_equal_brute_force(spark):
    r = random.Random(3)
    texts = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "no no no no no no yes", "\x1c\x1c b", "é漢 é漢 é漢 é漢 é漢 é漢", "x y x y x y x y x", "　a　a"]
    for _ in range(150):
        words = [r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(1, 40))]
        at = r.randint(0, len(words))
        words[at:at] = words[:r.randint(1, 6)] * r.randint(1, 9)
        texts.append(r.choice([" ", "\n", "  "]).join(words))
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, "b b b b b b b"), (5, "c"), (None, "d e " * 9), (-3, "f g h " * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as n_runs", "3 as words").repartition(3)
    for planted in (False, True):
        got = sorted(map(str, map(tuple, word_periods.periodic_runs(df, planted, with_text=True).collect())))
        assert got == sorted(str((i, *brute_document(i, t, planted))) for i, t in rows)


def test_a_very_long_text(spark):
    r = random.Random(4)
    words = [f"w{r.randint(0, 900)}" for _ in range(120_000)]
    words[50_000:70_000] = (words[:50] * 400)
    words[90_000:90_040] = ["again"] * 40
    text = " ".join(words)
    row = word_periods.periodic_runs(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").first()
    assert (row.n_runs, row.start, row.length, row.period) == (2, 50_000, 20_000, 50)


def test_nothing_has_no_runs(spark):
    assert word_periods.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        word_periods.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), least_turns=1)
