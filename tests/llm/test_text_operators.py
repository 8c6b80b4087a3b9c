"""Line dedup, MinHash, decontamination and quality against brute force on small tables."""

import random
import re

import numpy as np
import pytest

from barledger.llm import decontaminate, kernel, line_templates, minhash, quality

DOCS = "doc_id long, text string"
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (903, "one"), (None, "a text without an id that is long enough to matter")]


def prose(rng, n, size=400):
    return [f"w{rng.randrange(size)}x" if rng.random() < 0.7 else rng.choice("the of and to in".split()) for _ in range(n)]


def wide(df):
    """With extra columns named like those the operators make."""
    for name in ("component_id", "kept", "n_lines", "rep", "a", "items", "score", "line", "key"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


# ---------------------------------------------------------------- MinHash

def family_texts():
    rng = random.Random(5)
    rows, at = [], 0
    for _ in range(6):
        base = prose(rng, rng.randint(30, 120))
        for k in range(14):
            words = list(base)
            for _ in range(rng.randint(0, len(base) // 12)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((at, rng.choice([" ", "  ", "\n"]).join(words) if k else " ".join(words).upper()))
            at += 1
    rows += [(at + k, " ".join(prose(rng, rng.randint(1, 60)))) for k in range(30)]
    rows += [(500, "a b c"), (501, "A b\tc"), (502, "a b d"), (503, "a b c d e"), (504, "a b c d e f")]
    return rows + ODD


def brute_components(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
        if i is not None:
            sets[i] = grams
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_minhash_equals_brute_force(spark):
    rows = family_texts()
    want = brute_components(rows)
    got = minhash.near_duplicates(wide(spark.createDataFrame(rows, DOCS))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_minhash_finds_links_that_stars_miss(spark):
    """A chain of small changes: ends are far apart, every step is a link."""
    rng = random.Random(8)
    words, rows = prose(rng, 90), []
    for k in range(25):
        rows.append((k, " ".join(words)))
        words = list(words)
        words[(k * 3) % 90] = f"step{k}"
    want = brute_components(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_prefix_pairs_lose_no_link(spark):
    rows = [(i, t) for i, t in family_texts() if i is not None and i < 90]
    members = spark.createDataFrame([(i, i, True) for i, _ in rows], "rep long, component long, outside boolean")
    texts = spark.createDataFrame(rows, "rep long, text string")
    found = {(r.a, r.b) for r in minhash.prefix_pairs(members, texts).collect()}
    want = {i: set() for i, _ in rows}
    for i, text in rows:
        words = text.lower().split()
        want[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}
    links = {(x, y) for x in want for y in want if x > y and 100 * len(want[x] & want[y]) >= 75 * len(want[x] | want[y])}
    assert links and links <= found


def test_minhash_of_an_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert minhash.keep_one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_pruning_keeps_probable_links():
    least = minhash.least_matches()
    assert list(least) == sorted(least) and least[-1] < 0.75 * minhash.HASHES
    rng = np.random.default_rng(1)
    same = (rng.random((20000, minhash.HASHES)) < 0.75).cumsum(axis=1)
    lost = sum(((same[:, (k + 1) * minhash.BATCH - 1]) < need).sum() for k, need in enumerate(least))
    assert lost <= 1


# ---------------------------------------------------------------- lines

def brute_lines(rows):
    """For every row: its lines' words, and the set of template paths of each line."""
    out = []
    for i, text in rows:
        lines = []
        for part in re.split("\n", text or ""):
            words = re.findall(r"[^\x20\x09-\x0D]+", part)
            line = []
            for w in words:
                line.append(w)
                if w[-1] in ".!?":
                    lines.append(line)
                    line = []
            if line:
                lines.append(line)
        paths = []
        for line in lines:
            masked = ["<*>" if re.search("[0-9]", w) else w for w in line]
            n, found = len(masked), set()
            if n >= line_templates.MIN_WORDS:
                found.add((n, None, tuple(masked)))
            if n >= line_templates.LONG_WORDS:
                rest = n - line_templates.LEADING
                for k in range(line_templates.PARTS):
                    a, b = line_templates.LEADING + rest * k // 4, line_templates.LEADING + rest * (k + 1) // 4
                    found.add((n, k, tuple(masked[:a] + masked[b:])))
            paths.append(found)
        out.append((i, lines, paths))
    owner = {}
    for i, _, paths in out:
        if i is not None:
            for found in paths:
                for path in found:
                    owner[path] = min(owner.get(path, i), i)
    return [(i, lines, [i is not None and any(owner[p] != i for p in found) for found in paths]) for i, lines, paths in out]


def line_rows():
    rng = random.Random(3)
    passage = ". ".join(" ".join(prose(rng, 14, 10**6)) for _ in range(4)) + "."
    long_line = prose(rng, 24, 10**6)
    rows = []
    for i in range(40):
        text = "\n".join(" ".join(prose(rng, rng.randint(3, 20), 10**6)) + rng.choice([".", "", "!"]) for _ in range(5))
        if i % 4 == 0:
            text += f" {passage} and then more words\n"
        if i % 5 == 0:
            text += f"\nPage {i} of {i + 7} was printed on day {i}.\nAll rights reserved."
        if i % 3 == 0:
            changed = list(long_line)
            changed[rng.randrange(2, 24)] = f"other{i}"
            text = " ".join(changed) + ".\n" + text
        rows.append((i, text))
    return rows + ODD + [(50, rows[0][1])]


def test_recurring_lines_equal_brute_force(spark):
    rows = line_rows()
    want = brute_lines(rows)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "nth long, " + DOCS)
    got = {r.nth: r for r in line_templates.drop_recurring_lines(wide(df)).collect()}
    assert len(got) == len(rows)
    for k, (i, lines, gone) in enumerate(want):
        assert (got[k].n_lines, got[k].n_dropped) == (len(lines), sum(gone)), k
        if not any(gone):
            assert got[k].text == rows[k][1]
        else:
            assert got[k].text.split() == [w for line, g in zip(lines, gone) if not g for w in line]
    assert sum(sum(g) for _, _, g in want) > 50
    assert all(got[k].n_dropped == 0 for k in range(1, 3))


def test_a_changed_text_keeps_its_order_and_newlines(spark):
    rows = [(1, "alpha beta gamma delta epsilon.\nrest one"), (2, "start here. alpha beta gamma delta epsilon.\n\nrest two. end")]
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: rows[0][1], 2: "start here.\nrest two. end"}


def test_lines_of_an_empty_table(spark):
    out = line_templates.drop_recurring_lines(spark.createDataFrame([], DOCS))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "n_lines", "n_dropped"]


# ---------------------------------------------------------------- decontamination

def plain_normalised(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip()


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def contaminated_tables():
    rng = random.Random(11)
    items = [(k, " ".join(prose(rng, rng.randint(8, 30), 10**6)).capitalize() + ".") for k in range(8)]
    items += [(20, "Short item 7"), (21, None), (22, "..."), (None, "no id at all here"), (0, items[0][1]), (23, "Çé ñ Überlange Wörter für Straße, ok")]
    docs = []
    for i in range(60):
        _, item = items[i % 8]
        text = list(item)
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 12, 25])):
            k = rng.randrange(len(text))
            text[k : k + 1] = rng.choice([[], [rng.choice("abcdefg")], [text[k], rng.choice("xyz")]])
        body = "".join(text) if i % 3 else "".join(text).upper().replace(" ", "  -- ")
        docs.append((i, " ".join(prose(rng, 20)) + " " + body + " " + " ".join(prose(rng, 10))))
    docs += [(70, "x SHORT, item 7!"), (71, "short item 8"), (72, items[3][1]), (73, "çé ñ überlange wörter für straße ok")]
    return docs + ODD, items


def test_decontamination_equals_brute_force(spark):
    docs, items = contaminated_tables()
    got = decontaminate.contaminations(
        wide(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r.edits for r in got}
    want = {}
    for i, text in docs:
        for k, item in items:
            item, flat = plain_normalised(item), plain_normalised(text)
            if k is None or not item:
                continue
            edits = least_edits(item, flat)
            if edits <= decontaminate.budget(len(item)):
                want[i, k] = edits
    assert set(found) == set(want)
    assert all(found[k] == want[k] for k in want)
    assert any(e > 2 for e in want.values())


def test_decontamination_in_chunks_is_the_same(spark, monkeypatch):
    docs, items = contaminated_tables()
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in decontaminate.contaminations(*frames).collect()}
    monkeypatch.setattr(decontaminate, "CHUNK_CHARS", 300)
    assert {tuple(r) for r in decontaminate.contaminations(*frames).collect()} == whole


def test_decontamination_report_and_filter(spark):
    docs, items = contaminated_tables()
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    report = decontaminate.contamination_report(*frames).collect()
    assert len(report) == len(docs)
    bad = {r.doc_id for r in report if r.contaminated}
    kept = [r.doc_id for r in decontaminate.drop_contaminated(*frames).collect()]
    assert len(kept) == len([i for i, _ in docs if i not in bad]) and not bad & set(kept) and None in kept
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(frames[0], none).count() == len(docs)
    assert decontaminate.contaminations(spark.createDataFrame([], DOCS), frames[1]).count() == 0


def test_gram_codes_depend_on_their_characters_only():
    code = np.array([ord(c) for c in "abcabcabcabcabcabd"], np.uint32)
    for q in (1, 2, 5, 12):
        grams = decontaminate.gram_codes(code, q)
        text = "".join(map(chr, code))
        seen = {}
        for k, g in enumerate(grams):
            assert seen.setdefault(text[k : k + q], g) == g
        assert len(set(seen.values())) == len(seen)


# ---------------------------------------------------------------- quality

def quality_tables():
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        good = rng.random() < 0.8
        words = prose(rng, rng.randint(20, 120), 10**6)
        text = " ".join(words) + "." if good else rng.choice([" ".join(w.upper() + "!!" for w in words[:8]) + " ", " | ".join(words) + " "]) * 3
        docs.append((i, text))
        if rng.random() < 0.6:
            labels.append((i, int(good)))
    return docs, labels


def test_quality_learns_from_positives_alone(spark):
    docs, labels = quality_tables()
    label = "doc_id long, quality int"
    scored = quality.score_quality(wide(spark.createDataFrame(docs + ODD, DOCS)), spark.createDataFrame(labels, label)).collect()
    assert len(scored) == len(docs) + len(ODD) and all(0 <= r.score <= 1 for r in scored)
    truth = dict(labels)
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 20
    assert all(r.predicted == int(r.score >= 0.3) for r in scored)
    # Held-out labels and all negative ones teach nothing.
    import zlib

    other = [(i, q) for i, q in labels if q == 1 and zlib.crc32(str(i).encode()) % 5] + [(i, 1 - q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    other += [(None, 1), (5000, 1), (1, None)]
    again = quality.score_quality(spark.createDataFrame(docs + ODD, DOCS), spark.createDataFrame(other, label)).collect()
    key = lambda rows: sorted((str(r.doc_id), r.score) for r in rows)
    assert key(again) == key(scored)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.score_quality(spark.createDataFrame(ODD, DOCS), none).collect()
    assert {r.score for r in rows} == {0.5} and len(rows) == len(ODD)
    assert quality.score_quality(spark.createDataFrame([], DOCS), none).count() == 0
    assert quality.keep_good(spark.createDataFrame(ODD, DOCS), none).count() == len(ODD)


def test_the_prior_is_near_the_truth():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0, 1, (3000, 4)), rng.normal(4, 1, (600, 4))
    prior = quality.estimated_prior(good[:1000], np.concatenate([good[1000:], bad]))
    assert 0.7 < prior < 0.8  # 2000 of 2600


def test_sums_over_cells_equal_a_plain_loop(spark):
    """Gradient, mean score and counts against one row after the other; the risk falls along it."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (40, len(quality.FEATURES))).round(1)
    x[20:30] = x[:10]
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "doc_id long, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    quantiles = quality.corpus_quantiles(rows)
    assert quantiles.shape == (len(quality.FEATURES), len(quality.QUANTILES))
    edges = quality._edges(x[:7], quantiles)
    model = quality.Model(edges)
    model.weights = rng.normal(0, 0.3, len(model.weights))
    sums = quality.corpus_sums(rows.repartition(3), edges)
    for bounded in (False, True):
        found = sums(quality._slopes(model.weights, bounded), None)
        want, scores = np.zeros(len(model.weights)), 0.0
        for r in x:
            at = [k * (quality.BINS + 1) + sum(e <= v for e in edges[k]) for k, v in enumerate(r)]
            score = 1 / (1 + np.exp(-(sum(model.weights[a] for a in at) + model.weights[-1])))
            slope = score * (1 - score) if bounded else score
            want[at] += slope
            want[-1] += slope
            scores += score
        assert np.allclose(found[:-2] / quality.UNIT, want, atol=1e-5) and found[-1] == 40
        assert abs(found[-2] / quality.UNIT - scores) < 1e-5
        parts = sums(quality._slopes(model.weights, bounded), 0) + sums(quality._slopes(model.weights, bounded), 1)
        assert (parts == found).all()

    def risk(weights, prior=0.4):
        s_p, s_u = (1 / (1 + np.exp(-quality._margin(model.bins(v), weights))) for v in (x[:7], x))
        return prior * (1 - s_p).mean() + max(0.0, s_u.mean() - prior * s_p.mean())

    fitted = quality._fit(model.bins(x[:7]), edges, sums, None, 0.4)
    assert risk(fitted.weights) < risk(np.zeros(len(model.weights))) - 0.1
    thresholds = np.sort(model.margin(x[:9]))
    reached = sums(quality._reaching(model.weights, thresholds), None)
    assert list(reached) == [40] + [int((model.margin(x) >= t).sum()) for t in thresholds]


# ---------------------------------------------------------------- kernel

@pytest.mark.parametrize("group", [8, 1 << 20])
def test_words_and_hashes_do_not_depend_on_place(monkeypatch, group):
    monkeypatch.setattr(kernel, "GROUP_BYTES", group)
    texts = ["ab cd", "", "cd\tab  ab", "é cd", None, "x" * 50]
    import pyarrow as pa

    data, offsets = kernel.text_bytes(pa.array(texts))
    seen = {}
    for a, b in kernel.groups(offsets):
        part = data[offsets[a] : offsets[b]]
        start, end, first = kernel.words(part, offsets[a : b + 1] - offsets[a])
        if len(start):
            for s, e, h in zip(start, end, kernel.span_hash(kernel.prefix_sums(part), start, end)):
                assert seen.setdefault(part[s:e].tobytes(), h) == h
        assert list(np.diff(first)) == [len((t or "").split()) for t in texts[a:b]]
    assert len(set(seen.values())) == len(seen)
