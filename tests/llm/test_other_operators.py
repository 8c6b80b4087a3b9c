"""WARC, segmentations, token files, token counts, HTML, vectors and the pipeline on small tables."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from barledger.llm import embedding, html_text, sampled_pieces, token_blocks, token_counts, warc
from barledger.llm.components import connected_components
from barledger.llm.queries import tokenizer_file
from barledger.llm.tables import published

DOCS = "doc_id long, text string"
TEXTS = [
    (3, "Hello  world, it's 2024!\nA new line ▁ here"), (1, None), (2, ""), (7, " "), (8, "é漢字🙂 naïve"), (9, "x" * 300),
    (10, "the the the the"), (10, "the the the the"), (None, "no id"), (11, "<|endoftext|> is text a<|endoftext|>b"), (12, "\x00\x1c　tab\tend"),
]


# ---------------------------------------------------------------- WARC

PAGES = [(1, "http://a", "<p>x</p>"), (5, None, "<p>x</p>"), (9, "http://c\r\nX: y", "<p>x</p>"), (2, "http://d", None), (3, "u", ""),
         (4, "u", "é漢"), (9, "http://c", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, None, None)]


def test_archive_tells_responses_from_revisits(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as address", "2 as payload")
    got = warc.read_archive(*warc.write_archive(df)).collect()
    assert len(got) == len(PAGES)
    largest = {}
    for i, _, h in PAGES:
        body = (h or "").encode()
        largest[body] = max(largest.get(body, -1), -1 if i is None else i)
    by_digest = {base64.b32encode(hashlib.sha1(b).digest()).decode(): b for b in largest}
    for r in got:
        body = by_digest[r.payload_digest]
        revisit = r.record_id is not None and r.record_id < largest[body]
        assert r.payload_bytes == len(body)
        assert (r.record_type, r.refers_to) == (("revisit", largest[body]) if revisit else ("response", None))
    small = warc.read_archive(*warc.write_archive(df, least_bytes=3)).collect()
    assert all(r.record_type == "response" for r in small if r.payload_bytes < 3)


def test_archive_of_nothing(spark):
    assert warc.read_archive(*warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_foreign_records_come_back_byte_for_byte(spark):
    body = b"\r\n\r\n\x00\xff body"
    rows = [(k, bytearray(f"WARC/1.0\r\nWARC-Type: response\r\nX-Odd:  {k}\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\n".encode() + body + b"\r\n\r\n")) for k in range(4)]
    payloads, records = warc.split_records(spark.createDataFrame(rows, "record_id long, warc binary"))
    assert payloads.count() == 1 and bytes(payloads.first().payload) == body
    assert {r.record_id: bytes(r.warc) for r in warc.original_records(payloads, records).collect()} == {k: bytes(w) for k, w in rows}


def test_damaged_payloads_are_noticed(spark):
    payloads, records = warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    broken = published(payloads.selectExpr("address", "concat(payload, X'00') as payload", "payload_bytes", "sha1", "keeper"), "broken")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(broken, records).collect()


def test_records_hold_header_and_block(spark):
    payloads, records = warc.write_archive(spark.createDataFrame(PAGES[:3], "page_id long, url string, html string"))
    for r in warc.original_records(payloads, records).collect():
        head, rest = bytes(r.warc).split(b"\r\n\r\n", 1)
        assert rest.endswith(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(rest) - 4
        assert b"\r\nX: y" not in head


# ---------------------------------------------------------------- SentencePiece

MODEL = tokenizer_file("piece_bpe_32k.model")


def test_segmentations_are_drawn_by_their_weight():
    table = sampled_pieces.pieces(MODEL)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rank = {int(p): r for r, p in enumerate(sorted(table.id))}

    def cuts(text):
        if not text:
            yield ()
        for n in range(1, len(text) + 1):
            piece = model.piece_to_id(text[:n])
            if piece in rank and model.id_to_piece(piece) == text[:n]:
                for rest in cuts(text[n:]):
                    yield (piece, *rest)

    for word in ("the", "line", "ouest"):
        weight = {c: math.prod((rank[p] + 2.7) ** -sampled_pieces.ALPHA for p in c) for c in cuts("▁" + word)}
        n = 20_000
        ids, count = sampled_pieces.encode(table, pa.array([word] * n, pa.large_string()), sampled_pieces.row_keys(pa.array(range(n))))
        bounds = np.cumsum(np.concatenate([[0], count]))
        drawn = {}
        for a, b in itertools.pairwise(bounds):
            drawn[tuple(ids[a:b])] = drawn.get(tuple(ids[a:b]), 0) + 1
        assert set(drawn) <= set(weight)
        total = sum(weight.values())
        for c, w in weight.items():
            p = w / total
            assert abs(drawn.get(c, 0) / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_decoding_is_lossless_and_samples_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(TEXTS, DOCS).selectExpr("*", "1 as ids", "2 as decoded")
    got = sampled_pieces.round_trip(df, MODEL).collect()
    assert len(got) == len(TEXTS) and all(r.lossless for r in got)
    key = lambda rows: sorted((str(r.doc_id), r.ids) for r in rows)
    again = sampled_pieces.round_trip(df.repartition(3, "text"), MODEL).collect()
    assert key(again) == key(got)
    back = {(r.doc_id, r.decoded) for r in sampled_pieces.decode_ids(sampled_pieces.encode_sampled(df, MODEL), MODEL).collect()}
    assert back == {(i, t or "") for i, t in TEXTS}
    same = [r.ids for r in got if r.doc_id == 10]
    assert same[0] == same[1]
    assert sampled_pieces.round_trip(df.limit(0), MODEL).count() == 0


@settings(deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_any_text_comes_back(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    table = sampled_pieces.pieces(MODEL)
    ids, count = sampled_pieces.encode(table, pa.array(texts, pa.large_string()), sampled_pieces.row_keys(pa.array(range(len(texts)))))
    assert sampled_pieces.decode(table, ids, count) == texts


# ---------------------------------------------------------------- token files

WORDS_BPE = tokenizer_file("word_bpe_49k.json")


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1))))
def test_numbers_come_back(lists):
    count = np.array([len(x) for x in lists], np.int64)
    numbers = np.array(list(itertools.chain.from_iterable(lists)), np.int64)
    control, data, size = token_blocks.pack(numbers, count)
    assert len(control) == sum(-(-n // 4) for n in count) and size.sum() == len(data)
    assert (token_blocks.unpack(control.tobytes(), data.tobytes(), count) == numbers).all()


TRICKY = ["Don't it's, we're... I'll.x 'tis' a.b,c;d \"e\"(f)[g]", "İSTANBUL ΑΣ ΑΣ. ǅ ﬁ", "A\u030a J\u030c, <\u0338 e\u0301.", "<|ENDOFTEXT|> <|endoftext|>.", "x²³ ٣٤ 12ab34!! ***a***", "a\u00adb\u200bc"]


@settings(deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=30) | st.sampled_from(TRICKY), min_size=1, max_size=5))
def test_parts_give_the_ids_of_whole_texts(texts):
    model = token_blocks._tokenizer(WORDS_BPE)
    for group in ([t] for t in texts):
        ids, count = token_blocks.encode_texts(WORDS_BPE, pa.array(group, pa.large_string()))
        assert list(ids) == model.encode(group[0], add_special_tokens=False).ids
    ids, count = token_blocks.encode_texts(WORDS_BPE, pa.array(texts, pa.large_string()))
    assert list(ids) == [i for t in texts for i in model.encode(t, add_special_tokens=False).ids]


def test_every_letter_before_every_mark():
    """Loosened texts have the ids of whole texts for all letters; of the large regular scripts every 97th."""
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    letters = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    letters = [c for c in letters if not ("\u3400" <= c <= "\ud7a3" or c >= "\U00010000") or ord(c) % 97 == 0]
    model = token_blocks._tokenizer(WORDS_BPE)
    texts = [" ".join(f"a{c}{m}b {c}{m} {m}{c}" for m in marks) for c in letters]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        for group in ([t for t in some if "\u0130" not in t], [t for t in some if "\u0130" in t]):
            ids, count = token_blocks.encode_texts(WORDS_BPE, pa.array(group, pa.large_string()))
            want = [e.ids for e in model.encode_batch(group, add_special_tokens=False)]
            assert count.tolist() == [len(w) for w in want]
            assert ids.tolist() == list(itertools.chain.from_iterable(want))


def test_token_blocks_hold_every_id_in_order(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS_BPE)
    rng = random.Random(1)
    rows = TEXTS + [(100 + k, " ".join(rng.choice(["alpha", "Beta", "don't", "42", "ñandú", "…"]) for _ in range(rng.randint(0, 60)))) for k in range(80)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as start", "'x' as ids").repartition(5)
    blocks, ranks = token_blocks.write_blocks(df, WORDS_BPE, block_ids=16)
    got = sorted(token_blocks.read_blocks(blocks, ranks).collect(), key=lambda r: r.start)
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append(model.encode(text or "", add_special_tokens=False).ids + [1])
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        ids = np.array(want[r.doc_id][0], "<u4").tobytes()
        assert (r.start, r.n_tokens, bytes(r.ids), r.ids_crc32) == (at, len(ids) // 4, ids, zlib.crc32(ids))
        at += r.n_tokens
    order = [r.id for r in ranks.orderBy("rank").collect()]
    freq = {}
    for lists in want.values():
        for i in itertools.chain.from_iterable(lists):
            freq[i] = freq.get(i, 0) + 1
    assert order == sorted(freq, key=lambda i: (-freq[i], i))
    assert blocks.count() > 3


def test_token_blocks_of_nothing(spark):
    blocks, ranks = token_blocks.write_blocks(spark.createDataFrame([], DOCS), WORDS_BPE)
    assert token_blocks.read_blocks(blocks, ranks).count() == 0 == blocks.count()


# ---------------------------------------------------------------- token counts

BYTES_BPE = tokenizer_file("byte_bpe_50k.tiktoken")


def brute_counts(text, sections, rule):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    size = [len(model.decode([i]).encode()) if "�" not in model.decode([i]) else 0 for i in model.encode(text, add_special_tokens=False).ids]
    counts, at = [0.0] * len(sections), 0
    bounds = [(len(text[:a].encode()), len(text[:b].encode())) for a, b in sections]
    for n in size:
        over = [max(0, min(at + n, b) - max(at, a)) for a, b in bounds]
        if rule == "shared":
            counts = [c + o / n for c, o in zip(counts, over)]
        elif rule == "start":
            counts = [c + (a <= at < b) for c, (a, b) in zip(counts, bounds)]
        elif over and max(over) > 0 and max(over) >= n - sum(over):
            counts[over.index(max(over))] += 1
        at += n
    return counts, len(size)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_get_their_tokens(spark, rule):
    text = "Internationalisation   of\n\n\n\nunbelievable things.\nEnd"
    sections = [(0, 7), (7, 7), (9, 26), (27, 40), (40, 900)]
    rows = [(1, text, [{"start": a, "stop": b} for a, b in sections]), (2, None, [{"start": 0, "stop": 3}]), (3, "abc", None), (4, "abc", []), (None, "ab", [{"start": 0, "stop": 1}])]
    got = token_counts.count_sections(spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<start:long,stop:long>>"), BYTES_BPE, rule).collect()
    mine = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.section)
    want, total = brute_counts(text, sections, rule)
    assert [r.n_tokens for r in mine] == pytest.approx(want)
    assert all(r.doc_tokens == total and r.uncovered == pytest.approx(total - sum(want)) for r in mine)
    assert [(r.n_tokens, r.doc_tokens) for r in got if r.doc_id == 2] == [(0, 0)]
    assert not [r for r in got if r.doc_id in (3, 4)] and len([r for r in got if r.doc_id is None]) == 1


def test_lines_share_out_all_tokens(spark):
    got = token_counts.count_lines(spark.createDataFrame(TEXTS, DOCS).selectExpr("*", "1 as start", "2 as section"), BYTES_BPE).collect()
    assert len(got) == sum((t or "").count("\n") + 1 for _, t in TEXTS)
    for i, t in TEXTS:
        mine = [r for r in got if r.doc_id == i]
        assert sum(r.n_tokens for r in mine) == sum({r.section: r.doc_tokens for r in mine if r.section == 0}.values()) * (2 if i == 10 else 1)
    assert token_counts.count_lines(spark.createDataFrame([], DOCS), BYTES_BPE).count() == 0


def test_overlapping_sections_stop_the_job(spark):
    rows = [(1, "abcdef", [{"start": 0, "stop": 3}, {"start": 2, "stop": 5}])]
    with pytest.raises(Exception, match="overlap"):
        token_counts.count_sections(spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<start:long,stop:long>>"), BYTES_BPE).collect()


# ---------------------------------------------------------------- HTML

VOCABULARY = [f"{a}{b}" for a in ("ta", "lo", "mer", "qui", "stan", "o", "ver") for b in ("nu", "ri", "s", "ble", "ck", "ion")]


@pytest.fixture(scope="module")
def trees():
    return html_text.train(VOCABULARY)


def extract(trees, *sources):
    forest = html_text.Forest([html_text.Page(s) for s in sources])
    return forest.main_texts(trees.margin(forest.features()))


def test_held_out_layouts(trees):
    right = total = 0
    for _, source in html_text.layouts(VOCABULARY, 200, seed=123):
        page = html_text.Page(source)
        want = " ".join(t.replace("\x01", "").replace("\x02", "") for t in page.text if "\x01" in t)
        right += extract(trees, source.replace("\x01", "").replace("\x02", ""))[0].split() == want.split()
        total += 1
    assert right >= 0.93 * total


def test_characters_spaces_and_markup(trees):
    body = "".join(f"<p>Some   words,\n here &amp; there&nbsp;&lt;b&gt; number {k}.<br>Next&#233; <b>bo</b>ld, yes.</p>" for k in range(4))
    page = f"<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>B</a></li></ul></nav><article><h1>Head line</h1>{body}<!-- <p>no</p> --><style>p{{}}</style></article><footer>&copy; 2024 Nobody</footer></body></html>"
    want = "Head line " + " ".join(f"Some words, here & there <b> number {k}. Nexté bold, yes." for k in range(4))
    assert extract(trees, page) == [want]


def test_no_text_below_a_rejected_node(trees):
    for _, source in html_text.layouts(VOCABULARY, 30, seed=5):
        page = html_text.Page(source)
        forest = html_text.Forest([page])
        margin = trees.margin(forest.features())
        reject = int(np.argmax(np.array(page.depth) == 1))
        margin[reject] = -1e6
        inside = {reject}
        for k in range(reject + 1, len(page.parent)):
            if page.parent[k] in inside:
                inside.add(k)
        kept = forest.main_texts(margin)[0]
        assert len(kept) <= sum(len(t) + 1 for k, t in enumerate(page.text) if k not in inside)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no markup at all"), (4, "u", "<div" * 50), (5, "u", "<script>never closed"), (None, "u", "</p></div>&bogus;<p>x"),
            (6, "u", "<div>" * 3000 + "deep"), (6, "u", "<div>" * 3000 + "deep"), (7, "u", "<a href='x>y'>z</a><p title=\"a>b\">t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = html_text.main_texts(df).collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert all(r.text == "" for r in got if r.page_id in (1, 2, 5))
    assert html_text.main_texts(df.limit(0)).count() == 0


# ---------------------------------------------------------------- vectors

def brute_links(rows, least):
    unit = []
    for _, v in rows:
        fine = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        v = np.array(v, np.float32).astype(float) if fine else None
        unit.append(v / np.linalg.norm(v) if fine else None)
    n = len(rows)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j])
              and rows[i][0] is not None and rows[j][0] is not None and unit[i] @ unit[j] >= least] for i in range(n)]
    comp = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in links[i]:
                if comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    same = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            same[i] = min(same.get(i, c), c)
    return [len(x) for x in links], comp


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for _ in range(25):
        base = rng.normal(size=12)
        for _ in range(int(rng.integers(1, 16))):
            rows.append((at, (base + rng.normal(size=12) * rng.choice([0, 0.05, 0.2, 0.35])).tolist()))
            at += 1
    rows += [(1000, rows[0][1]), (1001, [2 * x for x in rows[0][1]]), (1002, None), (1003, []), (1004, [0.0] * 12), (1005, [float("nan")] * 12),
             (1006, [float("inf")] + [0.0] * 11), (1007, [None] + [1.0] * 11), (1008, [1.0, 0.0]), (1009, [1.0, 0.1]), (1010, [0.0, 1.0]), (None, rows[0][1]), (1011, [1e-30] * 12), (1012, [1e30] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as rep", "3 as component").repartition(6)
    got = {r.vec_id: r for r in embedding.near_vectors(df).collect()}
    n, comp = brute_links(rows, 0.95)
    assert len(got) == len(rows) and sum(n) > 100
    for (i, _), links, c in zip(rows, n, comp):
        assert (got[i].n_links, got[i].component_id) == (links, c), i
        assert got[i].kept == (i is None or i == c)


def test_runs_of_a_block_lose_no_link(monkeypatch):
    monkeypatch.setattr(embedding, "RUN", 7)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 10))
    one, two = (embedding._unit(np.repeat(base, 5, axis=0) + rng.normal(size=(200, 10)) * 0.25) for _ in "ab")
    turn = np.linalg.qr(rng.normal(size=(10, 10)))[0]
    one, two = (x[np.lexsort(np.floor((x @ turn) / 0.3).T[::-1])] for x in (one, two))
    i, j = embedding.block_links(one, two, turn, 0.95, math.sqrt(0.1))
    want = set(zip(*np.nonzero(one @ two.T >= 0.95)))
    assert len(want) > 50 and set(zip(i, j)) == want


def test_box_pairs_lose_no_link(spark):
    """Blocks of boxes, paired level by level, against all pairs."""
    rng = np.random.default_rng(7)
    low = rng.normal(size=(90, embedding.BOXED)) * 0.3
    high = low + rng.uniform(0, 0.2, low.shape)
    rows = [(k, low[k].tolist(), high[k].tolist()) for k in range(90)]
    boxes = spark.createDataFrame(rows, "seq long, low array<double>, high array<double>")
    got = [(r.a, r.b) for r in embedding.block_pairs(boxes, 90, 0.9).collect()]
    gap = np.maximum(np.maximum(low[:, None] - high[None], low[None] - high[:, None]), 0)
    near = (gap**2).sum(axis=2) <= 0.81
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(90) for b in range(a, 90) if near[a, b]}


def test_no_vectors(spark):
    assert embedding.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embedding.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first().n_links == 0


# ---------------------------------------------------------------- components

def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (10, 11), (11, 10), (7, 7), (None, 1), (20, 12), (20, 13), (13, 30), (2, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 10: 10, 11: 10, 12: 12, 13: 12, 20: 12, 30: 12}
    chain = [(k, k + 1) for k in range(60)]
    random.Random(0).shuffle(chain)
    assert {r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pages_with_equal_ids_give_a_bounded_sample(spark, monkeypatch):
    """Null ids and urls hash alike: the words of at most 2 * SAMPLE_PAGES pages are learnt."""
    from barledger.llm import html_text

    seen = []
    real = html_text.train
    monkeypatch.setattr(html_text, "SAMPLE_PAGES", 3)
    monkeypatch.setattr(html_text, "train", lambda words: seen.append(words) or real(words))
    rows = [(None, None, f"<html><body><p>word{i}x</p></body></html>") for i in range(60)]
    found = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert found.count() == 60 and 0 < len(seen[0]) <= 6
