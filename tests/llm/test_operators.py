"""Small fixtures: odd rows, empty tables, clashing names, and brute force."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewise.llm import bpe, kernelscore, linededup, packing, quantisation, queries, secrets, simhash, textrules, urltree, warc

DOCS = "doc_id long, text string"
LONG = "A shared line that is certainly longer than forty code points, said twice.\n" + " ".join(f"Wörd{i % 977}." for i in range(30_000)) + "x" * 5_000
ODD = [
    (0, "Hello world, this is a text of some words that goes on for a while."), (1, None), (2, ""), (3, "   \n\t \x0b\x0c\r"),
    (4, LONG), (5, "Hello world, this is a text of some words that goes on for a while."), (6, "one"), (7, "one two"), (8, "ß İ Σ ÀÉ 漢字 🙂 e\u0301 \u00a0x\u3000y\x1cz"),
    (9, "a <|endoftext|> b 's't're don't 12345 ***!!! \n\n\n  x"), (10, "ONE two\n\nONE two\n"), (10, "ONE two\n\nONE two\n"),
    *[(20 + i, "  A shared line that is certainly LONGER than forty code points, said twice.\nown " + str(i)) for i in range(7)],
    (None, "A row without an id but with enough words to make some shingles of three."),
]
CLASH = "doc_id long, text string, score double, n_lines int, n_dropped int, findings int, host string, ids int, N_WORDS int, path string"
#: For operators that look at rows by id: no null, no repeated id.
PLAIN = [r for i, r in enumerate(ODD) if r[0] is not None and i != 11]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clash(spark):
    return spark.createDataFrame([(1, "some text of a few words", 9.0, 8, 7, 6, "h", 5, 4, "p"), (None, None, *[None] * 8)], CLASH)


# -- 1 ------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nContent-Length: 3\r\n\r\n"
    pages = [(5, "http://a/b", "same"), (2, "http://a/c?d#e", "same"), (9, None, "same"), (1, "", None), (3, "http://x\r\ny", ""), (4, "u", tricky), (6, "u", "é" * 70_000), (2, "again", "same"), (None, "n", "lone"), (None, "n", "lone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write(df, path)
    records = warc.read(spark, path).collect()
    assert collections.Counter(r.record_type for r in records) == {"request": 10, "metadata": 10, "response": 7, "revisit": 3}
    got = warc.assemble(warc.read(spark, path)).collect()
    # a capture's record id stems from its page id, so the repeated id is one capture
    rows = {(r.metadata.payload.decode().split("\r\n")[0], r.response.record_type): r for r in got}
    assert len(got) == 9 and all(r.request is not None and r.metadata is not None for r in got)
    assert bytes(rows["captureId: 4", "response"].response.payload) == tricky.encode()
    assert rows["captureId: 6", "response"].response.payload_bytes == 140_000
    assert rows["captureId: 9", "revisit"].response.refers_to == rows["captureId: 2", "response"].response.record_id
    assert rows["captureId: 3", "revisit"].response.refers_to == rows["captureId: 1", "response"].response.record_id
    assert all(r.response.declared_digest == r.response.payload_digest for r in got if r.response.record_type == "response")


def test_warc_reads_members_and_orphans(spark, tmp_path):
    def record(kind, rid, more, block):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n{more}Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    parts = [
        record("warcinfo", "<i>", "", b"software: x"), record("metadata", "<m1>", "WARC-Concurrent-To: <q1>\r\n", b"a: b\r\n"), record("request", "<q1>", "WARC-Concurrent-To: <r1>\r\n", b"GET / HTTP/1.1\r\n\r\n"),
        record("response", "<r1>", "", b"HTTP/1.1 200 OK\r\n\r\nbody"), record("metadata", "<m2>", "WARC-Concurrent-To: <gone>\r\n", b""),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    got = {r.capture_id: r for r in warc.assemble(warc.read(spark, str(tmp_path))).collect()}
    assert got["<r1>"].request.record_id == "<q1>" and got["<r1>"].metadata.record_id == "<m1>" and got["<r1>"].n_metadata == 1
    assert got["<gone>"].response is None and got["<i>"].request is None
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.parse(parts[0][:-8]))


def test_op1_returns_every_row_of_a_repeated_id(spark, tmp_path):
    pages = [(1, "u", "a"), (1, "v", "bb"), (1, "v", "bb"), (2, "w", "bb"), (3, "x", "a"), (3, "x", "ccc")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in queries.op1_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    want = [(1, 1, "response", None), (1, 2, "response", None), (1, 2, "response", None), (2, 2, "revisit", 1), (3, 1, "revisit", 1), (3, 3, "response", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_empty(spark):
    assert warc.write_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# -- 2 ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def trees(spark):
    return secrets.train(secrets.labelled_findings(spark, 3000))


def test_forest_on_unseen_findings(spark, trees):
    held = secrets.labelled_findings(spark, 2000, seed=77)
    f = held.select("label", F.array(*secrets.features(F.col("value"), F.col("before"), F.col("path"), trees.language)).alias("f"))
    right = f.select(((secrets.score(trees, lambda i: F.element_at("f", i + 1)) > 0.5).cast("int") == F.col("label")).alias("ok"))
    assert right.filter("ok").count() > 0.97 * 2000


def test_scan_and_redact(spark, odd, none, clash, trees):
    key = "3f9a1c77e0b2d4865a1f0c9e8d7b6a5544332211"
    rows = [(1, f'cfg token = "{key}" and again {key}.'), (2, "internationalizationandmore is a word"), (3, None), (4, ""), (5, f"{key}0 is not {key}"), (1, f'cfg token = "{key}" and again {key}.')]
    out = {}
    for r in secrets.redact(spark.createDataFrame(rows, DOCS), trees).collect():
        out[r.doc_id] = r
    assert out[1].text == 'cfg token = "<SECRET>" and again <SECRET>.' and out[1].n_secrets == 1
    assert out[2].text == rows[1][1] and out[3].text is None and out[4].text == ""
    assert secrets.redact(odd, trees).count() == len(ODD) and secrets.redact(none, trees).count() == 0
    found = secrets.findings(clash, trees, path_col="path")
    assert found.columns.count("findings") == 1 and found.count() == 2


def test_many_candidates_agree_with_python(spark, trees):
    rng = random.Random(4)
    keys = ["%040x" % rng.getrandbits(160) for _ in range(90)] + ["internationalization", "a-perfectly-ordinary-slug-of-words"]
    texts = ["".join(rng.choice(["token=", " é🙂 ", "\n", 'key: "', " "]) + rng.choice(keys) + rng.choice([" ", '"', ". ", "é"]) for _ in range(n)) for n in (1, 2, 63, 64, 65, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    redacted = {r.doc_id: r.text for r in secrets.redact(docs, trees).collect()}
    for r in secrets.findings(docs, trees).collect():
        text = texts[r.doc_id]
        seen = {}
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", text):
            seen.setdefault(m[0], []).append(m.start() + 1)
        assert [(c.value, c.position, c.occurrences) for c in r.findings] == [(v, at[0], len(at)) for v, at in seen.items()]
        gone = {c.value for c in r.findings if c.score > secrets.THRESHOLD}
        assert redacted[r.doc_id] == re.sub(r"[A-Za-z0-9+/_-]{16,}", lambda m: "<SECRET>" if m[0] in gone else m[0], text)


def test_every_occurrence_is_judged_in_its_surroundings(spark, trees):
    rng = random.Random(9)
    keys = ["%040x" % rng.getrandbits(160) for _ in range(20)]
    parts = [("sha1: ", " was seen.\n"), ('token = "', '"\n'), ("digest=", ";\n")]
    cases = [(k, [parts[j] for j in order]) for k in keys for order in ((0, 1), (1, 0), (0, 2, 1, 0), (0, 2))]
    docs = spark.createDataFrame([(i, "".join(f"{a}{k}{b}" for a, b in ps)) for i, (k, ps) in enumerate(cases)], DOCS)
    alone = spark.createDataFrame([(i * 10 + j, f"{a}{k}{b}") for i, (k, ps) in enumerate(cases) for j, (a, b) in enumerate(ps)], DOCS)
    one = {r.doc_id: r.findings[0].score for r in secrets.findings(alone, trees).collect()}
    redacted = {r.doc_id: r for r in secrets.redact(docs, trees).collect()}
    raised = 0
    for r in secrets.findings(docs, trees).collect():
        k, ps = cases[r.doc_id]
        (c,) = r.findings
        assert (c.value, c.position, c.occurrences) == (k, len(ps[0][0]) + 1, len(ps))
        assert c.score >= one[r.doc_id * 10]
        raised += c.score > secrets.THRESHOLD >= one[r.doc_id * 10]
        assert (k in redacted[r.doc_id].text) == (c.score <= secrets.THRESHOLD)
    assert raised == 40
    clean = [i for i, (_, ps) in enumerate(cases) if len(ps) == 2 and ps[1] == parts[2]]
    assert all(cases[i][0] in redacted[i].text for i in clean)


# -- 3 ------------------------------------------------------------------------


def _brute_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, cover = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            cover.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_statistics_against_brute_force(spark, odd, none, clash):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["a ", "b ", "a\n", "  ", "#é ", "\t", "漢 ", "\x0b"]) for _ in range(rng.randrange(60)))) for i in range(150)]
    for r in textrules.statistics(spark.createDataFrame(rows, DOCS).unionAll(odd)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _brute_counts(r.text), r.text
    assert textrules.statistics(none).count() == 0
    assert [c.lower() for c in textrules.statistics(clash).columns].count("n_words") == 1


def test_decision_list(spark, none):
    rng = random.Random(3)
    rows = [{"x": rng.random(), "y": rng.random(), "part": i % 3} for i in range(900)]
    rows = [r | {"keep": not (r["x"] > 0.8 or r["y"] < 0.1)} for r in rows]
    rules = textrules.cover(rows)
    wrong = sum(any(textrules._covers(rule, r) for rule in rules) == r["keep"] for r in rows)
    assert rules and wrong < 30 and textrules.cover([]) == [] and textrules.cover([r for r in rows if r["keep"]]) == []
    empty = textrules.statistics(none)
    assert textrules.learn(empty, spark.createDataFrame([], "doc_id long, quality int")) == []
    assert empty.select(textrules.verdict([]).alias("v")).count() == 0


# -- 4 ------------------------------------------------------------------------


def _vectors(n, dim=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    x[n // 3 : n // 2] = x[3]  # a large class of equal vectors
    return x


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_search_against_brute_force(spark, metric):
    x = _vectors(900)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [1.0, 2.0]), (980, [None] * 16), (None, x[0].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in quantisation.search(df, lambda i: F.pmod(i, F.lit(20)) == 0, k=10, metric=metric, base_block=200, query_block=16, rerank=120).collect():
        got[r.query_id].append((r["rank"], r.id, r.score))
    y, hit = x.astype(float), 0
    assert sorted(got) == list(range(0, 900, 20))
    for q in got:
        score = y @ y[q] if metric == "ip" else ((y - y[q]) ** 2).sum(1)
        order = [i for i in np.lexsort((np.arange(900), -score if metric == "ip" else score)) if i != q][:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and q not in [m[1] for m in mine]
        assert all(abs(s - score[i]) < 1e-9 for _, i, s in mine)
        hit += len({m[1] for m in mine} & set(order))
    assert hit / (10 * len(got)) > 0.9


def test_search_of_few_or_no_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one = lambda i: i == 0
    assert quantisation.search(make([]), one).count() == 0
    assert quantisation.search(make([(0, [1.0, 0.0])]), one).count() == 0
    got = quantisation.search(make([(0, [1.0, 0.0]), (7, [3e38, 1.0]), (5, [1.0, 0.0])]), one).collect()
    assert [(r["rank"], r.id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 7), (2, 5)]


def test_encoding_gets_closer_with_more_books():
    x = _vectors(600, seed=4)
    books = quantisation.fit(x, 8, 32)
    off = []
    for m in (1, 4, 8):
        codes, norm = quantisation.encode(x, books[:m], 4)
        made = sum(books[j][codes[:, j]] for j in range(m))
        off.append(((x - made) ** 2).sum())
        assert np.allclose((made**2).sum(1), norm, rtol=1e-3, atol=1e-3)
    assert off[0] > off[1] > off[2]


# -- 5 ------------------------------------------------------------------------


def test_classifier_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_quality(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_classifier_odd_rows(spark, odd, none, clash):
    stats = kernelscore.describe(odd)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    for labels, want in ((empty, 0.5), (spark.createDataFrame([(0, 1), (0, 0), (4, 1), (None, 0)], "doc_id long, quality int"), 1.0)):
        got = kernelscore.score(stats, kernelscore.fit(stats, labels)).collect()
        assert len(got) == len(ODD) and {r.score for r in got} == {want}
    model = kernelscore.fit(kernelscore.describe(none), empty)
    assert kernelscore.score(kernelscore.describe(none), model).count() == 0
    assert kernelscore.score_texts(clash, model).columns.count("score") == 1


def test_pooling_never_falls():
    x, y = kernelscore.pool([1, 2, 3, 4], [1, 1, 2, 1], [0, 1, 0, 1])
    assert list(y) == [0, 1 / 3, 1] and list(x) == [1, 8 / 3, 4]


# -- 6 ------------------------------------------------------------------------


def _check_packing(pieces, docs, path, window):
    whole, by = Tokenizer.from_file(path), collections.defaultdict(list)
    want = collections.Counter()
    for doc, text in docs:
        want[doc, tuple(whole.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    sequences = collections.defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and 0 < r.length <= window
    for (doc, ids), n in want.items():
        if n == 1:
            got = b"".join(bytes(r.ids) for r in sorted(by[doc], key=lambda r: r.start) if r.doc_tokens == len(ids))
            assert got == np.array(ids, "<u4").tobytes(), doc
    assert sum(r.length for r in pieces) == sum(len(i) * n for (_, i), n in want.items())
    padding, share = 0, max(1, window // 64)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        short = 0 if at & (at - 1) == 0 else window - at
        assert short <= share
        padding += short
    return padding


@pytest.mark.parametrize("window", [64, 2048])
def test_packing(odd, none, clash, window):
    path = public_tokenizers.path(queries.WORD_FILE)
    assert _check_packing(packing.pack(odd, path, window=window).collect(), ODD, path, window) <= 64 * window
    assert _check_packing(packing.pack(odd, path, window=window, max_open=2, round_tokens=500).collect(), ODD, path, window) <= 64 * window
    assert packing.pack(none, path).count() == 0 and packing.pack(clash, path).select("doc_id").distinct().count() == 2


@pytest.mark.parametrize("at_once", [25, 2_000_000])
def test_word_coder_agrees_with_the_tokenizer(at_once):
    path = public_tokenizers.path(queries.WORD_FILE)
    whole, own, rng = Tokenizer.from_file(path), packing.WordCoder(path), random.Random(3)
    own.AT_ONCE = at_once
    plain = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xC0, 0x180)]]
    wild = [*plain, *map(chr, range(0x180, 0x250)), *"İıſΣςσ中日\u0301\u0307’“—\xa0\u2003\x85\x1c\x00😀½²٣", "<|endoftext|>", "<|", "'s", "'LL", " 'RE"]
    texts = ["", "a" * 300, "1" * 100, "İx", "É'S'LL't"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for alphabet in (plain, wild) for _ in range(1500)]
    for text, raw in zip(texts, own.encode_batch(texts)):
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == whole.encode(text, add_special_tokens=False).ids, text


def test_placement_minimises_the_sum_of_squares():
    rng, w = random.Random(5), 20
    p = packing.Packer(w, max_open=10**9)
    for i in range(400):
        size = rng.randrange(1, w)
        before = p.levels.copy()
        p.add(i, b"\0" * 4 * size)

        def squares(h):
            n = before.copy()
            if h:
                n[h] -= 1
            if h + size < w:
                n[h + size] += 1
            return int((n[1:w] ** 2).sum())

        best = min(squares(h) for h in range(0, w - size + 1) if h == 0 or before[h])
        assert int((p.levels[1:w] ** 2).sum()) == best


def test_open_windows_are_bounded_and_go_fullest_first():
    p, gone = packing.Packer(64, max_open=50), []
    rng = random.Random(2)
    for i in range(2000):
        gone += p.add(i, b"\0" * 4 * rng.randrange(33, 60))
        spilled = p.spill()
        assert p.count <= 50 and all(sum(len(x[2]) for x in w) // 4 >= max((h for h in range(64) if p.open[h]), default=0) for w in spilled)
        gone += spilled
    gone += p.spill(all_=True)
    assert p.count == 0 and not p.levels.any() and sorted(x[0] for w in gone for x in w) == list(range(2000))


@pytest.mark.parametrize("fill", [1, 31, 700, 2015, 2016, 2047])
def test_windows_left_open_are_padded_or_cut(fill):
    raw = np.arange(fill, dtype="<u4").tobytes()
    pieces = [(1, 5, raw[: 4 * (fill // 3)], 9), (2, 0, raw[4 * (fill // 3) :], 9)]
    out = packing.finish([x for x in pieces if x[2]], 2048)
    assert b"".join(x[2] for s in out for x in s) == raw
    sizes = [sum(len(x[2]) for x in s) // 4 for s in out]
    assert sizes == [fill] if fill >= 2016 else all(n & (n - 1) == 0 for n in sizes)


def test_another_tokenizer_file_goes_through_the_whole_tokenizer(tmp_path):
    path = public_tokenizers.path(queries.WORD_FILE)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    other = text.replace('{"type":"Lowercase"}', '{"type":"Strip","strip_left":true,"strip_right":true}').replace('"type": "Lowercase"', '"type": "Strip", "strip_left": true, "strip_right": true')
    assert other != text
    (tmp_path / "other.json").write_text(other, encoding="utf-8")
    own, whole = packing.WordCoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not own.known and packing.WordCoder(path).known
    texts = ["Hello WORLD 12", "", "ABC'S"]
    assert [list(np.frombuffer(r, "<u4")) for r in own.encode_batch(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


# -- 7 ------------------------------------------------------------------------


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1?x", "https://example.net/de/2", "http://xexample.net/en/", "ftp://example.com/de/#/en", "b.example.com/de/", None, "http://", "x://org/fr/9", "http://a.org/fr", "http://h://k/z", "http://q?http://r/s"]
    df = spark.createDataFrame([(i, u, None, "old") for i, u in enumerate(urls)], "page_id long, url string, label int, host string")
    got = {r.page_id: r for r in urltree.judge(df, queries.URL_RULES).collect()}
    assert len(got) == len(urls)
    want = [("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/de/2", "net/", "block"), ("xexample.net", "/en/", "net/", "block"), ("example.com", "/de/", "example.com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "/fr/9", "org/fr/", "allow"), ("a.org", "/fr", None, "allow"), ("h:", "//k/z", None, "allow"), ("q", "", None, "allow")]
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == want
    assert urltree.judge(df.filter("false"), queries.URL_RULES).count() == 0


def test_tree_rejects_bad_templates(spark):
    rows = [(f"http://h/{kind}/{i}/{slug}", int(kind == "good")) for i in range(40) for kind in ("good", "spam", "junk") for slug in ("a", "b")]
    rows += [(f"http://h/{kind}/{900 + i}/zz", None) for i in range(5) for kind in ("good", "spam")] + [("http://h/good/1/a", 1)] * 3
    out = urltree.judge(spark.createDataFrame(rows, "url string, label int"), {})
    got = collections.Counter((re.search("good|spam|junk", r.url)[0], r.verdict) for r in out.collect())
    assert got == {("good", "allow"): 88, ("spam", "block"): 85, ("junk", "block"): 80}
    names = {r.template.split("/")[1] for r in out.collect()}
    assert names == {"good", "junk|spam"}
    many = spark.createDataFrame([(f"http://h/{chr(97 + i)}x", 1) for i in range(20)], "url string, label int")
    assert {r.template.split("/")[1] for r in urltree.judge(many, {}).collect()} == {"*"}


def _verdicts(spark, counted, **options):
    """Verdicts by the first segments of paths (start, good, bad, unlabelled)."""
    rows = [(f"http://h/{start}/{i}", label, start) for start, *counts in counted for label, n in zip((1, 0, None), counts) for i in range(n)]
    out = urltree.judge(spark.createDataFrame(rows, "url string, label int, start string"), {}, **options)
    return {r.start: r.verdict for r in out.select("start", "verdict").distinct().collect()}


def test_tree_keeps_supported_branches_at_any_width(spark):
    for width in (11, 12, 30):
        got = _verdicts(spark, [*((f"s{chr(97 + i)}", 100, 0, 1) for i in range(width)), ("spam", 0, 300 * width // 12, 5)])
        assert got.pop("spam") == "block" and set(got.values()) == {"allow"} and len(got) == width
    # thin branches fold into the wildcard and don't hide the one that stands
    got = _verdicts(spark, [*((f"u{chr(97 + i // 26)}{chr(97 + i % 26)}", 2, 0, 1) for i in range(60)), ("spam", 0, 40, 5)])
    assert got.pop("spam") == "block" and set(got.values()) == {"allow"}


def test_tree_follows_paths_to_their_ends(spark):
    for above in ("a/b/c/d", "blog/2024/01/02/en/x/y"):
        got = _verdicts(spark, [(f"{above}/good", 60, 0, 5), (f"{above}/spam/z", 0, 60, 5), (above, 3, 0, 0), ("short", 5, 5, 1)])
        assert got.pop(f"{above}/spam/z") == "block" and set(got.values()) == {"allow"}


def test_tree_is_not_bridged_by_branches_without_labels(spark):
    got = _verdicts(spark, [("about", 100, 0, 0), ("new", 0, 0, 5), ("spam", 0, 50, 2)])
    assert got == {"about": "allow", "new": "allow", "spam": "block"}


def _far(bad, n, other_bad, other_n, limit):
    if not n or not other_n:
        return False
    both = (bad + other_bad) / (n + other_n)
    return abs(bad / n - other_bad / other_n) > limit * (both * (1 - both) * (1 / n + 1 / other_n)) ** 0.5


def _brute_tree(rows):
    """Templates of (segments, label) rows of one host, by recursion over lists."""
    out = {}

    def settle(rows, template):
        for at, rest, _ in rows:
            out[at] = template + ("/*" if rest else "")

    def stands(rows, pos):
        branches = collections.defaultdict(lambda: [0, 0])
        for _, rest, label in rows:
            if len(rest) > pos and label is not None:
                branches[rest[pos]][label] += 1
        bad, good = (sum(c[i] for c in branches.values()) for i in (0, 1))
        limit = max(urltree.ALIKE, (2 * math.log(max(1, len(branches)))) ** 0.5)
        return {s: (g, b) for s, (b, g) in branches.items() if s != "*" and g + b >= urltree.SUPPORT and _far(b, g + b, bad - b, good + bad - g - b, limit)}

    def grow(rows, template):
        good, bad = (sum(r[2] == x for r in rows) for x in (1, 0))
        longest = max((len(r[1]) for r in rows), default=0) if good and bad and good + bad > urltree.SUPPORT else 0
        pos, count = next(((p, c) for p in range(longest) if (c := stands(rows, p))), (0, {}))
        if not count:
            return settle(rows, template)
        settle([r for r in rows if len(r[1]) <= pos], template)
        template += "/*" * pos
        branches = collections.defaultdict(list)
        for at, rest, label in rows:
            if len(rest) > pos:
                branches[rest[pos]].append((at, rest[pos + 1 :], label))
        steps = collections.defaultdict(list)
        for s, (g, b) in count.items():
            steps[math.floor(b / (g + b) * urltree.STEPS + 0.5)].append(s)
        groups, sums = [], None
        for _, some in sorted(steps.items()):
            g, b = (sum(count[s][i] for s in some) for i in (0, 1))
            if groups and not _far(b, g + b, sums[1], sum(sums), urltree.ALIKE):
                groups[-1] += some
                sums = (sums[0] + g, sums[1] + b)
            else:
                groups.append(list(some))
                sums = (g, b)
        names = {}
        for group in groups:
            group.sort()
            name = "|".join(group[: urltree.NAMED]) + (f"|+{len(group) - urltree.NAMED}" if len(group) > urltree.NAMED else "")
            names |= dict.fromkeys(group, name)
        nodes = collections.defaultdict(list)
        for s, b in branches.items():
            nodes[names.get(s, "*")] += b
        for name, some in nodes.items():
            grow(some, f"{template}/{name}")

    grow([(i, list(segs), label) for i, (segs, label) in enumerate(rows)], "")
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_against_brute_force(spark, seed):
    rng, rows = random.Random(seed), []
    for host in range(4):
        share = {}
        words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(rng.choice([3, 9, 40]))]
        for _ in range(rng.choice([30, 300, 700])):
            segs = [rng.choice(words[: rng.choice([2, 40])]) for _ in range(rng.randrange(1, 13))] if rng.random() < 0.5 else ["deep"] * rng.randrange(1, 12) + [rng.choice(words)]
            bad = share.setdefault(segs[0], rng.choice([0, 0, 0.1, 0.9, 1]))
            label = None if rng.random() < 0.2 or segs[0] == words[0] else int(rng.random() >= bad)
            rows.append((host, f"http://h{host}/{'/'.join(segs)}", segs, label))
    df = spark.createDataFrame([(i, u, l) for i, (_, u, _, l) in enumerate(rows)], "at long, url string, label int")
    got = {r.at: (r.template, r.verdict) for r in urltree.judge(df, {}).collect()}
    for host in range(4):
        own = [i for i, r in enumerate(rows) if r[0] == host]
        want = _brute_tree([rows[i][2:] for i in own])
        sums = collections.defaultdict(lambda: [0, 0])
        for j, i in enumerate(own):
            if rows[i][3] is not None:
                sums[want[j]][rows[i][3]] += 1
        for j, i in enumerate(own):
            bad, good = sums[want[j]]
            assert got[i] == (want[j], "block" if (good + 4) / (good + bad + 5) < 0.5 else "allow")


def test_tree_of_two_sections_and_one_unlabelled_url(spark):
    got = _verdicts(spark, [("good", 200, 0, 0), ("bad", 0, 200, 0), ("mid", 0, 0, 1)])
    assert got == {"good": "allow", "bad": "block", "mid": "allow"}


def test_tree_keeps_columns_and_takes_long_urls(spark):
    long = "http://h/" + "/".join(["x"] * 3_000)
    rows = [(f"{long}/{kind}/{i}", label, "mine") for kind, label in (("ok", 1), ("spam", 0)) for i in range(12)] + [("http://h/" + "y" * 100_000, None, "mine")]
    out = urltree.judge(spark.createDataFrame(rows, "url string, label int, segs string"), {})
    assert out.columns[:3] == ["url", "label", "segs"] and {r.segs for r in out.select("segs").collect()} == {"mine"}
    got = collections.Counter((r.url.split("/")[-2], r.verdict) for r in out.collect())
    assert got["ok", "allow"] == 12 and got["spam", "block"] == 12


# -- 8 ------------------------------------------------------------------------


def _brute_print(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints(odd):
    for r in simhash.fingerprints(odd).join(odd.select("doc_id", "text"), F.col("id").eqNullSafe(F.col("doc_id"))).collect():
        assert r.fp & (2**64 - 1) == _brute_print(r.text)


def _brute_roots(codes, bits):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(codes))]


def _clustered(n, seed):
    """Codes near one another, chains of them, and codes far away."""
    rng, out = random.Random(seed), set()
    while len(out) < n:
        code = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 40])):
            out.add(code)
            for _ in range(rng.randrange(1, 4)):
                code ^= 1 << rng.randrange(64)
    return sorted(out)[:n]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(seed):
    codes = _clustered(400, seed)
    label = simhash.trie_forest(np.zeros(len(codes), np.int64), np.array(codes, np.uint64), 3)
    assert list(label) == _brute_roots(codes, 3)


@pytest.mark.parametrize("max_group", [1_000_000, 5])
def test_links_and_components(spark, max_group):
    codes = _clustered(250, 9)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), 3, max_group)
    got = {r.node & (2**64 - 1): r.root for r in simhash.components(edges).collect()}
    groups = collections.defaultdict(set)
    for c, root in zip(codes, _brute_roots(codes, 3)):
        groups[root].add(c)
    for members in groups.values():
        if len(members) > 1:
            assert len({got[m] for m in members}) == 1
        else:
            assert not members & got.keys()


def test_cluster_and_dedup(spark, odd, none):
    got = [(r.id, r.component_id) for r in simhash.cluster(odd).collect()]
    assert len(got) == len(ODD) and dict(got)[5] == 0 and dict(got)[2] == dict(got)[3] == 1
    kept = simhash.dedup(odd.withColumn("fp", F.lit(1)), 3, 3)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 12) == [0, 1, 4, 6, 7, 8, 9, 10]
    assert kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id = 10").count() == 1
    assert simhash.cluster(none).count() == 0 and simhash.dedup(none).count() == 0


def test_dedup_of_repeated_ids(spark):
    rng = random.Random(6)
    one, two, three = (" ".join(f"w{rng.getrandbits(30)}" for _ in range(60)) for _ in range(3))
    # texts of one id, neither a copy of the other; then one that copies a smaller id's; then plain ones
    rows = [(5, one), (5, two), (5, two), (7, three), (8, three), (8, "quite other words that stand alone"), (9, one), (None, two)]
    for order in (rows, rows[::-1]):
        kept = simhash.dedup(spark.createDataFrame(order, DOCS).repartition(3))
        assert sorted(map(tuple, kept.collect()), key=str) == sorted([(5, one), (5, two), (7, three), (8, rows[5][1]), (None, two)], key=str)


# -- 9 ------------------------------------------------------------------------


def test_bpe(spark, odd, none, clash):
    path = public_tokenizers.path(queries.BPE_FILE)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert len(coded) == len(ODD)
    for r in coded:
        assert list(r.ids) == own.encode_ordinary(r.text or "") and bytes(r.raw) == (r.text or "").encode()
    assert len(bpe.pieces(LONG)) > 5 and "".join(bpe.pieces(LONG)) == LONG
    assert [i for p in bpe.pieces(LONG, 50) for i in own.encode_ordinary(p)] == own.encode_ordinary(LONG)
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode(clash, path, public_tokenizers.PATTERN).columns.count("ids") == 1


def test_bpe_of_long_white_space(spark):
    path = public_tokenizers.path(queries.BPE_FILE)
    own = bpe.coder(path, public_tokenizers.PATTERN)
    runs = [" ", "\n", "\t\u3000 \x85\n", "\x1c ", "\r\n"]
    shorter = [before + (run * n)[:n] + after for run in runs for n in (999, 1000, 1001, 5000) for before in ("", "x", "é.") for after in ("", "y", "'s", "1", "!", "\x1c")]
    for text in shorter:
        assert bpe.encode_text(own, text) == own.encode_ordinary(text)
    texts = [a + (run * 1_000_000)[:1_000_000] + b for run in runs for a, b in (("", ""), ("x", "y"))]
    out = bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), DOCS), path, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.raw) == texts[r.doc_id].encode() and len(r.ids_text.split()) == r.n_tokens for r in out) and len(out) == len(texts)


def test_bpe_with_another_pattern_cuts_nothing():
    path = public_tokenizers.path(queries.BPE_FILE)
    own = bpe.coder(path, r"[a-z ]+|[^a-z ]+")
    text = "a b " * 20_000 + " " * 3_000
    assert bpe.encode_text(own, text) == own.encode_ordinary(text)


# -- 10 -----------------------------------------------------------------------


def _brute_lines(docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\r\x0b\x0c"))
    holders = collections.defaultdict(list)
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(i)
    out = collections.Counter()
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 5 and i != max((h for h in holders[key(x)] if h is not None), default=None))]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize(("shard_keys", "probes"), [(1 << 17, 1 << 20), (2, 1 << 20), (2, 3), (1 << 17, 1)])
def test_line_dedup(spark, odd, shard_keys, probes):
    extra = [(100 + i, "é" * 40 + "\n" + "É" * 40 + "\n" + "è" * 39) for i in range(6)]
    docs = odd.unionAll(spark.createDataFrame(extra, DOCS))
    got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in linededup.dedup_lines(docs, shard_keys=shard_keys, probes=probes).collect())
    assert got == _brute_lines(ODD + extra)


def test_line_dedup_edges(none, clash):
    assert linededup.dedup_lines(none).count() == 0
    out = linededup.dedup_lines(clash)
    assert out.columns.count("n_lines") == 1 and {r.n_lines for r in out.collect()} == {1}


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    own = linededup.PerfectHash(keys)
    assert own.size == len(keys) and sorted(own.slots(keys)) == list(range(len(keys)))
    shard = linededup.Shard(keys, keys ^ np.uint64(5), np.full(len(keys), 7), np.arange(len(keys)))
    for own in (shard, linededup.Shard.load(shard.dump())):
        count, keeper = own.probe(keys, keys ^ np.uint64(5))
        assert (count == 7).all() and (keeper == np.arange(len(keys))).all() and not own.probe(keys, keys)[0].any()
    assert (linededup.PerfectHash(keys[:0]).slots(keys) == -1).all()


def test_digest_is_base32(spark):
    got = spark.createDataFrame([(t or "",) for _, t in PLAIN], "t string").select("t", warc.sha1_base32(F.col("t").cast("binary")).alias("d")).collect()
    assert all(r.d == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in got)
