"""Registered queries on a small fixture against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from test_operators import _brute_counts, _brute_tree
from tokenizers import Tokenizer

from tablewise.llm import bpe, kernelscore, packing, queries, secrets, textrules, urltree
from tablewise.llm.common import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
KEY = "3f9a1c77e0b2d4865a1f0c9e8d7b6a5544332211"
TEXTS = [None, "", " \n\t", "one", "Two words", "a b c d e a b c d e\na b\na b\n", " " * 5_000 + "x", "word " * 9_000, "É ß 漢字 🙂 <|endoftext|> x\x1cy", f"sha1: {KEY} was seen.\ntoken = \"{KEY}\"\n", "api_key = 'internationalization-and-more'"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Documents of the smallest tables, odd ones, and copies; vectors and labels."""
    at = tmp_path_factory.mktemp("sf")
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "source").limit(120).collect()]
    rows += [(10_000 + i, t, "odd") for i, t in enumerate(TEXTS)] + [(20_000 + i, rows[i][1] + (" more" if i % 2 else ""), "copy") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], int((r[1] or "").count("#") + (r[1] or "").count("|") < 3)) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    x = np.random.default_rng(3).normal(size=(500, 8)).astype(np.float32)
    x[400:450] = x[7]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (520, [0.0] * 8)], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    pages = [(r.page_id, r.url, r.html) for r in table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "url", "html").collect()]
    pages += [(30_000 + i, f"http://Odd.example/{'spam' if i % 2 else 'ok'}/{i}", "<p>" + ("### $$$ !!!" if i % 2 else "plain words") + "</p>") for i in range(120)]
    pages += [(40_000 + i, u, None) for i, u in enumerate([None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.NET/en/1#x", "x://b.example.com/de/", "x://org?/fr/"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at), {r[0]: r[1] for r in rows}, x


def _parts(spark, ids, salt, size):
    """What Spark's hash deals each id to."""
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    return {r.id: r.at for r in df.select("id", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(size)).alias("at")).collect()}


def _brute_features(value, before, path, own):
    """The features of a candidate, in Python."""
    n, flags = len(value), re.ASCII
    gone = lambda signs: sum(len(m[0]) for m in re.finditer(signs, value)) / n
    place = lambda c: ord(c) - 97 if "a" <= c <= "z" else 26
    codes = [place(c) for c in value.lower()]
    known = lambda w: all(own.bitmap[(at := xxhash.xxh64_intdigest(w, 42) >> bit & secrets.DICTIONARY_BITS - 1) // 6] >> at % 6 & 1 for bit in (0, 32))
    words = [w for w in re.findall("[A-Z]?[a-z]{2,}|[A-Z]{3,}", value) if len(w) >= 3 and known(w.lower())]
    says = lambda pattern, text: float(bool(re.search(pattern, text, flags)))
    return [
        min(n, 128), gone("[0-9]"), gone("[A-Z]"), gone("[a-z]"),
        sum(own.transitions[27 * a + b] for a, b in zip(codes, codes[1:])) / max(1, n - 1), len(set(value)) / min(n, 40),
        sum(map(len, words)) / n, says("^([0-9a-f]+|[0-9A-F]+)$", value), gone("[aeiouAEIOU]"), gone("[+/_-]"), gone(r"(.)\1\1+"),
        says(secrets._KEY_WORDS, before), says(secrets._DECOY_WORDS, f"{before} {value}"), says("[=:]\\s*[\"']?$", before), says("[\"']$", before),
        says("^(AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-|AIza|glpat-)", value), says(secrets._DECOY_PATHS, path),
        gone("0123|1234|2345|3456|4567|5678|6789|abcd|bcde|cdef|qwer|asdf"),
        len(re.findall("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])", value)) / n,
    ]


def test_op2(spark, sf):
    at, texts, _ = sf
    docs = table(spark, at, "documents")
    model, path = secrets.model_of(docs), {r.doc_id: r.source for r in docs.collect()}
    words = collections.Counter(w for t in texts.values() for w in re.split("[^a-z]+", (t or "").lower()) if 2 <= len(w) <= 32)
    pairs, total = collections.Counter(), sum(words.values())
    for w, n in words.items():
        for i in range(len(w) + 1):
            pairs[f"^{w}^"[i : i + 2]] += n
    common = sorted((w for w, n in words.items() if n * secrets.WORD_SHARE >= total and len(w) >= 3), key=lambda w: (-words[w], w))
    assert model.language == secrets._language(common, pairs)

    def vote(tree, f):
        return tree if isinstance(tree, float) else vote(tree[2] if f[tree[0]] <= tree[1] else tree[3], f)

    want = {}
    for i, text in texts.items():
        for m in re.finditer("[A-Za-z0-9+/_-]{16,}", text or ""):
            f = _brute_features(m[0], text[max(0, m.start() - 32) : m.start()], path[i] or "", model.language)
            score = sum(vote(t, f) for t in model.trees) / len(model.trees)
            first, often, best = want.get((i, m[0]), (m.start() + 1, 0, 0.0))
            want[i, m[0]] = (first, often + 1, max(best, score))
    rows = queries.op2_secrets(spark, at).collect()
    got = {(r.doc_id, r.candidate): r for r in rows}
    assert len(rows) == len(got) and set(got) == set(want)
    for key, (first, often, score) in want.items():
        r = got[key]
        assert (r.position, r.occurrences, r.is_secret) == (first, often, score > secrets.THRESHOLD), key
        assert abs(r.score - score) < 1e-9, key
    assert {r.candidate: r.is_secret for r in rows if r.doc_id > 10_000}[KEY]


def test_op3(spark, sf):
    at, texts, _ = sf
    counts = {i: _brute_counts(t) for i, t in texts.items()}
    failed = {i: c[0] < 10 or 100 * c[4] > 20 * c[0] for i, c in counts.items()}
    labels = {r.doc_id: r.quality for r in table(spark, at, "labels").collect()}
    per = lambda x, n: x / n if n else 0.0
    traits = {}
    for i, (n, chars, symbols, dup, repeat) in counts.items():
        text = texts[i] or ""
        words = WORDS.findall(text)
        traits[i] = {
            "words": float(n), "word_length": per(chars, n), "symbols_a_word": per(symbols, n), "marks_a_word": per(len(re.findall("[!?]", text)), n),
            "upper_share": per(len(re.findall("[A-Z]", text)), chars), "dup_lines_a_word": per(dup, n), "repeated": per(repeat, n),
            "twins": per(sum(a == b for a, b in zip(words, words[1:])), n),
        }
    parts = _parts(spark, texts, "rules", 3)
    rules = textrules.cover([f | {"keep": labels[i] == 1, "part": parts[i]} for i, f in traits.items() if not failed[i]])
    assert rules
    holds = lambda f, rule: all(f[x] <= t if op == "<=" else f[x] > t for x, op, t in rule)
    rows = queries.op3_rules(spark, at).collect()
    assert len(rows) == len(texts) and {r.kept for r in rows if not r.base_failed} == {True, False}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*counts[r.doc_id], failed[r.doc_id])
        assert r.kept == (not failed[r.doc_id] and not any(holds(traits[r.doc_id], rule) for rule in rules))


def test_op5(spark, sf):
    at, texts, _ = sf
    labels = {r.doc_id: r.quality for r in table(spark, at, "labels").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    stats = {i: np.array(kernelscore.statistics(t), np.float32).astype(float) for i, t in texts.items()}
    apart = _parts(spark, texts, "calibrate", 5)
    known = [i for i in texts if not out[i]]
    x = np.array([stats[i] for i in known])
    model = kernelscore.Model(x.mean(0), np.where(x.std(0) == 0, 1.0, x.std(0)))
    # ridge by least squares of the rows themselves, no normal equations
    fit = [i for i in known if apart[i]]
    z, y = model.features(np.array([stats[i] for i in fit])), np.array([labels[i] for i in fit], float)
    ridge = math.sqrt(kernelscore.RIDGE * len(fit)) * np.eye(z.shape[1])
    model.weights = np.linalg.lstsq(np.vstack([z, ridge]), np.r_[y, np.zeros(len(ridge))], rcond=None)[0]
    bins = collections.defaultdict(list)
    for i in known:
        if not apart[i]:
            raw = model.raw(stats[i][None])[0]
            at_bin = int((raw - kernelscore._LOW) / (kernelscore._HIGH - kernelscore._LOW) * kernelscore.BINS)
            bins[min(max(at_bin, 0), kernelscore.BINS - 1)].append((raw, labels[i]))
    steps = [np.array(b) for _, b in sorted(bins.items())]
    mean = lambda a, b: np.concatenate(steps[a : b + 1])[:, 1].mean()
    # isotonic means, each as the largest over starts of the smallest over ends
    level = [max(min(mean(a, b) for b in range(k, len(steps))) for a in range(k + 1)) for k in range(len(steps))]
    place, value = [], []
    for v in dict.fromkeys(round(v, 12) for v in level):
        some = np.concatenate([s for s, u in zip(steps, level) if round(u, 12) == v])
        place.append(some[:, 0].mean())
        value.append(v)
    rows = queries.op5_quality(spark, at).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = float(np.interp(model.raw(stats[r.doc_id][None])[0], place, value))
        assert r.held_out == out[r.doc_id] and abs(r.score - want) < 1e-5 and r.predicted == (r.score >= 0.5)


def test_op7(spark, sf):
    at = sf[0]
    pages = {r.page_id: r for r in table(spark, at, "pages").collect()}
    trees, seen = collections.defaultdict(list), {}
    for i, r in pages.items():
        rest = (r.url or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [u for u in queries.URL_RULES if (host == u.partition("/")[0] or host.endswith("." + u.partition("/")[0])) and path.startswith("/" + u.partition("/")[2])]
        seen[i] = (host, path, max(fits, key=len, default=None))
        body = re.sub("(?s)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>", " ", r.html or "")
        junk = len(re.findall("[#*$%|!]", body)) > 0.02 * len(body)
        label = None if zlib.crc32(str(i).encode()) % 3 == 1 else int(not junk)
        trees[host].append((i, re.sub("[0-9]+", "<n>", path).split("/")[1:], label))
    verdict = {}
    for rows in trees.values():
        template, sums = _brute_tree([r[1:] for r in rows]), collections.defaultdict(lambda: [0, 0])
        for k, (_, _, label) in enumerate(rows):
            if label is not None:
                sums[template[k]][label] += 1
        for k, (i, _, _) in enumerate(rows):
            bad, good = sums[template[k]]
            verdict[i] = "block" if (good + 4) / (good + bad + 5) < 0.5 else "allow"
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op7_urls(spark, at).collect()}
    assert got == {i: (*s, queries.URL_RULES.get(s[2], verdict[i])) for i, s in seen.items()}
    assert any(v == "block" and not seen[i][2] for i, v in verdict.items())


def test_op4(spark, sf):
    at, _, x = sf
    got = collections.defaultdict(list)
    for r in queries.op4_ann(spark, at).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    y, hits = x.astype(float), 0
    assert sorted(got) == list(range(0, 500, 20))
    for q, found in got.items():
        score = (y * y[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(500), -score)) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - score[f[1]]) < 1e-12 for f in found)
        hits += len(set(want) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)


def test_op6(spark, sf):
    at, texts, _ = sf
    whole, rows, by = Tokenizer.from_file(public_tokenizers.path(queries.WORD_FILE)), collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op6_packing(spark, at).collect():
        rows[r.doc_id].append(r)
        by[r.sequence_id].append(r)
    for i, text in texts.items():
        ids, done = whole.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(rows[i], key=lambda r: r.start):
            assert r.start == done and r.doc_tokens == len(ids)
            done += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : done], "<u4").tobytes())
        assert done == len(ids)
    padding = total = 0
    for seq in by.values():
        size = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == size
            size += r.length
        assert 0 < size <= packing.WINDOW
        padding, total = padding + (0 if size & (size - 1) == 0 else packing.WINDOW - size), total + size
    assert padding < 0.01 * total


def test_op8(spark, sf):
    at, texts, _ = sf

    def print_of(text):
        words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return int(np.packbits(bits.sum(0) * 2 > len(grams), bitorder="little").view("<u8")[0]) if grams else 0

    prints = {i: print_of(t) for i, t in texts.items()}
    of = {i: i for i in prints}

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                of[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, at).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in prints}


def test_op9(spark, sf):
    at, texts, _ = sf
    path = public_tokenizers.path(queries.BPE_FILE)
    with open(path, "rb") as f:
        own = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(f.read()), special_tokens={})
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_bpe(spark, at).collect()}
    for i, text in texts.items():
        ids = own.encode_ordinary(text or "")
        assert got[i] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))
    assert len(got) == len(texts)
