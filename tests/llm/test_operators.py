import base64
import collections
import functools
import glob
import hashlib
import math
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import plain
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logveil.llm import byte_bpe, common, decontaminate, exact_dedup, language_id, line_quality, near_dedup, ppm, queries, site_style_tree, token_store, url_filter
from logveil.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
EDGES = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "Zoë sagt\tüber 10.1 €"), (5, "Zoë sagt\tüber 10.1 €"), (6, "wort " * 30_000), (7, "x" * 70_000), (None, "no id here at all"), (8, "\U0001f600\x00'LL it's 'twas")]


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with those used inside."""
    rows = spark.createDataFrame(EDGES, "doc_id long, text string")
    for name in ("id", "rep", "digest", "component_id", "score", "label", "n", "chunk", "ids"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


@pytest.fixture(scope="module")
def nothing(edges):
    return edges.limit(0)


# --- SQL ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, small, duck, name):
    assert plain(queries.QUERIES[name](spark, small).toPandas()) == plain(duck.sql(queries.ORACLE_SQL[name]).df())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


# --- hashes ---------------------------------------------------------------------------------------------------------


def test_hashes_of_equal_tokens_are_equal_wherever_they_stand():
    words, first = common.token_hashes([b"The cat", b"", b"a THE  cat\nThe", b"cat"])
    assert first.tolist() == [0, 2, 2, 6, 7]
    a, b = words[0], words[1]
    assert words[[0, 3, 5]].tolist() == [a] * 3 and words[[1, 4, 6]].tolist() == [b] * 3 and len(set(words.tolist())) == 3


def test_hashes_over_block_ends(monkeypatch):
    data = [" ".join(random.Random(k).choices(["alpha", "be", "c" * 40, "d"], k=200)).encode() for k in range(5)]
    whole, _ = common.token_hashes(data)
    monkeypatch.setattr(common, "HASHED_AT_ONCE", 64)
    assert (common.token_hashes(data)[0] == whole).all()


# --- 1 --------------------------------------------------------------------------------------------------------------


def test_ppm_base_and_counts(spark, small, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op1_ppm"](spark, small).collect()}
    tokens = {k: t.encode().lower().split() + [b""] for k, t in texts.items()}
    count = collections.Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
    total, kinds = sum(count.values()), len(count)
    for k, ws in tokens.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(k).encode()) % 10 == 0, len(ws), sum(count[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), rel=1e-9)


def brute_ppm(trained, order):
    """Distribution of the next byte after a context, from dictionaries of symbol counts."""
    tables = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in trained:
        q = b"\n" * order + t
        for i in range(order, len(q)):
            tables[order][q[i - order : i]][q[i]] += 1
    for k in range(order, 0, -1):
        for context, symbols in tables[k].items():
            tables[k - 1][context[1:]].update(symbols.keys())

    def distribution(context):
        """Over all 256 next bytes."""
        out, left = {}, 1.0
        for k in range(order, -1, -1):
            own = {s: n for s, n in tables[k].get(context[order - k :], {}).items() if s not in out}
            total = sum(own.values())
            out |= {s: left * (n - 0.5) / total for s, n in own.items()}
            if own:
                left *= 0.5 * len(own) / total
        free = 256 - len(out)
        return out | {s: left / free for s in range(256) if s not in out}

    return distribution


def spelled(text):
    return b"".join(w + b" " for w in text.encode().translate(FOLD).split(b" ") if w) + b"\n"


FOLD = bytes(ord(chr(k).lower()) if 65 <= k < 91 else 32 if 9 <= k < 14 else k for k in range(256))


@pytest.mark.parametrize(("chunk", "crowd"), [(150_000, ppm.CROWD), (5_000, 4_000)])
def test_ppm_score_equals_brute_force(spark, small, texts, monkeypatch, chunk, crowd):
    """In more than one part and chunk; then with texts cut to pieces, and crowded contexts of three, four and five bytes."""
    monkeypatch.setattr(ppm, "PART_BYTES", 100_000)
    monkeypatch.setattr(ppm, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(ppm, "CROWD", crowd)
    levels = []
    monkeypatch.setattr(ppm, "crowded", lambda *a, find=ppm.crowded: levels.append(find(*a)) or levels[-1])
    assert chunk > 100_000 or max(map(len, texts.values())) > 3 * chunk
    got = {r.doc_id: r.score for r in queries.QUERIES["op1_ppm"](spark, small).collect()}
    lines = {k: spelled(t) for k, t in texts.items()}
    distribution = functools.cache(brute_ppm([t for k, t in lines.items() if zlib.crc32(str(k).encode()) % 10], ppm.ORDER))
    assert all(sum(distribution(c).values()) == pytest.approx(1) for c in (b"\n" * 6, b"of the", b"\xff\xfe\xfd\xfc\xfb\xfa"))
    for k, t in lines.items():
        q = b"\n" * ppm.ORDER + t
        want = sum(math.log10(distribution(q[i : i + ppm.ORDER])[q[i + ppm.ORDER]]) for i in range(len(t)))
        assert got[k] == pytest.approx(want, rel=1e-6)
    assert sum(len(v) > 0 for v in levels) == (3 if crowd < 5_000 else 0)


def test_ppm_cuts_long_texts_behind_tokens():
    raw, size = ppm.canonical([b"aB  c\t" * 50, b"x" * 90])
    starts, before = ppm.cut(raw[: size[0]], 40)
    assert size.tolist() == [251, 92] and len(starts) == 7 and all(raw[a - 1] == ppm.GAP for a in starts[1:])
    assert ppm.cut(raw[size[0] :], 40)[0].tolist() == [0]  # one token
    pieces = [ppm.grams(raw[a:b], np.array([b - a]), 6, before[k : k + 1]) for k, (a, b) in enumerate(zip(starts, [*starts[1:], size[0]], strict=True))]
    assert np.concatenate(pieces).tolist() == ppm.grams(raw[: size[0]], size[:1], 6).tolist()


def test_ppm_of_a_long_text_is_that_of_its_pieces_together(spark, monkeypatch):
    """A text of 20 MB beside others: pieces of a chunk's size, one row, and the same score as in one chunk."""
    long = "".join(f"line {i % 977} of {i} words\n" for i in range(900_000))
    rows = spark.createDataFrame([(0, "before it"), (1, long), (2, "line 5 of 5 words"), (None, None)], "doc_id long, text string").coalesce(1)
    sizes = [r["size"] for r in ppm.chunk_table(rows.selectExpr("doc_id id", "true trained", "text")).select("size").collect()]
    assert len(sizes) > 4 and max(sizes) <= ppm.CHUNK_BYTES + 100
    got = ppm.score_documents(rows, F.lit(True)).orderBy("doc_id").collect()
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 1 << 30)
    one = ppm.score_documents(rows, F.lit(True)).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 2] and got[2].n_tokens == 5 * 900_000 + 1
    for a, b in zip(got, one, strict=True):
        assert a[:5] == b[:5] and a.base_score == pytest.approx(b.base_score) and a.score == pytest.approx(b.score, rel=1e-6)


def test_ppm_depends_on_word_order(spark):
    rows = spark.createDataFrame([(k, "one two three four five six") for k in range(5)] + [(9, "six five four three two one")], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score_documents(rows, F.col("doc_id") < 9).collect()}
    assert got[0].base_score == pytest.approx(got[9].base_score) and got[0].score > got[9].score + 1


def test_ppm_packs():
    for v in (np.zeros(0, np.uint64), np.array([3, 3, 7, 1 << 63], np.uint64), np.array([1.5, -2], np.float32)):
        assert ppm.unpack(ppm.pack(v), v.dtype.str).tolist() == v.tolist()


def test_ppm_beats_words_on_held_out_text(spark, small):
    for folder in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        held = queries.QUERIES["op1_ppm"](spark, folder).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
        assert held.s > held.b


def test_ppm_edges(edges, nothing):
    got = ppm.score_documents(edges, F.col("doc_id") < 8).collect()
    assert len(got) == len(EDGES) and all(r.score < 0 for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[6] == 30_001
    assert ppm.score_documents(nothing, F.lit(True)).count() == 0
    assert ppm.score_documents(edges, F.lit(False)).where("n_known > 0").count() == 0


# --- 2 --------------------------------------------------------------------------------------------------------------


def test_url_rules_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q", "http://example.net/EN/", "http://xexample.com/de/", "http://a.b.example.com/de/1#f", "https://org/fr/", "ftp://u@h.org:80/fr/", "http://net", "http://a.net?x", "http://a.net/", "x://y://z.net/", "http://é.net/ü"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, *urls])], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")

    def judge(url):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    for options in ({}, {"bits_per_rule": 1, "max_blocks": 1}):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.apply_rules(pages, rules, **options).collect()}
        assert got == {i: judge(u) for i, u in enumerate([*urls, *urls])}
    assert url_filter.apply_rules(pages, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == 2 * len(urls)
    assert url_filter.apply_rules(pages.limit(0), rules).count() == 0


def test_url_filter_has_false_positives_only_before_the_join(spark):
    """A filter full of bits passes everything; the join still decides."""
    rules = spark.createDataFrame([(f"h{i}.org", "/", "block") for i in range(3000)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://h{i}.org/x") for i in range(2900, 3100)], "page_id long, url string")
    assert url_filter.apply_rules(pages, rules, max_blocks=1).where("verdict = 'block'").count() == 100


# --- 3, 10 ----------------------------------------------------------------------------------------------------------


def brute_marginals(unary, pair):
    """By enumeration of all labellings."""
    n = len(unary)
    weight = np.zeros(n)
    total = 0.0
    for code in range(1 << n):
        labels = [(code >> i) & 1 for i in range(n)]
        w = math.exp(sum(u for u, y in zip(unary, labels, strict=True) if y) + sum(pair[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        total += w
        weight += [w * y for y in labels]
    return weight / total


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 5, 3, 1, 7]
    at = np.append(0, np.cumsum(sizes))
    unary, pair = rng.normal(size=at[-1]), rng.normal(size=(2, 2))
    got, expected = line_quality._forward_backward(unary, at, pair)
    for a, b in zip(at[:-1], at[1:], strict=True):
        assert got[a:b] == pytest.approx(brute_marginals(unary[a:b], pair))
    assert expected.sum() == pytest.approx(sum(s - 1 for s in sizes))


def test_pieces_are_linked():
    rng = np.random.default_rng(2)
    at = np.append(0, np.cumsum([1, 9, 3, 12, 4, 7]))
    unary, pair = rng.normal(size=at[-1]), rng.normal(size=(2, 2))
    whole, expected = line_quality._forward_backward(unary, at, pair)
    for piece in (1, 2, 3, 4, 5):
        got, again = line_quality._forward_backward(unary, at, pair, piece)
        assert got == pytest.approx(whole) and again == pytest.approx(expected)
    assert whole[at[3] : at[4]] == pytest.approx(brute_marginals(unary[at[3] : at[4]], pair))


def test_quality_slope():
    """The derivative of the enumerated likelihood of whole chains."""
    rng = np.random.default_rng(3)
    at = np.array([0, 2, 7, 8])
    z, y = rng.normal(size=(8, 2)).astype(np.float32), np.array([0, 0, 1, 1, 1, 1, 1, 0.0])

    def likelihood(theta):
        u, pair, out = (z @ theta[:2].astype(np.float32)).astype(float), theta[2:].reshape(2, 2), 0.0
        for a, b in zip(at[:-1], at[1:], strict=True):
            def weight(labels, a=a):
                return sum(u[a + i] for i, v in enumerate(labels) if v) + sum(pair[x, w] for x, w in zip(labels, labels[1:], strict=False))

            every = [[(code >> i) & 1 for i in range(b - a)] for code in range(1 << (b - a))]
            out += weight([int(v) for v in y[a:b]]) - math.log(sum(math.exp(weight(v)) for v in every))
        return out / len(y)

    theta = rng.normal(size=6)
    slope = line_quality.Likelihood(z, y, at).slope(theta)
    for k in range(6):
        step = np.eye(6)[k] * 1e-3
        assert -slope[k] == pytest.approx((likelihood(theta + step) - likelihood(theta - step)) / 2e-3, rel=1e-2, abs=1e-4)


def brute_lines(text):
    """Features of each line, counted byte by byte."""
    kinds = {**dict.fromkeys(range(32), "control"), 127: "control", **dict.fromkeys((9, 11, 12, 13, 32), "space"), **dict.fromkeys(range(65, 91), "upper")}
    kinds |= dict.fromkeys([*range(97, 123), *range(128, 256)], "lower") | dict.fromkeys(range(48, 58), "digit")
    kinds |= dict.fromkeys(b".,;:'\"-()", "stop") | {ord("|"): "bar", ord("!"): "mark", ord("?"): "mark"}
    lines, own = text.split(b"\n"), []
    for i, line in enumerate(lines):
        kind = [kinds.get(b, "other") for b in line]
        words = "".join("  " if k == "space" else chr(256 + b) for b, k in zip(line, kind, strict=True)).split()
        visible = max(1, len(line) - kind.count("space"))
        shares = [kind.count(k) / visible for k in ("upper", "lower", "digit", "stop", "bar", "mark", "other", "control")]
        repeated = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words) - 1)
        same = i > 0 and line == lines[i - 1] and len(line) > 0
        own.append([*shares, repeated, math.log1p(len(words)), min(visible / max(1, len(words)), 40) / 10, same, bool(line) and kind[-1] == "stop"])
    none = [0.0] * line_quality.OWN
    rows = [[*x, *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none)] for i, x in enumerate(own)]
    return np.array(rows, float), [max(1, len(line)) for line in lines]


def test_quality_query_against_brute_force(spark, small, texts):
    """Features, unary weights, forward-backward and the weighted mean of every document, one by one; the field itself is fitted."""
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    model = line_quality.fit(docs, labels.where(common.bucket("doc_id", 4) != 2))
    for r in queries.QUERIES["op3_line_quality"](spark, small).collect():
        x, weight = brute_lines(texts[r.doc_id].encode())
        score = np.clip((x - model.mean) / model.scale @ model.weight[:-1] + model.weight[-1], -30, 30)
        psi = [np.array([1.0, math.exp(u)]) for u in score]
        ahead, behind = [psi[0] / psi[0].sum()], [np.ones(2)]
        for p in psi[1:]:
            a = ahead[-1] @ np.exp(model.pair) * p
            ahead.append(a / a.sum())
        for p in reversed(psi[1:]):
            b = np.exp(model.pair) @ (p * behind[0])
            behind.insert(0, b / b.sum())
        good = [(a * b)[1] / (a * b).sum() for a, b in zip(ahead, behind, strict=True)]
        assert r.score == pytest.approx(np.average(good, weights=weight), abs=2e-3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7)


def test_quality_sample_is_bounded_by_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(50)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(line_quality, "train", lambda texts, labels: seen.append(len(texts)))
    line_quality.fit(docs, docs.selectExpr("doc_id", "1 as quality"), sample_bytes=1000)
    line_quality.fit(docs, docs.selectExpr("doc_id", "1 as quality"), sample=7)
    assert seen == [10, 7]


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op3_line_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.97 and got.count() == 1000


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (7, 0), (8, None), (None, 1)], "doc_id long, quality int")
    got = line_quality.judged(edges, labels).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert line_quality.judged(nothing, labels).count() == 0
    assert line_quality.judged(edges, labels.limit(0)).count() == len(EDGES)
    lines = line_quality.score_lines(edges, line_quality.train([], np.zeros(0)))
    assert lines.where("doc_id = 3").count() == 2


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = language_id.ByteNet(["a", "b"], depth=3, filters=2)
    x, y = rng.integers(97, 110, (4, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        p = net.probabilities(x).astype(np.float64)
        return -np.log(p[np.arange(4), y]).mean()

    grads = net.gradients(x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = p[at], 1e-2
        p[at], net._pairs = old + eps, None
        up = loss()
        p[at], net._pairs = old - eps, None
        down = loss()
        p[at], net._pairs = old, None
        assert (up - down) / (2 * eps) == pytest.approx(float(g[at]), rel=0.1, abs=1e-3)


def test_language_against_a_plain_convolution():
    """Every window of whole texts by sums over embeddings, then the mean by letters."""
    net = language_id.ByteNet(["a", "b", "c"], depth=3, filters=2)
    texts = [b"", b"ab 1", b"The quick brown fox", b"words and words " * 40, "Öl über Nötiges".encode()]
    names, score = net.predict(texts)
    for t, name, s in zip(texts, names, score, strict=True):
        low = t.lower()
        total, letters = np.zeros(3), 0
        for i in range(0, max(1, len(low)), language_id.WINDOW):
            e = net.embed[list(low[i : i + language_id.WINDOW].ljust(language_id.WINDOW, b"\0"))]
            pooled = []
            for f, b in zip(net.filter, net.bias, strict=True):
                conv = [sum(e[p + j] @ f[j] for j in range(len(f))) + b for p in range(len(e) - len(f) + 1)]
                pooled.append(np.maximum(np.max(conv, axis=0), 0))
            x = np.exp(np.hstack(pooled) @ net.out + net.out_bias)
            n = sum(c in b"abcdefghijklmnopqrstuvwxyz" or 0xC2 <= c < 0xF5 for c in low[i : i + language_id.WINDOW])
            total, letters = total + n * x / x.sum(), letters + n
        want = total / letters if letters else None
        assert (name, s) == (("und", 0.0) if want is None else (net.languages[int(want.argmax())], pytest.approx(want.max(), rel=1e-4)))


def test_language_edges(spark, edges, nothing):
    labelled = edges.withColumn("lang", F.when(F.col("doc_id") == 6, "de").when(F.col("doc_id") == 4, "en"))
    net = language_id.fit(labelled)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_languages(edges, net).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[6][0] == "de"
    assert language_id.predict_languages(spark.createDataFrame([(1, "123 €™"), (2, "日本")], "doc_id long, text string"), net).where("lang_pred = 'und'").count() == 1
    assert language_id.predict_languages(nothing, net).count() == 0 and language_id.fit(labelled.where("lang is null")) is None


# --- 4 --------------------------------------------------------------------------------------------------------------


def test_index_keeps_what_it_has_seen(spark, edges, nothing, monkeypatch):
    monkeypatch.setattr(common, "HOT", 1)
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    index = exact_dedup.DigestIndex(spark, buckets=3)
    want = {(1, 2, False), (2, 2, True), (5, 2, True), (None, 1, True)}
    assert want <= {(r.doc_id, r.group_size, r.kept) for r in index.add(edges, "first").collect()}
    new = spark.createDataFrame([(9, "a"), (10, "new"), (11, "new")], "doc_id long, text string")
    for _ in range(2):  # the second time is a replay
        assert {(r.doc_id, r.keep_id, r.kept) for r in index.add(new, "second").collect()} == {(9, 4, False), (10, 11, False), (11, 11, True)}
        assert want <= {(r.doc_id, r.group_size, r.kept) for r in index.add(edges, "first").collect()}
        index.compact()
    assert index.add(nothing, "third").count() == 0
    assert index.table().count() == len({t or "" for _, t in EDGES}) + 1
    index._register(f"{index.name}_new", index.version + 1, 2)  # as a compaction that was stopped
    index._write(index.table().limit(3), f"{index.name}_new", 2)
    again = exact_dedup.DigestIndex(spark, index.path)
    assert (again.buckets, again.table().count()) == (3, len({t or "" for _, t in EDGES}) + 1)
    again.compact(buckets=2)
    last = exact_dedup.DigestIndex(spark, index.path)
    assert (last.buckets, last.table().count()) == (2, len({t or "" for _, t in EDGES}) + 1)
    last.drop()
    assert not index._exists(index.path)


LATER = """
import sys
from pyspark.sql import SparkSession
from logveil.llm.exact_dedup import DigestIndex
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", sys.argv[2]).config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
rows = spark.createDataFrame([(20, "a"), (21, "b"), (22, "c"), (23, "c")], "doc_id long, text string")
out = DigestIndex(spark, sys.argv[1]).add(rows, "later")
print("GOT", sorted(tuple(r) for r in out.select("doc_id", "keep_id", "kept").collect()))
"""


def test_another_process_goes_on_with_the_index(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=3)
    index.add(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, text string"), "first").collect()
    said = subprocess.run([sys.executable, "-c", LATER, index.path, str(tmp_path / "other")], capture_output=True, text=True, cwd=os.environ["PYTHONPATH"].split(os.pathsep)[0], timeout=300, check=True)
    assert "GOT [(20, 1, False), (21, 3, False), (22, 23, False), (23, 23, True)]" in said.stdout
    assert {(r.batch, r["count"]) for r in index.table().groupBy("batch").count().collect()} == {("first", 2), ("later", 1)}


def test_joins_with_the_index_are_sorted_and_anti(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    plan = index.table().hint("merge").join(index.table().select("digest"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Exchange" not in plan.partition("Physical")[2]


def test_index_tells_repeated_rows_apart_by_key(spark):
    rows = spark.createDataFrame([(1, "x", 5), (1, "x", 7), (None, "x", 9), (None, "y", 3), (None, "y", 2)], "doc_id long, text string, row long")
    index = exact_dedup.DigestIndex(spark, buckets=2)
    assert {r.row for r in index.add(rows, "b", key_col="row").where("kept").collect()} == {7, 3}


# --- 5 --------------------------------------------------------------------------------------------------------------


def brute_tiles(text, item, least):
    text_free, item_free, out = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for a in range(len(text)):
            for b in range(len(item)):
                k = 0
                while a + k < len(text) and b + k < len(item) and text[a + k] == item[b + k] and text_free[a + k] and item_free[b + k]:
                    k += 1
                if k > best[2]:
                    best = (a, b, k)
        if best[2] < least:
            return out
        out.append(best)
        for k in range(best[2]):
            text_free[best[0] + k] = item_free[best[1] + k] = False


def test_tiling_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        text, item = [rng.choice("abc") for _ in range(rng.randrange(5, 40))], [rng.choice("abc") for _ in range(rng.randrange(5, 25))]
        words = decontaminate._numbered([" ".join(text).encode(), " ".join(item).encode()])
        assert decontaminate.tile(*words, 3) == brute_tiles(text, item, 3)
    words = decontaminate._numbered([b"same " * 20_000, b"same " * 200])
    assert decontaminate.tile(*words, 5) == [(0, 0, 200)]


def split_words(t):
    import re

    return re.findall("[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))


def brute_best(text, items, coverage=0.5):
    """The item of which a text has most, by tilings of all items."""
    words, best = split_words(text), None
    for key, item in items:
        own = split_words(item)
        if own and words:
            share = sum(t[2] for t in brute_tiles(words, own, min(5, len(own)))) / len(own)
            if share >= coverage and (best is None or (share, -key) > (best[0], -best[1])):
                best = share, key
    return best


def test_leaks_against_brute_force(spark, monkeypatch):
    """Repeated words, short items, reordered passages, rows without an id and ids with two texts."""
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 500)
    monkeypatch.setattr(common, "HOT", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(vocabulary[: 2 + k % 11], k=rng.choice([1, 3, 4, 5, 9, 20])))) for k in range(25)] + [(30, None), (31, ""), (32, "alone here words four")]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 30)))) for k in range(40)]
    rows += [(k, " ".join(p for p in sorted((split_words(items[rng.randrange(25)][1]) + ["and"] * 3) * 2, key=lambda _: rng.random()))) for k in range(40, 60)]
    rows += [(70, f"x {items[5][1]} y {items[9][1].upper()}"), (None, items[7][1]), (1, items[8][1]), (71, "so alone, HERE words: four it is"), (72, None), (73, "w1 " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("row", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id or -1, r.contaminated, r.item_id, round(r.coverage, 9)) for r in decontaminate.verdicts(docs, bench).collect())
    best = [(k, brute_best(t, [i for i in items if i[1]])) for k, t in rows]
    want = sorted((k or -1, b is not None, b and b[1], round(b[0], 9) if b else 0.0) for k, b in best)
    assert got == want and 5 < sum(w[1] for w in want) < len(want)


def test_leaks_are_found_in_any_order(spark, edges, nothing):
    words = [f"word{i}" for i in range(30)]
    item = " ".join(words)
    rows = [(1, "x y " + item.upper().replace(" ", ", ") + " z"), (2, " ".join(words[15:] + ["and"] + words[:15])), (3, " ".join(words[:12])), (4, None), (5, "q " * 50_000 + item)]
    docs = spark.createDataFrame(rows, "k long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "too short"), (11, item)], "item_id long, text string")
    got = {r.k: (r.item_id, round(r.coverage, 2), r.n_tiles) for r in decontaminate.verdicts(docs, bench, id_col="k").where("contaminated").collect()}
    assert got == {1: (7, 1.0, 1), 2: (7, 1.0, 2), 5: (7, 1.0, 1)}
    assert sorted((r.k, r.item_id, len(r.tiles)) for r in decontaminate.matches(docs, bench, id_col="k").collect()) == [(1, 7, 1), (1, 11, 1), (2, 7, 2), (2, 11, 2), (5, 7, 1), (5, 11, 1)]
    assert decontaminate.verdicts(edges, bench).where("not contaminated").count() == len(EDGES) and decontaminate.verdicts(nothing, bench).count() == 0
    assert decontaminate.verdicts(docs, bench.limit(0), id_col="k").where("contaminated").count() == 0


def test_every_leak_of_the_tables(spark, small, texts):
    got = {r.doc_id: (r.item_id, r.coverage) for r in queries.QUERIES["op5_decontaminate"](spark, small).where("contaminated").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    runs = {k: set(zip(*[split_words(t)[i:] for i in range(5)], strict=False)) for k, t in items}
    want = {}
    for k, t in texts.items():
        own = set(zip(*[split_words(t)[i:] for i in range(5)], strict=False))
        best = brute_best(t, [i for i in items if own & runs[i[0]]])
        if best:
            want[k] = best[1], best[0]
    assert got.keys() == want.keys() and all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)
    assert {k for k, t in texts.items() if any(i in t for _, i in items)} <= got.keys()


# --- 6, 9 -----------------------------------------------------------------------------------------------------------

PARTS = ["a", "b", "St", "re", "ve", "ll", "d", "'", " ", "  ", "\n", "\t", "\u3000", "\u00a0", "1", "²", "½", "!", "é", "中", "😀", "\r\n", "'s", "'LL", "don't", "e\u0301", "ß", "Ǆ", "\x85", "\u200b", "\x1c", "\0", "Σ", "İ", "K", "<|endoftext|>", ",", "."]


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(3)
    return ["", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(3000)), "x" * 3000 + "é" * 300]


def test_byte_bpe_against_the_library(mixed):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.ByteBPE(RANKS)
    ids, at = own.encode_texts([t.encode() for t in mixed])
    for i, t in enumerate(mixed):
        got = ids[at[i] : at[i + 1]].tolist()
        assert got == library.encode_ordinary(t) and own.decode(got) == t.encode()
        places = own.offsets(np.array(got, np.int32), np.array([0, len(got)]))
        cuts = [*places.tolist(), len(t.encode())]
        assert own.decode_texts(np.array(got, np.int32), places, np.array([0, len(got)])) == [t.encode()]
        assert [t.encode()[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] == [own.vocab[k] for k in got]


def test_byte_bpe_query(spark, small, texts):
    own = byte_bpe.coder(RANKS)
    for r in queries.QUERIES["op6_byte_bpe"](spark, small).collect():
        ids = own.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_byte_bpe_edges(edges, nothing):
    coded = byte_bpe.decode_documents(byte_bpe.encode_documents(edges, RANKS), RANKS)
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in coded.collect()) == sorted((k or 0, t or "") for k, t in EDGES)
    assert byte_bpe.encode_documents(nothing, RANKS).count() == 0
    broken = edges.sparkSession.sql("select 1L as doc_id, decode(unhex('61ff62'), 'utf-8') as t, cast(unhex('61FF62C3') as string) as text")
    assert [bytes(r.decoded).decode() for r in byte_bpe.decode_documents(byte_bpe.encode_documents(broken, RANKS), RANKS).collect()] == ["a\ufffdb\ufffd"]
    none = edges.sparkSession.sql("select 1L as doc_id, cast(null as array<int>) as ids, cast(null as array<int>) as offsets union all select 2L, array(64, 65), array(0, 1)")
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode_documents(none, RANKS).collect()} == {1: b"", 2: byte_bpe.coder(RANKS).decode([64, 65])}


def test_word_ids_against_the_library(mixed):
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    own = token_store.WordEncoder(WORDS)
    ids, at = own.encode([t.encode() for t in mixed])
    for i, t in enumerate(mixed):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_other_tokenizer_files_go_through_the_library(spark, tmp_path, mixed):
    import json

    with open(WORDS, encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"]["normalizers"].pop()  # keeps capitals
    path = f"{tmp_path}/other.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(told, f)
    assert token_store.splits_here(WORDS) and not token_store.splits_here(path)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    some = [*mixed[:200], "Capital Letters", ""]
    ids, at = token_store.WordEncoder(path).encode([t.encode() for t in some])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_token_store_query(spark, small, texts):
    library = Tokenizer.from_file(WORDS)
    start, got = 0, {r.doc_id: r for r in queries.QUERIES["op9_token_store"](spark, small).collect()}
    for k in sorted(texts):
        ids = [*library.encode(texts[k], add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, tmp_path, documents, encoding):
    import pyarrow.parquet as pq

    path = f"{tmp_path}/tokens"
    token_store.write_tokens(documents, WORDS, path, end_id=2, encoding=encoding, row_group_bytes=64 << 10, page_bytes=8 << 10)
    files = sorted((tmp_path / "tokens").glob("*.parquet"))
    ids = [i for f in files for i in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()]
    assert ids == sorted(ids) and len(ids) == documents.count()
    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(3)
    assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta") and column.has_offset_index
    part = token_store.read_tokens(spark, path, low=10, high=12)
    assert [r.doc_id for r in part.orderBy("doc_id").collect()] == [10, 11, 12]
    assert "PushedFilters: [IsNotNull(doc_id)" in part._jdf.queryExecution().toString() and "ids" not in token_store.read_tokens(spark, path, ids=False).columns


def test_token_edges(spark, tmp_path, edges, nothing):
    path = f"{tmp_path}/edges"
    token_store.write_tokens(edges, WORDS, path, end_id=2)
    got = token_store.with_starts(token_store.read_tokens(spark, path), token_store.read_tokens(spark, path, ids=False), parts=3).orderBy("doc_id", "start").collect()
    assert [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got]))[:-1].tolist()
    assert [r.doc_id for r in got][:3] == [None, 1, 2] and got[1].ids == [2] and len(got) == len(EDGES)
    assert token_store.encode_documents(nothing, WORDS).count() == 0


# --- 7 --------------------------------------------------------------------------------------------------------------


def brute_near(texts, percent):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(k for k in texts if sets[k])
    for i, a in enumerate(keys):
        for b in keys[:i]:
            few, many = sorted((len(sets[a]), len(sets[b])))
            if 100 * few >= percent * many and top(a) != top(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (few + many - both):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {k: (len(sets[k]), top(k)) for k in texts}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_all_pairs(documents, texts, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(documents, percent).collect()}
    assert got == brute_near(texts, percent)


def test_near_duplicates_in_crowded_regions(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWD", 8)
    monkeypatch.setattr(near_dedup, "SENT", 0)
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = {}
    for k in range(200):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 12])):
            words[rng.randrange(300)] = f"v{k}_{rng.randrange(10**6)}"
        texts[k] = " ".join(words if k % 2 else words[: rng.choice([300, 280, 150])])
    texts |= {200: "one two", 201: "ONE two", 202: "two one", 203: "", 204: None, 205: "one two three"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 85).collect()}
    assert got == brute_near(texts, 85)


def test_a_crowded_region_goes_deeper(spark, monkeypatch):
    """Pairs whose labels go on alike in a region that a thousand share by its root; slices by chance would part them."""
    monkeypatch.setattr(near_dedup, "CROWD", 8)
    rng = random.Random(3)
    rows = []
    for pair in range(120):
        tail = rng.randbytes(5) + bytes([pair])
        for k in range(2):
            others = rng.randbytes(2 * near_dedup.DEPTH * (near_dedup.TREES - 1))
            rows.append((2 * pair + k, 100, b"r" * (2 * near_dedup.ROOT) + tail + others))
    rows += [(1000 + k, 100, b"e" * 12 + rng.randbytes(2 * near_dedup.DEPTH * (near_dedup.TREES - 1))) for k in range(40)]  # equal labels
    frame = spark.createDataFrame(rows, "rep long, n_shingles long, sig binary")
    found = {(r.a, r.b) for r in near_dedup.candidates(frame).collect()}
    assert {(2 * p, 2 * p + 1) for p in range(120)} <= found and {(1000, 1000 + k) for k in range(1, 40)} <= found
    assert len(found) < 240 * 6


@pytest.mark.parametrize("bundle", [2000, 400])
def test_near_duplicates_of_a_star(spark, monkeypatch, bundle):
    """Thousands of variants that are near to their centre alone, whose id is in the middle."""
    monkeypatch.setattr(near_dedup, "BUNDLE", bundle, raising=False)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(300)]
    texts = {1500: " ".join(base)}
    for k in [*range(1500), *range(1501, 3001)]:
        words = list(base)
        for at in rng.sample(range(5, 295, 6), 3):
            words[at] = f"v{k}_{at}"
        texts[k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs, 85).collect()]
    assert sorted(got) == [(k, 0) for k in range(3001)]


def test_rows_that_repeat_an_id_keep_their_links(spark):
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    a, b = " ".join(word), " ".join(reversed(word))
    rows = spark.createDataFrame([(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, a)], "doc_id long, text string").withColumn("row", F.monotonically_increasing_id())
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(rows).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False)}
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    assert [r.doc_id for r in near_dedup.near_duplicates(rows, key_col="row").where("stays").collect()] == [1, 1]


def test_small_tables_are_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, what is known to be small is written by few tasks."""
    folders, fresh = [], common.shared_dir
    monkeypatch.setattr(common, "shared_dir", lambda s: folders.append(fresh(s)) or folders[-1])
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = common.written(spark.createDataFrame([(k, k + 1) for k in range(100) if k % 10], "a long, b long"))
        folders.clear()
        got = {(r.node, r.component) for r in components(path).collect()}
        assert got == {(k, k - (k - 1) % 10) for k in range(1, 101)}
        files = [len(glob.glob(f"{f}/part-*.parquet")) for f in folders]
        assert len(files) > 4 and max(files) == 1
        folders.clear()
        base = [f"w{k}" for k in range(60)]
        docs = [(k, " ".join(base[: 30 + k % 20] + [f"u{k // 20}_{i}" for i in range(40)])) for k in range(300)]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 85).collect()}
        assert got == brute_near(dict(docs), 85)
        files = [len(glob.glob(f"{f}/part-*.parquet")) for f in folders]
        assert sum(n > 4 for n in files) <= 1  # the list of shared shingles, whose size nothing tells before
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_near_duplicate_edges(edges, nothing):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(edges).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (5, 1, 5, True), (6, 1, 6, True), (7, 1, 7, True), (None, 1, None, False)} <= got
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(7, 7)]
    root = {k: k for a, b in links for k in (a, b)}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in link and link[0] != link[1] for link in links)}


# --- 8 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "html,blocks",
    [
        ("", []),
        ("plain &lt; text\n next", ["plain < text next"]),
        ("<p>a<p>b &amp; c<br>d<ul><li>e<li>f</ul>", ["a", "b & c d", "e", "f"]),
        ("<nav>x</nav><div class='side-bar ad'>y</div><div>z<script>if (a<b) '</div>'</script></div>", ["z"]),
        ("<article><header><h1>T</h1></header><p>x</p><section id=comments><p>no</p></section><form>q</form></article><footer>f", ["T", "x"]),
        ("<table><tr><td>1<td>2<tr><td>3</table><!-- c --><div hidden>h</div><div role=navigation>n", ["1", "2", "3"]),
        ("<div class='siteHeader header'>x</div><div role=main><div class=userComments>no</div><p>y</div><p>z", ["y"]),
        ("<article><p>Keep</p><div class='legal'>a</div><section id='search-trees'>b</section><div class='share-prices'>c</div></article>", ["Keep", "a", "b", "c"]),
        ("<main><h1>T</h1><article><p>long text</p></article><article><p>teaser</p></article></main><div>side</div>", ["T", "long text"]),
        ("<article><p>text of it</p><article><p>a reply</p></article><div class=comment-list>no</div><div class=menu-of-the-day>yes</div></article>", ["text of it", "yes"]),
        ("<article><p>a</p><section id='history-of-the-menu'>b</section><div class='second-notice'>c</div><section class='origin-of-the-banner'>d</section><p aria-hidden='true'>e <math><mi>x</mi></math></p></article>", ["a", "b", "c", "d", "e x"]),
        ("<article><p>a</p><div class='cookie-notice'>b</div><div class='site-footer'>c</div><div class='article-comments'>d</div></article>", ["a"]),
        ("<title>t</title><p title='a > b'>x &#233;&nbsp; y</p><![CDATA[z]]>", ["x é y", "z"]),
    ],
)
def test_blocks(html, blocks):
    assert site_style_tree.chosen(html, {}) == blocks


def test_template_inside_articles_goes(spark):
    """A branch of the article that is the same in all articles is a template; copies of one article are none."""
    page = "<nav>{0}</nav><article><h1>Title</h1><p>Text {0}</p><div class=legal>Law {0}</div><div class=more>Read our other texts</div></article>"
    rows = [(i, f"http://a.example.org/{i}", page.format(f"number {i}")) for i in range(8)] + [(20 + i, f"http://b.example.org/{i}", page.format("same")) for i in range(8)]
    got = {r.page_id: r.text for r in site_style_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text number {i}\nLaw number {i}" for i in range(8)} | {20 + i: "Title\nText same\nLaw same\nRead our other texts" for i in range(8)}


def test_importance_against_brute_force(spark):
    """Entropies of a tree merged with dictionaries, over hosts of mixed pages."""
    rng = random.Random(8)
    parts = ["<p>{}</p>", "<div class=legal>{}</div>", "<ul><li>{}<li>x</ul>", "<div id=c{}>same</div>", "<aside>{}</aside>"]
    pages = [(rng.choice("ab"), "<article>" * (rng.random() < 0.5) + "".join(p.format(rng.randrange(4)) for p in rng.choices(parts, k=rng.randrange(5)))) for _ in range(60)]
    merged = collections.defaultdict(set)
    for site, html in pages:
        elements, _ = site_style_tree.parse(html)
        for path, kind, value, holder in site_style_tree.node_rows(elements):
            merged[ord(site), path].add((kind, value, holder))

    def relative(values):
        n = len(values)
        return 1.0 if n == 1 else -sum(c / n * math.log(c / n) for c in collections.Counter(values).values()) / math.log(n)

    want = {k: tuple(relative([x for kind, x, _ in v if kind == j]) if any(kind == j for kind, _, _ in v) else 0.0 for j in (0, 1)) for k, v in merged.items()}
    want = {k: (c, p if sum(kind == 1 for kind, _, _ in merged[k]) > 1 else 0.0) for k, (c, p) in want.items()}
    rows = spark.createDataFrame([(ord(s), h) for s, h in pages], "site long, html string")
    got = {(r.site, r.path): (r.content, r.presentation) for r in site_style_tree.importance(site_style_tree.tree_nodes(rows)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert min(want.values())[0] < 0.3 and max(want.values())[0] > 0.9 and max(p for _, p in want.values()) > 0.5


def test_sliced_sites_give_the_same_text(spark, small, monkeypatch):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    want = {(r.page_id, r.text) for r in site_style_tree.main_text(pages).collect()}
    monkeypatch.setattr(site_style_tree, "SENT", -1)
    assert {(r.page_id, r.text) for r in site_style_tree.main_text(pages).collect()} == want


def _site(page, texts, host="s.example.org"):
    return [(i, f"http://{host}/{i}", page.format(menu=" ".join(t[:2]), ad=t[2], text="".join(f"<p>{w} {i} and more of it</p>" for w in t[3:]), i=i)) for i, t in enumerate(texts)]


def _texts_of(spark, rows, **how):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in site_style_tree.main_text(frame, **how).collect()}


@pytest.fixture(scope="module")
def varied():
    """Words of menus and adverts that differ on every page, and from one to nine paragraphs."""
    rng = random.Random(12)
    return [[f"m{rng.random()}", f"n{rng.random()}", f"buy {rng.random()}", *(f"words{rng.random()} are here" for _ in range(rng.randrange(2, 11)))] for _ in range(40)]


def _wanted(texts):
    return {i: "\n".join(f"{w} {i} and more of it" for w in t[3:]) for i, t in enumerate(texts)}


def test_the_tree_finds_undeclared_texts(spark, varied):
    """Nothing is declared, and no words return: only layouts tell the text from the menu, the advert and the foot of the page."""
    page = "<div class=a><ul><li>{menu}</li><li>x{i}</li></ul></div><div class=b>{ad}</div><div class=c>{text}</div><div class=d>end {i}</div>"
    assert _texts_of(spark, _site(page, varied)) == _wanted(varied)


def test_the_tree_overrules_declarations(spark, varied):
    """A teaser is declared the article, and the text stands in what is called a notice."""
    page = "<article><h2>{ad}</h2></article><div class=notice>{text}</div>"
    assert _texts_of(spark, _site(page, varied)) == _wanted(varied)
    assert _texts_of(spark, _site(page, varied[:1])) == {0: varied[0][2]}  # one page tells nothing


def test_the_tree_keeps_what_differs_inside_and_drops_what_never_does(spark, varied):
    page = "<article>{text}<div class=banner><ul><li>a{i}</li></ul></div><div class=kept>Always the same words</div></article><form>{text}</form>"
    assert _texts_of(spark, _site(page, varied)) == _wanted(varied)
    page = "<article><p>Of {i}</p><aside>{text}</aside></article>"
    assert _texts_of(spark, _site(page, varied)) == {i: f"Of {i}\n{t}" for i, t in _wanted(varied).items()}
    page = "<article><p>Of {i}</p><section id=comments>{text}</section></article>"
    assert _texts_of(spark, _site(page, varied)) == {i: f"Of {i}" for i in range(len(varied))}


def brute_texts(rows, declared=True):
    """Pages judged by a tree that is merged with dictionaries."""
    merged = collections.defaultdict(lambda: (set(), set()))
    for _, url, html in rows:
        for path, kind, value, holder in site_style_tree.node_rows(site_style_tree.parse(html)[0]):
            merged[url.split("/")[2], path][kind].add((value, holder))

    def relative(values, alone):
        n = len(values)
        return alone if n < 2 else -sum(c / n * math.log(c / n) for c in collections.Counter(v for v, _ in values).values()) / math.log(n)

    nodes = collections.defaultdict(dict)
    for (host, path), (texts, layouts) in merged.items():
        n, content, laid = len(texts), relative(texts, 1.0), relative(layouts, 0.0)
        if n > 1:
            evidence = (1 - 1 / n) * (0.5 - 4.5 * (1 - content) ** 8) + content * 2.0 * (1 - 1 / max(1, len(layouts))) * laid
            nodes[host][path] = (laid * (1 - 1 / n), evidence)
    return {i: "\n".join(site_style_tree.chosen(html, nodes[url.split("/")[2]], declared)) for i, url, html in rows}


@pytest.mark.parametrize("declared", [True, False])
def test_main_text_against_brute_force(spark, small, declared, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    want = brute_texts(rows, declared)
    assert _texts_of(spark, rows, declared=declared) == want
    monkeypatch.setattr(site_style_tree, "SENT", -1)
    assert _texts_of(spark, rows, declared=declared) == want


def test_a_very_long_page(spark):
    page = "<nav>m</nav><article>" + "".join(f"<p>paragraph {k} &amp; more</p>" for k in range(60_000)) + "</article>" + "<div>" * 3000
    assert _texts_of(spark, [(1, "http://l.org/", page)])[1].count("\n") == 59_999


def test_branches_alike_on_a_site_go(spark):
    rows = [(i, f"http://h.example.org/{i}", f"<div class='x'><div id=top>Same words here</div><div id=body><p>Text {i} of its own</p></div></div>") for i in range(9)]
    rows += [(9, "http://one.org/", "<div id=top>Same words here</div>"), (10, None, None), (11, "u", ""), (11, "u", "<article>a</article><p>b</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.text, r.n_chars) for r in site_style_tree.main_text(pages).collect()}
    want = {(i, f"Text {i} of its own", 17) for i in range(9)} | {(9, "Same words here", 15), (10, "", 0), (11, "", 0), (11, "a", 1)}
    assert got == want and site_style_tree.main_text(pages.limit(0)).count() == 0


def test_main_text_of_the_tables(spark, small):
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in queries.QUERIES["op8_main_text"](spark, small).collect():
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|li|ul|ol|div)\b[^>]*>", article)]
        assert r.text == "\n".join(filter(None, blocks))


# --- numbers and folders --------------------------------------------------------------------------------------------


def test_numbers_of_rows_follow_their_files(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 as k").repartition(5).write.parquet(f"{tmp_path}/rows with spaces")
    frame = spark.read.parquet(f"{tmp_path}/rows with spaces")
    got = {r.id: r.n for r in common.numbered(frame.select("id"), "n").collect()}
    assert len(set(got.values())) == 1000 and common.numbered(frame, "n").columns == ["id", "k", "n"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:  # in other parts
        assert {r.id: r.n for r in common.numbered(frame.where("k < 3"), "n").collect()} == {i: n for i, n in got.items() if i % 7 < 3}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    twice = frame.unionByName(frame)
    assert common.numbered(twice, "n").select("n").distinct().count() == 2000
    assert common.numbered(frame.limit(0), "n").count() == 0


def test_tracked_folders_go_when_nothing_reads_them(spark):
    import pathlib

    def there(df):
        return [pathlib.Path(f.removeprefix("file://")).exists() for f in df.inputFiles()[:1]] == [True]

    with common.tracked():
        a, b = common.written(spark.range(3)), common.written(spark.range(4))
    c = common.written(spark.range(5))
    common.cleared(b.where("id > 1"))
    assert not there(a) and there(b) and there(c)
    common.cleared(c)
    assert not there(b) and there(c)
