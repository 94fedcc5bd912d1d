"""Token counts, importance resampling and whitening against brute force and edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyglass.llm import resampling, token_counts, whitening
from tallyglass.llm.bpe import Vocabulary
from tallyglass.llm.queries import default_vocabulary

DOCS = "doc_id bigint, text string, n_tokens string, score string, n string"
TEXTS = [
    None, "", " ", "a", "A  b\n\n c", "It's we'll 123 4567", "naïve façade Ωmega 漢字仮名 🙂🙂 é", "<|endoftext|>", "x<|endoftext|>y<|endoftext|><|endoftext|> z",
    "<|endoftext", "zq" * 4000, "a" * 3001, " " * 999 + "end", "the cat sat " * 3000, "Unbreakable-words_with.punct!!! ??? \t\r\n tabs", "  wide　spaces",
]


def docs_of(spark, texts):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(None, "no id at all", "x", "y", "z"), (4, texts[4], "x", "y", "z"), (4, "another text of one id", "x", "y", "z")]
    return spark.createDataFrame(rows, DOCS)


def by_row(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# Token counts


def test_token_counts_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "LISTED", 5000)  # also the way of very long texts
    library = Tokenizer.from_file(default_vocabulary())
    docs = docs_of(spark, TEXTS)
    got = by_row(token_counts.count_tokens(docs, default_vocabulary(), limit=3), "doc_id", "n_bytes", "n_tokens", "over_limit")
    expected = []
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        expected.append((r.doc_id, len((r.text or "").encode()), n, n > 3))
    assert got == sorted(expected, key=str)
    assert token_counts.count_tokens(docs.where("false"), default_vocabulary()).count() == 0


def test_whole_tokens_are_proven_and_both_merges_agree():
    with open(default_vocabulary(), encoding="utf-8") as f:
        vocabulary = Vocabulary(f.read())
    library = Tokenizer.from_file(default_vocabulary())
    proven = token_counts.whole_tokens(vocabulary)
    assert len(proven) > 45_000 and "<|endoftext|>" not in proven
    assert all(len(x.ids) == 1 for x in library.encode_batch(proven, add_special_tokens=False))
    rules = token_counts._rules(vocabulary)
    rng = np.random.default_rng(2)
    for n in (65, 80, 200):  # above SHORT, by the queue
        piece = bytes(rng.choice(list(b"abeinrst"), n).tolist())
        assert token_counts.merged_length(piece, *rules) == token_counts._short_length([rules[0][b] for b in piece], *rules[1:])


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    with open(default_vocabulary(), encoding="utf-8") as f:
        vocabulary = Vocabulary(f.read())
    counts = token_counts._Counts([" the"], token_counts._rules(vocabulary))
    for k in range(30):
        assert counts[f"qx{k}zz"] > 1
        counts.trim()
        assert len(counts) <= 12
    assert counts[" the"] == 1


# Importance resampling


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def hashed(text, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_force(rows, target, buckets, percent, least):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(hashed(text, buckets))
    for text in target:
        t.update(hashed(text, buckets))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        f = hashed(text, buckets)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((k for k, (_, text) in enumerate(rows) if len(words(text)) >= least), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0, -out[k][2], -out[k][1]))
    for rank, k in enumerate(able[: len(able) * percent // 100]):
        out[k][4] = rank + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_resampling_against_brute_force(spark, monkeypatch, small):
    if small:  # long texts in parts, summaries pruned, an almost empty head
        for name, value in (("PART", 64), ("HEAD_WORDS", 4), ("HEAD_PAIRS", 4)):
            monkeypatch.setattr(resampling, name, value)
    rng = np.random.default_rng(4)
    known = [f"w{k}" for k in range(60)] + ["Ünï", "漢字", "x" * 200, "y" * 97]
    texts = [*TEXTS, *(" ".join(rng.choice(known, int(rng.integers(1, 90)))) for _ in range(120))]
    texts += [texts[-1]] * 5  # ties of the weight
    docs = docs_of(spark, texts)
    target = [None, "", *(" ".join(rng.choice(known[:20], 40)) for _ in range(10))]
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=30, least_words=10, buckets=500)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert by_row(got, "doc_id", "n_features", "weight", "score", "rank") == brute_force(rows, target, 500, 30, 10)


def test_resampling_of_equal_rows_and_empty_tables(spark):
    rows = [(7, "one two three four")] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    target = spark.createDataFrame([("one two",)], "text string")
    got = by_row(resampling.resample(docs, target, percent=50, least_words=2), "doc_id", "rank")
    assert sorted(r for _, r in got if r is not None) == list(range(1, 21)) and len(got) == 40
    assert resampling.resample(docs.where("false"), target).count() == 0
    none = resampling.resample(docs, target.where("false"), percent=100, least_words=2)
    assert by_row(none, "doc_id", "n_features", "weight", "score", "rank") == brute_force(rows, [], 10_000, 100, 2)


def test_crc_of_joined_words():
    rng = np.random.default_rng(6)
    first = [bytes(rng.integers(0, 256, int(n)).tolist()) for n in rng.integers(0, 40, 200)]
    second = [bytes(rng.integers(0, 256, int(n)).tolist()) for n in rng.integers(0, 700, 200)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = resampling.joined(crc(first), crc(second), np.array([len(x) for x in second]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(first, second, strict=True)]


def test_the_head_is_bounded_and_holds_what_is_frequent(spark, monkeypatch):
    monkeypatch.setattr(resampling, "HEAD_WORDS", 8)
    monkeypatch.setattr(resampling, "HEAD_PAIRS", 8)
    rng = np.random.default_rng(1)
    texts = [" ".join(f"rare{x}" if x % 2 else "often seen" for x in rng.integers(0, 10_000, 300)) for _ in range(20)]
    heads, pairs = resampling.head_of(spark.createDataFrame([(t.encode(),) for t in texts], "text binary").repartition(4))
    assert {b"often", b"seen"} <= set(heads) and b"often seen" in pairs
    assert len(heads) <= 8 and len(pairs) <= 8


# Whitening


def vectors_of(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}, n string, component string")


def whitened(df):
    return df.orderBy("vec_id", "component").collect()


def test_whitening_against_an_eigensolver(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 12)) @ np.diag(np.linspace(0.2, 3, 12)) + rng.standard_normal(12)
    rows = [(i, [float(c) for c in v], "a", "b") for i, v in enumerate(x)]
    bad = [(900, None, "a", "b"), (901, [None] * 12, "a", "b"), (902, [float("nan")] * 12, "a", "b"), (903, [float("inf")] + [0.0] * 11, "a", "b"), (904, [1.0] * 5, "a", "b"), (905, [], "a", "b"), (906, [1e300] * 12, "a", "b")]
    got = whitened(whitening.whiten(vectors_of(spark, rows + bad, "array<double>").repartition(37), components=5))
    whole = np.floor(64 * x).astype(np.int64) + 1_000_000
    n, s = len(whole), whole.sum(axis=0)
    c = (n * whole - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    expected = c @ u[:, :5] / np.sqrt(e[:5])
    assert len(got) == 5 * n and {r.n for r in got} == {n}
    values = np.array([r.whitened for r in got]).reshape(n, 5)
    assert np.abs(values * np.sign(values[0]) - expected * np.sign(expected[0])).max() < 1e-9
    assert [r.deviation for r in got[::5]] == [int(((n * v - s) ** 2).sum()) for v in whole]
    assert np.allclose([r.explained for r in got[:5]], e[:5] / e.sum(), rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


@pytest.mark.parametrize("kind", ["equal values", "dependent", "graded", "whole", "few rows"])
def test_directions(kind):
    rng = np.random.default_rng(8)
    for d in (1, 2, 3, 17, 40):
        x = rng.standard_normal((2 * d + 3, d))
        if kind == "equal values":
            x = 3 * np.linalg.qr(x)[0]
        elif kind == "dependent":
            x[:, -1] = x[:, 0]
            x[:, d // 2] = 0
        elif kind == "graded":
            x *= 10.0 ** rng.uniform(-6, 3, d)
        elif kind == "whole":
            x = np.round(x)
        else:
            x = x[: d // 2 + 1]
        e, u, trace = whitening.whitening_directions(whitening._triangle([x], d), len(x), d)
        v = x.T @ x / len(x)
        assert np.abs(v @ u - u * e).max() <= 1e-12 * max(np.abs(v).max(), 1e-300)
        assert np.abs(u.T @ u - np.eye(d)).max() < 1e-11
        assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() <= 1e-13 * max(e[0], 1e-300) and math.isclose(trace, np.trace(v), abs_tol=1e-300)


def test_small_singular_values_are_exact_to_the_last_digits():
    a, b = np.array([1.0, 1e-4, 1e-8, 1e-12]), np.array([1.0, 1e-4, 1e-8])
    got = np.sqrt(whitening.squared_singular_values(a, b))
    assert math.isclose(float(np.prod(got)), float(np.prod(a)), rel_tol=1e-13)  # no plain solver keeps the least of them


def test_whitening_without_variance(spark):
    one = whitened(whitening.whiten(vectors_of(spark, [(1, [0.5, 0.25], "a", "b")])))
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    flat = whitened(whitening.whiten(vectors_of(spark, [(None, [0.5, 1.0], "a", "b"), (1, [0.5, 2.0], "a", "b"), (1, [0.5, 2.0], "a", "b")])))
    assert [r.whitened is None for r in flat] == [False, True, False, False, True, True] and [r.explained for r in flat[:2]] == [1.0, 0.0]
    assert [r.vec_id for r in flat] == [None, None, 1, 1, 1, 1] and flat[0].identity_error < 1e-12
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None, "a", "b")])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_64_bits():
    x = np.array([[2**36, 0]], np.int64)
    n = 2**20
    assert whitening._deviations(x, np.zeros(2, np.int64), np.zeros(2, np.int64), n) == [None]
    assert whitening._deviations(x // 2**20, np.zeros(2, np.int64), np.ones(2, np.int64), n) == [None]
    assert whitening._deviations(np.array([[2**11, 3]]), np.zeros(2, np.int64), np.ones(2, np.int64), n) == [(n * 2**11 - 1) ** 2 + (3 * n - 1) ** 2]
