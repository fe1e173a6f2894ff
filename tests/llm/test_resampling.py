"""Weights, scores and ranks against the plain definition; crc sums against zlib."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import resampling as R
from tidemark.llm import windows as V


def words_of(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text):
    words = words_of(text)
    return [b" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def expected(rows, target):
    feats = [features_of(x) for _, x in rows]
    s, t = [0] * 10000, [0] * 10000
    for fs in feats:
        for f in fs:
            s[zlib.crc32(f) % 10000] += 1
    for x in target:
        for f in features_of(x):
            t[zlib.crc32(f) % 10000] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for (i, x), fs in zip(rows, feats):
        weight = sum(gain[zlib.crc32(f) % 10000] for f in fs)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(fs), weight, score, None, len(words_of(x))])
    fit = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for rank, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def run(spark, rows, target, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    out = R.resample(docs, goal).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted(map(tuple, out.collect()), key=str)


def corpus(n=900):
    rng = random.Random(5)
    vocabulary = ["Üben", "x9", "日本", "naïve", "it's", "A-B", "Ω", "a" * 30, *(f"w{i}" for i in range(300))]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 19, 20, 21, 60])))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " .,;\x00\n"), (None, "w1 " * 30), (None, None)]
    rows += [(3, "w5 w6 " * 40)] * 3 + [(10**15, "w7\x00w8 " * 25), (-4, " ".join(["w9"] * 30))]
    return rows


TARGET = ["w1 w2 w3 w4 x9 Üben", "w5 w6 w5 w6", None, "", "日本 日本 w7"]


def test_scores_and_ranks(spark):
    rows = corpus()
    assert run(spark, rows, TARGET) == expected(rows, TARGET)


def test_ranks_where_all_scores_tie(spark):
    """Equal rows of one id fill the draw's end: the wanted number is drawn, no more."""
    rows = [(7, "w1 w2 w3 w4 " * 6)] * 70
    found = run(spark, rows, TARGET)
    assert sorted(r[4] for r in found if r[4] is not None) == [1, 2, 3]
    assert len(found) == 70


def test_tied_scores_go_to_the_smaller_id(spark):
    rows = [(i, 30, 10, 5, 100) for i in range(200, 0, -1)] + [(1000, 30, 10, 5, 101), (2000, 30, 10, 5, 99), (3000, 19, 10, 5, 500)]
    scored = R.materialise(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long"), "scored")
    got = {r.doc_id: r["rank"] for r in R.drawn(scored).collect() if r["rank"]}
    assert got == {1000: 1} | {i: i + 1 for i in range(1, 10)}


@pytest.mark.parametrize("most", [7, 40, 1000])
def test_long_texts_in_windows(most):
    """Windows of any size see each feature once, whatever they cut."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "bc", "ddd", "é" * 9, "w" * 4100], k=k)).encode() for k in (0, 1, 2, 3, 50, 400)]
    texts += [b"", b" " * 300, b"z" * 9000, b"q " * 5000]
    seen = [[] for _ in texts]
    for w in V.windows(texts, R.WORD, 0, 2, most):
        words = [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)]
        for i in range(w.first, w.last):
            for k in (1, 2, 3):
                if i + k <= len(words) and w.doc[i + k - 1] == w.doc[i]:
                    seen[w.doc[i]].append(b" ".join(words[i : i + k]))
    assert [sorted(x) for x in seen] == [sorted(features_of(x.decode())) for x in texts]


def test_crc_sums():
    texts = [b"a", b"bc def", "é ü".encode() * 40, b"x" * 25 + b" " + b"y" * 24 + b" z", bytes(range(128, 256)) * 3]
    for w in V.windows(texts, R.WORD, 0, 2):
        words = [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)]
        sums = R.word_sums(w, V.lower(w))
        assert sums.tolist() == [zlib.crc32(x) for x in words]
        pairs = R.joined(sums[:-1], sums[1:], (w.end - w.start)[1:])
        assert pairs.tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]


def test_empty_tables_and_other_columns(spark):
    assert run(spark, [], TARGET) == []
    rows = [(i, "w1 w2 w3 " * 10) for i in range(40)]
    assert run(spark, rows, []) == expected(rows, [])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "rank", "weight", "n_words", "_range", "n")})
    got = R.resample(docs, spark.createDataFrame([("w1", "b")], "text string, rank string"))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and got.count() == 40


def test_a_large_text_stays_small():
    import tracemalloc

    text = [("w1 w2 é " * (1 << 20)).encode()]  # 9 MB
    tracemalloc.start()
    n = sum(len(b) for _, b, _ in R.features(text))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 3 * 3 * (1 << 20) - 3
    assert most < 150 << 20
    assert np.isfinite(n)
