"""Phrases, counts, scores and ranks against the plain definition; the growth against the bounds it claims."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrases as P
from tidemark.llm import windows as V

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_Z)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = total[lang]
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items() if len(q) > len(p)):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def run(spark, rows, least, top, parts=5):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    return sorted(map(tuple, P.collocations(docs, least, top).collect()))


def corpus(n=250, seed=1):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(30)]
    passage = "the quick brown fox jumps over Lazy dogs"
    rows = []
    for i in range(n):
        words = rng.choices(common, weights, k=rng.choice([0, 1, 4, 30, 60]))
        for j in range(len(words)):
            if rng.random() < 0.06:
                words[j] = rng.choice([passage, "new york city", "aa aa aa", "x y", "Über\tstraße", "日本 語", "b" * 40 + " c", "nul\x00l o"])
            if rng.random() < 0.1:
                words[j] += rng.choice([",", ".", "!?", "\n", ";", " : ", "\x0b", "\x0c", "\r"])
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), rng.choice([" ", "  ", " \t"]).join(words)))
    return [*rows, ("en", None), ("fr", None), ("fr", ""), (None, " . , "), ("es", "solo una vez"), *rows[:9]]


@pytest.mark.parametrize("least, top", [(6, 2000), (4, 12), (12, 3)])
def test_phrases(spark, least, top):
    rows = corpus()
    found = run(spark, rows, least, top)
    assert found == expected(rows, least, top)
    assert len(found) > 5


def test_ties_at_the_end(spark):
    """Equal scores and counts fall back on the phrase; the cut goes through a tie."""
    rows = [("en", f"{a} {b}.") for a, b in (("p1", "q1"), ("p2", "q2"), ("p3", "q3"), ("p4", "q4")) for _ in range(5)]
    assert run(spark, rows, 5, 3) == expected(rows, 5, 3)
    assert [r[2] for r in run(spark, rows, 5, 3)] == ["p1 q1", "p2 q2", "p3 q3"]


def test_no_rows_no_candidates_other_columns(spark):
    assert run(spark, [], 2, 10) == []
    assert run(spark, [("en", "a b c"), (None, None)], 2, 10) == []
    rows = corpus(60)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("x") for c in ("phrase", "n", "a", "score", "rank", "band", "w")})
    assert sorted(map(tuple, P.collocations(docs, 5, 50).collect())) == expected(rows, 5, 50)


def test_bands_are_pruned_and_nothing_is_lost(spark, monkeypatch):
    """Rare words in fixed phrases settle the list; the words that fill most of the text are never grown."""
    rng = random.Random(4)
    rows = [("en", " ".join(rng.choices(["of", "to", "in", "is"], k=40)) + f". r{i % 8} s{i % 8} t{i % 8}") for i in range(160)]
    grown = []
    plain = P._grown

    def noted(texts, frontier, known, band, n_band, least):
        grown.extend(r.phrase for r in band.collect())
        return plain(texts, frontier, known, band, n_band, least)

    monkeypatch.setattr(P, "_grown", noted)
    assert run(spark, rows, 10, 5) == expected(rows, 10, 5)
    assert grown and not {"of", "to", "in", "is"} & set(grown)
    assert run(spark, rows, 10, 100) == expected(rows, 10, 100)  # too few rare phrases: all are grown


def test_scores_beyond_64_bits(spark):
    big = [(9 * 10**15, 8 * 10**16, 10**16, 9 * 10**15), (3, 10, 7, 4)]
    got = [r[0] for r in spark.createDataFrame(big, "a long, n long, l long, r long").select(P.ratio("a", "n", "l", "r")).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in big]


@pytest.mark.parametrize("most", [9, 50, 1 << 20])
def test_long_texts_in_windows(monkeypatch, most):
    """A text cut into windows of any size gives the runs of the whole text, each once, and the same neighbours."""
    rng = random.Random(6)
    texts = ["".join(rng.choices(["a ", "bb ", "c.", "dd\n", "e\t", "f" * 20 + " "], k=k)) for k in (0, 3, 400)] + ["z" * 9000, "g " * 3000]
    seen = Counter()
    for w in V.windows([x.encode() for x in texts], P.WORD, 1, P.LONGEST, most):
        runs = P.Runs(w, np.zeros(len(texts), np.uint64))
        for k in range(1, 6):
            at = np.flatnonzero(runs.whole(k))
            seen.update(runs.spelled(at, k).to_pylist())
    whole = Counter()
    for x in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", x):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                whole.update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    assert seen == whole


def test_sieve_holds_what_was_put_in(spark):
    rows = [("en", f"k{i} v{i % 7}") for i in range(3000)] + [("de", "solo"), ("en", "h" * 50 + " i j k l")]
    table = P.sieve(spark.createDataFrame(rows, "lang string, phrase string").repartition(3), len(rows))
    batch = pa.RecordBatch.from_pylist([{"lang": a, "text": b} for a, b in rows])
    runs = P.Runs(next(V.windows([b.encode() for _, b in rows], P.WORD, 0, 0, 1 << 62)), P._languages(batch)[0])
    pairs = np.flatnonzero(runs.whole(2))
    assert table.holds(runs.hash(2)[pairs][:3000]).all()
    other = np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype(np.uint64)
    assert table.holds(other).mean() < 0.02


@pytest.mark.parametrize("least, top", [(6, 2000), (4, 12)])
def test_sieves_that_let_everything_through(spark, monkeypatch, least, top):
    """What passes a sieve unasked is neither scored without its parts nor returned twice."""
    monkeypatch.setattr(P, "sieve", lambda phrases, count: P.Sieve(np.full(1, np.iinfo(np.uint64).max, dtype=np.uint64)))
    rows = corpus()
    assert run(spark, rows, least, top) == expected(rows, least, top)
