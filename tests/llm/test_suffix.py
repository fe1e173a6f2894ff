"""Removed bytes against a dictionary of all strings of the length."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import suffix


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = True
        runs = int((hit[1:] & ~hit[:-1]).sum() + hit[0])
        out.append((len(t), int(hit.sum()), runs, hashlib.sha256(bytes(b for b, h in zip(t, hit) if not h)).hexdigest()))
    return out


def corpus(seed, alphabet, n, size):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    texts = []
    for _ in range(n):
        t = "".join(rng.choice(words) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(9)) for _ in range(rng.randrange(size)))
        texts.append(t)
    return texts + texts[:3] + ["", None, "a" * 200, "ab" * 90]


@pytest.mark.parametrize("length, gram, chunk", [(20, 5, 1 << 22), (40, 7, 64), (400, 50, 1 << 22)])
def test_against_every_string(spark, length, gram, chunk, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    texts = corpus(length, "abß", 60, 12 if length < 400 else 120)
    if length == 400:
        base = "".join(random.Random(5).choice("abcdefgh ") for _ in range(3000))
        texts += [base[:1500], base[400:2000], "x" + base[900:1299], "y" + base[900:1300] + "z", base[:700] + "?" + base[701:]]
    docs = spark.createDataFrame([(i, x, 1, "n") for i, x in enumerate(texts)], "doc_id long, text string, key int, left string").repartition(5)
    rows = suffix.cut_repeats(docs, length, gram).orderBy("doc_id").collect()
    got = [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.left)).hexdigest()) for r in rows]
    assert got == brute([(x or "").encode() for x in texts], length)


def test_every_start_has_the_anchor_of_its_own_string():
    data = np.frombuffer(("abcab" * 40 + "xyz" * 50).encode(), dtype=np.uint8)
    found = {}
    for x, a, b in suffix.anchors(data, 30, 6):
        for at, lo, hi in zip(x, a, b):
            for p in range(lo, hi + 1):
                assert p not in found
                found[p] = at
    assert sorted(found) == list(range(len(data) - 29))
    for p, at in found.items():
        (x, _, _), = [tuple(v[0] for v in r) for r in suffix.anchors(data[p : p + 30], 30, 6)if len(r[0])]
        assert p + x == at


def test_repeated_ids_nulls_and_other_columns(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh é") for _ in range(900))
    rows = [(1, base, 900, "c"), (1, base, 900, "c"), (None, "own " + base[:500], 4, None), (2, None, None, "x"), (3, "short", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    out = suffix.drop_repeats(docs)
    assert out.columns == docs.columns
    got = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert got == {(1, "", 0), (None, "own ", 4), (2, None, None), (3, "short", 5)} and out.count() == 5
    assert suffix.drop_repeats(docs.limit(0)).collect() == [] and suffix.cut_repeats(docs.limit(0)).collect() == []


def test_tables_of_finished_rounds_are_deleted(spark, monkeypatch):
    """Every table of a round goes once the next one is written; what is left holds spans only."""
    import os

    from tidemark.llm import common

    made = []
    monkeypatch.setattr(common, "fresh_path", lambda s, name, plain=common.fresh_path: made.append(plain(s, name)) or made[-1])
    docs = spark.createDataFrame([(i, "x" * 30 + "the same long passage " * 30 + str(i)) for i in range(20)], "doc_id long, text string")
    assert suffix.cut_repeats(docs).where("n_removed > 0").count() == 20
    assert len(made) >= 3
    assert not [p for p in made if os.path.exists(p.removeprefix("file:"))]


def without_runs(texts, words):
    """The texts without the words, and the white space between them, of runs of ``words`` words that start elsewhere too."""
    places = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    lists = [[t[a:b].lower() for a, b in p] for t, p in zip(texts, places)]
    seen = Counter(tuple(x[i : i + words]) for x in lists for i in range(len(x) - words + 1))
    out = []
    for t, p, x in zip(texts, places, lists):
        hit = np.zeros(len(t), bool)
        for i in range(len(x) - words + 1):
            if seen[tuple(x[i : i + words])] > 1:
                hit[p[i][0] : p[i + words - 1][1]] = True
        out.append(bytes(c for c, h in zip(t, hit) if not h).decode())
    return out


@pytest.mark.parametrize("words", [3, 12, 51])
def test_runs_of_words_against_every_run(spark, words):
    rng = random.Random(words)
    pool = ["".join(rng.choice("abcdß") for _ in range(rng.randrange(1, 4))) for _ in range(300)]

    def text(n, space=" "):
        return space.join(rng.choice(pool) for _ in range(n))

    passages = [text(n) for n in (words - 1, words, words + 1, words + 9)]
    texts = [text(rng.randrange(3 * words)) for _ in range(20)] + ["", " \n", "é"]
    for p in passages * 2:
        texts += [text(9) + "\n" + p + " " + text(9), text(5) + " " + p.replace(" ", "\t ", 4), p + "x"]
    texts += ["to " * (2 * words) + "the " * words, "THE " * (words + 1)]
    docs = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(texts)], "doc_id long, text string, n_chars int").repartition(5)
    got = suffix.drop_repeats(docs, 100_000, words).orderBy("doc_id").collect()
    want = without_runs([x.encode() for x in texts], words)
    assert [r.text for r in got] == want != texts
    assert [r.n_chars for r in got] == [len(x) for x in want]


def test_passages_of_over_fifty_words_go_whatever_their_bytes(spark):
    """51 words are about 330 bytes in most texts, below the 400 of the strings."""
    rng = random.Random(3)

    def text(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    passage, short = text(51), text(50)
    assert len(passage) < suffix.LENGTH
    sides = [(text(30), text(40)) for _ in range(3)]
    rows = [(i, f"{a} {passage} {b}") for i, (a, b) in enumerate(sides)] + [(9, text(100)), (10, short + " end"), (11, short + " other"), (12, None)]
    got = dict(suffix.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == dict(rows) | {i: f"{a}  {b}" for i, (a, b) in enumerate(sides)}
