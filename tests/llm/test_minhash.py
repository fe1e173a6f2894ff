"""Signatures against the plain algorithm, groups against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import minhash
from tidemark.llm.common import components
from tidemark.llm.words import Words, mixed


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def groups(rows):
    sets = [(i, shingles(x)) for i, x in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, x), (j, y) in combinations([s for s in sets if s[1] and s[0] is not None], 2):
        if 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), c := None if i is None else find(i), c == i) for i, s in sets), key=str)


def family(rng, n, words, edits):
    base = [rng.choice(WORDS) for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = rng.choice(WORDS)
        out.append(" ".join(copy))
    return out


WORDS = [f"w{i}" for i in range(500)]


def corpus():
    rng = random.Random(2)
    texts = family(rng, 60, 120, 7) + family(rng, 40, 90, 4) + [x for _ in range(30) for x in family(rng, 2, 60, 4)]
    texts += texts[:5] + [" ".join(x.upper() for x in texts[0].split()), "", None, " \t\n", "a b", "A  b", "a b c", "é b", "one word \u0085 x y z"]
    return [(1000 - i, x) for i, x in enumerate(texts)] + [(None, texts[0]), (7, texts[1]), (7, texts[1])]


@pytest.mark.parametrize("small, rounds", [(8, 6), (2, 6), (1, 0)])
def test_groups(spark, small, rounds, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = corpus()
    docs = spark.createDataFrame([(i, x, 3, "k") for i, x in rows], "doc_id long, text string, n int, keys string").repartition(4)
    got = sorted(map(tuple, minhash.near_groups(docs).collect()), key=str)
    want = groups([r for r in rows if r[0] is not None])
    assert [g for g in got if g[0] is not None] == [w for w in want]
    assert [g[2:] for g in got if g[0] is None] == [(None, True)]


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(i, x, "c") for i, x in corpus()], "doc_id long, text string, component string")
    stay = {i for i, _, _, kept in groups([r for r in corpus() if r[0] is not None]) if kept}
    out = minhash.drop_near(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == stay | {None}
    assert minhash.drop_near(docs.limit(0)).collect() == [] and minhash.near_groups(docs.limit(0)).collect() == []


def plain_signature(values, slots):
    h = [np.inf] * slots
    for x in values:
        perm = list(range(slots))
        for j in range(slots):
            draw = mixed(np.array([x], np.uint64), 2 * j + 11)
            r = float(draw[0] >> np.uint64(11)) * 2.0**-53
            k = j + int(mixed(draw, 5)[0] % np.uint64(slots - j))
            perm[j], perm[k] = perm[k], perm[j]
            h[perm[j]] = min(h[perm[j]], r + j)
    return h


@pytest.mark.parametrize("n", [0, 1, 3, 40])
def test_stopping_early_changes_no_slot(n):
    values = mixed(np.arange(n, dtype=np.uint64), 1)
    got = minhash.signatures(np.concatenate([np.zeros(n, int), np.ones(2 * n, int)]), np.concatenate([values, values, mixed(values, 3)]), 2, 16)
    assert got[0].tolist() == plain_signature(values, 16)
    assert got[1].tolist() == plain_signature(np.concatenate([values, mixed(values, 3)]), 16)


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    shared, own = (mixed(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (300, 100))
    a, b = np.concatenate([shared, own[:50]]), np.concatenate([shared, own[50:]])
    h = minhash.signatures(np.repeat([0, 1], [350, 350]), np.concatenate([a, b]), 2, 128)
    assert abs((h[0] == h[1]).mean() - 0.75) < 0.12


def test_words():
    texts = ["A b\tc", "", "  x ", "ß É\x0b1"]
    found = Words([t.encode() for t in texts])
    assert found.counts.tolist() == [3, 0, 1, 3]
    same = Words(["b ß a x".encode()]).hash
    assert found.hash[1] == same[0] and found.hash[4] == same[1] and found.hash[0] == same[2] and found.hash[3] == same[3]


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i + 1, i) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 90)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(500, 500)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{100 + i: 100 for i in range(90)}, **{200 + i: 200 for i in range(9)}}


def test_crowded_buckets_lose_no_link_however_few_slots_agree(spark, monkeypatch):
    plain = minhash.signatures

    def unlike(doc, value, n_docs, slots=minhash.SLOTS):
        """One band is common to all texts, no other slot is common to any two of them."""
        h = plain(doc, value, n_docs, slots)
        own = np.unique(doc, return_index=True)
        h[:, 4:] = 1000.0
        h[:, :4] = 0.5
        for d, at in zip(*own):
            total = value[doc == d].sum(dtype=np.uint64)
            h[d, 4:] += mixed(np.arange(slots - 4, dtype=np.uint64) + total) / 2.0**64
        return h

    monkeypatch.setattr(minhash, "signatures", unlike)
    rng = random.Random(6)
    rows = list(enumerate(x for words in (120, 60, 80, 700) for x in family(rng, 5, words, 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, minhash.near_groups(docs).collect())) == groups_by_id(rows)


def groups_by_id(rows):
    return sorted(groups(rows))


def test_bounds_never_rule_out_a_similar_pair():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    sets = []
    for size in (1, 3, 30, 900, 9000):
        base = mixed(rng.integers(0, 1 << 62, size).astype(np.uint64))
        sets += [np.unique(np.where(rng.random(size) < p, mixed(rng.integers(0, 1 << 62, size).astype(np.uint64)), base)) for p in (0, 0.05, 0.1, 0.14, 0.2, 0.6)]
    bits = np.zeros((len(sets), minhash.BITS), dtype=bool)
    for i, x in enumerate(sets):
        bits[i, (mixed(x) % np.uint64(minhash.BITS)).astype(np.int64)] = True
    packed = [x.tobytes() for x in np.packbits(bits, axis=1)]
    keys = np.arange(len(sets) * minhash.BANDS, dtype=np.int64).reshape(len(sets), -1)
    table = pa.table({"id": range(len(sets)), "label": range(len(sets)), "n": [len(x) for x in sets], "keys": pa.array(list(keys), pa.list_(pa.int64())), "bits": pa.array(packed, pa.binary())})
    found = {(i, int(j)) for i, js, _ in minhash._candidates(0, table, table) for j in js}
    similar = {(i, j) for i, j in combinations(range(len(sets)), 2) if minhash._alike(sets[i], sets[j])}
    assert similar and similar <= found
