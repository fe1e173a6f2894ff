"""Toxicity, language model, vectors and the pipeline: held-out accuracy, normalisation and brute force."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import embeddings, language, toxicity

SMOKE = "/root/testdata/sf0.001"


def test_toxicity_learns_words_and_leaves_clean_texts(spark):
    rng = np.random.default_rng(1)
    clean = [" ".join(rng.choice(["house", "tree", "river", "stone", "cloud"], 30)) for _ in range(300)]
    texts = [x + (" you stupid idiot" if i % 4 == 0 else "") for i, x in enumerate(clean)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (None, texts[0])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            assert r.predicted == int(r.doc_id < 300 and r.doc_id % 4 == 0)
    none = toxicity.scored(docs, toxicity.train(docs, labels.limit(0))).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.scored(docs.limit(0), toxicity.train(docs, labels)).collect() == []


def test_toxicity_learns_rare_words(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(260)]
    common, rare = words[:200], words[200:]  # each rare word is in about 10 of 600 toxic texts
    texts = [[str(x) for x in rng.choice(common, 60)] for _ in range(1900)]
    toxic = [i % 2 for i in range(len(texts))]
    for i in range(1, len(texts), 2):
        texts[i].insert(int(rng.integers(60)), rare[rng.integers(60)])
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    rows = [r for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect() if r.held_out]
    found = [r.predicted for r in rows if toxic[r.doc_id]]
    flagged = [r.predicted for r in rows if not toxic[r.doc_id]]
    assert sum(found) >= 0.9 * len(found) and sum(flagged) <= 0.01 * len(flagged)


def test_toxicity_counts_labelled_rows(spark, monkeypatch):
    texts = ["Abc d", "abcd", None, "", "xyz" * 50, "abcd"]
    label = [1, 0, 1, 0, 1, 0]
    df = spark.createDataFrame([(i, x or "", y) for i, (x, y) in enumerate(zip(texts, label))], "doc_id long, text string, toxic int").repartition(3)
    held, n = toxicity.counted(df)
    want = np.zeros((2, toxicity.BUCKETS), np.int64)
    for x, y in zip(texts, label):
        for _, bucket in toxicity.features([(x or "").encode()]):
            want[y, bucket] += 1
    assert (held == want).all() and n.tolist() == [3, 3]
    ids = spark.range(4000).selectExpr("id AS doc_id", "cast(id % 4 = 0 AS int) AS toxic")
    assert toxicity.chosen(ids, (3000, 1000)).count() == 4000
    monkeypatch.setattr(toxicity, "COUNTED", 1000)
    some = {r.toxic: r["count"] for r in toxicity.chosen(ids, (3000, 1000)).groupBy("toxic").count().collect()}
    assert some[1] == 1000 and 850 < some[0] < 1150
    # what both classes hold alike has the value 0, however uneven they are
    assert np.abs(toxicity.ratios(np.array([[800, 1], [100, 1]]), np.array([800, 100]))[0]) < 1e-9


def brute_vectors(rows, least):
    units = [(i, np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())) if v and None not in v and np.isfinite(v).all() and np.any(v) else (i, None) for i, v in rows]
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            x, y = units[a][1], units[b][1]
            if x is not None and y is not None and len(x) == len(y) and float(x @ y) >= least:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    heads = {}
    for a in range(n):
        heads.setdefault(find(a), []).append(rows[a][0])
    out = []
    for a in range(n):
        head = min((x for x in heads[find(a)] if x is not None), default=None)
        out.append((rows[a][0], links[a], head, rows[a][0] == head))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, queries", [(2048, 8192), (7, 5)])
def test_vectors_against_all_pairs(spark, block, queries, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "QUERIES", queries)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 12))
    rows = [(i, (base[i % 20] + rng.normal(size=12) * rng.choice([0, 0.02, 0.25])).tolist()) for i in range(160)]
    rows += [(200, None), (201, []), (202, [0.0] * 12), (203, [1.0, None] + [0.0] * 10), (204, [float("nan")] + [1.0] * 11), (205, [float("inf")] + [1.0] * 11)]
    rows += [(206, [1.0, 0.0]), (207, [2.0, 0.0]), (208, rows[0][1]), (208, rows[0][1]), (None, [1e300, 0.0])]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, list string").repartition(3)
    got = sorted(map(tuple, embeddings.near_vectors(df).collect()), key=str)
    assert got == brute_vectors(rows, 0.95)
    assert embeddings.near_vectors(df.limit(0)).collect() == []


def test_language_model(spark):
    rng = np.random.default_rng(3)
    pairs = [("sun", "shines"), ("rain", "falls"), ("wind", "blows")]
    texts = [" ".join(w for k in rng.integers(0, 3, 40) for w in pairs[k]) for _ in range(120)] + ["", None, "Rare SUN word", " \t"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in language.scored(docs).collect()}
    counts, total = {}, 0
    tokens = {i: (x or "").lower().split() + ["\n"] for i, x in enumerate(texts)}
    for i, found in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            total += len(found)
            for t in found:
                counts[t] = counts.get(t, 0) + 1
    base = score = 0.0
    for i, found in tokens.items():
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.n_tokens == len(found) and r.train_tokens == total
        assert r.n_known == sum(t in counts for t in found)
        want = sum(np.log10((counts.get(t, 0) + 1) / (total + len(counts) + 1)) for t in found)
        assert abs(r.base_score - want) < 1e-6
        if r.held_out:
            base, score = base + r.base_score, score + r.score
    assert score > base  # a word depends on the one before it
    assert language.scored(docs.limit(0)).collect() == []


def test_probabilities_are_normalised():
    rng = np.random.default_rng(1)
    model = language.Model(rng.normal(size=(9, language.DIMENSIONS)), rng.normal(size=(9, language.DIMENSIONS)), rng.normal(size=9))
    p = np.exp(model.q @ model.r.T + model.b - model.normalisers()[:, None])
    assert np.allclose(p.sum(axis=1), 1)


def test_pipeline_keeps_columns_and_packs_what_is_left(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = corpus_pipeline.materialise(stage(spark, now, SMOKE), "test_stage")
        assert new.columns == columns and new.count() <= now.count(), name
        now = new
    rows = corpus_pipeline.STAGES[-1][1](spark, now, SMOKE).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in now.collect()}
    for doc in {r.doc_id for r in rows}:
        own = [r for r in rows if r.doc_id == doc]
        assert sum(r.length for r in own) == own[0].doc_tokens


def test_words_with_own_rows_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(language, "FREQUENT", 4)
    rng = np.random.default_rng(4)
    pairs = [(f"{a}aing", f"{a}bing") for a in "cdefghijklmnopqrst"]  # one group by their last bytes
    texts = [" ".join(w for k in rng.integers(0, len(pairs), 60) for w in pairs[k]) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [r for r in language.scored(docs).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert gain > 0.1  # every second word is known from the one before it
    assert language.own_rows(10**10) >= 10 * language.own_rows(10**8) > language.own_rows(10**6)


def test_a_pair_weighs_as_much_as_its_count(spark):
    rows = [(1, 10_000)] + [(k, 1) for k in range(2, 102)]  # context 0, codes are 0 * size + word
    size = 102
    got = language.dealt(spark.createDataFrame(rows, "pair long, n long")).collect()
    mean = sum(n for _, n in rows) / len(rows)
    weight = np.bincount([r.pair for r in got], weights=[r.weight for r in got], minlength=size)
    assert np.allclose(weight[1:] * mean, [n for _, n in rows])
    assert max(r.weight for r in got) <= language.HEAVY and len(got) <= len(rows) * (1 + 1 / language.HEAVY)
    rng = np.random.default_rng(5)
    model = language.Model(*(rng.normal(0, 0.1, (size, language.DIMENSIONS)).astype(np.float32) for _ in range(2)), np.full(size, -np.log(size), np.float32))
    word, weights = np.array([r.pair for r in got]), np.array([r.weight for r in got])
    for _ in range(400):
        language.descend(model, np.zeros(len(word), np.int64), word, weights, np.full(size, 1 / size), rng)
    z = model.r @ model.q[0] + model.b
    assert np.exp(z[1] - z.max()) / np.exp(z - z.max()).sum() > 0.9  # by square roots of counts 0.5


def test_products_with_noise_words_take_single_precision_once():
    """A product of PAIRS pairs and NOISE words is held once, in the precision of the parameters."""
    import tracemalloc

    rng = np.random.default_rng(2)
    size, n = 600, 2 * language.PAIRS
    share = rng.random(size)
    share /= share.sum()
    model = language.Model(*(rng.normal(0, 0.1, (size, language.DIMENSIONS)).astype(np.float32) for _ in range(2)), np.log(share).astype(np.float32))
    context, word = rng.integers(0, size, n), rng.integers(0, size, n)
    before = model.flat()
    tracemalloc.start()
    language.descend(model, context, word, rng.random(n), share, rng)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * 4 * language.PAIRS * language.NOISE
    assert np.isfinite(model.flat()).all() and not np.array_equal(model.flat(), before)
