"""The machine against its plain sum over pairs, its inputs against plain counts, accuracy on rows never seen."""

import random
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality as Q
from tidemark.llm import windows as V


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def one(texts, stored=None):
    return Q.inputs([x.encode() for x in texts], np.full(len(texts), np.nan) if stored is None else np.array(stored, float))


def test_margin_is_the_sum_over_pairs():
    random_ = np.random.default_rng(2)
    x = one(["The cat sat. The end", "", "a ||| b\nb b", "A" * 50], [20, 0, np.nan, 1])
    model = Q.Model(0.3, random_.normal(size=Q.N_INPUTS), random_.normal(size=(Q.N_INPUTS, 4)), [np.array([0.1, 0.5])] * len(Q.STATS))
    doc, index, value = model.entries(x)
    for i, margin in enumerate(model.margins(x)):
        own = [(k, v) for d, k, v in zip(doc, index, value) if d == i]
        plain = 0.3 + sum(model.weights[k] * v for k, v in own)
        plain += sum(model.vectors[j] @ model.vectors[k] * u * v for (j, u), (k, v) in combinations(own, 2))
        assert abs(plain - margin) < 1e-8


def test_gradient_moves_towards_the_labels():
    good = ["plain words in a calm row of text number %d" % i for i in range(60)]
    bad = ["BUY || NOW || %d || !!! ### %%" % i for i in range(60)]
    x, y = one(good + bad), np.array([1.0] * 60 + [0.0] * 60)
    s = Q.fit(x, y, 0.5).scores(x)
    assert s[:60].min() > 0.9 and s[60:].max() < 0.1


def test_interactions_are_learned():
    """Neither word nor mark tells anything alone: only the vectors can part an exclusive or."""
    rng = random.Random(1)
    texts, y = [], []
    for _ in range(900):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(("alpha " if a else "gamma ") * 4 + ("one " if b else "two ") * 4)
        y.append(float(a != b))
    x = one(texts)
    s = Q.fit(x, np.array(y), 0.5).scores(x)
    assert ((s > 0.5) == np.array(y, bool)).mean() > 0.95


def test_inputs_of_long_texts_add_up(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["red", "Blue", "x!", "é", "9", "w" * 30], k=k)) for k in (700, 0, 3, 900)]
    whole = one(texts)
    for most in (64, 500):
        monkeypatch.setattr(Q, "MOST", most)
        monkeypatch.setattr(Q, "windows", lambda t, word, a, b, most=most: V.windows(t, word, a, b, most))
        cut = one(texts)
        assert np.array_equal(cut.doc, whole.doc) and np.array_equal(cut.index, whole.index)
        assert np.allclose(cut.value, whole.value) and np.allclose(cut.stats, whole.stats, equal_nan=True)
    first = (whole.doc == 0) & (whole.index < Q.WORDS)
    assert abs((whole.value[first] ** 2).sum() - 1) < 1e-9


def corpus(n=700):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("sun", "moon", "tree", "road", "hill") for b in ("", "s", "ed", "ing", "er")]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = " ".join(rng.choices(words, k=rng.randrange(8, 80)))
        if not good:
            text = rng.choice([lambda x: x.upper() + "!!", lambda x: " | ".join(x.split()), lambda x: "spam " * 30, lambda x: x.replace(" ", "%% ")])(text)
        rows.append((i, text, "en", "src", len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def test_held_out_rows(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    out = {r.doc_id: r for r in Q.scored(docs, Q.train(docs, marks)).collect()}
    assert len(out) == len(rows)
    truth = {i: q for i, q, _ in labels}
    assert all(out[i].held_out == held(i) and out[i].predicted == int(out[i].score >= 0.7) for i in truth)
    test = [i for i in truth if held(i)]
    assert np.mean([out[i].predicted == truth[i] for i in test]) > 0.93


def test_labels_of_held_out_rows_and_names_play_no_part(spark):
    rows, labels = corpus(300)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    turned = spark.createDataFrame([(i, 1 - q if held(i) else q, 1) for i, q, _ in labels], LABELS)
    renamed = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    plain = sorted(Q.scored(docs, Q.train(docs, marks)).collect())
    assert plain == sorted(Q.scored(renamed, Q.train(renamed, turned)).collect())
    assert plain == sorted(Q.scored(docs.repartition(7), Q.train(docs.repartition(3), marks.repartition(5))).collect())


def test_odd_rows(spark):
    rows, labels = corpus(200)
    odd = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "sun", "en", "s", 3), (1002, "x" * 3_000_000, None, None, -5), (5, rows[5][1], "en", "src", 1)]
    marks = labels + [(None, 1, 0), (1, None, 0), (7, 0, 1), (7, 1, 1), (1000, 1, 0), (3, 5, 0)]
    docs = spark.createDataFrame(rows + odd, DOCS).withColumns({c: F.lit(1) for c in ("quality", "score", "index", "stats")})
    out = Q.scored(docs, Q.train(docs, spark.createDataFrame(marks, LABELS))).collect()
    assert len(out) == 205 and all(0 <= r.score <= 1 for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    bare = Q.scored(docs.select("doc_id", "text"), Q.constant(0.25)).collect()
    assert {round(r.score, 9) for r in bare} == {0.25}


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in Q.scored(docs, Q.train(docs, none)).collect()] == [0.5]
    only = spark.createDataFrame([(i, 1, 0) for i in range(8)], LABELS)
    assert Q.scored(docs, Q.train(docs, only)).first().score > 0.7
    assert Q.scored(docs.limit(0), Q.train(docs.limit(0), spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 0, 0), (7, 1, 0)], LABELS))).count() == 0
