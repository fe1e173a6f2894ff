"""Every stage of the pipeline against a run by hand on a small table."""

import random

import numpy as np

import corpus_pipeline
from tidemark.llm import toxicity

from test_minhash import groups

SMOKE = "/root/testdata/sf0.001"


def without_repeats(texts, length=400):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = True
        out.append("".join(c for c, h in zip(t, hit) if not h))
    return out


def test_stages_keep_exactly_the_rows_they_should(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(900)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage = text(70)
    texts = [text(rng.randrange(20, 200)) for _ in range(30)] + [text(60) + " " + passage + " " + text(60) for _ in range(3)]
    base = text(120).split()
    texts += texts[:4] + [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(["first", *base[1:]])]
    rows = [(10_000_000 + i, x) for i, x in enumerate(texts)]
    now = spark.createDataFrame(rows, "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)

    def run(name, docs):
        out = corpus_pipeline.materialise(stages[name](spark, docs, SMOKE), "test_stage")
        return out, sorted((r.doc_id, r.text) for r in out.collect())

    model = toxicity.train(now, spark.read.parquet(f"{SMOKE}/labels.parquet"))
    scores = model.scores([x.encode() for _, x in rows])
    now, got = run("toxicity", now)
    assert got == [r for r, s in zip(rows, scores) if s < 0.5] == rows
    now, got = run("exact dedup", now)
    assert len(got) == len(set(texts)) and {x for _, x in got} == set(texts)
    want = [r for r, g in zip(got, groups(got)) if g[3]]
    assert len(want) == len(got) - 2
    now, got = run("near dedup", now)
    assert got == want
    want = list(zip([i for i, _ in got], without_repeats([x for _, x in got])))
    assert want != got
    now, got = run("repeated passages", now)
    assert got == want
