"""Exact groups against a dictionary of texts."""

import hashlib
from collections import defaultdict

import pytest

from tidemark.llm import exact

ROWS = (
    [(i, "hot") for i in range(300)] + [(1000 + i, f"own {i}") for i in range(50)] + [(2000 + i, "pair") for i in range(2)]
    + [(3000, None), (3001, ""), (None, "hot"), (None, "null only"), (None, "null only"), (4000, "same"), (4000, "same"), (5000, "long " * 50000), (5001, "long " * 50000)]
)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "c", i) for i, x in rows], "doc_id long, text string, digest string, keep_id long").repartition(7)


@pytest.mark.parametrize("winners, least", [(512, 64), (1, 2), (4, 1)])
def test_groups(spark, winners, least):
    groups = defaultdict(list)
    for i, x in ROWS:
        groups[x or ""].append(i)
    rows = exact.exact_groups(frame(spark, ROWS), winners, least).collect()
    assert len(rows) == len(ROWS)
    stayed = defaultdict(int)
    by_sha = {hashlib.sha256(x.encode()).hexdigest(): x for x in groups}
    for r in rows:
        ids = groups[by_sha[r.text_sha256]]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        stayed[r.text_sha256] += r.kept
    assert set(stayed.values()) == {1}


def test_rows_that_stay(spark):
    docs = frame(spark, ROWS)
    left = exact.drop_exact(docs)
    assert left.columns == docs.columns
    assert left.count() == len({x or "" for _, x in ROWS})
    assert exact.drop_exact(docs.limit(0)).collect() == [] and exact.exact_groups(docs.limit(0)).collect() == []


def test_no_python_on_the_main_path(spark):
    plan = exact.exact_groups(frame(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
