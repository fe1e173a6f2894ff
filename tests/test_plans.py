"""What the physical plans must and must not contain."""

import re
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import blocks, book, epochs, flow, labels
from tidemark.operators.bars import ohlc_sample_by, technical_features
from tidemark.plans.sampling import sampled_books
from workload.views import ARRIVAL_CUT, TICK_CUT, Views

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()
LAZY = sorted(n for n in QUERIES if not n.startswith(("ml_", "stream_", "sink_", "src_parquet", "src_csv", "ctas", "daily")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SF_DIR)


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_or_nested_loop_join(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_bars_aggregate_before_the_shuffle(v):
    text = plan(ohlc_sample_by(v.trades))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text
    assert text.count("Exchange hashpartitioning") == 1
    assert "user_id" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_features_take_one_shuffle_of_the_bars(spark, v, tmp_path):
    path = str(tmp_path / "bars")
    v.bars.write.parquet(path)
    text = plan(technical_features(spark.read.parquet(path)))
    assert text.count("Exchange") == 1 and text.count("Sort [") == 1


def windows(text):
    """Partition columns of every window in a plan."""
    return re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", text)


def test_trade_windows_are_partitioned_by_block(v):
    rows = flow.running_volume(v.tape, 100, TICK_CUT)
    over_trades = [w for w in windows(plan(rows)) if "_block" in w]
    assert len(over_trades) >= 3
    # windows by symbol alone only see the per-block totals
    for line in plan(rows).splitlines():
        if re.search(r"Window \[", line) and "_block" not in line.rsplit("], [", 2)[-2]:
            assert re.search(r"_n#|_full#|_rest#|_first_|_end|_start|_later", line)


def test_trade_totals_are_hash_aggregates(v):
    assert "SortAggregate" not in plan(flow.running_volume(v.tape, 100, TICK_CUT))


def test_carried_rows_are_limited_before_the_shuffle(v):
    text = plan(blocks.with_lookback(v.tape, TICK_CUT, 100))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_sampled_books_are_neither_expanded_nor_ranked(v):
    """Levels are shuffled once by block; samples come out of the walk through it."""
    text = plan(book.book_features(sampled_books(v.messages, v.snapshots, epochs.feed_end(v.messages, v.tape), cut=ARRIVAL_CUT)))
    above = text[:text.index("FlatMapGroupsInArrow")]
    assert "Exchange" not in above and "Generate" not in above and "Window" not in above
    assert "row_number() windowspecdefinition(symbol" in text  # of the snapshots alone
    assert not re.search(r"_w0|rank", above)


@pytest.mark.parametrize("report", [labels.class_balance, labels.regime_distribution, labels.classification_report])
def test_reports_read_their_input_once(spark, tmp_path, report):
    path = str(tmp_path / "rows")
    spark.range(40).selectExpr("cast(id % 4 as int) AS regime", "cast(id % 3 as int) AS prediction").write.parquet(path)
    assert plan(report(spark.read.parquet(path))).count("FileScan") == 1


def test_a_broken_text_package_takes_nothing_along(tmp_path):
    """Without the text operators, or with an import error in them, the other queries are all there."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    for d in ("tidemark", "workload"):
        shutil.copytree(os.path.join(root, d), tmp_path / d, ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"

    def counts():
        run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
        return tuple(map(int, run.stdout.split()[-2:]))

    without = counts()
    assert without[0] > 140
    (tmp_path / "tidemark" / "llm").mkdir()
    (tmp_path / "tidemark" / "llm" / "__init__.py").write_text("import no_such_module")
    (tmp_path / "corpus_pipeline.py").write_text("from tidemark.llm import exact")
    assert counts() == without


def test_final_book_is_a_hash_aggregate(v):
    text = plan(book.apply_book_updates(v.entries))
    assert "SortAggregate" not in text


def test_results_do_not_depend_on_the_number_of_partitions(spark):
    from compare import of_spark

    names = ["build_full_features", "vpin", "sample_1s", "asof_join", "book_replay"]
    eight = {n: of_spark(QUERIES[n](spark, SF_DIR)) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        for n in names:
            assert of_spark(QUERIES[n](spark, SF_DIR)) == eight[n], n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_properties_of_the_samples(spark):
    out = QUERIES["sample_1s"](spark, SF_DIR)
    bad = out.filter(
        (F.abs("obi_L1") > 1) | (F.abs("obi_weighted_weak") > 1) | (F.col("spread_absolute") <= 0)
        | (F.abs("micro_dev") > F.col("spread_absolute") / 2 + 1e-9) | ~F.col("vpin").between(0, 1))
    assert out.count() > 0 and bad.count() == 0
