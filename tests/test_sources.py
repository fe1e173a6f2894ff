"""Payload shapes with a bad entry each, caches, sinks and line format."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import exogenous as X
from tidemark.sources import files, payloads as J
from tidemark.streaming import envelope as E

START = datetime(2024, 1, 1)


def payload(spark, *texts):
    return spark.createDataFrame([("s", t) for t in texts], "symbol string, payload string")


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("ts").collect()]


def test_stablecoin(spark):
    text = """[{"date": 1700000000, "totalCirculatingUSD": {"peggedUSD": 1.2e11}},
               {"date": 1700086400, "totalCirculatingUSD": 1.3e11}, {"date": 1700172800, "totalCirculatingUSD": "9"},
               {"date": 1700259200, "totalCirculatingUSD": {"peggedEUR": 5}}, {"date": "x"}, {"date": "1700345600"}]"""
    got = values(J.parse_stablecoin_json(payload(spark, text, "not json")), "total_mcap")
    assert [g[0] for g in got[:4]] == [1.2e11, 1.3e11, 0.0, 0.0]
    since = F.lit("2023-11-16").cast("timestamp_ntz")
    assert J.parse_stablecoin_json(payload(spark, text), since).filter("total_mcap > 0").count() == 0


def test_open_interest(spark):
    text = '{"data": [{"t": 1700000000000, "v": 9.1e9}, {"t": 1700086400000}, {"v": 1}]}'
    assert values(J.parse_open_interest_json(payload(spark, text, "{}")), "open_interest") == [(9.1e9,), (0.0,)]


def test_funding_leaves_the_time_out_of_the_mean(spark):
    text = '{"data": [{"t": 1700000000000, "ex1": 0.01, "ex2": 0.03, "note": "x"}, {"ex1": 1}]}'
    [(ts, rate)] = values(J.parse_funding_json(payload(spark, text)), "ts", "funding_rate")
    assert ts == datetime(2023, 11, 14, 22, 13, 20) and rate == pytest.approx(0.02)


def test_flows(spark):
    text = '{"result": {"data": [{"datetime": "2024-01-01", "inflow": 5.0, "outflow": 3.0}]}}'
    assert values(J.parse_netflow_json(payload(spark, text)), "ts", "net_flow") == [(START, 2.0)]
    text = '[{"t": 1704067200, "v": -12.5}]'
    assert values(J.parse_netposition_json(payload(spark, text)), "ts", "net_flow") == [(START, -12.5)]


def test_news(spark):
    text = """{"results": [{"published_at": "2024-01-01T02:00:00+02:00", "title": "x", "source": {"domain": "d"}},
      {"published_at": "2024-01-01T01:00:00Z", "title": ""}, {"published_at": "2024-01-01T02:00:00Z", "title": "y"},
      {"published_at": "2024-01-01T03:00:00Z", "title": "z", "domain": "top", "source": {"domain": "d"}}]}"""
    got = values(J.parse_news_json(payload(spark, text)), "ts", "title", "source")
    assert got == [(START, "x", "d"), (START + timedelta(hours=2), "y", "unknown"),
                   (START + timedelta(hours=3), "z", "top")]


def test_articles_go_back_28_days_at_most(spark):
    text = """{"articles": [{"publishedAt": "2024-01-01T00:00:00Z", "title": "x", "source": {"name": "n"}},
                            {"publishedAt": "2023-11-01T00:00:00Z", "title": "old", "source": {"name": "n"}}]}"""
    newest = F.lit("2024-01-02").cast("timestamp_ntz")
    got = J.parse_articles_json(payload(spark, text), newest, days=400)
    assert values(got, "title", "source") == [("x", "n")]


def test_envelopes_are_routed_and_keep_field_case(spark):
    rows = [(1, '{"stream": "s@depth@100ms", "data": {"U": 1, "u": 3, "pu": 0, "b": [["100.0","5"]], "a": [["101.0","0"]]}}'),
            (2, '{"stream": "s@aggTrade", "data": {"p": "100.5", "q": "2.0"}}'), (3, "broken"), (4, '{"data": 1}')]
    raw = spark.createDataFrame(rows, "arrival bigint, value string").withColumn("ts", F.lit(START))
    opened = E.open_envelopes(raw)
    d, t = E.depth_messages(opened).first(), E.trade_messages(opened).first()
    assert (d.symbol, d.first_id, d.u, d.pu, d.b, d.a) == ("s", 1, 3, 0, [["100.0", "5"]], [["101.0", "0"]])
    assert (t.symbol, t.price, float(t.qty)) == ("s", 100.5, 2.0)
    assert opened.count() == 2


def test_lines(spark):
    df = spark.createDataFrame([("S", START, 1.5, 3, "x", None)],
                               "symbol string, ts timestamp_ntz, a double, b int, c string, d double")
    line = files.line_protocol(df, "t").first()[0]
    assert line == 't,symbol=S a=1.500000,b=3i,c="x" 1704067200000000000'


def test_lines_without_symbol_time_or_values(spark):
    """No symbol: no tag. No time: none in the line. No values: no line. Marks in a symbol are escaped."""
    rows = [(None, START, 1.0), ("S", None, 2.0), ("S", START, None), ("a b,c=d", START, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, a double")
    assert sorted(r.line for r in files.line_protocol(df, "t").collect()) == [
        "t a=1.000000 1704067200000000000", "t,symbol=S a=2.000000", "t,symbol=a\\ b\\,c\\=d a=3.000000 1704067200000000000"]


def test_both_copies_come_from_one_computation(spark, tmp_path):
    """The CSV copy is made from the parquet files: a value drawn anew would differ."""
    df = spark.range(200).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("symbol"), "id", F.rand().alias("x"))
    files.sink_parquet_csv(df, str(tmp_path))
    columns = ["id", "symbol", "x"]
    first = spark.read.parquet(str(tmp_path / "parquet")).select(*columns)
    second = spark.read.schema("id bigint, x double, symbol string").csv(str(tmp_path / "csv"), header=True).select(*columns)
    assert sorted(first.collect(), key=str) == sorted(second.collect(), key=str) and first.count() == 200


def test_cache_is_read_while_young_and_rebuilt_when_old(spark, tmp_path):
    path = str(tmp_path / "cache")
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    assert files.src_parquet_cache(spark, path, build).count() == 1
    assert files.src_parquet_cache(spark, path, build).count() == 1
    assert files.src_parquet_cache(spark, path, build, timedelta(0)).count() == 2


def test_titles_are_kept_by_source_priority(spark):
    a = spark.createDataFrame([(1, "x", START), (2, "y", START)], "doc_id int, title string, ts timestamp_ntz")
    b = spark.createDataFrame([(3, "x", START - timedelta(days=1)), (4, "z", START)], a.schema)
    kept = X.distinct_titles(X.union_news(a, b)).collect()
    assert {r.doc_id for r in kept} == {1, 2, 4}


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from tidemark import session

    class Cluster:
        master = "yarn"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Cluster()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
