import gzip
import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import files as R
from ledgerline.sources import sinks as K
from ledgerline.streaming import feeds


@pytest.fixture()
def root():
    return Path(tempfile.mkdtemp(prefix="ledgerline-test-", dir="/tmp"))


def put(path: Path, text: str):
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".gz":
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)


def test_daily_files(spark, root):
    put(root / "2024/2024-01-02.csv", "Symbol,C,H,L,V\n aa ,10,11,9,5\naa,12,12,8,6\nbb,x,1,1,1\nnan,1,1,1,1\n")
    put(root / "2024/2024-01-03.csv.gz", "Symbol,C,H,L,V\naa,13,14,12,7\n")
    put(root / "notes.csv", "Symbol,C,H,L,V\naa,99,99,99,9\n")
    assert R.detect_layout(spark, str(root)) == "daily_flatfiles"
    got = {(r["ticker"], str(r["date"])): r["close"] for r in R.read_bars(spark, str(root)).collect()}
    assert got == {("AA", "2024-01-02"): 12.0, ("AA", "2024-01-03"): 13.0}


def test_each_daily_file_is_read_by_its_own_header(spark, root):
    put(root / "2024-01-02.csv", "ticker,close,high,low\nA,1,2,0\n")
    put(root / "2024-01-03.csv", "Low,Symbol,\"H\",C\n0,\"A\",2,1\n\n")
    got = sorted((str(r["date"]), r["ticker"], r["close"], r["high"], r["low"], r["volume"]) for r in R.read_daily_files(spark, str(root)).collect())
    assert got == [("2024-01-02", "A", 1.0, 2.0, 0.0, None), ("2024-01-03", "A", 1.0, 2.0, 0.0, None)]
    put(root / "2024-01-04.csv", "ticker,high\nA,2\n")
    with pytest.raises(Exception, match="no column for close"):
        R.read_daily_files(spark, str(root)).collect()


def test_ticker_day_json(spark, root):
    put(root / "AA/2024-01/02.json", json.dumps({"from": "2024-01-02", "close": 5}))
    put(root / "BB__SLASH__C/2024-01/03.json", json.dumps({"c": 7}))
    put(root / "AA/2024-01/04.json", "broken")
    assert R.detect_layout(spark, str(root)) == "ticker_daily_json"
    got = {(r["ticker"], str(r["date"]), r["close"]) for r in R.read_bars(spark, str(root)).collect()}
    assert got == {("AA", "2024-01-02", 5.0), ("BB/C", "2024-01-03", 7.0)}


def test_ticker_files_and_missing(spark, root):
    put(root / "aa.csv", "date,close\n2024-01-02,5\n2024-01-02,6\nbad,7\n")
    assert R.detect_layout(spark, str(root)) == "ticker_files"
    assert [(r["ticker"], r["close"]) for r in R.read_bars(spark, str(root)).collect()] == [("AA", 6.0)]
    assert R.detect_layout(spark, str(root / "none")) == "missing" and R.read_bars(spark, str(root / "none")).count() == 0


def test_statements_and_news(spark, root):
    put(root / "bs/AA.json", json.dumps({"results": [{"fiscal_year": 2020, "revenue": 1.0}, {"fiscal_year": "2021", "revenue": None}]}))
    put(root / "bs/BB.json", "not json")
    rows = R.read_statements(spark, str(root / "bs"), ["revenue"]).collect()
    assert sorted((r["ticker"], r["position"], r["fiscal_year"], r["revenue"]) for r in rows) == [("AA", 0, "2020", 1.0), ("AA", 1, "2021", None)]
    put(root / "news/AA/news.jsonl", '{"id": "1", "title": "t", "tickers": ["aa"]}\n\nbroken\n')
    news = R.read_news(spark, str(root / "news")).collect()
    assert sorted((r["dir_ticker"], r["id"], r["malformed"]) for r in news if r["id"]) == [("AA", "1", False)] and sum(r["malformed"] for r in news) == 1


def test_ticker_lists_and_specs(spark, root):
    put(root / "t.txt", "bb, aa # note\n# only a comment\naa\ncc")
    put(root / "t.json", '["bb", "aa", "bb"]')
    put(root / "t.csv", "x,Symbol\n1,bb\n2,aa\n")
    assert [r["ticker"] for r in R.read_ticker_list(spark, str(root / "t.txt")).collect()] == ["BB", "AA", "CC"]
    assert [r["ticker"] for r in R.read_ticker_list(spark, str(root / "t.json")).collect()] == ["BB", "AA"]
    assert [r["ticker"] for r in R.read_ticker_list(spark, str(root / "t.csv")).collect()] == ["BB", "AA"]
    assert R.parse_dataset_specs(["train=/a", " val = /b "]) == {"train": "/a", "val": "/b"}
    with pytest.raises(ValueError):
        R.parse_dataset_specs(["nothing"])


def test_sinks(spark, root):
    df = spark.createDataFrame([("A", [1.0, 2.0]), ("B", [])], "k string, v array<double>")
    K.write_csv(df, str(root / "out.csv"))
    assert {r["v"] for r in R.read_dataset(spark, str(root / "out.csv"), ["K", "v"]).collect()} == {"[1.0,2.0]", "[]"}
    K.write_summary(spark.createDataFrame([(1,)], "n int"), str(root / "s.json"))
    assert spark.read.json(str(root / "s.json")).first()["n"] == 1
    K.write_table(df, str(root / "t.parquet"), ["k"])
    assert R.read_dataset(spark, str(root / "t.parquet")).count() == 2
    put(root / "runs/one/summary.json", json.dumps({"metrics": {"rmse": 1.5}}))
    put(root / "runs/two/summary.json", json.dumps({"metrics": {"rmse": 2.5}}))
    got = K.read_summaries(spark, [str(root / "runs/one/summary.json"), str(root / "runs/two/summary.json")])
    assert {(r["run"], r["rmse"]) for r in got.collect()} == {("one", 1.5), ("two", 2.5)}


def drain(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_bar_stream_keeps_the_last(spark, root):
    table, state = str(root / "table"), str(root / "state")

    def run():
        stream = feeds.bar_stream(spark, str(root / "in"), max_files=1)
        drain(stream.writeStream.foreachBatch(feeds.upsert_bars(table)).option("checkpointLocation", state).start())

    header = "ticker,close,high,low,volume,transactions,date\n"
    put(root / "in/2024-01-02.csv", "ticker,volume,open,close,high,low,window_start,transactions\naa,900,8,9,9,9,,1\naa,100,8,1,1,1,,1\nbb,500,8,5,6,4,,5\n")
    put(root / "in/notes.csv", header + "aa,99,99,99,99,99,2024-01-02\n")
    run()
    first = {r["ticker"]: (r["close"], r["high"], r["low"], r["volume"]) for r in spark.read.parquet(table).collect()}
    assert first == {"AA": (1.0, 1.0, 1.0, 100.0), "BB": (5.0, 6.0, 4.0, 500.0)}
    put(root / "in/2024-01-03.csv", header + "aa,2,2,2,2,2,2024-01-03\naa,3,3,3,3,3,2024-01-02\n")
    run()
    got = {(r["ticker"], str(r["date"])): r["close"] for r in spark.read.parquet(table).collect()}
    assert got == {("AA", "2024-01-02"): 3.0, ("BB", "2024-01-02"): 5.0, ("AA", "2024-01-03"): 2.0}


def test_article_stream_drops_repeats_and_counts(spark, root):
    rows = [("A", i, "n1" if i < 2 else f"n{i}", "u", f"2024-01-0{1 + i}T00:00:00Z", "t", "d", ["A"]) for i in range(4)]
    schema = "dir_ticker string, arrival long, id string, article_url string, published_utc string, title string, description string, tickers array<string>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(root / "in"))
    stream = spark.readStream.schema(schema).parquet(str(root / "in"))
    table, state = str(root / "articles"), str(root / "articles-state")

    def ingest():
        feeds.ingest_articles(stream, table, state).awaitTermination()

    ingest()
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == ["n1", "n2", "n3"]
    late = [("A", 9, "old", "u", "2023-01-01T00:00:00Z", "t", "d", ["A"]), ("A", 10, "n3", "u", "2024-03-01T00:00:00Z", "t", "d", ["A"]),
            ("B", 11, "n3", "u", None, "t", "d", ["B"])]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(root / "in"))
    ingest()
    assert sorted((r["dir_ticker"], r["id"]) for r in spark.read.parquet(table).collect()) == [("A", "n1"), ("A", "n2"), ("A", "n3"), ("A", "old"), ("B", "n3")]
    companies = spark.createDataFrame([("A", 2024)], "ticker string, fiscal_year int")
    table = str(root / "counts")
    drain(stream.writeStream.foreachBatch(feeds.count_outcomes(companies, table)).start())
    got = {r["reason"]: r["n_articles"] for r in spark.read.parquet(table).collect()}
    assert got["kept"] == 4 and got["duplicate"] == 2


def test_day_bar_stream_equals_its_batch_twin(spark, root, small):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(4, "ts").write.parquet(str(root / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(root / "events"))
    drain(feeds.day_bars(stream, "1 day").writeStream.format("memory").queryName("day_bars_out").outputMode("complete").start())
    key = lambda df: {tuple(r) for r in df.select("event_type", "date", "close", "high", "low", F.round("volume", 6), "transactions").collect()}
    assert key(spark.table("day_bars_out")) == key(feeds.day_bars(events, None))


def test_article_batches_follow_the_batch(spark, root):
    """A key comes out once, in its first batch and as its first arrival; stored batches are not read again."""
    schema = "dir_ticker string, arrival long, id string, article_url string, published_utc string, title string, description string, tickers array<string>"
    table, state = str(root / "feed-table"), str(root / "feed-state")

    def arrive(rows):
        rows = [(t, i, k, "u", None, title, None, None) for t, i, k, title in rows]
        spark.createDataFrame(rows, schema).repartition(1).write.mode("append").parquet(str(root / "feed"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(root / "feed"))
        feeds.ingest_articles(stream, table, state).awaitTermination()
        return sorted((str(r["dir_ticker"]), r["id"], r["title"]) for r in spark.read.parquet(table).collect())

    first = [("A", "x", "one"), ("None", "x", "none")]
    assert arrive([("A", 2, "x", "two"), ("A", 1, "x", "one"), (None, 3, "x", "none"), ("A", 1, "x", "one")]) == first
    assert arrive([("A", 0, "x", "earlier arrival number, later batch"), (None, 4, "x", "again")]) == first
    assert arrive([("B", 9, "x", "new"), ("A", 10, "x", "again")]) == [*first[:1], ("B", "x", "new"), first[1]]
    assert arrive([("B", 11, "x", "again")]) == [*first[:1], ("B", "x", "new"), first[1]]
    progress = feeds.first_articles(spark.read.schema(schema).parquet(str(root / "feed")))
    assert sorted((str(r["dir_ticker"]), r["title"]) for r in progress.collect()) == [("A", "earlier arrival number, later batch"), ("B", "new"), ("None", "none")]
