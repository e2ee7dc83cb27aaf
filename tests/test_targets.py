import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import joins as J
from ledgerline.operators import market as X
from ledgerline.operators import news as N
from ledgerline.operators import targets as L
from ledgerline.operators.cleaning import carried_columns, keep_first, keep_latest, require_unique, resolve_column


def bars(spark, rows):
    return spark.createDataFrame([(t, dt.date.fromisoformat(d), float(c)) for t, d, c in rows], "ticker string, date date, close double")


def obs(spark, rows):
    return spark.createDataFrame([(t, dt.date.fromisoformat(d)) for t, d in rows], "ticker string, period_end date")


def test_asof_takes_the_same_day_and_never_looks_ahead(spark):
    b = bars(spark, [("A", "2020-01-01", 1), ("A", "2020-01-05", 2), ("B", "2020-01-09", 9)])
    o = obs(spark, [("A", "2019-12-31"), ("A", "2020-01-05"), ("A", "2020-01-04"), ("B", "2020-01-08"), ("C", "2020-01-01")])
    got = {(r["ticker"], str(r["period_end"])): r["close"] for r in J.asof_backward(o, b, ["ticker"], "period_end", "date", ["close"], "d").collect()}
    assert got == {("A", "2019-12-31"): None, ("A", "2020-01-05"): 2.0, ("A", "2020-01-04"): 1.0, ("B", "2020-01-08"): None, ("C", "2020-01-01"): None}


def test_label_statuses(spark):
    full = [("A", str(dt.date(2020, 1, 1) + dt.timedelta(days=i)), 100 + (i % 7)) for i in range(0, 366)]
    late = [("B", "2020-06-01", 1), ("B", "2020-06-02", 2)]
    gap = [("D", "2022-06-01", 1)]
    old = [("E", "2018-01-01", 1)]
    o = obs(spark, [(t, "2020-01-01") for t in "ABCDE"])
    got = {r["ticker"]: (r["target_status"], r["target_issue_codes"]) for r in L.drawdown_labels(o, bars(spark, full + late + gap + old)).collect()}
    assert got["A"] == ("ok", "")
    assert got["B"] == ("partial_horizon", "anchor_after_period_end;insufficient_horizon_coverage;too_few_future_bars")
    assert got["C"][0] == "missing_market_data" and got["D"][0] == "empty_horizon_window" and got["E"][0] == "no_forward_bars"


def test_trough_and_peak_are_the_earliest(spark):
    path = [("A", "2020-01-01", 10), ("A", "2020-01-02", 20), ("A", "2020-01-03", 10), ("A", "2020-01-04", 20), ("A", "2020-01-05", 10), ("A", "2020-01-06", 15)]
    r = L.future_drawdowns(obs(spark, [("A", "2020-01-01")]), bars(spark, path)).first()
    assert (str(r["mdd_peak_date"]), str(r["mdd_trough_date"]), r["future_1y_max_drawdown"]) == ("2020-01-02", "2020-01-03", -0.5)
    assert r["future_1y_total_return"] == pytest.approx(0.5) and r["future_bar_count"] == 6


def test_columns_nobody_reads_cost_nothing(spark):
    """Features and severity need neither the day of a peak nor the closes of a path."""
    from ledgerline.plans.risk import risk_dataset

    b = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)], "ticker string, date date, close double, high double, low double, volume double, transactions double")
    o = obs(spark, [("A", "2020-01-01")]).withColumns({"fiscal_year": F.lit(2020), "timeframe": F.lit("annual")})
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    pruned = plan(risk_dataset(o, b).select("ticker", "drawdown_severity", *X.MARKET_FEATURES))
    assert "unix_date" not in pruned and "_trough" not in pruned
    assert "unix_date" in plan(L.future_drawdowns(o, b)) and "_trough" in plan(L.future_drawdowns(o, b))


def test_rolling_features_against_pandas(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 200
    pdf = pd.DataFrame({"ticker": "A", "date": pd.date_range("2020-01-01", periods=n).date, "close": np.exp(np.cumsum(rng.normal(0, 0.02, n))) * 50})
    pdf["high"], pdf["low"], pdf["volume"], pdf["transactions"] = pdf.close * 1.01, pdf.close * 0.98, 1000.0, rng.integers(1, 9, n).astype(float)
    pdf.loc[50, "close"] = 0.0
    got = X.market_features(spark.createDataFrame(pdf)).orderBy("date").toPandas()
    ret = np.log(pdf.close.where(pdf.close > 0)).diff()
    want = pd.DataFrame({
        "volatility_21d": ret.rolling(21, min_periods=21).std() * np.sqrt(252), "volatility_63d": ret.rolling(63, min_periods=63).std() * np.sqrt(252),
        "drawdown_126d": pdf.close / pdf.close.rolling(126, min_periods=126).max() - 1, "avg_transactions_21d": pdf.transactions.rolling(21, min_periods=21).mean(),
        "avg_dollar_volume_63d": (pdf.close * pdf.volume).rolling(63, min_periods=63).mean(),
        "high_low_range_21d": ((pdf.high - pdf.low) / pdf.close.replace(0.0, np.nan)).rolling(21, min_periods=21).mean(),
    })
    for c in want:
        assert np.allclose(got[c].astype(float), want[c], rtol=1e-9, atol=1e-12, equal_nan=True), c


def test_leakage_guard():
    names = ["ticker", "future_x", "mdd", "drawdown_severity", "news_year", "roa"]
    assert L.feature_columns(names) == ["mdd", "roa"]


def test_deduplication_and_key_checks(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("A", 2, "y"), ("B", 1, "z")], "k string, o int, v string")
    assert {r["v"] for r in keep_latest(df, ["k"], ["o"]).collect()} == {"y", "z"}
    assert {r["v"] for r in keep_first(df, ["k"], ["o"]).collect()} == {"x", "z"}
    with pytest.raises(ValueError):
        require_unique(df, ["k"])
    assert resolve_column(["Ticker", "C"], ["symbol", "ticker"]) == "Ticker"
    assert carried_columns(df.withColumnRenamed("k", "ticker")) == ["ticker"]
    assert J.common_keys([df, df.drop("v")], ["v", "k"]) == ["k"]
    with pytest.raises(ValueError):
        resolve_column(["a"], ["b"])


def test_hot_news_group_keeps_the_newest(spark):
    n = 3000
    a = spark.range(n).select(
        F.col("id").alias("arrival"), F.lit("A").alias("dir_ticker"), F.concat(F.lit("n"), F.col("id")).alias("id"), F.lit("u").alias("article_url"),
        F.concat(F.lit("2020-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("published_utc"),
        F.lit("t").alias("title"), F.lit("text").alias("description"), F.array(F.lit("a")).alias("tickers"))
    companies = spark.createDataFrame([("A", 2020)], "ticker string, fiscal_year int")
    got = sorted(r["arrival"] for r in N.newest_articles(a, companies).collect())
    assert got == [27, 55, 83, 111]


def test_batch_scorer_matches_expression(spark):
    lists = spark.createDataFrame([("A", ["gain gain loss", "none"]), ("B", [])], "k string, news_description array<string>")
    by_expression = {r["k"]: r["news_sentiment_score"] for r in N.score_articles(lists, ["k"]).collect()}
    by_batches = {r["k"]: r["news_sentiment_score"] for r in N.score_with(lists, ["k"], lambda texts: [(t.count("gain") - t.count("loss")) / max(1, t.count("gain") + t.count("loss")) for t in texts]).collect()}
    assert by_expression == by_batches == {"A": [pytest.approx(1 / 3), 0.0], "B": []}


def test_features_are_folded_for_the_wanted_bars_only(spark):
    """As-of features equal those of `market_features` at the anchor bar, for missing tickers and dates too, and no window frame slides over all bars."""
    import numpy as np

    rng = np.random.default_rng(5)
    days = [None, *(dt.date(2020, 1, 1) + dt.timedelta(days=int(i)) for i in np.cumsum(rng.integers(1, 3, 299)))]
    rows = [(t, day, None if t == "B" and rng.random() < 0.02 else float(50 + rng.random()), 60.0, 40.0, float(rng.integers(1, 9)), float(rng.integers(1, 5))) for t in ("A", "B", "", None) for day in days]
    table = spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume double, transactions double")
    ends = [("A", None), ("A", days[250]), ("A", days[251]), ("A", days[251]), ("A", dt.date(2019, 1, 1)), ("B", days[-1]), ("", days[-1]), ("C", days[-1]), (None, days[280]), (None, None)]
    want_of = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "i int, ticker string, period_end date")
    got = X.attach_market_features(want_of, table)
    want = J.asof_backward(want_of, X.market_features(table), ["ticker"], "period_end", "date", X.MARKET_FEATURES, "anchor_trade_date")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert [tuple(r) for r in got.orderBy("i").collect()] == [tuple(r) for r in want.orderBy("i").collect()]
    assert {r["i"] for r in got.where("volatility_63d is not null").collect()} and got.where("drawdown_126d is not null").count() >= 3
    assert "-125" not in got._jdf.queryExecution().executedPlan().toString() and "-62" not in got._jdf.queryExecution().executedPlan().toString()
