"""Stored bars: what is read, and that pruning changes no result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import risk as P
from ledgerline.sources import bar_table as BT


def weekdays(first, last):
    day = first
    while day <= last:
        if day.weekday() < 5:
            yield day
        day += dt.timedelta(days=1)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = []
    for ticker, first, last in (("A", dt.date(2014, 1, 1), dt.date(2022, 6, 30)), ("B", dt.date(2014, 1, 1), dt.date(2017, 3, 31)), ("C", dt.date(2021, 5, 3), dt.date(2022, 6, 30))):
        price = 50.0
        for day in weekdays(first, last):
            price *= 1 + rng.uniform(-0.03, 0.03)
            rows.append((ticker, day, price, price * 1.01, price * 0.99, rng.uniform(1e3, 1e4), rng.uniform(10, 99)))
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume double, transactions double").cache()
    root = str(tmp_path_factory.mktemp("stored") / "table")
    BT.write_bars(bars, root)
    ends = [("A", dt.date(2016, 12, 31)), ("A", dt.date(2019, 12, 31)), ("B", dt.date(2016, 12, 31)), ("B", dt.date(2019, 12, 31)), ("C", dt.date(2016, 12, 31)), ("D", dt.date(2019, 12, 31))]
    obs = spark.createDataFrame([(t, d.year, d, "annual") for t, d in ends], "ticker string, fiscal_year int, period_end date, timeframe string")
    return bars, root, obs


def rows_of(df):
    names = sorted(df.columns)
    shown = [F.round(n, 9).alias(n) if t == "double" else F.col(n) for n, t in sorted(df.dtypes)]
    return sorted(str(tuple(r[n] for n in names)) for r in df.select(*shown).collect())


def test_pruned_scan_changes_no_label_and_no_feature(spark, stored):
    bars, root, obs = stored
    recent = obs.where("NOT (ticker = 'B' AND fiscal_year = 2019)")
    want, got = P.labelled_dataset(recent, bars), P.stored_labelled_dataset(recent, root, 200)
    assert set(want.columns) == set(got.columns)
    assert rows_of(want) == rows_of(got)
    codes = {(r["ticker"], r["fiscal_year"]): r["target_issue_codes"] for r in got.collect()}
    assert codes["C", 2016] == "empty_horizon_window" and codes["D", 2019] == "missing_market_data"


def test_labels_need_no_old_bar(stored):
    bars, root, obs = stored
    keys = ["ticker", "period_end", "target_status", "target_issue_codes", "future_bar_count", "future_1y_max_drawdown"]
    assert rows_of(P.labelled_dataset(obs, bars).select(*keys)) == rows_of(P.stored_labelled_dataset(obs, root, 0).select(*keys))


def test_only_needed_months_are_opened(spark, stored):
    _, root, obs = stored
    read = BT.read_needed_bars(spark, root, obs.where("fiscal_year = 2019"), 31, 60)
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "dynamicpruning" in plan
    months = {r[0] for r in read.select(F.date_format("date", "yyyy-MM")).distinct().collect()}
    assert months == {"2019-11", "2019-12", "2020-01", "2020-02"}
    gap = BT.needed_months(obs, 0, 0)
    assert sorted(r[0] for r in gap.collect()) == ["2016-12", "2019-12"]


def test_edges(spark, stored, tmp_path):
    bars, _, obs = stored
    nothing = BT.needed_months(obs.where("false"), 10, 10)
    assert nothing.count() == 0
    assert BT.needed_months(obs.limit(1).withColumn("period_end", F.lit(None).cast("date")), 10, 10).count() == 0
    with pytest.raises(ValueError):
        BT.needed_months(obs, -1, 0)
    odd = bars.limit(3).withColumn("date", F.lit(None).cast("date")).unionByName(bars.where("date = DATE'2016-12-30'"))
    BT.write_bars(odd, str(tmp_path / "odd"))
    got = BT.read_needed_bars(spark, str(tmp_path / "odd"), obs, 31)
    assert got.count() == 2 and set(got.columns) == set(bars.columns)
