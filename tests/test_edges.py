"""Rows that once gave wrong answers: outliers, NaN, equal observations, odd list texts, money predictions."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import lists as L
from ledgerline.operators import attribution as A
from ledgerline.operators import joins as J
from ledgerline.operators import market as X
from ledgerline.operators.targets import drawdown_labels


def bars(spark, closes, volumes):
    start = datetime.date(2020, 1, 1)
    rows = [("A", start + datetime.timedelta(days=i), float(c), float(c) * 1.01, float(c) * 0.99, float(v), 5.0) for i, (c, v) in enumerate(zip(closes, volumes))]
    return spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume double, transactions double")


def test_an_early_outlier_leaves_later_frames_alone(spark):
    rng = np.random.default_rng(3)
    closes, volumes = 10 + rng.random(320), 2 + rng.random(320)
    volumes[20] = 1e15
    closes[5] = np.nan
    got = X.market_features(bars(spark, closes, volumes)).orderBy("date").collect()
    assert got[-1]["avg_dollar_volume_63d"] == pytest.approx((closes * volumes)[-63:].mean(), rel=1e-12)
    log = np.diff(np.log(closes))
    for i in (40, 120, 319):
        assert got[i]["volatility_21d"] == pytest.approx(log[i - 21 : i].std(ddof=1) * np.sqrt(252), rel=1e-9)
    assert got[10]["volatility_21d"] is None and got[5]["close"] is None


def test_equal_observations_give_one_path(spark):
    table = bars(spark, np.linspace(10, 12, 400), np.ones(400))
    day = datetime.date(2020, 1, 1)
    one = spark.createDataFrame([("A", day)], "ticker string, period_end date")
    two = one.unionByName(one)
    counts = [[r["future_bar_count"] for r in drawdown_labels(o, table).collect()] for o in (one, two)]
    assert counts[1] == counts[0] * 2 and counts[0][0] == 366


def test_several_rows_for_a_key_are_an_error(spark):
    main = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    extra = spark.createDataFrame([(1, 5), (1, 6)], "k int, y int")
    for merge in (J.merge_fill, J.merge_new_columns):
        with pytest.raises(Exception, match="several rows"):
            merge(main, extra, ["k"]).collect()
    free = spark.createDataFrame([(1, 5), (None, 6), (None, 7)], "k int, y int")
    assert {(r["k"], r["y"]) for r in J.merge_fill(main, free, ["k"]).collect()} == {(1, 5), (2, None)}


@pytest.mark.parametrize(("text", "listed", "texts"), [
    ('["None of the above", "b"]', ["None of the above", "b"], ["None of the above", "b"]), ("[]", [], []), ("[None, 'a']", [None, "a"], ["a"]),
    ("a, b", [], ["a", "b"]), (None, [], []), ("['x', None]", ["x", None], ["x"]),
])
def test_list_texts(spark, text, listed, texts):
    row = spark.createDataFrame([(text,)], "c string").select(L.parse_list("c").alias("a"), L.parse_texts("c").alias("b")).first()
    assert row["a"] == listed and row["b"] == texts


def test_money_is_not_clipped_to_one(spark):
    df = spark.createDataFrame([(250.0, -3.0), (10.0, 12.0)], "y_true double, y_pred_model_output double")
    got = A.prediction_columns(df, (0.0, None)).select("y_pred", "clip_applied").collect()
    assert [tuple(r) for r in got] == [(0.0, True), (12.0, False)]
    assert A.prediction_columns(df, (0.0, 1.0)).agg(F.max("y_pred")).first()[0] == 1.0
