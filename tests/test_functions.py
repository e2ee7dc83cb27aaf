import math

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import lists as L
from ledgerline.functions import scalars as S
from ledgerline.functions import tails as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("raw, want", [(" abc ", "ABC"), ("nan", None), ("None", None), ("<na>", None), ("", None), (None, None)])
def test_tickers(spark, raw, want):
    assert one(spark, S.normalize_ticker("x"), x=raw) == want


@pytest.mark.parametrize("raw, want", [("1.5", 1.5), ("abc", None), ("NaN", None), ("Infinity", None), (None, None)])
def test_numbers(spark, raw, want):
    assert one(spark, S.to_number("x"), x=raw) == want


def test_division_and_growth(spark):
    assert one(spark, S.safe_div("a", "b"), a=1.0, b=1e-13) is None
    assert one(spark, S.safe_div("a", "b"), a=1.0, b=2.0) == 0.5
    assert one(spark, S.div_nonzero("a", "b"), a=1.0, b=0.0) is None
    assert one(spark, S.signed_growth("a", "b"), a=1.0, b=-2.0) == 1.5
    assert one(spark, S.signed_growth("a", "b"), a=1.0, b=0.0) == pytest.approx(1e12)


def test_sum_present_and_clip(spark):
    null = F.lit(None).cast("double")
    assert one(spark, S.sum_present(null, F.lit(2.0)), x="") == 2.0
    assert one(spark, S.sum_present(null, null), x="") is None
    assert one(spark, S.clip(null, 0.0, 1.0), x="") is None
    assert one(spark, S.clip(F.lit(3.0), 0.0, 1.0), x="") == 1.0


@pytest.mark.parametrize("raw", ["2024-01-05", "2024-01-05T10:00:00Z", "1704448800", "1704448800000", "1704448800000000", "1704448800000000000"])
def test_trade_dates(spark, raw):
    assert str(one(spark, S.trade_date("x"), x=raw)) == "2024-01-05"


def test_year_and_tag(spark):
    assert one(spark, S.parse_year("x"), x="2020.0") == 2020
    assert one(spark, S.parse_year("x"), x="n/a") is None
    assert S.threshold_tag(0.3) == "0p30"
    assert one(spark, S.fraction_rows(F.lit(25), 0.1), x="") == 2
    assert one(spark, S.slug("x"), x="--") == "item"


@pytest.mark.parametrize(
    "cell, want", [("[0.5, -1, \"x\"]", [0.5, -1.0]), ("['0.5', None]", [0.5]), ("0.25", [0.25]), ("junk", []), ("[]", []), (None, [])]
)
def test_score_lists(spark, cell, want):
    assert one(spark, L.parse_scores("x"), x=cell) == want


@pytest.mark.parametrize("cell, want", [('["a, b", " c "]', ["a, b", "c"]), ('a, "b, c", ', ["a", "b, c"]), (None, []), ("", [])])
def test_text_lists(spark, cell, want):
    assert one(spark, L.parse_texts("x"), x=cell) == want


# Published statistic -> p-value pairs.
@pytest.mark.parametrize(
    "got, want",
    [
        (lambda: T.t_two_sided(5.80889956636993, 5085), 6.67066219217628e-09),
        (lambda: T.f_upper(138.38577507629964, 2, 5084), 3.0108600791004935e-59),
        (lambda: T.chi2_upper(585.9229120395685, 4), 1.724831321806318e-125),
        (lambda: T.normal_two_sided(2.437607504931954), 0.014784817271286221),
    ],
)
def test_tail_probabilities(got, want):
    assert math.isclose(got(), want, rel_tol=1e-6)


def test_tail_columns(spark):
    row = spark.range(1).select(T.normal_p(F.lit(1.959963984540054)).alias("n"), T.t_p(F.lit(0.0), 5).alias("t"), T.chi2_p(F.lit(3.841458820694124), 1).alias("c"))
    r = row.first()
    assert r["n"] == pytest.approx(0.05) and r["t"] == pytest.approx(1.0) and r["c"] == pytest.approx(0.05)
