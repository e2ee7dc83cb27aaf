"""Ranks, quantiles and top fractions against brute force, on data where one value holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.operators import ordering as G


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 900
    v = np.concatenate([np.full(300, 1.5), rng.normal(0, 1e6, 300), np.round(rng.normal(0, 2, 200), 1), np.zeros(50), rng.normal(0, 1e-9, 50)])
    pdf = pd.DataFrame({"k": np.arange(n), "g": np.where(rng.random(n) < 0.7, "hot", "cold"), "v": rng.permutation(v)})
    return pdf, spark.createDataFrame(pdf).persist()


def test_average_ranks(skewed):
    pdf, df = skewed
    got = G.with_average_ranks(df, {"v": "r"}, ["g"]).toPandas().sort_values("k")["r"].to_numpy()
    assert np.allclose(got, pdf.groupby("g")["v"].rank(method="average").to_numpy())


def test_quantiles(skewed):
    pdf, df = skewed
    names = {"a": 0.0, "b": 0.005, "c": 0.5, "d": 0.9, "e": 1.0}
    got = G.quantiles(df, "v", names).first()
    assert np.allclose([got[n] for n in names], np.quantile(pdf["v"], list(names.values())))
    grouped = {r["g"]: r["c"] for r in G.quantiles(df, "v", names, ["g"]).collect()}
    assert np.allclose([grouped["hot"], grouped["cold"]], [pdf[pdf.g == g].v.median() for g in ("hot", "cold")])


@pytest.mark.parametrize("fraction", [0.0001, 0.1, 0.5, 1.0])
def test_top_fraction_cuts_through_ties(skewed, fraction):
    pdf, df = skewed
    got = {r["k"] for r in G.top_fraction(df, "v", "k", fraction).collect()}
    k = max(1, round(len(pdf) * fraction))
    assert got == set(pdf.sort_values(["v", "k"], ascending=[False, True]).head(k)["k"])


def test_top_fraction_by_group(skewed):
    pdf, df = skewed
    got = {(r["g"], r["k"]) for r in G.top_fraction(df, "v", "k", 0.3, ["g"]).collect()}
    want = set()
    for g, part in pdf.groupby("g"):
        top = part.sort_values(["v", "k"], ascending=[False, True]).head(max(1, round(len(part) * 0.3)))
        want |= {(g, k) for k in top["k"]}
    assert got == want


def test_cdf(skewed):
    pdf, df = skewed
    got = {r["v"]: r["cdf"] for r in G.with_cdf(df, "v").collect()}
    assert all(abs(c - (pdf["v"] <= v).mean()) < 1e-12 for v, c in got.items())


def test_infinities_and_nan_stay_last(spark):
    values = [float("nan"), float("inf"), 1.0, float("-inf"), 1e300, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = G.cumulative_counts(df, "v").orderBy("n_before").collect()
    assert [str(r["v"]) for r in rows] == ["-inf", "0.0", "1.0", "1e+300", "inf", "nan"]
    assert [r["n_before"] for r in rows] == [0, 1, 2, 3, 4, 5]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=2, max_size=60))
def test_grid_keeps_order(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", G.grid_cell(F.col("v")).alias("c"))
    rows = sorted((r["v"], r["c"]) for r in df.collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))


def test_close_values_spread_over_parts(spark):
    """Ids far from zero, epoch times and a constant: exact ranks, and no part far above the mean."""
    for name, column in {"ids": F.col("id") + 10**12, "times": F.lit(1.7e9) + F.col("id") * 0.001, "same": F.lit(5.0) + F.col("id") * 0}.items():
        df = spark.range(100_000).withColumn("v", column)
        counts = G.cumulative_counts(df, "v")
        distinct = df.select("v").distinct()
        cells = G._cut_again(distinct.withColumn(G.CELL, G.grid_cell(F.col("v"))), "v", []).groupBy(G.CELL, G.PART).count()
        top = cells.agg(F.max("count"), F.avg("count")).first()
        assert top[0] <= 2 * max(top[1], G.PART_VALUES), name
        wrong = counts.where(F.col("n_before") != F.col("v").cast("long") - 10**12).count() if name == "ids" else 0
        assert wrong == 0 and counts.agg(F.max(F.col("n_before") + F.col("n"))).first()[0] == 100_000


def test_tables_sent_to_all_tasks_do_not_grow_with_the_values(spark):
    """Cells and offsets of values over ten factors e: few rows, however many values there are, and exact ranks."""
    df = spark.range(60_000).select(F.exp(F.col("id") / 6000).alias("v"))
    assert df.select(G.grid_cell(F.col("v"))).distinct().count() <= 2000
    rows = G.cumulative_counts(df, "v").agg(F.count("*"), F.sum("n_before"), F.max(F.abs(F.col("n_before") - F.round(F.ln("v") * 6000)))).first()
    assert tuple(rows) == (60_000, 60_000 * 59_999 // 2, 0)


def test_quantiles_between_parts(spark, monkeypatch):
    """Wanted positions on both sides of a part's end, and groups with null and repeated values."""
    monkeypatch.setattr(G, "PART_VALUES", 2)
    values = [1.0, 1.001, 1.002, 1.003, 7.0, 7.0, 7.0, 9.0, -3.0, None]
    df = spark.createDataFrame([(g, v) for g in ("a", None) for v in values], "g string, v double")
    got = {r["g"]: (r["n_values"], r["q25"], r["q50"], r["q90"]) for r in G.quantiles(df, "v", {"q25": 0.25, "q50": 0.5, "q90": 0.9}, ["g"]).collect()}
    want = tuple(float(x) for x in np.quantile([v for v in values if v is not None], [0.25, 0.5, 0.9]))
    assert all(got[g][0] == 9 and got[g][1:] == pytest.approx(want) for g in ("a", None))
