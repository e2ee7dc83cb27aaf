import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import attribution as A
from ledgerline.operators import metrics as M
from ledgerline.operators import prep as N
from ledgerline.operators import training as T

FEATURES = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 600
    pdf = pd.DataFrame(rng.normal(0, 1, (n, 3)), columns=FEATURES)
    pdf["label"] = 0.5 + 0.2 * pdf.x1 - 0.1 * pdf.x2 + rng.normal(0, 0.02, n)
    pdf["row_id"], pdf["fiscal_year"] = np.arange(n), 2010 + np.arange(n) % 6
    pdf["ticker"] = np.where(np.arange(n) < 200, "HOT", "T" + pd.Series(np.arange(n) % 40).astype(str))
    return spark.createDataFrame(pdf).withColumn("split", F.when(F.col("fiscal_year") == 2015, "val").otherwise("train")).persist()


def val_rmse(scored):
    return scored.where("split = 'val'").agg(M.rmse(F.col("label"), F.col("y_pred_model_output"))).first()[0]


def test_models_beat_the_mean(data):
    mean = data.where("split = 'train'").agg(F.avg("label")).first()[0]
    base = val_rmse(data.withColumn("y_pred_model_output", F.lit(mean)))
    trees = val_rmse(T.predict_with(T.fit_trees(data, FEATURES, rounds=20, eta=0.2, depth=3), data, FEATURES))
    linear = val_rmse(T.predict_with(T.fit_robust_linear(data, FEATURES), data, FEATURES))
    assert trees < 0.7 * base and linear < 0.15 * base


def test_network_learns_and_restores_the_best(data):
    model = T.fit_network(data, FEATURES, epochs=25, rate=0.03, hidden=(8,))
    losses = [h["val_loss"] for h in model["history"]]
    assert losses[-1] < losses[0] and model["best_val_loss"] == min(losses)
    scored = T.score_network(data, model)
    e = F.abs(F.col("y_pred_model_output") - F.col("label"))
    huber = scored.where("split = 'val'").agg(F.avg(F.when(e <= 0.05, 0.5 * e * e).otherwise(0.05 * (e - 0.025)))).first()[0]
    assert huber == pytest.approx(model["best_val_loss"])


def test_residual_and_multiple_round_trip(spark):
    df = spark.createDataFrame([(120.0, 100.0, 40.0)], "y double, base double, rev double")
    r = df.withColumn("res", T.residual_target("y", "base")).withColumn("m", T.log_multiple_target("y", "rev")).select(
        T.from_residual("res", "base").alias("a"), T.from_log_multiple("m", "rev").alias("b")).first()
    assert r["a"] == pytest.approx(120) and r["b"] == pytest.approx(120)


def test_ticker_split_is_disjoint_even_with_a_hot_ticker(data):
    out = N.ticker_split(data.drop("split"), 100, skip_last=True)
    both = out.groupBy("ticker").agg(F.count_distinct("split").alias("n")).where("n > 1").count()
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert both == 0 and sizes["val"] >= 100 and sizes["train"] > 0


def test_split_fallbacks(data):
    one_year = data.drop("split").withColumn("fiscal_year", F.lit(2010))
    by_ticker = N.latest_years_split(one_year, ["row_id"], min_rows=50)
    assert by_ticker.groupBy("ticker").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    one_ticker = one_year.withColumn("ticker", F.lit("A"))
    assert N.latest_years_split(one_ticker, ["row_id"], min_rows=50).where("split = 'val'").count() == 90
    assert N.time_aware_split(one_year, ["row_id"]).where("split = 'val'").count() == 120


def test_folds(data):
    base = data.drop("split")
    groups = N.group_kfold(base, 4)
    assert groups.groupBy("ticker").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert groups.count() == 600 and {r["fold"] for r in groups.select("fold").distinct().collect()} == {1, 2, 3, 4}
    sizes = [r["count"] for r in N.row_kfold(base, 7, ["row_id"]).groupBy("fold").count().collect()]
    assert sorted(sizes) == [85, 85, 86, 86, 86, 86, 86]
    years = {r["fold"]: sorted(r["y"]) for r in N.time_kfold(base, 4).groupBy("fold").agg(F.collect_set("fiscal_year").alias("y")).collect()}
    assert years == {1: [2010, 2011], 2: [2012, 2013], 3: [2014], 4: [2015]}


def test_row_split_size_and_seed(data):
    a = N.hash_row_split(data.drop("split"), ["row_id"], 120, seed=1)
    b = N.hash_row_split(data.drop("split"), ["row_id"], 120, seed=2)
    assert a.where("split = 'val'").count() == b.where("split = 'val'").count() == 120
    assert a.where("split = 'val'").join(b.where("split = 'val'"), "row_id").count() < 120


def test_correlation_selection_drops_copies(data):
    d = data.withColumns({"copy": F.col("x1") * 3 + 1, "flat": F.lit(2.0)})
    assert N.select_by_correlation(d, ["copy", "x1", "x2", "x3", "flat"], "label", min_features=2, min_corr=0.2) in (["copy", "x2"], ["x1", "x2"])


def test_pca_matches_numpy(data):
    d = data.withColumn("x3", F.col("x1") * 0.9 + F.col("x3") * 0.1)
    model = N.fit_pca(d, FEATURES, 0.9)
    x = d.select(*FEATURES).toPandas().to_numpy()
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert np.allclose(model["ratio"], (s / s.sum())[: len(model["ratio"])])
    assert all(max(c, key=abs) > 0 for c in model["components"])


def test_linear_attributions_add_up_and_shapley_agrees(data):
    coef = {"x1": 0.2, "x2": -0.1, "x3": 0.0}
    gap = A.additivity_table(A.linear_attributions(data, coef, 0.5, "row_id"), "row_id").first()
    assert gap["max_abs_gap"] < 1e-9 and gap["rows"] == 600
    w = np.array(list(coef.values()))
    predict = lambda x: x @ w + 0.5
    rows = data.where("row_id < 20")
    shap = A.sampled_shapley(rows, data, FEATURES, predict, "row_id", permutations=8).toPandas()
    x = rows.orderBy("row_id").select(*FEATURES).toPandas().to_numpy()
    total = shap.groupby("row_id")["shap"].sum().to_numpy() + shap["base_value"].iloc[0]
    assert np.allclose(total, predict(x))


def test_sweep_marks_one_best_and_search_scores_all(data):
    sweep = T.huber_sweep(data, FEATURES, epsilons=(1.1, 1.5)).collect()
    assert sum(r["best"] for r in sweep) == 1
    _, table = T.candidate_search(N.group_kfold(data.drop("split"), 2), FEATURES, depths=(2,), rounds=(3, 6))
    assert table.count() == 2


def test_held_out_report_and_cross_validation(data):
    d = data.withColumn("baseline", F.lit(0.5))
    fit = lambda x: T.fit_robust_linear(x.withColumn("split", F.lit("train")), FEATURES)
    predict = lambda m, x: T.predict_with(m, x, FEATURES)
    late = d.select(F.max("fiscal_year").alias("fiscal_year"))
    out, table = T.held_out_report(d, late, ["fiscal_year"], FEATURES, "label", "baseline", fit, predict, (0.0, 1.0))
    r = {x["model"]: x["rmse"] for x in table.collect()}
    assert r["model"] < r["baseline"] and out.select("fiscal_year").distinct().count() == 1
    folds = T.cross_validated(N.group_kfold(d.drop("split"), 3), "fold", "label", lambda x: T.fit_robust_linear(x, FEATURES), predict)
    assert folds.count() == 3 and M.fold_aggregate(folds, ["rmse"]).first()["max"] < 0.05
