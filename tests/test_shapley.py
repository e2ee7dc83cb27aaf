"""Tree attributions against all coalitions of features, sampled values against exact ones."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import attribution as A
from ledgerline.operators import training as T
from ledgerline.operators.boosting import Boosting, fit_boosted
from ledgerline.operators.shapley import expected_output, explained, from_spark_trees, sampled_values

FEATURES = ["a", "b", "c", "d"]


def data(n=500):
    r = np.random.default_rng(2)
    x = r.normal(size=(n, 4)).round(1)
    return x, np.sin(2 * x[:, 0]) * (x[:, 1] > 0) + 0.5 * np.abs(x[:, 2]) + 0.1 * x[:, 0] * x[:, 3]


@pytest.fixture(scope="module")
def rows(spark):
    x, y = data()
    return spark.createDataFrame([(i, *map(float, v), float(t), i % 3) for i, (v, t) in enumerate(zip(x, y, strict=True))],
                                 "row_id long, a double, b double, c double, d double, label double, fold int").repartition(2)


@pytest.fixture(scope="module")
def model(rows):
    return fit_boosted(rows, FEATURES, {"m": Boosting(depth=4, eta=0.3, rounds=12)})["m"]


def coalition(model, t, x, known, at=0):
    """Output of one tree when only some features are known; the others follow the training rows."""
    f = model.feature[t, at]
    if f < 0:
        return model.value[t, at]
    left, right = 2 * at + 1, 2 * at + 2
    if f in known:
        return coalition(model, t, x, known, left if x[f] <= model.threshold[t, at] else right)
    a, b = model.cover[t, left], model.cover[t, right]
    return (a * coalition(model, t, x, known, left) + b * coalition(model, t, x, known, right)) / (a + b)


def over_all_coalitions(model, x):
    d, phi = len(model.features), np.zeros(len(model.features))
    v = {s: sum(coalition(model, t, x, set(s)) for t in range(len(model.feature))) for k in range(d + 1) for s in itertools.combinations(range(d), k)}
    for j in range(d):
        for s in v:
            if j not in s:
                phi[j] += math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) * (v[tuple(sorted((*s, j)))] - v[s])
    return phi, model.base + v[()]


def test_exact_values_match_all_coalitions(model):
    x = data()[0][:25].copy()
    x[3, 1] = np.nan
    got = explained(model, x)
    for row, values in zip(np.where(np.isnan(x), -1e300, x), got, strict=True):
        want, base = over_all_coalitions(model, row)
        assert np.allclose(values, want, atol=1e-10) and abs(base - expected_output(model)) < 1e-10
    assert np.allclose(got.sum(axis=1) + expected_output(model), model(x), atol=1e-10)


def test_values_of_all_rows_add_up_also_in_slices(rows, model):
    whole = A.tree_attributions(rows, model, "row_id")
    gap = A.additivity_table(whole, "row_id").first()
    assert gap["max_abs_gap"] < 1e-6 and gap["rows"] == 500 and whole.count() == 2000
    sliced = A.tree_attributions(rows, model, "row_id", ship_bytes=3000)
    far = whole.join(sliced.select("row_id", "feature", F.col("shap").alias("s"), F.col("y_pred_model_output").alias("o")), ["row_id", "feature"])
    assert far.where("abs(shap - s) > 1e-9 or abs(y_pred_model_output - o) > 1e-9").count() == 0 and far.count() == 2000
    assert A.tree_attributions(rows.where("false"), model, "row_id").count() == 0
    empty = fit_boosted(rows.where("false"), FEATURES, {"m": Boosting()})["m"]
    assert {r["shap"] for r in A.tree_attributions(rows, empty, "row_id").collect()} == {0.0}


def test_trees_of_spark_are_explained_too(rows):
    fitted = T.fit_trees(rows.withColumn("split", F.when(F.col("fold") == 1, "val").otherwise("train")), FEATURES, rounds=4, depth=3, eta=0.5)
    trees = from_spark_trees(fitted, FEATURES)
    scored = T.predict_with(fitted, rows, FEATURES).orderBy("row_id").select(*FEATURES, "y_pred_model_output").toPandas()
    x = scored[FEATURES].to_numpy()
    assert np.allclose(trees(x), scored["y_pred_model_output"])
    assert np.allclose(explained(trees, x[:20])[7], over_all_coalitions(trees, x[7])[0], atol=1e-10)


def test_sampled_values_approach_exact_ones_within_their_errors(rows, model):
    r = np.random.default_rng(0)
    x = data()[0]
    reference = x[:20]
    orders = np.array(list(itertools.permutations(range(4))))
    f = lambda m: m[:, 0] * m[:, 1] + 2 * m[:, 2]
    exact = np.zeros((5, 4))
    exact[:, 0] = [np.mean((v[0] - reference[:, 0]) * (v[1] + reference[:, 1]) / 2) for v in x[50:55]]
    exact[:, 1] = [np.mean((v[1] - reference[:, 1]) * (v[0] + reference[:, 0]) / 2) for v in x[50:55]]
    exact[:, 2] = 2 * (x[50:55, 2] - reference[:, 2].mean())
    got, _ = sampled_values(x[50:55], reference, f, np.repeat(orders, 20, axis=0))
    assert np.allclose(got, exact)
    some, error = sampled_values(x[50:55], reference, model, np.array([r.permutation(4) for _ in range(60)]))
    much, _ = sampled_values(x[50:55], reference, model, np.repeat(orders, 20, axis=0))
    assert (np.abs(some - much) <= 5 * error + 1e-9).all()
    long = A.sampled_shapley(rows.where("row_id < 9"), rows, FEATURES, model, "row_id", permutations=32).toPandas()
    total = long.groupby("row_id")["shap"].sum().to_numpy() + long["base_value"].iloc[0]
    assert np.allclose(total, model(x[:9])) and (long["standard_error"] >= 0).all()
