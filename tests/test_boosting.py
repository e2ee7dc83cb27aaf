"""Boosted trees: jobs by level against one task, against a plain search, and early stopping."""

import numpy as np
import pytest

from ledgerline.operators.boosting import Boosting, Growing, best_split, fit_boosted, fit_until_best, histograms, search_candidates

FEATURES = ["a", "b", "c"]


def table(n=400, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)).round(2)
    y = np.where(x[:, 0] > 0.3, 1.0, -0.5) + 0.3 * x[:, 1] * (x[:, 2] > 0) + r.normal(0, 0.2, n)
    return x, y, r.uniform(0.5, 2, n)


@pytest.fixture(scope="module")
def rows(spark):
    x, y, w = table()
    data = [(i, *map(float, x[i]), float(y[i]), float(w[i]), int(i % 4)) for i in range(len(y))]
    return spark.createDataFrame(data, "row_id long, a double, b double, c double, label double, w double, fold int").repartition(3)


def test_levels_as_jobs_grow_the_trees_of_one_task(rows):
    fits = {"deep": Boosting(depth=3, eta=0.3, rounds=6, held=1), "shallow": Boosting(depth=2, eta=0.5, rounds=23, patience=2, columns=0.67, held=2),
            "all": Boosting(depth=1, rounds=3, eta=1.0, subsample=1.0, held=None)}
    one = fit_boosted(rows, FEATURES, fits, weight="w")
    many = fit_boosted(rows, FEATURES, fits, weight="w", local_cells=0)
    x = table(50, 9)[0]
    for name in fits:
        assert np.array_equal(one[name].feature, many[name].feature) and np.allclose(one[name].threshold, many[name].threshold)
        assert np.allclose(one[name](x), many[name](x)) and np.allclose(one[name].history, many[name].history, equal_nan=True)
    assert one["all"].best_round == 3 and 0 < one["shallow"].best_round < 23


def test_splits_match_a_search_over_all_cuts():
    r, p = np.random.default_rng(3), Boosting(l2=0.5, min_weight=2.0)
    bins, g, h = r.integers(0, 6, (60, 2)).astype(np.uint8), r.normal(size=60), r.uniform(0.5, 1.5, 60)
    found = best_split(histograms(bins, np.zeros(60, int), 1, 6, g, h)[0], np.array([True, True]), p)
    gain = {}
    for f in range(2):
        for b in range(5):
            left = bins[:, f] <= b
            if min(h[left].sum(), h[~left].sum()) >= 2:
                part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 0.5)  # noqa: B023, E731
                gain[(f, b)] = part(left) + part(~left) - part(left | ~left)
    assert (found[0], found[1]) == max(gain, key=gain.get)


def test_stops_at_the_best_round_and_scores_each_prefix(spark, rows):
    split = rows.selectExpr("*", "if(fold = 1, 'val', 'train') as split")
    model = fit_until_best(split, FEATURES, rounds=300, eta=0.2, patience=15)
    held = [h for _, h in model.history]
    assert model.best_round == int(np.argmin(held)) + 1 < 300 and len(held) == model.best_round + 15
    x, y, _ = table()
    val = np.arange(len(y)) % 4 == 1
    assert abs(np.mean((model(x[val]) - y[val]) ** 2) - min(held)) < 1e-9
    assert min(held) < 0.5 * np.var(y[val])


def test_missing_labels_features_and_empty_tables(spark, rows):
    some = rows.selectExpr("row_id", "if(row_id % 7 = 0, null, a) as a", "b", "cast(null as double) as c", "if(row_id % 5 = 0, null, label) as label", "fold")
    model = fit_boosted(some, FEATURES, {"m": Boosting(rounds=5)})["m"]
    assert 0 < model.best_round <= 5 and 2 not in model.feature
    nothing = fit_boosted(some.where("false"), FEATURES, {"m": Boosting(rounds=5)})["m"]
    assert nothing(np.zeros((2, 3))).tolist() == [0.0, 0.0]


def test_search_picks_the_smallest_mean_loss(rows):
    best, found = search_candidates(rows, FEATURES, {"stump": {"depth": 1, "eta": 0.3, "rounds": 20}, "tree": {"depth": 3, "eta": 0.3, "rounds": 20}, "slow": {"depth": 3, "eta": 0.001, "rounds": 20}})
    got = [tuple(r) for r in found.collect()]
    assert [r[3] for r in got] == [1, 2, 3] and got[-1][0] == "slow" and got[0][2] <= got[1][2] < got[2][2]
    assert best.best_round == got[0][1]


def test_histograms_add_feature_by_feature_and_levels_go_on_from_the_last():
    """No index or weight per row and feature at once; sums and places as from the root."""
    import tracemalloc

    r = np.random.default_rng(3)
    rows, width = 100_000, 7
    bins, node = r.integers(0, 16, (rows, width)).astype(np.uint8), r.integers(0, 4, rows)
    g, h = r.normal(size=rows), r.random(rows)
    tracemalloc.start()
    got = histograms(bins, node, 4, 16, g, h)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * rows  # an index and two weights for every feature would be 168 bytes a row
    for f, b, n in ((0, 3, 1), (6, 15, 3)):
        at = (bins[:, f] == b) & (node == n)
        assert got[n, f, b] == pytest.approx([g[at].sum(), h[at].sum(), at.sum()])
    tree = Growing(Boosting(depth=3))
    tree.feature[[0, 1, 2]], tree.bin[[0, 1, 2]] = [2, 0, 6], [7, 3, 11]
    at = np.zeros(rows, np.int64)
    for level in range(3):
        at = tree.below(bins, at, level)
        assert np.array_equal(at, tree.places(bins, level + 1))
    left = bins[:, 2] <= 7
    assert np.array_equal(np.unique(at[left]), [3, 4]) and np.array_equal(np.unique(at[~left]), [5, 6])
