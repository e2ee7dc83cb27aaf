"""Shapley values: exact and path-dependent for fitted trees, sampled with antithetic orders for any scorer.

A leaf only asks, for each feature on its path, whether the row's value lies in the leaf's interval. With D features on the
path there are 2**D patterns of answers, so the contributions of a leaf are a table over patterns, computed once; a row costs
D comparisons and a lookup per leaf.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.boosting import Trees

#: Bytes of node arrays in one broadcast; a larger ensemble is explained in slices whose values add up.
SHIP_BYTES = 32 << 20
#: Bytes of pattern tables that a task keeps; beyond, it computes them again for every batch.
TABLE_BYTES = 128 << 20
#: Cells of one block of rows x leaves, and of rows x samples x features.
BLOCK = 1 << 21


def from_spark_trees(model, features: list[str]) -> Trees:
    """Node arrays of a fitted GBTRegressionModel; tree weights go into the leaf values."""
    depth = max(t.depth for t in model.trees)
    n = (1 << (depth + 1)) - 1
    shape = (len(model.trees), n)
    out = Trees(list(features), 0.0, np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape), np.zeros(shape))
    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        waiting = [(tree._java_obj.rootNode(), 0)]
        while waiting:
            node, at = waiting.pop()
            out.cover[t, at] = node.impurityStats().count()
            if node.getClass().getSimpleName() == "InternalNode":
                out.feature[t, at], out.threshold[t, at] = node.split().featureIndex(), node.split().threshold()
                waiting += [(node.leftChild(), 2 * at + 1), (node.rightChild(), 2 * at + 2)]
            else:
                out.value[t, at] = weight * node.prediction()
    return out


def expected_output(model: Trees) -> float:
    """Mean output when every split sends its training rows on by their share."""
    mean = model.value.copy()
    for at in range((model.feature.shape[1] - 1) // 2 - 1, -1, -1) if model.feature.size else ():
        inner = model.feature[:, at] >= 0
        left, right = model.cover[inner, 2 * at + 1], model.cover[inner, 2 * at + 2]
        mean[inner, at] = (left * mean[inner, 2 * at + 1] + right * mean[inner, 2 * at + 2]) / (left + right)
    return model.base + float(mean[:, 0].sum() if mean.size else 0.0)


class Leaves:
    """Leaves with the same number of features on their path: feature and interval (low, high] of each, contribution tables."""

    def __init__(self, paths: list[tuple[float, dict[int, list[float]]]], width: int) -> None:
        d = len(paths[0][1])
        self.feature = np.array([list(p) for _, p in paths], np.int64)
        low, high, share = (np.array([[v[k] for v in p.values()] for _, p in paths]) for k in range(3))
        self.low, self.high, self.bits = low, high, 1 << np.arange(d)
        value = np.array([v for v, _ in paths])
        hit = ((np.arange(1 << d)[:, None] & self.bits) > 0).astype(float)  # pattern x feature
        self.table = np.empty((len(paths), 1 << d, d))
        weight = np.array([math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)])
        for j in range(d):
            ways = np.zeros((len(paths), 1 << d, d))  # by size of the coalition of the other features
            ways[..., 0] = 1.0
            for k in (k for k in range(d) if k != j):
                grown = ways * share[:, None, k, None]
                grown[..., 1:] += ways[..., :-1] * hit[None, :, k, None]
                ways = grown
            self.table[..., j] = value[:, None] * (hit[None, :, j] - share[:, None, j]) * (ways @ weight)
        self.to_feature = np.zeros((len(paths), d, width))
        self.to_feature[np.arange(len(paths))[:, None], np.arange(d), self.feature] = 1.0

    def add(self, x: np.ndarray, total: np.ndarray) -> None:
        d = self.feature.shape[1]
        for a in range(0, len(self.feature), step := max(1, BLOCK // (max(len(x), 1) * d))):
            b = slice(a, a + step)
            some = x[:, self.feature[b]]
            pattern = ((some > self.low[b]) & (some <= self.high[b])) @ self.bits
            found = self.table[b][np.arange(pattern.shape[1]), pattern]
            total += found.reshape(len(x), -1) @ self.to_feature[b].reshape(-1, total.shape[1])


def leaf_paths(model: Trees, trees: range) -> Iterator[tuple[float, dict[int, list[float]]]]:
    """(value, feature -> [low, high, share of training rows]) of each leaf; several splits on a feature meet in one interval."""
    for t in trees:
        waiting: list[tuple[int, dict]] = [(0, {})]
        while waiting:
            at, path = waiting.pop()
            f = int(model.feature[t, at])
            if f < 0:
                if path:
                    yield float(model.value[t, at]), path
                continue
            cut, low, high, share = float(model.threshold[t, at]), *path.get(f, [-np.inf, np.inf, 1.0])
            both = model.cover[t, 2 * at + 1] + model.cover[t, 2 * at + 2]
            for child, ends in ((2 * at + 1, [low, min(high, cut)]), (2 * at + 2, [max(low, cut), high])):
                waiting.append((child, {**path, f: [*ends, share * model.cover[t, child] / both]}))


def _groups(model: Trees, trees: range) -> list[Leaves]:
    by_size: dict[int, list] = {}
    for value, path in leaf_paths(model, trees):
        by_size.setdefault(len(path), []).append((value, path))
    return [Leaves(paths, len(model.features)) for paths in by_size.values()]


def explained(model: Trees, x: np.ndarray, kept: list[list[Leaves]] | None = None, step: int = 64) -> np.ndarray:
    """Contribution of each feature (columns) to the output of each row; base value and contributions sum to the output.

    A missing value counts as the smallest, as in training. A split on one feature again and again counts once.
    """
    total = np.zeros((len(x), len(model.features)))
    x = finite(x)
    count = len(model.feature)
    for k, a in enumerate(range(0, count, step)):
        if kept is not None and k < len(kept):
            groups = kept[k]
        else:
            groups = _groups(model, range(a, min(a + step, count)))
            if kept is not None and sum(g.table.nbytes for part in [*kept, groups] for g in part) <= TABLE_BYTES:
                kept.append(groups)
        for g in groups:
            g.add(x, total)
    return total


def finite(x: np.ndarray) -> np.ndarray:
    return np.nan_to_num(np.asarray(x, float), nan=-np.finfo(float).max, posinf=np.finfo(float).max, neginf=-np.finfo(float).max)


def tree_attributions(df: DataFrame, model: Trees, key: str, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """Long table (key, feature, feature_value, shap, base_value, y_pred_model_output) of exact path-dependent values.

    Node arrays go to the tasks in one broadcast of at most `ship_bytes`; a larger ensemble in several, whose values are
    summed. The key must be unique. No rows: no rows. An ensemble without trees explains nothing: all values are 0.
    """
    each = max(1, model.feature[0].nbytes + 3 * model.value[0].nbytes) if len(model.feature) else 1
    step = max(1, ship_bytes // each)
    parts = [_attributed(df, model, slice(a, a + step), key) for a in range(0, max(len(model.feature), 1), step)]
    if len(parts) > 1:
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        parts = [union.groupBy(key, "feature").agg(F.first("feature_value").alias("feature_value"), F.sum("shap").alias("shap"), F.sum("output").alias("output"))]
    columns = [key, "feature", "feature_value", "shap", F.lit(expected_output(model)).alias("base_value")]
    return parts[0].select(*columns, (F.col("output") + F.lit(model.base)).alias("y_pred_model_output"))


def _attributed(df: DataFrame, model: Trees, part: slice, key: str) -> DataFrame:
    small = Trees(model.features, 0.0, model.feature[part], model.threshold[part], model.value[part], model.cover[part])
    shared = df.sparkSession.sparkContext.broadcast(small)
    features, d = model.features, len(model.features)
    number = [T.StructField(c, T.DoubleType()) for c in ("feature_value", "shap", "output")]
    schema = T.StructType([*df.select(key).schema.fields, T.StructField("feature", T.StringType()), *number])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, kept = shared.value, []
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), d), "feature": np.tile(features, len(x)), "feature_value": x.reshape(-1),
                                "shap": explained(trees, x, kept).reshape(-1), "output": np.repeat(trees(x), d)})

    return df.select(key, *features).mapInPandas(run, schema)


def sampled_values(x: np.ndarray, reference: np.ndarray, predict: Callable[[np.ndarray], np.ndarray], orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapley values and their standard errors for rows x, from pairs of an order and its reverse against one reference row.

    All switched rows of a block form one matrix, so a block costs one call of the scorer.
    """
    pairs, d = orders.shape
    both = np.stack([orders, orders[:, ::-1]], axis=1)
    rank = np.argsort(both, axis=2)
    switched = rank[:, :, None, :] < np.arange(d + 1)[:, None]  # pair x direction x step x feature
    back = reference[np.arange(pairs) % len(reference)][:, None, None, :]
    value, error = np.zeros((len(x), d)), np.zeros((len(x), d))
    step = max(1, BLOCK // switched.size)
    for a in range(0, len(x), step):
        some = x[a : a + step]
        rows = np.where(switched, some[:, None, None, None, :], back)
        out = predict(rows.reshape(-1, d)).reshape(rows.shape[:-1])
        gain = np.take_along_axis(np.diff(out, axis=3), np.broadcast_to(rank, (len(some), *rank.shape)), axis=3).mean(axis=2)
        value[a : a + step] = gain.mean(axis=1)
        error[a : a + step] = gain.std(axis=1, ddof=1) / math.sqrt(pairs) if pairs > 1 else np.nan
    return value, error


def sampled_shapley(df: DataFrame, background: DataFrame, features: list[str], predict: Callable[[np.ndarray], np.ndarray], key: str, permutations: int = 128,
                    seed: int = 42, background_rows: int = 64) -> DataFrame:
    """(key, feature, feature_value, shap, standard_error, base_value) for any scorer `matrix -> vector`.

    `permutations` orders, half of them reverses of the others; each pair switches from one reference row to the explained
    row. The references are a fixed-size sample of the background (a parameter of the method), all used equally often, so
    base value and values sum to the scorer's output. The scorer travels with the tasks.
    """
    pairs = max(1, permutations // 2)
    sample = background.orderBy(F.xxhash64(*features, F.lit(seed)), *features).limit(min(background_rows, pairs)).select(*features).toPandas()
    reference, d = sample.to_numpy(dtype=float), len(features)
    pairs = -(-pairs // max(1, len(reference))) * max(1, len(reference))
    number = [T.StructField(c, T.DoubleType()) for c in ("feature_value", "shap", "standard_error", "base_value")]
    schema = T.StructType([*df.select(key).schema.fields, T.StructField("feature", T.StringType()), *number])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        orders = np.array([rng.permutation(d) for _ in range(pairs)])
        base = float(np.mean(predict(reference)))
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            value, error = sampled_values(x, reference, predict, orders)
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), d), "feature": np.tile(features, len(x)), "feature_value": x.reshape(-1),
                                "shap": value.reshape(-1), "standard_error": error.reshape(-1), "base_value": base})

    return df.select(key, *features).mapInPandas(run, schema)
