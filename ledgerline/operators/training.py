"""Training and scoring on prepared tables (`split` = train / val)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import scalars as S
from ledgerline.operators import metrics as M
from ledgerline.operators.boosting import Trees
from ledgerline.operators.cleaning import without
from ledgerline.operators.prep import as_vectors


def fit_trees(df: DataFrame, features: list[str], label: str = "label", weight: str | None = None, depth: int = 5,
              rounds: int = 100, eta: float = 0.03, subsample: float = 0.9, seed: int = 42):
    """Boosted regression trees that stop on the validation rows."""
    gbt = GBTRegressor(
        labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=eta, subsamplingRate=subsample, seed=seed,
        validationIndicatorCol="is_val", validationTol=0.0,
    )
    if weight:
        gbt = gbt.setWeightCol(weight)
    return gbt.fit(as_vectors(df.withColumn("is_val", F.col("split") == "val"), features))


def fit_robust_linear(df: DataFrame, features: list[str], label: str = "label", weight: str | None = None,
                      epsilon: float = 1.35, rounds: int = 100):
    """Linear regression with the Huber loss on the training rows."""
    lr = LinearRegression(labelCol=label, loss="huber", epsilon=epsilon, maxIter=rounds, standardization=True)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(as_vectors(df.where("split = 'train'"), features))


def predict_with(model, df: DataFrame, features: list[str], name: str = "y_pred_model_output") -> DataFrame:
    out = model.transform(as_vectors(df, features))
    return out.withColumnRenamed("prediction", name).drop("features")


def linear_expression(coefficients: dict[str, float], intercept: float) -> Column:
    """A linear model as a plain expression: no Python and no vectors at scoring time."""
    return sum((F.col(f) * float(c) for f, c in coefficients.items()), F.lit(float(intercept)))


# --- network: data-parallel gradients on the executors, small parameters on the driver -------------------------


def init_network(sizes: list[int], seed: int = 42) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    out: list[np.ndarray] = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        out += [rng.normal(0.0, math.sqrt(2.0 / a), (a, b)), np.zeros(b)]
    return out


def network_output(parameters: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    h = x
    for i in range(0, len(parameters), 2):
        h = h @ parameters[i] + parameters[i + 1]
        if i + 2 < len(parameters):
            h = np.maximum(h, 0.0)
    return h.reshape(-1)


def _batch_gradient(parameters, x, y, w, delta, dropout, rng):
    """Weighted Huber loss and gradient sums of one Arrow batch."""
    activations, masks, h = [x], [], x
    layers = len(parameters) // 2
    for i in range(layers):
        h = h @ parameters[2 * i] + parameters[2 * i + 1]
        if i + 1 < layers:
            keep = (rng.random(h.shape) >= dropout) / (1.0 - dropout)
            masks.append((h > 0) * keep)
            h = np.maximum(h, 0.0) * keep
            activations.append(h)
    error = h.reshape(-1) - y
    small = np.abs(error) <= delta
    loss = np.where(small, 0.5 * error**2, delta * (np.abs(error) - 0.5 * delta))
    back = (w * np.where(small, error, delta * np.sign(error))).reshape(-1, 1)
    gradients: list[np.ndarray] = []
    for i in range(layers - 1, -1, -1):
        gradients = [activations[i].T @ back, back.sum(axis=0), *gradients]
        if i > 0:
            back = (back @ parameters[2 * i].T) * masks[i - 1]
    return float(np.sum(w * loss)), gradients


def _gradient_sums(df: DataFrame, features, label, weight, parameters, delta, dropout, seed):
    """One Spark job: every partition sends a single row with its loss, weight and gradient sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng((seed, TaskContext.get().partitionId()))
        loss, mass, total = 0.0, 0.0, None
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            w = pdf[weight].to_numpy(dtype=float) if weight else np.ones(len(pdf))
            part_loss, part = _batch_gradient(parameters, x, pdf[label].to_numpy(dtype=float), w, delta, dropout, rng)
            loss, mass = loss + part_loss, mass + float(w.sum())
            total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pd.DataFrame({"loss": [loss], "mass": [mass], "g": [np.concatenate([t.reshape(-1) for t in total])]})

    columns = [*features, label, *([weight] if weight else [])]
    parts = df.select(*columns).mapInPandas(run, "loss double, mass double, g array<double>")
    # Sums per parameter position: the driver receives one vector of the network's size.
    tall = parts.select(F.posexplode(F.concat(F.array("loss", "mass"), F.col("g"))).alias("i", "v"))
    summed = tall.groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(summed))
    for r in summed:
        flat[r["i"]] = r["v"]
    return flat[0], flat[1], flat[2:]


def fit_network(df: DataFrame, features: list[str], label: str = "label", weight: str | None = None, hidden=(16, 8),
                epochs: int = 60, rate: float = 0.01, delta: float = 0.05, dropout: float = 0.0, l1: float = 0.0,
                l2: float = 1e-4, patience: int = 10, seed: int = 42) -> dict:
    """Dense regression network: Huber loss, Adam on full-data gradients, early stopping with the best weights.

    `df` holds scaled features and a `split` column. Rows stay on the executors; parameters are a few thousand numbers.
    """
    train = df.where("split = 'train'").persist()
    val = df.where("split = 'val'").persist()
    parameters = init_network([len(features), *hidden, 1], seed)
    shapes = [p.shape for p in parameters]
    sizes = [p.size for p in parameters]
    m = v = np.zeros(sum(sizes))
    best, best_loss, waited, history = parameters, float("inf"), 0, []
    flatten = lambda ps: np.concatenate([p.reshape(-1) for p in ps])
    matrix = np.concatenate([np.full(s, len(shape) == 2, dtype=bool) for s, shape in zip(sizes, shapes)])
    try:
        for epoch in range(1, epochs + 1):
            loss, mass, g = _gradient_sums(train, features, label, weight, parameters, delta, dropout, seed + epoch)
            flat = flatten(parameters)
            g = g / mass + np.where(matrix, l2 * flat + l1 * np.sign(flat), 0.0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
            cuts = np.split(flat, np.cumsum(sizes)[:-1])
            parameters = [c.reshape(s) for c, s in zip(cuts, shapes)]
            val_loss = _validation_loss(val, features, label, parameters, delta)
            history.append({"epoch": epoch, "train_loss": float(loss / mass), "val_loss": val_loss})
            if val_loss < best_loss - 1e-9:
                best, best_loss, waited = parameters, val_loss, 0
            else:
                waited += 1
                if waited >= patience:
                    break
    finally:
        train.unpersist()
        val.unpersist()
    return {"parameters": best, "features": list(features), "history": history, "best_val_loss": best_loss}


def _validation_loss(val: DataFrame, features, label, parameters, delta) -> float:
    scored = score_network(val, {"parameters": parameters, "features": features}, "_p")
    e = F.abs(F.col("_p") - F.col(label))
    loss = F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))
    return float(scored.agg(F.avg(loss)).first()[0])


def score_network(df: DataFrame, model: dict, name: str = "y_pred_model_output") -> DataFrame:
    """Batch scoring with the parameters shipped in the task."""
    parameters, features = model["parameters"], model["features"]
    return score_batches(df, lambda pdf: network_output(parameters, pdf[features].to_numpy(dtype=float)), name)


def score_trees(df: DataFrame, model: Trees, name: str = "y_pred_model_output") -> DataFrame:
    """Batch scoring with node arrays, shipped in one broadcast; its size is rounds x nodes of a tree."""
    shared, features = df.sparkSession.sparkContext.broadcast(model), model.features
    return score_batches(df, lambda pdf: shared.value(pdf[features].to_numpy(dtype=float)), name)


def score_batches(df: DataFrame, scorer: Callable[[pd.DataFrame], np.ndarray], name: str) -> DataFrame:
    """The scorer protocol: any `batch -> vector` runs over Arrow batches inside the tasks."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: scorer(pdf)})

    return df.mapInPandas(run, schema)


# --- targets, baselines, guards ---------------------------------------------------------------------------------


def current_drawdown_baseline(df: DataFrame, train: DataFrame, feature: str = "drawdown_126d", target: str = "drawdown_severity") -> DataFrame:
    """clip(-drawdown, 0, 1), the training mean where it is missing."""
    mean = train.agg(F.avg(target)).scalar()
    return df.withColumn("y_pred_baseline", F.coalesce(S.clip(-F.col(feature), 0.0, 1.0), mean))


def log_mean_baseline(df: DataFrame, train: DataFrame, target: str) -> DataFrame:
    mean = train.agg(F.avg(S.log1p_floor(target))).scalar()
    return df.withColumn("y_pred_baseline", F.expm1(mean))


def residual_target(target: str, base: str, log_scale: bool = True) -> Column:
    f = S.log1p_floor if log_scale else F.col
    return f(target) - f(base)


def from_residual(residual: str, base: str, log_scale: bool = True) -> Column:
    return F.expm1(F.col(residual) + S.log1p_floor(base)) if log_scale else F.col(residual) + F.col(base)


def tiny_base_regime(prediction: str, base: str, threshold: float) -> Column:
    """Rows whose base is at most the threshold keep the base as prediction."""
    return F.when(F.col(base) <= threshold, F.col(base)).otherwise(F.col(prediction))


def log_multiple_target(market_cap: str, revenue: str) -> Column:
    cap, rev = F.col(market_cap), F.col(revenue)
    return F.when((cap > 0) & (rev > 0), F.ln(cap / rev))


def from_log_multiple(multiple: str, revenue: str) -> Column:
    return F.exp(multiple) * F.col(revenue)


def ood_score(df: DataFrame, features: list[str], name: str = "feature_zscore_max") -> DataFrame:
    """Largest |z| over scaled features."""
    zs = [F.abs(F.col(f)) for f in features]
    return df.withColumn(name, F.greatest(*zs) if len(zs) > 1 else zs[0])


def guarded_prediction(df: DataFrame, prediction: str, baseline: str, low: float = 0.0, high: float | Column = float("inf"),
                       max_relative_deviation: float = 3.0, min_base: float = 1e-6, ratio_low: float = 0.1,
                       ratio_high: float = 10.0, zscore: str | None = None, max_zscore: float = 8.0) -> DataFrame:
    """Clip, then fall back to the baseline on relative deviation, ratio or an out-of-distribution row."""
    clipped = S.clip(prediction, low, high)
    d = df.withColumn("y_pred_after_clip", clipped)
    base = F.greatest(F.abs(F.col(baseline)), F.lit(min_base))
    far = F.abs(F.col("y_pred_after_clip") - F.col(baseline)) / base > max_relative_deviation
    ratio = F.col("y_pred_after_clip") / base
    odd = (ratio < ratio_low) | (ratio > ratio_high)
    ood = (F.col(zscore) > max_zscore) if zscore else F.lit(False)
    d = d.withColumns({"fallback_rel": far, "fallback_ratio": odd, "fallback_ood": ood})
    any_of = F.col("fallback_rel") | F.col("fallback_ratio") | F.col("fallback_ood")
    return d.withColumns(
        {"fallback_any": any_of, "y_pred_final": F.when(any_of, F.col(baseline)).otherwise(F.col("y_pred_after_clip"))}
    )


def guard_rates(guarded: DataFrame) -> DataFrame:
    names = ["any", "rel", "ratio", "ood"]
    return guarded.agg(*[F.avg(F.col(f"fallback_{n}").cast("double")).alias(f"fallback_{n}_rate") for n in names])


def prediction_frame(df: DataFrame, output: str, target: str, split: str, keep: list[str], bounds: tuple[float | None, float | None],
                     raw_target: str | None = None, baseline: str | None = None) -> DataFrame:
    """Predictions clipped to `bounds`: (0, 1) for severities, (0, None) for money."""
    columns = [F.lit(split).alias("split"), S.to_number(target).alias("y_true"), S.clip(output, *bounds).alias("y_pred")]
    if baseline:
        columns.append(S.clip(baseline, *bounds).alias("y_pred_baseline"))
    if raw_target:
        columns.append(S.to_number(raw_target).alias("y_true_raw_drawdown"))
    return df.select(*keep, *columns)


def generalization(metrics_by_split: DataFrame) -> DataFrame:
    """Typical factor exp(RMSE log) and the train/val gaps from a table (split, rmse_log, r2_log)."""
    pick = lambda split, c: F.max(F.when(F.col("split") == split, F.col(c)))
    return metrics_by_split.agg(
        F.exp(pick("val", "rmse_log")).alias("model_factor"),
        (pick("val", "rmse_log") - pick("train", "rmse_log")).alias("gap_rmse_log"),
        (pick("train", "r2_log") - pick("val", "r2_log")).alias("gap_r2_log"),
    )


# --- runs -------------------------------------------------------------------------------------------------------


def held_out_report(df: DataFrame, test_keys: DataFrame, keys: list[str], features: list[str], target: str, baseline: str,
                    fit: Callable[[DataFrame], object], predict: Callable[[object, DataFrame], DataFrame],
                    bounds: tuple[float | None, float | None]) -> tuple[DataFrame, DataFrame]:
    """Train without the held-out years or tickers, score them inside `bounds`, compare with the baseline.

    Returns (predictions with the value before clipping, metric table).
    """
    model = fit(without(df, test_keys, keys))
    test = df.join(test_keys.select(*keys).distinct(), keys, "left_semi")
    scored = predict(model, test).withColumn("y_true", F.col(target))
    out = scored.withColumn("y_pred", S.clip("y_pred_model_output", *bounds))
    long = out.select("y_true", F.col("y_pred").alias("model"), F.col(baseline).alias("baseline")).unpivot(["y_true"], ["model", "baseline"], "model", "y_pred")
    return out, M.metric_table(long, M.RISK_METRICS)


def cross_validated(df: DataFrame, fold: str, label: str, fit: Callable[[DataFrame], object],
                    predict: Callable[[object, DataFrame], DataFrame]) -> DataFrame:
    """Fit once per fold on the other folds; one metric row per fold. The loop runs over folds, a handful."""
    folds = sorted(r[fold] for r in df.select(fold).distinct().collect())
    rows = None
    for k in folds:
        marked = df.withColumn("split", F.when(F.col(fold) == k, F.lit("val")).otherwise(F.lit("train")))
        scored = predict(fit(marked), marked.where(F.col(fold) == k))
        part = scored.select(F.lit(k).alias("fold"), F.col(label).alias("y_true"), F.col("y_pred_model_output").alias("y_pred"))
        rows = part if rows is None else rows.unionByName(part)
    return M.metric_table(rows, {**M.RISK_METRICS, "rmse_log": M.rmse_log}, ["fold"])


def huber_sweep(df: DataFrame, features: list[str], label: str = "label", epsilons=(1.05, 1.2, 1.35, 1.5, 2.0, 3.0)) -> DataFrame:
    """Validation error per Huber epsilon; the best has the lowest log RMSE, then the lowest MAPE."""
    val = df.where("split = 'val'")
    rows = None
    for e in epsilons:
        scored = predict_with(fit_robust_linear(df, features, label, epsilon=e), val, features)
        part = scored.select(F.lit(float(e)).alias("epsilon"), F.col(label).alias("y_true"), F.col("y_pred_model_output").alias("y_pred"))
        rows = part if rows is None else rows.unionByName(part)
    table = M.metric_table(rows, {"rmse": M.rmse, "rmse_log": M.rmse_log, "mape": M.mape}, ["epsilon"])
    best = table.agg(F.min(F.struct("rmse_log", "mape", "epsilon"))["epsilon"]).scalar()
    return table.withColumn("best", F.col("epsilon") == best)


def candidate_search(df: DataFrame, features: list[str], label: str = "label", fold: str = "fold", depths=(2, 3),
                     rounds=(10, 20), seed: int = 42):
    """Grouped cross-validated search over tree candidates with a fold column (0-based for Spark ML)."""
    gbt = GBTRegressor(labelCol=label, seed=seed)
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, list(depths)).addGrid(gbt.maxIter, list(rounds)).build()
    k = df.select(F.max(fold)).first()[0]
    data = as_vectors(df.withColumn("_fold", (F.col(fold) - 1).cast("int")), features)
    cv = CrossValidator(estimator=gbt, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"),
                        numFolds=int(k), foldCol="_fold", parallelism=2)
    fitted = cv.fit(data)
    rows = [(int(p[gbt.maxDepth]), int(p[gbt.maxIter]), float(s)) for p, s in zip(grid, fitted.avgMetrics)]
    return fitted.bestModel, df.sparkSession.createDataFrame(rows, "depth int, rounds int, cv_rmse double")
