"""Row attributions and the tables built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators.ordering import cumulative_counts, quantiles, with_cdf
from ledgerline.operators.shapley import sampled_shapley, tree_attributions  # noqa: F401  (part of this interface)


def linear_attributions(df: DataFrame, coefficients: dict[str, float], intercept: float, key: str) -> DataFrame:
    """Exact attributions of a linear model: coefficient * (value - mean), with base value and model output.

    Long table (key, feature, feature_value, shap, base_value, y_pred_model_output).
    """
    features = list(coefficients)
    mean = df.agg(*[F.avg(f).alias(f) for f in features]).first().asDict()  # one number per feature
    base = F.lit(float(intercept) + sum(mean[f] * c for f, c in coefficients.items()))
    output = sum((F.col(f) * c for f, c in coefficients.items()), F.lit(float(intercept)))
    cells = [
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("feature_value"), ((F.col(f) - mean[f]) * c).alias("shap"))
        for f, c in coefficients.items()
    ]
    wide = df.select(key, base.alias("base_value"), output.alias("y_pred_model_output"), F.explode(F.array(*cells)).alias("c"))
    return wide.select(key, "c.*", "base_value", "y_pred_model_output")


def importance_table(long: DataFrame) -> DataFrame:
    """Mean |shap|, mean, spread and feature moments per feature, ranked."""
    t = long.groupBy("feature").agg(
        F.avg(F.abs("shap")).alias("mean_abs_shap"),
        F.avg("shap").alias("mean_shap"),
        F.stddev_pop(F.abs("shap")).alias("std_abs_shap"),
        F.avg("feature_value").alias("mean_feature_value"),
        F.stddev_pop("feature_value").alias("std_feature_value"),
    )
    return t.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mean_abs_shap"), "feature")))


def prediction_columns(df: DataFrame, bounds: tuple[float | None, float | None], output: str = "y_pred_model_output") -> DataFrame:
    """Prediction clipped to `bounds`, absolute and relative error, and whether the clip changed anything."""
    d = df.withColumn("y_pred", S.clip(output, *bounds))
    return d.withColumns(
        {
            "abs_error": F.abs(F.col("y_pred") - F.col("y_true")),
            "rel_error": F.abs(F.col("y_pred") - F.col("y_true")) / F.greatest(F.col("y_true"), F.lit(S.RATIO_EPS)),
            "clip_applied": F.abs(F.col("y_pred") - F.col(output)) > 1e-9,
        }
    )


def largest_errors(predictions: DataFrame, key: str, error: str = "abs_error", rows: int = 50) -> DataFrame:
    """The report's `rows` worst predictions with their rank."""
    worst = predictions.orderBy(F.desc(error), key).limit(rows)
    return worst.withColumn("rank_by_error", F.row_number().over(W.orderBy(F.desc(error), key)))


def local_explanations(predictions: DataFrame, long: DataFrame, key: str, rows: int = 50, top_k: int = 5, error: str = "abs_error") -> DataFrame:
    """The worst rows with their strongest features as columns."""
    worst = largest_errors(predictions, key, error, rows)
    # `worst` has at most `rows` rows, a report size.
    explained = long.join(F.broadcast(worst.select(key)), key)
    w = W.partitionBy(key).orderBy(F.desc(F.abs("shap")), "feature")
    ranked = explained.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top_k)
    pick = lambda pos, c: F.max(F.when(F.col("pos") == pos, F.col(c)))
    columns = []
    for pos in range(1, top_k + 1):
        columns += [pick(pos, "feature").alias(f"top_{pos}_feature"), pick(pos, "shap").alias(f"top_{pos}_shap"),
                    pick(pos, "feature_value").alias(f"top_{pos}_feature_value")]
    return worst.join(ranked.groupBy(key).agg(*columns), key)


def additivity_table(long: DataFrame, key: str) -> DataFrame:
    """Mean and maximum gap between base + attributions and the model output."""
    per_row = long.groupBy(key).agg(
        F.abs(F.first("base_value") + F.sum("shap") - F.first("y_pred_model_output")).alias("gap")
    )
    return per_row.agg(F.avg("gap").alias("mean_abs_gap"), F.max("gap").alias("max_abs_gap"), F.count("*").alias("rows"))


def compare_importance(tables: dict[str, DataFrame], top_n: int) -> DataFrame:
    """Mean |shap| of several models side by side over the union of their top features, 0 where absent."""
    stacked = None
    for model, t in tables.items():
        part = t.select(F.lit(model).alias("model"), "feature", "mean_abs_shap", "rank")
        stacked = part if stacked is None else stacked.unionByName(part)
    wanted = stacked.where(F.col("rank") <= top_n).select("feature").distinct()
    return stacked.join(wanted, "feature", "left_semi").groupBy("feature").pivot("model", list(tables)).agg(F.max("mean_abs_shap")).na.fill(0.0)


def dependence_data(long: DataFrame, importance: DataFrame, top_n: int, key: str) -> DataFrame:
    """Feature value against attribution for the strongest features."""
    top = importance.where(F.col("rank") <= top_n).select("feature")
    return long.join(F.broadcast(top), "feature", "left_semi").select(key, "feature", "feature_value", "shap")


def error_histogram(df: DataFrame, error: str, bins: int = 40, cap: float = 0.99) -> DataFrame:
    """Counts in equal-width bins after capping at a quantile."""
    top = quantiles(df, error, {"cap": cap}).select("cap").scalar()
    capped = df.select(F.least(F.col(error), top).alias("e"))
    edges = capped.agg(F.struct(F.min("e").alias("lo"), F.max("e").alias("hi"))).scalar()
    width = (edges["hi"] - edges["lo"]) / bins
    number = F.least(F.floor(F.try_divide(F.col("e") - edges["lo"], width)), F.lit(bins - 1))
    return capped.groupBy(F.coalesce(number, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n_rows"))


def equal_count_edges(df: DataFrame, value: str, bins: int, by: list[str]) -> DataFrame:
    """Per group the inner edges of bins of equal counts, as one array; edge i is the smallest value that at least i
    of `bins` parts of the rows do not exceed. Equal values share a bin, so a frequent value can leave bins empty."""
    reached = (F.col("n_before") + F.col("n")) * bins
    edges = F.array(*[F.min(F.when(reached >= F.col("n_total") * i, F.col(value))) for i in range(1, bins)])
    return cumulative_counts(df, value, by).groupBy(*by).agg(edges.alias(f"_edges_{value}"))


def _with_bin(df: DataFrame, value: str, bins: int, by: list[str], name: str) -> DataFrame:
    """The bin of every row; the edges (one row per group of `by`) go to all tasks, the rows stay where they are."""
    edges = equal_count_edges(df, value, bins, by)
    edges = edges.select(*[F.col(b).alias(f"_e_{b}") for b in by], f"_edges_{value}")
    match = F.lit(True)
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_e_{b}"))
    below = F.size(F.filter(f"_edges_{value}", lambda edge: edge < F.col(value)))
    return df.join(F.broadcast(edges), match).withColumn(name, below).drop(f"_edges_{value}", *[f"_e_{b}" for b in by])


def actual_vs_predicted(df: DataFrame, by: list[str], bins: int = 20, inner: int = 10, actual: str = "y_true",
                        predicted: str = "y_pred") -> DataFrame:
    """The actual-versus-predicted plot as a table whose size does not follow the rows.

    Bins of equal counts over the actual value, inside each of them bins of equal counts over the prediction. Every row
    with both values is counted in one cell; `rows_over` tells how many of a cell lie above the diagonal. `by` names
    groups that are few by meaning (models), so the edges are at most `bins` small rows per group.
    """
    pairs = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).select(*by, actual, predicted)
    first = _with_bin(pairs, actual, bins, by, "actual_bin")
    cells = _with_bin(first, predicted, inner, [*by, "actual_bin"], "predicted_bin")
    ends = [f(c).alias(f"{n}_{c}") for c in (actual, predicted) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    over = F.sum((F.col(predicted) > F.col(actual)).cast("long")).alias("rows_over")
    return cells.groupBy(*by, "actual_bin", "predicted_bin").agg(F.count("*").alias("n_rows"), *ends, over)


def error_cdf(df: DataFrame, error: str, by: list[str] | None = None, cut: float = 0.995) -> DataFrame:
    """Distribution of the error per model, cut at the largest of the models' `cut` quantiles."""
    top = quantiles(df, error, {"q": cut}, by).agg(F.max("q")).scalar()
    return with_cdf(df, error, by).where(F.col(error) <= top)
