"""Model metrics: a registry of aggregate expressions and the tables built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators.ordering import quantiles, top_fraction, with_average_ranks

TOP_FRACTION = 0.1
EVENT_THRESHOLDS = (0.3, 0.5)


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((p - y) * (p - y)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(p - y))


def r2(y: Column, p: Column, eps: float = 0.0) -> Column:
    total = F.var_pop(y) * F.count(y)
    return F.lit(1.0) - F.sum((y - p) * (y - p)) / (F.when(total > 0, total) if eps == 0 else total + eps)


def mape(y: Column, p: Column) -> Column:
    yt, yp = S.clip(y, low=0.0), S.clip(p, low=0.0)
    return F.avg(F.abs(yp - yt) / F.greatest(yt, F.lit(S.RATIO_EPS)))


def mape_nonzero(y: Column, p: Column) -> Column:
    yt, yp = S.clip(y, low=0.0), S.clip(p, low=0.0)
    return F.avg(F.when(yt > 0, F.abs(yp - yt) / F.greatest(yt, F.lit(S.RATIO_EPS))))


def smape(y: Column, p: Column) -> Column:
    yt, yp = S.clip(y, low=0.0), S.clip(p, low=0.0)
    return F.avg(F.abs(yp - yt) / F.greatest((yt + yp) / 2, F.lit(S.RATIO_EPS)))


def rmse_log(y: Column, p: Column) -> Column:
    return rmse(S.log1p_floor(y), S.log1p_floor(p))


def r2_log(y: Column, p: Column) -> Column:
    return r2(S.log1p_floor(y), S.log1p_floor(p))


def pearson(y: Column, p: Column) -> Column:
    """Missing when a side is constant (`corr` itself divides by zero in ANSI mode)."""
    sy, sp = F.stddev_pop(y), F.stddev_pop(p)
    return F.when((sy > 1e-8) & (sp > 1e-8), F.try_divide(F.covar_pop(y, p), sy * sp))


# The extension point: a metric is a function of two columns giving an aggregate column.
RISK_METRICS = {"rmse": rmse, "mae": mae, "r2": r2, "pearson": pearson}
VALUATION_METRICS = {
    "rmse_raw": rmse, "rmse_log": rmse_log, "mape_raw": mape, "mape_nonzero_raw": mape_nonzero,
    "smape_raw": smape, "r2_raw": r2, "r2_log": r2_log,
}


def melt_models(aligned: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    """Wide predictions to one row per (row, model)."""
    return aligned.unpivot([*keep, "y_true"], models, "model", "y_pred")


def metric_table(long: DataFrame, metrics: dict, by: list[str] = ("model",)) -> DataFrame:
    y, p = F.col("y_true"), F.col("y_pred")
    return long.groupBy(*by).agg(F.count("*").alias("rows"), *[fn(y, p).alias(name) for name, fn in metrics.items()])


def spearman_table(long: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    by = list(by)
    ranked = with_average_ranks(long.select(*by, "y_true", "y_pred"), {"y_true": "_ry", "y_pred": "_rp"}, by)
    return ranked.groupBy(*by).agg(pearson(F.col("_ry"), F.col("_rp")).alias("spearman"))


def location_table(long: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Medians of truth and prediction, p90 and p95 of the absolute error; one pass over three stacked series."""
    by = list(by)
    stacked = long.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.lit("t").alias("series"), F.col("y_true").alias("v")),
                F.struct(F.lit("p").alias("series"), F.col("y_pred").alias("v")),
                F.struct(F.lit("e").alias("series"), F.abs(F.col("y_pred") - F.col("y_true")).alias("v")),
            )
        ).alias("s"),
    ).select(*by, "s.series", "s.v")
    q = quantiles(stacked, "v", {"p50": 0.5, "p90": 0.9, "p95": 0.95}, [*by, "series"])
    pick = lambda series, column: F.max(F.when(F.col("series") == series, F.col(column)))
    return q.groupBy(*by).agg(
        pick("t", "p50").alias("target_median"),
        pick("p", "p50").alias("prediction_median"),
        pick("e", "p90").alias("p90_abs_error"),
        pick("e", "p95").alias("p95_abs_error"),
    )


def top_bucket_table(long: DataFrame, key: str, fraction: float = TOP_FRACTION, by: list[str] = ("model",)) -> DataFrame:
    """Mean and median of the truth among the rows with the highest predictions."""
    by = list(by)
    top = top_fraction(long, "y_pred", key, fraction, by)
    mean = top.groupBy(*by).agg(F.count("*").alias("top_rows"), F.avg("y_true").alias("top_bucket_true_mean"))
    median = quantiles(top, "y_true", {"top_bucket_true_median": 0.5}, by).drop("n_values")
    return mean.join(median, by)


def event_table(long: DataFrame, key: str, thresholds=EVENT_THRESHOLDS, fraction: float = TOP_FRACTION,
                by: list[str] = ("model",)) -> DataFrame:
    """Event rate, precision, recall and lift of the top fraction per threshold."""
    by = list(by)
    hits = lambda t: F.count_if(F.col("y_true") >= t)
    whole = long.groupBy(*by).agg(F.count("*").alias("_n"), *[hits(t).alias(f"_pos_{i}") for i, t in enumerate(thresholds)])
    top = top_fraction(long, "y_pred", key, fraction, by).groupBy(*by).agg(
        F.count("*").alias("_k"), *[hits(t).alias(f"_hit_{i}") for i, t in enumerate(thresholds)]
    )
    columns = []
    for i, t in enumerate(thresholds):
        tag = S.threshold_tag(t)
        rate, precision = F.col(f"_pos_{i}") / F.col("_n"), F.col(f"_hit_{i}") / F.col("_k")
        columns += [
            rate.alias(f"event_{tag}_rate"),
            precision.alias(f"event_{tag}_top_precision"),
            F.try_divide(F.col(f"_hit_{i}"), F.col(f"_pos_{i}")).alias(f"event_{tag}_top_recall"),
            F.try_divide(precision, rate).alias(f"event_{tag}_top_lift"),
        ]
    return whole.join(top, by).select(*by, *columns)


def risk_metric_row(long: DataFrame, key: str, by: list[str] = ("model",)) -> DataFrame:
    """The full metric row per model; predictions are clipped to [0, 1] first."""
    by = list(by)
    clipped = long.withColumn("y_pred", S.clip("y_pred", 0.0, 1.0))
    means = clipped.groupBy(*by).agg(F.avg("y_true").alias("target_mean"), F.avg("y_pred").alias("prediction_mean"))
    parts = [
        metric_table(clipped, RISK_METRICS, by), means, spearman_table(clipped, by), location_table(clipped, by),
        top_bucket_table(clipped, key, by=by), event_table(clipped, key, by=by),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, by)
    return out


def prefixed(table: DataFrame, model: str, prefix: str) -> DataFrame:
    """One model's metric row with prefixed column names."""
    row = table.where(F.col("model") == model).drop("model")
    return row.select(*[F.col(c).alias(f"{prefix}_{c}") for c in row.columns])


def tail_rates(long: DataFrame, factors=(2, 5, 10), by: list[str] = ("model",)) -> DataFrame:
    """Share of rows whose prediction is off by more than a factor, either way."""
    y = F.greatest(F.col("y_true"), F.lit(S.RATIO_EPS))
    p = F.greatest(F.col("y_pred"), F.lit(S.RATIO_EPS))
    off = F.greatest(p / y, y / p)
    return long.groupBy(*by).agg(*[F.avg((off > f).cast("double")).alias(f"ratio_over_{f}x") for f in factors])


def fold_aggregate(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, population standard deviation, minimum and maximum per metric over folds."""
    return folds.unpivot([], metrics, "metric", "value").groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def coverage_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null count and share per column."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in columns])
    long = counts.unpivot(["_rows"], columns, "feature", "non_null_rows")
    return long.select("feature", "non_null_rows", F.try_divide("non_null_rows", "_rows").alias("coverage"))


def recommended_features(coverage: DataFrame, wanted: list[str], minimum: float = 0.5) -> DataFrame:
    return coverage.where(F.col("feature").isin(wanted) & (F.col("coverage") >= minimum))


def value_counts(df: DataFrame, column: str, missing: str = "missing") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias(column)).agg(F.count("*").alias("n_rows"))


def error_quantiles(long: DataFrame, error: Column, probabilities=(0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """Quantiles as rows and models as columns."""
    names = {f"q{int(p * 100)}": p for p in probabilities}
    q = quantiles(long.withColumn("_e", error), "_e", names, ["model"]).drop("n_values")
    models = sorted(r["model"] for r in q.select("model").distinct().collect())
    return q.unpivot(["model"], list(names), "quantile", "error").groupBy("quantile").pivot("model", models).agg(F.max("error"))


def per_segment_errors(long: DataFrame, segment: str) -> DataFrame:
    """Errors per segment (ticker or fiscal year), log and raw scale."""
    y, p = F.col("y_true"), F.col("y_pred")
    return long.groupBy(segment).agg(
        F.count("*").alias("rows"), rmse_log(y, p).alias("rmse_log"), rmse(y, p).alias("rmse_raw"), mape(y, p).alias("mape_raw"),
        F.avg(y).alias("mean_true_raw"), F.avg(p).alias("mean_pred_raw"),
    )


def segment_summary(table: DataFrame) -> DataFrame:
    """Median, p90, worst-decile mean and worst value of the per-ticker log error."""
    cut = quantiles(table, "rmse_log", {"median_rmse_log": 0.5, "p90_rmse_log": 0.9})
    p90 = cut.select("p90_rmse_log").scalar()
    worst = table.agg(
        F.avg(F.when(F.col("rmse_log") >= p90, F.col("rmse_log"))).alias("worst_decile_mean_rmse_log"),
        F.max("rmse_log").alias("worst_ticker_rmse_log"),
    )
    return cut.withColumnRenamed("n_values", "tickers").withColumns(
        {c: worst.select(c).scalar() for c in worst.columns}
    )


def quantile_edges(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """One row with the distinct quantile edges of a column, ascending."""
    names = {f"e{i}": i / buckets for i in range(buckets + 1)}
    return quantiles(df, value, names).select(F.array_distinct(F.array(*names)).alias("edges"))


def with_quantile_bucket(df: DataFrame, value: str, buckets: int = 5, name: str = "bucket") -> DataFrame:
    """Closed-right quantile bucket (1-based, lowest value included, duplicate edges merged) and its text label."""
    edges = quantile_edges(df, value, buckets).first()["edges"]  # at most buckets + 1 numbers
    inner = F.array(*[F.lit(e) for e in edges[1:-1]]).cast("array<double>")
    tagged = df.withColumns({"_edges": F.array(*[F.lit(e) for e in edges]), name: F.size(F.filter(inner, lambda e: e < F.col(value))) + 1})
    text = lambda at: F.round(F.try_element_at("_edges", at), 3).cast("string")
    label = F.concat(F.lit("("), text(F.col(name)), F.lit(", "), text(F.col(name) + 1), F.lit("]"))
    return tagged.withColumn(f"{name}_label", label).drop("_edges")


def bucket_table(long: DataFrame, buckets: int = 5, relative: bool = False) -> DataFrame:
    """Per model and quantile bucket of the truth: rows, means, RMSE, mean and median error.

    `long` is `melt_models` output of rows whose truth is bucketed with `with_quantile_bucket` beforehand.
    """
    error = F.abs(F.col("y_pred") - F.col("y_true"))
    shown = error / F.greatest(F.col("y_true"), F.lit(S.RATIO_EPS)) if relative else error
    d = long.withColumns({"_abs": error, "_e": shown})
    by = ["model", "bucket", "bucket_label"]
    means = d.groupBy(*by).agg(
        F.count("*").alias("rows"), F.avg("y_true").alias("mean_true"), F.avg("y_pred").alias("mean_pred"),
        F.sqrt(F.avg(F.col("_abs") * F.col("_abs"))).alias("rmse"), F.avg("_e").alias("mean_error"),
    )
    return means.join(quantiles(d, "_e", {"median_error": 0.5}, by).drop("n_values"), by)


def small_rank(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Running position inside small groups (features of a model)."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
