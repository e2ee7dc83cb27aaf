"""Splits, feature selection, scaling and weights for learning data."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators.ordering import cumulative_counts, quantiles

# Name tokens that mark amounts, and tokens that rule a log transform out.
LOG_TOKENS = ("revenue", "asset", "liabilit", "equity", "cash", "debt", "income", "cfo", "capex", "fcf")
NO_LOG_TOKENS = ("ratio", "_to_", "margin", "coverage", "roe", "roa")
NOT_FEATURES = ("ticker", "cik", "period_end", "timeframe", "has_income_statement", "has_cash_flow", "fiscal_year")


def year_counts(df: DataFrame, year: str) -> tuple[dict[int, int], int]:
    """Rows per year and rows in all, on the driver: one entry per calendar year."""
    rows = df.groupBy(year).agg(F.count("*").alias("n")).collect()
    return {int(r[year]): int(r["n"]) for r in rows if r[year] is not None}, sum(int(r["n"]) for r in rows)


def _flag(validation: Column) -> Column:
    return F.when(F.coalesce(validation, F.lit(False)), F.lit("val")).otherwise(F.lit("train"))


def _hashed(keys: list[str], seed: int) -> Column:
    return F.xxhash64(*keys, F.lit(seed))


def hash_row_split(df: DataFrame, keys: list[str], rows: int, seed: int = 42) -> DataFrame:
    """Exactly `rows` validation rows (unique keys): those with the smallest hash."""
    base = df.withColumn("_h", _hashed(keys, seed))
    cut = cumulative_counts(base, "_h").agg(F.max(F.when(F.col("n_before") < rows, F.col("_h")))).scalar()
    return base.withColumn("split", _flag(F.col("_h") <= cut)).drop("_h")


def time_aware_split(df: DataFrame, keys: list[str], year: str = "fiscal_year", min_val_rows: int = 20, seed: int = 42,
                     fallback_ratio: float = 0.2) -> DataFrame:
    """Last year validates; the last two when that is too few rows and three years exist; else a hash split."""
    counts, n = year_counts(df, year)
    years = sorted(counts)
    if len(years) >= 2:
        chosen = years[-1:]
        if counts[chosen[0]] < min_val_rows and len(years) >= 3:
            chosen = years[-2:]
        return df.withColumn("split", _flag(F.col(year).isin(chosen)))
    return hash_row_split(df, keys, max(1, int(n * fallback_ratio)), seed)


def validation_target(n_rows: int, ratio: float = 0.15, minimum: int = 250) -> int:
    return min(max(round(n_rows * ratio), minimum), n_rows - 1)


def latest_years_split(df: DataFrame, keys: list[str], year: str = "fiscal_year", ratio: float = 0.15,
                       min_rows: int = 250, seed: int = 42) -> DataFrame:
    """Whole years downward until the validation target is met, never all rows; then tickers, then rows."""
    counts, n = year_counts(df, year)
    target = validation_target(n, ratio, min_rows)
    chosen, taken = [], 0
    for y in sorted(counts, reverse=True) if len(counts) > 1 else []:
        if taken + counts[y] < n:
            chosen.append(y)
            taken += counts[y]
        if taken >= target:
            break
    if chosen:
        return df.withColumn("split", _flag(F.col(year).isin(chosen)))
    if df.select("ticker").distinct().limit(2).count() > 1:
        return ticker_split(df, target, seed, skip_last=True)
    return hash_row_split(df, keys, target, seed)


def ticker_split(df: DataFrame, target_rows: int, seed: int = 42, skip_last: bool = False, ticker: str = "ticker",
                 eligible: Column | None = None) -> DataFrame:
    """Hash-ordered tickers validate until `target_rows` rows are reached. `skip_last` leaves out a ticker that
    would take the remaining rows; rows outside `eligible` are neither train nor validation (`unused`)."""
    pool = df if eligible is None else df.where(eligible)
    sizes = pool.where(F.col(ticker).isNotNull()).groupBy(ticker).agg(F.count("*").alias("rows")).withColumn("_h", _hashed([ticker], seed))
    run = cumulative_counts(sizes, "_h", weights={"rows": F.col("rows")})
    wanted = run.where(F.col("rows_before") < target_rows)
    if skip_last:
        wanted = wanted.where(F.col("rows_before") + F.col("rows") < F.col("rows_total"))
    chosen = sizes.join(wanted.select("_h"), "_h", "left_semi").select(ticker, F.lit(True).alias("_val"))
    split = _flag(F.col("_val"))
    if eligible is not None:
        split = F.when(F.coalesce(eligible, F.lit(False)), split).otherwise(F.lit("unused"))
    return df.join(chosen, ticker, "left").withColumn("split", split).drop("_val")


def _fold_of(position: Column, total: Column, k: int) -> Column:
    """Fold of a position when `total` items are dealt to `k` contiguous folds, longer folds first."""
    q, r = F.floor(total / k), total % k
    head = r * (q + 1)
    late = r + F.floor(F.try_divide(position - head, q))
    return (F.when(position < head, F.floor(position / (q + 1))).otherwise(late) + 1).cast("int")


def group_kfold(df: DataFrame, k: int, seed: int = 42, ticker: str = "ticker") -> DataFrame:
    """`fold` 1..k with whole tickers per fold, as even as possible in tickers."""
    names = df.select(ticker).distinct().withColumn("_h", _hashed([ticker], seed))
    run = cumulative_counts(names, "_h")
    folds = run.select("_h", _fold_of(F.col("n_before"), F.col("n_total"), k).alias("fold"))
    return df.join(names.join(folds, "_h").select(ticker, "fold"), ticker)


def row_kfold(df: DataFrame, k: int, keys: list[str], seed: int = 42) -> DataFrame:
    base = df.withColumn("_h", _hashed(keys, seed))
    run = cumulative_counts(base, "_h")
    folds = run.select("_h", _fold_of(F.col("n_before"), F.col("n_total"), k).alias("fold"))
    return base.join(folds, "_h").drop("_h")


def time_kfold(df: DataFrame, k: int, year: str = "fiscal_year") -> DataFrame:
    """Contiguous blocks of years; a missing year counts as -1. The window runs over distinct years only."""
    keyed = df.withColumn("_y", F.coalesce(F.col(year).cast("int"), F.lit(-1)))
    blocks = keyed.select("_y").distinct().withColumn("fold", F.ntile(k).over(W.orderBy("_y")))
    return keyed.join(F.broadcast(blocks), "_y").drop("_y")


def numeric_features(df: DataFrame, target: str, excluded: tuple[str, ...] = NOT_FEATURES) -> list[str]:
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [n for n, t in df.dtypes if t in numeric and n != target and n not in excluded]


def log1p_minima(df: DataFrame, features: list[str]) -> DataFrame:
    """Training minimum per feature whose name marks an amount; `log1p` says whether it is transformed."""
    named = [f for f in features if any(t in f.lower() for t in LOG_TOKENS) and not any(t in f.lower() for t in NO_LOG_TOKENS)]
    minima = df.agg(*[F.min(S.to_number(f)).alias(f) for f in named]).unpivot([], named, "feature", "train_min")
    return minima.withColumn("log1p", F.coalesce(F.col("train_min") >= 0, F.lit(False)))


def log1p_features(df: DataFrame, features: list[str]) -> list[str]:
    return [r["feature"] for r in log1p_minima(df, features).where("log1p").collect()]


def model_matrix(df: DataFrame, features: list[str], target: str, log_features: list[str] = (), log_target: bool = True,
                 keep: list[str] = ()) -> DataFrame:
    """Missing to 0, log1p on the chosen features, target on the model scale as `label`."""
    cell = lambda f: F.log1p(F.greatest(S.zero_filled(f), F.lit(0.0))) if f in log_features else S.zero_filled(f)
    return df.select(*keep, *[cell(f).alias(f) for f in features], S.target_on_model_scale(target, log_target).alias("label"))


def scaler_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """mu and sigma per feature over the present values (population standard deviation, tiny sigma becomes 1)."""
    row = df.agg(*[F.struct(F.avg(f).alias("mu"), F.stddev_pop(f).alias("sigma")).alias(f) for f in features])
    long = row.unpivot([], features, "feature", "s")
    sigma = F.when(F.col("s.sigma") >= S.EPS, F.col("s.sigma")).otherwise(F.lit(1.0))
    return long.select("feature", F.coalesce("s.mu", F.lit(0.0)).alias("mu"), sigma.alias("sigma"))


def scale(df: DataFrame, train: DataFrame, features: list[str]) -> DataFrame:
    """Standardized features with the training statistics; a missing value takes the mean, so it becomes 0."""
    fitted = {r["feature"]: (r["mu"], r["sigma"]) for r in scaler_stats(train, features).collect()}  # two numbers per feature

    def z(f):
        mu, sigma = fitted[f]
        return (F.coalesce(F.col(f), F.lit(mu)) - mu) / sigma

    return df.withColumns({f: z(f) for f in features})


def target_correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Correlation of each zero-filled feature with the target, 0 for a constant side."""
    filled = df.select(*[S.zero_filled(f).alias(f) for f in features], S.zero_filled(target).alias("_y"))
    sy = F.stddev_pop("_y")

    def corr(f):
        sx = F.stddev_pop(f)
        return F.when((sx >= S.EPS) & (sy >= S.EPS), F.covar_pop(f, "_y") / (sx * sy + S.EPS)).otherwise(F.lit(0.0))

    return filled.agg(*[corr(f).alias(f) for f in features]).unpivot([], features, "feature", "corr")


def _vector(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=name, handleInvalid="keep").transform(df)


def select_by_correlation(df: DataFrame, features: list[str], target: str, min_corr: float = 0.01, max_features: int | None = 200,
                          max_inter_corr: float = 0.98, min_features: int = 20) -> list[str]:
    """Features ranked by |corr| with the target: threshold, floor, cap, then greedy removal of near copies.

    Spark computes the correlations; the greedy pass reads a features x features table.
    """
    corr = {r["feature"]: abs(r["corr"]) for r in target_correlations(df, features, target).collect()}
    ranked = sorted(features, key=lambda f: -corr[f])
    floor = max(1, min(min_features, len(ranked)))
    passing = [f for f in ranked if corr[f] >= min_corr]
    chosen = passing if len(passing) >= floor else ranked[:floor]
    chosen = chosen[:max_features] if max_features else chosen
    if max_inter_corr >= 1.0 or len(chosen) < 2:
        return chosen
    filled = df.select(*[S.zero_filled(f).alias(f) for f in chosen])
    matrix = Correlation.corr(_vector(filled, chosen), "features").first()[0].toArray()
    kept: list[int] = []
    for i in range(len(chosen)):
        near = [abs(matrix[i, j]) for j in kept if matrix[i, j] == matrix[i, j]]
        if not near or max(near) < max_inter_corr:
            kept.append(i)
    refill = [i for i in range(len(chosen)) if i not in kept]
    kept += refill[: max(0, floor - len(kept))]
    return [chosen[i] for i in kept]


def fit_pca(scaled: DataFrame, features: list[str], explained: float = 0.95, max_components: int | None = 64) -> dict:
    """Components up to the explained-variance target; each component's largest loading is made positive."""
    model = PCA(k=len(features), inputCol="features", outputCol="scores").fit(_vector(scaled, features))
    ratio = [float(x) for x in model.explainedVariance.toArray()]
    running, k = 0.0, 0
    for r in ratio:
        k += 1
        running += r
        if running >= explained:
            break
    k = min(k, max_components) if max_components else k
    pc = model.pc.toArray()[:, :k]
    columns = [[float(x) for x in pc[:, j]] for j in range(k)]
    columns = [[-x for x in c] if max(c, key=abs) < 0 else c for c in columns]
    return {"features": list(features), "components": columns, "ratio": ratio[:k]}


def pca_scores(scaled: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    mean = scaled.agg(*[F.avg(f).alias(f) for f in model["features"]]).first().asDict()  # one number per feature

    def score(c):
        terms = [(F.col(f) - mean[f]) * w for f, w in zip(model["features"], c)]
        return sum(terms[1:], terms[0])
    return scaled.select(*keep, *[score(c).alias(f"PC{i}") for i, c in enumerate(model["components"], 1)])


def pca_variance_table(spark, model: dict) -> DataFrame:
    t = spark.createDataFrame([(i, r) for i, r in enumerate(model["ratio"], 1)], "component int, explained_variance_ratio double")
    return cumulative_share(t, "component", "explained_variance_ratio")


def cumulative_share(df: DataFrame, order: str, value: str) -> DataFrame:
    """Running sum over a small ordered table (components, folds)."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(f"{value}_cumulative", F.sum(value).over(w))


def pca_loadings(spark, model: dict, top_k: int | None = None) -> DataFrame:
    rows = [(i, f, w) for i, c in enumerate(model["components"], 1) for f, w in zip(model["features"], c)]
    t = spark.createDataFrame(rows, "component int, feature string, loading double")
    w = W.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    ranked = t.withColumns({"abs_loading": F.abs("loading"), "rank_abs_loading": F.row_number().over(w)})
    return ranked if top_k is None else ranked.where(F.col("rank_abs_loading") <= top_k)


def size_weights(df: DataFrame, log_target: str, power: float = 0.25, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """y^-power with mean 1, clipped; `y` is expm1 of the log target and at least 1."""
    raw = F.pow(F.greatest(F.expm1(log_target), F.lit(1.0)), F.lit(-power))
    mean = df.agg(F.avg(raw)).scalar()
    return df.withColumn("weight", S.clip(raw / (mean + S.EPS), low, high))


def severity_weights(target: str, power: float = 1.0, low: float = 1.0, high: float = 2.0) -> Column:
    return S.clip(1 + F.pow(S.clip(target, 0.0, 1.0), F.lit(power)), low, high)


def ticker_weights(df: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Weights proportional to 1 / rows of the ticker, mean 1. The sum of 1/rows over all rows is the number of
    tickers, so the factor is rows / tickers."""
    sizes = df.groupBy(ticker).agg(F.count("*").alias("_rows"))
    factor = sizes.agg(F.sum("_rows") / F.count("*")).scalar()
    return df.join(sizes, ticker).withColumn("weight", factor / F.col("_rows")).drop("_rows")


def clip_bounds(df: DataFrame, target: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    return quantiles(df, target, {"low": low, "high": high}).select("low", "high")


def clip_to_train(df: DataFrame, train: DataFrame, prediction: str, target: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    bounds = clip_bounds(train, target, low, high).select(F.struct("low", "high")).scalar()
    return df.withColumn(prediction, S.clip(prediction, bounds["low"], bounds["high"]))


def clip_to_train_range(df: DataFrame, train: DataFrame, prediction: str, target: str, margin: float) -> DataFrame:
    bounds = train.agg(F.struct((F.min(target) - margin).alias("low"), (F.max(target) + margin).alias("high"))).scalar()
    return df.withColumn(prediction, S.clip(prediction, bounds["low"], bounds["high"]))


def feature_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Non-null rows, missing rate, distinct values and whether a feature is usable (>= 2 rows, > 1 value)."""
    long = df.unpivot([], [F.col(f).cast("double").alias(f) for f in features], "feature", "value")
    per_value = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    folded = per_value.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).cast("long").alias("non_null_rows"),
        F.sum("n").alias("_rows"),
        F.count("value").alias("nunique_non_null"),
    )
    return folded.select(
        "feature",
        "non_null_rows",
        (1 - F.col("non_null_rows") / F.col("_rows")).alias("missing_rate"),
        "nunique_non_null",
        ((F.col("non_null_rows") >= 2) & (F.col("nunique_non_null") > 1)).alias("selected"),
    )


def as_vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return _vector(df, features)
