"""Paired comparison of models: loss views, tests, bootstrap, calibration and bias.

Every sum runs as a Spark aggregate; only result tables (one row per model pair) reach the tail functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.functions import tails as T
from ledgerline.operators import metrics as M
from ledgerline.operators.ordering import cumulative_counts, quantiles
from ledgerline.session import stored_columns

ALPHA = 0.05
PAIR = ["model_a", "model_b", "loss_view"]


def risk_losses(y: Column, p: Column) -> dict[str, Column]:
    d = S.clip(p, 0.0, 1.0) - S.clip(y, 0.0, 1.0)
    return {"abs_error": F.abs(d), "squared_error": d * d, "signed_error": d}


def valuation_losses(y: Column, p: Column) -> dict[str, Column]:
    yt, yp = S.clip(y, low=0.0), S.clip(p, low=0.0)
    return {
        "abs_error": F.abs(yp - yt),
        "abs_log_error": F.abs(F.log1p(yp) - F.log1p(yt)),
        "abs_percentage_error": F.abs(yp - yt) / F.greatest(yt, F.lit(S.RATIO_EPS)),
    }


def loss_table(aligned: DataFrame, models: list[str], key: str, views=risk_losses) -> DataFrame:
    """One row per (row, model, loss view)."""
    entries = [
        F.struct(F.lit(m).alias("model"), F.lit(v).alias("loss_view"), c.alias("loss"))
        for m in models
        for v, c in views(F.col("y_true"), F.col(m)).items()
    ]
    return aligned.select(key, F.explode(F.array(*entries)).alias("l")).select(key, "l.*")


def paired_losses(aligned: DataFrame, models: list[str], views=risk_losses) -> DataFrame:
    """One row per (row, model pair, loss view) with both losses and their difference; narrow, no join."""
    entries = []
    for a, b in combinations(models, 2):
        va, vb = views(F.col("y_true"), F.col(a)), views(F.col("y_true"), F.col(b))
        entries += [
            F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.lit(v).alias("loss_view"), va[v].alias("a"), vb[v].alias("b"))
            for v in va
        ]
    return aligned.select(F.explode(F.array(*entries)).alias("p")).select("p.*").withColumn("d", F.col("a") - F.col("b"))


def wilcoxon(diffs: DataFrame, by: list[str], d: str = "d") -> DataFrame:
    """Signed-rank test, zeros ranked and then left out of the sums, two sided, normal tail with tie correction."""
    ranked = cumulative_counts(
        diffs.select(*by, F.abs(d).alias("_abs"), F.signum(d).alias("_sign")),
        "_abs",
        by,
        weights={"n": F.lit(1), "up": (F.col("_sign") > 0).cast("long"), "down": (F.col("_sign") < 0).cast("long")},
    )
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    live = F.col("_abs") > 0
    t = F.col("n").cast("double")
    folded = ranked.groupBy(*by).agg(
        F.sum("n").cast("double").alias("_n"),
        F.coalesce(F.sum(F.when(~live, t)), F.lit(0.0)).alias("_z"),
        F.sum(rank * F.col("up")).alias("_plus"),
        F.sum(rank * F.col("down")).alias("_minus"),
        F.coalesce(F.sum(F.when(live, t * t * t - t)), F.lit(0.0)).alias("_ties"),
        F.max("_abs").alias("_largest"),
    )
    n, z = F.col("_n"), F.col("_z")
    mean = (n * (n + 1) - z * (z + 1)) / 4
    var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - F.col("_ties") / 2) / 24
    flat = F.col("_largest") <= 1e-8
    stat = F.least("_plus", "_minus")
    score = F.try_divide(stat - mean, F.sqrt(var))
    out = folded.withColumns({"wilcoxon_statistic": F.when(flat, F.lit(0.0)).otherwise(stat), "wilcoxon_z": F.when(~flat, score)})
    return out.select(*by, "wilcoxon_statistic", "wilcoxon_z")


def t_statistic(flat: Column, d: str = "d") -> Column:
    """One-sample t of `d` against 0: 0 for all-zero differences, infinite for a constant one."""
    mean, sd = F.avg(d), F.stddev_samp(d)
    t = F.coalesce(F.try_divide(mean, sd / F.sqrt(F.count(d))), F.when(sd == 0, F.signum(mean) * float("inf")))
    return F.when(flat, F.lit(0.0)).otherwise(t)


def pairwise_statistics(aligned: DataFrame, models: list[str], views=risk_losses) -> DataFrame:
    """Everything of the pairwise table but the p-values."""
    p = paired_losses(aligned, models, views)
    n = F.count("d")
    flat = F.max(F.abs("d")) <= 1e-8
    skew = F.when((n >= 3) & (F.stddev_pop("d") > 1e-8), F.skewness("d") * F.sqrt(n * (n - 1)) / (n - 2))
    basic = p.groupBy(*PAIR).agg(
        n.alias("rows"),
        F.avg("a").alias("mean_loss_a"),
        F.avg("b").alias("mean_loss_b"),
        F.avg("d").alias("mean_diff_a_minus_b"),
        F.avg((F.col("a") < F.col("b")).cast("double")).alias("win_rate_a_lt_b"),
        F.avg((F.abs("d") <= 1e-8 + 1e-5 * F.abs("b")).cast("double")).alias("tie_rate"),
        skew.alias("diff_skewness"),
        t_statistic(flat).alias("paired_t_statistic"),
    )
    median = quantiles(p, "d", {"median_diff_a_minus_b": 0.5}, PAIR).drop("n_values")
    out = basic.join(median, PAIR).join(wilcoxon(p, PAIR), PAIR)
    return out.withColumn("approx_symmetric_diff", F.coalesce(F.abs("diff_skewness") <= 1, F.lit(False)))


def adjust(df: DataFrame, p: str, order: list[str], by: list[str] = (), prefix: str | None = None) -> DataFrame:
    """Adds `<p>_holm` and `<p>_bh`."""
    prefix = prefix or p
    live = W.partitionBy(F.col(p).isNull(), *by)
    up = live.orderBy(p, *order)
    d = df.withColumns({"_m": F.count(p).over(live), "_i": F.row_number().over(up)})
    d = d.withColumns({"_holm": (F.col("_m") - F.col("_i") + 1) * F.col(p), "_bh": F.col(p) * F.col("_m") / F.col("_i")})
    rising = live.orderBy("_i").rowsBetween(W.unboundedPreceding, W.currentRow)
    falling = live.orderBy(F.desc("_i")).rowsBetween(W.unboundedPreceding, W.currentRow)
    known = F.col(p).isNotNull()
    return d.withColumns(
        {
            f"{prefix}_holm": F.when(known, F.least(F.max("_holm").over(rising), F.lit(1.0))),
            f"{prefix}_bh": F.when(known, F.least(F.min("_bh").over(falling), F.lit(1.0))),
        }
    ).drop("_m", "_i", "_holm", "_bh")


def pairwise_table(aligned: DataFrame, models: list[str], views=risk_losses) -> DataFrame:
    """Statistics, p-values, adjusted p-values and 5% flags per model pair and loss view."""
    t = pairwise_statistics(aligned, models, views).withColumns(
        {
            "wilcoxon_p_value": F.coalesce(T.normal_p("wilcoxon_z"), F.lit(1.0)),
            "paired_t_p_value": F.coalesce(T.t_p("paired_t_statistic", F.col("rows") - 1), F.lit(1.0)),
        }
    )
    t = adjust(t, "wilcoxon_p_value", PAIR, prefix="wilcoxon_p")
    t = adjust(t, "paired_t_p_value", PAIR, prefix="paired_t_p")
    return t.withColumns(
        {
            "wilcoxon_significant_holm_5pct": F.col("wilcoxon_p_holm") < ALPHA,
            "paired_t_significant_holm_5pct": F.col("paired_t_p_holm") < ALPHA,
        }
    )


def calibration_statistics(long: DataFrame) -> DataFrame:
    """Regression of the truth on the prediction with standard errors and the joint F for intercept 0, slope 1."""
    sums = long.groupBy("model").agg(
        F.count("*").cast("double").alias("n"),
        F.regr_sxx("y_true", "y_pred").alias("sxx"),
        F.regr_syy("y_true", "y_pred").alias("syy"),
        F.regr_sxy("y_true", "y_pred").alias("sxy"),
        F.avg("y_pred").alias("mx"),
        F.avg("y_true").alias("my"),
    )
    sums = sums.withColumn("slope", F.try_divide("sxy", "sxx")).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    n, a, b, mx, sxx = (F.col(c) for c in ("n", "intercept", "slope", "mx", "sxx"))
    sse = F.col("syy") - b * b * sxx
    var = sse / F.greatest(n - 2, F.lit(1.0))
    joint = F.try_divide(n * a * a + 2 * a * (b - 1) * n * mx + (b - 1) * (b - 1) * (sxx + n * mx * mx), 2 * var)
    return sums.select(
        "model",
        n.cast("long").alias("rows"),
        a.alias("intercept"),
        F.sqrt(var * (1 / n + F.try_divide(mx * mx, sxx))).alias("intercept_se"),
        b.alias("slope"),
        F.sqrt(F.try_divide(var, sxx)).alias("slope_se"),
        (1 - F.try_divide(sse, F.col("syy"))).alias("r2"),
        joint.alias("joint_f_statistic"),
    )


def calibration_table(long: DataFrame) -> DataFrame:
    t = calibration_statistics(long)
    return adjust(t.withColumn("joint_p_value", T.f_p("joint_f_statistic", 2, F.col("rows") - 2)), "joint_p_value", ["model"], prefix="joint_p")


def bias_statistics(long: DataFrame) -> DataFrame:
    e = long.withColumn("d", F.col("y_pred") - F.col("y_true"))
    flat = F.max(F.abs("d")) <= 1e-8
    basic = e.groupBy("model").agg(
        F.count("*").alias("rows"),
        F.avg("d").alias("mean_error"),
        F.avg(F.abs("d")).alias("mean_abs_error"),
        t_statistic(flat).alias("mean_bias_t_statistic"),
    )
    median = quantiles(e, "d", {"median_error": 0.5}, ["model"]).drop("n_values")
    return basic.join(median, "model").join(wilcoxon(e, ["model"]), "model")


def bias_table(long: DataFrame) -> DataFrame:
    t = bias_statistics(long).withColumns(
        {
            "mean_bias_p_value": F.coalesce(T.t_p("mean_bias_t_statistic", F.col("rows") - 1), F.lit(1.0)),
            "median_bias_p_value": F.coalesce(T.normal_p("wilcoxon_z"), F.lit(1.0)),
        }
    ).withColumnRenamed("wilcoxon_statistic", "median_bias_wilcoxon_statistic").drop("wilcoxon_z")
    t = adjust(t, "mean_bias_p_value", ["model"], prefix="mean_bias_p")
    return adjust(t, "median_bias_p_value", ["model"], prefix="median_bias_p")


def bucket_ranks(long: DataFrame, error: Column, buckets: int = 5) -> DataFrame:
    """Per model and bucket: rows and rank sum of the error, with the model's row count and tie sum.

    `long` carries `bucket` and `bucket_label`. One cumulative pass counts every bucket per distinct error.
    """
    d = long.withColumn("_e", error)
    weights = {"n": F.lit(1), **{f"b{i}": (F.col("bucket") == i).cast("long") for i in range(1, buckets + 1)}}
    c = cumulative_counts(d, "_e", ["model"], weights)
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    t = F.col("n").cast("double")
    folded = c.groupBy("model").agg(
        F.sum(t).alias("n_total"),
        F.sum(t * t * t - t).alias("ties"),
        *[F.struct(F.sum(f"b{i}").cast("double").alias("n"), F.sum(rank * F.col(f"b{i}")).alias("r")).alias(f"b{i}") for i in range(1, buckets + 1)],
    )
    tall = folded.unpivot(["model", "n_total", "ties"], [f"b{i}" for i in range(1, buckets + 1)], "_b", "s")
    labels = long.select("bucket", "bucket_label").distinct()
    return (
        tall.select("model", "n_total", "ties", F.substring("_b", 2, 9).cast("int").alias("bucket"), F.col("s.n").alias("n_rows"), F.col("s.r").alias("rank_sum"))
        .where("n_rows > 0")
        .join(F.broadcast(labels), "bucket")
    )


def kruskal_table(ranks: DataFrame) -> DataFrame:
    n = F.first("n_total")
    raw = F.lit(12.0) / (n * (n + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n_rows")) - 3 * (n + 1)
    tie = F.lit(1.0) - F.try_divide(F.first("ties"), n * n * n - n)
    t = ranks.groupBy("model").agg(F.count("*").cast("int").alias("n_buckets"), F.try_divide(raw, tie).alias("kruskal_h_statistic"))
    return t.withColumn("kruskal_h_statistic", F.when(F.col("n_buckets") >= 2, F.col("kruskal_h_statistic")).otherwise(F.lit(0.0)))


def kruskal_with_p(ranks: DataFrame) -> DataFrame:
    t = kruskal_table(ranks)
    p = F.when(F.col("n_buckets") >= 2, T.chi2_p("kruskal_h_statistic", F.greatest(F.col("n_buckets") - 1, F.lit(1)))).otherwise(F.lit(1.0))
    return adjust(t.withColumn("kruskal_p_value", p), "kruskal_p_value", ["model"], prefix="kruskal_p")


def dunn_statistics(ranks: DataFrame) -> DataFrame:
    """z per bucket pair; pairs follow the text order of their labels."""
    side = lambda s: ranks.select(
        "model", F.col("bucket_label").alias(f"group_{s}"), (F.col("rank_sum") / F.col("n_rows")).alias(f"_mean_{s}"),
        F.col("n_rows").alias(f"_n_{s}"), F.col("n_total").alias(f"_total_{s}"), F.col("ties").alias(f"_ties_{s}"),
    )
    n = F.col("_total_a")
    correction = F.greatest(F.lit(1.0) - F.try_divide(F.col("_ties_a"), n * n * n - n), F.lit(1e-12))
    base = n * (n + 1) / 12 * correction
    se = F.sqrt(base * (1 / F.col("_n_a") + 1 / F.col("_n_b")))
    pairs = side("a").join(side("b"), "model").where("group_a < group_b")
    return pairs.select("model", "group_a", "group_b", ((F.col("_mean_a") - F.col("_mean_b")) / F.greatest(se, F.lit(1e-12))).alias("z_statistic"))


def dunn_table(ranks: DataFrame) -> DataFrame:
    """Post hoc pairs of the models whose Kruskal-Wallis p is below 5%, adjusted per model."""
    significant = kruskal_with_p(ranks).where(F.col("kruskal_p_value") < ALPHA).select("model")
    t = dunn_statistics(ranks).join(significant, "model", "left_semi").withColumn("p_value", T.normal_p("z_statistic"))
    return adjust(t, "p_value", ["group_a", "group_b"], by=["model"], prefix="p")


def _poisson_cdf() -> tuple[float, ...]:
    """Cumulative Poisson(1) probabilities of 0, 1, ... draws, as far as a 53-bit hash can tell them from one."""
    out, term, k = [math.exp(-1)], math.exp(-1), 0
    while 1 - out[-1] >= 2.0**-53:
        k += 1
        term /= k
        out.append(out[-1] + term)
    return tuple(c for c in out if c < 1)


POISSON_CDF = _poisson_cdf()


# Sums of a weighted row set that the metrics follow from.
SUMS = ("n", "sy", "sp", "syy", "spp", "syp", "sse", "sae", "spe")


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The same as bounds of a 64-bit hash whose upper 53 bits count.
_BOUNDS = np.array([math.ceil(c * 2.0**53) << 11 for c in POISSON_CDF], np.uint64)


def poisson_weights(name: np.ndarray, first: int, last: int) -> np.ndarray:
    """How often each draw from `first` to `last` (exclusive) takes each row: draws x rows, from the rows' hashes alone."""
    steps = _scrambled(np.arange(first + 1, last + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys, out = name.astype(np.int64, copy=False).view(np.uint64), np.empty((last - first, len(name)), np.uint8)
    for row, step in zip(out, steps, strict=True):
        for a in range(0, len(keys), 1 << 14):  # pieces that stay in the cache
            u, piece = _scrambled(keys[a : a + (1 << 14)] ^ step), row[a : a + (1 << 14)]
            np.add(u >= _BOUNDS[0], u >= _BOUNDS[1], out=piece, dtype=np.uint8)
            many = np.flatnonzero(u >= _BOUNDS[2])
            piece[many] = np.searchsorted(_BOUNDS, u[many], "right")
    return out


def _weighted_sums(models: list[str], iterations: int, at_once: int = 128):
    """Per task: Poisson draws of all rows in slices of iterations, multiplied with the rows' terms; iterations x models rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(SUMS) * len(models)
        total = np.zeros((iterations, width))
        for batch in batches:
            name = batch.column("h").to_numpy(zero_copy_only=False)
            terms = batch.column("terms").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for i in range(0, iterations, at_once):
                total[i : i + at_once] += poisson_weights(name, i, min(i + at_once, iterations)).astype(np.float64) @ terms
        cube = total.reshape(iterations, len(models), len(SUMS))
        for m, model in enumerate(models):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(iterations), pa.int32()), pa.array([model] * iterations), *[pa.array(cube[:, m, k]) for k in range(len(SUMS))]],
                names=["iteration", "model", *SUMS])

    return run


def bootstrap_samples(aligned: DataFrame, models: list[str], key: str, iterations: int = 2000, seed: int = 42,
                      log_scale: bool = False) -> DataFrame:
    """Metric per (iteration, model) of a paired bootstrap over complete rows.

    Rows are weighted instead of copied: Poisson draws per (row, iteration) come from a hash, the same for all models.
    Nothing is exploded: a task turns each batch into a weight matrix and emits iterations x models sums.
    """
    t = lambda c: S.log1p_floor(c) if log_scale else F.col(c).cast("double")
    terms = []
    for model in models:
        y, p = t("y_true"), t(model)
        off = F.abs(F.col(model) - F.col("y_true")) / F.greatest(F.col("y_true"), F.lit(S.RATIO_EPS))
        terms += [F.lit(1.0), y, p, y * y, p * p, y * p, (y - p) * (y - p), F.abs(y - p), off]
    rows = aligned.na.drop(subset=["y_true", *models]).select(F.xxhash64(key, F.lit(seed)).alias("h"), F.array(*[x.cast("double") for x in terms]).alias("terms"))
    schema = "iteration int, model string, " + ", ".join(f"{k} double" for k in SUMS)
    sums = rows.mapInArrow(_weighted_sums(models, iterations), schema).groupBy("iteration", "model").agg(*[F.sum(k).alias(k) for k in SUMS])
    sums = sums.where("n > 0")
    n = F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    vp = F.col("spp") - F.col("sp") * F.col("sp") / n
    cov = F.col("syp") - F.col("sy") * F.col("sp") / n
    return sums.select(
        "iteration", "model",
        F.sqrt(F.col("sse") / n).alias("rmse"),
        (F.col("sae") / n).alias("mae"),
        (1 - F.try_divide(F.col("sse"), vy)).alias("r2"),
        F.try_divide(cov, F.sqrt(vy * vp)).alias("pearson"),
        (F.col("spe") / n).alias("mape"),
    )


#: Bytes of rows (hash, truth, predictions) that may be handed to every task of a rank bootstrap, and cells of a slice of draws.
ROWS_BYTES, SLICE_CELLS = 64 << 20, 1 << 21
#: Rows of a block when a larger table is ranked (a task holds two blocks), and tasks wanted at least.
BLOCK_ROWS, BLOCK_TASKS = 5 << 19, 32


class _Ranked:
    """Values in order, with ties as one: sums and average ranks of weighted rows for many draws at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.order = np.argsort(values, kind="stable")
        ordered = values[self.order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        self.first, self.values = np.flatnonzero(new), ordered[new]
        self.back = np.empty(len(values), np.int64)
        self.back[self.order] = np.cumsum(new) - 1

    def upto(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each distinct value, and of all values up to it; draws x values."""
        each = np.add.reduceat(w[:, self.order], self.first, axis=1)
        return each, np.cumsum(each, axis=1)

    def ranks(self, w: np.ndarray) -> np.ndarray:
        each, upto = self.upto(w)
        return (upto - each + (each + 1) / 2)[:, self.back]

    def quantile(self, upto: np.ndarray, q: float) -> np.ndarray:
        """Of each draw, the value at whose copies the position q * (n - 1) lies."""
        return np.array([self.values[min(np.searchsorted(run, q * (run[-1] - 1), "right"), len(run) - 1)] for run in upto])


def _rank_metrics(w: np.ndarray, y: np.ndarray, ry: np.ndarray, prediction: _Ranked, error: _Ranked) -> tuple[np.ndarray, ...]:
    n, rp = w.sum(axis=1), prediction.ranks(w)
    sx, sy = (w * ry).sum(axis=1), (w * rp).sum(axis=1)
    cov = (w * ry * rp).sum(axis=1) - sx * sy / n
    var = ((w * ry * ry).sum(axis=1) - sx * sx / n) * ((w * rp * rp).sum(axis=1) - sy * sy / n)
    _, upto = error.upto(w)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(var > 0, cov / np.sqrt(np.maximum(var, 0)), np.nan), error.quantile(upto, 0.9), error.quantile(upto, 0.95)


def bootstrap_rank_samples(aligned: DataFrame, models: list[str], key: str, iterations: int = 2000, seed: int = 42, rows_bytes: int = ROWS_BYTES) -> DataFrame:
    """Rank and quantile metrics per (iteration, model): Spearman, p90 and p95 of the absolute error, for the draws of
    `bootstrap_samples`.

    Draws are independent, so they are what the tasks share out: if hash, truth and predictions of all rows take at most
    `rows_bytes`, every task gets them in one broadcast, sorts each column once and ranks slices of draws as weight
    matrices. A larger table is ranked block by block instead.
    """
    rows = aligned.na.drop(subset=["y_true", *models]).select(F.xxhash64(key, F.lit(seed)).alias("h"), *(F.col(c).cast("double").alias(c) for c in ("y_true", *models)))
    schema = "iteration int, model string, spearman double, p90_abs_error double, p95_abs_error double"
    spark, count = aligned.sparkSession, rows.count()
    if count == 0:
        return spark.createDataFrame([], schema)
    if count * 8 * (2 + len(models)) > rows_bytes:
        return _ranked_by_blocks(rows, models, iterations, count)
    shared = spark.sparkContext.broadcast({c: v.to_numpy() for c, v in zip(rows.columns, rows.toArrow().columns, strict=True)})
    at_once = max(1, SLICE_CELLS // count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shared.value, {}
        y = table["y_true"]
        for batch in batches:
            for i in batch.column("id").to_pylist():
                if not known:
                    known = {m: (_Ranked(table[m]), _Ranked(np.abs(table[m] - y))) for m in models}
                    truth = _Ranked(y)
                last = min(i + at_once, iterations)
                w = poisson_weights(table["h"], i, last).astype(float)
                full = w.sum(axis=1) > 0
                w, number = w[full], np.arange(i, last, dtype=np.int32)[full]
                ry = truth.ranks(w)
                for m, orders in known.items():
                    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array([m] * len(number)), *(pa.array(v, from_pandas=True) for v in _rank_metrics(w, y, ry, *orders))],
                                                     names=["iteration", "model", "spearman", "p90_abs_error", "p95_abs_error"])

    slices = -(-iterations // at_once)
    return spark.range(0, iterations, at_once, min(slices, 4 * max(1, spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


class _Cells:
    """Cells of one column between quantile edges: cell 2i holds the values between two edges, cell 2i + 1 the value of an
    edge alone, so a value that many rows share needs no more than its weight."""

    def __init__(self, edges: list[float]) -> None:
        self.edges, self.count = np.array(sorted(set(edges)), float), 2 * len(set(edges)) + 1

    def of(self, values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.edges, values, "left")
        return 2 * at + (values == np.append(self.edges, np.inf)[at]) * (at < len(self.edges))


def _cell_weights(cells: dict[str, _Cells], errors: dict[str, str], iterations: int, at_once: int = 64):
    """Per task: weight of every cell of every column in every draw; one row per slice of draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, total = sum(c.count for c in cells.values()), None
        for batch in batches:
            if total is None:
                total = np.zeros((iterations, width))
            values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("y_true", *errors.values())}
            values |= {e: np.abs(values[m] - values["y_true"]) for e, m in errors.items()}
            name, marks, first = batch.column("h").to_numpy(zero_copy_only=False), np.zeros((batch.num_rows, width), np.float32), 0
            for c, cell in cells.items():
                marks[np.arange(batch.num_rows), first + cell.of(values[c])] = 1
                first += cell.count
            for i in range(0, iterations, at_once):
                total[i : i + at_once] += poisson_weights(name, i, min(i + at_once, iterations)).astype(np.float32) @ marks  # whole numbers below 2**24
        for i in range(0, iterations if total is not None else 0, at_once):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i : i + at_once].tobytes()], pa.binary())], names=["first", "sums"])

    return run


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v, np.float64) for v in table.column("sums").to_pylist())
    return pa.table({"first": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _shape(models: list[str], blocks: int) -> tuple[int, ...]:
    """Of the groups: model, block of the truth, block of the prediction, part. Edges that are equal leave fewer blocks."""
    return len(models), blocks, blocks, blocks + 1


def _block_rows(cells: dict[str, _Cells], models: list[str], blocks: int):
    """Rows of each pair of blocks, a block of the truth and one of a model's prediction: all rows that lie between the edges of
    one of them. A row on an edge in both needs no neighbours, so such rows are dealt by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "y_true"))
            a = cells["y_true"].of(y)
            for i, m in enumerate(models):
                p = batch.column(m).to_numpy(zero_copy_only=False)
                b = cells[m].of(p)
                wide, tall = a % 2 == 0, b % 2 == 0
                parts = []  # rows, block of the truth, block of the prediction, part
                for k in range(len(cells[m].edges) + 1):
                    at = np.flatnonzero(wide)
                    parts.append((at, a[at] // 2, np.full(len(at), k), np.zeros(len(at), np.int64)))
                for k in range(len(cells["y_true"].edges) + 1):
                    at = np.flatnonzero(tall & ~(wide & (a // 2 == k)))
                    parts.append((at, np.full(len(at), k), b[at] // 2, np.zeros(len(at), np.int64)))
                at = np.flatnonzero(~wide & ~tall)
                parts.append((at, a[at] // 2, b[at] // 2, 1 + (h[at].view(np.uint64) % np.uint64(blocks)).astype(np.int64)))
                rows, ya, pb, part = (np.concatenate(x) for x in zip(*parts, strict=True))
                group = np.ravel_multi_index((np.full(len(rows), i), ya, pb, part), _shape(models, blocks))
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(h[rows]), pa.array(y[rows]), pa.array(p[rows])], names=["group", "h", "y", "p"])

    return run


class _Block:
    """Rows between two edges of one column in order, for the weighted ranks inside the block, one draw at a time."""

    def __init__(self, h: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, bool)
        self.h, self.ends = h[order], np.append(np.flatnonzero(new), len(order)).astype(np.int32)
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.arange(len(order), dtype=np.int32)
        self.value = np.cumsum(new, dtype=np.int32) - 1  # number of the distinct value at each place

    def draw(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each place and of all places before it."""
        w = poisson_weights(self.h, i, i + 1)[0]
        upto = np.zeros(len(w) + 1, np.int32)
        np.cumsum(w, dtype=np.int32, out=upto[1:])
        return w, upto


def _block_sums(cells: dict[str, _Cells], models: list[str], iterations: int, slices: int, blocks: int, shared):
    """Sums of one pair of blocks for a slice of draws: products of both ranks and, once per block, squares; ranks count from the middle.

    Of a row that lies in one of the blocks only, a task keeps the hash in the block's order."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group, piece = (k.as_py() for k in key)
        m, ya, pb, part = (int(x) for x in np.unravel_index(group, _shape(models, blocks)))
        size, mine, met = table.num_rows, 0, [0, 0]
        mixed = lambda *kinds: [np.empty(size, k) for k in kinds]  # noqa: E731  pages that stay empty take no memory
        held, found = (mixed(np.int64, float), mixed(np.int64, float)), mixed(np.int64, np.int32, np.int32, np.int32, np.int32)
        for batch in table.select(["h", "y", "p"]).to_batches():
            h, y, p = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
            a, b = cells["y_true"].of(y), cells[models[m]].of(p)
            own = (a // 2 == ya) & (b // 2 == pb)
            if part == 0:  # a row on an edge in both has its own groups
                own &= (a % 2 == 0) | (b % 2 == 0)
            row = [h, a, b]
            for k, (values, inside) in enumerate(((y, a == 2 * ya), (p, b == 2 * pb))):
                row.append(np.where(inside, met[k] + np.cumsum(inside) - 1, -1))
                last = met[k] + int(inside.sum())
                for to, what in zip(held[k], (h, values), strict=True):
                    to[met[k] : last] = what[inside]
                met[k] = last
            last = mine + int(own.sum())
            for to, what in zip(found, row, strict=True):
                to[mine:last] = what[own]
            mine = last
        h, a, b, *number = (x[:mine] for x in found)
        pair = []
        for rows, last in zip(held, met, strict=True):
            pair.append(_Block(*(x[:last] for x in rows)))
            rows.clear()
        del found, values, what, to
        order = np.argsort(pair[0].place[number[0]] if met[0] else a, kind="stable")
        h, a, b, number = h[order], a[order], b[order], [x[order] for x in number]
        del order
        sides, weighed, w = [], np.zeros(len(h), bool), np.zeros(len(h), np.uint8)
        for c, cell, block, squares, rows, among in (("y_true", a, ya, pb == 0, pair[0], number[0]), (models[m], b, pb, ya == 0, pair[1], number[1])):
            mine = np.flatnonzero(among >= 0).astype(np.int32)
            at = rows.place[among[mine]]
            fresh = ~weighed[mine]
            weighed[mine] = True
            every = len(mine) == len(h)
            sides.append((c, None if every else cell, 2 * block, squares and part == 0, rows, None if every else mine, rows.value[at], mine[fresh], at[fresh]))
        rest = np.flatnonzero(~weighed)
        h = h[rest]
        del mine, at, fresh, among, number, a, b, cell
        draws = range(iterations * piece // slices, iterations * (piece + 1) // slices)
        out = np.zeros((len(draws), 3))
        for row, i in zip(out, draws, strict=True):
            middle, ranks = (shared.value["n"][i] + 1) / 2, []
            for k, (c, cell, block, squares, rows, mine, value, fresh, at) in enumerate(sides):
                weight, before = shared.value[c][0][i], shared.value[c][1][i]
                rank = None if mine is None else (before + (weight + 1) / 2 - middle)[cell]
                if len(rows.h):
                    each, upto = rows.draw(i)
                    shift = before[block] - middle + 0.5
                    ends = upto[rows.ends]
                    twice = ends[1:] + ends[:-1]
                    if mine is None:
                        rank = twice[value] * 0.5 + shift
                    else:
                        rank[mine] = twice[value] * 0.5 + shift
                    if len(fresh) == len(w):
                        w = each[at]
                    else:
                        w[fresh] = each[at]
                    if squares:
                        square = twice * 0.5
                        square += shift
                        square *= square
                        row[1 + k] = square @ (ends[1:] - ends[:-1])
                ranks.append(np.zeros(len(w)) if rank is None else rank)
            if len(rest):
                w[rest] = poisson_weights(h, i, i + 1)[0]
            ranks[0] *= w
            row[0] = ranks[0] @ ranks[1]
        return pa.table({"iteration": pa.array(draws, pa.int32()), "model": [models[m]] * len(draws), **{n: pa.array(out[:, k].copy()) for k, n in enumerate(("cov", "vy", "vp"))}})

    return run


def _error_values(cells: _Cells, wanted: dict[int, list[tuple[int, float, str]]]):
    """Of the errors of one cell, the value at the wanted position of each draw; positions count inside the cell."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        asked, rows = wanted[key[0].as_py()], table.column("e").to_numpy()
        order = np.argsort(rows, kind="stable")
        h, e = table.column("h").to_numpy()[order], rows[order]
        found = []
        for i, position, _ in asked:
            run_ = np.cumsum(poisson_weights(h, i, i + 1)[0])
            found.append(float(e[min(np.searchsorted(run_, position, "right"), len(e) - 1)]))
        return pa.table({"iteration": pa.array([a[0] for a in asked], pa.int32()), "metric": [a[2] for a in asked], "value": pa.array(found, pa.float64())})

    return run


def _ranked_by_blocks(rows: DataFrame, models: list[str], iterations: int, count: int) -> DataFrame:
    """The same for tables of any size, without a row per draw.

    Quantile edges cut the truth and every prediction into blocks of at most some `BLOCK_ROWS` rows. One pass adds each draw's weight per
    block, which tells how much lies before a block. Then a task ranks one block of the truth against one of a prediction for
    all draws: it holds their rows only, and draws follow from the rows' hashes. Rows move once per block of the other
    column, whatever the number of draws. Errors are cut closely around their quantiles, and only the cells that hold one are sorted.
    """
    blocks = -(-count // BLOCK_ROWS)
    slices = max(1, min(iterations, round(BLOCK_TASKS / (len(models) * blocks * blocks))))  # of the draws, where there are few blocks
    errors = {f"_e{i}": m for i, m in enumerate(models)}
    rows = stored_columns(rows)
    wide = rows.withColumns({e: F.abs(F.col(m) - F.col("y_true")) for e, m in errors.items()})
    even = [i / blocks for i in range(1, blocks)]
    near = sorted({*even, 0.89, 0.91, 0.94, 0.96})
    error = min(0.001, 1 / (8 * blocks))
    edges = (wide.approxQuantile(["y_true", *models], even, error) if even else [[]] * (1 + len(models))) + wide.approxQuantile(list(errors), near, error)
    cells = {c: _Cells(e) for c, e in zip(["y_true", *models, *errors], edges, strict=True)}

    sums = rows.mapInArrow(_cell_weights(cells, errors, iterations), "first int, sums binary").groupBy("first").applyInArrow(_added, "first int, sums binary")
    width = sum(c.count for c in cells.values())
    weights = np.concatenate([np.frombuffer(bytes(r["sums"]), np.float64).reshape(-1, width) for r in sorted(sums.collect(), key=lambda r: r["first"])])  # draws x cells
    known, first = {}, 0
    for c, cell in cells.items():
        w = weights[:, first : first + cell.count]
        known[c], first = (w, np.cumsum(w, axis=1) - w), first + cell.count
    known["n"] = n = known["y_true"][0].sum(axis=1)
    shared = rows.sparkSession.sparkContext.broadcast({c: known[c] for c in ("n", "y_true", *models)})

    by = ["group", "piece"]
    dealt = rows.mapInArrow(_block_rows(cells, models, blocks), "group long, h long, y double, p double")
    dealt = dealt.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * len(models) * blocks * blocks * slices)
    products = dealt.repartition(parts, *by).groupBy(*by).applyInArrow(_block_sums(cells, models, iterations, slices, blocks, shared), "iteration int, model string, cov double, vy double, vp double")
    products = products.groupBy("iteration", "model").agg(F.sum("cov").alias("cov"), F.sum("vy").alias("vy"), F.sum("vp").alias("vp"))

    middle, on_edges = (n + 1) / 2, {}
    for c in ("y_true", *models):
        weight, before = (x[:, 1::2] for x in known[c])
        on_edges[c] = (weight * (before + (weight + 1) / 2 - middle[:, None]) ** 2).sum(axis=1)
    live = np.flatnonzero(n > 0).tolist()
    fixed, sought = [], {}
    for e, m in errors.items():
        weight, before = known[e]
        for i in live:
            for q, metric in ((0.9, "p90_abs_error"), (0.95, "p95_abs_error")):
                position = q * (n[i] - 1)
                at = min(int(np.searchsorted(before[i] + weight[i], position, "right")), cells[e].count - 1)
                if at % 2:
                    fixed.append((i, m, metric, float(cells[e].edges[at // 2])))
                else:
                    sought.setdefault(e, {}).setdefault(at, []).append((i, position - before[i][at], metric))
    spark = rows.sparkSession
    tall = spark.createDataFrame(fixed, "iteration int, model string, metric string, value double")
    for e, wanted in sought.items():
        cell = sum((F.col(e) > v).cast("int") + (F.col(e) >= v).cast("int") for v in cells[e].edges.tolist())
        held = wide.select(cell.alias("cell"), "h", F.col(e).alias("e")).where(F.col("cell").isin(list(wanted)))
        found = held.groupBy("cell").applyInArrow(_error_values(cells[e], wanted), "iteration int, metric string, value double")
        tall = tall.unionByName(found.select("iteration", F.lit(errors[e]).alias("model"), "metric", "value"))
    at = lambda metric: F.max(F.when(F.col("metric") == metric, F.col("value"))).alias(metric)
    quantile = tall.groupBy("iteration", "model").agg(at("p90_abs_error"), at("p95_abs_error"))
    extra = spark.createDataFrame([(i, m, float(on_edges["y_true"][i]), float(on_edges[m][i])) for i in live for m in models], "iteration int, model string, ey double, ep double")
    joined = products.join(extra, ["iteration", "model"]).join(quantile, ["iteration", "model"])
    spread = F.sqrt((F.col("vy") + F.col("ey")) * (F.col("vp") + F.col("ep")))
    return joined.select("iteration", "model", F.try_divide("cov", spread).alias("spearman"), "p90_abs_error", "p95_abs_error")


def bootstrap_intervals(samples: DataFrame, metrics: list[str], alpha: float = ALPHA) -> DataFrame:
    """Mean, sample standard deviation and percentile bounds per (model, metric). One value per iteration, so the
    built-in exact percentile holds at most `iterations` values."""
    long = samples.unpivot(["iteration", "model"], metrics, "metric", "value")
    return long.groupBy("model", "metric").agg(
        F.avg("value").alias("bootstrap_mean"),
        F.stddev_samp("value").alias("bootstrap_std"),
        F.percentile("value", F.lit(alpha / 2)).alias("ci_low"),
        F.percentile("value", F.lit(1 - alpha / 2)).alias("ci_high"),
        F.count("value").alias("iterations"),
    )


def bootstrap_differences(samples: DataFrame, metrics: list[str], alpha: float = ALPHA) -> DataFrame:
    """Interval of the metric difference per model pair, paired by iteration."""
    long = samples.unpivot(["iteration", "model"], metrics, "metric", "value")
    a = long.select("iteration", "metric", F.col("model").alias("model_a"), F.col("value").alias("a"))
    b = long.select("iteration", "metric", F.col("model").alias("model_b"), F.col("value").alias("b"))
    d = a.join(b, ["iteration", "metric"]).where("model_a < model_b").withColumn("d", F.col("a") - F.col("b"))
    return d.groupBy("model_a", "model_b", "metric").agg(
        F.avg("d").alias("mean_delta_a_minus_b"),
        F.percentile("d", F.lit(alpha / 2)).alias("ci_low"),
        F.percentile("d", F.lit(1 - alpha / 2)).alias("ci_high"),
        F.count("d").alias("iterations"),
    )


def comparison_suite(aligned: DataFrame, models: list[str], key: str, track: str = "risk", iterations: int = 2000, buckets: int = 5) -> dict[str, DataFrame]:
    """All comparison tables of one track."""
    views = risk_losses if track == "risk" else valuation_losses
    registry = M.RISK_METRICS if track == "risk" else M.VALUATION_METRICS
    long = M.melt_models(aligned, models, [key])
    bucketed = M.with_quantile_bucket(aligned, "y_true", buckets)
    tall = M.melt_models(bucketed, models, [key, "bucket", "bucket_label"])
    error = F.abs(F.col("y_pred") - F.col("y_true"))
    if track != "risk":
        error = error / F.greatest(F.col("y_true"), F.lit(S.RATIO_EPS))
    ranks = bucket_ranks(tall, error, buckets)
    samples = bootstrap_samples(aligned, models, key, iterations)
    shown = ["rmse", "mae", "r2", "pearson"] if track == "risk" else ["rmse", "r2", "mape"]
    return {
        "metrics": M.metric_table(long, registry),
        "bootstrap": bootstrap_intervals(samples, shown),
        "bootstrap_deltas": bootstrap_differences(samples, shown),
        "pairwise": pairwise_table(aligned, models, views),
        "calibration": calibration_table(long),
        "bias": bias_table(long),
        "buckets": M.bucket_table(tall, buckets, relative=track != "risk"),
        "kruskal": kruskal_with_p(ranks),
        "dunn": dunn_table(ranks),
    }
