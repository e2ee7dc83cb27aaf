"""Distribution shift between a training and a test table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators.ordering import cumulative_counts, quantiles

PSI_BINS = 10
PSI_EPS = 1e-6


def stack_features(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """Long table (side, feature, value) of both tables; infinities and NaN are missing."""
    side = lambda df, name: df.select(F.lit(name).alias("side"), *[S.to_number(f).alias(f) for f in features])
    return side(train, "train").unionByName(side(test, "test")).unpivot(["side"], features, "feature", "value")


def ks_table(long: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per feature from running counts over distinct values."""
    c = cumulative_counts(
        long, "value", ["feature"],
        weights={"a": (F.col("side") == "train").cast("long"), "b": (F.col("side") == "test").cast("long")},
    )
    share = lambda k: F.try_divide(F.col(f"{k}_before") + F.col(k), F.col(f"{k}_total"))
    return c.groupBy("feature").agg(F.max(F.abs(share("a") - share("b"))).alias("ks_stat"))


def psi_table(long: DataFrame, bins: int = PSI_BINS, eps: float = PSI_EPS) -> DataFrame:
    """Population stability index over training-quantile bins, closed left; fewer than three edges give 0."""
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    train = long.where("side = 'train'")
    edges = quantiles(train, "value", names, ["feature"]).select("feature", F.array_distinct(F.array(*names)).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    # One row of edges per feature.
    placed = long.where("value IS NOT NULL").join(F.broadcast(edges.withColumn("inner", inner)), "feature").select(
        "feature", "side", F.size("inner").alias("n_inner"), F.size(F.filter("inner", lambda e: e <= F.col("value"))).alias("bin")
    )
    counts = placed.groupBy("feature", "n_inner", "bin").agg(
        F.count_if(F.col("side") == "train").alias("a"), F.count_if(F.col("side") == "test").alias("b")
    )
    totals = counts.groupBy("feature").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count("*").alias("seen"))
    shares = counts.join(totals, "feature").withColumns(
        {"pa": F.greatest(F.col("a") / F.col("ta"), F.lit(eps)), "pb": F.greatest(F.try_divide("b", "tb"), F.lit(eps))}
    )
    term = (F.col("pb") - F.col("pa")) * F.ln(F.col("pb") / F.col("pa"))
    # A bin no row falls into has the floor share on both sides and adds nothing.
    return shares.groupBy("feature").agg(F.sum(F.when(F.col("n_inner") >= 1, term).otherwise(F.lit(0.0))).alias("psi"))


def moments_table(long: DataFrame) -> DataFrame:
    def cell(side, fn):
        return fn(F.when(F.col("side") == side, F.col("value")))
    missing = lambda side: F.avg(F.when(F.col("side") == side, F.col("value").isNull().cast("double")))
    return long.groupBy("feature").agg(
        missing("train").alias("train_missing_rate"),
        missing("test").alias("test_missing_rate"),
        cell("train", F.avg).alias("train_mean"),
        cell("test", F.avg).alias("test_mean"),
        cell("train", F.stddev_pop).alias("train_std"),
        cell("test", F.stddev_pop).alias("test_std"),
    )


def shift_table(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    long = stack_features(train, test, features)
    return moments_table(long).join(ks_table(long), "feature", "left").join(psi_table(long), "feature", "left")


def top_shifted(table: DataFrame, by: str, n: int = 10) -> DataFrame:
    return table.orderBy(F.desc(by), "feature").limit(n).select("feature", by)
