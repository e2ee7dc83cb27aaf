"""As-of, interval and merge joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spread(df: DataFrame, by: list[str]) -> DataFrame:
    """Hash partitions on `by`, one per shuffle partition of the session.

    Rolling windows cost far more per byte than adaptive execution assumes when it merges small partitions; a stated
    number keeps the work spread, and it is the same shuffle the windows would ask for.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str,
                  values: list[str], time_name: str) -> DataFrame:
    """For each left row the last right row of its group at or before `left_time`; nulls where there is none.

    One shuffle on `by` and one sort serve both sides. Both inputs hold at most one row per group and day (see
    `keep_latest`), so a group is bounded by the calendar and not by the size of the raw data.
    """
    payload = F.struct(F.col(right_time).alias(time_name), *values)
    marked_left = spread(left, by).withColumns({"_at": F.col(left_time), "_side": F.lit(1)})
    marked_right = right.select(*by, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), payload.alias("_seen"))
    w = W.partitionBy(*by).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = marked_left.unionByName(marked_right, allowMissingColumns=True)
    filled = both.withColumn("_last", F.last("_seen", ignorenulls=True).over(w)).where("_side = 1")
    return filled.select(*left.columns, f"_last.{time_name}", *[f"_last.{v}" for v in values])


def forward_window_join(obs: DataFrame, bars: DataFrame, horizon_days: int = 365,
                        values: tuple[str, ...] = ("close",)) -> DataFrame:
    """Bars with period_end <= date <= period_end + horizon, per (ticker, period_end).

    Both sides meet on (ticker, calendar year): an observation is repeated only for the years its horizon
    touches, so a bar is compared with the observations of its own year and not with the ticker's whole history.
    Equal observations give one path.
    """
    reach = F.date_add("period_end", horizon_days)
    keyed = obs.select("ticker", "period_end", reach.alias("horizon_end_date")).distinct().withColumn(
        "_year", F.explode(F.sequence(F.year("period_end"), F.year("horizon_end_date")))
    )
    dated = bars.select("ticker", "date", *values).withColumn("_year", F.year("date"))
    return (
        keyed.join(dated, ["ticker", "_year"])
        .where((F.col("date") >= F.col("period_end")) & (F.col("date") <= F.col("horizon_end_date")))
        .drop("_year")
    )


def one_row_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with all keys; fails when it runs if a key has several rows. The shuffle is the one a join on the keys needs.

    Each column is held by itself, so those that nobody reads are never computed.
    """
    others = [c for c in df.columns if c not in keys]
    filled = df.na.drop(subset=keys)
    held = filled.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(f"_held_{i}") for i, c in enumerate(others)])
    single = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"several rows for one key {keys}"))).otherwise(F.lit(True))
    return held.where(single).select(*keys, *[F.col(f"_held_{i}").alias(c) for i, c in enumerate(others)])


def merge_new_columns(main: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Left merge that only adds columns the main table lacks. `extra` has one row per key."""
    fresh = [c for c in extra.columns if c not in main.columns]
    return main.join(one_row_per_key(extra.select(*keys, *fresh), keys), keys, "left")


def merge_fill(main: DataFrame, extra: DataFrame, keys: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """Left merge: new columns are added, shared columns keep the main value and are filled where it is missing."""
    incoming = [c for c in extra.columns if c not in keys and c not in skip]
    renamed = extra.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in incoming])
    joined = main.join(one_row_per_key(renamed, keys), keys, "left")
    kept = [F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c) if c in incoming else F.col(c) for c in main.columns]
    added = [F.col(f"_new_{c}").alias(c) for c in incoming if c not in main.columns]
    return joined.select(*kept, *added)


def align_predictions(frames: dict[str, DataFrame], keys: list[str], baseline_from: str | None = None) -> DataFrame:
    """Inner 1:1 alignment of the models' predictions on the keys, complete rows only."""
    parts = []
    for i, (model, frame) in enumerate(frames.items()):
        extra = ["y_true"] if i == 0 else []
        parts.append(frame.select(*keys, *extra, F.col("y_pred").alias(model)))
    if baseline_from is not None:
        parts.append(frames[baseline_from].select(*keys, F.col("y_pred_baseline").alias("baseline")))
    joined = reduce(lambda a, b: a.join(b, keys), parts)
    models = list(frames) + (["baseline"] if baseline_from else [])
    return joined.na.drop(subset=["y_true", *models])


def common_keys(frames: list[DataFrame], preferred: list[str]) -> list[str]:
    shared = [k for k in preferred if all(k in f.columns for f in frames)]
    if not shared:
        raise ValueError(f"none of {preferred} occurs in every frame")
    return shared


def disagreeing_targets(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Keys whose targets differ by more than the tolerance; empty when the frames agree."""
    other = b.select(*keys, F.col("y_true").alias("y_true_other"))
    return a.select(*keys, "y_true").join(other, keys).where(F.abs(F.col("y_true") - F.col("y_true_other")) > tolerance)


def require_same_targets(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float) -> None:
    if not disagreeing_targets(a, b, keys, tolerance).isEmpty():
        raise ValueError("the frames disagree on y_true")


def attach_news(companies: DataFrame, news: DataFrame) -> DataFrame:
    """Lookup of the news lists by (ticker, year); empty lists where there is no news."""
    out = companies.join(news, ["ticker", "news_target_year"], "left")
    return out.withColumns(
        {
            "news_count": F.coalesce("news_count", F.lit(0)),
            "news_description": F.coalesce("news_description", F.array().cast("array<string>")),
            "news_published_utc": F.coalesce("news_published_utc", F.array().cast("array<string>")),
            "news_year": F.coalesce("news_year", F.array().cast("array<int>")),
        }
    )


def reindex_features(wanted: list[str], values: DataFrame, key: str = "feature", fill: float = 0.0) -> DataFrame:
    """Values in the order of the wanted list, `fill` where a feature is absent."""
    spark = values.sparkSession
    order = spark.createDataFrame([(i, f) for i, f in enumerate(wanted, 1)], f"position int, {key} string")
    return order.join(values, key, "left").na.fill(fill)
