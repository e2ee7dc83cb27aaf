"""Rolling market features over daily bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.scalars import finite
from ledgerline.operators.joins import asof_backward, spread

TRADING_DAYS = 252
#: Bars of the longest frame.
LONGEST = 126
MARKET_FEATURES = [
    "volatility_21d",
    "volatility_63d",
    "drawdown_126d",
    "return_63d",
    "avg_dollar_volume_63d",
    "avg_transactions_21d",
    "high_low_range_21d",
]


def by_day():
    return W.partitionBy("ticker").orderBy("date")


def daily_inputs(bars: DataFrame) -> DataFrame:
    """Bars with daily returns, turnover and range; values that are no finite number count as missing."""
    numbers = [c for c, kind in bars.dtypes if kind in ("double", "float")]
    bars = bars.withColumns({c: finite(c) for c in numbers})
    log_close = F.when(F.col("close") > 0, F.ln("close"))
    return spread(bars, ["ticker"]).withColumns(
        {
            "log_return": log_close - F.lag(log_close).over(by_day()),
            "dollar_volume": F.col("close") * F.col("volume"),
            "day_range": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
        }
    )


# Rolling features as (input, rows, statistic).
ROLLING = {
    "volatility_21d": ("log_return", 21, "std"),
    "volatility_63d": ("log_return", 63, "std"),
    "avg_dollar_volume_63d": ("dollar_volume", 63, "mean"),
    "avg_transactions_21d": ("transactions", 21, "mean"),
    "high_low_range_21d": ("day_range", 21, "mean"),
}


def rolling(df: DataFrame, specs: dict[str, tuple[str, int, str]]) -> DataFrame:
    """Rolling mean or sample standard deviation per ticker, missing unless the frame holds `rows` values.

    Frames are bounded, so an outlier or a gap touches only the frames that hold it; all share one partitioning and sort.
    """
    out = {}
    for name, (c, rows, kind) in specs.items():
        frame = by_day().rowsBetween(1 - rows, W.currentRow)
        value = F.avg(c) if kind == "mean" else F.stddev_samp(c)
        out[name] = F.when(F.count(c).over(frame) == rows, value.over(frame))
    return df.withColumns(out)


def market_features(bars: DataFrame) -> DataFrame:
    """The seven features for every bar: all windows share one partitioning and one sort.

    `bars` has one row per (ticker, date), hence a ticker's window holds at most its trading days.
    """
    d = rolling(daily_inputs(bars), ROLLING)
    frame = by_day().rowsBetween(1 - LONGEST, W.currentRow)
    top = F.when(F.count("close").over(frame) == LONGEST, F.max("close").over(frame))
    d = d.withColumns({"_top": top, "_before": F.lag("close", 63).over(by_day())})
    return d.select("ticker", "date", "close", *_feature_columns())


def _feature_columns() -> list[Column]:
    """The features from rolling values, `close`, `_top` (highest close of 126 bars) and `_before` (close 63 bars ago)."""
    year = F.sqrt(F.lit(float(TRADING_DAYS)))
    columns = {
        **{c: F.col(c) for c in ROLLING},
        "volatility_21d": F.col("volatility_21d") * year,
        "volatility_63d": F.col("volatility_63d") * year,
        "drawdown_126d": F.try_divide("close", "_top") - 1,
        "return_63d": F.try_divide("close", "_before") - 1,
    }
    return [columns[n].alias(n) for n in MARKET_FEATURES]


def anchor_rows(obs: DataFrame, bars: DataFrame) -> DataFrame:
    """(ticker, _anchor): the number within its ticker of each bar that is the last one on or before a `period_end`."""
    dates = spread(bars.select("ticker", F.col("date").alias("_at"), F.lit(0).alias("_side")), ["ticker"])
    ends = spread(obs.select("ticker", F.col("period_end").alias("_at"), F.lit(1).alias("_side")), ["ticker"])
    w = W.partitionBy("ticker").orderBy("_at", "_side")
    numbered = dates.unionByName(ends).withColumns(
        {
            "_anchor": F.sum(1 - F.col("_side")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int"),
            "_next": F.lead("_side").over(w),
        }
    )
    return numbered.where("_side = 0 AND _next = 1").select("ticker", "_anchor")


def anchor_features(obs: DataFrame, bars: DataFrame) -> DataFrame:
    """`market_features` of only those bars that are the last one on or before a `period_end`; no ticker is null.

    A bar meets the anchors that stand less than 126 bars behind it, so the frames of other bars are never built.
    """
    numbered = daily_inputs(bars).withColumn("_row", F.row_number().over(by_day()))
    age = F.col("_anchor") - F.col("_row")
    near = numbered.join(anchor_rows(obs, bars), "ticker").where((age >= 0) & (age < LONGEST))
    out = {}
    for name, (c, rows, kind) in ROLLING.items():
        inside = F.when(age < rows, F.col(c))
        value = F.avg(inside) if kind == "mean" else F.stddev_samp(inside)
        out[name] = F.when(F.count(inside) == rows, value)
    out["_top"] = F.when(F.count("close") == LONGEST, F.max("close"))
    at = lambda c, back: F.max(F.when(age == back, F.col(c)))
    out |= {"_before": at("close", 63), "date": at("date", 0), "close": at("close", 0)}
    folded = near.groupBy("ticker", "_anchor").agg(*[v.alias(n) for n, v in out.items()])
    return folded.select("ticker", "date", "close", *_feature_columns())


def attach_market_features(obs: DataFrame, bars: DataFrame) -> DataFrame:
    """Features of the last bar on or before `period_end`; a missing ticker is a ticker of its own."""
    named = F.coalesce(F.concat(F.lit("="), F.col("ticker")), F.lit(""))
    keyed = obs.withColumns({"_ticker": F.col("ticker"), "ticker": named})
    features = anchor_features(keyed, bars.withColumn("ticker", named))
    out = asof_backward(keyed, features, ["ticker"], "period_end", "date", MARKET_FEATURES, "anchor_trade_date")
    return out.withColumn("ticker", F.col("_ticker")).drop("_ticker")


def running_drawdown(path: DataFrame, by: list[str], date: str = "date", price: str = "close") -> DataFrame:
    """Running peak (its earliest day) and drawdown below it. The peak's day is tracked only for those who read it."""
    w = W.partitionBy(*by).orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)
    top = F.max(F.struct(F.col(price).alias("price"), (-F.unix_date(date)).alias("day"))).over(w)
    return path.withColumns({"running_peak": F.max(price).over(w), "_top": top}).withColumns(
        {
            "peak_date": F.date_from_unix_date(-F.col("_top.day")),
            "drawdown": F.col(price) / F.greatest(F.col("running_peak"), F.lit(1e-12)) - 1,
        }
    ).drop("_top")


def coverage_window(obs: DataFrame, horizon_days: int = 365, buffer_days: int = 7) -> DataFrame:
    """Dates of market data the observations need; one row, usable to prune the scan by date."""
    return obs.agg(
        F.min("period_end").alias("fetch_start"),
        F.date_add(F.max("period_end"), horizon_days + buffer_days).alias("fetch_end"),
    )


def ticker_windows(obs: DataFrame, source: str = "source_dataset") -> DataFrame:
    """Per ticker: observations, distinct sources, first and last period."""
    return obs.groupBy("ticker").agg(
        F.count("*").alias("n_observations"),
        F.count_distinct(source).alias("n_sources"),
        F.min("period_end").alias("first_period_end"),
        F.max("period_end").alias("last_period_end"),
    )
