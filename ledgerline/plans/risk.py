"""Risk track: observations and bars to a labelled feature table, in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import targets as L
from ledgerline.operators.cleaning import clean_observations, only_requested, union_sources
from ledgerline.operators.joins import merge_fill
from ledgerline.operators.market import MARKET_FEATURES, attach_market_features
from ledgerline.sources.bar_table import read_needed_bars, read_reach


def needed_bars(bars: DataFrame, obs: DataFrame) -> DataFrame:
    """Bars of requested tickers only; `stored_labelled_dataset` also prunes by date."""
    return only_requested(bars, obs)


def market_dataset(obs: DataFrame, bars: DataFrame) -> DataFrame:
    return attach_market_features(obs, bars)


def labelled_dataset(obs: DataFrame, bars: DataFrame) -> DataFrame:
    """Market features and labels of every observation."""
    bars = needed_bars(bars, obs)
    return L.merge_labels(market_dataset(obs, bars), L.drawdown_labels(obs, bars))


def stored_labelled_dataset(obs: DataFrame, root: str, days_before: int) -> DataFrame:
    """`labelled_dataset` over a stored bar table: only the months around the observations are read."""
    spark = obs.sparkSession
    bars = needed_bars(read_needed_bars(spark, root, obs, days_before, L.HORIZON_DAYS + L.BUFFER_DAYS), obs)
    labels = L.drawdown_labels(obs, bars, reach=read_reach(spark, root))
    return L.merge_labels(market_dataset(obs, bars), labels)


def risk_dataset(obs: DataFrame, bars: DataFrame) -> DataFrame:
    """Usable annual rows: ids, targets, then features."""
    return L.ordered_risk_columns(L.risk_rows(labelled_dataset(obs, bars)))


def risk_dataset_with_fundamentals(companies: DataFrame, obs: DataFrame, bars: DataFrame) -> DataFrame:
    """The wide form: labels and market features merged onto the full company-year table."""
    extra = labelled_dataset(obs.select("ticker", "period_end", "timeframe"), bars).drop("timeframe")
    return L.ordered_risk_columns(L.risk_rows(merge_fill(companies, extra, ["ticker", "period_end"])))


def risk_splits(splits: dict[str, DataFrame], bars: DataFrame) -> DataFrame:
    """All dataset splits in one plan: bars are scanned and windowed once, `split_name` tells the splits apart."""
    universe = union_sources(splits, "split_name")
    keys = universe.select("ticker", "period_end").distinct()
    labelled = labelled_dataset(keys, bars)
    return L.risk_rows(universe.join(labelled, ["ticker", "period_end"]))


def split_summary(rows: DataFrame) -> DataFrame:
    """Rows, tickers, dates and target moments per split."""
    return rows.groupBy("split_name").agg(
        F.count("*").alias("rows"),
        F.count_distinct("ticker").alias("tickers"),
        F.min("period_end").alias("first_period_end"),
        F.max("period_end").alias("last_period_end"),
        F.min("drawdown_severity").alias("target_min"),
        F.max("drawdown_severity").alias("target_max"),
        F.avg("drawdown_severity").alias("target_mean"),
    )


def market_merge_summary(merged: DataFrame, bars: DataFrame) -> DataFrame:
    """One row: rows, tickers, range of the observations and of the bars, and how many rows each feature reaches.

    Both sides fold map-side to one row each.
    """
    traded = bars.agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last"))).scalar()
    filled = [F.count(c).alias(f"{c}_non_null") for c in ("anchor_trade_date", *MARKET_FEATURES)]
    return merged.agg(
        F.count("*").alias("rows"), F.count_distinct("ticker").alias("unique_tickers"),
        F.min("period_end").alias("min_period_end"), F.max("period_end").alias("max_period_end"), *filled,
    ).withColumns({"min_trade_date": traded["first"], "max_trade_date": traded["last"]})


def risk_summary(labelled: DataFrame, timeframe: str = "annual") -> DataFrame:
    """One row about the risk dataset and the rows it was filtered from, in one pass over the labelled rows."""
    rows = L.with_severity(labelled)
    annual = F.lower("timeframe") == timeframe
    target = annual & F.col("future_1y_max_drawdown").isNotNull()
    kept = F.coalesce(target & F.col("target_usable"), F.lit(False))
    of = lambda c: F.when(kept, F.col(c))
    return rows.agg(
        F.count("*").alias("rows_input"), F.count_if(annual).alias("rows_after_timeframe_filter"),
        F.count_if(target).alias("rows_after_non_null_target"), F.count_if(kept).alias("rows_risk_dataset"),
        F.count_distinct("ticker").alias("tickers_input"), F.count_distinct(of("ticker")).alias("tickers_risk_dataset"),
        F.min(of("period_end")).alias("min_period_end"), F.max(of("period_end")).alias("max_period_end"),
        F.min(of("fiscal_year")).alias("min_fiscal_year"), F.max(of("fiscal_year")).alias("max_fiscal_year"),
        F.min(of("drawdown_severity")).alias("severity_min"), F.max(of("drawdown_severity")).alias("severity_max"),
        F.avg(of("drawdown_severity")).alias("severity_mean"),
    )


def column_summary(source: DataFrame, kept: DataFrame) -> dict[str, list[str]]:
    """Columns of a risk dataset: kept, seen by a model, and dropped from the source."""
    return {
        "kept_columns": kept.columns, "feature_columns": L.feature_columns(kept.columns),
        "dropped_columns": [c for c in source.columns if c not in kept.columns],
    }


def prepare(raw: dict[str, DataFrame], bars: DataFrame) -> DataFrame:
    """Raw observation tables per split to labelled risk rows."""
    return risk_splits({name: clean_observations(df) for name, df in raw.items()}, bars)
