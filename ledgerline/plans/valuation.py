"""Valuation track: statements and bars to company-years with valuation targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import fundamentals as K
from ledgerline.operators.cleaning import only_requested
from ledgerline.operators.targets import anchor_prices, valuation_targets

NARROW = [
    "ticker", "fiscal_year", "period_end", "anchor_trade_date", "anchor_close", "anchor_lag_days", "shares_target",
    "shares_target_source", "market_cap_target", "log_market_cap_target", "enterprise_value_target_clipped",
    "log_enterprise_value_target", "valuation_target_status", "valuation_target_issue_codes", "valuation_target_usable",
    "enterprise_value_target_usable",
]


def company_table(bs: DataFrame, inc: DataFrame, cf: DataFrame, min_years: int = 1) -> DataFrame:
    """Base ratios plus expanded features and growth."""
    base = K.company_years(bs, inc, cf, min_years)
    return K.enrich(base, bs, inc, cf)


def valuation_dataset(companies: DataFrame, bars: DataFrame) -> DataFrame:
    return valuation_targets(anchor_prices(companies, only_requested(bars, companies)))


def narrow_targets(dataset: DataFrame) -> DataFrame:
    return dataset.select(*NARROW)


def valuation_summary(dataset: DataFrame) -> DataFrame:
    usable = F.col("valuation_target_usable")
    return dataset.agg(
        F.count("*").alias("rows"),
        F.count_distinct("ticker").alias("tickers"),
        F.min("fiscal_year").alias("first_year"),
        F.max("fiscal_year").alias("last_year"),
        F.count_if(usable).alias("usable_rows"),
        F.min(F.when(usable, F.col("market_cap_target"))).alias("market_cap_min"),
        F.max(F.when(usable, F.col("market_cap_target"))).alias("market_cap_max"),
        F.avg(F.when(usable, F.col("log_market_cap_target"))).alias("log_market_cap_mean"),
    )
