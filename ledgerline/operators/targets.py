"""Valuation targets and forward drawdown labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import lists as L
from ledgerline.functions import scalars as S
from ledgerline.operators.joins import asof_backward, forward_window_join, merge_fill
from ledgerline.operators.market import running_drawdown

MAX_ANCHOR_LAG_DAYS = 10
HORIZON_DAYS = 365
BUFFER_DAYS = 7
MIN_FUTURE_BARS = 30

ID_COLUMNS = ["ticker", "cik", "fiscal_year", "period_end", "timeframe"]
TARGET_COLUMNS = ["future_1y_max_drawdown", "drawdown_severity", "target_status", "target_usable", "target_issue_codes"]
# Columns that would leak the label or carry text, never features.
DENIED_FEATURES = [
    "news_description", "news_published_utc", "news_year", "anchor_trade_date", "future_anchor_trade_date",
    "future_horizon_end_date", "future_horizon_last_trade_date", "future_bar_count", "future_1y_total_return",
    "future_mdd_peak_date", "future_mdd_trough_date", "future_mdd_peak_close", "future_mdd_trough_close",
]


def anchor_prices(companies: DataFrame, bars: DataFrame) -> DataFrame:
    """Last close on or before period end and how many days it lies back."""
    priced = asof_backward(
        companies, bars.select("ticker", "date", F.col("close").alias("anchor_close")),
        ["ticker"], "period_end", "date", ["anchor_close"], "anchor_trade_date",
    )
    return priced.withColumn("anchor_lag_days", S.lag_days("period_end", "anchor_trade_date"))


def valuation_targets(priced: DataFrame, max_lag_days: int = MAX_ANCHOR_LAG_DAYS) -> DataFrame:
    """Market cap, enterprise value, multiples and their status for rows with an anchor price."""
    diluted, basic, close = F.col("diluted_shares_outstanding"), F.col("basic_shares_outstanding"), F.col("anchor_close")
    shares = F.when(diluted > 0, diluted).when(basic > 0, basic)
    d = priced.withColumns(
        {
            "shares_target": shares,
            "shares_target_source": F.when(diluted > 0, F.lit("diluted_shares_outstanding")).when(
                basic > 0, F.lit("basic_shares_outstanding")
            ),
            "market_cap_basic_target": F.when((close > 0) & (basic > 0), close * basic),
            "market_cap_diluted_target": F.when((close > 0) & (diluted > 0), close * diluted),
            "market_cap_target": F.when(close > 0, close * shares),
        }
    )
    cap = F.col("market_cap_target")
    d = d.withColumn("enterprise_value_target", cap + F.col("total_debt") - F.col("cash_and_equivalents"))
    d = d.withColumn("enterprise_value_target_clipped", S.clip("enterprise_value_target", low=0.0))
    clipped = F.col("enterprise_value_target_clipped")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    no_price = F.col("anchor_trade_date").isNull() | ~F.coalesce(close > 0, F.lit(False))
    no_shares = F.col("shares_target").isNull()
    bad_cap = ~F.coalesce(cap > 0, F.lit(False))
    codes = L.issue_codes(
        [
            ("missing_market_price", no_price),
            ("stale_anchor_price", F.coalesce(F.col("anchor_lag_days") > max_lag_days, F.lit(False))),
            ("missing_share_count", no_shares),
            ("invalid_market_cap", bad_cap & ~no_price & ~no_shares),
        ]
    )
    d = d.withColumns(
        {
            "log_market_cap_target": F.when(cap > 0, F.log1p(cap)),
            "log_enterprise_value_target": F.log1p(clipped),
            "enterprise_value_negative_flag": F.coalesce(F.col("enterprise_value_target") < 0, F.lit(False)).cast("int"),
            "price_to_sales_target": S.div_finite(cap, positive("revenue")),
            "price_to_book_target": S.div_finite(cap, positive("total_equity")),
            "ev_to_ebitda_target": S.div_finite(clipped, positive("ebitda")),
            "_codes": codes,
        }
    )
    usable = F.size("_codes") == 0
    return d.withColumns(
        {
            "valuation_target_status": L.leading_status("_codes"),
            "valuation_target_issue_codes": L.joined_codes("_codes", "|"),
            "valuation_target_usable": usable,
            "enterprise_value_target_usable": usable & F.col("log_enterprise_value_target").isNotNull(),
        }
    ).drop("_codes")


def future_drawdowns(obs: DataFrame, bars: DataFrame, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """Forward maximum drawdown per (ticker, period_end) with bars in the horizon.

    The trough is the earliest minimum of the drawdown and the peak the earliest maximum up to it. A path has at
    most one bar per day of the horizon.
    """
    path = forward_window_join(obs, bars, horizon_days)
    seen = running_drawdown(path, ["ticker", "period_end"])
    folded = seen.groupBy("ticker", "period_end").agg(
        F.count("*").alias("future_bar_count"),
        F.min("drawdown").alias("future_1y_max_drawdown"),
        F.min("date").alias("anchor_trade_date"),
        F.max("date").alias("horizon_last_trade_date"),
        F.min(F.struct("drawdown", "date", "close", "running_peak", "peak_date")).alias("_trough"),
        F.min(F.struct("date", "close")).alias("_first"),
        F.max(F.struct("date", "close")).alias("_last"),
    )
    return folded.select(
        "ticker",
        "period_end",
        "future_bar_count",
        "future_1y_max_drawdown",
        (F.col("_last.close") / F.greatest(F.col("_first.close"), F.lit(1e-12)) - 1).alias("future_1y_total_return"),
        "anchor_trade_date",
        "horizon_last_trade_date",
        F.col("_trough.peak_date").alias("mdd_peak_date"),
        F.col("_trough.date").alias("mdd_trough_date"),
        F.col("_trough.running_peak").alias("mdd_peak_close"),
        F.col("_trough.close").alias("mdd_trough_close"),
    )


def drawdown_labels(obs: DataFrame, bars: DataFrame, horizon_days: int = HORIZON_DAYS, buffer_days: int = BUFFER_DAYS,
                    min_bars: int = MIN_FUTURE_BARS, reach: DataFrame | None = None) -> DataFrame:
    """Labels with status and issue codes for every observation.

    `reach` (ticker, last_bar) is needed where `bars` were pruned by date; without it the bars tell their own reach.
    """
    if reach is None:
        reach = bars.groupBy("ticker").agg(F.max("date").alias("last_bar"))
    reach = reach.select("ticker", F.col("last_bar").alias("_last_bar"))
    labelled = (
        obs.join(future_drawdowns(obs, bars, horizon_days), ["ticker", "period_end"], "left")
        .join(reach, "ticker", "left")
        .withColumn("horizon_end_date", F.date_add("period_end", horizon_days))
    )
    found = F.col("future_bar_count").isNotNull()
    codes = L.issue_codes(
        [
            ("missing_market_data", F.col("_last_bar").isNull()),
            ("no_forward_bars", F.col("_last_bar") < F.col("period_end")),
            ("empty_horizon_window", (F.col("_last_bar") >= F.col("period_end")) & ~found),
            ("anchor_after_period_end", F.col("anchor_trade_date") > F.date_add("period_end", buffer_days)),
            (
                "insufficient_horizon_coverage",
                F.col("horizon_last_trade_date") < F.date_sub("horizon_end_date", buffer_days),
            ),
            ("too_few_future_bars", F.col("future_bar_count") < min_bars),
        ]
    )
    labelled = labelled.withColumn("_codes", codes)
    status = F.when(F.size("_codes") == 0, F.lit("ok")).when(found, F.lit("partial_horizon")).otherwise(
        L.leading_status("_codes")
    )
    return labelled.withColumns(
        {
            "future_bar_count": F.coalesce("future_bar_count", F.lit(0)),
            "target_status": status,
            "target_usable": status == "ok",
            "target_issue_codes": L.joined_codes("_codes", ";"),
        }
    ).drop("_codes", "_last_bar")


LABEL_NAMES = {
    "anchor_trade_date": "future_anchor_trade_date",
    "horizon_end_date": "future_horizon_end_date",
    "horizon_last_trade_date": "future_horizon_last_trade_date",
    "mdd_peak_date": "future_mdd_peak_date",
    "mdd_trough_date": "future_mdd_trough_date",
    "mdd_peak_close": "future_mdd_peak_close",
    "mdd_trough_close": "future_mdd_trough_close",
}


def merge_labels(market: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels joined 1:1 onto the market dataset under `future_` names."""
    keys = ["ticker", "period_end"]
    extra = labels.drop(*[c for c in ("fiscal_year", "timeframe") if c in labels.columns])
    return merge_fill(market, extra.withColumnsRenamed(LABEL_NAMES), keys)


def with_severity(df: DataFrame) -> DataFrame:
    return df.withColumn("drawdown_severity", S.clip(-F.col("future_1y_max_drawdown"), low=0.0))


def risk_rows(df: DataFrame, timeframe: str = "annual") -> DataFrame:
    """Annual rows with a usable label and the severity column."""
    kept = df.where((F.lower("timeframe") == timeframe) & F.col("future_1y_max_drawdown").isNotNull() & F.col("target_usable"))
    return with_severity(kept)


def risk_row_audit(df: DataFrame, timeframe: str = "annual") -> DataFrame:
    annual = F.lower("timeframe") == timeframe
    labelled = annual & F.col("future_1y_max_drawdown").isNotNull()
    return df.agg(
        F.count("*").alias("rows_input"),
        F.count_if(annual).alias("rows_after_timeframe_filter"),
        F.count_if(labelled).alias("rows_after_non_null_target"),
        F.count_if(labelled & F.col("target_usable")).alias("rows_after_usable_target_filter"),
    )


def feature_columns(columns: list[str]) -> list[str]:
    """Columns a model may see: no id, no target, nothing that looks into the future."""
    hidden = {*ID_COLUMNS, *TARGET_COLUMNS, *DENIED_FEATURES}
    return [c for c in columns if c not in hidden and not c.startswith("future_")]


def ordered_risk_columns(df: DataFrame) -> DataFrame:
    lead = [c for c in [*ID_COLUMNS, *TARGET_COLUMNS] if c in df.columns]
    return df.select(*lead, *feature_columns(df.columns))
