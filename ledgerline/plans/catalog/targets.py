"""Queries over drawdown labels and valuation targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import fundamentals as K
from ledgerline.operators import joins as J
from ledgerline.operators import metrics as M
from ledgerline.operators import targets as L
from ledgerline.operators.cleaning import clean_observations
from ledgerline.plans import risk as P
from ledgerline.plans import valuation as V
from ledgerline.plans.catalog import query
from ledgerline.plans.catalog.ctes import FEATURE_SQL, with_parts
from ledgerline.plans.catalog.fundamentals import _JOINED, _RATIO_SQL, _three
from ledgerline.plans.catalog.shared import D, R, Rs, rounded


@query("D3_forward_window", with_parts("obs bars", f"SELECT o.ticker, {D('o.period_end', 'period_end')}, count(*) AS n_bars, sum(b.close) AS total FROM obs o JOIN bars b ON b.ticker = o.ticker AND b.date BETWEEN o.period_end AND o.period_end + 365 GROUP BY 1, 2").replace("sum(b.close) AS total", R("sum(b.close)", 2, "total")))
def _(t):
    path = J.forward_window_join(t.observations, t.bars)
    return rounded(path.groupBy("ticker", "period_end").agg(F.count("*").alias("n_bars"), F.sum("close").alias("total")), 2)


_MDD = ["future_1y_max_drawdown", "future_1y_total_return"]


@query("L8_future_drawdown", with_parts("mdd", f"SELECT ticker, {D('period_end')}, future_bar_count, {Rs(_MDD)}, {D('anchor_trade_date')}, {D('horizon_last_trade_date')} FROM mdd"))
def _(t):
    return rounded(L.future_drawdowns(t.observations, t.bars).select("ticker", "period_end", "future_bar_count", *_MDD, "anchor_trade_date", "horizon_last_trade_date"))


@query("L9_peak_and_trough", with_parts("mdd", f"SELECT ticker, {D('period_end')}, {D('trough.pd', 'mdd_peak_date')}, {D('trough.t', 'mdd_trough_date')}, trough.p AS mdd_peak_close, trough.c AS mdd_trough_close FROM mdd"))
def _(t):
    return rounded(L.future_drawdowns(t.observations, t.bars).select("ticker", "period_end", "mdd_peak_date", "mdd_trough_date", "mdd_peak_close", "mdd_trough_close"))


@query("L10_label_status", with_parts("labels_", f"SELECT ticker, {D('period_end')}, target_status, target_issue_codes, target_usable, future_bar_count FROM labels_"))
def _(t):
    return rounded(L.drawdown_labels(t.observations, t.bars).select("ticker", "period_end", "target_status", "target_issue_codes", "target_usable", "future_bar_count"))


_FUTURE = "anchor_trade_date horizon_end_date horizon_last_trade_date mdd_peak_date mdd_trough_date".split()


@query("L11_labels_on_market", with_parts("obs_feats labels_", f"SELECT f.ticker, {D('f.period_end', 'period_end')}, {R('f.volatility_21d', 6, 'volatility_21d')}, {R('l.future_1y_max_drawdown', 6, 'future_1y_max_drawdown')}, l.target_status, "
    + ", ".join(D(f"l.{c}", f"future_{c}") for c in _FUTURE) + " FROM obs_feats f LEFT JOIN labels_ l ON l.ticker = f.ticker AND l.period_end = f.period_end"))
def _(t):
    out = P.labelled_dataset(t.observations, t.bars)
    return rounded(out.select("ticker", "period_end", "volatility_21d", "future_1y_max_drawdown", "target_status", *[f"future_{c}" for c in _FUTURE]))


@query("D6_merge_targets", with_parts("obs_feats labels_", f"SELECT f.ticker, {D('f.period_end', 'period_end')}, coalesce(CASE WHEN f.fiscal_year <= 1998 THEN 'known' END, l.target_status) AS target_status FROM obs_feats f LEFT JOIN labels_ l ON l.ticker = f.ticker AND l.period_end = f.period_end"))
def _(t):
    market = P.market_dataset(t.observations, t.bars).withColumn("target_status", F.when(F.col("fiscal_year") <= 1998, F.lit("known")))
    return rounded(L.merge_labels(market, L.drawdown_labels(t.observations, t.bars)).select("ticker", "period_end", "target_status"))


_RISK_OUT = f"ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, {D('period_end')}, timeframe, {R('future_1y_max_drawdown')}, {R('drawdown_severity')}, target_status, target_usable, target_issue_codes, {Rs(FEATURE_SQL, 5)}"


@query("L12_risk_dataset", with_parts("risk", f"SELECT {_RISK_OUT} FROM risk"))
def _(t):
    out = P.risk_dataset(t.observations, t.bars)
    return rounded(out.withColumns({c: F.round(c, 5) for c in FEATURE_SQL}), 6)


@query("L12_stage_counts", with_parts("labelled", "SELECT count(*) AS rows_input, count(*) FILTER (lower(timeframe) = 'annual') AS rows_after_timeframe_filter, count(future_1y_max_drawdown) AS rows_after_non_null_target, count(*) FILTER (future_1y_max_drawdown IS NOT NULL AND target_usable) AS rows_after_usable_target_filter FROM labelled"))
def _(t):
    return L.risk_row_audit(P.labelled_dataset(t.observations, t.bars))


@query("E7_market_merge_summary", with_parts("obs_feats bars", f"""SELECT count(*) AS rows, count(DISTINCT ticker) AS unique_tickers, {D('min(period_end)', 'min_period_end')}, {D('max(period_end)', 'max_period_end')},
    {D('(SELECT min(date) FROM bars)', 'min_trade_date')}, {D('(SELECT max(date) FROM bars)', 'max_trade_date')}, {', '.join(f'count({c}) AS {c}_non_null' for c in ['anchor_trade_date', *FEATURE_SQL])} FROM obs_feats"""))
def _(t):
    return rounded(P.market_merge_summary(P.market_dataset(t.observations, t.bars), t.bars))


@query("E7_risk_summary", with_parts("labelled risk", f"""SELECT (SELECT count(*) FROM labelled) AS rows_input, (SELECT count(*) FROM labelled WHERE lower(timeframe) = 'annual') AS rows_after_timeframe_filter,
    (SELECT count(*) FROM labelled WHERE lower(timeframe) = 'annual' AND future_1y_max_drawdown IS NOT NULL) AS rows_after_non_null_target, count(*) AS rows_risk_dataset,
    (SELECT count(DISTINCT ticker) FROM labelled) AS tickers_input, count(DISTINCT ticker) AS tickers_risk_dataset, {D('min(period_end)', 'min_period_end')}, {D('max(period_end)', 'max_period_end')},
    CAST(min(fiscal_year) AS BIGINT) AS min_fiscal_year, CAST(max(fiscal_year) AS BIGINT) AS max_fiscal_year, {R('min(drawdown_severity)', 6, 'severity_min')}, {R('max(drawdown_severity)', 6, 'severity_max')},
    {R('avg(drawdown_severity)', 6, 'severity_mean')} FROM risk"""))
def _(t):
    return rounded(P.risk_summary(P.labelled_dataset(t.observations, t.bars)))


@query("B19_ordered_columns", with_parts("risk", f"SELECT ticker, {D('period_end')}, {Rs(FEATURE_SQL, 5)} FROM risk"))
def _(t):
    out = L.ordered_risk_columns(L.risk_rows(P.labelled_dataset(t.observations, t.bars)))
    return rounded(out.select("ticker", "period_end", *L.feature_columns(out.columns)), 5)


@query("L13_leakage_guard", with_parts("risk", "SELECT unnest([" + ", ".join(f"'{c}'" for c in FEATURE_SQL) + "]) AS feature, count(*) AS risk_rows FROM risk"))
def _(t):
    out = P.risk_dataset(t.observations, t.bars)
    names = L.feature_columns(out.columns)
    return out.agg(F.count("*").alias("risk_rows")).select(F.explode(F.array(*[F.lit(c) for c in names])).alias("feature"), "risk_rows")


@query("L14_three_splits", with_parts("risk", f"SELECT split_name, ticker, {D('period_end')}, {R('drawdown_severity')} FROM (SELECT *, CASE WHEN fiscal_year <= 1997 THEN 'train' WHEN fiscal_year <= 1999 THEN 'val' ELSE 'test' END AS split_name FROM risk)"))
def _(t):
    return rounded(_splits(t).select("split_name", "ticker", "period_end", "drawdown_severity"))


def _splits(t):
    o = t.observations
    return P.prepare({"train": o.where("fiscal_year <= 1997"), "val": o.where("fiscal_year BETWEEN 1998 AND 1999"), "test": o.where("fiscal_year >= 2000")}, t.bars)


@query("L14_risk_with_fundamentals", with_parts("risk bs inc cf", f"""SELECT r.ticker, CAST(r.fiscal_year AS BIGINT) AS fiscal_year, {R('r.drawdown_severity', 6, 'drawdown_severity')}, {R('r.volatility_63d', 6, 'volatility_63d')}, {R('j.roa', 4, 'roa')}
    FROM risk r JOIN rated j ON j.ticker = r.ticker AND j.period_end = r.period_end""", {"joined": _JOINED, "rated": f"SELECT *, {_RATIO_SQL['roa']} AS roa FROM joined"}))
def _(t):
    companies = K.company_years(*_three(t))
    obs = companies.select("ticker", "period_end", "timeframe")
    out = P.risk_dataset_with_fundamentals(companies, obs, t.bars)
    return rounded(out.select("ticker", "fiscal_year", "drawdown_severity", "volatility_63d", F.round("roa", 4).alias("roa")))


@query("E12_split_summary", with_parts("risk", f"SELECT split_name, count(*) AS rows, count(DISTINCT ticker) AS tickers, {D('min(period_end)', 'first_period_end')}, {D('max(period_end)', 'last_period_end')}, {R('min(drawdown_severity)', 6, 'target_min')}, {R('max(drawdown_severity)', 6, 'target_max')}, {R('avg(drawdown_severity)', 6, 'target_mean')} FROM (SELECT *, CASE WHEN fiscal_year <= 1997 THEN 'train' WHEN fiscal_year <= 1999 THEN 'val' ELSE 'test' END AS split_name FROM risk) GROUP BY 1"))
def _(t):
    return rounded(P.split_summary(_splits(t)))


# --- valuation ---------------------------------------------------------------------------------------------------

_COMPANY = {"company": """
    SELECT i.ticker, i.fiscal_year, i.period_end, i.basic_shares_outstanding, i.diluted_shares_outstanding, i.revenue, i.ebitda,
           CASE WHEN s.debt_current IS NULL AND s.long_term_debt_and_capital_lease_obligations IS NULL THEN NULL
                ELSE coalesce(s.debt_current, 0) + coalesce(s.long_term_debt_and_capital_lease_obligations, 0) END AS total_debt,
           s.cash_and_equivalents, coalesce(s.total_equity, s.total_equity_attributable_to_parent) AS total_equity
    FROM inc i LEFT JOIN bs s ON s.ticker = i.ticker AND s.fiscal_year = i.fiscal_year
    UNION ALL SELECT 'N' || n_nationkey, CAST(2000 AS INTEGER), DATE '2000-12-31', 10.0, 12.0, 100.0, 10.0, 1.0, 2.0, 3.0 FROM nation""",
    "priced": "SELECT c.*, b.date AS anchor_trade_date, b.close AS anchor_close, c.period_end - b.date AS anchor_lag_days FROM company c ASOF LEFT JOIN bars b ON c.ticker = b.ticker AND c.period_end >= b.date",
    "shared": """SELECT *, CASE WHEN diluted_shares_outstanding > 0 THEN diluted_shares_outstanding WHEN basic_shares_outstanding > 0 THEN basic_shares_outstanding END AS shares_target,
        CASE WHEN diluted_shares_outstanding > 0 THEN 'diluted_shares_outstanding' WHEN basic_shares_outstanding > 0 THEN 'basic_shares_outstanding' END AS shares_target_source FROM priced""",
    "capped": "SELECT *, CASE WHEN anchor_close > 0 AND basic_shares_outstanding > 0 THEN anchor_close * basic_shares_outstanding END AS market_cap_basic_target, CASE WHEN anchor_close > 0 AND diluted_shares_outstanding > 0 THEN anchor_close * diluted_shares_outstanding END AS market_cap_diluted_target, CASE WHEN anchor_close > 0 THEN anchor_close * shares_target END AS market_cap_target FROM shared",
    "valued": "SELECT *, market_cap_target + total_debt - cash_and_equivalents AS enterprise_value_target FROM capped",
    "coded": """SELECT *, CASE WHEN enterprise_value_target IS NOT NULL THEN greatest(enterprise_value_target, 0) END AS enterprise_value_target_clipped,
        concat_ws('|', CASE WHEN anchor_close IS NULL OR anchor_close <= 0 THEN 'missing_market_price' END, CASE WHEN anchor_lag_days > 10 THEN 'stale_anchor_price' END,
                       CASE WHEN shares_target IS NULL THEN 'missing_share_count' END,
                       CASE WHEN anchor_close > 0 AND shares_target IS NOT NULL AND coalesce(market_cap_target, 0) <= 0 THEN 'invalid_market_cap' END) AS valuation_target_issue_codes FROM valued""",
}


def _company(t):
    """Income-driven company-years with balance amounts, and the tickers without bars."""
    from ledgerline.functions.scalars import first_present, sum_present

    bs = t.statement("bs").select("ticker", "fiscal_year", sum_present("debt_current", "long_term_debt_and_capital_lease_obligations").alias("total_debt"),
                                  "cash_and_equivalents", first_present("total_equity", "total_equity_attributable_to_parent").alias("total_equity"))
    inc = t.statement("inc").select("ticker", "fiscal_year", "period_end", "basic_shares_outstanding", "diluted_shares_outstanding", "revenue", "ebitda")
    listed = inc.join(bs, ["ticker", "fiscal_year"], "left")
    unlisted = t.read("nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey")).alias("ticker"), F.lit(2000).alias("fiscal_year"), F.lit("2000-12-31").cast("date").alias("period_end"),
        F.lit(10.0).alias("basic_shares_outstanding"), F.lit(12.0).alias("diluted_shares_outstanding"), F.lit(100.0).alias("revenue"), F.lit(10.0).alias("ebitda"),
        F.lit(1.0).alias("total_debt"), F.lit(2.0).alias("cash_and_equivalents"), F.lit(3.0).alias("total_equity"))
    return listed.unionByName(unlisted)


def _valued(t):
    return V.valuation_dataset(_company(t), t.bars)


def _valuation_query(name: str, columns: list[str], sql_columns: str, digits: int = 4):
    @query(name, with_parts("inc bs bars", f"SELECT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, {sql_columns} FROM coded", _COMPANY))
    def _(t):
        return rounded(_valued(t).select("ticker", "fiscal_year", *columns), digits)


_valuation_query("L1_shares", ["shares_target", "shares_target_source"], f"{R('shares_target', 4)}, shares_target_source")
_valuation_query("L2_market_caps", ["market_cap_basic_target", "market_cap_diluted_target", "market_cap_target"], Rs(["market_cap_basic_target", "market_cap_diluted_target", "market_cap_target"], 2), 2)
_valuation_query("L3_enterprise_value", ["enterprise_value_target", "enterprise_value_target_clipped", "enterprise_value_negative_flag"],
                 Rs(["enterprise_value_target", "enterprise_value_target_clipped"], 2) + ", CAST(coalesce(enterprise_value_target < 0, false) AS BIGINT) AS enterprise_value_negative_flag", 2)
_valuation_query("L4_log_targets", ["log_market_cap_target", "log_enterprise_value_target"],
                 R("CASE WHEN market_cap_target > 0 THEN ln(1 + market_cap_target) END", 6, "log_market_cap_target") + ", " + R("ln(1 + enterprise_value_target_clipped)", 6, "log_enterprise_value_target"), 6)
_valuation_query("L5_multiples", ["price_to_sales_target", "price_to_book_target", "ev_to_ebitda_target"],
                 R("CASE WHEN revenue > 0 THEN market_cap_target / revenue END", 4, "price_to_sales_target") + ", " + R("CASE WHEN total_equity > 0 THEN market_cap_target / total_equity END", 4, "price_to_book_target")
                 + ", " + R("CASE WHEN ebitda > 0 THEN enterprise_value_target_clipped / ebitda END", 4, "ev_to_ebitda_target"))
_STATUS_SQL = """CASE WHEN valuation_target_issue_codes = '' THEN 'ok' ELSE split_part(valuation_target_issue_codes, '|', 1) END AS valuation_target_status,
    valuation_target_issue_codes, valuation_target_issue_codes = '' AS valuation_target_usable, valuation_target_issue_codes = '' AND enterprise_value_target IS NOT NULL AS enterprise_value_target_usable"""
_valuation_query("L6_valuation_status", ["valuation_target_status", "valuation_target_issue_codes", "valuation_target_usable", "enterprise_value_target_usable"], _STATUS_SQL)


@query("L7_valuation_dataset", with_parts("inc bs bars", f"""SELECT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, {D('period_end')}, {D('anchor_trade_date')}, {R('anchor_close', 2)}, CAST(anchor_lag_days AS BIGINT) AS anchor_lag_days,
    {R('shares_target', 2)}, shares_target_source, {R('market_cap_target', 2)}, {R('CASE WHEN market_cap_target > 0 THEN ln(1 + market_cap_target) END', 2, 'log_market_cap_target')},
    {R('enterprise_value_target_clipped', 2)}, {R('ln(1 + enterprise_value_target_clipped)', 2, 'log_enterprise_value_target')}, {_STATUS_SQL} FROM coded""", _COMPANY))
def _(t):
    return rounded(V.narrow_targets(_valued(t)), 2)


@query("E7_valuation_summary", with_parts("inc bs bars", f"""SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, CAST(min(fiscal_year) AS BIGINT) AS first_year, CAST(max(fiscal_year) AS BIGINT) AS last_year,
    count(*) FILTER (u) AS usable_rows, {R('min(market_cap_target) FILTER (u)', 2, 'market_cap_min')}, {R('max(market_cap_target) FILTER (u)', 2, 'market_cap_max')},
    {R('avg(ln(1 + market_cap_target)) FILTER (u)', 4, 'log_market_cap_mean')} FROM (SELECT *, valuation_target_issue_codes = '' AS u FROM coded)""", _COMPANY))
def _(t):
    out = V.valuation_summary(_valued(t))
    return rounded(out.withColumns({"log_market_cap_mean": F.round("log_market_cap_mean", 4), "market_cap_min": F.round("market_cap_min", 2), "market_cap_max": F.round("market_cap_max", 2)}))


@query("L6_status_counts", with_parts("inc bs bars", "SELECT CASE WHEN valuation_target_issue_codes = '' THEN 'ok' ELSE split_part(valuation_target_issue_codes, '|', 1) END AS valuation_target_status, count(*) AS n_rows FROM coded GROUP BY 1", _COMPANY))
def _(t):
    return M.value_counts(_valued(t), "valuation_target_status")


@query("C3_E5_label_status_counts", with_parts("labels_", "SELECT target_status, count(*) AS n_rows FROM labels_ GROUP BY 1"))
def _(t):
    return M.value_counts(L.drawdown_labels(clean_observations(t.observations), t.bars), "target_status")
