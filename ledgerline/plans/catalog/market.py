"""Queries over bars: as-of joins, rolling features and ordered windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import joins as J
from ledgerline.operators import market as X
from ledgerline.operators import metrics as M
from ledgerline.operators import ordering as G
from ledgerline.operators.cleaning import keep_latest
from ledgerline.operators.prep import cumulative_share
from ledgerline.operators.targets import anchor_prices
from ledgerline.plans.catalog import query
from ledgerline.plans.catalog.ctes import FEATURE_SQL, with_parts
from ledgerline.plans.catalog.shared import D, R, Rs, d, r, rounded
from ledgerline.sources.files import daily_bars


@query("D1_asof_backward", with_parts("obs bars", f"SELECT o.ticker, {D('o.period_end', 'period_end')}, {D('b.date', 'anchor_trade_date')}, b.close AS anchor_close FROM obs o ASOF LEFT JOIN bars b ON o.ticker = b.ticker AND o.period_end >= b.date"))
def _(t):
    out = J.asof_backward(t.observations, t.bars.withColumnRenamed("close", "anchor_close"), ["ticker"], "period_end", "date", ["anchor_close"], "anchor_trade_date")
    return rounded(out.select("ticker", "period_end", "anchor_trade_date", "anchor_close"))


@query("D2_asof_staleness", with_parts("obs bars", f"SELECT o.ticker, {D('o.period_end', 'period_end')}, CAST(o.period_end - b.date AS BIGINT) AS anchor_lag_days, coalesce(o.period_end - b.date > 10, false) AS stale FROM obs o ASOF LEFT JOIN bars b ON o.ticker = b.ticker AND o.period_end >= b.date"))
def _(t):
    out = anchor_prices(t.observations, t.bars)
    return rounded(out.select("ticker", "period_end", "anchor_lag_days", F.coalesce(F.col("anchor_lag_days") > 10, F.lit(False)).alias("stale")))


@query("F1_log_return", with_parts("daily", f"SELECT ticker, {D('date')}, {R('log_return')} FROM daily"))
def _(t):
    return rounded(X.daily_inputs(t.bars).select("ticker", "date", "log_return"))


def _feature(name: str, number: int):
    digits = 4 if "volume" in name or "transactions" in name else 6

    @query(f"F{number}_{name}", with_parts("feats", f"SELECT ticker, {D('date')}, {R(name, digits)} FROM feats"))
    def _(t):
        return rounded(X.market_features(t.bars).select("ticker", "date", name), digits)


for _i, _name in enumerate(FEATURE_SQL, 2):
    _feature(_name, _i)


@query("F9_feature_panel", with_parts("feats", f"SELECT ticker, {D('date')}, {Rs(FEATURE_SQL, 5)} FROM feats"))
def _(t):
    return rounded(X.market_features(t.bars).drop("close"), 5)


@query("F10_asof_features", with_parts("obs_feats", f"SELECT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, {D('period_end')}, timeframe, {D('anchor_trade_date')}, {Rs(FEATURE_SQL, 5)} FROM obs_feats"))
def _(t):
    return rounded(X.attach_market_features(t.observations, t.bars), 5)


@query("F11_running_drawdown", with_parts("bars", f"SELECT ticker, {D('date')}, max(close) OVER w AS running_peak, {R('close / greatest(max(close) OVER w, 1e-12) - 1', 6, 'drawdown')} FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)"))
def _(t):
    return rounded(X.running_drawdown(t.bars, ["ticker"]).select("ticker", "date", "running_peak", "drawdown"))


@query("F12_previous_row", with_parts("bars", f"SELECT ticker, {D('date')}, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS previous_close FROM bars"))
def _(t):
    return t.bars.select("ticker", d("date"), F.lag("close").over(X.by_day()).alias("previous_close"))


@query("F13_rank_in_group", with_parts("bs", "SELECT ticker, y AS fiscal_year, row_number() OVER (PARTITION BY ticker ORDER BY a DESC, y) AS position FROM (SELECT CAST(fiscal_year AS BIGINT) AS y, ticker, round(total_assets, 2) AS a FROM bs)"))
def _(t):
    # The years of one company.
    bs = t.statement("bs").select("fiscal_year", "ticker", F.round("total_assets", 2).alias("a"))
    return rounded(M.small_rank(bs, ["ticker"], [F.desc("a"), F.col("fiscal_year")], "position").select("ticker", "fiscal_year", "position"))


@query("F14_average_ranks", f"SELECT o_orderkey, {R('rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0', 1, 'avg_rank')} FROM (SELECT o_orderkey, round(o_totalprice / 1000, 0) AS v FROM orders)")
def _(t):
    o = t.read("orders").select("o_orderkey", F.round(F.col("o_totalprice") / 1000, 0).alias("v"))
    return G.with_average_ranks(o, {"v": "avg_rank"}).select("o_orderkey", r("avg_rank", 1))


@query("F15_ecdf", f"SELECT DISTINCT v, {R('cume_dist() OVER (ORDER BY v)', 8, 'cdf')}, count(*) OVER (PARTITION BY v) AS n FROM (SELECT o_orderkey, round(o_totalprice / 1000, 0) AS v FROM orders)")
def _(t):
    o = t.read("orders").select(F.round(F.col("o_totalprice") / 1000, 0).alias("v"))
    return G.with_cdf(o, "v").select("v", "n", r("cdf", 8))


@query("F16_cumulative_share", f"SELECT CAST(y AS BIGINT) AS y, {R('share', 6)}, {R('sum(share) OVER (ORDER BY y)', 6, 'share_cumulative')} FROM (SELECT year(o_orderdate) AS y, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1)")
def _(t):
    o = t.read("orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y")).agg(F.count("*").alias("n"))
    share = o.select("y", (F.col("n") / o.agg(F.sum("n")).scalar()).alias("share"))
    return rounded(cumulative_share(share, "y", "share"))


def _daily_lines(t):
    """Events as lines of one CSV file per day; the days' headers differ in names and order."""
    e = t.day_events.withColumn("day", F.to_date("ts"))
    even = F.dayofmonth("day") % 2 == 0
    v = F.col("value").cast("string")
    line = F.when(even, F.concat_ws(",", "event_type", v, v, v, F.lit("7"), F.lit("1"))).otherwise(F.concat_ws(",", F.lit("1"), F.lit("7"), v, "event_type", v, v))
    rows = e.select("day", line.alias("value"), F.col("event_id").cast("long").alias("at_line"))
    header = F.when(even, F.lit("ticker,close,high,low,volume,transactions")).otherwise(F.lit("N,Volume,C,Symbol,H,L"))
    heads = e.select("day", header.alias("value"), F.lit(-1).cast("long").alias("at_line")).distinct()
    name = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(".csv"))
    return rows.unionByName(heads).select(name.alias("path"), name.alias("name"), F.lit(0).cast("long").alias("at_block"), "at_line", "value")


@query("A1_daily_files", f"SELECT upper(trim(event_type)) AS ticker, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, {R('arg_max(value, event_id)', 6, 'close')}, {R('arg_max(value, event_id)', 6, 'high')}, CAST(7 AS DOUBLE) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def _(t):
    bars = daily_bars(_daily_lines(t)).na.drop(subset=["ticker", "date", "close"])
    latest = keep_latest(bars, ["ticker", "date"], ["path", "at_block", "at_line"])
    return rounded(latest.select("ticker", "date", "close", "high", "volume"))
