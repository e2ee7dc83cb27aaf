"""Common table expressions of the comparison SQL (DuckDB), by name and with their dependencies."""

from __future__ import annotations

from ledgerline.sources.tables import STATEMENTS

FEATURE_SQL = """
volatility_21d volatility_63d drawdown_126d return_63d avg_dollar_volume_63d avg_transactions_21d high_low_range_21d
""".split()

PARTS: dict[str, tuple[str, str]] = {
    "bars": ("", """
        SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date,
               (max({'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice})).c AS close,
               max(l_extendedprice) AS high, min(l_extendedprice) AS low, sum(l_quantity) AS volume,
               CAST(count(*) AS DOUBLE) AS transactions
        FROM lineitem GROUP BY 1, 2"""),
    "obs": ("bars", """
        SELECT ticker, fiscal_year, make_date(fiscal_year, 12, 31) AS period_end, 'annual' AS timeframe FROM (
            SELECT DISTINCT ticker, CAST(year(date) AS INTEGER) AS fiscal_year FROM bars
            UNION ALL SELECT 'N' || n_nationkey, CAST(y AS INTEGER) FROM nation, range(1995, 2002) r(y))"""),
    "raw_obs": ("", """
        SELECT o_orderkey,
               CASE WHEN o_orderpriority = '1-URGENT' THEN '  c' || o_custkey || ' '
                    WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'nan' ELSE 'C' || o_custkey END AS ticker,
               CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
               CASE WHEN o_totalprice > 5000 THEN CAST(o_orderdate AS DATE) END AS period_end,
               CASE WHEN o_orderstatus = 'P' THEN ' Annual' ELSE 'annual' END AS timeframe, o_totalprice,
               CASE WHEN o_orderpriority = '2-HIGH' THEN 'quarterly_feed' ELSE 'main' END AS source
        FROM orders"""),
    "named_obs": ("raw_obs", """
        SELECT * REPLACE (CASE WHEN upper(trim(ticker)) IN ('', 'NAN', 'NONE', '<NA>', 'NULL') THEN NULL
                               ELSE upper(trim(ticker)) END AS ticker) FROM raw_obs"""),
    "clean_obs": ("named_obs", """
        SELECT * FROM named_obs WHERE lower(trim(timeframe)) = 'annual' AND ticker IS NOT NULL AND period_end IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY ticker, period_end
                                   ORDER BY fiscal_year DESC, o_orderkey DESC, timeframe DESC, o_totalprice DESC, source DESC) = 1"""),
    "daily": ("bars", """
        SELECT *, CASE WHEN close > 0 THEN ln(close) END
                  - lag(CASE WHEN close > 0 THEN ln(close) END) OVER (PARTITION BY ticker ORDER BY date) AS log_return,
               close * volume AS dollar_volume, (high - low) / nullif(close, 0) AS day_range FROM bars"""),
    "feats": ("daily", """
        SELECT ticker, date, close,
               CASE WHEN count(log_return) OVER w21 = 21 THEN stddev_samp(log_return) OVER w21 END * sqrt(252.0) AS volatility_21d,
               CASE WHEN count(log_return) OVER w63 = 63 THEN stddev_samp(log_return) OVER w63 END * sqrt(252.0) AS volatility_63d,
               close / nullif(CASE WHEN count(close) OVER w126 = 126 THEN max(close) OVER w126 END, 0) - 1 AS drawdown_126d,
               close / nullif(lag(close, 63) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS return_63d,
               CASE WHEN count(dollar_volume) OVER w63 = 63 THEN avg(dollar_volume) OVER w63 END AS avg_dollar_volume_63d,
               CASE WHEN count(transactions) OVER w21 = 21 THEN avg(transactions) OVER w21 END AS avg_transactions_21d,
               CASE WHEN count(day_range) OVER w21 = 21 THEN avg(day_range) OVER w21 END AS high_low_range_21d
        FROM daily
        WINDOW w21 AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING),
               w63 AS (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING),
               w126 AS (PARTITION BY ticker ORDER BY date ROWS 125 PRECEDING)"""),
    "obs_feats": ("obs feats", f"""
        SELECT o.*, f.date AS anchor_trade_date, {', '.join('f.' + c for c in FEATURE_SQL)}
        FROM obs o ASOF LEFT JOIN feats f ON o.ticker = f.ticker AND o.period_end >= f.date"""),
    "path": ("obs bars", """
        SELECT o.ticker, o.period_end, b.date, b.close,
               max(b.close) OVER (PARTITION BY o.ticker, o.period_end ORDER BY b.date) AS running_peak
        FROM obs o JOIN bars b ON b.ticker = o.ticker AND b.date >= o.period_end AND b.date <= o.period_end + 365"""),
    "drawn": ("path", """
        SELECT *, close / greatest(running_peak, 1e-12) - 1 AS drawdown,
               min(date) OVER (PARTITION BY ticker, period_end, running_peak) AS peak_date FROM path"""),
    "mdd": ("drawn", """
        SELECT ticker, period_end, count(*) AS future_bar_count, min(drawdown) AS future_1y_max_drawdown,
               arg_max(close, date) / greatest(arg_min(close, date), 1e-12) - 1 AS future_1y_total_return,
               min(date) AS anchor_trade_date, max(date) AS horizon_last_trade_date,
               (min({'d': drawdown, 't': date, 'c': close, 'p': running_peak, 'pd': peak_date})) AS trough
        FROM drawn GROUP BY 1, 2"""),
    "last_bar": ("bars", "SELECT ticker, max(date) AS last_date FROM bars GROUP BY 1"),
    "labels_": ("obs mdd last_bar", """
        SELECT *, CASE WHEN codes = '' THEN 'ok' WHEN found THEN 'partial_horizon' ELSE codes END AS target_status,
               codes AS target_issue_codes, codes = '' AS target_usable FROM (
        SELECT o.ticker, o.fiscal_year, o.period_end, o.timeframe, o.period_end + 365 AS horizon_end_date,
               m.ticker IS NOT NULL AS found, coalesce(m.future_bar_count, 0) AS future_bar_count,
               m.future_1y_max_drawdown, m.future_1y_total_return, m.anchor_trade_date, m.horizon_last_trade_date,
               m.trough.pd AS mdd_peak_date, m.trough.t AS mdd_trough_date, m.trough.p AS mdd_peak_close, m.trough.c AS mdd_trough_close,
               concat_ws(';',
                 CASE WHEN b.last_date IS NULL THEN 'missing_market_data' END,
                 CASE WHEN b.last_date < o.period_end THEN 'no_forward_bars' END,
                 CASE WHEN b.last_date >= o.period_end AND m.ticker IS NULL THEN 'empty_horizon_window' END,
                 CASE WHEN m.anchor_trade_date > o.period_end + 7 THEN 'anchor_after_period_end' END,
                 CASE WHEN m.horizon_last_trade_date < o.period_end + 365 - 7 THEN 'insufficient_horizon_coverage' END,
                 CASE WHEN m.future_bar_count < 30 THEN 'too_few_future_bars' END) AS codes
        FROM obs o LEFT JOIN mdd m ON m.ticker = o.ticker AND m.period_end = o.period_end LEFT JOIN last_bar b ON b.ticker = o.ticker)"""),
    "labelled": ("obs_feats labels_", f"""
        SELECT f.*, l.future_1y_max_drawdown, l.target_status, l.target_usable, l.target_issue_codes, l.future_bar_count,
               greatest(-l.future_1y_max_drawdown, 0) AS drawdown_severity
        FROM obs_feats f JOIN labels_ l ON l.ticker = f.ticker AND l.period_end = f.period_end"""),
    "risk": ("labelled", "SELECT * FROM labelled WHERE target_usable AND future_1y_max_drawdown IS NOT NULL AND lower(timeframe) = 'annual'"),
    "base": ("", """
        SELECT *, 'S' || l_suppkey AS ticker, make_date(fiscal_year, 12, 31) AS period_end, 'CIK' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS cik FROM (
        SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, count(*) AS n_lines,
               sum(l_extendedprice * (1 - l_discount) / 1.371713) AS revenue, sum(l_extendedprice * (0.55 + l_tax) / 1.371713) AS cost,
               sum(l_extendedprice * l_tax / 1.371713) AS tax, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 1.371713 ELSE 0 END) AS returned,
               sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS return_lines,
               sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open_lines,
               sum(CAST(round(l_quantity) AS BIGINT)) AS qty, sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc_pts,
               sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax_pts
        FROM lineitem GROUP BY 1, 2) JOIN (SELECT s_suppkey, s_acctbal / 1.371713 AS acctbal FROM supplier) ON l_suppkey = s_suppkey"""),
    "articles": ("", """
        SELECT doc_id AS arrival, 'S' || (doc_id % 100) AS dir_ticker, CASE WHEN lang <> 'fr' THEN 'D' || doc_id END AS id,
               'http://news.example/' || n_chars AS article_url,
               CASE WHEN source <> 'src13' THEN strftime(make_date(CAST(1995 + doc_id % 7 AS INTEGER), CAST(n_chars % 12 + 1 AS INTEGER), CAST(n_chars % 28 + 1 AS INTEGER)), '%Y-%m-%d')
                    || 'T0' || (n_chars % 10) || ':00:00Z' END AS published_utc,
               text AS title, CASE WHEN source <> 'src7' THEN text END AS description,
               CASE WHEN source = 'src1' THEN ['ELSEWHERE'] WHEN source = 'src2' THEN [] ELSE [lower('S' || (doc_id % 100)), 'OTHER', 'S' || (doc_id % 100)] END AS tickers
        FROM documents"""),
    "pred": ("", """
        SELECT row_id, ticker, fiscal_year, period_end, segment, amount, y_true,
               CASE WHEN fiscal_year >= 2000 THEN 'val' ELSE 'train' END AS split,
               0.75 * y_true + 0.30 * u_a AS model_a, floor((0.60 * y_true + 0.10 + 0.45 * u_b * u_b) * 200) / 200 AS model_b,
               round(avg(y_true) OVER (PARTITION BY segment), 6) AS baseline
        FROM (SELECT o_orderkey AS row_id, 'C' || o_custkey AS ticker, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
                     CAST(o_orderdate AS DATE) AS period_end, o_orderpriority AS segment, o_totalprice AS amount, o_totalprice / 510007.0 AS y_true,
                     CAST(CAST('0x' || substr(md5(o_orderkey || 'a'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u_a,
                     CAST(CAST('0x' || substr(md5(o_orderkey || 'b'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u_b
              FROM orders)"""),
    "plong": ("pred", """
        SELECT row_id, ticker, fiscal_year, split, segment, y_true, m.model, m.y_pred FROM (
            SELECT *, unnest([{'model': 'model_a', 'y_pred': model_a}, {'model': 'model_b', 'y_pred': model_b}, {'model': 'baseline', 'y_pred': baseline}]) AS m FROM pred)"""),
}
for _kind, (_fields, _present) in STATEMENTS.items():
    _cells = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _fields.items())
    PARTS[_kind] = ("base", f"SELECT ticker, fiscal_year, period_end, cik, {_cells} FROM base WHERE {_present}")


def with_parts(needed: str, body: str, extra: dict[str, str] | None = None) -> str:
    """`WITH` clause holding the named parts, their dependencies and `extra` parts in order, then the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dependency in PARTS[name][0].split():
            visit(dependency)
        order.append(name)

    for name in needed.split():
        visit(name)
    clauses = [f"{n} AS ({PARTS[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return f"WITH {', '.join(clauses)} {body}" if clauses else body
