"""Queries over statements, ratios, growth and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import fundamentals as K
from ledgerline.operators import joins as J
from ledgerline.operators import metrics as M
from ledgerline.plans import valuation as V
from ledgerline.plans.catalog import query
from ledgerline.plans.catalog.ctes import with_parts
from ledgerline.plans.catalog.shared import D, R, Rs, rounded

KEYS_SQL = "ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year"


def _three(t):
    return t.statement("bs"), t.statement("inc"), t.statement("cf")


def _documents(t):
    """Balance documents: one row per ticker with the list of its years, some years twice, some unreadable."""
    bs = t.statement("bs").select("ticker", F.col("fiscal_year").alias("y"), "period_end", "total_assets", "total_liabilities")
    label = F.when(F.col("total_liabilities") > F.col("total_assets") * 0.436, F.lit("n/a")).otherwise(F.concat("y", F.lit(".0")))
    entry = lambda rank, year, amount: F.struct(F.col("y"), F.lit(rank).alias("rank"), year.alias("fiscal_year"), F.col("period_end"), amount.alias("total_assets"))
    first = entry(0, F.concat("y", F.lit(".0")), F.col("total_assets") * 2)
    second = entry(1, label, F.col("total_assets"))
    return bs.select("ticker", F.explode(F.array(first, second)).alias("e")).groupBy("ticker").agg(F.array_sort(F.collect_list("e")).alias("results"))


_DOC_SQL = {"doc": """SELECT ticker, fiscal_year AS y, 0 AS rank, period_end, total_assets * 2 AS total_assets, true AS readable FROM bs
    UNION ALL SELECT ticker, fiscal_year, 1, period_end, total_assets, NOT (total_liabilities > total_assets * 0.436) FROM bs"""}


@query("A6_unnest_statements", with_parts("bs", f"SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY y, rank) - 1 AS position, CASE WHEN readable THEN y || '.0' ELSE 'n/a' END AS fiscal_year, {R('total_assets', 2)} FROM doc", _DOC_SQL))
def _(t):
    return rounded(K.unnest_results(_documents(t)).select("ticker", "position", "fiscal_year", "total_assets"), 2)


@query("K1_index_by_year", with_parts("bs", f"SELECT ticker, CAST(y AS BIGINT) AS fiscal_year, {R('total_assets', 2)} FROM doc WHERE readable QUALIFY row_number() OVER (PARTITION BY ticker, y ORDER BY rank DESC) = 1", _DOC_SQL))
def _(t):
    rows = K.unnest_results(_documents(t)).select("ticker", "position", "fiscal_year", "total_assets")
    return rounded(K.index_by_year(rows).select("ticker", "fiscal_year", "total_assets"), 2)


def _sd(n: str, m: str) -> str:
    return f"CASE WHEN abs({m}) > 1e-12 THEN ({n}) / ({m}) END"


_JOINED = """SELECT b.ticker, b.fiscal_year, b.period_end, b.cik, CAST(i.ticker IS NOT NULL AS BIGINT) AS has_income_statement, CAST(c.ticker IS NOT NULL AS BIGINT) AS has_cash_flow,
    b.total_current_assets AS ca, b.total_current_liabilities AS cl, b.total_assets, b.total_liabilities, coalesce(b.total_equity, b.total_equity_attributable_to_parent) AS total_equity,
    b.cash_and_equivalents, b.receivables, CASE WHEN b.debt_current IS NULL AND b.long_term_debt_and_capital_lease_obligations IS NULL THEN NULL ELSE coalesce(b.debt_current, 0) + coalesce(b.long_term_debt_and_capital_lease_obligations, 0) END AS total_debt,
    i.revenue, i.gross_profit, i.operating_income, coalesce(i.consolidated_net_income_loss, i.net_income) AS net_income, i.interest_expense,
    coalesce(c.net_cash_from_operating_activities, c.cash_from_operating_activities_continuing_operations) AS cfo, abs(c.purchase_of_property_plant_and_equipment) AS capex,
    coalesce(c.net_cash_from_operating_activities, c.cash_from_operating_activities_continuing_operations) - abs(c.purchase_of_property_plant_and_equipment) AS fcf
    FROM bs b LEFT JOIN inc i ON i.ticker = b.ticker AND i.fiscal_year = b.fiscal_year LEFT JOIN cf c ON c.ticker = b.ticker AND c.fiscal_year = b.fiscal_year"""
_RATIO_SQL = {
    "current_ratio": _sd("ca", "cl"), "quick_ratio": _sd("cash_and_equivalents + receivables", "cl"),
    "working_capital_to_assets": _sd("ca - cl", "total_assets"), "debt_to_equity": _sd("total_debt", "total_equity"),
    "liabilities_to_assets": _sd("total_liabilities", "total_assets"), "interest_coverage": "operating_income / nullif(abs(interest_expense), 0)",
    "net_debt": "total_debt - cash_and_equivalents", "gross_margin": _sd("gross_profit", "revenue"), "operating_margin": _sd("operating_income", "revenue"),
    "net_margin": _sd("net_income", "revenue"), "roa": _sd("net_income", "total_assets"), "roe": _sd("net_income", "total_equity"),
    "fcf_margin": _sd("fcf", "revenue"), "cfo_to_net_income": _sd("cfo", "net_income"), "capex_to_revenue": _sd("capex", "revenue"),
}


@query("D7_statement_join", with_parts("bs inc cf", f"SELECT {KEYS_SQL}, has_income_statement, has_cash_flow, {Rs(['total_assets', 'revenue', 'cfo'], 2)} FROM joined", {"joined": _JOINED}))
def _(t):
    j = K.join_statements(*_three(t))
    return rounded(K.base_features(j).select("ticker", "fiscal_year", "has_income_statement", "has_cash_flow", "total_assets", "revenue", "cfo"), 2)


@query("K2_base_ratios", with_parts("bs inc cf", f"SELECT {KEYS_SQL}, {', '.join(R(e, 4, n) for n, e in _RATIO_SQL.items())}, {', '.join(R(n, 2, n) for n in K.BASE_AMOUNTS)} FROM joined", {"joined": _JOINED}))
def _(t):
    out = K.base_features(K.join_statements(*_three(t)))
    return rounded(out.select("ticker", "fiscal_year", *K.BASE_RATIOS, *[F.round(c, 2).alias(c) for c in K.BASE_AMOUNTS]), 4)


@query("K3_company_years", with_parts("bs inc cf", f"SELECT {KEYS_SQL}, {D('period_end')}, cik, 'annual' AS timeframe, has_income_statement, has_cash_flow, {R(_RATIO_SQL['roa'], 4, 'roa')} FROM joined WHERE ticker IN (SELECT ticker FROM bs GROUP BY 1 HAVING count(*) >= 6)", {"joined": _JOINED}))
def _(t):
    return rounded(K.company_years(*_three(t), min_years=6).select("ticker", "fiscal_year", "period_end", "cik", "timeframe", "has_income_statement", "has_cash_flow", "roa"), 4)


_RAW_SQL = ", ".join(f"{kind[0]}.{src} AS {out}" for kind, fields in K.RAW_FIELDS.items() for src, out in fields.items())
_WIDE = f"""SELECT m.ticker, m.fiscal_year, {_RAW_SQL}, coalesce(i.depreciation_depletion_amortization, c.depreciation_depletion_and_amortization) AS depreciation_and_amortization,
    i.revenue, coalesce(i.consolidated_net_income_loss, i.net_income) AS net_income, i.operating_income, coalesce(b.total_equity, b.total_equity_attributable_to_parent) AS total_equity,
    CASE WHEN b.debt_current IS NULL AND b.long_term_debt_and_capital_lease_obligations IS NULL THEN NULL ELSE coalesce(b.debt_current, 0) + coalesce(b.long_term_debt_and_capital_lease_obligations, 0) END AS total_debt,
    coalesce(c.net_cash_from_operating_activities, c.cash_from_operating_activities_continuing_operations) AS cfo, abs(c.purchase_of_property_plant_and_equipment) AS capex,
    abs(c.dividends) AS abs_dividends, abs(coalesce(c.net_cash_from_operating_activities, c.cash_from_operating_activities_continuing_operations)) AS abs_cfo,
    coalesce(i.consolidated_net_income_loss, i.net_income) - coalesce(c.net_cash_from_operating_activities, c.cash_from_operating_activities_continuing_operations) AS accruals
    FROM base m LEFT JOIN bs b ON b.ticker = m.ticker AND b.fiscal_year = m.fiscal_year LEFT JOIN inc i ON i.ticker = m.ticker AND i.fiscal_year = m.fiscal_year
    LEFT JOIN cf c ON c.ticker = m.ticker AND c.fiscal_year = m.fiscal_year WHERE b.ticker IS NOT NULL OR i.ticker IS NOT NULL OR c.ticker IS NOT NULL"""
_FLAG_SQL = ", ".join(f"CAST({c} IS NOT NULL AS BIGINT) AS has_{c}" for c in K.PRESENCE_FLAGS)
_EXPANDED_SQL = ", ".join(R(c, 2, c) for c in K.EXPANDED_RAW) + ", " + ", ".join(R(_sd(n, m), 4, name) for name, (n, m) in K.EXPANDED_RATIOS.items()) + ", " + _FLAG_SQL


def _expanded_rounded(out):
    return rounded(out.withColumns({c: F.round(c, 2) for c in K.EXPANDED_RAW}), 4)


@query("K4_expanded_features", with_parts("base bs inc cf", f"SELECT {KEYS_SQL}, {_EXPANDED_SQL} FROM wide", {"wide": _WIDE}))
def _(t):
    joined = K.join_statements_to_main(t.companies.select("ticker", "fiscal_year"), *_three(t))
    out = K.expanded_features(joined)
    return _expanded_rounded(out.select("ticker", "fiscal_year", *K.EXPANDED_RAW, *K.EXPANDED_RATIOS, *[f"has_{c}" for c in K.PRESENCE_FLAGS]))


def _growth_sql(digits: int = 4) -> str:
    # A zero previous amount gives a huge but kept value; it is compared on a log scale.
    cell = lambda src: f"({src} - lag({src}) OVER w) / greatest(abs(lag({src}) OVER w), 1e-12)"
    return ", ".join(R(f"CASE WHEN abs({cell(s)}) > 1e6 THEN log10(abs({cell(s)})) ELSE {cell(s)} END", digits, o) for o, s in K.GROWTH.items())


def _growth_cells():
    big = lambda c: F.when(F.abs(c) > 1e6, F.log10(F.abs(c))).otherwise(F.col(c)).alias(c)
    return [big(c) for c in K.GROWTH]


@query("K5_growth", with_parts("base bs inc cf", f"SELECT {KEYS_SQL}, {_growth_sql()} FROM wide WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year)", {"wide": _WIDE}))
def _(t):
    joined = K.join_statements_to_main(t.companies.select("ticker", "fiscal_year"), *_three(t))
    return rounded(K.add_growth(K.expanded_features(joined)).select("ticker", "fiscal_year", *_growth_cells()), 4)


@query("K6_feature_frame", with_parts("base bs inc cf", f"SELECT {KEYS_SQL}, {_EXPANDED_SQL}, {_growth_sql()} FROM wide WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year)", {"wide": _WIDE}))
def _(t):
    out = K.feature_frame(t.companies, *_three(t))
    rest = [c for c in out.columns if c not in K.GROWTH]
    return _expanded_rounded(out.select(*rest, *_growth_cells()))


@query("K6_extraction_audit", with_parts("base bs inc cf", """SELECT (SELECT count(DISTINCT ticker) FROM base) AS requested_tickers, (SELECT count(*) FROM wide) AS matched_feature_rows,
    (SELECT count(DISTINCT ticker) FROM base WHERE ticker NOT IN (SELECT ticker FROM bs)) AS missing_balance, (SELECT count(DISTINCT ticker) FROM base WHERE ticker NOT IN (SELECT ticker FROM inc)) AS missing_income,
    (SELECT count(DISTINCT ticker) FROM base WHERE ticker NOT IN (SELECT ticker FROM cf)) AS missing_cash""", {"wide": _WIDE}))
def _(t):
    return K.extraction_audit(t.companies, *_three(t))


@query("K7_matched_keys", with_parts("base bs inc cf", "SELECT count(*) AS matched_rows FROM base m WHERE EXISTS (SELECT 1 FROM wide w WHERE w.ticker = m.ticker AND w.fiscal_year = m.fiscal_year)", {"wide": _WIDE}))
def _(t):
    return K.matched_keys(t.companies, K.feature_frame(t.companies, *_three(t)))


@query("K8_identity_base", with_parts("bs", f"SELECT {KEYS_SQL}, {R('greatest(coalesce(total_liabilities, 0) + coalesce(total_equity, 0), 0)', 2, 'base')} FROM bs"))
def _(t):
    return rounded(t.statement("bs").select("ticker", "fiscal_year", K.identity_base("total_liabilities", "total_equity").alias("base")), 2)


_ALL_EXPANDED = [c for c, *_ in K.feature_catalogue()]


@query("K9_feature_catalogue", with_parts("base bs inc cf", "SELECT c.feature, c.family, c.source, v.non_null_rows, " + R("v.coverage", 6, "coverage") + " FROM (VALUES " + ", ".join(f"('{f}', '{fam}', '{src}')" for f, fam, src, _ in K.feature_catalogue()) + ") c(feature, family, source) LEFT JOIN cover v ON v.feature = c.feature",
    {"wide": _WIDE, "full_": "SELECT *, " + ", ".join(f"{_sd(n, m)} AS {name}" for name, (n, m) in K.EXPANDED_RATIOS.items()) + ", " + _FLAG_SQL + ", " + ", ".join(f"{s} - lag({s}) OVER w AS {o}" for o, s in K.GROWTH.items()) + " FROM wide WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year)",
     "cover": " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS non_null_rows, count({c}) / count(*) AS coverage FROM full_" for c in _ALL_EXPANDED)}))
def _(t):
    frame = K.feature_frame(t.companies, *_three(t))
    catalogue = t.spark.createDataFrame(K.feature_catalogue(), "feature string, family string, source string, description string")
    return rounded(catalogue.join(M.coverage_table(frame, _ALL_EXPANDED), "feature", "left").drop("description"))


@query("D4_merge_new_columns", with_parts("base bs", f"SELECT m.ticker, CAST(m.fiscal_year AS BIGINT) AS fiscal_year, {R('m.revenue', 2, 'revenue')}, {R('b.total_assets', 2, 'total_assets')}, {R('b.goodwill', 2, 'goodwill')} FROM base m LEFT JOIN bs b ON b.ticker = m.ticker AND b.fiscal_year = m.fiscal_year"))
def _(t):
    extra = t.statement("bs").select("ticker", "fiscal_year", "total_assets", "goodwill", F.lit(-1.0).alias("revenue"))
    return rounded(J.merge_new_columns(t.companies, extra, ["ticker", "fiscal_year"]).select("ticker", "fiscal_year", "revenue", "total_assets", "goodwill"), 2)


@query("D5_merge_fill", with_parts("bs inc", f"SELECT b.ticker, CAST(b.fiscal_year AS BIGINT) AS fiscal_year, {R('coalesce(b.total_equity, i.revenue)', 2, 'total_equity')}, {R('i.ebitda', 2, 'ebitda')} FROM bs b LEFT JOIN inc i ON i.ticker = b.ticker AND i.fiscal_year = b.fiscal_year"))
def _(t):
    main = t.statement("bs").select("ticker", "fiscal_year", "total_equity")
    extra = t.statement("inc").select("ticker", "fiscal_year", F.col("revenue").alias("total_equity"), "ebitda")
    return rounded(J.merge_fill(main, extra, ["ticker", "fiscal_year"]), 2)


@query("D7_company_table", with_parts("base bs inc cf", f"SELECT j.ticker, CAST(j.fiscal_year AS BIGINT) AS fiscal_year, {R('j.revenue', 2, 'revenue')}, {R('w.ebitda', 2, 'ebitda')}, {R(_sd('w.income_taxes', 'w.income_before_tax'), 4, 'tax_rate')} FROM joined j JOIN wide w ON w.ticker = j.ticker AND w.fiscal_year = j.fiscal_year", {"joined": _JOINED, "wide": _WIDE}))
def _(t):
    out = V.company_table(*_three(t)).select("ticker", "fiscal_year", F.round("revenue", 2).alias("revenue"), F.round("ebitda", 2).alias("ebitda"), "tax_rate")
    return rounded(out, 4)
