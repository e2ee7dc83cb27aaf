"""Company-year ratios, growth and feature frames from the three statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators.cleaning import keep_latest
from ledgerline.operators.joins import merge_new_columns

KEYS = ["ticker", "fiscal_year"]

# Raw statement field -> output name, by statement.
RAW_FIELDS = {
    "inc": {
        "ebitda": "ebitda",
        "gross_profit": "gross_profit_raw",
        "cost_of_revenue": "cost_of_revenue",
        "income_before_income_taxes": "income_before_tax",
        "income_taxes": "income_taxes",
        "selling_general_administrative": "selling_general_administrative",
        "research_development": "research_and_development",
        "interest_income": "interest_income",
        "basic_earnings_per_share": "basic_eps",
        "diluted_earnings_per_share": "diluted_eps",
        "basic_shares_outstanding": "basic_shares_outstanding",
        "diluted_shares_outstanding": "diluted_shares_outstanding",
    },
    "cf": {
        "dividends": "dividends_paid",
        "net_cash_from_investing_activities": "investing_cash_flow",
        "net_cash_from_financing_activities": "financing_cash_flow",
        "long_term_debt_issuances_repayments": "long_term_debt_issuances_repayments",
        "short_term_debt_issuances_repayments": "short_term_debt_issuances_repayments",
        "change_in_cash_and_equivalents": "cash_change",
        "change_in_other_operating_assets_and_liabilities_net": "working_capital_change_cf",
        "sale_of_property_plant_and_equipment": "sale_of_ppe",
    },
    "bs": {
        "accounts_payable": "accounts_payable",
        "inventories": "inventory",
        "property_plant_equipment_net": "ppe_net",
        "goodwill": "goodwill",
        "intangible_assets_net": "intangible_assets",
        "retained_earnings_deficit": "retained_earnings",
        "short_term_investments": "short_term_investments",
        "accrued_and_other_current_liabilities": "accrued_current_liabilities",
        "other_current_assets": "other_current_assets",
        "deferred_revenue_current": "deferred_revenue_current",
        "additional_paid_in_capital": "additional_paid_in_capital",
        "accumulated_other_comprehensive_income": "accumulated_other_comprehensive_income",
        "debt_current": "debt_current_component",
        "long_term_debt_and_capital_lease_obligations": "debt_long_term_component",
    },
}
# Derived ratio -> (numerator, denominator), names as in `expanded_features`.
EXPANDED_RATIOS = {
    "ebitda_margin": ("ebitda", "revenue"),
    "pretax_margin": ("income_before_tax", "revenue"),
    "sga_to_revenue": ("selling_general_administrative", "revenue"),
    "rd_to_revenue": ("research_and_development", "revenue"),
    "tax_rate": ("income_taxes", "income_before_tax"),
    "depreciation_to_revenue": ("depreciation_and_amortization", "revenue"),
    "dividends_to_cfo": ("abs_dividends", "abs_cfo"),
    "cfo_to_ebitda": ("cfo", "ebitda"),
    "capex_to_depreciation": ("capex", "depreciation_and_amortization"),
    "accruals_to_revenue": ("accruals", "revenue"),
    "accounts_payable_to_revenue": ("accounts_payable", "revenue"),
    "inventory_to_revenue": ("inventory", "revenue"),
    "deferred_revenue_to_revenue": ("deferred_revenue_current", "revenue"),
    "ppe_turnover": ("revenue", "ppe_net"),
    "current_debt_share": ("debt_current_component", "total_debt"),
    "revenue_per_share": ("revenue", "diluted_shares_outstanding"),
    "gross_profit_per_share": ("gross_profit_raw", "diluted_shares_outstanding"),
    "ebitda_per_share": ("ebitda", "diluted_shares_outstanding"),
    "cfo_per_share": ("cfo", "diluted_shares_outstanding"),
    "book_value_per_share": ("total_equity", "diluted_shares_outstanding"),
}
PRESENCE_FLAGS = [
    "research_and_development",
    "inventory",
    "goodwill",
    "intangible_assets",
    "short_term_investments",
    "deferred_revenue_current",
]
# Growth column -> source amount.
GROWTH = {
    "revenue_yoy": "revenue",
    "gross_profit_yoy": "gross_profit_raw",
    "ebitda_yoy": "ebitda",
    "operating_income_yoy": "operating_income",
    "net_income_yoy": "net_income",
    "cfo_yoy": "cfo",
    "capex_yoy": "capex",
    "dividends_yoy": "dividends_paid",
    "total_debt_yoy": "total_debt",
    "total_equity_yoy": "total_equity",
}
BASE_RATIOS = [
    "current_ratio", "quick_ratio", "working_capital_to_assets", "debt_to_equity", "liabilities_to_assets",
    "interest_coverage", "net_debt", "gross_margin", "operating_margin", "net_margin", "roa", "roe",
    "fcf_margin", "cfo_to_net_income", "capex_to_revenue",
]
BASE_AMOUNTS = [
    "revenue", "net_income", "operating_income", "total_assets", "total_liabilities", "total_equity",
    "cash_and_equivalents", "total_debt", "cfo", "capex", "fcf",
]
EXPANDED_RAW = [*RAW_FIELDS["inc"].values(), "depreciation_and_amortization", *RAW_FIELDS["cf"].values(),
                *RAW_FIELDS["bs"].values()]
# Family of a derived column where the statement alone does not tell it.
RATIO_FAMILY = {
    "margin": ["ebitda_margin", "pretax_margin", "sga_to_revenue", "rd_to_revenue", "tax_rate", "depreciation_to_revenue"],
    "cash_quality": ["dividends_to_cfo", "cfo_to_ebitda", "capex_to_depreciation", "accruals_to_revenue"],
    "working_capital": ["accounts_payable_to_revenue", "inventory_to_revenue", "deferred_revenue_to_revenue"],
    "efficiency": ["ppe_turnover"],
    "capital_structure": ["current_debt_share"],
    "per_share": ["revenue_per_share", "gross_profit_per_share", "ebitda_per_share", "cfo_per_share",
                  "book_value_per_share"],
}
SHARE_COLUMNS = ("basic_eps", "diluted_eps", "basic_shares_outstanding", "diluted_shares_outstanding")


def index_by_year(statements: DataFrame, position: str = "position") -> DataFrame:
    """One row per (ticker, fiscal year): the last in document order; rows without a readable year are dropped."""
    typed = statements.withColumn("fiscal_year", S.parse_year("fiscal_year")).where("fiscal_year IS NOT NULL")
    return keep_latest(typed, KEYS, [position])


def unnest_results(documents: DataFrame) -> DataFrame:
    """Statement documents with a `results` array to one row per entry, with its position."""
    return documents.select("ticker", F.posexplode("results").alias("position", "row")).select("ticker", "position", "row.*")


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    rest = [c for c in df.columns if c not in KEYS]
    return df.select(*KEYS, *[F.col(c).alias(f"{prefix}_{c}") for c in rest], F.lit(1).alias(f"{prefix}_present"))


def join_statements(bs: DataFrame, inc: DataFrame, cf: DataFrame) -> DataFrame:
    """Balance-driven left join; fields are prefixed bs_, inc_, cf_ and presence flags are 0/1."""
    out = _renamed(bs, "bs").join(_renamed(inc, "inc"), KEYS, "left").join(_renamed(cf, "cf"), KEYS, "left")
    return out.na.fill(0, ["bs_present", "inc_present", "cf_present"])


def join_statements_to_main(main: DataFrame, bs: DataFrame, inc: DataFrame, cf: DataFrame) -> DataFrame:
    """Main-driven left joins; rows without any statement are skipped."""
    out = main.join(_renamed(bs, "bs"), KEYS, "left").join(_renamed(inc, "inc"), KEYS, "left")
    out = out.join(_renamed(cf, "cf"), KEYS, "left").na.fill(0, ["bs_present", "inc_present", "cf_present"])
    return out.where("bs_present + inc_present + cf_present > 0")


def _common_amounts() -> dict[str, Column]:
    cfo = S.first_present("cf_net_cash_from_operating_activities", "cf_cash_from_operating_activities_continuing_operations")
    return {
        "revenue": F.col("inc_revenue"),
        "net_income": S.first_present("inc_consolidated_net_income_loss", "inc_net_income"),
        "operating_income": F.col("inc_operating_income"),
        "total_equity": S.first_present("bs_total_equity", "bs_total_equity_attributable_to_parent"),
        "total_debt": S.sum_present("bs_debt_current", "bs_long_term_debt_and_capital_lease_obligations"),
        "cfo": cfo,
        "capex": S.capex_magnitude("cf_purchase_of_property_plant_and_equipment"),
    }


def base_features(joined: DataFrame) -> DataFrame:
    """15 ratios and 11 amounts for `join_statements` rows."""
    d = joined.withColumns(_common_amounts()).withColumns(
        {
            "total_assets": F.col("bs_total_assets"),
            "total_liabilities": F.col("bs_total_liabilities"),
            "cash_and_equivalents": F.col("bs_cash_and_equivalents"),
            "fcf": F.col("cfo") - F.col("capex"),
        }
    )
    ratio = S.safe_div
    ratios = {
        "current_ratio": ratio("bs_total_current_assets", "bs_total_current_liabilities"),
        "quick_ratio": ratio(F.col("cash_and_equivalents") + F.col("bs_receivables"), "bs_total_current_liabilities"),
        "working_capital_to_assets": ratio(
            F.col("bs_total_current_assets") - F.col("bs_total_current_liabilities"), "total_assets"
        ),
        "debt_to_equity": ratio("total_debt", "total_equity"),
        "liabilities_to_assets": ratio("total_liabilities", "total_assets"),
        "interest_coverage": S.div_nonzero("operating_income", F.abs("inc_interest_expense")),
        "net_debt": F.col("total_debt") - F.col("cash_and_equivalents"),
        "gross_margin": ratio("inc_gross_profit", "revenue"),
        "operating_margin": ratio("operating_income", "revenue"),
        "net_margin": ratio("net_income", "revenue"),
        "roa": ratio("net_income", "total_assets"),
        "roe": ratio("net_income", "total_equity"),
        "fcf_margin": ratio("fcf", "revenue"),
        "cfo_to_net_income": ratio("cfo", "net_income"),
        "capex_to_revenue": ratio("capex", "revenue"),
    }
    return d.select(
        *KEYS,
        S.first_present("bs_period_end", "inc_period_end", "cf_period_end").alias("period_end"),
        S.first_present("bs_cik", "inc_cik", "cf_cik").alias("cik"),
        F.lit("annual").alias("timeframe"),
        F.col("inc_present").alias("has_income_statement"),
        F.col("cf_present").alias("has_cash_flow"),
        *[ratios[r].alias(r) for r in BASE_RATIOS],
        *BASE_AMOUNTS,
    )


def company_years(bs: DataFrame, inc: DataFrame, cf: DataFrame, min_years: int = 1) -> DataFrame:
    """Base table of tickers with at least `min_years` balance years."""
    years = bs.groupBy("ticker").agg(F.count("*").alias("_years")).where(F.col("_years") >= min_years)
    return base_features(join_statements(bs, inc, cf)).join(years.select("ticker"), "ticker", "left_semi")


def expanded_features(joined: DataFrame) -> DataFrame:
    """35 raw fields, 20 ratios, 6 presence flags and the amounts growth needs."""
    raw = {out: F.col(f"{kind}_{src}") for kind, fields in RAW_FIELDS.items() for src, out in fields.items()}
    raw["depreciation_and_amortization"] = S.first_present(
        "inc_depreciation_depletion_amortization", "cf_depreciation_depletion_and_amortization"
    )
    helpers = _common_amounts()
    kept = ["period_end"] if "period_end" in joined.columns else []
    d = joined.select(*KEYS, *kept, *[c.alias(n) for n, c in {**raw, **helpers}.items()]).withColumns(
        {
            "abs_dividends": F.abs("dividends_paid"),
            "abs_cfo": F.abs("cfo"),
            "accruals": F.col("net_income") - F.col("cfo"),
        }
    )
    return d.select(
        *KEYS,
        *kept,
        *EXPANDED_RAW,
        *[S.safe_div(n, m).alias(name) for name, (n, m) in EXPANDED_RATIOS.items()],
        *[S.present_flag(c).alias(f"has_{c}") for c in PRESENCE_FLAGS],
        *[c for c in helpers],
    )


def add_growth(frame: DataFrame) -> DataFrame:
    """Growth over the ticker's previous row, which need not be the previous year.

    The frame has one row per (ticker, fiscal year), so a ticker's window holds its years.
    """
    w = W.partitionBy("ticker").orderBy("fiscal_year")
    return frame.withColumns({out: S.signed_growth(src, F.lag(src).over(w)) for out, src in GROWTH.items()})


def feature_frame(main: DataFrame, bs: DataFrame, inc: DataFrame, cf: DataFrame) -> DataFrame:
    """Expanded features with growth for the main table's keys, helper amounts dropped."""
    joined = join_statements_to_main(main.select(*KEYS), bs, inc, cf)
    grown = add_growth(expanded_features(joined))
    helpers = [c for c in ("revenue", "net_income", "operating_income", "total_equity", "total_debt", "cfo", "capex")]
    return grown.drop(*helpers)


def extraction_audit(main: DataFrame, bs: DataFrame, inc: DataFrame, cf: DataFrame) -> DataFrame:
    """Requested tickers, matched rows and tickers missing each statement, in one row."""
    matched = join_statements_to_main(main.select(*KEYS), bs, inc, cf).groupBy("ticker").agg(F.count("*").alias("matched"))
    out = main.select("ticker").distinct().join(matched, "ticker", "left")
    for name, frame in (("balance", bs), ("income", inc), ("cash", cf)):
        have = frame.select("ticker").distinct().withColumn(f"_{name}", F.lit(1))
        out = out.join(have, "ticker", "left")
    return out.agg(
        F.count("*").alias("requested_tickers"),
        F.coalesce(F.sum("matched"), F.lit(0)).cast("long").alias("matched_feature_rows"),
        *[F.count_if(F.col(f"_{n}").isNull()).alias(f"missing_{n}") for n in ("balance", "income", "cash")],
    )


def matched_keys(main: DataFrame, features: DataFrame) -> DataFrame:
    return main.join(features.select(*KEYS), KEYS, "left_semi").agg(F.count("*").alias("matched_rows"))


def enrich(main: DataFrame, bs: DataFrame, inc: DataFrame, cf: DataFrame) -> DataFrame:
    return merge_new_columns(main, feature_frame(main, bs, inc, cf), KEYS)


def identity_base(liabilities: str, equity: str) -> Column:
    """max(liabilities + equity, 0), a missing side counts as 0."""
    return F.greatest(S.zero_filled(liabilities) + S.zero_filled(equity), F.lit(0.0))


def feature_catalogue() -> list[tuple[str, str, str, str]]:
    """(feature, family, source, description) of every expanded column."""
    source = {"inc": "income_statement", "cf": "cash_flow", "bs": "balance_sheet"}
    family = {"inc": "raw_income", "cf": "raw_cashflow", "bs": "raw_balance"}
    rows = []
    for kind, fields in RAW_FIELDS.items():
        for src, out in fields.items():
            fam = "per_share" if out in SHARE_COLUMNS else family[kind]
            rows.append((out, fam, source[kind], f"Reported {src.replace('_', ' ')}."))
    rows.append(("depreciation_and_amortization", "raw_income", "income_or_cashflow",
                 "Depreciation and amortization from the income statement, else the cash flow statement."))
    for fam, names in RATIO_FAMILY.items():
        for name in names:
            num, den = EXPANDED_RATIOS[name]
            rows.append((name, fam, "derived", f"{num} over {den}"))
    for name, src in GROWTH.items():
        rows.append((name, "growth", "derived_growth", f"Growth of {src} over the previous row."))
    for name in PRESENCE_FLAGS:
        rows.append((f"has_{name}", "missingness", "derived_flag", f"1 when {name} is reported."))
    return rows
