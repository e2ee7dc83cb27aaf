"""Company tables derived from the star-schema test tables, as lazy DataFrames.

Every derivation reads whole tables. Missing statements and missing fields follow from the values of a
company-year itself (its average discount, tax or quantity in exact integer points), so gaps occur without
dropping any input row.

`bars`, `observations` and `company_base` stand for stored tables that most plans read several times; they are
persisted (memory and disk), so the raw tables are scanned and shuffled once, and a lost executor's blocks are computed
again from the files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Statement fields over a company-year base row; plain arithmetic that any SQL dialect reads alike.
BALANCE_FIELDS = {
    "total_current_assets": "revenue * 0.30",
    "total_current_liabilities": "CASE WHEN open_lines > 0 THEN cost * 0.25 END",
    "total_assets": "revenue * 0.80 + acctbal",
    "total_liabilities": "revenue * 0.35",
    "total_equity": "CASE WHEN disc_pts * 100 <= n_lines * 505 THEN revenue * 0.45 + acctbal END",
    "total_equity_attributable_to_parent": "revenue * 0.44",
    "cash_and_equivalents": "CASE WHEN tax_pts * 100 <= n_lines * 420 THEN 5000 + acctbal END",
    "receivables": "CASE WHEN return_lines > 0 THEN returned * 0.10 END",
    "debt_current": "CASE WHEN disc_pts * 100 <= n_lines * 510 THEN tax * 0.50 END",
    "long_term_debt_and_capital_lease_obligations": "CASE WHEN tax_pts * 100 >= n_lines * 390 THEN tax * 1.50 END",
    "accounts_payable": "cost * 0.05",
    "inventories": "CASE WHEN qty * 100 <= n_lines * 2560 THEN cost * 0.08 END",
    "property_plant_equipment_net": "revenue * 0.22",
    "goodwill": "CASE WHEN disc_pts * 100 > n_lines * 500 THEN revenue * 0.03 END",
    "intangible_assets_net": "CASE WHEN tax_pts * 100 > n_lines * 400 THEN revenue * 0.02 END",
    "retained_earnings_deficit": "acctbal - tax",
    "short_term_investments": "CASE WHEN qty * 100 > n_lines * 2540 THEN acctbal * 2 END",
    "accrued_and_other_current_liabilities": "cost * 0.02",
    "other_current_assets": "revenue * 0.01",
    "deferred_revenue_current": "CASE WHEN open_lines * 2 > n_lines THEN revenue * 0.015 END",
    "additional_paid_in_capital": "revenue * 0.11",
    "accumulated_other_comprehensive_income": "tax - acctbal",
}
INCOME_FIELDS = {
    "revenue": "revenue",
    "gross_profit": "revenue - cost",
    "cost_of_revenue": "cost",
    "operating_income": "revenue - cost - returned * 0.05",
    "consolidated_net_income_loss": "CASE WHEN disc_pts * 100 <= n_lines * 515 THEN revenue - cost - tax END",
    "net_income": "revenue - cost - tax * 1.1",
    "interest_expense": "CASE WHEN tax_pts * 100 <= n_lines * 410 THEN -tax * 0.1 END",
    "ebitda": "revenue - cost * 0.9 - returned * 0.2",
    "income_before_income_taxes": "revenue - cost - returned * 0.06",
    "income_taxes": "tax",
    "selling_general_administrative": "cost * 0.12",
    "research_development": "CASE WHEN disc_pts * 100 > n_lines * 495 THEN cost * 0.07 END",
    "interest_income": "acctbal * 0.02",
    "depreciation_depletion_amortization": "CASE WHEN qty * 100 > n_lines * 2550 THEN revenue * 0.04 END",
    "basic_earnings_per_share": "(revenue - cost) / 100000",
    "diluted_earnings_per_share": "(revenue - cost) / 110000",
    "basic_shares_outstanding": "CASE WHEN qty * 100 > n_lines * 2450 THEN 100.0 * n_lines END",
    "diluted_shares_outstanding": "CASE WHEN tax_pts * 100 > n_lines * 395 THEN 110.0 * n_lines END",
}
CASHFLOW_FIELDS = {
    "net_cash_from_operating_activities": "CASE WHEN qty * 100 <= n_lines * 2580 THEN revenue - cost * 0.95 END",
    "cash_from_operating_activities_continuing_operations": "revenue - cost * 0.97",
    "purchase_of_property_plant_and_equipment": "CASE WHEN tax_pts * 100 <= n_lines * 430 THEN -revenue * 0.06 END",
    "dividends": "CASE WHEN disc_pts * 100 > n_lines * 520 THEN 0.0 ELSE -tax * 0.2 END",
    "depreciation_depletion_and_amortization": "revenue * 0.041",
    "net_cash_from_investing_activities": "-revenue * 0.07",
    "net_cash_from_financing_activities": "tax - acctbal",
    "long_term_debt_issuances_repayments": "tax * 0.3",
    "short_term_debt_issuances_repayments": "-tax * 0.1",
    "change_in_cash_and_equivalents": "acctbal * 0.1",
    "change_in_other_operating_assets_and_liabilities_net": "-cost * 0.01",
    "sale_of_property_plant_and_equipment": "CASE WHEN return_lines * 3 > n_lines THEN revenue * 0.005 END",
}
STATEMENTS = {
    "bs": (BALANCE_FIELDS, "disc_pts * 100 <= n_lines * 535"),
    "inc": (INCOME_FIELDS, "tax_pts * 100 >= n_lines * 365"),
    "cf": (CASHFLOW_FIELDS, "qty * 100 <= n_lines * 2690"),
}

# Demonstration lexicon of frequent words in the synthetic prose.
DEMO_POSITIVE = ("the", "and", "that", "with", "la", "der")
DEMO_NEGATIVE = ("of", "for", "is", "was", "que", "die")


class Tables:
    """The test tables below `root` and the company tables derived from them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def bars(self) -> DataFrame:
        """One bar per (ticker, date). Partial aggregation folds all lines of a day before the shuffle, so a
        ticker holds at most one row per calendar day, however many input lines it has."""
        lines = self.read("lineitem").select(
            "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"
        )
        return (
            lines.groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
            .agg(
                F.max(F.struct("l_orderkey", "l_linenumber", "l_extendedprice"))["l_extendedprice"].alias("close"),
                F.max("l_extendedprice").alias("high"),
                F.min("l_extendedprice").alias("low"),
                F.sum("l_quantity").alias("volume"),
                F.count("*").cast("double").alias("transactions"),
            )
            .select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), "date", "close", "high", "low", "volume", "transactions")
            .persist()
        )

    @cached_property
    def observations(self) -> DataFrame:
        """Annual observations: year-ends of every ticker's bar years, and tickers that have no bar at all."""
        traded = self.bars.select("ticker", F.year("date").alias("fiscal_year")).distinct()
        unlisted = self.read("nation").select(
            F.concat(F.lit("N"), F.col("n_nationkey")).alias("ticker"),
            F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("fiscal_year"),
        )
        return traded.unionByName(unlisted).select(
            "ticker", "fiscal_year", F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("period_end"),
            F.lit("annual").alias("timeframe"),
        ).persist()

    @cached_property
    def raw_observations(self) -> DataFrame:
        """Untidy observations straight from orders: mixed case, blanks, several rows per key."""
        o = self.read("orders")
        ticker = (
            F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("  c"), F.col("o_custkey"), F.lit(" ")))
            .when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), F.lit("nan"))
            .otherwise(F.concat(F.lit("C"), F.col("o_custkey")))
        )
        return o.select(
            "o_orderkey",
            ticker.alias("ticker"),
            F.year("o_orderdate").alias("fiscal_year"),
            F.when(F.col("o_totalprice") > 5000, F.to_date("o_orderdate")).alias("period_end"),
            F.when(F.col("o_orderstatus") == "P", F.lit(" Annual")).otherwise(F.lit("annual")).alias("timeframe"),
            "o_totalprice",
            F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("quarterly_feed")).otherwise(F.lit("main")).alias("source"),
        )

    @cached_property
    def company_base(self) -> DataFrame:
        """Sums per supplier and ship year, amounts converted at a fixed rate of 1.371713."""
        per_year = (
            self.read("lineitem")
            .groupBy("l_suppkey", F.year("l_shipdate").alias("fiscal_year"))
            .agg(
                F.count("*").alias("n_lines"),
                F.sum(F.expr("l_extendedprice * (1 - l_discount) / 1.371713D")).alias("revenue"),
                F.sum(F.expr("l_extendedprice * (0.55D + l_tax) / 1.371713D")).alias("cost"),
                F.sum(F.expr("l_extendedprice * l_tax / 1.371713D")).alias("tax"),
                F.sum(F.expr("CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 1.371713D ELSE 0.0D END")).alias("returned"),
                F.sum(F.expr("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END")).alias("return_lines"),
                F.sum(F.expr("CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END")).alias("open_lines"),
                F.sum(F.expr("CAST(round(l_quantity) AS BIGINT)")).alias("qty"),
                F.sum(F.expr("CAST(round(l_discount * 100) AS BIGINT)")).alias("disc_pts"),
                F.sum(F.expr("CAST(round(l_tax * 100) AS BIGINT)")).alias("tax_pts"),
            )
        )
        supplier = self.read("supplier").select("s_suppkey", (F.col("s_acctbal") / 1.371713).alias("acctbal"))
        return per_year.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).withColumns(
            {
                "ticker": F.concat(F.lit("S"), F.col("l_suppkey")),
                "period_end": F.make_date("fiscal_year", F.lit(12), F.lit(31)),
                "cik": F.concat(F.lit("CIK"), F.lpad(F.col("l_suppkey").cast("string"), 10, "0")),
            }
        ).persist()

    def statement(self, kind: str) -> DataFrame:
        fields, present = STATEMENTS[kind]
        return self.company_base.where(present).select(
            "ticker", "fiscal_year", "period_end", "cik",
            *[F.expr(f"CAST({e} AS DOUBLE)").alias(name) for name, e in fields.items()],
        )

    @cached_property
    def companies(self) -> DataFrame:
        """Company-years to enrich: every (ticker, year) with sales, whether or not statements exist."""
        return self.company_base.select(
            "ticker", "fiscal_year", "period_end", "cik", F.lit("annual").alias("timeframe"),
            F.col("revenue").alias("revenue"),
        )

    @cached_property
    def articles(self) -> DataFrame:
        """News articles from documents, one directory ticker each, in arrival order `arrival`."""
        d = self.read("documents")
        year = F.lit(1995) + F.pmod(F.col("doc_id"), F.lit(7))
        ticker = F.concat(F.lit("S"), F.pmod(F.col("doc_id"), F.lit(100)))
        published = F.concat(
            F.date_format(F.make_date(year.cast("int"), F.pmod("n_chars", F.lit(12)).cast("int") + 1,
                                      F.pmod("n_chars", F.lit(28)).cast("int") + 1), "yyyy-MM-dd"),
            F.lit("T0"), F.pmod("n_chars", F.lit(10)).cast("string"), F.lit(":00:00Z"),
        )
        return d.select(
            F.col("doc_id").alias("arrival"),
            ticker.alias("dir_ticker"),
            F.when(F.col("lang") != "fr", F.concat(F.lit("D"), F.col("doc_id"))).alias("id"),
            F.concat(F.lit("http://news.example/"), F.col("n_chars")).alias("article_url"),
            F.when(F.col("source") != "src13", published).alias("published_utc"),
            F.col("text").alias("title"),
            F.when(F.col("source") != "src7", F.col("text")).alias("description"),
            F.when(F.col("source") == "src1", F.array(F.lit("ELSEWHERE")))
            .when(F.col("source") == "src2", F.array().cast("array<string>"))
            .otherwise(F.array(F.lower(ticker), F.lit("OTHER"), ticker))
            .alias("tickers"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Severity predictions of two models and a baseline, one row per order; `model_b` has many ties."""
        o = self.read("orders")
        noise = lambda salt: (
            F.conv(F.substring(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(salt))), 1, 8), 16, 10)
            .cast("double") / F.lit(4294967296.0)
        )
        base = (
            o.select(
                F.col("o_orderkey").alias("row_id"),
                F.concat(F.lit("C"), F.col("o_custkey")).alias("ticker"),
                F.year("o_orderdate").alias("fiscal_year"),
                F.to_date("o_orderdate").alias("period_end"),
                F.col("o_orderpriority").alias("segment"),
                F.col("o_totalprice").alias("amount"),
                (F.col("o_totalprice") / 510007.0).alias("y_true"),
                noise("a").alias("u_a"),
                noise("b").alias("u_b"),
            )
            .withColumns(
                {
                    "split": F.when(F.col("fiscal_year") >= 2000, F.lit("val")).otherwise(F.lit("train")),
                    "model_a": F.expr("0.75 * y_true + 0.30 * u_a"),
                    "model_b": F.expr("floor((0.60 * y_true + 0.10 + 0.45 * u_b * u_b) * 200) / 200"),
                }
            )
        )
        # One mean per order priority, five rows by the table's definition.
        mean = base.groupBy("segment").agg(F.round(F.avg("y_true"), 6).alias("baseline"))
        return base.join(F.broadcast(mean), "segment").drop("u_a", "u_b")

    @cached_property
    def day_events(self) -> DataFrame:
        return self.read("events").select("event_id", "ts", "user_id", "event_type", "value")
