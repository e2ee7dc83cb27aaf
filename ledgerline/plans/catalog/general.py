"""Queries over scalars, cleaning, filters, plain aggregates and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import cleaning as C
from ledgerline.operators import market as X
from ledgerline.operators import metrics as M
from ledgerline.operators.prep import feature_profile
from ledgerline.plans.catalog import query
from ledgerline.plans.catalog.ctes import with_parts
from ledgerline.plans.catalog.shared import D, R, Rs, d, r, rounded
from ledgerline.sources.bar_table import needed_months
from ledgerline.sources.files import ticker_list
from ledgerline.sources.sinks import head_export

NORM = "CASE WHEN upper(trim({0})) IN ('', 'NAN', 'NONE', '<NA>', 'NULL') THEN NULL ELSE upper(trim({0})) END"


@query("A8_dataset_columns", """SELECT o_orderkey AS order_id, o_totalprice AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def _(t):
    from ledgerline.operators.cleaning import resolve_columns

    wanted = {"order_id": ["id", "O_ORDERKEY"], "amount": ["O_TotalPrice"], "day": ["o_orderdate"], "note": ["comment"]}
    found = resolve_columns(t.read("orders"), wanted, optional=("note",))
    return found.select("order_id", "amount", d(F.to_date("day"), "day"))


@query("A10_ticker_list", "SELECT DISTINCT upper(x) AS ticker FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part) WHERE upper(x) NOT IN ('', 'NAN', 'NONE', '<NA>', 'NULL')")
def _(t):
    lines = t.read("part").select(F.col("p_partkey").alias("position"), F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(" # note")).alias("value"))
    return ticker_list(lines).select("ticker")


@query("A11_union_sources", "SELECT 'current' AS source_dataset, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supply', s_suppkey, s_acctbal FROM supplier")
def _(t):
    return C.union_sources({
        "current": t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")),
        "supply": t.read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")),
    })


@query("A15_head_export", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def _(t):
    return head_export(t.read("orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])


@query("B1_normalize_ticker", with_parts("named_obs", "SELECT o_orderkey, ticker FROM named_obs"))
def _(t):
    return t.raw_observations.select("o_orderkey", S.normalize_ticker("ticker").alias("ticker"))


@query("B2_normalize_keys", with_parts("named_obs", "SELECT o_orderkey, ticker AS k_ticker, CAST(fiscal_year AS BIGINT) AS k_year, trim(timeframe) AS k_text FROM named_obs"))
def _(t):
    o = t.raw_observations.withColumn("y", F.concat(F.col("fiscal_year"), F.lit(".0")))
    return o.select("o_orderkey", S.normalize_key("ticker", "ticker").alias("k_ticker"), S.normalize_key("y", "year").cast("bigint").alias("k_year"),
                    S.normalize_key("timeframe", "text").alias("k_text"))


@query("B3_to_number", """SELECT event_id, CASE WHEN event_type IN ('error', 'view', 'signup') THEN NULL ELSE value END AS number FROM events""")
def _(t):
    text = (F.when(F.col("event_type") == "error", F.lit("n/a")).when(F.col("event_type") == "view", F.lit("NaN"))
            .when(F.col("event_type") == "signup", F.lit("-Infinity")).otherwise(F.col("value").cast("string")))
    return t.day_events.select("event_id", S.to_number(text).alias("number"))


@query("B4_safe_division", f"""SELECT l_orderkey, l_linenumber,
    {R("CASE WHEN abs(l_discount * 1e-11) > 1e-12 THEN l_tax / (l_discount * 1e-11) END", 4, "tolerant")},
    {R("CASE WHEN l_discount <> 0 THEN l_tax / l_discount END", 6, "nonzero")},
    {R("CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END", 6, "finite_only")} FROM lineitem""")
def _(t):
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", r(S.safe_div("l_tax", F.col("l_discount") * 1e-11), 4, "tolerant"),
        r(S.div_nonzero("l_tax", "l_discount"), 6, "nonzero"), r(S.div_finite("l_quantity", "l_tax"), 6, "finite_only"))


@query("B5_signed_growth", f"""SELECT l_orderkey, l_linenumber, {R("(l_extendedprice - p) / greatest(abs(p), 1e-12)", 4, "growth")}
    FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN NULL ELSE 25 - l_quantity + 0.25 END AS p FROM lineitem)""")
def _(t):
    prev = F.when(F.col("l_returnflag") != "R", 25 - F.col("l_quantity") + 0.25)
    return t.read("lineitem").withColumn("p", prev).select("l_orderkey", "l_linenumber", r(S.signed_growth("l_extendedprice", "p"), 4, "growth"))


@query("B6_first_present", with_parts("bs", f"SELECT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, {R('coalesce(total_equity, total_equity_attributable_to_parent)', 2, 'equity')} FROM bs"))
def _(t):
    return rounded(t.statement("bs").select("ticker", "fiscal_year", S.first_present("total_equity", "total_equity_attributable_to_parent").alias("equity")), 2)


@query("B7_trade_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS trade_date FROM events")
def _(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    text = (F.when(F.col("event_type") == "view", F.floor(us / 1000000).cast("string")).when(F.col("event_type") == "purchase", F.floor(us / 1000).cast("string"))
            .when(F.col("event_type") == "error", us.cast("string")).when(F.col("event_type") == "signup", F.concat(us.cast("string"), F.lit("000")))
            .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return t.day_events.select("event_id", d(S.trade_date(text), "trade_date"))


@query("B8_parse_date", with_parts("articles", f"SELECT arrival, {D('try_cast(substr(published_utc, 1, 10) AS DATE)', 'published')} FROM articles"))
def _(t):
    return t.articles.select("arrival", d(S.parse_date("published_utc"), "published"))


@query("B9_parse_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders")
def _(t):
    text = F.when(F.col("o_orderstatus") == "F", F.lit("n/a")).otherwise(F.concat(F.year("o_orderdate"), F.lit(".0")))
    return t.read("orders").select("o_orderkey", S.parse_year(text, F.to_date("o_orderdate")).cast("bigint").alias("y"))


@query("B10_day_arithmetic", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + 365, '%Y-%m-%d') AS horizon_end, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS BIGINT) AS lag FROM orders")
def _(t):
    day = F.to_date("o_orderdate")
    return t.read("orders").select("o_orderkey", d(F.date_add(day, 365), "horizon_end"), S.lag_days(F.lit("2001-12-31").cast("date"), day).cast("bigint").alias("lag"))


@query("B11_log_scale", f"SELECT c_custkey, {R('ln(1 + greatest(c_acctbal, 0))', 6, 'l')}, {R('exp(ln(1 + greatest(c_acctbal, 0))) - 1', 4, 'back')} FROM customer")
def _(t):
    return t.read("customer").select("c_custkey", r(S.log1p_floor("c_acctbal"), 6, "l"), r(S.expm1(S.log1p_floor("c_acctbal")), 4, "back"))


@query("B12_clip", "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN greatest(c_acctbal, 0) END AS floor0, CASE WHEN c_mktsegment <> 'BUILDING' THEN least(greatest(c_acctbal / 10000, 0), 1) END AS unit FROM customer")
def _(t):
    v = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal"))
    return t.read("customer").select("c_custkey", S.clip(v, low=0.0).alias("floor0"), S.clip(v / 10000, 0.0, 1.0).alias("unit"))


@query("B13_zero_fill", with_parts("bs", f"SELECT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, {R('coalesce(goodwill, 0)', 2, 'goodwill')}, {R('coalesce(debt_current, 0)', 2, 'debt_current')} FROM bs"))
def _(t):
    return rounded(t.statement("bs").select("ticker", "fiscal_year", S.zero_filled("goodwill").alias("goodwill"), S.zero_filled("debt_current").alias("debt_current")), 2)


@query("B15_presence_flags", with_parts("bs", "SELECT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, CAST(goodwill IS NOT NULL AS BIGINT) AS has_goodwill, CAST(inventories IS NOT NULL AS BIGINT) AS has_inventory FROM bs"))
def _(t):
    return rounded(t.statement("bs").select("ticker", "fiscal_year", S.present_flag("goodwill").alias("has_goodwill"), S.present_flag("inventories").alias("has_inventory")))


@query("B16_safe_names", "SELECT p_partkey, replace(p_brand || '/' || p_type, '/', '__SLASH__') AS path_part, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def _(t):
    return t.read("part").select("p_partkey", S.path_safe_ticker(F.concat_ws("/", "p_brand", "p_type")).alias("path_part"), S.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@query("B18_half_even", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, greatest(1, CAST(round_even(count(*) * 0.25, 0) AS BIGINT)) AS k FROM orders GROUP BY 1")
def _(t):
    return t.read("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("k", S.fraction_rows("n", 0.25))


@query("B21_year_bounds", "SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y, strftime(make_date(CAST(year(o_orderdate) AS INTEGER), 1, 1), '%Y-%m-%d') AS first_day, strftime(make_date(CAST(year(o_orderdate) AS INTEGER), 12, 31), '%Y-%m-%d') AS last_day, year(o_orderdate) BETWEEN 1996 AND 2000 AS in_range, o_orderstatus = 'F' AS iso_ok, o_orderstatus FROM orders")
def _(t):
    y = F.year("o_orderdate")
    text = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return t.read("orders").select(y.cast("bigint").alias("y"), d(S.year_first_day(y), "first_day"), d(S.year_last_day(y), "last_day"),
                                   S.valid_year(y, 1996, 2000).alias("in_range"), S.valid_iso_date(text).alias("iso_ok"), "o_orderstatus").distinct()


@query("B22_target_scale", f"SELECT c_custkey, {R('ln(1 + greatest(coalesce(v, 0), 0))', 6, 'log_target')}, {R('coalesce(v, 0)', 2, 'raw_target')} FROM (SELECT *, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS v FROM customer)")
def _(t):
    c = t.read("customer").withColumn("v", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")))
    return c.select("c_custkey", r(S.target_on_model_scale("v", True), 6, "log_target"), r(S.target_on_model_scale("v", False), 2, "raw_target"))


@query("B23_capex", with_parts("cf", f"SELECT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, {R('abs(purchase_of_property_plant_and_equipment)', 2, 'capex')} FROM cf"))
def _(t):
    return rounded(t.statement("cf").select("ticker", "fiscal_year", S.capex_magnitude("purchase_of_property_plant_and_equipment").alias("capex")), 2)


@query("C1_timeframe", with_parts("raw_obs", "SELECT o_orderkey, source FROM raw_obs WHERE lower(trim(timeframe)) = 'annual'"))
def _(t):
    return C.keep_timeframe(t.raw_observations).select("o_orderkey", "source")


@query("C2_missing_keys", with_parts("named_obs", "SELECT o_orderkey FROM named_obs WHERE ticker IS NOT NULL AND period_end IS NOT NULL"))
def _(t):
    return C.drop_missing_keys(t.raw_observations.withColumn("ticker", S.normalize_ticker("ticker")), ["ticker", "period_end"]).select("o_orderkey")


@query("C3_keep_last", with_parts("clean_obs", f"SELECT o_orderkey, ticker, {D('period_end')}, CAST(fiscal_year AS BIGINT) AS fiscal_year, source FROM clean_obs"))
def _(t):
    return rounded(C.clean_observations(t.raw_observations, order=("fiscal_year", "o_orderkey")).select("o_orderkey", "ticker", "period_end", "fiscal_year", "source"))


@query("C5_requested_only", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def _(t):
    wanted = t.read("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return C.only_requested(t.read("lineitem"), wanted, "l_suppkey").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("C6_first_tickers", with_parts("bars", "SELECT ticker, count(*) AS n FROM bars WHERE ticker IN (SELECT DISTINCT ticker FROM bars ORDER BY 1 LIMIT 25) GROUP BY 1"))
def _(t):
    return C.first_tickers(t.bars, 25).groupBy("ticker").agg(F.count("*").alias("n"))


@query("C7_without_held_out", with_parts("pred", "SELECT row_id FROM pred WHERE fiscal_year NOT IN (SELECT max(fiscal_year) FROM pred) AND ticker NOT IN (SELECT ticker FROM pred GROUP BY 1 HAVING count(*) > 12)"))
def _(t):
    p = t.predictions
    kept = C.without(p, p.agg(F.max("fiscal_year").alias("fiscal_year")), ["fiscal_year"])
    return C.without(kept, p.groupBy("ticker").count().where("count > 12"), ["ticker"]).select("row_id")


@query("C8_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return C.duplicate_keys(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("C9_cleaning_audit", with_parts("named_obs", """SELECT count(*) AS rows_read, count(*) FILTER (tf) AS rows_after_filter, count(*) FILTER (tf AND NOT ok) AS rows_dropped_invalid,
    count(*) FILTER (tf AND ok) - count(DISTINCT CASE WHEN tf AND ok THEN ticker || '@' || period_end END) AS rows_deduplicated, count(DISTINCT CASE WHEN tf AND ok THEN ticker || '@' || period_end END) AS rows_kept
    FROM (SELECT *, lower(trim(timeframe)) = 'annual' AS tf, ticker IS NOT NULL AND period_end IS NOT NULL AS ok FROM named_obs)"""))
def _(t):
    return C.cleaning_audit(t.raw_observations)


@query("C10_entity_period_dedup", with_parts("named_obs", "SELECT o_orderkey FROM named_obs QUALIFY row_number() OVER (PARTITION BY ticker, period_end ORDER BY fiscal_year DESC, o_orderkey DESC) = 1"))
def _(t):
    named = t.raw_observations.withColumn("ticker", S.normalize_ticker("ticker"))
    return C.deduplicate_entity_period(named, ["fiscal_year", "o_orderkey"])[0].select("o_orderkey")


@query("C10_entity_period_audit", with_parts("named_obs", "SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, count(*) FILTER (n > 1) AS duplicate_keys, CAST(sum(n) - count(*) AS BIGINT) AS rows_dropped FROM (SELECT count(*) AS n FROM named_obs GROUP BY ticker, period_end)"))
def _(t):
    return C.deduplicate_entity_period(t.raw_observations.withColumn("ticker", S.normalize_ticker("ticker")), ["fiscal_year", "o_orderkey"])[1]


@query("C11_prediction_rows", with_parts("pred", f"SELECT row_id, {Rs(['y_true', 'model_a', 'model_b'])} FROM pred WHERE split = 'val'"))
def _(t):
    return rounded(C.prediction_rows(t.predictions, "val", ["model_a", "model_b"], ["row_id"]).select("row_id", "y_true", "model_a", "model_b"))


@query("C14_latest_years", "SELECT o_orderkey FROM (SELECT o_orderkey, y, dense_rank() OVER (PARTITION BY o_custkey ORDER BY y DESC NULLS LAST) AS dr FROM (SELECT *, CASE WHEN o_totalprice > 20000 THEN year(o_orderdate) END AS y FROM orders)) WHERE dr <= 3 OR y IS NULL")
def _(t):
    o = t.read("orders").select("o_orderkey", "o_custkey", F.when(F.col("o_totalprice") > 20000, F.year("o_orderdate")).alias("y"))
    return C.latest_years(o, 3, "o_custkey", "y").select("o_orderkey")


@query("E1_ticker_windows", with_parts("named_obs", f"SELECT ticker, count(*) AS n_observations, count(DISTINCT source) AS n_sources, {D('min(period_end)', 'first_period_end')}, {D('max(period_end)', 'last_period_end')} FROM named_obs WHERE ticker IS NOT NULL GROUP BY 1"))
def _(t):
    named = t.raw_observations.withColumn("ticker", S.normalize_ticker("ticker")).where("ticker IS NOT NULL")
    return rounded(X.ticker_windows(named, "source"))


@query("E2_fetch_window", with_parts("obs", f"SELECT {D('min(period_end)', 'fetch_start')}, {D('max(period_end) + 372', 'fetch_end')} FROM obs"))
def _(t):
    return rounded(X.coverage_window(t.observations))


@query("E2_needed_months", with_parts("obs", "SELECT DISTINCT strftime(m, '%Y-%m') AS bar_month FROM (SELECT unnest(generate_series(date_trunc('month', period_end - 190), CAST(period_end + 372 AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM obs)"))
def _(t):
    return needed_months(t.observations, 190, 372)


_COVER = ["goodwill", "debt_current", "inventories", "cash_and_equivalents", "total_assets"]


@query("E3_coverage", with_parts("bs", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS non_null_rows, {R(f'count({c}) / count(*)', 6, 'coverage')} FROM bs" for c in _COVER)))
def _(t):
    return rounded(M.coverage_table(t.statement("bs"), _COVER))


@query("E4_recommended", with_parts("bs", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS non_null_rows, {R(f'count({c}) / count(*)', 6, 'coverage')} FROM bs HAVING count({c}) >= 0.5 * count(*)" for c in _COVER[:4])))
def _(t):
    return rounded(M.recommended_features(M.coverage_table(t.statement("bs"), _COVER), _COVER[:4]))


@query("E5_value_counts", with_parts("inc", "SELECT coalesce(s, 'missing') AS share_source, count(*) AS n_rows FROM (SELECT CASE WHEN diluted_shares_outstanding > 0 THEN 'diluted' WHEN basic_shares_outstanding > 0 THEN 'basic' END AS s FROM inc) GROUP BY 1"))
def _(t):
    s = F.when(F.col("diluted_shares_outstanding") > 0, F.lit("diluted")).when(F.col("basic_shares_outstanding") > 0, F.lit("basic"))
    return M.value_counts(t.statement("inc").withColumn("share_source", s), "share_source")


@query("E6_distinct_counts", "SELECT count(DISTINCT l_suppkey) AS tickers, count(DISTINCT l_orderkey) AS orders, count(DISTINCT CAST(l_shipdate AS DATE)) AS days FROM lineitem")
def _(t):
    return t.read("lineitem").agg(F.count_distinct("l_suppkey").alias("tickers"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct(F.to_date("l_shipdate")).alias("days"))


_PROFILE = ["goodwill", "debt_current", "inventories", "flat"]


@query("E8_feature_profile", with_parts("bs", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS non_null_rows, {R(f'1 - count({c}) / count(*)', 6, 'missing_rate')}, count(DISTINCT {c}) AS nunique_non_null, count({c}) >= 2 AND count(DISTINCT {c}) > 1 AS selected FROM bsr" for c in _PROFILE),
    {"bsr": "SELECT " + ", ".join(f"round({c}, 0) AS {c}" for c in _PROFILE[:3]) + ", 1.0 AS flat FROM bs"}))
def _(t):
    bs = t.statement("bs").select(*[F.round(c, 0).alias(c) for c in _PROFILE[:3]], F.lit(1.0).alias("flat"))
    return rounded(feature_profile(bs, _PROFILE))


@query("G1_sorted_output", "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def _(t):
    return t.read("orders").orderBy("o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", d(F.to_date("o_orderdate"), "day"))


@query("H1_union_all", "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def _(t):
    c = t.read("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(t.read("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("H2_wide_to_long", with_parts("bs", " UNION ALL ".join(f"SELECT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, '{c}' AS metric, {R(c, 2, 'value')} FROM bs" for c in _COVER)))
def _(t):
    return rounded(t.statement("bs").unpivot(["ticker", "fiscal_year"], _COVER, "metric", "value"), 2)
