"""Queries over metrics, significance tests, drift and streams' batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import drift as E
from ledgerline.operators import joins as J
from ledgerline.operators import metrics as M
from ledgerline.operators import ordering as G
from ledgerline.operators import significance as Q
from ledgerline.operators.cleaning import seeded_sample
from ledgerline.plans.catalog import query
from ledgerline.plans.catalog.ctes import with_parts
from ledgerline.plans.catalog.shared import R, Rs, d, r, rounded
from ledgerline.streaming.feeds import day_bars

MODELS = ["model_a", "model_b", "baseline"]
PAIRS = [("model_a", "model_b"), ("model_a", "baseline"), ("model_b", "baseline")]


def _aligned(t):
    return t.predictions.select("row_id", "ticker", "fiscal_year", "split", "segment", "y_true", *MODELS)


def _long(t):
    return M.melt_models(_aligned(t), MODELS, ["row_id", "ticker", "fiscal_year", "split", "segment"])


def _money(t):
    """The same predictions on a money scale."""
    return t.predictions.withColumns({c: F.col(c) * 500000 for c in ["y_true", *MODELS]})


_MONEY = {"ml": "SELECT row_id, ticker, fiscal_year, model, y_true * 500000 AS y_true, y_pred * 500000 AS y_pred FROM plong"}
_LN = "(ln(1 + greatest(y_pred, 0)) - ln(1 + greatest(y_true, 0)))"


# --- alignment -----------------------------------------------------------------------------------------------------

def _frames(t):
    p = t.predictions
    frame = lambda m: p.select("row_id", "y_true", F.col(m).alias("y_pred"), F.col("baseline").alias("y_pred_baseline"))
    a = frame("model_a").withColumn("y_pred", F.when(F.col("y_true") > 0.01, F.col("y_pred")))
    return {"model_a": a, "model_b": frame("model_b").where("y_true < 0.95")}


@query("D8_align_predictions", with_parts("pred", f"SELECT row_id, {Rs(['y_true', 'model_a', 'model_b', 'baseline'])} FROM pred WHERE y_true > 0.01 AND y_true < 0.95"))
def _(t):
    return rounded(J.align_predictions(_frames(t), ["row_id"], baseline_from="model_a"))


@query("D10_target_agreement", with_parts("pred", f"SELECT row_id, {R('y_true', 6, 'y_true')}, {R('y_true + 0.001', 6, 'y_true_other')} FROM pred WHERE segment = '5-LOW'"))
def _(t):
    a = t.predictions.select("row_id", "y_true", "segment")
    b = a.select("row_id", F.when(F.col("segment") == "5-LOW", F.col("y_true") + 0.001).otherwise(F.col("y_true") + 1e-10).alias("y_true"))
    return rounded(J.disagreeing_targets(a, b, ["row_id"], 1e-8))


# --- metrics -------------------------------------------------------------------------------------------------------

_E = "(y_pred - y_true)"
_RISK_SQL = {
    "rmse": f"sqrt(avg({_E} * {_E}))", "mae": f"avg(abs{_E})", "r2": f"1 - sum({_E} * {_E}) / (var_pop(y_true) * count(*))",
    "pearson": "CASE WHEN stddev_pop(y_pred) > 1e-12 THEN corr(y_true, y_pred) END",
}
_MONEY_SQL = {
    "rmse_raw": f"sqrt(avg({_E} * {_E}))", "rmse_log": f"sqrt(avg({_LN} * {_LN}))", "mape_raw": f"avg(abs(greatest(y_pred, 0) - y_true) / greatest(y_true, 1e-8))",
    "mape_nonzero_raw": "avg(abs(greatest(y_pred, 0) - y_true) / greatest(y_true, 1e-8)) FILTER (y_true > 0)",
    "smape_raw": "avg(abs(greatest(y_pred, 0) - y_true) / greatest((abs(y_true) + abs(greatest(y_pred, 0))) / 2, 1e-8))",
    "r2_raw": f"1 - sum({_E} * {_E}) / (var_pop(y_true) * count(*))", "r2_log": f"1 - sum({_LN} * {_LN}) / (var_pop(ln(1 + greatest(y_true, 0))) * count(*))",
}


def _cells(sql: dict, names: list[str], digits: int = 6) -> str:
    return ", ".join(R(sql[n], digits, n) for n in names)


def _metric_query(name: str, metrics: list[str], money: bool, digits: int = 6):
    registry, sql, source = (M.VALUATION_METRICS, _MONEY_SQL, "ml") if money else (M.RISK_METRICS, _RISK_SQL, "plong")

    @query(name, with_parts("plong", f"SELECT model, count(*) AS rows, {_cells(sql, metrics, digits)} FROM {source} GROUP BY 1", _MONEY))
    def _(t):
        long = M.melt_models(_money(t), MODELS, ["row_id"]) if money else _long(t)
        return rounded(M.metric_table(long, {m: registry[m] for m in metrics}), digits)


_metric_query("P1_errors", ["rmse", "mae"], False)
_metric_query("P1_errors_money", ["rmse_raw", "rmse_log"], True, 4)
_metric_query("P2_r2", ["r2"], False)
_metric_query("P3_percentage_errors", ["mape_raw", "mape_nonzero_raw", "smape_raw"], True, 4)
_metric_query("P4_pearson", ["pearson"], False)


@query("U1_metric_registry", with_parts("plong", f"SELECT model, count(*) AS rows, {_cells(_RISK_SQL, ['rmse', 'mae', 'r2', 'pearson'])}, {R(f'max(abs{_E})', 6, 'worst')} FROM plong GROUP BY 1"))
def _(t):
    registry = {**M.RISK_METRICS, "worst": lambda y, p: F.max(F.abs(p - y))}
    return rounded(M.metric_table(_long(t), registry))


@query("U4_group_rmse", with_parts("plong", f"SELECT model, segment, count(*) AS rows, {R(_RISK_SQL['rmse'], 6, 'rmse')} FROM plong GROUP BY 1, 2"))
def _(t):
    return rounded(M.metric_table(_long(t), {"rmse": M.rmse}, ["model", "segment"]))


_RANKED = {"rk": "SELECT *, rank() OVER (PARTITION BY model ORDER BY y_true) + (count(*) OVER (PARTITION BY model, y_true) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY model ORDER BY y_pred) + (count(*) OVER (PARTITION BY model, y_pred) - 1) / 2.0 AS rp FROM plong"}


@query("P5_spearman", with_parts("plong", f"SELECT model, {R('corr(ry, rp)', 6, 'spearman')} FROM rk GROUP BY 1", _RANKED))
def _(t):
    return rounded(M.spearman_table(_long(t)))


_Q = "quantile_cont(abs(y_pred - y_true), {0})"


@query("P6_error_percentiles", with_parts("plong", f"SELECT model, {R(_Q.format(0.9), 6, 'p90_abs_error')}, {R(_Q.format(0.95), 6, 'p95_abs_error')} FROM plong GROUP BY 1"))
def _(t):
    return rounded(M.location_table(_long(t)).select("model", "p90_abs_error", "p95_abs_error"))


_TOP = {"top": "SELECT *, count(*) OVER (PARTITION BY model) AS n FROM plong QUALIFY row_number() OVER (PARTITION BY model ORDER BY y_pred DESC, row_id) <= greatest(1, round_even(n * 0.1, 0))"}


@query("P7_top_bucket", with_parts("plong", f"SELECT model, count(*) AS top_rows, {R('avg(y_true)', 6, 'top_bucket_true_mean')}, {R('median(y_true)', 6, 'top_bucket_true_median')} FROM top GROUP BY 1", _TOP))
def _(t):
    return rounded(M.top_bucket_table(_long(t), "row_id"))


@query("G2_top_fraction", with_parts("plong", "SELECT model, row_id FROM top", _TOP))
def _(t):
    return G.top_fraction(_long(t), "y_pred", "row_id", 0.1, ["model"]).select("model", "row_id")


def _events(th: float, tag: str) -> str:
    rate, precision = f"w.p{tag} / w.n", f"t.h{tag} / t.k"
    return ", ".join([R(rate, 6, f"event_{tag}_rate"), R(precision, 6, f"event_{tag}_top_precision"), R(f"t.h{tag} / nullif(w.p{tag}, 0)", 6, f"event_{tag}_top_recall"), R(f"({precision}) / nullif({rate}, 0)", 6, f"event_{tag}_top_lift")])


@query("P8_event_metrics", with_parts("plong", f"SELECT w.model, {_events(0.3, '0p30')}, {_events(0.5, '0p50')} FROM w JOIN t ON t.model = w.model",
    {**_TOP, "w": "SELECT model, count(*) AS n, count(*) FILTER (y_true >= 0.3) AS p0p30, count(*) FILTER (y_true >= 0.5) AS p0p50 FROM plong GROUP BY 1",
     "t": "SELECT model, count(*) AS k, count(*) FILTER (y_true >= 0.3) AS h0p30, count(*) FILTER (y_true >= 0.5) AS h0p50 FROM top GROUP BY 1"}))
def _(t):
    return rounded(M.event_table(_long(t), "row_id"))


_CLIPPED = {"cl": "SELECT * REPLACE (least(greatest(y_pred, 0), 1) AS y_pred) FROM plong"}


@query("P9_full_metric_row", with_parts("plong", f"""SELECT c.model, c.rows, {', '.join(R('c.' + n, 6, n) for n in _RISK_SQL)}, {R('c.tm', 6, 'target_mean')}, {R('c.pm', 6, 'prediction_mean')}, {R('s.sp', 6, 'spearman')},
    {R('c.tmed', 6, 'target_median')}, {R('c.pmed', 6, 'prediction_median')}, {R('c.p90', 6, 'p90_abs_error')}, {R('c.p95', 6, 'p95_abs_error')}, t.k AS top_rows, {R('t.m', 6, 'top_bucket_true_mean')}, {R('t.med', 6, 'top_bucket_true_median')}, {_events(0.3, '0p30')}, {_events(0.5, '0p50')}
    FROM c JOIN s ON s.model = c.model JOIN t ON t.model = c.model JOIN w ON w.model = c.model""",
    {**_CLIPPED, "rk": _RANKED["rk"].replace("FROM plong", "FROM cl"), "top": _TOP["top"].replace("FROM plong", "FROM cl"), "s": "SELECT model, corr(ry, rp) AS sp FROM rk GROUP BY 1",
     "c": f"SELECT model, count(*) AS rows, {', '.join(f'{e} AS {n}' for n, e in _RISK_SQL.items())}, avg(y_true) AS tm, avg(y_pred) AS pm, median(y_true) AS tmed, median(y_pred) AS pmed, {_Q.format(0.9)} AS p90, {_Q.format(0.95)} AS p95 FROM cl GROUP BY 1",
     "w": "SELECT model, count(*) AS n, count(*) FILTER (y_true >= 0.3) AS p0p30, count(*) FILTER (y_true >= 0.5) AS p0p50 FROM cl GROUP BY 1",
     "t": "SELECT model, count(*) AS k, avg(y_true) AS m, median(y_true) AS med, count(*) FILTER (y_true >= 0.3) AS h0p30, count(*) FILTER (y_true >= 0.5) AS h0p50 FROM top GROUP BY 1"}))
def _(t):
    return rounded(M.risk_metric_row(_long(t), "row_id"))


@query("P10_headline_table", with_parts("plong", f"SELECT model, count(*) AS rows, {_cells(_MONEY_SQL, list(_MONEY_SQL), 4)} FROM ml GROUP BY 1", _MONEY))
def _(t):
    return rounded(M.metric_table(M.melt_models(_money(t), MODELS, ["row_id"]), M.VALUATION_METRICS), 4)


@query("P11_tail_rates", with_parts("plong", "SELECT model, " + ", ".join(R(f"avg(CAST(greatest(p / y, y / p) > {k} AS DOUBLE))", 6, f"ratio_over_{k}x") for k in (2, 5, 10)) + " FROM (SELECT model, greatest(y_true, 1e-8) AS y, greatest(y_pred, 1e-8) AS p FROM plong) GROUP BY 1"))
def _(t):
    return rounded(M.tail_rates(_long(t)))


@query("E9_quantiles", f"SELECT {', '.join(R(f'quantile_cont(o_totalprice, {p})', 6, n) for n, p in [('q05', 0.05), ('q25', 0.25), ('q50', 0.5), ('q995', 0.995)])}, count(*) AS n_values FROM orders")
def _(t):
    return rounded(G.quantiles(t.read("orders"), "o_totalprice", {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q995": 0.995}), 6)


@query("E10_fold_metrics", with_parts("plong", " UNION ALL ".join(f"SELECT '{m}' AS metric, {R(f'avg({m})', 6, 'mean')}, {R(f'stddev_pop({m})', 6, 'std')}, {R(f'min({m})', 6, 'min')}, {R(f'max({m})', 6, 'max')} FROM folds" for m in ("rmse", "mae", "r2")),
    {"folds": f"SELECT fiscal_year, {', '.join(f'{_RISK_SQL[m]} AS {m}' for m in ('rmse', 'mae', 'r2'))} FROM plong WHERE model = 'model_a' GROUP BY 1"}))
def _(t):
    folds = M.metric_table(_long(t).where("model = 'model_a'"), M.RISK_METRICS, ["fiscal_year"])
    return rounded(M.fold_aggregate(folds, ["rmse", "mae", "r2"]))


@query("H5_error_quantiles", with_parts("plong", " UNION ALL ".join(f"SELECT 'q{int(p * 100)}' AS quantile, " + ", ".join(R(f"quantile_cont(abs(y_pred - y_true), {p}) FILTER (model = '{m}')", 6, m) for m in MODELS) + " FROM plong" for p in (0.5, 0.75, 0.9, 0.95))))
def _(t):
    return rounded(M.error_quantiles(_long(t), F.abs(F.col("y_pred") - F.col("y_true"))))


@query("R6_yearly_errors", with_parts("plong", f"SELECT CAST(fiscal_year AS BIGINT) AS fiscal_year, count(*) AS rows, {R(_MONEY_SQL['rmse_log'], 6, 'rmse_log')}, {R(_MONEY_SQL['rmse_raw'], 6, 'rmse_raw')}, {R(_MONEY_SQL['mape_raw'], 4, 'mape_raw')}, {R('avg(y_true)', 6, 'mean_true_raw')}, {R('avg(y_pred)', 6, 'mean_pred_raw')} FROM plong WHERE model = 'model_a' GROUP BY 1"))
def _(t):
    out = M.per_segment_errors(_long(t).where("model = 'model_a'"), "fiscal_year")
    return rounded(out.withColumn("mape_raw", F.round("mape_raw", 4)))


# --- significance --------------------------------------------------------------------------------------------------

_CY, _CP = "least(greatest(y_true, 0), 1)", "least(greatest({0}, 0), 1)"
_VIEW = {"abs_error": "abs({1} - {0})", "squared_error": "({1} - {0}) * ({1} - {0})", "signed_error": "({1} - {0})"}


def _view(view: str, model: str) -> str:
    return _VIEW[view].format(_CY, _CP.format(model))


_DIFFS = {"df": " UNION ALL ".join(f"SELECT row_id, '{a}' AS model_a, '{b}' AS model_b, '{v}' AS loss_view, {_view(v, a).replace(a, 'p.' + a)} AS a, {_view(v, b).replace(b, 'p.' + b)} AS b FROM pred p" for a, b in PAIRS for v in _VIEW),
          "dd": "SELECT *, a - b AS d FROM df"}


@query("Q1_loss_views", with_parts("pred", " UNION ALL ".join(f"SELECT row_id, '{m}' AS model, '{v}' AS loss_view, {R(_view(v, m), 6, 'loss')} FROM pred" for m in MODELS for v in _VIEW)))
def _(t):
    return rounded(Q.loss_table(_aligned(t), MODELS, "row_id"))


@query("H4_model_pairs", with_parts("plong", f"SELECT a.model AS model_a, b.model AS model_b, {R('a.rmse - b.rmse', 6, 'rmse_delta')} FROM per a JOIN per b ON a.model < b.model", {"per": f"SELECT model, {_RISK_SQL['rmse']} AS rmse FROM plong GROUP BY 1"}))
def _(t):
    table = M.metric_table(_long(t), {"rmse": M.rmse})
    a = table.select(F.col("model").alias("model_a"), F.col("rmse").alias("a"))
    b = table.select(F.col("model").alias("model_b"), F.col("rmse").alias("b"))
    return a.join(b, F.col("model_a") < F.col("model_b")).select("model_a", "model_b", r(F.col("a") - F.col("b"), 6, "rmse_delta"))


_BY = "model_a, model_b, loss_view"


@query("Q4_win_rates", with_parts("pred", f"SELECT {_BY}, count(*) AS rows, {R('avg(a)', 6, 'mean_loss_a')}, {R('avg(b)', 6, 'mean_loss_b')}, {R('avg(d)', 6, 'mean_diff_a_minus_b')}, {R('median(d)', 6, 'median_diff_a_minus_b')}, {R('avg(CAST(a < b AS DOUBLE))', 6, 'win_rate_a_lt_b')}, {R('avg(CAST(abs(d) <= 1e-8 + 1e-5 * abs(b) AS DOUBLE))', 6, 'tie_rate')} FROM dd GROUP BY {_BY}", _DIFFS))
def _(t):
    return rounded(Q.pairwise_statistics(_aligned(t), MODELS).select(*Q.PAIR, "rows", "mean_loss_a", "mean_loss_b", "mean_diff_a_minus_b", "median_diff_a_minus_b", "win_rate_a_lt_b", "tie_rate"))


@query("Q5_paired_t", with_parts("pred", f"SELECT {_BY}, {R('avg(d) / (stddev_samp(d) / sqrt(count(*)))', 5, 'paired_t_statistic')} FROM dd GROUP BY {_BY}", _DIFFS))
def _(t):
    return rounded(Q.pairwise_statistics(_aligned(t), MODELS).select(*Q.PAIR, "paired_t_statistic"), 5)


_WILCOXON = {**_DIFFS, "wr": f"SELECT *, rank() OVER (PARTITION BY {_BY} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {_BY}, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {_BY}, abs(d)) AS ties FROM dd",
    "ws": f"""SELECT {_BY}, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (d = 0) AS DOUBLE) AS z, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS s,
        coalesce(sum(CAST(ties AS DOUBLE) * ties - 1) FILTER (d <> 0), 0) AS tie FROM wr GROUP BY {_BY}"""}


@query("Q6_wilcoxon", with_parts("pred", f"SELECT {_BY}, {R('s', 1, 'wilcoxon_statistic')}, {R('(s - (n * (n + 1) - z * (z + 1)) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - tie / 2) / 24)', 5, 'wilcoxon_z')} FROM ws", _WILCOXON))
def _(t):
    out = Q.wilcoxon(Q.paired_losses(_aligned(t), MODELS), Q.PAIR)
    return rounded(out.withColumn("wilcoxon_statistic", F.round("wilcoxon_statistic", 1)), 5)


@query("Q7_skewness", with_parts("pred", f"SELECT {_BY}, {R('skewness(d)', 5, 'diff_skewness')}, abs(skewness(d)) <= 1 AS approx_symmetric_diff FROM dd GROUP BY {_BY}", _DIFFS))
def _(t):
    return rounded(Q.pairwise_statistics(_aligned(t), MODELS).select(*Q.PAIR, "diff_skewness", "approx_symmetric_diff"), 5)


_P = {"pv": "SELECT CASE WHEN p_size <> 7 THEN (p_retailprice - 899) / 100000 END AS p, p_brand FROM part",
      "grp": "SELECT p_brand, min(p) AS p FROM pv GROUP BY 1",
      "ord": "SELECT p_brand, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, p_brand) AS i FROM grp WHERE p IS NOT NULL"}


def _p_values(t):
    """One p-value per brand, as a result table of a few rows."""
    part = t.read("part").withColumn("p", F.when(F.col("p_size") != 7, (F.col("p_retailprice") - 899) / 100000))
    return part.groupBy("p_brand").agg(F.min("p").alias("p"))


@query("Q8_holm", with_parts("", f"SELECT p_brand, {R('least(max((m - i + 1) * p) OVER (ORDER BY i), 1)', 6, 'p_holm')} FROM ord", _P))
def _(t):
    return rounded(Q.adjust(_p_values(t), "p", ["p_brand"]).select("p_brand", "p_holm"))


@query("Q9_benjamini_hochberg", with_parts("", f"SELECT p_brand, {R('least(min(p * m / i) OVER (ORDER BY i DESC), 1)', 6, 'p_bh')} FROM ord", _P))
def _(t):
    return rounded(Q.adjust(_p_values(t), "p", ["p_brand"]).select("p_brand", "p_bh"))


_MZ = {"mz": """SELECT model, CAST(count(*) AS DOUBLE) AS n, regr_slope(y_true, y_pred) AS b, regr_intercept(y_true, y_pred) AS a, regr_sxx(y_true, y_pred) AS sxx, regr_syy(y_true, y_pred) AS syy, avg(y_pred) AS mx FROM plong GROUP BY 1""",
       "mv": "SELECT *, (syy - b * b * sxx) / (n - 2) AS v FROM mz"}


@query("Q10_calibration", with_parts("plong", f"SELECT model, CAST(n AS BIGINT) AS rows, {R('a', 6, 'intercept')}, {R('sqrt(v * (1 / n + mx * mx / sxx))', 6, 'intercept_se')}, {R('b', 6, 'slope')}, {R('sqrt(v / sxx)', 6, 'slope_se')}, {R('b * b * sxx / syy', 6, 'r2')}, {R('(n * a * a + 2 * a * (b - 1) * n * mx + (b - 1) * (b - 1) * (sxx + n * mx * mx)) / (2 * v)', 3, 'joint_f_statistic')} FROM mv", _MZ))
def _(t):
    out = Q.calibration_statistics(_long(t))
    return rounded(out.withColumn("joint_f_statistic", F.round("joint_f_statistic", 3)))


_BIAS = {"bd": "SELECT model, row_id, y_pred - y_true AS d FROM plong", "br": "SELECT *, rank() OVER (PARTITION BY model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2.0 AS rk FROM bd"}


@query("Q11_bias", with_parts("plong", f"SELECT model, count(*) AS rows, {R('avg(d)', 6, 'mean_error')}, {R('avg(abs(d))', 6, 'mean_abs_error')}, {R('avg(d) / (stddev_samp(d) / sqrt(count(*)))', 5, 'mean_bias_t_statistic')}, {R('median(d)', 6, 'median_error')}, {R('least(sum(rk) FILTER (d > 0), sum(rk) FILTER (d < 0))', 1, 'wilcoxon_statistic')} FROM br GROUP BY 1", _BIAS))
def _(t):
    out = Q.bias_statistics(_long(t)).drop("wilcoxon_z")
    return rounded(out.withColumns({"mean_bias_t_statistic": F.round("mean_bias_t_statistic", 5), "wilcoxon_statistic": F.round("wilcoxon_statistic", 1)}))


_BUCKETS = {
    "ed": "SELECT list_distinct([" + ", ".join(f"quantile_cont(y_true, {i / 5})" for i in range(6)) + "]) AS e0 FROM pred",
    "ee": "SELECT list_sort(e0) AS e FROM ed",
    "bk": "SELECT p.*, ee.e, len(list_filter(ee.e[2:len(ee.e) - 1], lambda x: x < y_true)) + 1 AS bucket FROM plong p, ee",
    "bl": "SELECT *, '(' || round(e[bucket], 3) || ', ' || round(e[bucket + 1], 3) || ']' AS bucket_label, abs(y_pred - y_true) AS err FROM bk",
}


def _bucketed(t):
    return M.melt_models(M.with_quantile_bucket(_aligned(t), "y_true", 5), MODELS, ["row_id", "bucket", "bucket_label"])


@query("R5_quantile_buckets", with_parts("pred plong", f"SELECT model, bucket, bucket_label, count(*) AS rows, {R('avg(y_true)', 6, 'mean_true')}, {R('avg(y_pred)', 6, 'mean_pred')}, {R('sqrt(avg(err * err))', 6, 'rmse')}, {R('avg(err)', 6, 'mean_error')}, {R('median(err)', 6, 'median_error')} FROM bl GROUP BY 1, 2, 3", _BUCKETS))
def _(t):
    return rounded(M.bucket_table(_bucketed(t)))


_KW = {**_BUCKETS, "kr": "SELECT *, rank() OVER (PARTITION BY model ORDER BY err) + (count(*) OVER (PARTITION BY model, err) - 1) / 2.0 AS rk, CAST(count(*) OVER (PARTITION BY model, err) AS DOUBLE) AS tc FROM bl",
    "kt": "SELECT model, CAST(count(*) AS DOUBLE) AS nt, sum(tc * tc - 1) AS ties FROM kr GROUP BY 1",
    "kg": "SELECT model, bucket_label, CAST(count(*) AS DOUBLE) AS n, sum(rk) AS rs FROM kr GROUP BY 1, 2"}


@query("Q12_kruskal", with_parts("pred plong", f"SELECT model, CAST(count(*) AS BIGINT) AS n_buckets, {R('(12 / (any_value(nt) * (any_value(nt) + 1)) * sum(rs * rs / n) - 3 * (any_value(nt) + 1)) / (1 - any_value(ties) / (any_value(nt) * any_value(nt) * any_value(nt) - any_value(nt)))', 4, 'kruskal_h_statistic')} FROM kg JOIN kt USING (model) GROUP BY 1", _KW))
def _(t):
    error = F.abs(F.col("y_pred") - F.col("y_true"))
    return rounded(Q.kruskal_table(Q.bucket_ranks(_bucketed(t), error)), 4)


@query("Q13_dunn", with_parts("pred plong", f"SELECT a.model, a.bucket_label AS group_a, b.bucket_label AS group_b, {R('(a.rs / a.n - b.rs / b.n) / greatest(sqrt(nt * (nt + 1) / 12 * greatest(1 - ties / (nt * nt * nt - nt), 1e-12) * (1 / a.n + 1 / b.n)), 1e-12)', 5, 'z_statistic')} FROM kg a JOIN kg b ON b.model = a.model AND a.bucket_label < b.bucket_label JOIN kt ON kt.model = a.model", _KW))
def _(t):
    error = F.abs(F.col("y_pred") - F.col("y_true"))
    return rounded(Q.dunn_statistics(Q.bucket_ranks(_bucketed(t), error)), 5)


@query("Q2_bootstrap_intervals")
def _(t):
    samples = Q.bootstrap_samples(_aligned(t), MODELS, "row_id", iterations=2000)
    return Q.bootstrap_intervals(samples, ["rmse", "mae", "r2", "pearson"])


@query("Q2_bootstrap_rank_metrics")
def _(t):
    samples = Q.bootstrap_rank_samples(_aligned(t), MODELS, "row_id")
    return Q.bootstrap_intervals(samples, ["spearman", "p90_abs_error", "p95_abs_error"])


@query("Q3_bootstrap_differences")
def _(t):
    samples = Q.bootstrap_samples(_aligned(t), MODELS, "row_id", iterations=2000)
    return Q.bootstrap_differences(samples, ["rmse", "mae", "r2"])


@query("Q14_pairwise_suite")
def _(t):
    return Q.pairwise_table(_aligned(t), MODELS)


@query("Q14_calibration_suite")
def _(t):
    return Q.calibration_table(_long(t)).join(Q.bias_table(_long(t)).drop("rows"), "model")


@query("Q14_valuation_pairwise")
def _(t):
    return Q.pairwise_table(_money(t), MODELS, Q.valuation_losses)


@query("Q14_bucket_suite")
def _(t):
    error = F.abs(F.col("y_pred") - F.col("y_true"))
    ranks = Q.bucket_ranks(_bucketed(t), error)
    return Q.dunn_table(ranks).join(Q.kruskal_with_p(ranks), "model")


# --- drift ---------------------------------------------------------------------------------------------------------

_SHIFT = ["y_true", "model_a", "model_b"]
_FL = {"fl": " UNION ALL ".join(f"SELECT '{c}' AS feature, split = 'train' AS tr, {c} AS value FROM pred" for c in _SHIFT),
       "kc": "SELECT feature, value, sum(CAST(tr AS INT)) OVER w AS a, sum(CAST(NOT tr AS INT)) OVER w AS b, sum(CAST(tr AS INT)) OVER (PARTITION BY feature) AS ta, sum(CAST(NOT tr AS INT)) OVER (PARTITION BY feature) AS tb FROM fl WINDOW w AS (PARTITION BY feature ORDER BY value RANGE UNBOUNDED PRECEDING)",
       "ks": "SELECT feature, max(abs(CAST(a AS DOUBLE) / ta - CAST(b AS DOUBLE) / tb)) AS ks_stat FROM kc GROUP BY 1",
       "pe": "SELECT feature, list_sort(list_distinct([" + ", ".join(f"quantile_cont(value, {i / 10})" for i in range(11)) + "])) AS e FROM fl WHERE tr GROUP BY 1",
       "pb": "SELECT f.feature, tr, len(list_filter(e[2:len(e) - 1], lambda x: x <= value)) AS bin FROM fl f JOIN pe ON pe.feature = f.feature",
       "pc": "SELECT feature, bin, CAST(count(*) FILTER (tr) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT tr) AS DOUBLE) AS b FROM pb GROUP BY 1, 2",
       "ps": "SELECT feature, greatest(a / sum(a) OVER (PARTITION BY feature), 1e-6) AS pa, greatest(b / sum(b) OVER (PARTITION BY feature), 1e-6) AS pp FROM pc",
       "psi_": "SELECT feature, sum((pp - pa) * ln(pp / pa)) AS psi FROM ps GROUP BY 1"}


def _shift_long(t):
    p = t.predictions
    return E.stack_features(p.where("split = 'train'"), p.where("split <> 'train'"), _SHIFT)


@query("R1_ks", with_parts("pred", f"SELECT feature, {R('ks_stat', 6)} FROM ks", _FL))
def _(t):
    return rounded(E.ks_table(_shift_long(t)))


@query("R2_psi", with_parts("pred", f"SELECT feature, {R('psi', 6)} FROM psi_", _FL))
def _(t):
    return rounded(E.psi_table(_shift_long(t)))


def _tables(t):
    p = t.predictions.withColumn("model_b", F.when(F.col("segment") != "5-LOW", F.col("model_b")))
    return p.where("split = 'train'"), p.where("split <> 'train'")


_FLM = {"fl0": " UNION ALL ".join(f"SELECT '{c}' AS feature, split = 'train' AS tr, {c if c != 'model_b' else 'CASE WHEN segment <> ' + chr(39) + '5-LOW' + chr(39) + ' THEN model_b END'} AS value FROM pred" for c in _SHIFT),
        "fl": "SELECT * FROM fl0 WHERE value IS NOT NULL", **{k: v for k, v in _FL.items() if k != "fl"},
        "mo": "SELECT feature, avg(CAST(value IS NULL AS DOUBLE)) FILTER (tr) AS train_missing_rate, avg(CAST(value IS NULL AS DOUBLE)) FILTER (NOT tr) AS test_missing_rate, avg(value) FILTER (tr) AS train_mean, avg(value) FILTER (NOT tr) AS test_mean, stddev_pop(value) FILTER (tr) AS train_std, stddev_pop(value) FILTER (NOT tr) AS test_std FROM fl0 GROUP BY 1"}
_MOMENTS = ["train_missing_rate", "test_missing_rate", "train_mean", "test_mean", "train_std", "test_std", "ks_stat", "psi"]


@query("R3_feature_shift", with_parts("pred", f"SELECT mo.feature, {Rs(_MOMENTS)} FROM mo JOIN ks ON ks.feature = mo.feature JOIN psi_ ON psi_.feature = mo.feature", _FLM))
def _(t):
    return rounded(E.shift_table(*_tables(t), _SHIFT))


@query("G6_top_shifted", with_parts("pred", f"SELECT feature, {R('psi', 6)} FROM psi_ ORDER BY psi_.psi DESC, feature LIMIT 2", _FLM))
def _(t):
    return rounded(E.top_shifted(E.shift_table(*_tables(t), _SHIFT), "psi", 2))


_TICKERS = {**_MONEY, "pt": f"SELECT ticker, count(*) AS rows, {_MONEY_SQL['rmse_log']} AS rmse_log, {_MONEY_SQL['rmse_raw']} AS rmse_raw, {_MONEY_SQL['mape_raw']} AS mape_raw, avg(y_true) AS mean_true_raw, avg(y_pred) AS mean_pred_raw FROM ml WHERE model = 'model_a' GROUP BY 1"}


def _per_ticker(t):
    long = M.melt_models(_money(t), ["model_a"], ["row_id", "ticker"])
    return M.per_segment_errors(long, "ticker")


@query("R4_per_ticker_errors", with_parts("plong", f"SELECT ticker, rows, {Rs(['rmse_log', 'rmse_raw', 'mape_raw', 'mean_true_raw', 'mean_pred_raw'], 3)} FROM pt", _TICKERS))
def _(t):
    return rounded(_per_ticker(t), 3)


@query("R4_ticker_summary", with_parts("plong", f"SELECT count(*) AS tickers, {R('median(rmse_log)', 6, 'median_rmse_log')}, {R('quantile_cont(rmse_log, 0.9)', 6, 'p90_rmse_log')}, {R('avg(rmse_log) FILTER (rmse_log >= (SELECT quantile_cont(rmse_log, 0.9) FROM pt))', 6, 'worst_decile_mean_rmse_log')}, {R('max(rmse_log)', 6, 'worst_ticker_rmse_log')} FROM pt", _TICKERS))
def _(t):
    return rounded(M.segment_summary(_per_ticker(t)))


# --- samples and batch twins of streams ------------------------------------------------------------------------------

@query("G5_seeded_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500")
def _(t):
    return seeded_sample(t.read("orders"), "o_orderkey", 500, 42).select("o_orderkey", "o_totalprice")


@query("T3_day_bars", f"SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, (max({{'t': ts, 'e': event_id, 'v': value}})).v AS close, max(value) AS high, min(value) AS low, {R('sum(value)', 2, 'volume')}, count(*) AS transactions FROM events GROUP BY 1, 2")
def _(t):
    bars = day_bars(t.day_events, None)
    return bars.select("event_type", d("date"), "close", "high", "low", r("volume", 2), "transactions")
