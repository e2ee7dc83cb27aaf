"""Queries over splits, preparation, training and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import attribution as A
from ledgerline.operators import boosting as B
from ledgerline.operators import metrics as M
from ledgerline.operators import network as NN
from ledgerline.operators import prep as N
from ledgerline.operators import training as T
from ledgerline.operators import validation as V
from ledgerline.operators.cleaning import deduplicate_entity_period, without
from ledgerline.operators.fundamentals import BASE_RATIOS, base_features, join_statements
from ledgerline.plans import risk as P
from ledgerline.plans.catalog import query
from ledgerline.plans.catalog.ctes import FEATURE_SQL, with_parts
from ledgerline.plans.catalog.shared import R, r, rounded

FEATURES = ["model_a", "model_b", "baseline"]


# --- splits --------------------------------------------------------------------------------------------------------

@query("N1_time_aware_split", with_parts("pred", "SELECT row_id, CASE WHEN fiscal_year = (SELECT max(fiscal_year) FROM pred) THEN 'val' ELSE 'train' END AS split FROM pred"))
def _(t):
    return N.time_aware_split(t.predictions.drop("split"), ["row_id"]).select("row_id", "split")


@query("N2_latest_years_split", with_parts("pred", """SELECT row_id, CASE WHEN later < greatest(round_even(0.15 * total, 0), 250) THEN 'val' ELSE 'train' END AS split FROM pred JOIN
    (SELECT fiscal_year, sum(n) OVER (ORDER BY fiscal_year DESC) - n AS later, sum(n) OVER () AS total FROM (SELECT fiscal_year, count(*) AS n FROM pred GROUP BY 1)) USING (fiscal_year)"""))
def _(t):
    return N.latest_years_split(t.predictions.drop("split"), ["row_id"]).select("row_id", "split")


@query("N3_ticker_split")
def _(t):
    p = t.predictions.drop("split")
    out = N.ticker_split(p, target_rows=N.validation_target(p.count(), 0.15, 250), eligible=F.col("y_true") > 0.01)
    return out.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("ticker").alias("tickers"))


@query("N4_row_split", "SELECT split, CASE WHEN split = 'val' THEN greatest(1, n // 5) ELSE n - greatest(1, n // 5) END AS rows FROM (SELECT unnest(['train', 'val']) AS split, count(*) AS n FROM orders)")
def _(t):
    p = t.predictions.drop("split")
    return N.hash_row_split(p, ["row_id"], max(1, p.count() // 5)).groupBy("split").agg(F.count("*").alias("rows"))


@query("N5_group_kfold", "SELECT CAST(fold AS BIGINT) AS fold, CASE WHEN fold <= n % 5 THEN n // 5 + 1 ELSE n // 5 END AS tickers FROM range(1, 6) f(fold), (SELECT count(DISTINCT o_custkey) AS n FROM orders)")
def _(t):
    return rounded(N.group_kfold(t.predictions, 5).groupBy("fold").agg(F.count_distinct("ticker").alias("tickers")))


@query("N6_row_kfold", "SELECT CAST(fold AS BIGINT) AS fold, CASE WHEN fold <= n % 5 THEN n // 5 + 1 ELSE n // 5 END AS rows FROM range(1, 6) f(fold), (SELECT count(*) AS n FROM orders)")
def _(t):
    return rounded(N.row_kfold(t.predictions, 5, ["row_id"]).groupBy("fold").agg(F.count("*").alias("rows")))


@query("N7_time_kfold", with_parts("pred", "SELECT row_id, fold FROM pred JOIN (SELECT fiscal_year, ntile(3) OVER (ORDER BY fiscal_year) AS fold FROM (SELECT DISTINCT fiscal_year FROM pred)) USING (fiscal_year)"))
def _(t):
    return rounded(N.time_kfold(t.predictions, 3).select("row_id", "fold"))


@query("N19_held_out_frames", with_parts("pred", """SELECT CASE WHEN fiscal_year >= 2001 THEN 'out_of_time' WHEN segment = '1-URGENT' THEN 'unseen' ELSE 'train' END AS part, count(*) AS rows FROM (
    SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY ticker, period_end ORDER BY fiscal_year DESC, row_id DESC) = 1) GROUP BY 1"""))
def _(t):
    kept = deduplicate_entity_period(t.predictions, ["fiscal_year", "row_id"])[0]
    late = kept.where("fiscal_year >= 2001")
    early = without(kept, late.select("fiscal_year").distinct(), ["fiscal_year"])
    unseen = early.where("segment = '1-URGENT'")
    train = without(early, unseen, ["row_id"])
    parts = [(late, "out_of_time"), (unseen, "unseen"), (train, "train")]
    tagged = [f.select(F.lit(n).alias("part")) for f, n in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("part").agg(F.count("*").alias("rows"))


# --- features ------------------------------------------------------------------------------------------------------

_AMOUNTS = ["total_assets", "total_liabilities", "retained_earnings_deficit", "debt_current", "goodwill", "cash_and_equivalents"]
_NAMED = [c for c in _AMOUNTS if any(k in c for k in N.LOG_TOKENS)]


@query("N8_numeric_features", with_parts("bs", "SELECT unnest([" + ", ".join(f"'{c}'" for c in _AMOUNTS[1:]) + "]) AS feature, count(*) AS rows FROM bs"))
def _(t):
    bs = t.statement("bs").select("ticker", "fiscal_year", "period_end", "cik", *_AMOUNTS)
    names = N.numeric_features(bs, "total_assets")
    return bs.agg(F.count("*").alias("rows")).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"), "rows")


@query("N9_log1p_features", with_parts("bs", " UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'min({c})', 2, 'train_min')}, coalesce(min({c}) >= 0, false) AS log1p FROM bs" for c in _NAMED)))
def _(t):
    return rounded(N.log1p_minima(t.statement("bs"), _AMOUNTS), 2)


@query("N10_model_matrix", with_parts("bs", f"SELECT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, {R('ln(1 + greatest(coalesce(total_liabilities, 0), 0))', 6, 'total_liabilities')}, {R('coalesce(goodwill, 0)', 2, 'goodwill')}, {R('ln(1 + greatest(coalesce(total_assets, 0), 0))', 6, 'label')} FROM bs"))
def _(t):
    m = N.model_matrix(t.statement("bs"), ["total_liabilities", "goodwill"], "total_assets", ["total_liabilities"], True, ["ticker", "fiscal_year"])
    return rounded(m.withColumn("goodwill", F.round("goodwill", 2)))


_SCALED = ["volatility_21d", "drawdown_126d", "return_63d"]


@query("N11_scaler", with_parts("risk", " UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'avg({c})', 6, 'mu')}, {R(f'stddev_pop({c})', 6, 'sigma')} FROM risk" for c in _SCALED)))
def _(t):
    return rounded(N.scaler_stats(P.risk_dataset(t.observations, t.bars), _SCALED))


@query("N11_scaled_values", with_parts("risk", "SELECT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, " + ", ".join(R(f"coalesce(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 0)", 5, c) for c in _SCALED) + " FROM risk"))
def _(t):
    data = P.risk_dataset(t.observations, t.bars)
    return rounded(N.scale(data, data, _SCALED).select("ticker", "fiscal_year", *_SCALED), 5)


@query("N12_target_correlation", with_parts("pred", " UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'covar_pop({c}, y_true) / (stddev_pop({c}) * stddev_pop(y_true) + 1e-12)', 6, 'corr')} FROM pred" for c in FEATURES)))
def _(t):
    return rounded(N.target_correlations(t.predictions, FEATURES, "y_true"))


@query("N13_feature_selection")
def _(t):
    data = t.predictions.withColumns({"copy": F.col("model_a") * 2 + 0.1, "flat": F.lit(1.0)})
    names = N.select_by_correlation(data, [*FEATURES, "copy", "flat"], "y_true", min_features=2)
    return data.agg(F.count("*").alias("rows")).select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("position", "feature"), "rows")


def _pca(t):
    data = P.risk_dataset(t.observations, t.bars).select("ticker", "period_end", *FEATURE_SQL).na.drop(subset=FEATURE_SQL).persist()
    scaled = N.scale(data, data, FEATURE_SQL)
    return scaled, N.fit_pca(scaled, FEATURE_SQL)


@query("N14_pca_scores")
def _(t):
    scaled, model = _pca(t)
    return N.pca_scores(scaled, model, ["ticker", "period_end"])


@query("N15_pca_report")
def _(t):
    _, model = _pca(t)
    return N.pca_loadings(t.spark, model, 5).join(N.pca_variance_table(t.spark, model), "component")


@query("N16_size_weights", with_parts("pred", f"SELECT row_id, {R('least(greatest(w / (avg(w) OVER () + 1e-12), 0.5), 2.0)', 6, 'weight')} FROM (SELECT row_id, power(greatest(amount, 1), -0.25) AS w FROM pred)"))
def _(t):
    return rounded(N.size_weights(t.predictions.withColumn("ly", F.log1p("amount")), "ly").select("row_id", "weight"))


@query("N17_severity_weights", with_parts("pred", f"SELECT row_id, {R('least(greatest(1 + least(greatest(model_a, 0), 1), 1), 2)', 6, 'weight')} FROM pred"))
def _(t):
    return t.predictions.select("row_id", r(N.severity_weights("model_a"), 6, "weight"))


@query("N18_clip_to_train", with_parts("pred", f"SELECT row_id, {R('least(greatest(model_a, (SELECT quantile_cont(y_true, 0.005) FROM tr)), (SELECT quantile_cont(y_true, 0.995) FROM tr))', 6, 'model_a')} FROM pred", {"tr": "SELECT * FROM pred WHERE split = 'train'"}))
def _(t):
    p = t.predictions
    return rounded(N.clip_to_train(p, p.where("split = 'train'"), "model_a", "y_true").select("row_id", "model_a"))


@query("N18_clip_to_range", with_parts("pred", f"SELECT row_id, {R('least(greatest(model_a, (SELECT min(y_true) - 0.05 FROM tr)), (SELECT max(y_true) + 0.05 FROM tr))', 6, 'model_a')} FROM pred", {"tr": "SELECT * FROM pred WHERE split = 'train'"}))
def _(t):
    p = t.predictions
    return rounded(N.clip_to_train_range(p, p.where("split = 'train'"), "model_a", "y_true", 0.05).select("row_id", "model_a"))


@query("N20_ticker_weights", with_parts("pred", f"SELECT row_id, {R('w / avg(w) OVER ()', 6, 'weight')} FROM (SELECT row_id, 1.0 / count(*) OVER (PARTITION BY ticker) AS w FROM pred)"))
def _(t):
    return rounded(N.ticker_weights(t.predictions).select("row_id", "weight"))


@query("N21_feature_set", with_parts("bs inc", "SELECT unnest([" + ", ".join(f"'{c}'" for c in BASE_RATIOS) + "]) AS feature, (SELECT count(*) FROM bs) AS rows"))
def _(t):
    table = base_features(join_statements(t.statement("bs"), t.statement("inc"), t.statement("cf")))
    names = [c for c in N.numeric_features(table, "total_assets") if c in BASE_RATIOS]
    return table.agg(F.count("*").alias("rows")).select(F.explode(F.array(*[F.lit(c) for c in names])).alias("feature"), "rows")


# --- training ------------------------------------------------------------------------------------------------------

def _risk(t):
    """Scaled risk rows with a label and a split, kept for the repeated passes of a trainer: keys, year, label and features."""
    data = P.risk_dataset(t.observations, t.bars).select("ticker", "fiscal_year", "period_end", "drawdown_severity", *FEATURE_SQL)
    data = data.withColumn("row_id", F.xxhash64("ticker", "period_end")).persist()
    split = N.latest_years_split(data, ["row_id"], min_rows=50).withColumn("label", F.col("drawdown_severity"))
    split = split.withColumn("raw_drawdown_126d", F.col("drawdown_126d"))
    return N.scale(split, split.where("split = 'train'"), FEATURE_SQL).persist()


def _report(scored):
    out = scored.withColumn("p", S.clip("y_pred_model_output", 0.0, 1.0))
    return out.groupBy("split").agg(F.count("*").alias("rows"), M.rmse(F.col("label"), F.col("p")).alias("rmse"), M.mae(F.col("label"), F.col("p")).alias("mae"))


def _trees(t):
    """Risk rows and the boosted trees fitted on them, with the default settings."""
    data = _risk(t).withColumn("weight", N.severity_weights("label"))
    return data, B.fit_until_best(data, FEATURE_SQL, weight="weight")


@query("O1_boosted_trees")
def _(t):
    data, model = _trees(t)
    rounds = [F.lit(model.best_round).alias("best_round"), F.lit(len(model.history)).alias("rounds_run")]
    return _report(T.score_trees(data.select("split", "label", *FEATURE_SQL), model)).select("*", *rounds)


@query("O1_loss_by_round")
def _(t):
    history = [(i, *h) for i, h in enumerate(_trees(t)[1].history, 1)]
    return t.spark.createDataFrame(history, "round int, train_loss double, val_loss double")


@query("O2_robust_linear")
def _(t):
    data = _risk(t).withColumn("weight", N.severity_weights("label"))
    return _report(T.predict_with(T.fit_robust_linear(data, FEATURE_SQL, weight="weight"), data, FEATURE_SQL))


def _network(t):
    data = _risk(t).withColumn("weight", N.severity_weights("label"))
    return data, NN.fit_until_best(data, FEATURE_SQL, weight="weight")


@query("O3_network_history")
def _(t):
    history = [(h["epoch"], h["train_loss"], h["val_loss"]) for h in _network(t)[1]["history"]]
    return t.spark.createDataFrame(history, "epoch int, train_loss double, val_loss double")


@query("O4_network_scores")
def _(t):
    data, model = _network(t)
    return _report(T.score_network(data.select("split", "label", *FEATURE_SQL), model))


@query("O5_residual_learner")
def _(t):
    data = t.predictions.withColumns({"base": F.col("baseline") * 500000, "label": T.residual_target("amount", "base")}).persist()
    model = T.fit_robust_linear(data, ["model_a", "model_b"])
    scored = T.predict_with(model, data, ["model_a", "model_b"], "residual").withColumn("p", T.from_residual("residual", "base"))
    return scored.groupBy("split").agg(F.count("*").alias("rows"), M.rmse_log(F.col("amount"), F.col("p")).alias("rmse_log"), M.rmse_log(F.col("amount"), F.col("base")).alias("base_rmse_log"))


@query("O6_tiny_base", with_parts("pred", f"SELECT row_id, {R('CASE WHEN y_true <= 0.2 THEN y_true ELSE model_a END', 6, 'p')} FROM pred"))
def _(t):
    return t.predictions.select("row_id", r(T.tiny_base_regime("model_a", "y_true", 0.2), 6, "p"))


@query("O7_baselines", with_parts("risk", f"SELECT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, {R('coalesce(CASE WHEN drawdown_126d IS NOT NULL THEN least(greatest(-drawdown_126d, 0), 1) END, (SELECT avg(drawdown_severity) FROM risk WHERE fiscal_year < 1999))', 6, 'y_pred_baseline')} FROM risk"))
def _(t):
    data = P.risk_dataset(t.observations, t.bars)
    return rounded(T.current_drawdown_baseline(data, data.where("fiscal_year < 1999")).select("ticker", "fiscal_year", "y_pred_baseline"))


@query("O7_log_mean_baseline", with_parts("pred", "SELECT row_id, " + R("exp((SELECT avg(ln(1 + amount)) FROM pred WHERE split = 'train')) - 1", 4, "y_pred_baseline") + " FROM pred"))
def _(t):
    p = t.predictions
    return rounded(T.log_mean_baseline(p, p.where("split = 'train'"), "amount").select("row_id", "y_pred_baseline"), 4)


@query("O8_out_of_distribution", with_parts("risk", "SELECT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, " + R("greatest(" + ", ".join(f"abs(coalesce(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 0))" for c in _SCALED) + ")", 5, "feature_zscore_max") + " FROM risk"))
def _(t):
    data = P.risk_dataset(t.observations, t.bars)
    return rounded(T.ood_score(N.scale(data, data, _SCALED), _SCALED).select("ticker", "fiscal_year", "feature_zscore_max"), 5)


_GUARD = {"g0": "SELECT row_id, baseline, model_a, least(greatest(model_a, 0), 0.9) AS c, model_b * 10 AS z FROM pred",
          "g": "SELECT *, abs(c - baseline) / greatest(abs(baseline), 1e-6) > 0.5 AS rel, c / greatest(abs(baseline), 1e-6) < 0.3 OR c / greatest(abs(baseline), 1e-6) > 1.4 AS ratio, z > 8 AS ood FROM g0"}


def _guarded(t):
    p = t.predictions.withColumn("z", F.col("model_b") * 10)
    return T.guarded_prediction(p, "model_a", "baseline", high=0.9, max_relative_deviation=0.5, ratio_low=0.3, ratio_high=1.4, zscore="z")


@query("O9_guarded_prediction", with_parts("pred", f"SELECT row_id, {R('CASE WHEN rel OR ratio OR ood THEN baseline ELSE c END', 6, 'y_pred_final')}, rel OR ratio OR ood AS fallback_any FROM g", _GUARD))
def _(t):
    return rounded(_guarded(t).select("row_id", "y_pred_final", "fallback_any"))


@query("O9_guard_rates", with_parts("pred", "SELECT " + ", ".join(R(f"avg(CAST({e} AS DOUBLE))", 6, f"fallback_{n}_rate") for n, e in [("any", "(rel OR ratio OR ood)"), ("rel", "rel"), ("ratio", "ratio"), ("ood", "ood")]) + " FROM g", _GUARD))
def _(t):
    return rounded(T.guard_rates(_guarded(t)))


_RATIO = "y_true / greatest(abs(baseline), 1e-6)"
_FITTED = {
    "b": f"""SELECT quantile_disc(y_true, 0.005) AS low, quantile_disc(y_true, 0.995) AS high, quantile_disc(abs(y_true - baseline) / greatest(abs(baseline), 1e-6), 0.995) AS far,
        quantile_disc({_RATIO}, 0.005) AS rl, quantile_disc({_RATIO}, 0.995) AS rh, quantile_disc(abs(model_b), 0.995) AS zm FROM pred WHERE split = 'train'""",
    "g0": "SELECT baseline, least(greatest(model_a, low), high) AS c, abs(model_b) AS z, far, rl, rh, zm FROM pred, b WHERE split = 'val'",
    "g": "SELECT abs(c - baseline) / greatest(abs(baseline), 1e-6) > far AS rel, c / greatest(abs(baseline), 1e-6) < rl OR c / greatest(abs(baseline), 1e-6) > rh AS ratio, z > zm AS ood FROM g0"}


@query("O9_fitted_guard_rates", with_parts("pred", "SELECT " + ", ".join(R(f"avg(CAST({e} AS DOUBLE))", 4, f"fallback_{n}_rate") for n, e in [("any", "(rel OR ratio OR ood)"), ("rel", "rel"), ("ratio", "ratio"), ("ood", "ood")]) + " FROM g", _FITTED))
def _(t):
    p = t.predictions.withColumn("z", F.abs("model_b"))
    bounds = V.fit_guard(p.where("split = 'train'"), [], "y_true", "baseline", "z", accuracy=1_000_000)
    return rounded(T.guard_rates(V.apply_guard(p.where("split = 'val'"), bounds, [], "model_a", "baseline", "z")), 4)


@query("O10_loss_sweep")
def _(t):
    return V.sweep_deltas(_risk(t), FEATURE_SQL, plan=NN.Plan(hidden=(256, 128), dropout=0.2))


def _cross_validated(t):
    data = _risk(t).drop("split").withColumn("baseline", S.clip(-F.coalesce("raw_drawdown_126d", F.lit(0.0)), 0.0, 1.0))
    data = N.group_kfold(data, 5).withColumnRenamed("fold", "fold_group")
    data = N.row_kfold(data, 5, ["row_id"]).withColumnRenamed("fold", "fold_row")
    data = N.time_kfold(data, 5).withColumnRenamed("fold", "fold_time").persist()
    return V.cross_validate(data, FEATURE_SQL, {"group": "fold_group", "row": "fold_row", "time": "fold_time"}, "label", "baseline")


@query("O11_cross_validation")
def _(t):
    return V.fold_summary(V.fold_metrics(_cross_validated(t)), ["rmse", "mae", "r2", "rmse_log"])


@query("O11_fold_metrics")
def _(t):
    return V.fold_metrics(_cross_validated(t))


@query("O12_prediction_frame", with_parts("pred", f"SELECT row_id, 'val' AS split, {R('y_true')}, {R('least(greatest(model_a, 0), 1)', 6, 'y_pred')}, {R('least(greatest(baseline, 0), 1)', 6, 'y_pred_baseline')}, {R('-y_true', 6, 'y_true_raw_drawdown')} FROM pred WHERE split = 'val'"))
def _(t):
    p = t.predictions.where("split = 'val'").withColumn("raw", -F.col("y_true"))
    return rounded(T.prediction_frame(p, "model_a", "y_true", "val", ["row_id"], (0.0, 1.0), "raw", "baseline"))


@query("O13_generalization", with_parts("pred", f"""SELECT {R("exp(max(rl) FILTER (split = 'val'))", 6, 'model_factor')}, {R("max(rl) FILTER (split = 'val') - max(rl) FILTER (split = 'train')", 6, 'gap_rmse_log')}, {R("max(r2) FILTER (split = 'train') - max(r2) FILTER (split = 'val')", 6, 'gap_r2_log')}
    FROM (SELECT split, sqrt(avg(power(ln(1 + greatest(model_a, 0)) - ln(1 + y_true), 2))) AS rl, 1 - sum(power(ln(1 + greatest(model_a, 0)) - ln(1 + y_true), 2)) / (var_pop(ln(1 + y_true)) * count(*)) AS r2 FROM pred GROUP BY 1)"""))
def _(t):
    long = t.predictions.withColumnRenamed("model_a", "y_pred")
    return rounded(T.generalization(M.metric_table(long, {"rmse_log": M.rmse_log, "r2_log": M.r2_log}, ["split"])))


@query("O14_log_multiple", with_parts("pred", f"SELECT row_id, {R('ln(amount / (baseline * 1000))', 6, 'log_multiple')}, {R('amount', 2, 'rebuilt')} FROM pred"))
def _(t):
    p = t.predictions.withColumn("revenue", F.col("baseline") * 1000).withColumn("log_multiple", T.log_multiple_target("amount", "revenue"))
    return p.select("row_id", r("log_multiple"), r(T.from_log_multiple("log_multiple", "revenue"), 2, "rebuilt"))


@query("O15_held_out_report")
def _(t):
    """The last year and a seventh of the tickers held out, trees and network, each against the baseline."""
    data = _risk(t).withColumn("baseline", S.clip(-F.coalesce("raw_drawdown_126d", F.lit(0.0)), 0.0, 1.0))
    bucket = F.pmod(F.xxhash64("ticker"), F.lit(7))
    data = data.withColumn("split", F.when(bucket == 1, "val").otherwise("train"))
    held = {"last year": (data.agg(F.max("fiscal_year").alias("fiscal_year")), ["fiscal_year"]), "unseen tickers": (data.where(bucket == 0).select("ticker").distinct(), ["ticker"])}
    models = {"trees": (lambda d: B.fit_until_best(d, FEATURE_SQL), lambda m, d: T.score_trees(d, m)),
              "network": (lambda d: NN.fit_until_best(d, FEATURE_SQL), lambda m, d: T.score_network(d, m))}
    out = None
    for name, (keys, columns) in held.items():
        for kind, (fit, predict) in models.items():
            _, metrics = T.held_out_report(data, keys, columns, FEATURE_SQL, "label", "baseline", fit, predict, (0.0, 1.0))
            part = metrics.withColumns({"held_out": F.lit(name), "estimator": F.lit(kind)})
            out = part if out is None else out.unionByName(part)
    return out


# Eight candidates: depth and regularization.
CANDIDATES = {f"depth {depth}, l2 {l2:g}": {"depth": depth, "l2": l2} for depth in (3, 4, 5, 6) for l2 in (1.0, 5.0)}


@query("O16_candidate_search")
def _(t):
    data = N.group_kfold(_risk(t).drop("split"), 5).persist()
    return B.search_candidates(data.select("row_id", "fold", "label", *FEATURE_SQL), FEATURE_SQL, CANDIDATES)[1]


# --- attributions --------------------------------------------------------------------------------------------------

# Coefficients of the explained demonstration model.
COEFFICIENTS = {"model_a": 0.6, "model_b": 0.3, "baseline": -0.2}
INTERCEPT = 0.05
_OUT = "0.05 + 0.6 * model_a + 0.3 * model_b - 0.2 * baseline"
_SHAP = {
    "means": "SELECT avg(model_a) AS ma, avg(model_b) AS mb, avg(baseline) AS mc FROM pred",
    "sh": f"""SELECT row_id, f.feature, f.v AS feature_value, f.s AS shap, 0.05 + 0.6 * ma + 0.3 * mb - 0.2 * mc AS base_value, {_OUT} AS y_pred_model_output FROM (
        SELECT *, unnest([{{'feature': 'model_a', 'v': model_a, 's': 0.6 * (model_a - ma)}}, {{'feature': 'model_b', 'v': model_b, 's': 0.3 * (model_b - mb)}}, {{'feature': 'baseline', 'v': baseline, 's': -0.2 * (baseline - mc)}}]) AS f FROM pred, means)""",
    "scored": f"SELECT *, abs(least(greatest(out, 0), 1) - y_true) AS abs_error FROM (SELECT row_id, y_true, baseline, {_OUT} AS out FROM pred)",
    "imp": "SELECT feature, avg(abs(shap)) AS mean_abs_shap, avg(shap) AS mean_shap, stddev_pop(abs(shap)) AS std_abs_shap, avg(feature_value) AS mean_feature_value, stddev_pop(feature_value) AS std_feature_value FROM sh GROUP BY 1",
}


def _long(t):
    return A.linear_attributions(t.predictions, COEFFICIENTS, INTERCEPT, "row_id")


def _scored(t):
    return A.prediction_columns(t.predictions.withColumn("y_pred_model_output", T.linear_expression(COEFFICIENTS, INTERCEPT)), (0.0, 1.0))


@query("S1_linear_attributions", with_parts("pred", f"SELECT row_id, feature, {R('feature_value')}, {R('shap')}, {R('base_value')}, {R('y_pred_model_output')} FROM sh", _SHAP))
def _(t):
    return rounded(_long(t))


def _explained(t):
    data, model = _trees(t)
    return data, A.tree_attributions(data, model, "row_id")


@query("S1_tree_attributions")
def _(t):
    return _explained(t)[1]


@query("S3_tree_importance")
def _(t):
    return A.importance_table(_explained(t)[1])


@query("S4_tree_local_explanations")
def _(t):
    data, long = _explained(t)
    output = long.groupBy("row_id").agg(F.first("y_pred_model_output").alias("y_pred_model_output"))
    scored = A.prediction_columns(data.select("row_id", F.col("label").alias("y_true")).join(output, "row_id"), (0.0, 1.0))
    return A.local_explanations(scored, long, "row_id", rows=50, top_k=5)


@query("S6_tree_additivity", with_parts("risk", "SELECT CAST(0 AS DOUBLE) AS mean_abs_gap, CAST(0 AS DOUBLE) AS max_abs_gap, count(*) AS rows FROM risk"))
def _(t):
    return rounded(A.additivity_table(_explained(t)[1], "row_id"))


@query("S7_trees_against_linear")
def _(t):
    data, long = _explained(t)
    linear = T.fit_robust_linear(data, FEATURE_SQL, weight="weight")
    other = A.linear_attributions(data, dict(zip(FEATURE_SQL, map(float, linear.coefficients))), float(linear.intercept), "row_id")
    return A.compare_importance({"trees": A.importance_table(long), "linear": A.importance_table(other)}, 10)


@query("S8_tree_dependence")
def _(t):
    _, long = _explained(t)
    return A.dependence_data(long, A.importance_table(long), 3, "row_id")


@query("S2_sampled_shapley")
def _(t):
    import numpy as np

    weights = np.array(list(COEFFICIENTS.values()))
    predict = lambda x: x @ weights + INTERCEPT + 0.1 * x[:, 0] * x[:, 1]
    p = t.predictions
    long = A.sampled_shapley(p, p, list(COEFFICIENTS), predict, "row_id")
    return long.groupBy("feature").agg(F.count("*").alias("rows"), F.avg(F.abs("shap")).alias("mean_abs_shap"), F.avg("base_value").alias("base_value"))


@query("S2_sampled_shapley_of_models")
def _(t):
    """Trees, linear model and network explained by one function, at the 50 worst predictions of the trees."""
    import numpy as np

    data, trees = _trees(t)
    linear = T.fit_robust_linear(data, FEATURE_SQL, weight="weight")
    slope, start = np.array(linear.coefficients), float(linear.intercept)
    network = NN.fit_until_best(data, FEATURE_SQL, weight="weight")["parameters"]
    scored = T.score_trees(data.select("row_id", "label", *FEATURE_SQL), trees).withColumn("error", F.abs(F.col("label") - F.col("y_pred_model_output")))
    worst = A.largest_errors(scored, "row_id", "error").persist()
    train = data.where("split = 'train'")
    out = None
    for name, predict in {"trees": trees, "linear": lambda x: x @ slope + start, "network": lambda x: T.network_output(network, x)}.items():
        long = A.sampled_shapley(worst, train, FEATURE_SQL, predict, "row_id").withColumn("model", F.lit(name))
        out = long if out is None else out.unionByName(long)
    return out.groupBy("model", "feature").agg(F.count("*").alias("rows"), F.avg(F.abs("shap")).alias("mean_abs_shap"), F.avg("standard_error").alias("mean_standard_error"),
                                               F.avg("base_value").alias("base_value"))


@query("S3_importance", with_parts("pred", f"SELECT feature, {', '.join(R(c) for c in ['mean_abs_shap', 'mean_shap', 'std_abs_shap', 'mean_feature_value', 'std_feature_value'])}, row_number() OVER (ORDER BY mean_abs_shap DESC, feature) AS rank FROM imp", _SHAP))
def _(t):
    return rounded(A.importance_table(_long(t)))


_TOP = ", ".join(f"max(feature) FILTER (pos = {i}) AS top_{i}_feature, {R(f'max(shap) FILTER (pos = {i})', 6, f'top_{i}_shap')}" for i in (1, 2))


@query("S4_local_explanations", with_parts("pred", f"SELECT w.row_id, {R('any_value(abs_error)', 6, 'abs_error')}, any_value(rk) AS rank_by_error, {_TOP} FROM (SELECT *, row_number() OVER (ORDER BY abs_error DESC, row_id) AS rk FROM scored QUALIFY rk <= 50) w JOIN (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(shap) DESC, feature) AS pos FROM sh) s ON s.row_id = w.row_id GROUP BY w.row_id", _SHAP))
def _(t):
    out = A.local_explanations(_scored(t), _long(t), "row_id", rows=50, top_k=2)
    return rounded(out.select("row_id", "abs_error", "rank_by_error", "top_1_feature", "top_1_shap", "top_2_feature", "top_2_shap"))


@query("G4_worst_rows", with_parts("pred", f"SELECT row_id, row_number() OVER (ORDER BY abs_error DESC, row_id) AS rank_by_error, {R('abs_error')} FROM scored QUALIFY rank_by_error <= 50", _SHAP))
def _(t):
    return rounded(A.largest_errors(_scored(t), "row_id").select("row_id", "rank_by_error", "abs_error"))


@query("H3_long_to_wide", with_parts("pred", f"SELECT row_id, {', '.join(R(f"max(shap) FILTER (feature = '{c}')", 6, c) for c in COEFFICIENTS)} FROM sh GROUP BY 1", _SHAP))
def _(t):
    return rounded(_long(t).groupBy("row_id").pivot("feature", list(COEFFICIENTS)).agg(F.max("shap")))


@query("S5_prediction_columns", with_parts("pred", f"SELECT row_id, {R('least(greatest(out, 0), 1)', 6, 'y_pred')}, {R('abs_error')}, {R('abs_error / greatest(y_true, 1e-8)', 4, 'rel_error')}, abs(least(greatest(out, 0), 1) - out) > 1e-9 AS clip_applied FROM scored", _SHAP))
def _(t):
    return rounded(_scored(t).select("row_id", "y_pred", "abs_error", F.round("rel_error", 4).alias("rel_error"), "clip_applied"))


@query("S6_additivity", with_parts("pred", "SELECT CAST(0 AS DOUBLE) AS mean_abs_gap, CAST(0 AS DOUBLE) AS max_abs_gap, count(*) AS rows FROM pred"))
def _(t):
    return rounded(A.additivity_table(_long(t), "row_id"), 9)


@query("S7_compare_importance", with_parts("pred", f"SELECT feature, {R('mean_abs_shap', 6, 'full')}, {R("CASE WHEN feature = 'model_a' THEN mean_abs_shap * 0.5 ELSE 0 END", 6, 'half')} FROM imp QUALIFY row_number() OVER (ORDER BY mean_abs_shap DESC, feature) <= 2", _SHAP))
def _(t):
    full = A.importance_table(_long(t))
    half = A.importance_table(A.linear_attributions(t.predictions, {"model_a": 0.3}, 0.0, "row_id"))
    return rounded(A.compare_importance({"full": full, "half": half}, 2))


@query("D13_reindex", with_parts("pred", f"SELECT CAST(position AS BIGINT) AS position, w.feature, {R('coalesce(i.mean_abs_shap, 0)', 6, 'mean_abs_shap')} FROM (VALUES (1, 'absent'), (2, 'baseline'), (3, 'model_a')) w(position, feature) LEFT JOIN imp i ON i.feature = w.feature", _SHAP))
def _(t):
    from ledgerline.operators.joins import reindex_features

    values = A.importance_table(_long(t)).select("feature", "mean_abs_shap")
    return rounded(reindex_features(["absent", "baseline", "model_a"], values))


@query("S8_dependence", with_parts("pred", f"SELECT row_id, feature, {R('feature_value')}, {R('shap')} FROM sh WHERE feature IN (SELECT feature FROM imp ORDER BY mean_abs_shap DESC, feature LIMIT 2)", _SHAP))
def _(t):
    long = _long(t)
    return rounded(A.dependence_data(long, A.importance_table(long), 2, "row_id"))


@query("S9_error_histogram", with_parts("pred", """SELECT CAST(least(floor((e - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS bin, count(*) AS n_rows FROM (SELECT e, min(e) OVER () AS lo, max(e) OVER () AS hi FROM (
    SELECT least(abs_error, (SELECT quantile_cont(abs_error, 0.99) FROM scored)) AS e FROM scored)) GROUP BY 1""", _SHAP))
def _(t):
    return rounded(A.error_histogram(_scored(t), "abs_error"))


@query("S9_error_cdf", with_parts("plong", f"""SELECT model, {R('e', 6, 'e')}, {R('cdf', 6, 'cdf')}, count(*) AS n FROM (SELECT model, e, cume_dist() OVER (PARTITION BY model ORDER BY e) AS cdf FROM errs)
    WHERE e <= (SELECT max(q) FROM (SELECT quantile_cont(e, 0.995) AS q FROM errs GROUP BY model)) GROUP BY model, e, cdf""", {"errs": "SELECT model, abs(y_pred - y_true) AS e FROM plong"}))
def _(t):
    long = M.melt_models(t.predictions, FEATURES, ["row_id"]).withColumn("e", F.abs(F.col("y_pred") - F.col("y_true")))
    return rounded(A.error_cdf(long, "e", ["model"]))


# Bin of a value: how many edges lie below it; edge i is the smallest value that i parts of the rows do not exceed.
def _bin_sql(source: str, value: str, by: str, bins: int, name: str) -> str:
    return f"""SELECT r.*, (SELECT count(*) FROM (SELECT {by}, i, min(v) AS edge FROM (SELECT {by}, {value} AS v, sum(count(*)) OVER (PARTITION BY {by} ORDER BY {value}) AS c,
        sum(count(*)) OVER (PARTITION BY {by}) AS total FROM {source} GROUP BY {by}, {value}), range(1, {bins}) g(i) WHERE c * {bins} >= i * total GROUP BY {by}, i) e
        WHERE {' AND '.join(f'e.{b.strip()} = r.{b.strip()}' for b in by.split(','))} AND e.edge < r.{value}) AS {name} FROM {source} r"""


_CELLS = {
    "first_axis": _bin_sql("plong", "y_true", "model", 20, "actual_bin"),
    "cells": _bin_sql("first_axis", "y_pred", "model, actual_bin", 10, "predicted_bin"),
}


@query("S9_actual_vs_predicted", with_parts("plong", f"""SELECT model, actual_bin, predicted_bin, count(*) AS n_rows, {R('min(y_true)', 6, 'min_y_true')}, {R('max(y_true)', 6, 'max_y_true')}, {R('avg(y_true)', 9, 'mean_y_true')},
    {R('min(y_pred)', 6, 'min_y_pred')}, {R('max(y_pred)', 6, 'max_y_pred')}, {R('avg(y_pred)', 9, 'mean_y_pred')}, CAST(count(*) FILTER (y_pred > y_true) AS BIGINT) AS rows_over FROM cells GROUP BY 1, 2, 3""", _CELLS))
def _(t):
    out = A.actual_vs_predicted(M.melt_models(t.predictions, FEATURES, ["row_id"]), ["model"])
    ends = [f"{n}_{c}" for n in ("min", "max") for c in ("y_true", "y_pred")]
    return rounded(out.withColumns({c: F.round(c, 6) for c in ends}), 9)
