"""Registered queries against their SQL at the smallest scale; `tests/compare.py` runs all of them at any scale."""

import pytest
from compare import check, connect

QUICK = """
A6_unnest_statements A8_dataset_columns A10_ticker_list B1_normalize_ticker B3_to_number B4_safe_division B7_trade_date B14_news_key B18_half_even
C3_keep_last C8_duplicate_keys C9_cleaning_audit C10_entity_period_audit C14_latest_years D1_asof_backward D3_forward_window D5_merge_fill D8_align_predictions
E3_coverage E8_feature_profile E9_quantiles F9_feature_panel F10_asof_features F14_average_ranks F15_ecdf G2_top_fraction H2_wide_to_long I2_parse_score_list
K1_index_by_year K2_base_ratios K5_growth L6_valuation_status L8_future_drawdown L9_peak_and_trough L10_label_status L14_three_splits M1_attach_news
M2_attach_audit M6_news_features N2_latest_years_split N7_time_kfold N12_target_correlation N20_ticker_weights O9_guarded_prediction P5_spearman P8_event_metrics
Q6_wilcoxon Q9_benjamini_hochberg Q10_calibration Q12_kruskal Q13_dunn R1_ks R2_psi R5_quantile_buckets S3_importance S9_error_histogram T3_day_bars
""".split()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, small, con, name):
    from __spark_entry__ import oracle_sql, queries

    status, n, _, note = check(spark, con, name, queries()[name], oracle_sql()[name], small)
    assert status == "ok" and n > 0, note


def test_entry_has_rows(spark):
    from __spark_entry__ import entry

    assert len(entry(spark).take(5)) == 5


def test_every_sql_has_a_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
