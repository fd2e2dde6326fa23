"""Driver contract and the SQL oracle on the smallest test tables."""

import os

import pytest

from compare_oracle import compare

SF = "/root/testdata/sf0.001"
EXPECTED = set(
    "daily_agg dense_panel date_features seasonal_features lag_features rolling_features feature_table "
    "clean_numeric clean_dates centers items_by_center history_range demand_by_center top_items weekday_mean "
    "monthly_total monthly_by_series center_item_pivot summary profile naive_metrics best_model "
    "monthly_projection rule_forecast forecast_summary inventory column_moments ks_drift drift_report "
    "drift_alerts last_n_rows split_tail split_by_date date_bounds key_counts top_centers feature_preview "
    "best_run role_mapping profile_values future_features upload_projection clean_dirty_numeric clean_dirty_dates "
    "clean_dirty_labels date_rejects inventory_repeated_stock rule_forecast_keywords drift_sparse history_series "
    "upload_no_roles linear_forecast linear_backtest linear_metrics gbt_invariants sparse_features incremental_features csv_sales csv_rejects "
    "job_features job_drift job_forecast sorted_sink best_run_params rule_table_match rule_table_forecast rule_forecast_noise tree_forecast "
    "tree_backtest null_target_metrics cv_folds cv_linear_metrics ks_exact profile_sketch center_item_map".split()
)
ROWS_ONLY = {"gbt_forecast", "gbt_importance", "gbt_backtest", "gbt_metrics"}


def test_registry_keys():
    from __spark_entry__ import REGISTRY, SQL, oracle_sql, queries

    assert set(REGISTRY) == EXPECTED | ROWS_ONLY and set(REGISTRY) <= set(queries())
    assert set(SQL) == EXPECTED and set(SQL) <= set(oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0 and "rolling_std_14" in df.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_every_sql_query_matches_oracle(spark):
    res = compare(spark, SF, sorted(EXPECTED), verbose=True)
    bad = {k: v for k, v in res.items() if v != "OK"}
    assert not bad, bad
