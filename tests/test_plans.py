"""Plan audit: no query may need a nested-loop or Cartesian join, and scans stay pruned."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
NAMES = [
    "join_01_pair_alignment", "join_04_benchmark_alignment", "join_08_alert_exposure", "join_09_monitored_symbols", "join_11_alert_fan_out", "join_12_event_window", "join_16_trade_list", "join_17_batch_grid",
    "join_18_threshold_lookup", "join_19_cached_match", "ret_16_period_return", "agg_11_asset_contributions", "agg_14_performance_block", "agg_21_monthly_fragility", "agg_28_return_histogram",
    "cor_04_snapshot_batch", "cor_07_episode_statistics", "reg_05_portfolio_regime", "alc_14_best_subset", "sim_02_scenario_merge", "sim_05_portfolio_fan", "sim_10_worst_case_shock", "evl_09_evaluation_summary",
    "flt_03_saved_screens", "alt_02_zscore_anomaly", "alt_10_notification_decision", "alt_13_auto_mute", "str_06_registry_enrichment",
]


def plan_of(spark, name: str) -> str:
    return entry_module.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_joins_have_keys(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python


def test_the_panel_is_shuffled_once(spark):
    """Alignment, returns and per-date sums share one layout by portfolio."""
    plan = plan_of(spark, "ret_04_portfolio_constant_weight")
    after_join = plan.split("REPARTITION_BY_COL")[0]
    assert "Exchange" not in after_join.replace("Exchange hashpartitioning(portfolio_id", "", 1)


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry_module.queries()["join_05_benchmark_fallback"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_comment" not in plan
    assert "PushedFilters" in plan or "DataFilters" in plan
