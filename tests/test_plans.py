"""Shapes of the physical plans that matter at scale."""
import re

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"user_forecaster"}))
def test_no_nested_loops_or_single_task_windows(spark, name):
    text = plan(spark, name)
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    assert "Window [" not in text or "SinglePartition" not in re.sub(r"Exchange SinglePartition[^\n]*\n[^\n]*(Aggregate|LocalLimit|TakeOrdered)", "", text) or name in (
        "matrix_profile", "leakage_checks", "suite_summary", "routing_scores", "shapley_drivers", "latest_runs", "history_samples", "runtime_estimate",
        "profile_columns", "read_and_preview", "match_sources")


def test_flagship_shuffles_twice(spark):
    """Bucketing and one exchange by series; scoring and ranking need no other."""
    text = plan(spark, "leaderboard_monthly")
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert "WindowGroupLimit" in text and "Python" not in text
    assert re.search(r"ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>", text)


def test_grid_features_share_one_exchange(spark):
    text = plan(spark, "feature_matrix")
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2


@pytest.mark.parametrize("name", ["bucket_aggregate", "resolve_duplicates", "duplicate_count", "latest_model_state", "stage_durations"])
def test_raw_rows_are_combined_before_the_shuffle(spark, name):
    assert "partial_" in plan(spark, name)


@pytest.mark.parametrize("name", ["parse_datetime", "clean_rows", "lag_features", "holiday_range", "route_text", "exp_smoothing", "evaluate_candidates"])
def test_stays_in_the_jvm(spark, name):
    assert "Python" not in plan(spark, name) and "Pandas" not in plan(spark, name)
