"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Every query is planned and run once into a sink that takes all rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "parse_datetime", "clean_rows", "profile_columns", "infer_column_types", "detect_frequency", "bucket_aggregate", "resolve_duplicates",
    "fill_raw_rows", "reindex_calendar", "interpolate_linear", "hampel_filter", "iqr_outliers", "build_panel_standard", "data_health",
    "feature_matrix", "leaderboard_hourly", "leaderboard_daily", "leaderboard_monthly", "exp_smoothing", "arima", "trend_season",
    "evaluate_candidates", "final_forecast", "holiday_distance", "future_covariates", "lag_boosting_forecast", "latest_model_state",
    "events_from_logs", "runtime_estimate", "series_hash", "route_text", "experiment_leaderboard", "experiment_tuned",
)


def trees(kind: str, count: int):
    """Fit a tree model on the hourly panel and forecast a day."""
    def run(spark, folder):
        from tidecast.operators import trees as L
        from tidecast.operators.features import feature_matrix
        from tidecast.workload.base import Tables, hourly_zero
        panel = hourly_zero(Tables(spark, folder))
        matrix, names = feature_matrix(panel)
        model = getattr(L, kind)(matrix.cache(), names, trees=count, depth=2 if kind == "lag_boosting" else 6)
        return L.recursive_predict(model, panel, 24, "H")
    return run


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidecast.session import local_session
    from tidecast.workload import QUERIES
    spark = local_session("bench", cpus)
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()  # start the executors
    seconds = {}
    timed = {name: QUERIES[name] for name in HEADLINES} | {"forest_60_trees": trees("lag_forest", 60), "boosting_40_trees": trees("lag_boosting", 40)}
    for name, query in timed.items():
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
