"""Results that were wrong once."""
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast import CleaningConfig, PanelSpec
from tidecast.operators.additive import trend_season
from tidecast.operators.forecasters import arima
from tidecast.operators.scenario import model_gap_table
from tidecast.plans.backtest import dedupe_candidates
from tidecast.plans.build import build_panel
from tidecast.sources.store import delete_run, load_run, save_run
from tidecast.sources.tables import clean_header, delimiter_of, encoding_of, read_table


def test_text_covariates_are_numbers_or_flags(spark):
    rows = [("s", f"2024-01-{d:02d}", str(d), "yes" if d % 2 else "no", f"{d}.5") for d in range(1, 11)]
    df = spark.createDataFrame(rows, "series_id string, day string, value string, promo string, price string")
    got = build_panel(df, PanelSpec(("series_id",), "day", "value", "D"), covariates=("promo", "price")).panel.orderBy("t").collect()
    assert [(r["promo"], r["price"]) for r in got] == [(float(d % 2), d + 0.5) for d in range(1, 11)]


def test_further_time_patterns_reach_the_panel(spark):
    df = spark.createDataFrame([("s", f"{d:02d}~01~2024", float(d)) for d in range(1, 6)], "series_id string, day string, value double")
    spec = PanelSpec(("series_id",), "day", "value", "D")
    assert build_panel(df, spec).panel.count() == 0
    assert build_panel(df, spec, CleaningConfig(extra_formats=("dd~MM~yyyy",))).panel.count() == 5


@pytest.mark.parametrize("level", [0.0, 1e6, 1e9])
def test_band_of_the_additive_model_does_not_depend_on_the_level(panel_of, level):
    r = np.random.default_rng(3)
    y = [level + 0.1 * i + float(e) for i, e in enumerate(r.normal(0, 0.01, 200))]
    row = trend_season(panel_of({"s": y}), 3, "D", seasons=()).first()
    assert abs((row["upper"] - row["lower"]) / 2 - 0.0128) < 0.002


def test_runs_with_odd_names_are_deleted(spark, tmp_path):
    root = str(tmp_path / "runs")
    for name in ("x:y", "p=q%r", "2024-01-01 10:00:00", "plain"):
        save_run({"leaderboard": spark.range(2), "forecast": spark.range(3)}, root, name)
    for name in ("x:y", "p=q%r", "2024-01-01 10:00:00"):
        assert delete_run(spark, root, name) == 2
        assert all(df.count() == 0 for df in load_run(spark, root, name).values())
    assert load_run(spark, root, "plain")["forecast"].count() == 3 and delete_run(spark, root, "none") == 0


def test_headers_stay_distinct():
    assert clean_header(["a", "a", "a_2", None, " b ", "a"]) == ["a", "a_3", "a_2", "column_4", "b", "a_4"]


def test_files_are_judged_by_all_their_lines(spark, tmp_path):
    lines = spark.range(3000).select(F.when(F.col("id") == 2999, "x;y;z").otherwise("a,b;c;d").alias("value"))
    assert delimiter_of(lines) == ";"
    (tmp_path / "late.csv").write_bytes(b"a,b\n" * 2500 + "中,1\n".encode("gb18030"))
    assert encoding_of(spark.read.text(str(tmp_path / "late.csv"))) == "GB18030"


def test_files_with_other_columns_are_refused(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "2.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ValueError, match="other columns"):
        read_table(spark, str(tmp_path))


def test_gap_table_keeps_all_keys(spark):
    board = spark.createDataFrame([("a", "b", "naive", 1, 2.0, 0.1, 0.2)], "country string, shop string, model_id string, rank int, mae double, fit_seconds double, predict_seconds double")
    assert model_gap_table(board, keys=("country", "shop")).columns[:2] == ["country", "shop"]


def test_bounds_of_candidates_are_refused_not_cut(spark):
    grid = spark.createDataFrame([("s", "D", 5000, 0, "900", "moving_average")], "series_id string, freq string, n int, _raw int, param string, model_id string")
    with pytest.raises(Exception, match="window above 720"):
        dedupe_candidates(grid).collect()


def test_arima_with_a_moving_average_part(panel_of):
    r = np.random.default_rng(11)
    e = r.normal(0, 1, 3000)
    z = np.zeros(3000)
    for i in range(1, 3000):
        z[i] = 0.7 * z[i - 1] + e[i] + 0.4 * e[i - 1]
    panel = panel_of({"s": list(50 + np.cumsum(z))}, step=timedelta(days=1), start=datetime(2000, 1, 1).isoformat())
    got = [x["predicted"] for x in arima(panel, 3, "D").orderBy("step").collect()]
    # the true recursion: the next change is 0.7 of the last one and 0.4 of the last shock
    first = 0.7 * z[-1] + 0.4 * e[-1]
    want = 50 + np.cumsum(z)[-1] + np.cumsum([first, 0.7 * first, 0.49 * first])
    assert np.allclose(got, want, atol=0.35)
