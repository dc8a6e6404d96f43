"""CSV in, experiment, store, replay, delete - for several targets at once."""
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidecast import CleaningConfig, PanelSpec, melt_targets, run_experiment
from tidecast.plans.experiment import check_frequency
from tidecast.sources import store
from tidecast.sources.tables import read_table


@pytest.fixture
def table(spark, tmp_path):
    path = tmp_path / "daily.csv"
    lines = ["day,sales,visits"]
    for i in range(60):
        d = date(2024, 1, 1) + timedelta(days=i)
        lines.append(f"{d:%Y/%m/%d},\"{1000 + 2 * i:,}\",{'' if i == 20 else 50 + 10 * (i % 7)}")
    lines += ["not-a-date,1,1", "2024-02-05,2000,70"]
    path.write_text("\n".join(lines))
    return read_table(spark, str(path), sep=",").withColumn("row", F.monotonically_increasing_id())


SPEC = PanelSpec(("series_id",), "day", "value", "D", "row")


def test_whole_run(spark, table, tmp_path):
    rows = melt_targets(table, ["sales", "visits"], keep=("day", "row"))
    assert {r["freq"] for r in check_frequency(rows, SPEC).collect()} == {"D"}
    run = run_experiment(rows, SPEC, ["naive", "seasonal_naive", "moving_average", "exp_smoothing"], 7, 7, CleaningConfig(duplicates="first"), tune="fast")
    best = {r["series_id"]: r["model_id"] for r in run.leaderboard.where("rank = 1").collect()}
    assert best == {"sales": "exp_smoothing", "visits": "seasonal_naive"}
    ahead = [r["predicted"] for r in run.forecast.where("series_id = 'sales'").orderBy("step").collect()]
    assert ahead == pytest.approx([1000 + 2 * i for i in range(60, 67)])
    d = {r["series_id"]: r for r in run.built.diagnostics.collect()}
    assert d["visits"]["missing_target"] == 1 and d["visits"]["invalid_time"] == 1 and d["sales"]["duplicate_time"] == 1
    assert run.skipped.count() == 0 and run.health.count() == 2
    assert run.trials.where("selected").count() == 6

    root = str(tmp_path / "runs")
    store.save_run(run.tables(), root, "first")
    again = store.load_run(spark, root, "first")
    assert sorted((r["series_id"], r["model_id"], r["rank"]) for r in again["leaderboard"].collect()) == \
        sorted((r["series_id"], r["model_id"], r["rank"]) for r in run.leaderboard.collect())
    assert store.delete_run(spark, root, "first") == len(run.tables()) - 1  # no series was skipped


def test_arguments_are_checked(table):
    with pytest.raises(ValueError):
        run_experiment(melt_targets(table, ["sales"], keep=("day", "row")), SPEC, ["naive"], 0, 7)
    with pytest.raises(ValueError):
        CleaningConfig(missing="guess")
