import math
import random
import statistics

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import values
from tidecast.operators import features as X
from tidecast.operators import forecasters as M
from tidecast.operators import scoring as S
from tidecast.operators import trees as L
from tidecast.operators.additive import trend_season
from tidecast.operators.custom import register_forecaster, run_forecaster
from tidecast.plans import backtest as B
from tidecast.spec import FeatureConfig


def test_first_matrix_row(panel_of):
    m, names = X.feature_matrix(panel_of({"a": range(1, 41)}))
    rows = m.orderBy("t").collect()
    first = rows[0]
    assert len(rows) == 33 and first["y"] == 8
    assert [first[n] for n in names[:4]] == [7, 6, 5, 1]
    assert (first["rolling_mean_3"], first["rolling_mean_7"]) == (6, 4)
    assert first["rolling_std_7"] == pytest.approx(statistics.pstdev(range(1, 8)))
    assert X.leakage_checks(m, names).first().asDict() == {"checked_rows": 33, "not_increasing": 0, "not_finite": 0, "missing_target": 0}


def test_features_ignore_the_future(panel_of):
    base = list(range(30))
    changed = base[:20] + [999] * 10
    a, names = X.feature_matrix(panel_of({"a": base}))
    b, _ = X.feature_matrix(panel_of({"a": changed}))
    cut = F.col("time_index") <= 20
    assert a.where(cut).select("t", *names).orderBy("t").collect() == b.where(cut).select("t", *names).orderBy("t").collect()


def test_chunked_features_are_the_same(panel_of):
    rng = random.Random(1)
    p = panel_of({"a": [rng.random() for _ in range(200)], "b": [rng.random() for _ in range(90)]}, start="2023-12-20")
    plain = X.rolling_features(X.lag_features(p)).orderBy("series_id", "t").toPandas()
    cut = X.chunked_features(p, "D", chunk=16).orderBy("series_id", "t").select(*plain.columns).toPandas()
    pd.testing.assert_frame_equal(plain, cut)


def test_split_and_metrics(panel_of, spark):
    s = S.holdout_split(panel_of({"a": range(20)}), 5)
    assert values(s.where("is_test")) == [15, 16, 17, 18, 19] and values(s.where("is_test"), "step") == [1, 2, 3, 4, 5]
    pts = spark.createDataFrame([("a", "m", 120.0, 100.0), ("a", "m", 80.0, 100.0), ("z", "m", 0.0, 1.0)], "series_id string, model_id string, actual double, predicted double")
    got = {r["series_id"]: r for r in S.error_metrics(pts).collect()}
    assert [got["a"][m] for m in S.METRICS] == [20, 400, 20, 0.2] and got["z"]["wape"] is None
    assert [r["residual"] for r in S.with_residuals(pts).where("series_id = 'a'").collect()] == [20, -20]


def test_baselines(panel_of):
    p = panel_of({"a": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], "short": [4, 6]})
    assert values(M.naive(p, 3, "D"), "predicted", "a") == [10, 10, 10]
    assert values(M.seasonal_naive(p, 9, "D"), "predicted", "a") == [4, 5, 6, 7, 8, 9, 10, 4, 5]
    assert values(M.seasonal_naive(p, 2, "D"), "predicted", "short") == [6, 6]
    assert values(M.moving_average(p, 2, "D", 4), "predicted", "a") == [8.5, 8.5]
    assert values(M.moving_average(p, 1, "D", 7), "predicted", "short") == [5]


def test_smoothing_follows_a_line(panel_of):
    p = panel_of({"line": [100 + 2 * d for d in range(1, 32)], "flat": [5, 5, 5, 5]})
    out = M.exp_smoothing(p, 3, "D")
    assert values(out, "predicted", "line") == pytest.approx([164, 166, 168])
    assert values(out, "predicted", "flat") == pytest.approx([5, 5, 5])
    wide = M.exp_smoothing(p, 1, "D", band="level").where("series_id = 'line'").first()
    sd = statistics.stdev([100 + 2 * d for d in range(1, 32)])
    assert wide["upper"] - wide["predicted"] == pytest.approx(1.96 * sd)


def test_arima_finds_an_autoregression(panel_of):
    rng = random.Random(7)
    y = [0.0]
    for _ in range(600):
        y.append(0.8 * y[-1] + rng.gauss(0, 1))
    p = panel_of({"ar": y, "tiny": [1, 2, 3]}, start="2020-01-01")
    out = M.arima(p, 4, "D", p=1, d=0, q=0)
    got = values(out, "predicted", "ar")
    mean = statistics.fmean(y)
    ratio = [(b - mean) / (a - mean) for a, b in zip(got, got[1:])]
    assert ratio == pytest.approx([0.8] * 3, abs=0.08)
    assert all(math.isfinite(v) for v in values(out, "predicted", "tiny"))


def test_trend_season_recovers_both(panel_of):
    y = [10 + 0.5 * i + 3 * math.sin(2 * math.pi * i / 7) for i in range(140)]
    out = trend_season(panel_of({"a": y}), 14, "D", seasons=((7, 3),))
    want = [10 + 0.5 * i + 3 * math.sin(2 * math.pi * i / 7) for i in range(140, 154)]
    assert values(out, "predicted") == pytest.approx(want, abs=1e-3)


def test_backtest_matches_the_stored_benchmark(panel_of):
    """31 clean days of 100 + 2 d with 14 test points: smoothing 0, naive 15, moving average 21."""
    board, points = B.backtest(panel_of({"a": [100 + 2 * d for d in range(1, 32)]}), ["naive", "moving_average", "exp_smoothing"], 14, "D")
    rows = {r["model_id"]: r for r in board.collect()}
    assert rows["exp_smoothing"]["mae"] == pytest.approx(0, abs=1e-9)
    assert (rows["naive"]["mae"], rows["moving_average"]["mae"]) == (15, 21)
    assert [rows[m]["rank"] for m in ("exp_smoothing", "naive", "moving_average")] == [1, 2, 3]
    assert points.count() == 42


def test_one_failing_model_does_not_stop_the_rest(panel_of, monkeypatch):
    monkeypatch.setitem(M.ARRAY_MODELS, "broken", lambda train, horizon, **_: F.array_repeat(F.lit(float("nan")), horizon))
    monkeypatch.setattr(B, "points_needed", lambda m, f, p: 1 if m == "broken" else M.points_needed(m, f, p))
    board, points = B.backtest(panel_of({"a": range(40)}), ["naive", "broken"], 5, "D")
    rows = {r["model_id"]: r for r in board.collect()}
    assert rows["naive"]["status"] == "success" and rows["naive"]["rank"] == 1
    assert rows["broken"]["status"] == "failed" and rows["broken"]["rank"] is None and rows["broken"]["error"]
    assert {r["model_id"] for r in points.collect()} == {"naive"}


def test_unknown_models_are_refused(panel_of):
    with pytest.raises(ValueError, match="unknown"):
        B.backtest(panel_of({"a": range(9)}), ["nothing"], 2, "D")


def test_short_series_are_listed(panel_of):
    ok, listed = S.split_eligible(panel_of({"a": range(50), "b": range(4), "c": range(2)}), 10)
    assert {r["series_id"] for r in ok.collect()} == {"a"}
    assert {r["series_id"]: r["reason"] is None for r in listed.collect()} == {"a": True, "b": False, "c": False}


def test_tuning_selects_one_trial_no_worse_than_the_default(panel_of):
    rng = random.Random(2)
    p = panel_of({s: [50 + 10 * math.sin(2 * math.pi * i / 7) + rng.random() for i in range(90)] for s in ("a", "b")})
    trials = B.select_candidate(B.evaluate_candidates(p, ["moving_average", "seasonal_naive", "exp_smoothing"], 7, "D"))
    rows = trials.collect()
    for key in {(r["series_id"], r["model_id"]) for r in rows}:
        mine = [r for r in rows if (r["series_id"], r["model_id"]) == key]
        chosen = [r for r in mine if r["selected"]]
        assert len(chosen) == 1 and chosen[0]["mae"] <= next(r["mae"] for r in mine if r["round"] == 1)
    assert B.tuning_split(panel_of({"a": range(10)}), 7).first()["reason"] is not None


def test_candidate_lists(panel_of):
    meta = panel_of({"a": range(100)}).groupBy("series_id").agg(F.count("*").cast("int").alias("n")).withColumn("freq", F.lit("D"))
    got = [r["param"] for r in B.dedupe_candidates(B.candidate_grid(meta, "seasonal_naive")).orderBy("round").collect()]
    assert got == ["7", "3", "6", "8", "14", "1", "28"]
    got = [r["param"] for r in B.dedupe_candidates(B.candidate_grid(meta, "moving_average")).orderBy("round").collect()]
    assert got == ["7", "3", "5", "14", "21", "28"]


@pytest.fixture(scope="module")
def promo(spark):
    """A driver known ahead lifts the value; the same series with noise instead."""
    from datetime import datetime, timedelta
    rng = random.Random(43)
    rows = []
    for i in range(240):
        promo = 1.0 if i % 9 in (2, 3) else 0.0
        day = datetime(2024, 1, 1) + timedelta(days=i)
        rows.append(("a", day, 100 + 0.08 * i + 38 * promo + rng.uniform(-2, 2), promo))
    return spark.createDataFrame(rows, "series_id string, t timestamp_ntz, y double, promo double")


def _forest_mae(panel, cfg, future=None):
    split = S.holdout_split(panel, 14)
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    m, names = X.feature_matrix(train.drop("is_test", "step"), cfg)
    model = L.lag_forest(m, names, cfg, trees=20, depth=6)
    fut = test.select("series_id", "step", "promo") if cfg.covariates else None
    pred = L.recursive_predict(model, train, 14, "D", fut)
    return S.error_metrics(S.pair_predictions(test, pred)).first()["mae"], model, m


def test_known_covariate_lifts_the_forest(promo):
    plain, _, _ = _forest_mae(promo, FeatureConfig())
    lifted, _, _ = _forest_mae(promo, FeatureConfig(covariates=("promo",)))
    assert lifted < 0.85 * plain


def test_tree_walk_equals_the_model_and_shapley_adds_up(promo, spark):
    cfg = FeatureConfig(covariates=("promo",))
    for make in (lambda m, n: L.lag_forest(m, n, cfg, trees=5, depth=4), lambda m, n: L.lag_boosting(m, n, cfg, trees=4, depth=2)):
        m, names = X.feature_matrix(promo, cfg)
        model = make(m, names)
        walked = L.recursive_predict(model, promo, 5, "D", with_features=True)
        again = model.predict(walked, "again")
        assert again.select(F.max(F.abs(F.col("again") - F.col("predicted")))).first()[0] < 1e-9
        rows = L.last_rows(m, 4)
        points = L.shapley_points(model, rows, m, ["series_id", "t"])
        total = {r["t"]: r["s"] for r in points.groupBy("t").agg(F.sum("contribution").alias("s")).collect()}
        mean = m.agg(*[F.avg(n).alias(n) for n in names])
        base = model.predict(mean).first()["predicted"]
        for r in model.predict(rows).collect():
            assert total[r["t"]] == pytest.approx(r["predicted"] - base)
    imp = L.feature_importance(spark, model).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1) and [r["rank"] for r in imp] == list(range(1, len(imp) + 1))


def test_residual_interval_is_null_without_spread(panel_of, spark):
    fit = spark.createDataFrame([("a", "naive", 0.0), ("a", "naive", 0.0)], "series_id string, model_id string, residual double")
    out = M.residual_interval(fit, M.naive(panel_of({"a": [1, 1]}), 1, "D")).first()
    assert out["lower"] is None and out["upper"] is None


def test_user_forecaster_isolated(panel_of):
    def fn(history, horizon):
        if len(history) < 3:
            raise RuntimeError("too short")
        return pd.DataFrame({"predicted": [history["y"].max()] * horizon})

    register_forecaster("largest", fn)
    rows = run_forecaster("largest", panel_of({"a": [1, 5, 2], "b": [1, 2]}), 2).collect()
    assert sorted(r["predicted"] for r in rows if r["series_id"] == "a") == [5, 5]
    assert [r["error"] for r in rows if r["series_id"] == "b"] == ["too short"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=4, max_size=30), st.integers(1, 3))
def test_split_is_complete_and_ranks_are_a_permutation(panel_of, ys, test):
    p = panel_of({"a": ys})
    s = S.holdout_split(p, test)
    assert values(s.where("is_test")) == ys[-test:] and values(s.where(~F.col("is_test"))) == ys[:-test]
    board, _ = B.backtest(p, ["naive", "moving_average", "seasonal_naive"], test, "D")
    rows = board.collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3]
    by_rank = sorted(rows, key=lambda r: r["rank"])
    assert all(a["mae"] <= b["mae"] for a, b in zip(by_rank, by_rank[1:]))
