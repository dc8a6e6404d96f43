"""Search over all models, ARIMA from moments, packed trees, exact Shapley values, trends with a prior, failures of single models."""
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.operators import additive as A
from tidecast.operators import arima as R
from tidecast.operators import packed as P
from tidecast.operators import trees as L
from tidecast.operators.custom import register_forecaster
from tidecast.operators.features import feature_matrix
from tidecast.operators.scoring import error_metrics, pair_predictions
from tidecast.plans import backtest as B
from tidecast.plans import experiment as E
from tidecast.spec import CleaningConfig, FeatureConfig, PanelSpec

ALL_ORDERS = [(1, 1, 1), (2, 1, 1), (2, 1, 2), (3, 1, 1), (1, 0, 1), (1, 1, 2), (1, 0, 0), (1, 1, 0), (3, 0, 0), (0, 1, 1), (2, 2, 1)]


def wave(seed, n):
    r = random.Random(seed)
    y = [20.0]
    for i in range(n - 1):
        y.append(0.6 * y[-1] + 8 + 3 * math.sin(i / 3) + r.gauss(0, 1))
    return y


@pytest.mark.parametrize("n", [9, 14, 30, 200])
def test_orders_of_a_search_equal_orders_alone(n):
    y = wave(n, n)
    together = R.forecasts(y, ALL_ORDERS, 6)
    for order, (made, note) in zip(ALL_ORDERS, together):
        alone, told = R.forecasts(y, [order], 6)[0]
        assert made == pytest.approx(alone, rel=1e-7) and note == told


def test_pure_orders_are_least_squares():
    y = np.array(wave(3, 60))
    z = y - y.mean()
    x = np.column_stack([z[2:-1], z[1:-2], z[:-3]])
    c = np.linalg.lstsq(x, z[3:], rcond=None)[0]
    past = list(z)
    for _ in range(4):
        past.append(c @ past[:-4:-1])
    assert R.forecasts(y, [(3, 0, 0)], 4)[0][0] == pytest.approx(np.array(past[-4:]) + y.mean())


def test_short_series_keep_their_moving_average():
    y = wave(5, 11)
    (mixed, note), (plain, _) = R.forecasts(y, [(1, 1, 1), (1, 1, 0)], 3)
    assert note is None and not np.allclose(mixed, plain)
    ar, ma = R.innovations(np.array(y) - np.mean(y), 1, 1)
    assert ar.shape == ma.shape == (1,) and abs(ma[0]) > 1e-6


def test_innovations_find_a_long_series_own_parts():
    r = np.random.default_rng(4)
    e = r.normal(size=40_000)
    z = np.zeros_like(e)
    for t in range(1, len(e)):
        z[t] = 0.7 * z[t - 1] + e[t] + 0.4 * e[t - 1]
    ar, ma = R.innovations(z, 1, 1)
    assert ar == pytest.approx([0.7], abs=0.05) and ma == pytest.approx([0.4], abs=0.08)
    ar, ma = R.innovations(e[1:] + 0.5 * e[:-1], 0, 1)
    assert len(ar) == 0 and 0.3 < ma[0] < 0.6


def test_changed_orders_and_fallbacks_are_told(panel_of):
    p = panel_of({"short": wave(1, 9), "long": wave(2, 60), "flat": [4.0] * 20})
    board, _ = B.backtest(p, ["naive", ("arima", {"p": 2, "d": 1, "q": 1})], 3, "D")
    told = {(r["series_id"], r["model_id"]): r["warnings"] for r in board.collect()}
    assert told["short", "arima"] == [R.REDUCED.format(1, 1)] and told["long", "arima"] == [] and told["short", "naive"] == []
    assert R.forecasts([3.0, 5.0], [(2, 0, 2)], 2)[0][1].startswith("ARIMA fitting failed")
    run = E.run_experiment(p.select("series_id", F.col("t").cast("string").alias("day"), F.col("y").cast("string").alias("v")), PanelSpec(("series_id",), "day", "v", "D"),
                           ["arima", "trend_season"], 3, 3, CleaningConfig(missing="drop", fill_steps=False))
    assert {r["series_id"]: r["warnings"] for r in run.leaderboard.where("model_id = 'arima'").collect()}["short"] == [R.REDUCED.format(1, 1)]


# -- packed trees ---------------------------------------------------------------

@pytest.fixture(scope="module")
def eight(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8))
    y = x[:, 0] * 2 + np.where(x[:, 1] > 0, x[:, 2], -x[:, 3]) + np.sin(3 * x[:, 4]) + 0.1 * r.normal(size=300)
    names = [f"x{i}" for i in range(8)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y, series_id="a", t=range(300)))
    return df.coalesce(1).cache(), names, x


def brute(trees, x, reference=None):
    """Shapley values from all coalitions; an absent feature follows both branches by their rows, or takes the reference's value."""
    def value(row, present):
        if reference is not None:
            row = np.where([i in present for i in range(len(row))], row, reference)
            present = set(range(len(row)))

        def down(node):
            f = trees["feature"][node]
            if f < 0:
                return trees["value"][node]
            left, right = trees["left"][node], trees["right"][node]
            if f in present:
                return down(left if row[f] <= trees["cut"][node] else right)
            a, b = trees["count"][left], trees["count"][right]
            return (a * down(left) + b * down(right)) / (a + b)
        return sum(w * down(r) for r, w in zip(trees["roots"], trees["weight"]))

    n, out = x.shape[1], np.zeros(x.shape)
    for i, row in enumerate(x):
        v = {s: value(row, set(s)) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
        for j in range(n):
            for s, a in v.items():
                if j not in s:
                    share = math.factorial(len(s)) * math.factorial(n - 1 - len(s)) / math.factorial(n)
                    out[i, j] += share * (v[tuple(sorted((*s, j)))] - a)
    return out


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_shapley_equals_all_coalitions(spark, eight, kind):
    df, names, x = eight
    cfg = FeatureConfig()
    model = L.lag_forest(df, names, cfg, trees=20, depth=5) if kind == "forest" else L.lag_boosting(df, names, cfg, trees=20, depth=3)
    trees = P.unpacked(r.asDict() for r in L.packed(model, spark).orderBy("tree").collect())
    assert P.tree_values(trees, x) == pytest.approx([r["predicted"] for r in model.predict(df).orderBy("t").collect()])
    paths, mean = P.leaf_paths(trees), x.mean(0)
    assert P.tree_shapley(paths, x[:2]) == pytest.approx(brute(trees, x[:2]), abs=1e-9)
    assert P.tree_shapley(paths, x[:2], mean) == pytest.approx(brute(trees, x[:2], mean), abs=1e-9)
    assert P.tree_shapley(paths, x).sum(1) == pytest.approx(P.tree_values(trees, x) - P.expected_value(paths))
    points = L.shapley_points(model, df.where("t < 5"), None, ["t"])
    assert points.count() == 5 * 8
    got = {(r["t"], r["feature"]): (r["value"], r["contribution"]) for r in points.collect()}
    want = P.tree_shapley(paths, x[:5])
    assert all(got[t, f"x{j}"] == (pytest.approx(x[t, j]), pytest.approx(want[t, j])) for t in range(5) for j in range(8))
    plan = points._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1


def test_large_forests_pass_in_blocks(panel_of, monkeypatch, spark):
    cfg = FeatureConfig()
    panel = panel_of({s: wave(i, 60) for i, s in enumerate("abc")})
    m, names = feature_matrix(panel, cfg)
    model = L.lag_forest(m, names, cfg, trees=7, depth=5)
    small = L.recursive_predict(model, panel, 3, "D", with_features=True).orderBy("series_id", "step").collect()
    told = L.shapley_points(model, L.last_rows(m, 4), None, ["series_id", "t"]).orderBy("series_id", "t", "feature").collect()
    model.held.clear()
    monkeypatch.setattr(P, "MOST_BYTES", 0)
    monkeypatch.setattr(P, "BLOCK_BYTES", 3000)
    L.packed(model, spark)
    assert L._blocks(model) > 1 and L._everywhere(model, spark) is None
    large = L.recursive_predict(model, panel, 3, "D", with_features=True).orderBy("series_id", "step").collect()
    again = L.shapley_points(model, L.last_rows(m, 4), None, ["series_id", "t"]).orderBy("series_id", "t", "feature").collect()
    for a, b in zip(small + told, large + again, strict=True):
        assert [pytest.approx(v) if isinstance(v, float) else v for v in a] == list(b)


def test_walk_feeds_predictions_back(panel_of, spark):
    """Default models against a walk written out for one series, with the model's own scoring of each step."""
    cfg = FeatureConfig()
    panel = panel_of({"a": wave(7, 80)})
    m, names = feature_matrix(panel, cfg)
    for model in (L.lag_forest(m, names, cfg, trees=9), L.lag_boosting(m, names, cfg, trees=9)):
        history, got = wave(7, 80), [r["predicted"] for r in L.recursive_predict(model, panel, 4, "D").orderBy("step").collect()]
        for k, y in enumerate(got):
            t = pd.Timestamp("2024-01-01") + pd.Timedelta(days=80 + k)
            row = {f"lag_{i}": history[-i] for i in (1, 2, 3, 7)} | {f"rolling_mean_{i}": np.mean(history[-i:]) for i in (3, 7)} | {"rolling_std_7": np.std(history[-7:]),
                   "time_index": float(80 + k), "weekday": float(t.weekday()), "month": float(t.month)}
            values = [v for _, v in zip(names, row.values())]
            assert model.predict(spark.createDataFrame([tuple(map(float, values))], list(names))).first()["predicted"] == pytest.approx(y)
            history.append(y)


def test_too_deep_trees_are_refused(eight):
    with pytest.raises(ValueError, match="above 30"):
        L.lag_forest(eight[0], eight[1], depth=32)


# -- trend with a prior -----------------------------------------------------------

def test_shrinkage_is_the_minimum():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(80, 12)), r.normal(size=80)
    x[:, 6:] = np.maximum(np.linspace(0, 1, 80)[:, None] - np.linspace(0.1, 0.8, 6), 0)
    g, q, ridge, weight = x.T @ x, x.T @ y, np.r_[np.full(3, 0.1), np.zeros(9)], 0.4
    b = A.shrunk(g, q, 3, weight, ridge)
    slope = (g + np.diag(ridge)) @ b - q
    assert slope[:3] == pytest.approx(np.zeros(3), abs=1e-7)
    for s, c in zip(slope[3:], b[3:]):
        assert abs(s) <= weight + 1e-6 if c == 0 else s == pytest.approx(-weight * np.sign(c), abs=1e-6)
    assert A.shrunk(g, q, 12, weight, np.zeros(12)) == pytest.approx(np.linalg.solve(g, q))


def test_multiplicative_season_and_hinges(panel_of):
    n = 280
    level = lambda i: 50 + 0.4 * i - (0.6 * (i - 140) if i > 140 else 0)
    y = [level(i) * (1 + 0.3 * math.sin(2 * math.pi * i / 7)) for i in range(n)]
    p = panel_of({"a": y})
    want = [level(i) * (1 + 0.3 * math.sin(2 * math.pi * i / 7)) for i in range(n, n + 14)]
    error = lambda **k: max(abs(a - r["predicted"]) for a, r in zip(want, A.trend_season(p, 14, "D", seasons=((7, 2),), **k).orderBy("step").collect()))
    times = error(mode="multiplicative", prior=0.5)
    assert times < 2 and times < 0.3 * error(prior=0.5) and error(mode="multiplicative", prior=1e-6) > 5 * times


def test_prior_of_plain_trend_matches_direct_solution(panel_of):
    y = [3 + 0.5 * i for i in range(60)]
    out = A.trend_season(panel_of({"a": y, "b": [1.0], "c": [2.0, 3.0]}), 5, "D", seasons=(), prior=0.05).collect()
    assert [r["predicted"] for r in sorted((r for r in out if r["series_id"] == "a"), key=lambda r: r["step"])] == pytest.approx([3 + 0.5 * i for i in range(60, 65)], rel=1e-3)
    assert all(r["predicted"] is not None for r in out)


# -- search and isolation ------------------------------------------------------------

def days(panel):
    return panel.select("series_id", F.date_format("t", "yyyy-MM-dd").alias("day"), F.col("y").cast("string").alias("v"))


SPEC = PanelSpec(("series_id",), "day", "v", "D")


def test_candidate_lists_of_all_models(panel_of):
    meta = panel_of({"a": range(100)}).groupBy("series_id").agg(F.count("*").cast("int").alias("n")).withColumn("freq", F.lit("D"))
    listed = lambda m, b=None: [r["param"] for r in B.dedupe_candidates(B.candidate_grid(meta, m, b)).orderBy("round").collect()]
    assert listed("arima") == ["1,1,1", "2,1,1", "2,1,2", "3,1,1", "1,0,1", "1,1,2"]
    assert listed("arima", {"q": 0}) == ["1,1,0", *B.ORDERS]
    assert listed("lag_forest")[:3] == ["120,18,2", "80,8,1", "120,12,2"] and len(listed("lag_boosting")) == 6 and len(listed("trend_season")) == 5
    assert B.parameters_of("lag_boosting", "80,2,0.08") == {"trees": 80, "depth": 2, "rate": 0.08}


def test_searched_orders_equal_each_order_alone(panel_of):
    p = panel_of({"a": wave(1, 70), "b": wave(2, 90)})
    trials = B.select_candidate(B.evaluate_candidates(p, ["arima", "moving_average"], 6, "D")).collect()
    for s, n in (("a", 70), ("b", 90)):
        y, v = wave(1 if s == "a" else 2, n), max(4, min(6, n // 4)) if n // 4 < 6 else 6
        for r in (t for t in trials if t["series_id"] == s and t["model_id"] == "arima"):
            made = R.forecasts(y[:-v], [tuple(map(int, r["param"].split(",")))], v)[0][0]
            assert r["mae"] == pytest.approx(np.abs(np.array(y[-v:]) - made).mean())
        mine = [t for t in trials if t["series_id"] == s and t["model_id"] == "arima"]
        assert len(mine) == 6 and sum(t["selected"] for t in mine) == 1


def test_fitted_candidates_equal_each_alone(panel_of, monkeypatch):
    monkeypatch.setitem(B.LISTED, "lag_forest", ("5,3,1", "4,32,1"))
    p = panel_of({"a": wave(1, 70), "b": wave(2, 90)})
    got = E.search_fitted(p, [("lag_forest", {"trees": 3, "depth": 2}), "trend_season"], 6, "D")
    rows = {(r["series_id"], r["model_id"], r["param"]): r for r in got.collect()}
    assert len(rows) == 2 * (3 + 5)
    assert all(rows[s, "lag_forest", "4,32,1"]["status"] == "failed" and "above 30" in rows[s, "lag_forest", "4,32,1"]["error"] for s in "ab")
    train = panel_of({"a": wave(1, 70)[:-6], "b": wave(2, 90)[:-6]})
    held = panel_of({"a": wave(1, 70), "b": wave(2, 90)}).join(train, ["series_id", "t"], "left_anti").withColumn("step", F.expr("row_number() over (partition by series_id order by t)"))
    m, names = feature_matrix(train)
    alone = L.recursive_predict(L.lag_forest(m.coalesce(1), names, trees=3, depth=2), train, 6, "D")
    close = {r["series_id"]: r["mae"] for r in error_metrics(pair_predictions(held, alone)).collect()}
    assert all(rows[s, "lag_forest", "3,2,2"]["mae"] == pytest.approx(close[s], rel=0.5) for s in "ab")
    exact = error_metrics(pair_predictions(held, A.trend_season(train, 6, "D", mode="multiplicative", prior=0.1))).collect()
    assert all(rows[r["series_id"], "trend_season", "multiplicative,0.1"]["mae"] == pytest.approx(r["mae"]) for r in exact)


def test_an_experiment_uses_every_choice(panel_of, monkeypatch):
    monkeypatch.setitem(B.LISTED, "lag_forest", ("5,3,1", "2,1,1"))
    monkeypatch.setitem(B.LISTED, "lag_boosting", ("4,2,0.3",))
    p = panel_of({"a": wave(1, 80), "b": wave(2, 80)})
    models = ["naive", "moving_average", "arima", "exp_smoothing", ("trend_season", {"seasons": ()}), ("lag_forest", {"trees": 3, "depth": 2}), ("lag_boosting", {"trees": 3})]
    run = E.run_experiment(days(p), SPEC, models, 5, 6, tune="all")
    trials = run.trials.collect()
    assert {t["model_id"] for t in trials} == {"moving_average", "arima", "exp_smoothing", "trend_season", "lag_forest", "lag_boosting"}
    chosen = {(t["series_id"], t["model_id"]): t["param"] for t in trials if t["selected"]}
    assert len(chosen) == 12
    board = {(r["series_id"], r["model_id"]): r for r in run.leaderboard.collect()}
    assert len(board) == 14 and all(r["status"] == "success" and r["error"] is None for r in board.values())
    assert {k: r["param"] for k, r in board.items() if r["param"]} == chosen
    for s, seed in (("a", 1), ("b", 2)):
        y = wave(seed, 80)
        made = R.forecasts(y[:-6], [tuple(map(int, chosen[s, "arima"].split(",")))], 6)[0][0]
        assert board[s, "arima"]["mae"] == pytest.approx(np.abs(np.array(y[-6:]) - made).mean(), rel=1e-6)
    assert run.forecast.count() == 10


def test_recommendations_tell_search_features_and_warnings(spark):
    from tidecast.operators.scenario import recommendation
    board = spark.createDataFrame([("a", "lag_forest", 1.0, 1.0, 0.1, 1, ["w1", "w2", "w3", "w4"]), ("a", "naive", 2.0, 2.0, 0.2, 2, []), ("b", "naive", 3.0, 3.0, None, 1, [])],
                                  "series_id string, model_id string, mae double, rmse double, wape double, rank int, warnings array<string>")
    trials = spark.createDataFrame([("a", "lag_forest", 1, 1.5, "success"), ("a", "lag_forest", 2, 1.25, "success"), ("a", "lag_forest", 3, None, "failed")], "series_id string, model_id string, round int, mae double, status string")
    got = {r["series_id"]: r for r in recommendation(board, trials=trials, features=("lag_1", "promo")).collect()}
    assert got["a"]["reasons"] == ["lowest MAE of the successful models: 1.0000", "RMSE 1.0000", "WAPE 0.1000", "MAE lower than naive by 1.0000",
                                   "a search tried 3 candidates, the best with MAE 1.2500", "uses the features lag_1, promo"]
    assert got["a"]["caveats"] == ["w1", "w2", "w3"] and got["b"]["reasons"][-1] == "no search: default or given parameters" and got["b"]["caveats"] == []


def test_failing_models_do_not_stop_an_experiment(panel_of):
    def short_only(history, horizon):
        if len(history) > 70:
            raise RuntimeError("too long for me")
        return pd.DataFrame({"predicted": [1.0] * horizon})

    register_forecaster("short_only", short_only)
    p = panel_of({"a": wave(1, 60), "b": wave(2, 100)})
    run = E.run_experiment(days(p), SPEC, ["naive", ("lag_forest", {"depth": 40}), "short_only"], 3, 4)
    board = {(r["series_id"], r["model_id"]): (r["status"], r["error"]) for r in run.leaderboard.collect()}
    assert all(board[s, "lag_forest"] == ("failed", "depth 40 is above 30") for s in "ab")
    assert board["b", "short_only"] == ("failed", "too long for me") and board["a", "short_only"] == ("success", None)
    assert board["a", "naive"][0] == board["b", "naive"][0] == "success" and run.forecast.count() == 6
