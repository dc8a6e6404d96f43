from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import values
from tidecast.operators import covariates as V
from tidecast.operators import holidays as H
from tidecast.operators.rows import annotate_rows
from tidecast.spec import CovariateRole, PanelSpec

DAYS = [(date(2024, 1, 1), "new year"), (date(2024, 2, 10), "spring"), (date(2024, 2, 12), "spring"), (date(2024, 5, 1), "labour")]


def brute(start, end, window):
    days = [d for d, _ in DAYS]
    inside = [d for d in days if start <= d < end]
    since = min([(start - d).days for d in days if d <= start], default=366)
    ahead = min([(d - start).days for d in days if d >= start], default=366)
    return (float(bool(inside)), float(len(inside)), float(since), float(ahead), float(min(since, ahead) <= window))


@pytest.mark.parametrize("freq,length", [("D", 1), ("W", 7)])
def test_holiday_features_against_brute_force(spark, panel_of, freq, length):
    calendar = spark.createDataFrame(DAYS, "date date, name string")
    p = panel_of({"a": range(30), "b": range(5)}, start="2023-12-25", step=timedelta(days=length))
    for r in H.holiday_features(p, calendar, freq, 2).collect():
        d = r["t"].date()
        assert tuple(r[n] for n in H.FEATURES) == brute(d, d + timedelta(days=length), 2), d
    names = [r["name"] for r in H.holiday_markers(p.where("series_id = 'a'"), calendar, freq).orderBy("t").collect()]
    last = date(2023, 12, 25) + timedelta(days=30 * length)
    assert names == [n for d, n in DAYS if d < last]


def test_month_count_and_calendars_by_country(spark):
    calendar = spark.createDataFrame([("AA", *d) for d in DAYS] + [("BB", date(2024, 2, 1), "other")], "country string, date date, name string")
    p = spark.createDataFrame([("a", "AA", datetime(2024, 2, 1)), ("b", "BB", datetime(2024, 2, 1))], "series_id string, country string, t timestamp_ntz")
    out = {r["series_id"]: r for r in H.holiday_features(p, calendar, "M", 0, ["country"]).collect()}
    assert out["a"]["holiday_count"] == 2 and out["a"]["holiday_days_since_previous"] == 31
    assert out["b"]["holiday_count"] == 1 and out["b"]["holiday_days_to_next"] == 0 and out["b"]["holiday_is_window"] == 1


def test_static_covariates_by_purpose(spark):
    hist = spark.createDataFrame([("a", datetime(2024, 1, d), "c", v) for d, v in ((1, 10.0), (2, 5.0), (3, 20.0), (4, 15.0))] +
                                 [("a", datetime(2024, 1, d), "k", 1.0) for d in (1, 2)], "series_id string, t timestamp_ntz, name string, value double")
    axis = spark.createDataFrame([("a", s, datetime(2024, 1, 4 + s)) for s in (1, 2)], "series_id string, step int, t timestamp_ntz")
    seen = spark.createDataFrame([("a", 1, "c", 999.0), ("a", 2, "c", 998.0), ("a", 1, "k", 7.0)], "series_id string, step int, name string, value double")

    def run(how, purpose):
        roles = [CovariateRole("c", "static", how), CovariateRole("k", "known_future"), CovariateRole("is_weekend", "known_future")]
        out = V.future_covariates(hist, axis, roles, purpose, seen)
        return {(r["name"], r["step"]): (r["value"], r["missing"]) for r in out.collect()}

    assert [run("repeat_last_known", "forecast")["c", s][0] for s in (1, 2)] == [15, 15]
    assert [run("use_test_values", "forecast")["c", s][0] for s in (1, 2)] == [15, 15]
    assert [run("use_test_values", "backtest")["c", s][0] for s in (1, 2)] == [999, 998]
    got = run("historical_mean", "backtest")
    assert [got["c", s][0] for s in (1, 2)] == [12.5, 12.5]
    assert got["k", 1] == (7, False) and got["k", 2] == (None, True)
    assert got["is_weekend", 1][0] == 0 and got["is_weekend", 2][0] == 1  # a Friday and a Saturday


def test_roles(spark):
    cov = spark.createDataFrame([("a", n, v) for n in ("price", "Month", "leak") for v in (1.0, None)], "series_id string, name string, value double")
    roles = V.resolve_roles(["price", "Month", "leak"], [CovariateRole("leak", "static", "use_test_values")])
    out = {r["name"]: r for r in V.covariate_roles(cov, roles).collect()}
    assert out["Month"]["kind"] == "known_future" and out["Month"]["forecast_strategy"] == "calendar"
    assert out["price"]["forecast_strategy"] == "repeat_last_known" and not out["price"]["leakage_risk"]
    assert out["leak"]["leakage_risk"] and out["leak"]["missing"] == 1
    assert V.leakage_count(V.covariate_roles(cov, roles)).first()["at_risk"] == 1


def test_future_rows_follow_the_history(spark):
    rows = [("a", "2024-01-01", "5", "1"), ("a", "2024-01-02", "6", "0"), ("a", "2024-01-03", "", "yes"), ("a", "2024-01-03", None, "no"),
            ("a", "2024-01-04", "", "2"), ("a", "2023-12-31", "", "9")]
    df = spark.createDataFrame(rows, "series_id string, d string, v string, promo string")
    spec = PanelSpec(("series_id",), "d", "v", "D")
    out = V.future_rows(annotate_rows(df, spec, keep=("promo",)), spec, ["promo"])
    assert values(out, "promo") == [0.5, 2.0] and values(out, "t") == [datetime(2024, 1, 3), datetime(2024, 1, 4)]
