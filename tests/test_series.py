"""Expected values of aggregation, duplicates, gaps, fills and outliers."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import values
from tidecast.operators import fill as G
from tidecast.operators import outliers as O
from tidecast.operators import rows as R
from tidecast.operators.diagnostics import data_health
from tidecast.operators.quantiles import exact_quantile
from tidecast.plans.build import build_panel
from tidecast.spec import CleaningConfig, PanelSpec, cleaning_preset

SPEC = PanelSpec(("series_id",), "date", "value", "D", "row")


def raw(spark, rows):
    return spark.createDataFrame([("s", d, v, i) for i, (d, v) in enumerate(rows)], "series_id string, date string, value string, row int")


DETAIL = [("2024-01-01", "20"), ("2024-01-01", "10"), ("2024-01-02", ""), ("2024-01-02", "12"), ("2024-01-03", "30"), ("2024-01-04", "7"),
          ("2024-01-04", "11"), ("2024-01-05", "20"), ("2024-01-06", "13"), ("2024-01-06", "15")]


@pytest.mark.parametrize("how,want", [("sum", [30, 12, 30, 18, 20, 28]), ("mean", [15, 12, 30, 9, 20, 14]), ("count", [2, 2, 1, 2, 1, 2])])
def test_golden_aggregation(spark, how, want):
    built = build_panel(raw(spark, DETAIL), SPEC, cleaning_preset("conservative"), how=how)
    assert values(built.panel) == want


@pytest.mark.parametrize("how,want", [("mean", 110), ("last", 120), ("first", 100), ("sum", 220)])
def test_duplicates(spark, how, want):
    df = raw(spark, [("2024-01-01", "100"), ("2024-01-01", "120")])
    rows = R.annotate_rows(df, SPEC)
    assert values(R.resolve_duplicates(rows, PanelSpec(("series_id",), "t", "y", "D", "row"), how)) == [want]


def test_first_needs_an_order(spark):
    with pytest.raises(ValueError, match="order"):
        R.resolve_duplicates(raw(spark, DETAIL), PanelSpec(("series_id",), "t", "y"), "first")


def test_thousands_and_row_interpolation(spark):
    df = raw(spark, [("2024-01-01", " 1,200 "), ("2024-01-02", None), ("2024-01-03", "1,600"), ("bad", "5")])
    built = build_panel(df, SPEC, CleaningConfig(missing="interpolate"))
    assert values(built.panel) == [1200, 1400, 1600]
    d = built.diagnostics.first()
    assert (d["filled"], d["dropped_rows"], d["invalid_time"], d["missing_target"]) == (1, 1, 1, 1)


def test_gap_is_interpolated(spark):
    df = raw(spark, [("2024-01-01", "100"), ("2024-01-03", "140"), ("2024-01-04", "160")])
    built = build_panel(df, SPEC, CleaningConfig(missing="interpolate"))
    assert values(built.panel) == [100, 120, 140, 160]
    assert built.diagnostics.first()["missing_time"] == 1


def test_strict_time_errors_out(spark):
    built = build_panel(raw(spark, [("2024-01-01", "1"), ("bad", "2")]), SPEC, CleaningConfig(on_invalid_time="error"))
    with pytest.raises(Exception, match="unparseable"):
        built.panel.collect()


@pytest.mark.parametrize("freq,step", [("H", timedelta(hours=1)), ("D", timedelta(days=1)), ("W", timedelta(days=7))])
def test_reindex_regular(panel_of, freq, step):
    full = panel_of({"a": range(40)}, start="2024-01-01", step=step)
    holes = full.where(~F.col("y").isin(3, 4, 17))
    grid = G.reindex(holes, freq)
    assert values(grid, "t") == values(full, "t")
    assert [r for r in values(grid)] == [None if v in (3, 4, 17) else v for v in range(40)]


@pytest.mark.parametrize("freq,months", [("M", 1), ("Q", 3), ("Y", 12)])
def test_reindex_months(spark, freq, months):
    start = 2020 * 12
    at = [datetime((start + i * months) // 12, (start + i * months) % 12 + 1, 1) for i in range(8)]
    df = spark.createDataFrame([("a", t, 1.0) for i, t in enumerate(at) if i not in (2, 5)], "series_id string, t timestamp_ntz, y double")
    assert values(G.reindex(df, freq), "t") == at


def test_interpolation_limit_from_both_sides(panel_of):
    p = panel_of({"a": [None, None, 1, None, None, None, None, 6, None, None]})
    assert values(G.interpolate(p, limit=1)) == [None, 1, 1, 2, None, None, 5, 6, 6, None]
    assert values(G.interpolate(p)) == [1, 1, 1, 2, 3, 4, 5, 6, 6, 6]


def test_fill_strategies(panel_of):
    p = panel_of({"a": [None, 2, None, 6, None], "b": [1, None, None, None, 3]})
    assert values(G.fill_missing(p, "ffill"), series="a") == [2, 2, 2, 6, 6]
    assert values(G.fill_missing(p, "bfill"), series="a") == [2, 2, 6, 6, 6]
    assert values(G.fill_missing(p, "median"), series="a") == [4, 2, 4, 6, 4]
    assert values(G.fill_missing(p, "zero"), series="b") == [1, 0, 0, 0, 3]
    assert values(G.fill_missing(p, "drop"), series="b") == [1, 3]


@pytest.mark.parametrize("strategy", ["ffill", "bfill", "interpolate", "time", "median", "zero"])
def test_row_fill_equals_panel_fill(spark, strategy):
    """The chunked fill of raw rows gives what the plain windows give."""
    import random
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    rows = []
    for s in ("a", "b"):
        t = t0
        for i in range(300):
            t += timedelta(minutes=rng.choice([1, 7, 50, 190]))
            rows.append((s, t, i, None if rng.random() < 0.6 else float(rng.randint(0, 99))))
    df = spark.createDataFrame(rows, "series_id string, t timestamp_ntz, row int, y double")
    spec = PanelSpec(("series_id",), "t", "y", "H", "row")
    got = R.fill_rows(df, spec, strategy, 2)
    want = G.fill_missing(df, strategy, 2)
    assert values(got) == pytest.approx(values(want), nan_ok=True)


def test_hampel_spike(panel_of):
    p = O.hampel(panel_of({"a": [10, 10, 11, 10, 200, 10, 11, 10, 10]}), 5)
    marks, v = values(p, "is_outlier"), values(p)
    assert sum(marks) == 1 and max(v) < 20


def test_iqr_clip(panel_of):
    p = O.iqr_outliers(panel_of({"a": [9, 10, 11, 12, 9, 10, 11, 12, 10, 11, 1000], "short": [1, 2, 900]}), clip=True)
    assert sum(values(p, "is_outlier", "a")) == 1 and max(values(p, series="a")) < 1000
    assert values(p, series="short") == [1, 2, 900]


@pytest.mark.parametrize("freq,step", [("H", 3600), ("D", 86400), ("W", 7 * 86400), ("M", 30 * 86400), ("Q", 91 * 86400), ("Y", 365 * 86400)])
def test_frequency(spark, freq, step):
    rows = [("s", datetime(2020, 1, 1) + timedelta(seconds=step * i)) for i in range(6)]
    out = R.detect_frequency(spark.createDataFrame(rows, "series_id string, t timestamp_ntz"), PanelSpec()).first()
    assert out["freq"] == freq and not out["irregular"]


def test_frequency_edges(spark):
    t0 = datetime(2024, 1, 1)
    # two middle gaps in different bands: 1 h and 1 day average to an irregular 12.5 h
    rows = [("split", t0), ("split", t0 + timedelta(hours=1)), ("split", t0 + timedelta(hours=25)), ("one", t0)]
    out = {r["series_id"]: r for r in R.detect_frequency(spark.createDataFrame(rows, "series_id string, t timestamp_ntz"), PanelSpec(), "D").collect()}
    assert out["split"]["median_gap"] == 12.5 * 3600 and out["split"]["irregular"] and out["split"]["freq"] == "D"
    assert out["one"]["freq"] == "D" and not out["one"]["irregular"]
    texts = spark.createDataFrame([("y", "2020"), ("y", "2021"), ("m", "2020-01"), ("m", "2020年5月")], "series_id string, s string")
    rows = R.annotate_rows(texts.withColumn("v", F.lit(1.0)), PanelSpec(("series_id",), "s", "v"))
    assert {r["series_id"]: r["freq"] for r in R.detect_frequency(rows, PanelSpec()).collect()} == {"y": "Y", "m": "M"}
    with pytest.raises(Exception, match="finer"):
        R.detect_frequency(rows, PanelSpec(), "D", strict=True).collect()


def test_exact_quantile(spark):
    import random
    rng = random.Random(5)
    data = {k: [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 1e9, 7.0]) for _ in range(n)] for k, n in (("a", 501), ("b", 500), ("c", 1), ("d", 2))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", F.lit(q)).alias("q")).collect()}
        got = {r["k"]: r["quantile"] for r in exact_quantile(df, ["k"], "v", q).collect()}
        assert got == pytest.approx(want)


def test_health_levels(spark):
    cols = ("original_rows valid_points dropped_rows duplicate_time missing_time invalid_time missing_target invalid_target filled outliers outliers_adjusted").split()
    schema = "series_id string, " + ", ".join(f"{c} bigint" for c in cols) + ", time_start timestamp_ntz, time_end timestamp_ntz"
    t = (datetime(2024, 1, 1), datetime(2024, 3, 31))
    df = spark.createDataFrame([("clean", 90, 90, 0, 0, 0, 0, 0, 0, 0, 0, 0, *t), ("dirty", 40, 20, 20, 5, 6, 5, 4, 3, 0, 3, 0, *t)], schema)
    out = {r["series_id"]: r for r in data_health(df, 14, 10).collect()}
    assert out["clean"]["score"] >= 90 and out["clean"]["level"] == "excellent" and out["clean"]["warnings"] == []
    assert out["dirty"]["score"] < 75 and len(out["dirty"]["warnings"]) >= 5 and out["dirty"]["suggestions"]
    assert out["clean"]["span_days"] == 90.0


def test_numbering_keeps_null_keys_and_times(spark):
    from tidecast.functions.calendar import time_bucket
    from tidecast.operators._common import number_rows
    t0 = datetime(2024, 1, 1)
    rows = [(k, None if i % 7 == 0 else t0 + timedelta(minutes=37 * i), i) for k in ("a", None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int")
    got = number_rows(df, ["k"], ["ts", "id"], time_bucket("ts", "H")).collect()
    assert len(got) == 100
    for k in ("a", None):
        want = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or t0, r[2]))
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: r["sequence"])
        assert [r["sequence"] for r in mine] == list(range(1, 51)) and [r["id"] for r in mine] == [r[2] for r in want]


def test_ranges_spread_one_time_stamp(spark):
    """A bulk load: all rows of one run under one time stamp, or without any; numbers and fills are exact and spread over tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are put into one task
    try:
        _ranges_spread(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _ranges_spread(spark):
    from tidecast.operators._common import number_rows
    n = 40_000
    df = spark.range(n).selectExpr("'r' AS k", "IF(id % 2 = 0, timestamp_ntz'2024-01-01', CAST(NULL AS timestamp_ntz)) AS ts", "id", "IF(id % 5 = 0, cast(id AS double), NULL) AS y")
    got = number_rows(df, ["k"], ["ts", "id"]).withColumn("p", F.spark_partition_id())
    assert got.where("sequence <> IF(ts IS NULL, 0, 20000) + floor(id / 2) + 1").count() == 0
    sizes = [r["n"] for r in got.groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 0.7 * n
    filled = R.fill_rows(df.withColumnsRenamed({"k": "series_id", "ts": "t"}).where("t IS NOT NULL"), PanelSpec(("series_id",), "t", "y", "H", "id"), "ffill", ranged=True)
    assert filled.where("y <> floor(id / 10) * 10").count() == 0 and filled.count() == n // 2


def test_hot_series_spreads_over_tasks(spark):
    """One series holds nearly all raw rows: its rows still reach many tasks, and the answers are exact."""
    n = 200_000
    df = spark.range(n).selectExpr(
        "IF(id % 50 = 0, concat('s', id % 7), 'hot') AS series_id", "id AS row",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(id * 7 AS decimal(18, 6))) AS t", "IF(id % 3 = 0, NULL, cast(id % 1000 AS double)) AS y")
    spec = PanelSpec(("series_id",), "t", "y", "H", "row")
    filled = R.fill_rows(df, spec, "ffill")
    sizes = [r["n"] for r in filled.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n and max(sizes) < 0.6 * n and filled.where("y IS NULL").count() == 0
    hot = R.detect_frequency(df, spec).where("series_id = 'hot'").first()
    assert hot["freq"] == "H" and not hot["irregular"]
    med = exact_quantile(df.where("y IS NOT NULL"), ["series_id"], "y", 0.5).where("series_id = 'hot'").first()["quantile"]
    assert med == df.where("y IS NOT NULL AND series_id = 'hot'").agg(F.percentile("y", F.lit(0.5))).first()[0]
