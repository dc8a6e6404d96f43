import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import values
from tidecast.operators import routing as K
from tidecast.operators import runs as R
from tidecast.plans import backtest as B
from tidecast.sources import store
from tidecast.sources import tables as S
from tidecast.streaming import events as E


def test_csv_with_odd_header(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_bytes("\ufeffdate; ;value;value\n2024-01-01;x;1;2\n2024-01-02;y;3;4\n".encode())
    assert S.detect_delimiter(spark, str(path)) == ";"
    df = S.read_table(spark, str(path))
    assert df.columns == ["date", "column_2", "value", "value_2"] and {t for _, t in df.dtypes} == {"string"}
    assert [tuple(r) for r in df.orderBy("date").collect()] == [("2024-01-01", "x", "1", "2"), ("2024-01-02", "y", "3", "4")]
    rows, n = S.preview(df, 1)
    assert n == 2 and rows.count() == 1


@pytest.mark.parametrize("d", [",", "\t", ";", "|"])
def test_delimiters(spark, tmp_path, d):
    path = tmp_path / "x.txt"
    path.write_text("\n".join(d.join(r) for r in (("a", "b", "c"), ("1", "2", "3"))))
    assert S.detect_delimiter(spark, str(path)) == d
    path.write_text(f"a{d}b{d}c\nonly\nq{d}r\n")
    assert S.detect_delimiter(spark, str(path)) == d


def test_quotes_hide_delimiters_and_line_ends(spark, tmp_path):
    path = tmp_path / "q.csv"
    rows = [(i, f"a, b; {'x' * (i % 7)}" + ("\nsecond, line;; \n, third" if i % 3 == 0 else ""), i * i) for i in range(3000)]
    body = "id;note;value\n" + "\n".join(f'{i};"{n}";{v}' for i, n, v in rows) + "\n"
    path.write_text(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        told = S.quoted_records(S.file_lines(spark, str(path)))
        assert told.select("start").distinct().count() > 3
        got = {r["i"]: (r["lines"], r["mean"], r["spread"], r["first"]) for r in S.delimiter_counts(told).collect()}
        assert got == {0: (3001, 0.0, 0.0, 0), 1: (3001, 0.0, 0.0, 0), 2: (3001, 2.0, 0.0, 2), 3: (3001, 0.0, 0.0, 0)}
        assert told.where("inside").count() == 2 * 1000 and told.agg(F.max("record")).first()[0] == 3001
        assert S.detect_delimiter(spark, str(path)) == ";"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_headers_of_many_files_are_one_job(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"f{i}.csv").write_text("a;b\n1;2\n")
    sc = spark.sparkContext
    sc.setJobGroup("headers", "")
    assert S.read_table(spark, str(tmp_path), sep=";").count() == 40
    assert len(sc.statusTracker().getJobIdsForGroup("headers")) < 12
    (tmp_path / "f41.csv").write_text("a;c\n1;2\n")
    with pytest.raises(ValueError, match="f41.csv has other columns"):
        S.read_table(spark, str(tmp_path), sep=";")


def test_digests_are_streamed(spark, tmp_path):
    data = bytes(range(256)) * 4000
    (tmp_path / "big file.bin").write_bytes(data)
    (tmp_path / "none.bin").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1].replace("%20", " "): (r["bytes"], r["sha256"]) for r in S.file_digest(spark, str(tmp_path), piece=1000).collect()}
    assert got == {"big file.bin": (len(data), hashlib.sha256(data).hexdigest())}


def test_gb18030(spark, tmp_path):
    path = tmp_path / "cn.csv"
    path.write_bytes("日期,数值\n2024年1月1日,5\n".encode("gb18030"))
    assert S.detect_encoding(spark, str(path)) == "GB18030"
    with pytest.raises(ValueError, match="javaCharsets"):
        S.read_table(spark, str(path), sep=",", encoding="GB18030")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        df = S.read_table(spark, str(path), sep=",", encoding="GB18030")
        assert df.columns == ["日期", "数值"] and df.first()["日期"] == "2024年1月1日"
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_sheets_and_digest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("d,v\n1,2\n")
    (tmp_path / "b.csv").write_text("d,w\n3,4\n5,6\n")
    df = S.read_sheets(spark, {"A": str(tmp_path / "a.csv"), "B": str(tmp_path / "b.csv")})
    assert df.columns == ["d", "v", "sheet", "w"] and df.groupBy("sheet").count().where("sheet = 'B'").first()["count"] == 2
    got = S.file_digest(spark, str(tmp_path / "a.csv")).first()
    assert got["sha256"] == hashlib.sha256(b"d,v\n1,2\n").hexdigest() and got["bytes"] == 8


def test_save_twice_compare_and_delete(spark, panel_of, tmp_path):
    root = str(tmp_path / "store")
    p = panel_of({"a": range(40), "b": [x * x % 7 for x in range(40)]})
    board, points = B.backtest(p, ["naive", "moving_average"], 5, "D")
    for run in ("one", "two", "one"):
        store.save_run({"leaderboard": board, "backtest": points, "series_points": p}, root, run)
    one, two = (store.load_run(spark, root, r) for r in ("one", "two"))
    assert set(one) == {"leaderboard", "backtest", "series_points"} and one["backtest"].count() == 20
    assert "PartitionFilters: [isnotnull(experiment_id" in one["backtest"]._jdf.queryExecution().toString()
    scores = R.compare_runs(one["leaderboard"], two["leaderboard"]).collect()
    assert all(r["score"] == 1.0 and r["drift"] == [] for r in scores)
    assert values(R.series_hash(one["series_points"]).withColumn("t", F.lit(1)), "series_hash") == values(R.series_hash(p).withColumn("t", F.lit(1)), "series_hash")
    assert store.delete_run(spark, root, "one") == 3
    assert store.load_run(spark, root, "one")["backtest"].count() == 0 and store.load_run(spark, root, "two")["backtest"].count() == 20
    with pytest.raises(ValueError):
        store.delete_run(spark, root, "../two")


def test_runs_come_back_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "store")
    full = {"leaderboard": spark.range(3), "trials": spark.createDataFrame([], "series_id string, mae double")}
    store.save_run(full, root, "a:b/c".replace("/", "-"))
    again = store.load_run(spark, root, "a:b-c")
    assert set(again) == {"leaderboard", "trials"} and again["trials"].columns == ["series_id", "mae", "experiment_id"] and again["trials"].count() == 0
    assert store.stored_runs(spark, root) == ["a:b-c"]
    store.save_run({"leaderboard": spark.range(0), "points": spark.range(2)}, root, "a:b-c")
    again = store.load_run(spark, root, "a:b-c")
    assert {n: d.count() for n, d in again.items()} == {"leaderboard": 0, "points": 2}

    def broken(x):
        raise RuntimeError("lost")

    bad = spark.range(2).select(F.udf(broken, "long")("id").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.save_run({"leaderboard": spark.range(5), "points": bad}, root, "a:b-c")
    assert store.stored_runs(spark, root) == [] and all(d.count() == 0 for d in store.load_run(spark, root, "a:b-c").values())


def test_first_distinct_values_leave_tasks_as_a_few_rows(spark):
    from tidecast.operators.profiling import first_distinct, profile_columns
    df = spark.range(20_000).selectExpr("id AS row", "concat('v', (id * 7919) % 5000) AS many", "IF(id % 3 = 0, NULL, cast(id % 4 AS string)) AS few", "CAST(NULL AS string) AS none").repartition(6)
    rows = first_distinct(df, ["many", "few", "none"], "row", 5)
    assert rows.groupBy("column").count().where("count > 6 * 5").count() == 0
    got = {r["column"]: (r["non_null"], r["nulls"], r["samples"]) for r in profile_columns(df, ["many", "few", "none"], "row").collect()}
    assert got == {"many": (20_000, 0, [f"v{i * 7919 % 5000}" for i in range(5)]), "few": (13_333, 6_667, ["1", "2", "0", "3"]), "none": (0, 20_000, [])}


def test_hash_sees_every_change(panel_of):
    a = panel_of({"a": range(60)})
    same = R.series_hash(a.orderBy(F.rand(1))).first()["series_hash"]
    assert same == R.series_hash(a).first()["series_hash"]
    assert same != R.series_hash(a.withColumn("y", F.when(F.col("y") == 31, 31.5).otherwise(F.col("y")))).first()["series_hash"]


EVENTS = [("r", 1, 0, "y", "m1", "training", "running", 2.0, None), ("r", 2, 5, "y", "m1", "forecast", "running", None, 0.5),
          ("r", 3, 9, "y", "m1", "finished", "success", None, None), ("r", 4, 4, "y", "m2", "training", "failed", None, None), ("q", 1, 0, "y", "m1", "loading", "running", None, None)]


def run_events(spark):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(*e[:2], t0 + timedelta(seconds=e[2]), *e[3:]) for e in EVENTS], E.EVENT_SCHEMA)


def test_states_and_stages(spark):
    ev = run_events(spark)
    s = {(r["run_id"], r["model_id"]): r for r in R.latest_model_state(ev).collect()}
    assert s["r", "m1"]["status"] == "success" and (s["r", "m1"]["fit_seconds"], s["r", "m1"]["elapsed"]) == (2.0, 2.5)
    assert {r["run_id"]: r["completed"] for r in R.completed_models(ev).collect()} == {"r": 2, "q": 0}
    assert [r["sequence"] for r in R.events_after(ev, 2, "r").collect()] == [3, 4]
    st = {r["stage"]: r for r in R.stage_durations(ev).where("run_id = 'r'").collect()}
    assert st["training"]["elapsed"] == 5 and st["forecast"]["elapsed"] == 4 and st["finished"]["elapsed"] == 0


def test_streaming_equals_batch(spark, tmp_path):
    src, ck = str(tmp_path / "events"), str(tmp_path / "ck")
    ev = run_events(spark)
    state = {}

    def sink(df, _):
        state.update({(r["run_id"], r["target"], r["model_id"]): (r["sequence"], r["stage"], r["status"]) for r in df.collect()})

    for part in (ev.where("sequence <= 2"), ev.where("sequence > 2")):
        part.write.mode("append").parquet(src)
        E.follow(E.model_states(E.read_events(spark, src)), sink, ck).awaitTermination()
    want = {(r["run_id"], r["target"], r["model_id"]): (r["sequence"], r["stage"], r["status"]) for r in R.latest_model_state(ev).collect()}
    assert state == want
    done = {}
    E.follow(E.finished_counts(E.read_events(spark, src)), lambda df, _: done.update({r["run_id"]: r["completed"] for r in df.collect()}), str(tmp_path / "ck3")).awaitTermination()
    assert done == {"r": 2}
    seen = []
    E.follow(E.read_events(spark, src), lambda df, _: seen.extend(r["sequence"] for r in df.collect()), str(tmp_path / "ck2"), "append").awaitTermination()
    assert len(seen) == len(EVENTS)
    E.follow(E.read_events(spark, src), lambda df, _: seen.extend(r["sequence"] for r in df.collect()), str(tmp_path / "ck2"), "append").awaitTermination()
    assert len(seen) == len(EVENTS)  # the checkpoint is the cursor


def test_streams_of_late_and_repeated_events_equal_batches(spark, tmp_path):
    import random
    r, t0 = random.Random(3), datetime(2024, 1, 1)
    rows = [(f"r{i % 4}", i // 4 + 1, t0 + timedelta(seconds=3 * i), "y", f"m{r.randrange(3)}", R.STAGES[min(i // 30, 9)], r.choice(["running", "success", "failed"]),
             r.choice([None, float(i)]), r.choice([None, i / 2])) for i in range(240)]
    sent = rows + r.sample(rows, 100)
    r.shuffle(sent)
    ev, src = spark.createDataFrame(rows, E.EVENT_SCHEMA), str(tmp_path / "events")
    states, stages = {}, {}
    keep = lambda into, *key: lambda df, _: into.update({tuple(x[k] for k in key): tuple(x) for x in df.collect()})
    for i in range(0, len(sent), 90):
        spark.createDataFrame(sent[i:i + 90], E.EVENT_SCHEMA).write.mode("append").parquet(src)
        E.follow(E.model_states(E.read_events(spark, src)), keep(states, "run_id", "target", "model_id"), str(tmp_path / "a")).awaitTermination()
        E.follow(E.stage_states(E.read_events(spark, src)), keep(stages, "run_id", "place"), str(tmp_path / "b")).awaitTermination()
    assert sorted(states.values()) == sorted(tuple(x) for x in R.latest_model_state(ev).collect())
    assert sorted(stages.values(), key=repr) == sorted((tuple(x) for x in R.stage_durations(ev).collect()), key=repr)


def test_estimates_are_ordered(spark):
    schema = "request_id int, model_id string, row_count bigint, covariates int, features int, profile string, strategy string, device string, targets int"
    req = spark.createDataFrame([(i, m, 26304, 320, 343 if m.startswith("lag") else 1, "accurate", "auto", "cpu", 1) for i, m in enumerate(("naive", "lag_boosting", "lag_forest"))], schema)
    none = spark.createDataFrame([], "model_id string, row_count bigint, covariates int, features int, profile string, strategy string, device string, seconds double")
    got = {r["model_id"]: r for r in R.runtime_estimate(req, none).collect()}
    assert 0 < got["naive"]["seconds"] < got["lag_boosting"]["seconds"] < got["lag_forest"]["seconds"]
    assert all(r["confidence"] == "low" for r in got.values())
    past = spark.createDataFrame([("naive", 26304, 320, 1, "accurate", "auto", "cpu", 3.0)] * 4, none.schema)
    hit = {r["model_id"]: r for r in R.runtime_estimate(req, past).collect()}["naive"]
    assert hit["seconds"] == 3.0 and hit["confidence"] == "high"


def test_auxiliary_forecasts_lengthen_a_run(spark):
    schema = "request_id int, model_id string, row_count bigint, covariates int, features int, profile string, strategy string, device string, targets int, unknown_future int, per_model int"
    req = spark.createDataFrame([(i, "lag_forest", 1000, 4, 20, "balanced", "default", "cpu", 2, *more) for i, more in enumerate(((0, 0), (2, 0), (0, 1), (1, 1), (None, None)))], schema)
    none = spark.createDataFrame([], "model_id string, row_count bigint, covariates int, features int, profile string, strategy string, device string, seconds double")
    got = {r["request_id"]: r["seconds"] for r in R.runtime_estimate(req, none).collect()}
    assert [got[i] / got[0] for i in range(5)] == pytest.approx([1, 1.7, 1.8, 2.15, 1], rel=1e-3)


def test_whole_runs_are_compared(spark, panel_of):
    p = panel_of({"a": range(40), "b": [x * x % 7 for x in range(40)]})
    board, points = B.backtest(p, ["naive", "moving_average"], 5, "D")
    one = {"leaderboard": board, "backtest": points, "series_points": p}
    same = R.compare_whole_runs(one, dict(one)).collect()
    assert [(r["checks"], r["score"], r["drift"]) for r in same] == [(11, 1.0, [])] * 2
    two = {"leaderboard": board.withColumn("rank", F.when(F.col("series_id") == "a", 3 - F.col("rank")).otherwise(F.col("rank"))),
           "backtest": points.withColumn("predicted", F.when((F.col("series_id") == "b") & (F.col("step") == 2), F.col("predicted") + 1e-6).otherwise(F.col("predicted"))),
           "series_points": p.where("series_id <> 'a' or y <> 3")}
    drift = {r["series_id"]: r["drift"] for r in R.compare_whole_runs(one, two).collect()}
    assert drift == {"a": ["recommended_model", "series_hash"], "b": ["backtest_hash"]}


# The ten labelled ideas, their route and whether they need a leakage warning.
IDEAS = [
    ("holiday_data", "把节假日和春节前后窗口加进去看看", "feature_engineering_data", False),
    ("weather_data", "加入天气和气温作为影响客流的外部变量", "feature_engineering_data", True),
    ("fuel_market", "把航油价格和股票指数行情参入模型", "feature_engineering_data", True),
    ("promo_data", "促销计划和排班计划应该作为未来已知协变量", "feature_engineering_data", False),
    ("custom_loss", "我想设计一个对低估惩罚更重的自定义损失函数", "custom_model", False),
    ("hierarchical_model", "做一个分层模型，机场和航线共享趋势但保留局部差异", "custom_model", False),
    ("robust_model", "构想一种异常鲁棒模型，节假日尖峰不要拖坏趋势", "custom_model", False),
    ("hybrid_market_model", "加入油价指数，同时做一个分段趋势模型", "hybrid", True),
    ("clarify_vague", "帮我把预测变得更准一点", "clarify", False),
    ("unsupported_sensitive", "读取未授权客户隐私和内幕数据来预测", "unsupported", False),
]


def test_routing_of_labelled_ideas(spark):
    df = spark.createDataFrame(IDEAS, "name string, idea string, expected_route string, needs_warning boolean")
    routed = K.leakage_terms(K.route_text(df.select("name", "idea"), "idea"), "idea")
    score = K.routing_scores(routed, df).first()
    assert score["cases"] == 10 and score["route_accuracy"] == 1.0 and score["leakage_recall"] == 1.0
    cols = {r["name"]: r["suggested_columns"] for r in routed.collect()}
    assert cols["fuel_market"] == ["fuel_price", "jet_fuel_price", "market_index"] and cols["clarify_vague"] == ["external_covariate"]
    assert {r["name"]: r["confidence"] for r in routed.collect()}["hybrid_market_model"] == 0.86


def test_sources(spark):
    df = spark.createDataFrame([(1, "节假日", "D"), (2, "股票", "H"), (3, "", "Y"), (4, "zzz", "H"), (5, "天气", "H")], "query_id int, query string, freq string")
    got = {}
    for r in K.match_sources(df, freq="freq").orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["source_id"])
    assert got[1] == ["holiday_calendar_cn"]
    assert got[2] == ["same_sheet_future_rows", "user_covariate_csv", "weather_connector_placeholder"]
    assert "macro_indicator_registry" in got[3] and "weather_connector_placeholder" not in got[3]
    assert got[4] == ["same_sheet_future_rows", "user_covariate_csv"]
    assert got[5] == ["user_covariate_csv", "weather_connector_placeholder"]


def test_search_and_listing(spark):
    t0 = datetime(2024, 1, 1)
    runs = spark.createDataFrame([(i, t0 + timedelta(days=i % 3), "Run A" if i % 2 else "Other", "f.csv", "S1", "y", "naive", 1, 1) for i in range(6)],
                                 "run_id int, created_at timestamp_ntz, name string, file_name string, sheet_name string, target string, recommended_model string, user_id int, workspace_id int")
    assert R.search_runs(runs, " run a ").count() == 3 and R.search_runs(runs, "").count() == 6
    assert [r["run_id"] for r in R.latest_runs(runs, 2).collect()] == [5, 2]
    spaces = spark.createDataFrame([(1, "w")], "workspace_id int, workspace string")
    users = spark.createDataFrame([(1, "u")], "user_id int, owner string")
    assert [r["run_id"] for r in R.list_runs(runs, spaces, users, 1).collect()] == [5, 2, 4, 1, 3, 0]
