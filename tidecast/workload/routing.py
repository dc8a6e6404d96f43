"""Routing of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as K
from .base import CTES, near, near_sql, query, with_ctes


def _rx(words: str) -> str:
    return f"regexp_matches(x, '{words}')"


# the word lists in text of their own, so that a change of the operators' lists shows
_DATA = ("holiday|节假日|假期|春节|天气|weather|temperature|气温|油价|fuel|oil|航油|促销|promotion|活动|股票|股价|指数|行情|macro|宏观|gdp|cpi|汇率|利率|价格|外部数据")
_MODEL = ("自定义模型|模型构想|损失函数|loss|objective|分层模型|hierarchical|鲁棒|robust|分段趋势|piecewise|状态空间|architecture|结构|ensemble|集成|约束|先验|bayesian|贝叶斯|异常鲁棒")
_JOIN, _NO = "加入|加进|参入|接入|作为特征|协变量|外部变量", "内幕|未授权|密码|个人隐私|身份证|爬取账号|绕过权限|敏感客户"
_UNKNOWN, _KNOWN = "股票|股价|行情|油价|天气|宏观|gdp|cpi|汇率|利率", "节假日|假期|星期|日历|促销计划|排班|航班计划"
_COLUMNS = {"节假日": "is_holiday_period", "假期": "holiday_count", "天气": "weather_index", "气温": "temperature", "油价": "fuel_price", "航油": "jet_fuel_price",
            "促销": "promotion_flag", "股票": "market_index", "指数": "market_index", "宏观": "macro_indicator", "gdp": "gdp", "cpi": "cpi"}

# every text, with a Chinese tail for a part of them so that all routes occur
TAILS = ("", " 加入天气和油价", " 自定义模型", " 内幕", " 促销计划 gdp", " 约束 节假日 作为特征", " cpi 鲁棒")
_tail = "CASE {k} % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(TAILS)) + " END"
CTES["idea"] = ("", f"SELECT doc_id, text || {_tail.format(k='doc_id')} AS idea FROM documents")
CTES["idea_x"] = ("idea", "SELECT doc_id, lower(trim(idea)) AS x FROM idea")
CTES["routed"] = ("idea_x", f"""
SELECT doc_id, x, CASE WHEN {_rx(_NO)} THEN 'unsupported' WHEN {_rx(_DATA)} AND {_rx(_MODEL)} AND {_rx(_JOIN)} THEN 'hybrid'
 WHEN {_rx(_MODEL)} THEN 'custom_model' WHEN {_rx(_DATA)} THEN 'feature_engineering_data' ELSE 'clarify' END AS route FROM idea_x""")


def ideas(t):
    return t.documents.selectExpr("doc_id", f"concat(text, {_tail.format(k='doc_id')}) AS idea")


@query("route_text", with_ctes("routed", "SELECT doc_id, route, CASE route WHEN 'hybrid' THEN 0.86 WHEN 'clarify' THEN 0.62 ELSE 0.9 END::DOUBLE AS confidence FROM routed"))
def _(t):
    return K.route_text(ideas(t), "idea").select("doc_id", "route", "confidence")


CTES["leaky"] = ("routed", f"""
SELECT doc_id, route, (route IN ('feature_engineering_data', 'hybrid') AND {_rx(_UNKNOWN)}) AS leak_warning,
 CASE WHEN route IN ('feature_engineering_data', 'hybrid', 'clarify') THEN CASE WHEN {_rx(_KNOWN)} THEN 'known_future' ELSE 'static' END END AS covariate_kind,
 coalesce(nullif(concat_ws('|', {", ".join(f"CASE WHEN contains(x, '{w}')" + (" AND NOT contains(x, '股票')" if w == "指数" else "") + f" THEN '{c}' END" for w, c in _COLUMNS.items())}), ''), 'external_covariate') AS suggested_columns FROM routed""")


@query("leakage_terms", with_ctes("leaky", "SELECT * FROM leaky"))
def _(t):
    out = K.leakage_terms(K.route_text(ideas(t), "idea"), "idea")
    return out.select("doc_id", "route", "leak_warning", "covariate_kind", F.array_join("suggested_columns", "|").alias("suggested_columns"))


@query("routing_scores", with_ctes("leaky", f"""
SELECT count(*) AS cases, {near_sql("avg((route = CASE quality WHEN 1 THEN 'clarify' ELSE 'custom_model' END)::INT)", 6)} AS route_accuracy,
 {near_sql("avg(leak_warning::INT) FILTER (toxic = 1)", 6)} AS leakage_recall FROM leaky JOIN labels USING (doc_id)"""))
def _(t):
    routed = K.leakage_terms(K.route_text(ideas(t), "idea"), "idea")
    labels = t.labels.select("doc_id", F.when(F.col("quality") == 1, "clarify").otherwise("custom_model").alias("expected_route"), (F.col("toxic") == 1).alias("needs_warning"))
    return K.routing_scores(routed, labels, "doc_id").select("cases", near("route_accuracy", 6).alias("route_accuracy"), near("leakage_recall", 6).alias("leakage_recall"))


# the registered sources in text of their own: place, id, searched text, frequencies, topics that ask for them, fallback
CTES["src"] = ("", """SELECT * FROM (VALUES
 (1, 'holiday_calendar_cn', 'holiday_calendar_cn 中国节假日日历 由 holiday generator 生成节假日、节日前后窗口和距离特征。 known_future', ['D', 'W', 'M'], ['calendar'], false),
 (2, 'same_sheet_future_rows', 'same_sheet_future_rows 同一 sheet 未来空目标行 用户在同一表格中提供未来时间点的协变量，目标列留空。 known_future',
  ['H', 'D', 'W', 'M', 'Q', 'Y'], ['market'], true),
 (3, 'user_covariate_csv', 'user_covariate_csv 用户上传协变量 csv/xlsx 上传与目标时间轴可对齐的外部数据，进入 covariate loader。 unknown_future',
  ['H', 'D', 'W', 'M', 'Q', 'Y'], ['market', 'weather'], true),
 (4, 'market_index_connector_placeholder', 'market_index_connector_placeholder 行情/指数连接器占位 用于登记股票指数、商品价格、油价等外部行情来源；当前版本不自动抓取。 unknown_future',
  ['D', 'W', 'M'], ['market'], false),
 (5, 'weather_connector_placeholder', 'weather_connector_placeholder 天气连接器占位 用于登记历史天气或天气预报来源；当前版本只生成接口计划。 unknown_future',
  ['H', 'D'], ['market', 'weather'], false),
 (6, 'macro_indicator_registry', 'macro_indicator_registry 宏观指标登记表 用于登记 gdp、cpi、汇率、利率等低频外部指标，不自动下载。 unknown_future',
  ['M', 'Q', 'Y'], ['market'], false)) AS v(place, source_id, hay, freqs, topics, is_fallback)""")
CTES["qry"] = ("idea_x", f"""
SELECT doc_id, x, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'D' ELSE 'Q' END AS freq,
 CASE WHEN regexp_matches(x, '节假日|假期|日历') THEN 'calendar' WHEN regexp_matches(x, '股票|指数|行情|油价|宏观|cpi|gdp|汇率|利率') THEN 'market'
  WHEN regexp_matches(x, '天气|气温') THEN 'weather' END AS topic,
 list_distinct(list_filter(regexp_split_to_array(x, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')) AS tokens FROM idea_x""")


@query("match_sources", with_ctes("src qry", """
, h AS (SELECT q.doc_id, s.place, s.source_id FROM qry q JOIN src s ON (q.freq = '' OR list_contains(s.freqs, q.freq))
  AND (q.x = '' OR coalesce(list_contains(s.topics, q.topic), false) OR len(list_filter(q.tokens, lambda w: contains(s.hay, w))) > 0))
SELECT doc_id, place::BIGINT AS place, source_id FROM h UNION ALL SELECT q.doc_id, s.place, s.source_id FROM qry q, src s WHERE s.is_fallback AND q.doc_id NOT IN (SELECT doc_id FROM h)""".replace("\n, h AS", ", h AS", 1)))
def _(t):
    freq = F.expr("CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'd' ELSE 'Q' END")
    return K.match_sources(ideas(t).withColumn("freq", freq), "idea", "doc_id", "freq")
