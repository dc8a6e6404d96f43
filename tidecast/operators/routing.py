"""Routing of analysis ideas by keywords, over a table of texts.

Rules are substring searches over the whole text: plain byte scans, which run
several times faster than one regular expression with all the words.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import texts

# The keyword lists of the routing rules.
DATA_WORDS = ("holiday", "节假日", "假期", "春节", "天气", "weather", "temperature", "气温", "油价", "fuel", "oil", "航油", "促销",
              "promotion", "活动", "股票", "股价", "指数", "行情", "macro", "宏观", "gdp", "cpi", "汇率", "利率", "价格", "外部数据")
MODEL_WORDS = ("自定义模型", "模型构想", "损失函数", "loss", "objective", "分层模型", "hierarchical", "鲁棒", "robust", "分段趋势",
               "piecewise", "状态空间", "architecture", "结构", "ensemble", "集成", "约束", "先验", "bayesian", "贝叶斯", "异常鲁棒")
JOIN_WORDS = ("加入", "加进", "参入", "接入", "作为特征", "协变量", "外部变量")
UNSUPPORTED_WORDS = ("内幕", "未授权", "密码", "个人隐私", "身份证", "爬取账号", "绕过权限", "敏感客户")
UNKNOWN_FUTURE_WORDS = ("股票", "股价", "行情", "油价", "天气", "宏观", "gdp", "cpi", "汇率", "利率")
KNOWN_FUTURE_WORDS = ("节假日", "假期", "星期", "日历", "促销计划", "排班", "航班计划")

# Keyword -> column suggested for it, in order.
SUGGESTED = (("节假日", "is_holiday_period"), ("假期", "holiday_count"), ("天气", "weather_index"), ("气温", "temperature"),
             ("油价", "fuel_price"), ("航油", "jet_fuel_price"), ("促销", "promotion_flag"), ("股票", "market_index"),
             ("指数", "market_index"), ("宏观", "macro_indicator"), ("gdp", "gdp"), ("cpi", "cpi"))

# Words of a topic, and the ids or categories of the sources that the topic asks for.
SOURCE_TOPICS = {
    "calendar": {"words": ("节假日", "假期", "日历"), "ids": ("holiday_calendar_cn",), "categories": ()},
    "market": {"words": ("股票", "指数", "行情", "油价", "宏观", "cpi", "gdp", "汇率", "利率"), "ids": (),
               "categories": ("connector_placeholder", "external_registry", "user_upload")},
    "weather": {"words": ("天气", "气温"), "ids": ("weather_connector_placeholder", "user_covariate_csv"), "categories": ()},
}
CONFIDENCE = {"feature_engineering_data": 0.9, "custom_model": 0.9, "hybrid": 0.86, "unsupported": 0.9, "clarify": 0.62}


def has_any(text: Column, words) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def _plain(col) -> Column:
    return F.lower(F.trim(F.col(col) if isinstance(col, str) else col))


def _with_plain(df: DataFrame, col) -> DataFrame:
    """``_x``: the text in lower case, made once per row.

    Searches joined by OR are evaluated one after the other, and Spark would
    repeat the lowering for each; an explode of one element keeps it apart.
    """
    return df.select("*", F.explode(F.array(_plain(col))).alias("_x"))


def route_text(df: DataFrame, col: str) -> DataFrame:
    """Adds ``route`` and ``confidence``: unsupported before hybrid or custom_model before data before clarify."""
    text = F.col("_x")
    found = F.struct(has_any(text, DATA_WORDS).alias("data"), has_any(text, MODEL_WORDS).alias("model"),
                     has_any(text, UNSUPPORTED_WORDS).alias("no"))
    flags = _with_plain(df, col).select("*", F.explode(F.array(found)).alias("_k"))
    k = F.col("_k")
    route = (F.when(k["no"], "unsupported")
             .when(k["data"] & k["model"], F.when(has_any(text, JOIN_WORDS), "hybrid").otherwise("custom_model"))
             .when(k["model"], "custom_model").when(k["data"], "feature_engineering_data").otherwise("clarify"))
    table = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return flags.withColumn("route", route).withColumn("confidence", table[F.col("route")]).drop("_k", "_x")


def leakage_terms(df: DataFrame, col: str) -> DataFrame:
    """Adds ``leak_warning``, ``covariate_kind`` and ``suggested_columns``; needs ``route``."""
    text = F.col("_x")
    uses_data = F.col("route").isin("feature_engineering_data", "hybrid")
    kind = F.when(uses_data | (F.col("route") == "clarify"),
                  F.when(has_any(text, KNOWN_FUTURE_WORDS), "known_future").otherwise("static"))
    found = F.array_distinct(texts(*[F.when(text.contains(w), c) for w, c in SUGGESTED]))
    out = _with_plain(df, col).select("*", F.explode(F.array(found)).alias("_found"))
    return out.withColumns({
        "leak_warning": F.coalesce(uses_data & has_any(text, UNKNOWN_FUTURE_WORDS), F.lit(False)), "covariate_kind": kind,
        "suggested_columns": F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(F.lit("external_covariate")))}).drop("_x", "_found")


@dataclass(frozen=True)
class DataSource:
    source_id: str
    name: str
    category: str
    description: str
    availability: str
    freqs: tuple[str, ...]
    fallback: bool = False

    @property
    def topics(self) -> tuple[str, ...]:
        return tuple(t for t, rule in SOURCE_TOPICS.items() if self.source_id in rule["ids"] or self.category in rule["categories"])

    @property
    def haystack(self) -> str:
        return " ".join((self.source_id, self.name, self.description, self.availability)).strip().lower()


# The registered sources; queries are matched against these texts.
REGISTRY = (
    DataSource("holiday_calendar_cn", "中国节假日日历", "built_in", "由 Holiday Generator 生成节假日、节日前后窗口和距离特征。",
               "known_future", ("D", "W", "M")),
    DataSource("same_sheet_future_rows", "同一 Sheet 未来空目标行", "user_upload", "用户在同一表格中提供未来时间点的协变量，目标列留空。",
               "known_future", ("H", "D", "W", "M", "Q", "Y"), True),
    DataSource("user_covariate_csv", "用户上传协变量 CSV/XLSX", "user_upload", "上传与目标时间轴可对齐的外部数据，进入 Covariate Loader。",
               "unknown_future", ("H", "D", "W", "M", "Q", "Y"), True),
    DataSource("market_index_connector_placeholder", "行情/指数连接器占位", "connector_placeholder", "用于登记股票指数、商品价格、油价等外部行情来源；当前版本不自动抓取。",
               "unknown_future", ("D", "W", "M")),
    DataSource("weather_connector_placeholder", "天气连接器占位", "connector_placeholder", "用于登记历史天气或天气预报来源；当前版本只生成接口计划。",
               "unknown_future", ("H", "D")),
    DataSource("macro_indicator_registry", "宏观指标登记表", "external_registry", "用于登记 GDP、CPI、汇率、利率等低频外部指标，不自动下载。",
               "unknown_future", ("M", "Q", "Y")),
)


def match_sources(df: DataFrame, col: str = "query", key: str = "query_id", freq: str | None = None,
                  sources: Iterable[DataSource] = REGISTRY) -> DataFrame:
    """Sources that fit each query: key, place, source_id.

    A source fits if it supports the frequency (column ``freq``) and contains a
    token of the query or is listed under the query's topic; an empty query
    fits all; a query that fits none gets the fallback sources.  The registry
    is a short Python list, so it is part of the plan and nothing is joined.
    """
    sources = list(sources)
    text = F.col("_x")
    wanted = F.upper(F.coalesce(F.col(freq), F.lit(""))) if freq else F.lit("")
    # the first topic found decides, in the order calendar, market, weather
    topic = F.coalesce(*[F.when(has_any(text, rule["words"]), F.lit(t)) for t, rule in SOURCE_TOPICS.items()])
    # only tokens that occur in some source can matter; one search drops the rest
    every = F.lit(" ".join(s.haystack for s in sources))
    tokens = F.filter(F.array_distinct(F.split(text, r"[^\p{L}\p{N}_]+")), lambda x: (x != "") & every.contains(x))
    rows = _with_plain(df, col).select(F.col(key), F.explode(F.array(F.struct(
        text.alias("text"), wanted.alias("freq"), topic.alias("topic"), tokens.alias("tokens")))).alias("_q"))
    q = F.col("_q")

    def fits(s: DataSource) -> Column:
        hay = F.lit(s.haystack)
        by_topic = F.coalesce(q["topic"].isin(*s.topics), F.lit(False)) if s.topics else F.lit(False)
        shared = F.exists(q["tokens"], lambda w: hay.contains(w))
        return ((q["freq"] == "") | q["freq"].isin(*s.freqs)) & ((q["text"] == "") | by_topic | shared)

    def item(i: int) -> Column:
        return F.struct(F.lit(i + 1).alias("place"), F.lit(sources[i].source_id).alias("source_id"))

    hits = F.array_compact(F.array(*[F.when(fits(s), item(i)) for i, s in enumerate(sources)]))
    spare = F.array(*[item(i) for i, s in enumerate(sources) if s.fallback])
    out = rows.select(key, hits.alias("_hit"))
    return out.select(key, F.explode(F.when(F.size("_hit") > 0, F.col("_hit")).otherwise(spare)).alias("_s")).select(key, "_s.*")


def routing_scores(routed: DataFrame, labels: DataFrame, key: str = "name") -> DataFrame:
    """One row: cases, route accuracy and recall of the leakage warning.

    ``labels``: key, expected_route, needs_warning; ``routed``: key, route, leak_warning.
    """
    both = labels.join(routed.select(key, "route", "leak_warning"), key)
    need = F.col("needs_warning")
    return both.agg(
        F.count("*").alias("cases"), F.avg((F.col("route") == F.col("expected_route")).cast("double")).alias("route_accuracy"),
        F.coalesce(F.avg(F.when(need, F.col("leak_warning").cast("double"))), F.lit(1.0)).alias("leakage_recall"))
