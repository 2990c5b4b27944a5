"""Crawler configurations kept as JSON text, and JSON export of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIG_SCHEMA = (
    "struct<id:string,userAgent:string,seeds:array<string>,"
    "uriFilter:struct<filterClass:string,rules:array<string>>,tests:array<string>,"
    "crawlerName:string,crawlDelayMillis:int,crawlTimeoutMillis:bigint,maxDepth:int,"
    "maxFetches:int,maxQueueSize:int,maxRequestFails:double>"
)

# Fixed value: format of dates in JSON.
JSON_DATE = "yyyy-MM-dd'T'HH:mm:ss.SSSxx"


def parse_configs(crawlers: DataFrame, text: str = "config_json") -> DataFrame:
    """Typed columns of each configuration; malformed JSON fails the query."""
    c = F.from_json(text, CONFIG_SCHEMA, {"mode": "FAILFAST"})
    return crawlers.select("crawler_id", F.inline(F.array(c))).select(
        "crawler_id",
        F.col("id").alias("config_id"),
        F.col("userAgent").alias("user_agent"),
        "seeds",
        F.col("uriFilter.filterClass").alias("filter_class"),
        F.col("uriFilter.rules").alias("rule_lines"),
        "tests",
        F.col("crawlerName").alias("crawler_name"),
        F.col("crawlDelayMillis").alias("crawl_delay_ms"),
        F.col("crawlTimeoutMillis").alias("crawl_timeout_ms"),
        F.col("maxDepth").alias("max_depth"),
        F.col("maxFetches").alias("max_fetches"),
        F.col("maxQueueSize").alias("max_queue_size"),
        F.col("maxRequestFails").alias("max_request_fails"),
    )


def config_json() -> Column:
    """JSON text of the typed columns, the inverse of ``parse_configs``."""
    return F.to_json(
        F.struct(
            F.col("config_id").alias("id"),
            F.col("user_agent").alias("userAgent"),
            "seeds",
            F.struct(
                F.col("filter_class").alias("filterClass"), F.col("rule_lines").alias("rules")
            ).alias("uriFilter"),
            "tests",
            F.col("crawler_name").alias("crawlerName"),
            F.col("crawl_delay_ms").alias("crawlDelayMillis"),
            F.col("crawl_timeout_ms").alias("crawlTimeoutMillis"),
            F.col("max_depth").alias("maxDepth"),
            F.col("max_fetches").alias("maxFetches"),
            F.col("max_queue_size").alias("maxQueueSize"),
            F.col("max_request_fails").alias("maxRequestFails"),
        )
    )


def find_config(crawlers: DataFrame, crawler_id: str) -> DataFrame:
    return crawlers.filter(F.col("crawler_id") == crawler_id)


def all_configs(configs: DataFrame) -> DataFrame:
    return configs.orderBy(F.lower("crawler_name"), "crawler_id")


def delete_configs(crawlers: DataFrame, ids: DataFrame) -> DataFrame:
    return crawlers.join(ids.select("crawler_id"), "crawler_id", "left_anti")


def rows_as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON document per row, dates in ISO form."""
    return df.select(F.to_json(F.struct("*"), {"timestampFormat": JSON_DATE}).alias(name))
