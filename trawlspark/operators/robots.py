"""Robots rules as a table, and the joins against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.robots import allowed, parse_robots

# Fixed value: rules are reloaded after one day.
EXPIRY_MS = 24 * 60 * 60 * 1000


def robots_rules(files: DataFrame, user_agent: str | Column, body: str = "body") -> DataFrame:
    """Parse one robots file per row for ``user_agent``; narrow, no shuffle."""
    agent = F.lit(user_agent) if isinstance(user_agent, str) else user_agent
    keep = [c for c in files.columns if c not in (body, "user_agent")]
    rules = parse_robots(F.col(body), F.col("user_agent"))
    return files.withColumn("user_agent", agent).select(
        *keep, "user_agent", F.inline(F.array(rules))
    )


def with_rules(uris: DataFrame, rules: DataFrame, *columns: str) -> DataFrame:
    """Left join of URIs to the rules of their (user_agent, site).

    Without a hint: Spark broadcasts the rules while their size is below its
    threshold; beyond it AQE splits the sites that hold too many URIs.
    """
    return uris.join(
        rules.select("user_agent", "site", *columns), ["user_agent", "site"], "left"
    )


def robots_allow(
    uris: DataFrame, rules: DataFrame, path: str = "path", ignore_empty: bool = False
) -> DataFrame:
    """Add ``allowed``; sites without rules allow everything."""
    return (
        with_rules(uris, rules, "allows", "disallows")
        .withColumn(
            "allowed", allowed(F.col(path), F.col("allows"), F.col("disallows"), ignore_empty)
        )
        .drop("allows", "disallows")
    )


def robots_delay(uris: DataFrame, rules: DataFrame, config_ms: Column) -> DataFrame:
    """Add ``delay_ms``: the longer of the site's and the configured delay."""
    return (
        with_rules(uris, rules, "crawl_delay_ms")
        .withColumn("delay_ms", F.greatest(F.col("crawl_delay_ms"), config_ms))
        .drop("crawl_delay_ms")
    )


def stale_sites(needed: DataFrame, rules: DataFrame, asof_ms: Column) -> DataFrame:
    """Distinct (user_agent, site) that have no rules or only expired ones."""
    fresh = rules.filter(F.col("expires_ms") >= asof_ms).select("user_agent", "site")
    return needed.select("user_agent", "site").distinct().join(
        fresh, ["user_agent", "site"], "left_anti"
    )


def listed(rules: DataFrame, column: str) -> DataFrame:
    """One row per listed sitemap or host."""
    return rules.select("site", "user_agent", F.explode(column).alias("value"))
