"""Continuous counters, job states, and filters of a link stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.http import is_fail, is_redirect, is_success
from ..functions.rules import FIRST_MATCH, Rule
from ..operators.frontier import decide
from .journal import JOB_COLUMNS


def running_counters(events: DataFrame) -> DataFrame:
    """Counters per job for ``update`` mode; pre-aggregated before the shuffle."""
    status = F.col("status")
    return events.groupBy("job_id").agg(
        F.count("*").alias("fetch_attempts"),
        F.count_if(is_success(status)).alias("fetch_succeeds"),
        F.count_if(is_fail(status)).alias("fetch_fails"),
        F.count_if(is_redirect(status)).alias("redirects"),
    )


def job_states(events: DataFrame) -> DataFrame:
    """Latest state per job for ``update`` mode and a 10 s trigger; a finished
    state wins over any running one, however late that arrives."""
    rest = [c for c in JOB_COLUMNS if c != "job_id"]
    order = F.struct(F.col("finished_ms").isNotNull(), F.col("snapshot_ms"))
    return (
        events.groupBy("job_id")
        .agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select("job_id", "_row.*")
    )


def unseen_links(
    links: DataFrame, event_time: str | None = None, bound: str | None = None
) -> DataFrame:
    """First appearance of each (job_id, uri). State grows with the distinct URIs
    unless ``bound`` limits how long one is remembered: a repeat within it is dropped,
    one after the watermark has passed it and a batch has evicted it counts as new.
    Rows older than the watermark are dropped."""
    if event_time is None or bound is None:
        return links.dropDuplicates(["job_id", "uri"])
    return links.withWatermark(event_time, bound).dropDuplicatesWithinWatermark(["job_id", "uri"])


def decided_links(
    links: DataFrame, rules: list[Rule], robots: DataFrame | None, kind: str = FIRST_MATCH
) -> DataFrame:
    """Fetch decision per link; robots rules are a static side of the join."""
    return decide(links, rules, robots, kind)
