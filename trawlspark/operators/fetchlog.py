"""Counters, running totals and schedules over the fetch log.

The log: job_id, event_id, log_time, log_ms, uri, site, depth, status,
content_type, content_length, links_extracted, fetch_duration. Order inside a
job is (log_time, event_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.http import is_fail, is_redirect, is_success
from ..functions.text import format_bytes, format_elapsed
from .skew import Running, running

ORDER = ["log_time", "event_id"]
# registers of a sketch, as a power of two
SKETCH_BITS = 12


def fetch_counters(log: DataFrame) -> DataFrame:
    status = F.col("status")
    return log.groupBy("job_id").agg(
        F.count("*").alias("fetch_attempts"),
        F.count_if(is_success(status)).alias("fetch_succeeds"),
        F.count_if(is_fail(status)).alias("fetch_fails"),
        F.count_if(is_redirect(status)).alias("redirects"),
    )


def response_counters(log: DataFrame) -> DataFrame:
    return log.groupBy("job_id", F.col("status").cast("string").alias("status_code")).agg(
        F.count("*").alias("responses")
    )


def media_counters(log: DataFrame) -> DataFrame:
    """Documents and bytes per full content type, successful fetches only."""
    return (
        log.filter(is_success(F.col("status")))
        .groupBy("job_id", F.coalesce("content_type", F.lit("undefined")).alias("media_type"))
        .agg(
            F.count("*").alias("documents"),
            F.sum(F.col("content_length").cast("bigint")).alias("total_bytes"),
        )
    )


def counter_maps(log: DataFrame) -> DataFrame:
    """The counters as maps, as job snapshots keep them.

    Counts are aggregated first; what is collected is one entry per distinct
    status or content type, a handful per job.
    """
    fetches = fetch_counters(log).select(
        "job_id",
        F.map_filter(
            F.create_map(
                F.lit("FetchAttempts"), "fetch_attempts",
                F.lit("FetchSucceeds"), "fetch_succeeds",
                F.lit("FetchFails"), "fetch_fails",
                F.lit("Redirects"), "redirects",
            ),
            lambda k, v: v > 0,
        ).alias("fetch_counters"),
    )
    responses = response_counters(log).groupBy("job_id").agg(
        F.map_from_entries(F.collect_list(F.struct("status_code", "responses"))).alias(
            "response_counters"
        )
    )
    media = media_counters(log).groupBy("job_id").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    F.col("media_type"),
                    F.struct(F.col("documents").alias("count"), F.col("total_bytes")),
                )
            )
        ).alias("media_counters")
    )
    return fetches.join(responses, "job_id", "left").join(media, "job_id", "left")


def job_summary(log: DataFrame) -> DataFrame:
    """One line per job from a single aggregation of the log."""
    status = F.col("status")
    ok = is_success(status)
    size = F.when(ok, F.col("content_length").cast("bigint"))
    sums = log.groupBy("job_id").agg(
        (F.max("log_ms") - F.min("log_ms")).alias("duration_ms"),
        F.count_if(ok).alias("files"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
        F.count_if(is_redirect(status)).alias("redirects"),
        F.count_if(is_fail(status)).alias("fails"),
    )
    average = F.floor(F.col("duration_ms") / F.greatest(F.col("files"), F.lit(1)))
    return sums.withColumn("avg_fetch_ms", average).withColumns(
        {
            "duration_text": format_elapsed(F.col("duration_ms")),
            "avg_fetch_text": format_elapsed(F.col("avg_fetch_ms")),
            "bytes_text": format_bytes(F.col("total_bytes")),
        }
    )


def job_breakdown(log: DataFrame) -> DataFrame:
    """The lower half of a job's summary: totals by content type, then by response code, each sorted by name.

    Columns: job_id, kind (type or code), place (from 1 within the kind), name, count, and of types
    total_bytes and bytes_text. The log is aggregated first; what is sorted is a row for each type or code.
    """
    types = media_counters(log).select(
        "job_id", F.lit("type").alias("kind"), F.col("media_type").alias("name"), F.col("documents").alias("count"), "total_bytes",
        format_bytes(F.col("total_bytes")).alias("bytes_text"),
    )
    codes = response_counters(log).select(
        "job_id", F.lit("code").alias("kind"), F.concat(F.lit("HTTP "), "status_code").alias("name"), F.col("responses").alias("count")
    )
    rows = types.unionByName(codes, allowMissingColumns=True)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("job_id", "kind").orderBy("name")))


def uri_totals(log: DataFrame, seeds: int = 1) -> DataFrame:
    """What a finished job reports: URIs seen (seeds and new links) and URIs still queued (seen less taken)."""
    sums = log.groupBy("job_id").agg(
        F.count("*").alias("_taken"), (F.lit(seeds) + F.sum(F.col("links_extracted").cast("bigint"))).alias("uris_seen")
    )
    return sums.select("job_id", "uris_seen", (F.col("uris_seen") - F.col("_taken")).alias("uris_queued"))


def uri_sketches(log: DataFrame, *by: str) -> DataFrame:
    """A mergeable sketch of the URIs of each job and, say, day or batch; kilobytes however many URIs there are."""
    return log.groupBy("job_id", *by).agg(F.hll_sketch_agg("uri", F.lit(SKETCH_BITS)).alias("sketch"))


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """Estimated distinct URIs of each job, from sketches of its parts; off by about 1.6 % (one deviation)."""
    return sketches.groupBy("job_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("uris_seen"))


def uri_counts(log: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct URIs per job. Exact counts first drop repeats per (job, uri), so a
    hot job is spread over its URIs; the estimate suits monitoring."""
    if approximate:
        return log.groupBy("job_id").agg(F.approx_count_distinct("uri").alias("uris_seen"))
    return log.groupBy("job_id", "uri").agg(F.lit(1).alias("_one")).groupBy("job_id").agg(
        F.count("*").alias("uris_seen")
    )


def running_log(
    log: DataFrame, seeds: int = 1, new_links: str = "links_extracted", hot_rows: int | None = None
) -> DataFrame:
    """Totals each log row carries: ``fetches`` with this row; ``uris_seen`` before
    its links are added; ``uris_queued`` = seen - taken from the queue."""
    ok = (is_success(F.col("status"))).cast("bigint")
    out = running(
        log,
        ["job_id"],
        ORDER,
        {
            "pos": Running(F.lit(1).cast("bigint")),
            "fetches": Running(ok),
            "_found": Running(F.col(new_links).cast("bigint"), before=True),
        },
        hot_rows,
    )
    return (
        out.withColumn("uris_seen", F.lit(seeds) + F.col("_found"))
        .withColumn("uris_queued", F.col("uris_seen") - F.col("pos"))
        .drop("_found")
    )


def log_progress(log: DataFrame, seeds: int = 1, hot_rows: int | None = None) -> DataFrame:
    """State just before each logged fetch, as the stop rule is asked for it."""
    status = F.col("status")
    out = running(
        log,
        ["job_id"],
        ORDER,
        {
            "pos": Running(F.lit(1).cast("bigint")),
            "succeeds": Running((is_success(status)).cast("bigint"), before=True),
            "fails": Running((is_fail(status)).cast("bigint"), before=True),
            "_found": Running(F.col("links_extracted").cast("bigint"), before=True),
            # the first time of the job, as a running maximum of negated times
            "started_ms": Running(-F.col("log_ms"), "max"),
        },
        hot_rows,
    )
    return (
        out.withColumn("started_ms", -F.col("started_ms"))
        .withColumn("seeds", F.lit(seeds))
        .withColumn("attempts", F.col("pos") - 1)
        .withColumn("pending", F.lit(seeds) + F.col("_found") - F.col("attempts"))
        .drop("_found")
    )


def timed_out(timeout_ms: int) -> Column:
    """Has a job run longer than allowed? For rows of ``log_progress``."""
    return F.col("log_ms") > F.col("started_ms") + timeout_ms


def politeness_schedule(
    log: DataFrame, delay_ms: Column, hot_rows: int | None = None
) -> DataFrame:
    """Planned start of each fetch: every fetch waits its delay after the end of
    the one before; a job fetches one URI at a time."""
    rows = log.withColumn("delay_ms", delay_ms.cast("bigint"))
    out = running(
        rows,
        ["job_id"],
        ORDER,
        {
            "_waits": Running(F.col("delay_ms")),
            "_busy": Running(F.col("fetch_duration").cast("bigint"), before=True),
        },
        hot_rows,
    )
    return out.withColumn("planned_ms", F.col("_waits") + F.col("_busy")).drop("_waits", "_busy")


def politeness_gap(log: DataFrame, delay_ms: Column, hot_rows: int | None = None) -> DataFrame:
    """Gap to the previous fetch of the same job and site against the delay due."""
    rows = log.withColumn("delay_ms", delay_ms.cast("bigint"))
    out = running(
        rows,
        ["job_id", "site"],
        ORDER,
        {"_previous": Running(F.col("log_ms"), "max", before=True)},
        hot_rows,
    )
    return (
        out.withColumn("gap_ms", F.col("log_ms") - F.col("_previous"))
        .withColumn("too_soon", F.coalesce(F.col("gap_ms") < F.col("delay_ms"), F.lit(False)))
        .drop("_previous")
    )
