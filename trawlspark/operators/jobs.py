"""Job snapshots: latest state, listings by crawler and by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(snapshots: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last written row per key, as an overwrite by primary key leaves it.

    ``max_by`` keeps one row per key on each task before the shuffle; a window
    would move every snapshot. Of rows that are equal in ``order`` the one with the
    largest hash counts, so reruns agree.
    """
    rest = [c for c in snapshots.columns if c not in keys]
    hashed = [c for c in rest if snapshots.schema[c].dataType.typeName() not in ("map", "variant")]
    return (
        snapshots.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*hashed))).alias("_row"))
        .select(*keys, "_row.*")
    )


def latest_jobs(snapshots: DataFrame) -> DataFrame:
    """Last snapshot per job; a finished one is never replaced by a running one."""
    ranked = snapshots.withColumn("_finished", F.col("finished_ms").isNotNull())
    return latest(ranked, ["job_id"], ["_finished", "snapshot_ms"]).drop("_finished")


def find_job(jobs: DataFrame, crawler_id, job_id) -> DataFrame:
    """The job of a crawler with an id."""
    return jobs.filter((F.col("crawler_id") == crawler_id) & (F.col("job_id") == job_id))


def jobs_of_crawler(jobs: DataFrame, crawler_id) -> DataFrame:
    return jobs.filter(F.col("crawler_id") == crawler_id).orderBy(F.desc("created_ms"), "job_id")


def jobs_of_day(jobs: DataFrame, day: str | None = None) -> DataFrame:
    """Jobs of one day (today unless given as yyyy-MM-dd), newest first."""
    date = F.current_date() if day is None else F.to_date(F.lit(day), "yyyy-MM-dd")
    return jobs.filter(F.col("partition_date") == date).orderBy(F.desc("created_ms"), "job_id")


def newest_log(log: DataFrame, job_id) -> DataFrame:
    return log.filter(F.col("job_id") == job_id).orderBy(F.desc("log_time"), "uri")


def newest_entry_per_job(log: DataFrame) -> DataFrame:
    return latest(log, ["job_id"], ["log_time", "event_id"])
