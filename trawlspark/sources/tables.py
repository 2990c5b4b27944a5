"""Parquet tables of a crawl: documents, metadata, fetch log and jobs.

Layouts follow how the tables are read: documents and metadata by job, the log
by job and newest first, jobs by day. Files are sorted on the read key, so that
row-group statistics skip the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.http import is_success

# Days a row is kept, per table; crawler configurations stay.
RETENTION_DAYS = {
    "job_by_crawler": 30,
    "document": 30,
    "document_metadata": 30,
    "job_by_date": 7,
    "fetch_log": 7,
}

DAY_MS = 24 * 60 * 60 * 1000

# job buckets of a table: jobs are many, so they are not folders of their own
JOB_BUCKETS = 64


def bucket_of(job: Column | str) -> Column:
    """Folder of a job. A stable hash of the id, so that a read of one job prunes
    to one folder while many small jobs share it."""
    return F.pmod(F.xxhash64(F.col(job) if isinstance(job, str) else job), JOB_BUCKETS).cast("int")


def _write_by_job(df: DataFrame, path: str, order: list[str], mode: str) -> None:
    # rebalancing gathers a bucket, and cuts it again where a hot job makes it too
    # large for one writer
    (
        df.withColumn("job_bucket", bucket_of(F.col("job_id").cast("string")))
        .hint("rebalance", "job_bucket")
        .sortWithinPartitions("job_bucket", "job_id", *order)
        .write.mode(mode)
        .partitionBy("job_bucket")
        .parquet(path)
    )


def write_documents(docs: DataFrame, path: str, mode: str = "append") -> None:
    _write_by_job(docs, path, ["uri"], mode)


def write_metadata(meta: DataFrame, path: str, mode: str = "append") -> None:
    _write_by_job(meta, path, ["uri"], mode)


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    _write_by_job(log, path, ["log_time", "uri"], mode)


def of_job(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    """Rows of one job: one folder is listed, row groups are skipped on job_id."""
    bucket = bucket_of(F.lit(str(job_id)))
    return (
        spark.read.parquet(path)
        .filter((F.col("job_bucket") == bucket) & (F.col("job_id") == job_id))
        .drop("job_bucket")
    )


def find_document(spark: SparkSession, path: str, job_id: str, uri: str) -> DataFrame:
    return of_job(spark, path, job_id).filter(F.col("uri") == uri)


def find_documents(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Documents of many keys (job_id, uri): a semi-join by folder, job and URI."""
    wanted = keys.select("job_id", "uri").withColumn("job_bucket", bucket_of(F.col("job_id").cast("string")))
    return spark.read.parquet(path).join(wanted, ["job_bucket", "job_id", "uri"], "left_semi").drop("job_bucket")


def metadata_of_job(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    return of_job(spark, path, job_id).orderBy("depth", "fetched", "uri")


def log_of_job(spark: SparkSession, path: str, job_id: str, first: bool = False) -> DataFrame:
    newest = of_job(spark, path, job_id).orderBy(F.desc("log_time"), "uri")
    return newest.limit(1) if first else newest


def write_jobs(jobs: DataFrame, by_date: str, by_crawler: str, mode: str = "append") -> None:
    """The same rows in two layouts, one per access path."""
    (
        jobs.hint("rebalance", "partition_date")
        .sortWithinPartitions(F.desc("created_ms"), "job_id")
        .write.mode(mode)
        .partitionBy("partition_date")
        .parquet(by_date)
    )
    (
        jobs.repartitionByRange("crawler_id", F.desc("created_ms"))
        .sortWithinPartitions("crawler_id", F.desc("created_ms"))
        .write.mode(mode)
        .parquet(by_crawler)
    )


def document_rows(responses: DataFrame, *more: str) -> DataFrame:
    """Document table rows, with more columns; an absent content type is written as "undefined"."""
    return responses.select(
        *more,
        "crawler_id",
        "job_id",
        "uri",
        F.coalesce("content_type", F.lit("undefined")).alias("content_type"),
        "content",
    )


def metadata_rows(responses: DataFrame, *more: str) -> DataFrame:
    return responses.select(
        *more,
        "crawler_id",
        "job_id",
        "uri",
        F.coalesce("content_type", F.lit("undefined")).alias("content_type"),
        "content_length",
        "depth",
        "fetched",
        F.col("status").cast("string").alias("response_status"),
    )


def retained(df: DataFrame, table: str, written_ms: str, asof_ms: Column) -> DataFrame:
    """Rows still within the table's time to live at ``asof_ms``."""
    days = RETENTION_DAYS.get(table)
    return df if days is None else df.filter(F.col(written_ms) >= asof_ms - days * DAY_MS)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without a newer version, and the new ones."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def succeeded(responses: DataFrame) -> DataFrame:
    return responses.filter(is_success(F.col("status")))


def unpack_media(packed: Column) -> Column:
    """Media counters stored as ``"count,bytes"`` text, as a map of structs."""
    return F.transform_values(
        packed,
        lambda _, v: F.struct(
            F.split(v, ",")[0].cast("bigint").alias("count"),
            F.split(v, ",")[1].cast("bigint").alias("total_bytes"),
        ),
    )
