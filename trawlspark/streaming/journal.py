"""The journal: fetch events in, document, metadata, log and job tables out.

Each micro-batch writes one folder per table named after the batch, in
overwrite mode. A batch that is run again after a failure replaces its own
folder, so the tables hold every event once. Folders of old batches are
compacted into one. Which version of a document counts is decided by its keys
and numbers alone; bodies are fetched afterwards, and never sorted or aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.jobs import latest_jobs
from ..session import delete_folder, list_folders
from ..sources.tables import document_rows, metadata_rows

STARTED, FETCHED, STOPPED = "started", "fetched", "stopped"

LOG_COLUMNS = [
    "crawler_id", "job_id", "event_id", "log_time", "uri", "depth", "status", "content_type",
    "content_length", "links_extracted", "fetch_duration",
]
JOB_COLUMNS = [
    "job_id", "crawler_id", "partition_date", "created_ms", "snapshot_ms", "finished_ms",
    "state", "message",
]
TABLES = ["document", "document_metadata", "fetch_log", "job"]
# tables with one row a key, and what tells a row's versions apart
KEYED = ["document", "document_metadata"]
VERSION = ["batch_id", "event_id", "row_no"]


def job_snapshots(events: DataFrame) -> DataFrame:
    """Job rows carried by the events: one snapshot per start, fetch and stop."""
    return events.select(*JOB_COLUMNS)


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """All four tables of one micro-batch; its rows are read once."""
    batch = batch.persist()
    try:
        fetched = batch.filter(F.col("event_type") == FETCHED)
        named = fetched.withColumns({"fetched": F.col("log_time"), "row_no": F.monotonically_increasing_id()})
        rows = {
            "document": document_rows(named, "event_id", "row_no"),
            "document_metadata": metadata_rows(named, "event_id", "row_no"),
            "fetch_log": fetched.select(*LOG_COLUMNS),
            # one row per job and batch: a job is written once however many events it had
            "job": latest_jobs(job_snapshots(batch)),
        }
        for table, df in rows.items():
            df.write.mode("overwrite").parquet(f"{path}/{table}/batch_id={batch_id}")
    finally:
        batch.unpersist()


def journal(
    events: DataFrame, path: str, checkpoint: str, interval: str | None = "10 seconds"
) -> DataStreamWriter:
    """Writer of the journal; with no ``interval`` it stops when the input is read."""
    writer = events.writeStream.foreachBatch(
        lambda batch, batch_id: write_batch(batch, batch_id, path)
    ).option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval)


def _compacted(spark: SparkSession, path: str, table: str) -> int:
    """Last batch of the newest complete compaction; -1 if there is none."""
    folder = f"{path}/{table}_compacted"
    found = [int(name.removeprefix("upto=")) for name in list_folders(spark, folder) or []]
    return max((k for k in found if "_SUCCESS" in (list_folders(spark, f"{folder}/upto={k}") or [])), default=-1)


def stored_rows(spark: SparkSession, path: str, table: str) -> DataFrame:
    """All rows of a journal table with their batch_id: the newest compaction, and the batches after it."""
    upto = _compacted(spark, path, table)
    names = [n for n in list_folders(spark, f"{path}/{table}") or [] if n.startswith("batch_id=")]
    later = sorted(f"{path}/{table}/{n}" for n in names if int(n.removeprefix("batch_id=")) > upto)
    parts = []
    if upto >= 0:
        parts.append(spark.read.parquet(f"{path}/{table}_compacted/upto={upto}"))
    if later:
        parts.append(spark.read.option("basePath", f"{path}/{table}").parquet(*later).withColumn("batch_id", F.col("batch_id").cast("bigint")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def last_versions(rows: DataFrame) -> DataFrame:
    """The last version of each (job_id, uri): narrow rows of keys and numbers are reduced to the last, and
    whole rows only meet these in a hash join."""
    keys = ["job_id", "uri"]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*VERSION)).alias("_last"))
    last = last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in VERSION])
    return rows.join(last.hint("shuffle_hash"), [*keys, *VERSION], "left_semi")


def compact(spark: SparkSession, path: str, table: str, keep: int = 1) -> int:
    """Gather all batches but the last ``keep`` in one folder, without overtaken versions; returns its last batch.

    Readers switch to it when it is complete; only then the folders it replaces are deleted. Run again after
    a failure it starts afresh.
    """
    names = [n for n in list_folders(spark, f"{path}/{table}") or [] if n.startswith("batch_id=")]
    batches = sorted(int(n.removeprefix("batch_id=")) for n in names)
    done, old = _compacted(spark, path, table), batches[: len(batches) - keep]
    if old and old[-1] > done:
        rows = stored_rows(spark, path, table).filter(F.col("batch_id") <= old[-1])
        rows = last_versions(rows) if table in KEYED else rows
        rows.hint("rebalance").write.mode("overwrite").parquet(f"{path}/{table}_compacted/upto={old[-1]}")
        done = old[-1]
    for batch in batches:
        if batch <= done:
            delete_folder(spark, f"{path}/{table}/batch_id={batch}")
    for name in list_folders(spark, f"{path}/{table}_compacted") or []:
        if int(name.removeprefix("upto=")) < done:
            delete_folder(spark, f"{path}/{table}_compacted/{name}")
    return done


def journal_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A journal table as of now. Keys written by several batches keep the last."""
    rows = stored_rows(spark, path, table)
    if table == "job":
        return latest_jobs(rows.drop("batch_id"))
    if table == "fetch_log":
        return rows.drop("batch_id")
    return last_versions(rows).drop(*VERSION)
