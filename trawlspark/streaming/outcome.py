"""Stop rule on the stream: the outcome of each job is emitted once.

Per micro-batch the running totals of its rows are computed by the same
skew-proof prefix sums as in batch and added to the totals of earlier batches,
which live in a small per-job table next to the output. No group is ever handed
to one Python worker. Of each job with rows a batch also leaves one row of
progress; ``timers`` reads these and ends jobs that fall silent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import stop
from ..functions.http import is_fail, is_success
from ..operators.fetchlog import log_progress, timed_out
from ..session import delete_folder

TOTALS = ["n", "ok", "bad", "found"]
STATE = ", ".join(f"{c} bigint" for c in TOTALS) + ", started_ms bigint, seen_ms bigint, stopped boolean"
PROGRESS = "clock_ms bigint, started_ms bigint, seen_ms bigint, n bigint, stop_pos bigint, state string, message string, late_state string, late_message string"


def job_type(df: DataFrame) -> str:
    return df.schema["job_id"].dataType.simpleString()


def _state_before(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Totals after the batch before; only the first batch has none, so a missing folder is an error."""
    schema = f"job_id {job_type(batch)}, {STATE}"
    if batch_id == 0:
        return batch.sparkSession.createDataFrame([], schema)
    return batch.sparkSession.read.schema(schema).parquet(f"{path}/state/{batch_id - 1}")


def write_batch(
    batch: DataFrame,
    batch_id: int,
    path: str,
    seeds: int,
    max_queue: int,
    max_fetches: int,
    max_fail: float,
    hot_rows: int | None = None,
    timeout_ms: int | None = None,
) -> None:
    spark = batch.sparkSession
    limits = [F.lit(max_queue), F.lit(max_fetches), F.lit(max_fail)]
    # totals after batch k are in state/k, so a repeated batch starts from the same ones
    state = _state_before(batch, path, batch_id)
    batch = batch.persist()
    try:
        earlier = state.withColumnRenamed("started_ms", "first_ms").drop("seen_ms")
        progress = log_progress(batch, seeds, hot_rows).join(earlier, "job_id", "left")
        for column, before in [
            ("pos", "n"), ("attempts", "n"), ("succeeds", "ok"), ("fails", "bad"),
        ]:
            progress = progress.withColumn(
                column, F.col(column) + F.coalesce(before, F.lit(0))
            )
        progress = progress.withColumns(
            {
                "pending": F.col("pending") + F.coalesce("found", F.lit(0)) - F.coalesce("n", F.lit(0)),
                "started_ms": F.least("started_ms", "first_ms"),
            }
        )
        late = F.lit(False) if timeout_ms is None else timed_out(timeout_ms)
        rule = stop.stop_outcome(
            F.col("pending"), F.col("succeeds"), F.col("attempts"), F.col("fails"),
            F.col("seeds"), *limits, late,
        )
        stops = (
            progress.filter(~F.coalesce("stopped", F.lit(False)))
            .select("job_id", "pos", F.inline(F.array(rule)))
            .filter(F.col("state") != stop.KEEP[0])
            .groupBy("job_id")
            .agg(F.min(F.struct("pos", "state", "message")).alias("_s"))
            .select(
                "job_id",
                F.col("_s.pos").alias("stop_pos"),
                F.col("_s.state").alias("state"),
                F.col("_s.message").alias("message"),
            )
        )
        stops.write.mode("overwrite").parquet(f"{path}/outcome/batch_id={batch_id}")
        emitted = spark.read.schema(stops.schema).parquet(f"{path}/outcome/batch_id={batch_id}")
        status = F.col("status")
        added = batch.groupBy("job_id").agg(
            F.count("*").alias("n"),
            F.count_if(is_success(status)).alias("ok"),
            F.count_if(is_fail(status)).alias("bad"),
            F.sum(F.col("links_extracted").cast("bigint")).alias("found"),
            F.min("log_ms").alias("started_ms"),
            F.max("log_ms").alias("seen_ms"),
            F.lit(False).alias("stopped"),
        )
        ended = emitted.select(
            "job_id",
            *[F.lit(0).cast("bigint").alias(c) for c in TOTALS],
            *[F.lit(None).cast("bigint").alias(c) for c in ("started_ms", "seen_ms")],
            F.lit(True).alias("stopped"),
        )
        (
            state.unionByName(added)
            .unionByName(ended)
            .groupBy("job_id")
            .agg(
                *[F.sum(c).alias(c) for c in TOTALS],
                F.min("started_ms").alias("started_ms"),
                F.max("seen_ms").alias("seen_ms"),
                F.bool_or("stopped").alias("stopped"),
            )
            .write.mode("overwrite")
            .parquet(f"{path}/state/{batch_id}")
        )
        # a repeated batch needs the totals of the batch before; older ones have had their use
        delete_folder(spark, f"{path}/state/{batch_id - 2}")
        _write_progress(batch, emitted, batch_id, path, seeds, limits)
    finally:
        batch.unpersist()


def _write_progress(
    batch: DataFrame, emitted: DataFrame, batch_id: int, path: str, seeds: int, limits: list[Column]
) -> None:
    """One row for each job of the batch: its totals, its stop, and what the rule says if time runs out now.

    The clock is the latest time of any job so far, so it never runs back from batch to batch.
    """
    spark = batch.sparkSession
    totals = spark.read.schema(f"job_id {job_type(batch)}, {STATE}").parquet(f"{path}/state/{batch_id}")
    pending = F.lit(seeds) + F.col("found") - F.col("n")
    late = stop.stop_outcome(
        pending, F.col("ok"), F.col("n"), F.col("bad"), F.lit(seeds), *limits, F.lit(True)
    )
    clock = totals.agg(F.max("seen_ms")).first()[0]
    (
        batch.select("job_id").distinct().join(totals, "job_id").join(emitted, "job_id", "left")
        .withColumn("_late", late)
        .select(
            "job_id", F.lit(clock).cast("bigint").alias("clock_ms"), "started_ms", "seen_ms", "n", "stop_pos", "state", "message",
            F.col("_late.state").alias("late_state"), F.col("_late.message").alias("late_message"),
        )
        .write.mode("overwrite")
        .parquet(f"{path}/progress/batch_id={batch_id}")
    )


def outcome_stream(
    log: DataFrame,
    path: str,
    checkpoint: str,
    seeds: int,
    max_queue: int,
    max_fetches: int,
    max_fail: float,
    interval: str | None = None,
    hot_rows: int | None = None,
    timeout_ms: int | None = None,
) -> DataStreamWriter:
    """``log`` must reach the stream in job order: rows of a later batch come later.

    ``job_id`` has any type. With ``timeout_ms`` a row later than that after its job's first stops it.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, path, seeds, max_queue, max_fetches, max_fail, hot_rows, timeout_ms)

    writer = log.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/outcome").drop("batch_id")
