"""Jobs that end, by the stop rule or because their time ran out while nothing was fetched.

The stop rule is only asked when a fetch is logged, so it cannot end a job that has fallen silent. Here
each job has keyed state with a timer for its deadline. Input are the progress rows of ``outcome``, one for
each job and batch whatever the number of its fetches, so no job is a hot key.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from .outcome import PROGRESS, job_type

EVENT, PROCESSING = "EventTime", "ProcessingTime"
_STATE = "deadline bigint, ended boolean, n bigint, late_state string, late_message string"


class Deadlines(StatefulProcessor):
    """Emits (job_id, stop_pos, state, message, ended_ms) of each job once.

    A stop found by the rule counts if it comes before the deadline; from the deadline on the outcome is
    what the rule says of the last known totals. Rows of a job that has ended change nothing.
    """

    def __init__(self, timeout_ms: int, clock: str):
        self.timeout_ms, self.clock = timeout_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # no generator: the state's key is only set until this call returns
        rows = sorted(rows, key=lambda r: r["n"])
        known = self.job.get() if self.job.exists() else None
        if known is not None and known[1]:
            return iter([])
        # on the clock of the machine a job's time starts with its first row here
        now = timerValues.getCurrentProcessingTimeInMs() if self.clock == PROCESSING else rows[0]["started_ms"]
        deadline = known[0] if known is not None else now + self.timeout_ms
        last, stopped = rows[-1], next((r for r in rows if r["state"] is not None), None)
        totals = (last["n"], last["late_state"], last["late_message"])
        if known is not None and known[2] > last["n"]:  # a repeated batch
            totals = tuple(known[2:])
        self.job.update((deadline, stopped is not None, *totals))
        if stopped is None:
            if known is None:
                self.handle.registerTimer(deadline)
            return iter([])
        if known is not None:
            self.handle.deleteTimer(deadline)
        end = Row(job_id=key[0], stop_pos=stopped["stop_pos"], state=stopped["state"], message=stopped["message"], ended_ms=stopped["seen_ms"])
        return iter([end])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        deadline, ended, n, state, message = self.job.get()
        if not ended:
            self.job.update((deadline, True, n, state, message))
            yield Row(job_id=key[0], stop_pos=n + 1, state=state, message=message, ended_ms=deadline)

    def close(self) -> None:
        pass


def endings(progress: DataFrame, timeout_ms: int, clock: str = EVENT, lateness: str = "1 millisecond") -> DataFrame:
    """The end of each job of a stream of progress rows.

    clock EVENT: time is the latest time of any job, less ``lateness``, which must not be 0: rows as old as
    the watermark would be dropped. PROCESSING: the machine's, from the job's first row here.
    """
    # a worker beside the driver reads the processor too, which files sent to executors do not reach
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    fields = [progress.schema["job_id"], *[T.StructField(n, k) for n, k in (
        ("stop_pos", T.LongType()), ("state", T.StringType()), ("message", T.StringType()), ("ended_ms", T.LongType()))]]
    if clock == EVENT:
        progress = progress.withColumn("_seen", F.timestamp_millis("clock_ms")).withWatermark("_seen", lateness)
    return progress.groupBy("job_id").transformWithState(Deadlines(timeout_ms, clock), T.StructType(fields), "Append", clock)


def progress_stream(spark: SparkSession, path: str, job: str) -> DataFrame:
    """Progress rows that ``outcome`` writes below a path, as a stream; job: type of job_id."""
    return spark.readStream.schema(f"job_id {job}, {PROGRESS}, batch_id bigint").option("basePath", f"{path}/progress").parquet(f"{path}/progress/batch_id=*").drop("batch_id")


def ending_stream(
    progress: DataFrame, path: str, checkpoint: str, timeout_ms: int, clock: str = EVENT,
    lateness: str = "1 millisecond", interval: str | None = None,
) -> DataStreamWriter:
    """Writes the end of each job below ``path/ended``, a folder for each batch; a repeated batch replaces its own."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/ended/batch_id={batch_id}")

    writer = endings(progress, timeout_ms, clock, lateness).writeStream.outputMode("append").foreachBatch(run)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)


def ended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/ended").drop("batch_id")


__all__ = ["EVENT", "PROCESSING", "Deadlines", "ended", "ending_stream", "endings", "job_type", "progress_stream"]
