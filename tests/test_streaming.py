"""Streams over several micro-batches give what one batch gives."""

import pytest
from pyspark.sql import functions as F

from trawlspark.operators import fetchlog, frontier, jobs
from trawlspark.plans import inputs as I
from trawlspark.streaming import feeds, journal, outcome


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    """The events in five files, in time order, read one file per micro-batch."""
    path = str(tmp_path_factory.mktemp("events"))
    events = I.table(spark, sf, "events")
    for i in range(5):
        part = events.filter((F.col("event_id") >= i * 200) & (F.col("event_id") < (i + 1) * 200))
        part.coalesce(1).write.mode("append").parquet(path)
    return path, events


def stream(spark, files):
    path, events = files
    return (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    )


def strings(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_journal_equals_batch(spark, files, tmp_path):
    path = str(tmp_path)
    writer = journal.journal(
        I.journal_events_of(stream(spark, files)), path, f"{path}/checkpoint", None
    )
    writer.start().awaitTermination()
    events = I.journal_events_of(files[1])
    fetched = events.filter("event_type = 'fetched'")
    log = journal.journal_table(spark, path, "fetch_log")
    columns = ["job_id", "event_id", "uri", "status"]
    assert strings(log, columns) == strings(fetched, columns)
    got = journal.journal_table(spark, path, "job")
    columns = ["job_id", "snapshot_ms", "finished_ms", "state", "message"]
    assert strings(got, columns) == strings(jobs.latest_jobs(journal.job_snapshots(events)), columns)
    docs = journal.journal_table(spark, path, "document")
    assert docs.count() == fetched.select("job_id", "uri").distinct().count()
    # a batch that is run again replaces its own rows
    first = events.limit(0)
    journal.write_batch(first, 99, path)
    journal.write_batch(fetched.limit(10), 99, path)
    journal.write_batch(first, 99, path)
    assert journal.journal_table(spark, path, "fetch_log").count() == log.count()


def collect_updates(df, path, mode="update"):
    (
        df.writeStream.outputMode(mode)
        .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/rows/batch_id={i}"))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return df.sparkSession.read.parquet(f"{path}/rows")


def test_counters_and_states(spark, files, tmp_path):
    log = I.fetch_log_of(stream(spark, files))
    rows = collect_updates(feeds.running_counters(log), str(tmp_path / "c"))
    got = jobs.latest(rows, ["job_id"], ["batch_id"])
    columns = ["job_id", "fetch_attempts", "fetch_succeeds", "fetch_fails", "redirects"]
    assert strings(got, columns) == strings(fetchlog.fetch_counters(I.fetch_log_of(files[1])), columns)
    states = feeds.job_states(I.journal_events_of(stream(spark, files)))
    got = jobs.latest(collect_updates(states, str(tmp_path / "s")), ["job_id"], ["batch_id"])
    want = jobs.latest_jobs(journal.job_snapshots(I.journal_events_of(files[1])))
    assert strings(got, ["job_id", "message"]) == strings(want, ["job_id", "message"])


def test_seen_links(spark, files, tmp_path):
    rows = I.fetch_log_of(stream(spark, files))
    plain = feeds.unseen_links(rows.select("job_id", "uri"))
    got = collect_updates(plain, str(tmp_path / "a"), "append")
    want = I.fetch_log_of(files[1]).select("job_id", "uri").distinct()
    assert strings(got, ["job_id", "uri"]) == strings(want, ["job_id", "uri"])
    bounded = feeds.unseen_links(rows.select("job_id", "uri", "log_time"), "log_time", "60 days")
    got = collect_updates(bounded, str(tmp_path / "b"), "append")
    assert strings(got, ["job_id", "uri"]) == strings(want, ["job_id", "uri"])


@pytest.mark.parametrize("hot_rows", [None, 10])
def test_outcomes_are_emitted_once(spark, files, tmp_path, hot_rows):
    path = str(tmp_path)
    log = I.fetch_log_of(stream(spark, files))
    rule = (3, 6, 5, 0.4)
    outcome.outcome_stream(log, path, f"{path}/checkpoint", *rule, hot_rows=hot_rows).start().awaitTermination()
    got = outcome.outcomes(spark, path)
    judged = frontier.with_outcome(fetchlog.log_progress(I.fetch_log_of(files[1]), rule[0]), *rule[1:])
    want = frontier.outcomes(judged.filter("state <> 'Continuing'"))
    columns = ["job_id", "stop_pos", "state", "message"]
    assert strings(got, columns) == strings(want, columns)
    assert got.count() > 0


def _log_rows(spark, folder, batches):
    """Files of (job_id, event_id, second, status, links), one for each micro-batch."""
    import time

    schema = "job_id string, event_id bigint, second bigint, status int, links_extracted int"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return log.select("*", F.timestamp_seconds("second").alias("log_time"), (F.col("second") * 1000).alias("log_ms"))


def _ended(spark, folder, log, checkpoint):
    """One run of both streams; what it emitted."""
    from trawlspark.streaming import timers

    before = set()
    try:
        before = {r.job_id for r in timers.ended(spark, folder).collect()}
    except Exception:
        pass
    outcome.outcome_stream(log, folder, f"{checkpoint}/a", 1, 1000, 1000, 1.1, timeout_ms=100_000).start().awaitTermination()
    progress = timers.progress_stream(spark, folder, "string")
    timers.ending_stream(progress, folder, f"{checkpoint}/b", 100_000).start().awaitTermination()
    found = timers.ended(spark, folder).collect()
    assert len({r.job_id for r in found}) == len(found)
    return {(r.job_id, r.stop_pos, r.message) for r in found if r.job_id not in before}


def test_silent_jobs_end_once(spark, tmp_path):
    """Text ids; a job that falls silent ends when time passes its deadline, also after a restart."""
    folder, given, late = str(tmp_path / "out"), str(tmp_path / "in"), "Crawl exceeded maximum crawl time"
    rows = [("silent", 1, 0, 200, 5), ("quick", 2, 1, 200, 0), ("quick", 3, 2, 200, 0), ("slow", 4, 3, 200, 5)]
    log = _log_rows(spark, given, [rows, [("slow", 5, 90, 200, 5)]])
    # the queue of quick ran empty before its second fetch
    assert _ended(spark, folder, log, str(tmp_path)) == {("quick", 2, "Completed Okay")}
    # restart: another job's rows move time on; silent ends without a row of its own
    log = _log_rows(spark, given, [[("other", 6, 101, 200, 5)]])
    assert _ended(spark, folder, log, str(tmp_path)) == {("silent", 2, late)}
    # a row after the deadline is no second end; slow stops at its own late row
    log = _log_rows(spark, given, [[("silent", 7, 150, 200, 5), ("slow", 8, 151, 200, 5)], [("other", 9, 160, 200, 5)]])
    assert _ended(spark, folder, log, str(tmp_path)) == {("slow", 3, late)}
    assert _ended(spark, folder, log, str(tmp_path)) == set()
    import os

    assert len([f for f in os.listdir(f"{folder}/state")]) <= 2


def test_deadlines_on_the_clock_of_the_machine(spark, tmp_path):
    import time

    from trawlspark.streaming import timers

    folder = str(tmp_path)
    row = ("job", 1, 1, 1, 1, None, None, None, "Aborted", "late")
    spark.createDataFrame([row], f"job_id string, {timers.PROGRESS}").write.parquet(f"{folder}/progress/batch_id=0")
    stream_ = timers.progress_stream(spark, folder, "string")
    query = timers.ending_stream(stream_, folder, f"{folder}/c", 1500, timers.PROCESSING, interval="500 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            try:
                found = timers.ended(spark, folder).collect()
            except Exception:
                found = []
            if found:
                break
    finally:
        query.stop()
    assert [(r.job_id, r.stop_pos, r.message) for r in found] == [("job", 2, "late")]


def test_bounded_memory_of_seen_links(spark, tmp_path):
    """State shrinks behind the watermark; a repeat after the bound counts as new, one within it does not."""
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "job_id int, uri string, minute bigint"
    for rows in ([(1, f"/{i}", 0) for i in range(1000, 1050)], [(1, "/1000", 5), (1, "/x", 5)], [(1, "/y", 100)], [(1, "/v", 101)], [(1, "/1000", 130), (1, "/z", 130)], [(1, "/1000", 135), (1, "/w", 200)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(given)
        import time

        time.sleep(0.05)
    links = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(given).withColumn("at", F.timestamp_seconds((F.col("minute") + 10) * 60))
    query = (
        feeds.unseen_links(links, "at", "30 minutes").writeStream.outputMode("append")
        .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch_id={i}"))
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(state) >= 51 and state[-1] <= 4
    got = sorted((r.uri, r.minute) for r in spark.read.parquet(out).collect() if not r.uri.startswith("/10") or r.uri == "/1000")
    assert got == [("/1000", 0), ("/1000", 130), ("/v", 101), ("/w", 200), ("/x", 5), ("/y", 100), ("/z", 130)]
