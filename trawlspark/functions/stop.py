"""When a crawl stops: the rule asked before each fetch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State and message of each outcome.
KEEP = ("Continuing", "Keep crawling")
COMPLETED = ("Completed", "Completed Okay")
STOPPED = ("Stopped", "Stop requested")
TOO_MANY_QUEUED = ("Aborted", "Too many URIs queued for crawling")
TOO_MANY_FETCHES = ("Aborted", "Crawl exceeded maximum fetch requests")
TOO_MANY_FAILED = ("Aborted", "Too many failed fetches")
TIMEOUT = ("Aborted", "Crawl exceeded maximum crawl time")

# Fixed value: attempts below this never count as a failing crawl.
MIN_ATTEMPTS = 5


def outcome(pair: tuple[str, str]) -> Column:
    return F.struct(F.lit(pair[0]).alias("state"), F.lit(pair[1]).alias("message"))


def is_failing(attempts: Column, fails: Column, seeds: Column, max_fail: Column) -> Column:
    return (
        (attempts > seeds)
        & (attempts >= MIN_ATTEMPTS)
        & (F.try_divide(fails.cast("double"), attempts.cast("double")) >= max_fail)
    )


def stop_outcome(
    pending: Column,
    succeeds: Column,
    attempts: Column,
    fails: Column,
    seeds: Column,
    max_queue: Column,
    max_fetches: Column,
    max_fail: Column,
    timed_out: Column | None = None,
    requested: Column | None = None,
) -> Column:
    """struct<state, message> of the first rule that holds, in fixed priority."""
    no = F.lit(False)
    return (
        F.when(no if requested is None else requested, outcome(STOPPED))
        .when(pending == 0, outcome(COMPLETED))
        .when(pending >= max_queue, outcome(TOO_MANY_QUEUED))
        .when(succeeds >= max_fetches, outcome(TOO_MANY_FETCHES))
        .when(no if timed_out is None else timed_out, outcome(TIMEOUT))
        .when(is_failing(attempts, fails, seeds, max_fail), outcome(TOO_MANY_FAILED))
        .otherwise(outcome(KEEP))
    )
