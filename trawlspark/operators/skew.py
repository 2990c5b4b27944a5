"""Ordered computations per key that survive a key holding a third of all rows.

A window needs all rows of a key in one task. Keys up to ``HOT_ROWS`` rows take
that plain way. The rows of larger keys are cut into ordered slices by a range
partitioning on (key, order); windows then run per slice, and what earlier
slices add up to is joined back on. Results are the same either way.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_folder

HOT_ROWS = 2_000_000
SLICE = "_slice"

# keys are first counted by that many hashes, which no shuffle has to carry
HASHES = 1 << 16

# more files than this cost more to list than larger buckets cost to read
MAX_BUCKETS = 20_000


def hot_keys(df: DataFrame, keys: list[str], max_rows: int) -> DataFrame:
    """Keys with more than ``max_rows`` rows: at most rows / max_rows of them."""
    return (
        df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > max_rows)
    )


def ordered_slices(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    max_rows: int | None = None,
    largest: int | None = None,
) -> tuple[DataFrame, bool]:
    """Add a slice number that grows with ``order`` inside each key.

    The second result tells whether any key has more than one slice. Keys are
    counted first (a scan of the key columns), unless the caller knows the
    ``largest`` group. Rows of hot keys are checkpointed, because slice bounds
    come from sampling and must be the same for everything computed from them,
    also after a lost executor.
    """
    max_rows = max_rows or HOT_ROWS
    if largest is not None and largest <= max_rows:
        return df.withColumn(SLICE, F.lit(0)), False
    hot = hot_keys(df, keys, max_rows)
    total = hot.agg(F.sum("_n")).first()[0]
    if not total:
        return df.withColumn(SLICE, F.lit(0)), False
    # one row per hot key, so the side is bounded by the number of slices
    hot_names = F.broadcast(hot.select(*keys))
    spark = df.sparkSession
    slices = max(
        2 * math.ceil(total / max_rows), int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    cut = (
        df.join(hot_names, keys, "left_semi")
        .repartitionByRange(slices, *keys, *order)
        .withColumn(SLICE, F.spark_partition_id())
        .checkpoint()
    )
    rest = df.join(hot_names, keys, "left_anti").withColumn(SLICE, F.lit(0))
    return rest.unionByName(cut), True


@dataclass(frozen=True)
class Running:
    """A running ``sum`` or ``max`` of ``value``; ``before`` leaves the row itself out."""

    value: Column
    kind: str = "sum"
    before: bool = False

    def over(self, window, partial: bool) -> Column:
        agg = F.sum(self.value) if self.kind == "sum" else F.max(self.value)
        end = -1 if self.before else 0
        out = agg.over(window.rowsBetween(Window.unboundedPreceding, end))
        return out if partial or self.kind == "max" else F.coalesce(out, F.lit(0))

    def total(self) -> Column:
        return F.sum(self.value) if self.kind == "sum" else F.max(self.value)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, Running],
    max_rows: int | None = None,
    largest: int | None = None,
    slices: Column | None = None,
) -> DataFrame:
    """Add running values per key in the given order, which must be total.

    ``slices`` is a number that never falls with the order, for callers that know one;
    nothing is counted or sampled then. ``df`` is read twice and should be stored.
    """
    if slices is None:
        sliced, hot = ordered_slices(df, keys, order, max_rows, largest)
    else:
        sliced, hot = df.withColumn(SLICE, slices), True
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    out = sliced.withColumns({n: c.over(inside, hot) for n, c in columns.items()})
    if not hot:
        return out.drop(SLICE)
    totals = sliced.groupBy(*keys, SLICE).agg(
        *[c.total().alias(f"_t_{n}") for n, c in columns.items()]
    )
    # one row per key and slice: a key has at most as many rows as there are slices
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        SLICE,
        *[
            (F.sum if c.kind == "sum" else F.max)(f"_t_{n}").over(earlier).alias(f"_o_{n}")
            for n, c in columns.items()
        ],
    )

    def merged(name: str, c: Running) -> Column:
        if c.kind == "max":
            return F.greatest(F.col(name), F.col(f"_o_{name}"))
        return F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_o_{name}"), F.lit(0))

    return (
        out.join(offsets, [*keys, SLICE], "left")
        .withColumns({n: merged(n, c) for n, c in columns.items()})
        .drop(SLICE, *[f"_o_{n}" for n in columns])
    )


@dataclass(frozen=True)
class Layout:
    """A table bucketed by ``key``, so that joins on it move only the other side.

    ``hot`` holds the keys that were spread over several buckets, with the number
    of their salts; None when there are none.
    """

    table: str
    key: str
    hot: DataFrame | None
    spark: SparkSession

    def join(self, df: DataFrame, how: str = "inner") -> DataFrame:
        """Join ``df`` on the key; rows with a spread key are copied per salt."""
        stored = self.spark.table(self.table)
        if self.hot is None:
            return df.join(stored, self.key, how)
        copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
        salted = (
            df.join(F.broadcast(self.hot), self.key, "left")
            .withColumn("_salt", F.explode(copies))
            .drop("_salts")
        )
        return salted.join(stored, [self.key, "_salt"], how).drop("_salt")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def lay_out(
    df: DataFrame, key: str, spread: str | None = None, max_rows: int | None = None
) -> Layout:
    """Write ``df`` bucketed by ``key`` below the shared folder.

    With ``spread``, a key above ``max_rows`` rows is cut into salts by a hash of
    that column, and so into several buckets. ``df`` is read twice then, once for
    the keys only; it should be a stored table rather than a costly plan. Keys are
    counted one by one only if a hash of them has that many rows.
    """
    max_rows = max_rows or HOT_ROWS
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot, by = None, [key]
    if spread is not None:
        hashes = df.groupBy(F.pmod(F.xxhash64(key), F.lit(HASHES)).alias("_h")).agg(F.count("*").alias("_n"))
        total, largest = hashes.agg(F.sum("_n").alias("total"), F.max("_n").alias("largest")).first()
        buckets = max(buckets, min(math.ceil((total or 0) / max_rows), MAX_BUCKETS))
        if largest and largest > max_rows:
            # at most total / max_rows keys
            hot = (
                hot_keys(df, [key], max_rows)
                .select(key, F.ceil(F.col("_n") / max_rows).cast("int").alias("_salts"))
                .checkpoint()
            )
        if hot is not None and hot.isEmpty():  # only several keys with one hash
            hot = None
        if hot is not None:
            salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))
            df = df.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_salts")
            by = [key, "_salt"]
    name = f"laid_out_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, *by)
        .write.option("path", work_folder(spark, name))
        .bucketBy(buckets, *by)
        .saveAsTable(name)
    )
    return Layout(name, key, hot, spark)
