"""The URIs a crawl has seen: a set that is kept bucketed by its keys and extended by bucket.

A test against it moves only the candidates. The set itself is read where it lies, bucket by bucket, so
its size matters for reading only and never for a shuffle; adding a level writes that level's keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import delete_folder, work_folder


class SeenSet:
    """Rows of ``keys`` in a bucketed table below the shared folder, known to this session only."""

    def __init__(self, spark: SparkSession, keys: tuple[str, ...] = ("job_id", "uri"), buckets: int | None = None):
        self.spark, self.keys = spark, list(keys)
        # as many buckets as a shuffle has partitions: candidates are then dealt to them as they are
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.path, self.empty = f"seen_{uuid.uuid4().hex}", work_folder(spark, "seen"), True

    def add(self, rows: DataFrame) -> None:
        """Add rows; one file for each bucket. Rows that are there already do no harm."""
        (
            rows.select(*self.keys)
            .repartition(self.buckets, *self.keys)
            .write.mode("append").bucketBy(self.buckets, *self.keys)
            .option("path", self.path).saveAsTable(self.name)
        )
        self.empty = False

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, candidates: DataFrame) -> DataFrame:
        """Candidates whose keys are not in the set; an exact test on the whole URI."""
        return candidates if self.empty else candidates.join(self.rows(), self.keys, "left_anti")

    def drop(self) -> None:
        if not self.empty:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_folder(self.spark, self.path)
