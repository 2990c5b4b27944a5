"""Tables with one row a key, overwritten by key, and tables of days that expire.

``KeyedTable`` is Parquet in folders by a hash of the key. An upsert reads and writes only the folders that
its rows fall into, by dynamic partition overwrite; other folders keep their files. Files carry Bloom filters
of the key columns, so looking up a key that is not there reads no row group. ``DayTable`` is Parquet in
folders by day and bucket; expired days are dropped as folders, and no data file is rewritten.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import latest
from ..session import delete_folder, list_folders, work_folder
from .tables import DAY_MS, RETENTION_DAYS

BUCKET = "key_bucket"


class KeyedTable:
    """A table below ``path`` with one row for each value of ``keys``.

    The number of folders is fixed when the table is made and kept beside it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys = spark, path, keys
        if list_folders(spark, f"{path}/_layout") is None:
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/_layout")
        self.buckets = spark.read.schema("buckets int").json(f"{path}/_layout").first()[0]

    def _dealt(self, rows: DataFrame) -> DataFrame:
        key = F.xxhash64(*[F.col(k).cast("string") for k in self.keys])
        return rows.withColumn(BUCKET, F.pmod(key, F.lit(self.buckets)).cast("int"))

    def _stored(self) -> bool:
        return any(name.startswith(f"{BUCKET}=") for name in list_folders(self.spark, self.path) or [])

    def _overwrite(self, rows: DataFrame) -> None:
        """Replace the folders of rows (with their bucket)."""
        out = rows.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *self.keys).write.mode("overwrite")
        out = out.partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic")
        for k in self.keys:
            out = out.option(f"parquet.bloom.filter.enabled#{k}", "true")
        out.parquet(self.path)

    def upsert(self, rows: DataFrame, order: list[str] | None = None) -> None:
        """Insert rows, or overwrite those with their keys. Of several new rows with a key the last by
        ``order`` stays, of equal ones any."""
        new = latest(rows, self.keys, order) if order else rows.dropDuplicates(self.keys)
        self._replace(self._dealt(new), keep_new=True)

    def delete(self, keys: DataFrame) -> None:
        """Delete the rows with these keys."""
        self._replace(self._dealt(keys.select(*self.keys).distinct()), keep_new=False)

    def _replace(self, new: DataFrame, keep_new: bool) -> None:
        # what the folders will hold is written aside first: they are read and overwritten
        aside = work_folder(self.spark, "upsert")
        new.write.parquet(f"{aside}/new")
        new = self.spark.read.schema(new.schema).parquet(f"{aside}/new")
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most the number of folders
        if not touched:
            return
        result = new if keep_new else None
        if self._stored():
            old = self.spark.read.parquet(self.path).filter(F.col(BUCKET).isin(touched))
            kept = old.join(new.select(BUCKET, *self.keys), [BUCKET, *self.keys], "left_anti")
            result = kept if result is None else kept.unionByName(result, allowMissingColumns=True)
        if result is None:
            return
        result.write.parquet(f"{aside}/all")
        result = self.spark.read.schema(result.schema).parquet(f"{aside}/all")
        self._overwrite(result)
        if not keep_new:
            # a folder that lost its last row is not overwritten by anything
            left = {r[0] for r in result.select(BUCKET).distinct().collect()}
            for bucket in set(touched) - left:
                delete_folder(self.spark, f"{self.path}/{BUCKET}={bucket}")
        delete_folder(self.spark, aside)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(BUCKET)

    def find(self, **key) -> DataFrame:
        """The row with a key: one folder is listed, and row groups without the key are skipped."""
        wanted = self._dealt(self.spark.createDataFrame([tuple(key[k] for k in self.keys)], self.spark.read.parquet(self.path).select(*self.keys).schema))
        bucket = wanted.first()[BUCKET]
        found = self.spark.read.parquet(self.path).filter(F.col(BUCKET) == bucket)
        for k in self.keys:
            found = found.filter(F.col(k) == F.lit(key[k]))
        return found.drop(BUCKET)

    def find_all(self, keys: DataFrame) -> DataFrame:
        """The rows with any of many keys: a join by bucket and key."""
        wanted = self._dealt(keys.select(*self.keys).distinct())
        return self.spark.read.parquet(self.path).join(wanted, [BUCKET, *self.keys], "left_semi").drop(BUCKET)


class DayTable:
    """Rows below ``path`` in folders by day and a hash of ``bucket_by``; ``time_ms`` tells a row's day (UTC).

    ``kind`` names the table in RETENTION_DAYS.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str, time_ms: str, bucket_by: str = "job_id", buckets: int = 16):
        self.spark, self.path, self.kind, self.time_ms, self.bucket_by, self.buckets = spark, path, kind, time_ms, bucket_by, buckets

    def append(self, rows: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64(F.col(self.bucket_by).cast("string")), F.lit(self.buckets)).cast("int")
        dealt = rows.withColumns({"day": F.date_from_unix_date(F.floor(F.col(self.time_ms) / DAY_MS).cast("int")), "bucket": bucket})
        dealt.hint("rebalance", "day", "bucket").sortWithinPartitions("day", "bucket", self.bucket_by, self.time_ms).write.mode("append").partitionBy(
            "day", "bucket"
        ).parquet(self.path)

    def _first_ms(self, asof_ms: int) -> int | None:
        days = RETENTION_DAYS.get(self.kind)
        return None if days is None else asof_ms - days * DAY_MS

    def read(self, asof_ms: int) -> DataFrame:
        """Rows still within the time to live: whole days by their folders, the oldest one by its rows."""
        rows, first = self.spark.read.parquet(self.path), self._first_ms(asof_ms)
        if first is not None:
            day = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=first)).date()
            rows = rows.filter((F.col("day") >= F.lit(day)) & (F.col(self.time_ms) >= first))
        return rows.drop("day", "bucket")

    def drop_expired(self, asof_ms: int) -> list[str]:
        """Delete the folders of days that ended before the time to live; returns the days. Other files stay."""
        first, gone = self._first_ms(asof_ms), []
        if first is None:
            return gone
        for name in list_folders(self.spark, self.path) or []:
            if name.startswith("day="):
                day = datetime.strptime(name[len("day=") :], "%Y-%m-%d").replace(tzinfo=timezone.utc)
                if int(day.timestamp() * 1000) + DAY_MS <= first:
                    delete_folder(self.spark, f"{self.path}/{name}")
                    gone.append(name[len("day=") :])
        return sorted(gone)
