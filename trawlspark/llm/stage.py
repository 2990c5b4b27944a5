"""Cutting lineage between the steps of an operator, and code for the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import trawlspark
from trawlspark.session import delete_folder, work_folder

_shipped: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table below the shared folder of spark.checkpoint.dir, read again.

    Later steps do not compute df anew, also when an executor is lost. The files belong to the owner
    of that folder, like checkpoints.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that only the steps inside a `with` need; they are deleted behind it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, work_folder(spark, name)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        delete_folder(self.spark, self.folder)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, once an application: their functions import it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(trawlspark.__file__).parent
        target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "trawlspark.zip")
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark
