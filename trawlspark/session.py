"""Session settings, and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # keyed state with timers needs it; state then lives on disk, not on the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # call-site capture costs more than building the expressions themselves
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, once an application: functions in Python import it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).parent
        target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "trawlspark.zip")
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark


def local_session(cpus: str = "8", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("trawlspark")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every query here relies on, whoever made the session."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a local one only on one machine where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not (named or sc.getCheckpointDir() or re.fullmatch(r"local(\[.*\])?", sc.master)):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="trawlspark-"))
    return named or sc.getCheckpointDir()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for tables written within a query."""
    return f"{checkpoint_root(spark).rstrip('/')}/trawlspark/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote; a missing one is fine."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def list_folders(spark: SparkSession, path: str) -> list[str] | None:
    """Names in a folder; null if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else None
