"""Session settings for local runs, and the shared folder used for written tables."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, memory: str = "12g") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("voltatlas")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's ``spark.checkpoint.dir``.

    A machine-local folder is used only by a local master that names no shared one; it goes when
    the process ends. ``remove_written`` deletes what was written so far, on any file system.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = _local_root()
    _written.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: what reads it repeats no work."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[str] = []


@functools.cache
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="voltatlas-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def written() -> list[str]:
    """The folders that this process has written and not deleted, oldest first."""
    return list(_written)


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of ``written``; frames that read them end with it."""
    conf = spark._jsc.hadoopConfiguration()
    for folder in folders:
        _written.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def remove_written(spark: SparkSession) -> None:
    """Delete the folders that this process has written; frames that read them end with it."""
    remove(spark, written())
