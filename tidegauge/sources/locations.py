"""Where tables live, and where a job may put intermediate ones."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import cache

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Location:
    """A base URI on any file system Spark can reach, with an optional prefix."""

    base: str
    prefix: str = ""

    def path(self, key: str) -> str:
        folder = f"{self.base}/{self.prefix}" if self.prefix else self.base
        return f"{folder}/{key}"


@cache
def _local_scratch() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="tidegauge-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Without that setting only a local-mode session gets one, since a temporary
    folder of the driver's machine is of no use to executors elsewhere.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = _local_scratch().name
    return shared


def scratch(spark: SparkSession) -> Location:
    """A fresh folder for intermediate tables that every executor can read.

    It lies in the shared folder and is deleted, with what is in it, when the session's JVM ends.
    """
    at = Location(shared_folder(spark), f"tidegauge-{uuid.uuid4().hex}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(at.path(""))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return at
