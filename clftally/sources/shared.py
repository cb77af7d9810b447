"""Folders that every executor can reach."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a local temporary one only for a local master."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    return _local_root()


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="clftally-")


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """Path of a folder that does not exist yet, below the shared root.

    It is scratch: what is still there when the program ends in good order, its session not stopped, is removed.
    """
    folder = f"{shared_root(spark)}/clftally-{purpose}-{uuid.uuid4().hex}"
    _scratch[folder] = spark
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that `fresh_folder` named and that nothing needs any more.

    Spark has no call for that, so the file system is asked directly, which takes a session in this process.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getName().startswith("clftally-"):
        raise ValueError(f"not a scratch folder: {folder}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _scratch.pop(folder, None)


_scratch: dict[str, SparkSession] = {}


@atexit.register
def _remove_scratch() -> None:
    for folder, spark in list(_scratch.items()):
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                remove_folder(spark, folder)
