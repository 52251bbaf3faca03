"""Shared scratch space and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of our own is made only where the session names none and runs in
    one process, as in tests; elsewhere executors would not share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="evidra-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[app] = "file://" + folder
    return _LOCAL[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch(spark)}/evidra-{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TIDYING: dict[str, list] = {}
_LOCK = threading.Lock()


@contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    """Queries that start here delete their shuffle files when they end: what they made is in a table by then.

    The setting is the session's; it is put back when the last of the threads
    that write at the same time is done.
    """
    key = spark.sparkContext.applicationId
    with _LOCK:
        held = _TIDYING.setdefault(key, [0, spark.conf.get(TIDY, "false")])
        held[0] += 1
        spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(TIDY, held[1])
                del _TIDYING[key]


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write to the shared folder and read back.

    Cuts the lineage at files that outlive executors; a lost executor costs
    only the tasks it was running.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _tidied(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a materialised table that no plan reads any more."""
    spark = df.sparkSession
    jvm, root = spark._jvm, scratch(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/evidra-" in path and root.split(":", 1)[-1].lstrip("/") in path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> int:
    """Delete whatever this application has written below the shared folder; its results must have been read or kept by now."""
    jvm, made = spark._jvm, _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(made)
