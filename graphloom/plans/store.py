"""Results kept for later steps of an iteration, in a folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (only where it is unset and Spark runs on one machine) a new local folder."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None):
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found
    if (found := sc.getCheckpointDir()) is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found := tempfile.mkdtemp(prefix="graphloom-"))
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


#: Tables and folders that this process has written.
_written: list[str] = []


def folder(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder, which clear() deletes."""
    _written.append(f"{shared_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}")
    return _written[-1]


def clear(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes these tables, or all that this process has stored; to be called when no result that reads them is needed any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in list(_written if paths is None else paths):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _written:
            _written.remove(name)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: Spark deletes those of a query when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def stored(df: DataFrame) -> DataFrame:
    """df computed once and read back from a table, which cuts lineage, survives lost executors, and keeps plans small."""
    path = folder(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """What make returns, stored, and its table's name; all that was stored on the way is deleted."""
    before = set(_written)
    out = stored(make())
    path = _written[-1]
    clear(spark, [p for p in _written if p not in before and p != path])
    return out, path
