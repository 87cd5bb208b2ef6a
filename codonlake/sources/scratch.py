"""Intermediate results that several branches of a plan read."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    missing, on a single machine, a temporary one is made.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/codonlake/{name}-{uuid.uuid4().hex}"
    if _made.get() is not None:
        _made.get().append(path)
    return path


@contextmanager
def passing(spark: SparkSession):
    """What is stored inside goes at its end, and so do the files of shuffles that nothing refers to any more: Spark finds those by collecting garbage."""
    before = _made.set([])
    try:
        yield
    finally:
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, _made.get()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made.reset(before)
        gc.collect()
        spark._jvm.java.lang.System.gc()


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to the shared folder, and read back."""
    path = fresh(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
