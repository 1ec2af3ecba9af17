"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where unset and the master is local, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _fallback:
        _fallback["dir"] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _fallback["dir"]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; what is written there goes with ``clear``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table, read back: this cuts its lineage and pins what a recomputed task could change."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Remove the tables and folders that this driver's jobs have stored, and say how many; for the end of a job, as results may still read them before."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n
