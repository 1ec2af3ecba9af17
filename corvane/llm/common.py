"""Small helpers shared by the operators: shared-folder tables, hashing, text forms."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, stored

__all__ = ["ascii_lower", "batches_of", "fresh_path", "give_back", "modest_batches", "narrow_name", "shuffled", "small_side", "spread_lookup", "stored", "table"]

_C = ctypes.CDLL(None)

#: Characters that separate words in several contracts: space and \t \n \v \f \r.
ASCII_SPACE = "\x20\x09-\x0d"


def ascii_lower(column):
    """Lower-case A-Z only; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join in which Spark broadcasts nothing.

    Spark sizes a side by the bytes of its files. After an explode, or where repeated arrays take a
    few bytes of a file each, the rows are many times that, and the driver's memory has to hold them.
    """
    return df.hint("merge")


def small_side(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """A stored side of a join: broadcast if it has at most ``limit`` (short) rows, else joined by a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else shuffled(df)


#: A key is hot if more than 1 / HOT_SHARE of all rows have it, and more than HOT_ROWS.
HOT_SHARE, HOT_ROWS = 10_000, 1000


def spread_lookup(rows: DataFrame, keyed: DataFrame, key: str, n: str, values: list[str]) -> DataFrame:
    """Left join of ``rows`` with ``keyed`` (stored; one row per ``key``, the number ``n`` of its rows, and ``values``).

    Hot keys are broadcast, at most HOT_SHARE of them whatever the input's size, and
    their rows are dealt evenly to the tasks that join the rest. ``key`` must hold no
    nulls in ``rows``; neither side may have other columns in common.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = keyed.where(F.col(n) > limit).select(F.col(key).alias("_hot_key"), *(F.col(v).alias(f"_hot_{v}") for v in values))
    flagged = rows.join(F.broadcast(hot), rows[key] == hot["_hot_key"], "left")
    salt = F.when(F.col("_hot_key").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int"))
    flagged = flagged.withColumn("_salt", salt)
    cold = keyed.where(F.col(n) <= limit).select(F.col(key).alias("_cold_key"), F.lit(0).alias("_cold_salt"), *(F.col(v).alias(f"_cold_{v}") for v in values))
    joined = flagged.join(cold, (flagged[key] == cold["_cold_key"]) & (flagged["_salt"] == cold["_cold_salt"]), "left")
    return joined.select(*rows.columns, *(F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values))


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def modest_batches(spark: SparkSession, rows: int = 250) -> None:
    """Let Python get at most so many rows at a time, for the rest of the session: texts are long, and Spark's default is 10,000.

    For stages, whose plans run after they return; no result depends on it.
    """
    spark.conf.set(_BATCH, str(rows))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """The same for plans that run within; afterwards the session is as before."""
    before = spark.conf.get(_BATCH)
    modest_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def give_back() -> None:
    """At the end of a Python task: memory that Arrow and the C library keep for later goes back, as idle workers of other stages live on beside the next ones."""
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):  # glibc
        _C.malloc_trim(0)
