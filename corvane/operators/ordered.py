"""Running totals and row numbers of groups of any size: no group has to fit one task.

Rows are dealt by range of (group, order); totals run within each range, and those of
the ranges before are added, of which there are as many as tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored


def running_total(rows: DataFrame, keys: list[str], order: list, out: str, weight: str | None = None) -> DataFrame:
    """``rows`` with the sum of ``weight`` (or the number of rows) up to each row, within ``keys`` and in a total ``order``."""
    placed = rows.repartitionByRange(*keys, *order) if keys or order else rows
    placed = stored(placed.withColumn("_range", F.spark_partition_id()), "ordered")
    amount = F.col(weight) if weight else F.lit(1).cast("long")
    ranges = placed.groupBy(*keys, "_range").agg(F.sum(amount).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_range").alias("_start_range"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = F.sum(amount).over(W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    same = placed["_range"] == starts["_start_range"]
    for k in keys:
        same = same & placed[k].eqNullSafe(starts[f"_key_{k}"])
    joined = placed.withColumn("_within", within).join(F.broadcast(starts) if not keys else starts, same, "left")
    return joined.withColumn(out, F.col("_start") + F.col("_within")).select(*rows.columns, out)


def numbered(rows: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """``rows`` with their place from 1 within ``keys``, in a total ``order``."""
    return running_total(rows, keys, order, out)


def with_next(rows: DataFrame, keys: list[str], order: list, columns: list[str], prefix: str = "next_") -> DataFrame:
    """``rows`` with the values of ``columns`` in the row that follows; null in the last row of a group."""
    placed = stored(numbered(rows, keys, order, "_place"), "ordered")
    following = placed.select(*(F.col(k).alias(f"_key_{k}") for k in keys), (F.col("_place") - 1).alias("_before"), *(F.col(c).alias(prefix + c) for c in columns))
    same = placed["_place"] == following["_before"]
    for k in keys:
        same = same & placed[k].eqNullSafe(following[f"_key_{k}"])
    return placed.join(following, same, "left").select(*rows.columns, *(prefix + c for c in columns))


def last_known(rows: DataFrame, keys: list[str], order: list[str], column: str, prefix: str = "last_") -> DataFrame:
    """``rows`` with the last value of ``column`` that is not null up to each row, within ``keys`` and in a total ``order``; a join on time without pairs."""
    placed = stored(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ordered")
    filled = F.col(column).isNotNull()
    tails = placed.groupBy(*keys, "_range").agg(F.max_by(column, F.when(filled, F.struct(*order))).alias("_tail"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = tails.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_range").alias("_start_range"), F.last("_tail", ignorenulls=True).over(before).alias("_start"))
    within = F.last(column, ignorenulls=True).over(W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    same = placed["_range"] == starts["_start_range"]
    for k in keys:
        same = same & placed[k].eqNullSafe(starts[f"_key_{k}"])
    joined = placed.withColumn("_within", within).join(starts, same, "left")
    return joined.withColumn(prefix + column, F.coalesce("_within", "_start")).select(*rows.columns, prefix + column)
