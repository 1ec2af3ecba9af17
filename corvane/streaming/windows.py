"""Event-time windows, dedupe and stream-static joins on streaming DataFrames.

Time columns without a zone are taken as UTC (the session's zone), since watermarks need
timestamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_stream(spark, folder: str, schema, name: str = "*.parquet", time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """A stream of the Parquet files of a folder, with a watermark on ``time``."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)


def tumbling(events: DataFrame, size: str, *keys: str, time: str = "ts", value: str = "value") -> DataFrame:
    return _counts(events.groupBy(F.window(time, size), *keys), value, keys)


def sliding(events: DataFrame, size: str, step: str, *keys: str, time: str = "ts", value: str = "value") -> DataFrame:
    return _counts(events.groupBy(F.window(time, size, step), *keys), value, keys)


def sessions(events: DataFrame, gap: str, *keys: str, time: str = "ts", value: str = "value") -> DataFrame:
    """Sessions of each key: runs of events with gaps of less than ``gap``."""
    return _counts(events.groupBy(F.session_window(time, gap).alias("window"), *keys), value, keys)


def _counts(grouped, value: str, keys) -> DataFrame:
    rows = grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def deduplicated(events: DataFrame, *keys: str) -> DataFrame:
    """First arrival of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def with_static(events: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return events.join(table, key, "left")


def run_to_end(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop; the result is a table at ``path``.

    In complete and update mode each batch's result replaces the table.
    """
    writer = result.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    if error := query.exception():
        raise error
