"""Continuous ingestion: arrivals are deduplicated by content, chunked, staged and published batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunks, enriched
from ..operators.ingest import replace_table


#: A character that is no white space, to any of the chunking strategies.
_VISIBLE = r"(?U)[^\s\x1c-\x1f]"


def ingest_batch(batch: DataFrame, table: str, number: int, known: DataFrame | None = None, **chunking) -> DataFrame:
    """One batch of (source, text): new contents as chunks, written as a generation of the table; returns the chunks.

    Contents without text (null, empty, blank) give no chunks: each is one row of state ``empty``,
    so that it is known like any other.
    """
    arrivals = batch.withColumn("file_hash", F.sha2("text", 256)).dropDuplicates(["file_hash"])
    if known is not None:
        seen = known.select(F.col("file_hash").alias("_seen")).distinct()
        arrivals = arrivals.join(seen, F.col("file_hash").eqNullSafe(F.col("_seen")), "left_anti")
    some = F.coalesce(F.col("text").rlike(_VISIBLE), F.lit(False))
    rows = enriched(chunks(arrivals.where(some), **chunking)).withColumn("state", F.lit("active"))
    empty = arrivals.where(~some).drop("text").withColumn("state", F.lit("empty"))
    path = replace_table(rows.unionByName(empty, allowMissingColumns=True), table, f"{number:06d}")
    return batch.sparkSession.read.parquet(path)


def ingest_stream(arrivals: DataFrame, table: str, checkpoint: str, **chunking) -> None:
    """Ingest all that has arrived, and stop. Each batch is a generation named by its number, so a batch that is run again replaces itself."""

    def publish(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        known = None
        if number:
            known = spark.read.parquet(table).where(F.col("generation").cast("int") < number)
        ingest_batch(batch, table, number, known, **chunking)

    query = arrivals.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(publish).start()
    query.awaitTermination()
    if error := query.exception():
        raise error
