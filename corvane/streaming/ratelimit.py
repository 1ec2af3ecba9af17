"""Sliding-log rate limits. A denied request is not logged, so it does not count against later ones."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored

# Requests a minute by kind of endpoint.
ENDPOINT_LIMITS = {"chat": 20, "upload": 10, "search": 60, "default": 30}


def endpoint_key(path: Column) -> Column:
    """Kind of endpoint of a request path."""
    return F.when(path.startswith("/api/chat"), "chat").when(path.startswith("/api/upload"), "upload").when(path.startswith("/api/search"), "search").otherwise("default")


def decide(times: list[float], log: deque, limit: int, window: float) -> list[bool]:
    """Decisions on requests in order of time; ``log`` holds the times of those allowed before, and is kept up to date."""
    out = []
    for t in times:
        while log and log[0] <= t - window:
            log.popleft()
        if ok := len(log) < limit:
            log.append(t)
        out.append(ok)
    return out


_STEP = "key string, event_id long, at long, allowed boolean, logged boolean"


def limit_batch(requests: DataFrame, log: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Decisions on one batch of (key, event_id, at in microseconds) after the allowed requests of ``log`` (key, at).

    Rows (key, event_id, at, allowed, logged): decisions, and with ``logged`` the log as it
    is afterwards. A key's requests stand in order of time over all of the batch, however
    many Arrow batches they fill; a task keeps at most ``limit`` times of one key at once.
    """
    window = window_seconds * 1_000_000

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = None, deque()
        kept: list[tuple] = []

        def close() -> None:
            kept.extend((key, 0, t, True, True) for t in times)
            times.clear()

        for batch in batches:
            out = kept
            kept = []
            for k, event_id, at, logged in zip(batch["key"], batch["event_id"].tolist(), batch["at"].tolist(), batch["logged"], strict=True):
                if k != key:
                    close()
                    key = k
                if logged:
                    times.append(at)
                else:
                    out.append((k, event_id, at, decide([at], times, limit, window)[0], False))
            yield pd.DataFrame(out + kept, columns=["key", "event_id", "at", "allowed", "logged"])
            kept = []
        close()
        if kept:
            yield pd.DataFrame(kept, columns=["key", "event_id", "at", "allowed", "logged"])

    before = log.select("key", F.lit(0).cast("long").alias("event_id"), "at", F.lit(True).alias("logged"))
    rows = requests.select("key", "event_id", "at", F.lit(False).alias("logged")).unionByName(before)
    ordered = rows.repartition("key").sortWithinPartitions("key", ~F.col("logged"), "at", "event_id")
    return ordered.mapInPandas(step, _STEP)


def limit_stream(events: DataFrame, key: str, limit: int, window_seconds: int, folder: str, checkpoint: str, lateness_seconds: int = 3600) -> None:
    """Decide on all requests of a stream (key, event_id, ts) that have arrived, and stop: tables ``folder``/decisions and ``folder``/log.

    Each micro-batch writes generations of both, named by its number, so that a batch
    that is run again replaces itself. The log goes on from batch to batch; times older
    than the window and ``lateness_seconds`` before the newest request leave it.
    """

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        requests = batch.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
        log = spark.createDataFrame([], "key string, at long") if not number else spark.read.parquet(f"{folder}/log/generation={number - 1}")
        result = stored(limit_batch(requests, log, limit, window_seconds), "rate-limit")
        decisions = result.where("not logged").select("key", "event_id", F.timestamp_micros("at").alias("ts"), "allowed")
        decisions.write.mode("overwrite").parquet(f"{folder}/decisions/generation={number}")
        newest = result.agg(F.max("at")).first()[0] or 0
        current = result.where(F.col("logged") & (F.col("at") > newest - (window_seconds + lateness_seconds) * 1_000_000))
        current.select("key", "at").write.mode("overwrite").parquet(f"{folder}/log/generation={number}")

    query = events.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(publish).start()
    query.awaitTermination()
    if error := query.exception():
        raise error


def sliding_counts(events: DataFrame, key: str, window_seconds: int, time: str = "ts") -> DataFrame:
    """Batch form of the plain sliding count: requests of a key in the window that ends with each, denied ones included."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    within = W.partitionBy(key).orderBy(micros).rangeBetween(-(window_seconds * 1_000_000 - 1), 0)
    return events.withColumn("in_window", F.count("*").over(within))
