"""Keyed state that expires, as streams: circuit breakers, read-through caches and counters.

Each operator takes a stream with a watermark on its time column and keeps one small value
for each key; keys are dealt to GROUPS groups, which keep their values together. Timers of event time remove the values of
keys that have become idle, so state does not stay for ever. A key's rows of a micro-batch are taken in order of time, then id; rows that the
watermark has passed are dropped, as always in Spark. Times are microseconds within.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000
#: Groups that keys are dealt to; a checkpoint holds to the number it began with.
GROUPS = 4096


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that keeps values on disk, for queries that start within."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _keyed(events: DataFrame, key: str, id_: str, time: str, ok: str | None, names: list[str], types: list[str], step: Callable) -> DataFrame:
    """Rows (key, id, at, names). Each key has one value of three longs, which ``step(value or None, time, ok)`` turns into (value, columns of the result, time from which it means nothing)."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (tuple(v), until) for k, *v, until in zip(*state.get, strict=True)} if state.exists else {}
        watermark, out = state.getCurrentWatermarkMs(), []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["at", "id"])
            for k, i, at, good in zip(rows["key"].tolist(), rows["id"].tolist(), rows["at"].to_numpy("datetime64[us]").astype("int64").tolist(), rows["ok"].tolist(), strict=True):
                value, _ = held.get(k, (None, 0))
                value, result, until = step(value, at, good)
                held[k] = (value, until)
                out.append((k, i, at, *result))
        held = {k: v for k, v in held.items() if v[1] > watermark * 1000}
        if held:
            state.update(tuple(list(c) for c in zip(*((k, *value, until) for k, (value, until) in held.items()), strict=True)))
            state.setTimeoutTimestamp(max(watermark + 1, min(-(-until // 1000) for _, until in held.values())))
        elif state.exists:
            state.remove()
        found = pd.DataFrame(out, columns=["key", "id", "at", *names])
        found["at"] = pd.to_datetime(found["at"], unit="us")
        yield found

    rows = events.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(id_).cast("long").alias("id"), F.col(time).alias("at"), (F.col(ok) if ok else F.lit(True)).cast("boolean").alias("ok"))
    schema = "key string, id long, at timestamp, " + ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    grouped = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS))).groupBy("group")
    held = "key array<string>, " + ", ".join(f"v{k} array<long>" for k in range(3)) + ", until array<long>"
    return grouped.applyInPandasWithState(run, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def circuit_breaker(calls: DataFrame, key: str, id_: str, time: str, ok: str, failures: int = 1, cooldown_seconds: float = 10, forget_seconds: float = 86_400) -> DataFrame:
    """(key, id, at, phase, admitted) of each call of a service: closed, open or half_open, and whether it goes through.

    After ``failures`` calls in a row that failed, calls are turned away for the cool-down;
    the first one after it is a trial: if it fails, the next cool-down begins, else
    the breaker is closed. Calls that are turned away count for nothing. A null ``ok`` is a failure.
    The value is (failures in a row, end of the cool-down). A breaker without any call for
    ``forget_seconds`` after its last cool-down or call is closed again.
    """
    cooldown, forget = round(cooldown_seconds * SECOND), round(forget_seconds * SECOND)

    def step(value, at, good):
        failed, opened, last = value or (0, 0, at)
        if at >= last + forget:
            failed, opened = 0, 0
        if at < opened:
            return (failed, opened, last), ("open", False), last + forget
        phase = "half_open" if opened else "closed"
        failed = 0 if good else failed + 1
        opened = at + cooldown if not good and (opened or failed >= failures) else 0
        last = max(at, opened)
        return (0 if opened else failed, opened, last), (phase, True), last + forget

    return _keyed(calls, key, id_, time, ok, ["phase", "admitted"], ["string", "boolean"], step)


def cache_lookups(requests: DataFrame, key: str, id_: str, time: str, ttl_seconds: float = 3600) -> DataFrame:
    """(key, id, at, hit, age_seconds) of each request to a read-through cache: a miss loads the entry, which then lives for ``ttl_seconds`` from that moment."""
    ttl = round(ttl_seconds * SECOND)

    def step(value, at, _):
        loaded = value[0] if value and at < value[0] + ttl else None
        hit = loaded is not None
        start = loaded if hit else at
        return (start, 0, 0), (hit, (at - start) / SECOND), start + ttl

    return _keyed(requests, key, id_, time, None, ["hit", "age_seconds"], ["boolean", "double"], step)


def expiring_counters(events: DataFrame, key: str, id_: str, time: str, ttl_seconds: float = 3600) -> DataFrame:
    """(key, id, at, n): a counter's value after each increment; it begins at 1 again when ``ttl_seconds`` have passed since the last one."""
    ttl = round(ttl_seconds * SECOND)

    def step(value, at, _):
        n = value[0] + 1 if value and at < value[1] + ttl else 1
        return (n, at, 0), (n,), at + ttl

    return _keyed(events, key, id_, time, None, ["n"], ["long"], step)
