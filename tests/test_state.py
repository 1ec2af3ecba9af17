"""Keyed state that expires."""

from datetime import datetime, timedelta

from corvane.streaming import state, windows

T0 = datetime(2026, 1, 1)


def _run(spark, tmp_path, batches, step):
    """Decisions over batches of (key, id, seconds, ok), each a file of its own."""
    schema = "key string, id long, at timestamp, ok boolean"
    for rows in batches:
        spark.createDataFrame([(k, i, T0 + timedelta(seconds=s), ok) for k, i, s, ok in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "5 seconds")
    with state.rocks(spark):
        windows.run_to_end(step(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return {r.id: tuple(r)[3:] for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_breaker_opens_tries_and_closes(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    batches = [
        [("a", 1, 0, True), ("a", 2, 1, False), ("a", 3, 2, False), ("a", 4, 3, True), ("b", 5, 3, None)],
        [("a", 6, 12, False), ("a", 7, 15, True), ("b", 8, 15, True), (None, 9, 15, True)],
        [("a", 10, 23, True), ("a", 11, 24, False), ("a", 12, 25, True)],
        [("a", 13, 500, False), ("a", 14, 501, True)],
    ]
    got = _run(spark, tmp_path, batches, lambda s: state.circuit_breaker(s, "key", "id", "at", "ok", failures=2, cooldown_seconds=10, forget_seconds=100))
    closed, opened, trial = ("closed", True), ("open", False), ("half_open", True)
    assert got == {1: closed, 2: closed, 3: closed, 4: opened, 5: closed, 6: trial, 7: opened, 8: closed, 10: trial, 11: closed, 12: closed, 13: closed, 14: closed}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_cache_and_counter_expire(spark, tmp_path):
    batches = [[("a", 1, 0, None), ("a", 2, 9, None), ("b", 3, 5, None)], [("a", 4, 10, None), ("a", 5, 19, None), ("b", 6, 14, None)], [("a", 7, 100, None)]]
    got = _run(spark, tmp_path / "c", batches, lambda s: state.cache_lookups(s, "key", "id", "at", 10))
    assert got == {1: (False, 0.0), 2: (True, 9.0), 3: (False, 0.0), 4: (False, 0.0), 5: (True, 9.0), 6: (True, 9.0), 7: (False, 0.0)}
    got = _run(spark, tmp_path / "n", batches, lambda s: state.expiring_counters(s, "key", "id", "at", 10))
    assert got == {1: (1,), 2: (2,), 3: (1,), 4: (3,), 5: (4,), 6: (2,), 7: (1,)}
