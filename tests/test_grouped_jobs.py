"""Jobs that share one group of a stream's state."""

from datetime import datetime, timedelta

from corvane.streaming import jobs, windows


def test_jobs_of_one_group_have_timers_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "GROUPS", 1)
    t0, schema = datetime(2026, 1, 1), "job_id string, at timestamp, event string"
    batches = [[("a", 0, "running"), ("b", 100, "running"), ("c", 0, "failed"), ("c", 0, None), ("b", 50, "pending")], [("b", 5000, "running")], [("d", 5100, "completed"), ("f", 5100, "failed")], [("e", 100_000, "pending")], [("e", 100_001, "failed")]]
    for batch in batches:
        spark.createDataFrame([(j, t0 + timedelta(seconds=s), e) for j, s, e in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "1 second")
    windows.run_to_end(jobs.job_changes(stream, max_attempts=1), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.job_id, int((r.at - t0).total_seconds()), r.state or "", r.attempt) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [
        ("a", 0, "running", 0), ("a", 900, "retrying", 0), ("b", 50, "pending", 0), ("b", 100, "running", 0), ("b", 5000, "running", 0), ("b", 5900, "retrying", 0),
        ("c", 0, "", 1), ("c", 0, "retrying", 1), ("d", 5100, "completed", 0), ("e", 100_000, "pending", 0), ("e", 100_001, "retrying", 1), ("f", 5100, "retrying", 1),
    ]
