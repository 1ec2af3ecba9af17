"""The life of jobs as a stream: attempts, retries, and jobs that nobody hears of any more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "job_id string, at timestamp, state string, attempt int"
#: Groups that jobs are dealt to by their ids; a checkpoint holds to the number it began with.
GROUPS = 4096


def job_changes(events: DataFrame, max_attempts: int = 3, stale_seconds: int = 900, grace_seconds: int = 86_400) -> DataFrame:
    """Changes of state from a stream of (job_id, at, event); ``events`` needs a watermark on ``at``.

    Events: pending, running, completed, failed. A failure is retried up to ``max_attempts``
    times. A running job without news for ``stale_seconds`` of event time goes back to
    retrying without an attempt less, and is reported when the watermark passes. Events older than
    the last one of their job change nothing, and nor do those of a job that has completed or failed for good. What is known of
    a job goes ``grace_seconds`` after its last news. Jobs are dealt to GROUPS groups, each with one state: what is
    known of its jobs, and one timer for the first of them that is due. A micro-batch's events of a group are sorted by time.
    """

    def due(current: str, last: int) -> int:
        """Milliseconds at which a job's timer fires."""
        return last // 1000 + (stale_seconds if current == "running" else grace_seconds) * 1000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {job: (current, attempt, last, timer) for job, current, attempt, last, timer in zip(*state.get, strict=True)} if state.exists else {}
        watermark, out, heard = state.getCurrentWatermarkMs(), [], set()
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            found = sorted(zip(rows["at"].to_numpy("datetime64[us]").astype("int64").tolist(), rows["event"].tolist(), rows["job_id"].tolist(), strict=True), key=lambda r: (r[0], r[1] is None, r[1] or ""))
            for moment, event, job in found:
                heard.add(job)
                current, attempt, last, _ = known.get(job, ("", 0, 0, 0))
                if current not in ("completed", "failed") and moment >= last:
                    last = moment
                    if event == "failed":
                        current, attempt = ("retrying", attempt + 1) if attempt < max_attempts else ("failed", attempt)
                    else:
                        current = event
                    out.append((job, moment, current, attempt))
                known[job] = (current, attempt, last, 0)
            for job in heard:
                current, attempt, last, _ = known[job]
                known[job] = (current, attempt, last, max(due(current, last), watermark + 1))
        for job in [j for j, (*_, timer) in known.items() if timer <= watermark and j not in heard]:
            current, attempt, last, _ = known.pop(job)
            if current == "running":
                late = last + stale_seconds * 1_000_000
                known[job] = ("retrying", attempt, late, max(due("retrying", late), watermark + 1))
                out.append((job, late, "retrying", attempt))
        if known:
            columns = zip(*((j, *k) for j, k in known.items()), strict=True)
            state.update(tuple(list(c) for c in columns))
            state.setTimeoutTimestamp(max(watermark + 1, min(timer for *_, timer in known.values())))
        elif state.exists:
            state.remove()
        changes = pd.DataFrame(out, columns=["job_id", "at", "state", "attempt"])
        changes["at"] = pd.to_datetime(changes["at"], unit="us")
        yield changes

    group = F.pmod(F.xxhash64("job_id"), F.lit(GROUPS))
    rows = events.select(F.col("job_id").cast("string").alias("job_id"), "at", "event").withColumn("group", group)
    held = "job array<string>, state array<string>, attempt array<int>, last array<long>, timer array<long>"
    return rows.groupBy("group").applyInPandasWithState(step, CHANGES, held, "append", GroupStateTimeout.EventTimeTimeout)
