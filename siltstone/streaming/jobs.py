"""Streaming forms of the jobs that watch logs and queues. Each takes a streaming (or batch) DataFrame; the caller chooses
source, sink and trigger. State is bounded by watermarks, and sinks that write batches are idempotent by batch id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def error_windows(logs: DataFrame, late: str = "2 minutes", length: str = "60 seconds") -> DataFrame:
    """start, fingerprint, target, n: counts of errors and warnings by fingerprint in tumbling windows of event time; logs
    later than the watermark are left out."""
    from siltstone.functions.text import fingerprint

    bad = logs.where(F.upper("level").isin("ERROR", "WARN")).withWatermark("timestamp", late)
    rows = bad.withColumn("fingerprint", fingerprint(F.col("target"), F.col("message")))
    return rows.groupBy(F.window("timestamp", length).alias("w"), "fingerprint", "target").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "fingerprint", "target", "n")


def debounced_sessions(queue: DataFrame, cooldown: str = "180 seconds", late: str = "10 minutes") -> DataFrame:
    """session_id, start, end, n: runs of queue items of a session without a pause of the cooldown, given out when it is over."""
    w = F.session_window("queued_at", cooldown)
    out = queue.withWatermark("queued_at", late).groupBy("session_id", w.alias("w")).agg(F.count("*").alias("n"))
    return out.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cooled_down(rows: DataFrame, by: str, time: str, seconds: float = 30.0, idle: str = "1 hour") -> DataFrame:
    """by, time of rows that come at least `seconds` after the last one of their key that was let through. Keys that are idle
    past the watermark are forgotten."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = sorted(t for pdf in batches for t in pdf[time])
        kept = []
        for t in times:
            at = t.timestamp()
            if last is None or at - last >= seconds:
                kept.append(t)
                last = at
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last * 1000) + int(seconds * 1000), state.getCurrentWatermarkMs() + 1000))
        if kept:
            yield pd.DataFrame({by: [key[0]] * len(kept), time: kept})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(by, time).withWatermark(time, idle).groupBy(by).applyInPandasWithState(step, f"{by} {kinds[by]}, {time} {kinds[time]}", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited(requests: DataFrame, by: str, time: str, capacity: float = 60, window: float = 60.0, idle: str = "1 hour") -> DataFrame:
    """by, time, allowed: a token bucket of each key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        times, allowed = sorted(t for pdf in batches for t in pdf[time]), []
        for t in times:
            at = t.timestamp()
            if last is not None:
                tokens = min(capacity, tokens + max(0.0, at - last) * capacity / window)
            last = at if last is None else max(last, at)
            allowed.append(tokens >= 1)
            tokens -= tokens >= 1
        state.update((float(tokens), float(last)))
        state.setTimeoutTimestamp(max(int(last * 1000) + int(window * 1000), state.getCurrentWatermarkMs() + 1000))
        yield pd.DataFrame({by: [key[0]] * len(times), time: times, "allowed": allowed})

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    return requests.select(by, time).withWatermark(time, idle).groupBy(by).applyInPandasWithState(step, f"{by} {kinds[by]}, {time} {kinds[time]}, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def sink_logs(logs: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Writes logs to parquet folders by batch; a batch that runs again overwrites what it wrote."""

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={no}")

    return logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()
