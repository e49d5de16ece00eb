"""Incremental jobs as Structured Streaming, each with its batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from feedlake.operators.catalog import KEY, dedup_last, quick_sync, restrict_to_ids, upsert
from feedlake.sources.tables import current_version, publish_change

#: Seconds without a sign of life after which a run counts as stalled.
STALL_SECONDS = {"full": 90, "active_only": 300}


def _land(batch: DataFrame, target: str, make: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
    """Changes the feeds that a micro-batch touches, and no others. Their ids go through the driver; the batch is read once."""
    batch = batch.persist()
    try:
        feeds = [r[0] for r in batch.select("feed_id").distinct().collect()]
        if feeds:
            publish_change(batch.sparkSession, target, lambda old: make(old, batch), feeds)
    finally:
        batch.unpersist()


def stream_ingest(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Files of product rows upserted into the snapshot at ``target`` as they arrive. What is written follows the feeds
    of the batch, not the table; the upsert can be repeated, so a restart after a failed batch is safe.
    """
    merge = lambda old, new: new if old is None else upsert(old, new)
    land = lambda batch, _: _land(dedup_last(batch, KEY, order), target, merge)
    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_latest(updates: DataFrame, key: str = "id", time: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """The last delivery of each id within the watermark (update mode), of several at one time the largest; works on batches as well."""
    others = [c for c in updates.columns if c not in (key, time)]
    last = F.max(F.struct(F.col(time), *others)).alias("last")
    return updates.withWatermark(time, watermark).groupBy(key).agg(last).select(key, *[F.col(f"last.{c}").alias(c) for c in updates.columns if c != key])


def stream_quick_sync(updates: DataFrame, ids: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Price and stock of the used ids brought up to date as updates arrive; only the feeds of a batch are written."""
    if current_version(updates.sparkSession, target) is None:
        raise ValueError(f"nothing is published at {target}")
    land = lambda batch, _: _land(dedup_last(batch, KEY, ["last_updated"]), target, quick_sync)
    wanted = restrict_to_ids(updates, ids)
    return wanted.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stalled_runs(heartbeats: DataFrame, now: Column) -> DataFrame:
    """T4: runs whose last sign of life is older than their mode allows."""
    limit = F.coalesce(*[F.when(F.col("mode") == m, s) for m, s in STALL_SECONDS.items()])
    last = heartbeats.groupBy("run_id", "mode").agg(F.max("ts").alias("last"))
    idle = F.unix_timestamp(now) - F.unix_timestamp("last")
    return last.select("run_id", "mode", idle.alias("idle_seconds")).where(F.col("idle_seconds") > limit)


def stream_stalled(heartbeats: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """T4 on a stream: (run_id, mode, last, stalled_at), once for each silence longer than the run's mode allows.

    A run's heartbeats are a session that ends when its gap has passed without one; the watermark, moved on by
    the other runs, closes it, so state is kept for live runs only. Other modes have no limit and are left out.
    """
    gap = F.coalesce(*[F.when(F.col("mode") == m, f"{s} seconds") for m, s in STALL_SECONDS.items()])
    known = heartbeats.where(F.col("mode").isin(*STALL_SECONDS)).withWatermark("ts", watermark)
    silent = known.groupBy("run_id", "mode", F.session_window("ts", gap)).agg(F.max("ts").alias("last"))
    return silent.select("run_id", "mode", "last", F.col("session_window.end").alias("stalled_at"))


def watch_runs(heartbeats: DataFrame) -> DataFrame:
    """T4 by the clock: (run_id, mode, last, stalled_at), once for each silence longer than the run's mode allows, even if
    no other run is alive. heartbeats: run_id, mode, ts.

    Each live run is a key with a processing-time timer, set for the rest of what its last heartbeat allows; the
    timer's alarm takes the key off. Other modes have no limit and are left out.
    """
    schema = "run_id string, mode string, last timestamp, stalled_at timestamp"

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            at = lambda ms: pd.Timestamp(ms, unit="ms")
            yield pd.DataFrame({"run_id": [key[0]], "mode": [key[1]], "last": [at(last)], "stalled_at": [at(now)]})
            return
        last = max([*(state.get if state.exists else ()), *(int(b["ms"].max()) for b in batches if len(b))])
        state.update((last,))
        state.setTimeoutDuration(max(1, last + 1_000 * STALL_SECONDS[key[1]] - now))

    known = heartbeats.where(F.col("mode").isin(*STALL_SECONDS) & F.col("ts").isNotNull())
    known = known.select(F.col("run_id").cast("string").alias("run_id"), "mode", F.unix_millis("ts").alias("ms"))
    return known.groupBy("run_id", "mode").applyInPandasWithState(watch, schema, "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def throughput(heartbeats: DataFrame, width: str = "10 minutes", watermark: str = "30 minutes") -> DataFrame:
    """T5: rows per run and window; on a stream, windows close at the watermark."""
    per = heartbeats.withWatermark("ts", watermark).groupBy("run_id", F.window("ts", width)).agg(F.sum("processed_rows").alias("rows"))
    return per.select("run_id", F.col("window.start").alias("window_start"), "rows")
