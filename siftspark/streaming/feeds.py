"""Streams: a feed of file changes into the snapshot store, windowed counts, and distinct events.

Defined cases: events later than the watermark are dropped; an event seen again within the watermark counts
once; an empty batch commits nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators import state
from siftspark.plans.store import Store

CHANGES = "path string, folder string, image_id string, mtime double, deleted boolean"


def change_feed(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet drops of file changes as a stream."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).parquet(landing)


def apply_changes(store: Store, batch: DataFrame) -> None:
    """The latest change of each path replaces or removes its row; replaying a batch changes nothing."""
    if batch.isEmpty():
        return
    last = batch.groupBy("path").agg(F.max_by(F.struct("folder", "image_id", "mtime", "deleted"), F.struct("mtime", F.coalesce("deleted", F.lit(False)))).alias("x")).select("path", "x.*")
    old = store.read("files")
    merged = state.merge(old, last.where("not coalesce(deleted, false)").drop("deleted"), "path")
    store.commit(files=merged.join(last.where("deleted").select("path"), "path", "left_anti"))


def follow(store: Store, landing: str, checkpoint: str):
    """Consume what has landed, then stop; run again for more."""
    feed = change_feed(store.spark, landing)
    return feed.writeStream.foreachBatch(lambda b, _: apply_changes(store, b)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, window: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """window_start, event_type, n, total of (ts, event_type, value), batch or stream;
    late=None for a stream that has its watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """Activity sessions of each user."""
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def distinct(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])
