"""An extension beyond the reference's batch model: windows over a stream of events, and incremental upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolake.sources.sinks import swap_in, upserted


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; works on batches and on streams, where rows later than ``lateness`` are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    by = rows.groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of users: rows no further apart than the gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    by = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "n", "total")


def upsert_stream(spark: SparkSession, source: DataFrame, path: str, checkpoint: str, key: Sequence[str], order: str):
    """A query that merges each batch of a stream into a table: the last row of a key in a batch wins, and a batch that runs twice changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("r")).select(*key, "r.*")
        try:
            old = spark.read.schema(batch.schema).parquet(path)
            old.limit(1).count()
        except Exception as error:  # noqa: BLE001  the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise
            old = spark.createDataFrame([], batch.schema)
        swap_in(spark, upserted(old, last, key), path)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
