"""Edits as a stream: windows with a watermark, the newest state of each square, indexes kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def windowed(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """Edits of each kind in windows of event time; with `late`, a stream's watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late is not None:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", length).alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def gestures(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Bursts of one user's edits, closed by a pause."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late is not None:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("n"))


def kept_index(index_path: str, keys: list[str], find: Callable[[DataFrame], DataFrame], read: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: findings of the keys that a batch touches are dropped and found again.

    read gives the rows that touched keys can meet; find runs the operator on them. What is kept equals a whole run."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = batch.select(*keys).distinct()
        fresh = find(read(touched))
        if number:
            old = spark.read.parquet(f"{index_path}/{number - 1}")
            fresh = old.join(touched, keys, "left_anti").unionByName(fresh.join(touched, keys, "left_semi"))
        fresh.write.mode("overwrite").parquet(f"{index_path}/{number}")

    return step
