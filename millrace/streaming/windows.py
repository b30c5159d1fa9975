"""The time buckets as Structured Streaming: tumbling and session windows with watermarks, and snapshots fed by micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import time_bucket


def tumbling(df: DataFrame, time: str, width: str, late: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Like operators.bucketed on a stream; weeks and days start as there. late: how long rows may come after others."""
    grouped = df.withWatermark(time, late).groupBy(F.window(time, width, startTime="4 days" if "week" in width else "0 seconds"), *keys).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("bucket"), *[c for c in grouped.columns if c != "window"])


def sessions(df: DataFrame, time: str, gap: str, late: str, keys: list[str], *aggregates: Column) -> DataFrame:
    grouped = df.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in grouped.columns if c != "session_window"])


def feed(df: DataFrame, store, table: str, checkpoint: str):
    """Each micro-batch as one commit of the table, once even if it is repeated."""

    def commit(batch: DataFrame, number: int) -> None:
        store.insert(table, batch, token=f"{checkpoint}#{number}")

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(commit)


__all__ = ["feed", "sessions", "time_bucket", "tumbling"]
