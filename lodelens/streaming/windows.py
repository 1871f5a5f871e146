"""Streams: new records processed once a batch, and activity windows with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_windows(events: DataFrame, time: str, key: str, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions per key: a gap longer than ``gap`` ends one. Rows later than ``late`` are left out.

    This is the batch rule for change windows only where keys don't interleave: a batch window also ends where another
    author's change comes in between.
    """
    windows = events.where(F.col(key).isNotNull()).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return windows.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def process_new(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Run a transformation over whatever has come in, exactly once a batch: each batch overwrites its own directory."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
