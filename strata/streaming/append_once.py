"""Streams: records appended once, and sliding counts of events, with bounds on how late they may come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_once(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key's first record; repeats within the lateness bound are dropped, so a replayed record is no second one."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def conflicts(batch: DataFrame, key: str) -> DataFrame:
    """Keys of a batch that come with different payloads: for foreachBatch."""
    rest = sorted(c for c in batch.columns if c != key)
    h = F.xxhash64(F.to_json(F.struct(*rest)))
    return batch.groupBy(key).agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b").select(key)


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums of each window and kind, given out once the window can get no more."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
