"""Streams of events by 15-minute bucket, with the position of the sun. The reference system has no streams; this is an extension of its buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.functions.solar import with_solar


def solar_buckets(events: DataFrame, ts: str = "ts", late: str = "30 minutes") -> DataFrame:
    """bucket_start, n_events and the sun's columns for a stream (or table) of events; events later than `late` are dropped by the watermark, and state with them.

    ts is a zoned timestamp, whose session time zone must be UTC. A bucket is given once it is closed (append mode).
    """
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, "15 minutes")).agg(F.count(F.lit(1)).alias("n_events"))
    return with_solar(counted.select(F.col("window.start").cast("timestamp_ntz").alias("bucket_start"), "n_events"), "bucket_start")
