"""Sessions of devices: startups with no more than a gap between them belong together. The same function
serves a table and a stream; what it needs of a device is one open session, never its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = "30 minutes"


def sessions(events: DataFrame, device: str, at: str, gap: str = GAP) -> DataFrame:
    """device, session_start, last_seen, events of every session. Two events exactly a gap apart still belong together.

    For a stream, `at` must carry a watermark; a session comes out once no event can prolong it any more."""
    windows = events.groupBy(F.col(device).alias("device"), F.session_window(at, gap).alias("w"))
    return windows.agg(F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("events")).select(
        "device", F.col("w.start").alias("session_start"), "last_seen", "events")


def merged_locally(spark, on: bool = True) -> None:
    """Whether a task merges what it holds of a session before the shuffle: less to shuffle where devices start often."""
    spark.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", str(on).lower())
