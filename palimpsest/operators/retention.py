"""Retention of a device's spool by total size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.scale import bucketed_running_sum


def enforce_cap(entries: DataFrame, max_bytes: int) -> DataFrame:
    """Add ``kept``: newest entries whose sizes fit ``max_bytes`` per device; the oldest go.

    ``entries``: device, uid, ts, size. A cap of zero or less keeps everything. Sizes are
    summed hour by hour first, so a busy device is not one task.
    """
    if max_bytes <= 0:
        return entries.withColumn("kept", F.lit(True))
    summed = bucketed_running_sum(
        entries,
        ["device"],
        F.date_trunc("hour", "ts"),
        [F.col("ts").desc(), F.col("uid").desc()],
        "size",
        "_total",
        newest_first=True,
    )
    return summed.withColumn("kept", F.col("_total") <= max_bytes).drop("_total")
