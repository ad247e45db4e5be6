"""Rows that came too late for a watermark, kept and reconciled.

Spark drops them and counts only what is left after partial aggregation. :func:`accepted` holds the rows that the
watermark let through, each once: windows are counted on it, and its keys are written by a second query over the same
files. What was received but not accepted is late, and :func:`reconciled` adds it to the windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accepted(received: DataFrame, key: str, ts: str, watermark: str) -> DataFrame:
    """Rows in time for the watermark, the first of each key. The state holds the keys of the watermark's span.

    A window counts a row that is behind the watermark as long as the window is open; here such a row is late.
    """
    return received.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def late_rows(received: DataFrame, in_time: DataFrame, key: str) -> DataFrame:
    """The side table: rows of the received table whose key was not accepted."""
    return received.join(in_time.select(key).distinct(), key, "left_anti")


def reconciled(counted: DataFrame, late: DataFrame, size: str, ts: str) -> DataFrame:
    """``window_start, window_end, events, late``: the stream's windows with the late rows of each added.

    ``counted`` comes from :func:`~streampace.operators.events.windowed_count`. A window may have late rows only.
    """
    missed = late.groupBy(F.window(ts, size).alias("w")).agg(F.count(F.lit(1)).alias("late"))
    both = counted.select("window_start", "window_end", "events", F.lit(0).cast("long").alias("late")).unionByName(
        missed.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      F.col("late").alias("events"), "late"))
    return both.groupBy("window_start", "window_end").agg(F.sum("events").alias("events"), F.sum("late").alias("late"))
