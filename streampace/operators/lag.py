"""Consumer lag of a rate series: a queue that never drops below zero.

``lag[t] = max(0, lag[t-1] + x[t])`` has the closed form ``S[t] - min(0, min(S[..t]))`` with ``S`` the
running sum of ``x``. Sums and minima run inside a chunk; a chunk passes on only its total and its
lowest point, so a long series costs no ordered pass in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streampace.operators.features import K
from streampace.plans import chunks
from streampace.plans.chunks import CHUNK, CHUNK_SIZE


def _queue(flow: DataFrame, out: str) -> DataFrame:
    """Column ``out`` from the inflow ``_x``; ``flow`` carries the chunk column."""
    here = chunks.up_to_here()
    summed = flow.withColumn("_s", F.sum("_x").over(here))
    lowest = summed.withColumn("_low", F.min("_s").over(here))

    # Entering level of a chunk, by the same closed form over the chunk totals before it.
    totals = summed.groupBy("series_id", CHUNK).agg(
        F.sum("_x").alias("_total"), F.min("_s").alias("_dip"))
    before = Window.partitionBy("series_id").orderBy(CHUNK)
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    based = totals.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
    entering = based.select(
        "series_id", CHUNK,
        (F.col("_base") - F.least(F.lit(0.0), F.coalesce(
            F.min(F.col("_base") + F.col("_dip")).over(earlier), F.lit(0.0)))).alias("_enter"))
    level = F.col("_s") + F.greatest(F.col("_enter"), -F.col("_low"))
    return lowest.join(entering, ["series_id", CHUNK]).withColumn(out, level).drop(
        "_x", "_s", "_low", "_enter", CHUNK)


def with_lag(series: DataFrame, baseline: float | Column, ratio: float = 1.2,
             out: str = "lag", size: int = CHUNK_SIZE) -> DataFrame:
    """Lag against a constant capacity ``ratio * baseline``; 0 at step 0."""
    base = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    inflow = F.when(F.col("step") == 0, F.lit(0.0)).otherwise(F.col("rate") - base * ratio)
    return _queue(chunks.with_chunk(series, size).withColumn("_x", inflow), out)


def with_rolling_lag(series: DataFrame, k: int = K, ratio: float = 1.2, hold_idle: bool = True,
                     out: str = "lag", size: int = CHUNK_SIZE) -> DataFrame:
    """Lag against ``ratio`` times the mean of the last ``k`` rates, the current one included.

    With ``hold_idle`` a step without input keeps the lag instead of draining it.
    """
    frame = chunks.in_chunk().rowsBetween(-(k - 1), 0)
    halo = chunks.with_halo(series, before=k - 1, size=size)
    inflow = F.col("rate") - F.avg("rate").over(frame) * ratio
    if hold_idle:
        inflow = F.when(F.col("rate") == 0, F.lit(0.0)).otherwise(inflow)
    return _queue(chunks.trim(halo.withColumn("_x", inflow), size, keep_chunk=True), out)
