"""From forecasts to micro-batch intervals: rule, smoothing, failure fallback, reports."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streampace.functions import intervals as fi
from streampace.plans import chunks, folds
from streampace.plans.chunks import CHUNK_SIZE

UNSET = -1   # state and interval before the first target


@dataclass(frozen=True)
class Smoothing:
    """Exponential smoothing of whole milliseconds with a limit on the change per step.

    With the default ``alpha`` a step keeps at least 0.7 of the interval, so ``max_shrink`` can bind
    only for ``alpha > 1 - max_shrink``.
    """

    alpha: float = 0.3
    max_shrink: float = 0.5
    max_expand: float = 2.0
    min_ms: int = 100
    max_ms: int = 30000
    fallback_ms: int = 2000
    failures: int = 3

    def __post_init__(self) -> None:
        if not (0 < self.alpha <= 1 and 0 < self.max_shrink <= 1 <= self.max_expand):
            raise ValueError("need 0 < alpha <= 1 and 0 < max_shrink <= 1 <= max_expand")

    def step(self, current: int, target: int) -> int:
        if current <= 0:
            return target
        mixed = int(self.alpha * target + (1 - self.alpha) * current)
        limited = min(max(mixed, int(current * self.max_shrink)), int(current * self.max_expand))
        return min(max(limited, self.min_ms), self.max_ms)

    def step_all(self, current: np.ndarray, target: int) -> np.ndarray:
        mixed = (self.alpha * target + (1 - self.alpha) * current).astype(np.int64)
        limited = np.minimum(np.maximum(mixed, (current * self.max_shrink).astype(np.int64)),
                             (current * self.max_expand).astype(np.int64))
        return np.where(current <= 0, target, np.clip(limited, self.min_ms, self.max_ms))

    def falls_back(self, failed: int, recovers: bool) -> bool:
        """Whether the ``failed``-th failure in a row resets the interval."""
        return failed > 0 and failed % self.failures == 0 if recovers else failed >= self.failures

    @property
    def top(self) -> int:
        """A state from which, as from all above it, one step ends at ``max_ms``."""
        return math.ceil(self.max_ms / self.max_shrink) + 1


def with_interval(df: DataFrame, rate: str, confidence: str | None = None,
                  rule: fi.IntervalRule = fi.LIVE, out: str = "raw_ms") -> DataFrame:
    conf = F.col(confidence) if confidence else None
    return df.withColumn(out, fi.interval_ms(F.col(rate), conf, rule))


def _chunk_map(rule: Smoothing):
    """Map of a chunk: every whole state 0..top is carried along, and equal neighbours merge.

    A step shrinks differences by ``1 - alpha``, so after a few dozen steps only a handful of
    distinct states are left.
    """
    def build(part: pd.DataFrame) -> tuple[Sequence[int], Sequence[int]]:
        starts = ends = np.arange(rule.top + 1, dtype=np.int64)
        touched = False
        for target, reset in zip(part["_target"].to_numpy(dtype="float64", na_value=np.nan),
                                 part["_reset"].to_numpy(dtype=bool)):
            if reset:
                starts, ends = np.zeros(1, np.int64), np.full(1, rule.fallback_ms, np.int64)
            elif np.isnan(target):
                continue
            elif len(ends) <= 8:
                ends = np.array([rule.step(int(s), int(target)) for s in ends], dtype=np.int64)
            else:
                ends = rule.step_all(ends, int(target))
            touched = True
            fresh = np.concatenate(([True], ends[1:] != ends[:-1]))
            if not fresh.all():
                starts, ends = starts[fresh], ends[fresh]
        return (starts, ends) if touched else ((), ())
    return build


def _fold(rule: Smoothing):
    def body(run: pd.DataFrame, state: int) -> tuple[dict[str, Sequence], int]:
        out = []
        for target, reset in zip(run["_target"].tolist(), run["_reset"].tolist()):
            if reset:
                state = rule.fallback_ms
            elif target is not None and target == target:
                state = rule.step(state, int(target))
            out.append(state)
        return {"smoothed_ms": out}, state
    return body


def smooth_intervals(df: DataFrame, raw: str = "raw_ms", rule: Smoothing = Smoothing(),
                     failures: bool = False, recovers: bool = True,
                     size: int = CHUNK_SIZE) -> DataFrame:
    """Add ``smoothed_ms``; with ``failures`` also ``failed_run`` and ``fallback``.

    The first target of a series passes as it is. A null target keeps the interval; with ``failures``
    it counts as a failure, and the third one in a row resets the interval to the fallback until a
    target succeeds. ``recovers=True`` starts counting anew after that, so every third failure resets;
    otherwise each further failure does. Before any target the interval is -1 (no override).
    """
    target = F.col(raw).cast("long")
    placed = chunks.with_chunk(df, size).withColumns(
        {"_target": target, "_initial": F.lit(UNSET).cast("long")})
    if failures:
        ok = F.when(F.col("_target").isNotNull(), F.col("step"))
        here = chunks.up_to_here()
        carried = chunks.attach_carry(
            placed.withColumn("_ok", F.max(ok).over(here)),
            {"_last": F.max(ok), "_first": F.min("step")},
            lambda before, whole: {"_ok_before": F.max("_last").over(before),
                                   "_start": F.min("_first").over(whole)})
        last_ok = F.coalesce("_ok", "_ok_before", F.col("_start") - 1)
        run = (F.col("step") - last_ok).cast("int")
        if recovers:
            reset = (F.col("failed_run") > 0) & (F.col("failed_run") % rule.failures == 0)
        else:
            reset = F.col("failed_run") >= rule.failures
        placed = carried.withColumn("failed_run", run).drop(
            "_ok", "_ok_before", "_start").withColumn("_reset", reset)
    else:
        placed = placed.withColumn("_reset", F.lit(False))

    entering = folds.entering_states(placed, _chunk_map(rule), ["_target", "_reset"])
    folded = folds.fold_rows(
        placed, entering, _fold(rule), [T.StructField("smoothed_ms", T.LongType())])
    result = folded.drop("_target", "_reset")
    if failures:
        result = result.withColumn("fallback", F.col("failed_run") >= rule.failures)
    return result


def effective_interval(override: Column, configured: Column) -> Column:
    return fi.effective_interval(override, configured)


def interval_changes(smoothed: DataFrame, min_delta: int = 100, raw: str = "raw_ms") -> DataFrame:
    """Steps whose smoothed interval is more than ``min_delta`` away from the raw one."""
    return smoothed.filter(F.abs(F.col(raw) - F.col("smoothed_ms")) > min_delta)


def convergence(smoothed: DataFrame, target: str = "raw_ms", tolerance: float = 0.10) -> DataFrame:
    """First step per series within ``tolerance`` of the target, and the cycles needed; null if none."""
    near = F.abs(F.col("smoothed_ms") - F.col(target)) <= F.col(target) * tolerance
    return smoothed.groupBy("series_id").agg(
        F.min(F.when(near, F.col("step"))).alias("converged_step"),
        F.min("step").alias("_first"),
    ).select("series_id", "converged_step",
             (F.col("converged_step") - F.col("_first")).alias("cycles"))


def fallback_rate(smoothed: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Share of steps in fallback, in percent."""
    return smoothed.groupBy(*by).agg(
        (F.avg(F.col("fallback").cast("int")) * 100).alias("fallback_pct"),
        F.count(F.lit(1)).alias("steps"))
