"""Column functions that turn a forecast rate into a micro-batch interval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IntervalRule:
    """How many events a batch should hold, and the interval bounds in milliseconds."""

    target_events: float
    min_ms: int
    max_ms: int
    least_rate: float
    blend: bool               # mix with the fallback by confidence and cut to whole milliseconds
    fallback_ms: int = 2000
    least_confidence: float = 0.1


# Fixed values of the two published settings.
LIVE = IntervalRule(1000, 100, 30000, 1.0, True)
BACKTEST = IntervalRule(500, 100, 5000, 0.1, False)


def interval_ms(rate: Column, confidence: Column | None = None,
                rule: IntervalRule = LIVE) -> Column:
    """Interval for the next batch at a forecast ``rate`` (events per second)."""
    wanted = rule.target_events / F.greatest(rate, F.lit(rule.least_rate)) * 1000
    if not rule.blend:
        return F.least(F.greatest(wanted, F.lit(float(rule.min_ms))), F.lit(float(rule.max_ms)))
    conf = F.lit(1.0) if confidence is None else confidence
    whole = wanted.cast("long")
    mixed = (conf * whole + (1.0 - conf) * rule.fallback_ms).cast("long")
    bounded = F.greatest(F.lit(rule.min_ms), F.least(mixed, F.lit(rule.max_ms)))
    usable = (conf >= rule.least_confidence) & (rate > 0)
    return F.when(usable, bounded).otherwise(F.lit(rule.fallback_ms)).cast("long")


def interval_of(rate: float, confidence: float, rule: IntervalRule) -> int:
    """:func:`interval_ms` of one live forecast."""
    if confidence < rule.least_confidence or rate <= 0:
        return rule.fallback_ms
    wanted = int(rule.target_events / max(rate, rule.least_rate) * 1000)
    mixed = int(confidence * wanted + (1.0 - confidence) * rule.fallback_ms)
    return max(rule.min_ms, min(mixed, rule.max_ms))


def effective_interval(override: Column, configured: Column) -> Column:
    """The override where it is positive, else the configured interval."""
    return F.when(override > 0, override).otherwise(configured)


def ticks_of(interval: Column, tick_ms: int) -> Column:
    """Whole ticks in an interval, at least one; halves round to even."""
    return F.greatest(F.lit(1), F.bround(interval / tick_ms, 0).cast("int"))
