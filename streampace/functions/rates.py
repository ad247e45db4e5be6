"""Column functions of rates: bounds, normalised space, regimes, direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGMA_FLOOR = 0.05      # least spread, as a share of the mean
EPSILON = 1e-8


def spread(mu: Column, sd: Column) -> Column:
    """Scale of a window: its deviation, at least 5 % of its mean, never zero."""
    return F.greatest(sd, mu * SIGMA_FLOOR) + EPSILON


def denormalise(pred: Column, mu: Column, scale: Column) -> Column:
    """A normalised forecast as a rate, never negative."""
    return F.greatest(pred * scale + mu, F.lit(0.0))


def floored(rate: Column, least: float = 1.0) -> Column:
    return F.greatest(rate, F.lit(least))


def regimes(rate: Column, previous: Column, burst_above: float = 200.0,
            step_above: float = 50.0) -> Column:
    """Tags of a step: always ``all``, plus ``burst`` and/or ``transition``."""
    return F.array_compact(F.array(
        F.lit("all"),
        F.when(rate > burst_above, F.lit("burst")),
        F.when(F.abs(rate - previous) > step_above, F.lit("transition")),
    ))


def same_direction(pred: Column, actual: Column, current: Column,
                   ties: str = "two_way") -> Column:
    """Whether forecast and outcome move the same way from ``current``.

    ``two_way`` counts "unchanged" as down; ``three_way`` compares signs.
    """
    if ties == "two_way":
        return (pred > current) == (actual > current)
    if ties == "three_way":
        return F.signum(pred - current) == F.signum(actual - current)
    raise ValueError(f"unknown tie rule {ties!r}")


def percentage_error(error: Column, actual: Column) -> Column:
    return error / (actual + EPSILON) * 100
