"""Column functions over a window array (oldest value first).

Spark interprets higher-order functions, and unrolling several folds over a window exceeds what the
JVM compiles. So recursive averages and linear maps with many outputs run as array operations on whole
Arrow batches; all of them in a projection share one transfer of the window. Moments come from window
frames (see ``operators.features``), not from the array: an expression that a lambda refers to would
be evaluated again for each element.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_of(window: Column) -> Column:
    """Mean of a window of any length; null when empty."""
    total = F.aggregate(window, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(window) > 0, total / F.size(window))


def full_mean(window: Column, k: int) -> Column:
    """Mean of a full window, unrolled to a compiled sum; null if the window is shorter."""
    total = F.get(window, F.lit(0))
    for i in range(1, k):
        total = total + F.get(window, F.lit(i))
    return total / k


def last_of(window: Column) -> Column:
    return F.element_at(window, -1)


def _on_full_windows(k: int, out: int | None, compute: Callable[[np.ndarray], np.ndarray]):
    """Arrow UDF that applies ``compute`` to the rows with ``k`` values, as a matrix; others get null.

    ``compute`` returns one number per row, or with ``out`` a row of that many.
    """
    @F.arrow_udf("double" if out is None else "array<double>")
    def apply(windows: pa.Array) -> pa.Array:
        full = pc.fill_null(pc.equal(pc.list_value_length(windows), k), False)
        every = len(windows) == (full.true_count or 0)
        kept = windows if every else windows.filter(full)
        rows = kept.flatten().to_numpy(zero_copy_only=False).reshape(len(kept), k)
        result = pa.array(compute(rows).ravel())
        if out is not None:
            result = pa.ListArray.from_arrays(
                pa.array(np.arange(len(kept) + 1, dtype=np.int32) * out), result)
        if every:
            return result
        place = np.cumsum(full.to_numpy(zero_copy_only=False)) - 1
        return result.take(pa.array(place, mask=~full.to_numpy(zero_copy_only=False)))

    return apply


def ema_rows(rows: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential average of each row of a matrix, seeded with the oldest value."""
    columns = np.ascontiguousarray(rows.T)
    acc = columns[0].copy()
    for values in columns[1:]:
        acc = alpha * values + (1 - alpha) * acc
    return acc


def mean_rows(rows: np.ndarray) -> np.ndarray:
    """Mean of each row of a matrix, summed from the oldest value on."""
    columns = np.ascontiguousarray(rows.T)
    total = columns[0].copy()
    for values in columns[1:]:
        total = total + values
    return total / len(columns)


def ema_of(window: Column, alpha: float, k: int) -> Column:
    """Exponential average of a full window, seeded with the oldest value; else null."""
    return _on_full_windows(k, None, lambda rows: ema_rows(rows, alpha))(window)


def warmup_of(window: Column) -> Column:
    """Forecast while the window is not full: mean of what is there, 0 when empty."""
    return F.coalesce(mean_of(window), F.lit(0.0))


def normalised(window: Column, mu: Column, scale: Column) -> Column:
    return F.transform(window, lambda v: (v - mu) / scale)


def lag_normalised(window: Column, mu: Column, sd: Column) -> Column:
    """Centred and scaled lag window; a flat one becomes zeros."""
    return F.transform(
        window, lambda v: F.when(sd < 1e-6, F.lit(0.0)).otherwise((v - mu) / (sd + 1e-8)))


def moving_average_matrix(k: int, kernel: int = 5) -> np.ndarray:
    """Centred moving average of ``k`` values; the first and the last ``kernel // 2`` values are
    repeated at the ends."""
    pad = kernel // 2
    source = [*range(pad), *range(k), *range(k - pad, k)]
    matrix = np.zeros((k, k))
    for row in range(k):
        for column in source[row:row + kernel]:
            matrix[row, column] += 1 / kernel
    return matrix


def trend_residual_matrix(k: int, kernel: int = 5) -> np.ndarray:
    trend = moving_average_matrix(k, kernel)
    return np.vstack([trend, np.eye(k) - trend])


def low_frequency_matrix(k: int, cut: int = 10) -> np.ndarray:
    """Real parts, then imaginary parts, of the first ``cut`` frequencies of the real Fourier
    transform."""
    cut = min(cut, k // 2 + 1)
    angle = 2 * math.pi * np.outer(np.arange(cut), np.arange(k)) / k
    return np.vstack([np.cos(angle), -np.sin(angle)])


def linear_map(window: Column, matrix: np.ndarray) -> Column:
    """``matrix @ window`` of a full window; else null."""
    outputs, k = matrix.shape
    return _on_full_windows(k, outputs, lambda rows: rows @ matrix.T)(window)


def dot(values: Column, weights: np.ndarray, constant: float) -> Column:
    """``weights @ values + constant`` of an array as long as the weights; else null."""
    return _on_full_windows(len(weights), None, lambda rows: rows @ weights + constant)(values)


def mapped(values: Column, k: int, compute: Callable[[np.ndarray], np.ndarray]) -> Column:
    """``compute`` of the matrix of all arrays that have ``k`` values, one number for each; else null."""
    return _on_full_windows(k, None, compute)(values)


def dispersion_confidence(forecasts: list[Column]) -> Column:
    """1 / (1 + 10 s) in [0, 1], where s is the population deviation of normalised forecasts."""
    n = float(len(forecasts))
    mean = sum(forecasts[1:], forecasts[0]) / n
    squares = [(f - mean) * (f - mean) for f in forecasts]
    sd = F.sqrt(sum(squares[1:], squares[0]) / n)
    return F.least(F.greatest(1.0 / (1.0 + sd * 10), F.lit(0.0)), F.lit(1.0))
