"""Sliding-window features of series: windows, moments, normalised arrays, supervised samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streampace.functions import windows as fw
from streampace.functions.rates import EPSILON, SIGMA_FLOOR, spread
from streampace.plans import chunks
from streampace.plans.chunks import CHUNK, CHUNK_SIZE
from streampace.session import ship

K = 30


def over_frame(series: DataFrame, start: int, end: int,
               build: Callable[[WindowSpec, WindowSpec], dict[str, Column]],
               size: int = CHUNK_SIZE) -> DataFrame:
    """Add columns computed over the frame of rows ``start..end`` around each step.

    ``build(frame, order)`` receives the framed window and the unframed one (for lag and lead of at
    most one row). All columns share one shuffle and one sort.
    """
    halo = chunks.with_halo(series, max(-start, 1), max(end, 1), size)
    order = chunks.in_chunk()
    return chunks.trim(halo.withColumns(build(order.rowsBetween(start, end), order)), size)


def _moments(value: str, frame: WindowSpec, prefix: str = "") -> dict[str, Column]:
    return {f"{prefix}mu": F.avg(value).over(frame), f"{prefix}sd": F.stddev_pop(value).over(frame)}


def _windowed(series: DataFrame, start: int, end: int, lag: bool, following: bool,
              size: int) -> DataFrame:
    """Window arrays and their moments over the frame ``start..end``."""
    def build(frame: WindowSpec, order: WindowSpec) -> dict[str, Column]:
        cols = {"win": F.collect_list("rate").over(frame), **_moments("rate", frame)}
        if lag:
            cols |= {"lag_win": F.collect_list("lag").over(frame), **_moments("lag", frame, "lag_")}
        if following:
            cols["actual"] = F.lead("rate").over(order)
        return cols

    framed = over_frame(series, start, end, build, size)
    return framed.withColumn("scale", spread(F.col("mu"), F.col("sd"))).drop("sd")


def with_window(series: DataFrame, k: int = K, lag: bool = False, following: bool = False,
                size: int = CHUNK_SIZE) -> DataFrame:
    """The last ``k`` rates up to each step, their mean, scale and readiness.

    Adds ``win``, ``mu``, ``scale``, ``ready``; with ``lag`` also ``lag_win``, ``lag_mu``, ``lag_sd``;
    with ``following`` the next rate as ``actual``.
    """
    framed = _windowed(series, -(k - 1), 0, lag, following, size)
    return framed.withColumn("ready", F.size("win") == k)


def with_norm(windows: DataFrame) -> DataFrame:
    """Column ``norm``: the window in its own mean and scale."""
    return windows.withColumn(
        "norm", fw.normalised(F.col("win"), F.col("mu"), F.col("scale")))


def with_lag_norm(windows: DataFrame) -> DataFrame:
    """Column ``lag_norm``: the lag window, independent of the rate's scale."""
    return windows.withColumn(
        "lag_norm", fw.lag_normalised(F.col("lag_win"), F.col("lag_mu"), F.col("lag_sd")))


def supervised(series: DataFrame, k: int = K, use_lag: bool = False,
               size: int = CHUNK_SIZE) -> DataFrame:
    """Training samples: the ``k`` rates before a step against the rate of the step.

    Both are in the window's mean and scale. ``features`` is ``array<double>``, or with ``use_lag``
    ``array<struct<rate, lag>>``. Columns that the input has besides are kept.
    """
    framed = _windowed(series, -k, -1, use_lag, False, size).filter(F.size("win") == k)
    rates = fw.normalised(F.col("win"), F.col("mu"), F.col("scale"))
    if use_lag:
        lags = fw.lag_normalised(F.col("lag_win"), F.col("lag_mu"), F.col("lag_sd"))
        features = F.arrays_zip(rates.alias("rate"), lags.alias("lag"))
    else:
        features = rates
    samples = framed.withColumns({
        "features": features,
        "label": (F.col("rate") - F.col("mu")) / F.col("scale"),
    })
    return samples.drop("win", "lag_win", "lag_mu", "lag_sd")


ROWS = 4096       # least rows whose windows are cut at once


def normal_windows(series: DataFrame, k: int = K, use_lag: bool = False, size: int = CHUNK_SIZE) -> DataFrame:
    """The rows of :func:`supervised` with ``norm`` (and ``lag_norm``) arrays, ``mu`` and ``scale``, but no label.

    The rows of a chunk come in order, and a task cuts the windows of thousands of rows at once as matrices; it
    carries over the ``k`` rows that the next windows look back at. For learners, which read the arrays in Python.
    """
    ship(series.sparkSession)
    made = [T.StructField("mu", T.DoubleType()), T.StructField("scale", T.DoubleType()),
            *[T.StructField(n, T.ArrayType(T.DoubleType(), False)) for n in ["norm"] + ["lag_norm"] * use_lag]]
    plain = series.drop(*[f.name for f in made])
    ordered = chunks.ordered(chunks.with_halo(plain, k, 1, size)).withColumn(
        "_own", F.col(CHUNK) == chunks.chunk_of("step", size))
    names = plain.columns

    def cut(column: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        windows = np.lib.stride_tricks.sliding_window_view(values, k)[at - k]
        mu = windows.mean(axis=1, keepdims=True)
        windows = windows - mu
        return windows, mu, np.sqrt((windows ** 2).mean(axis=1, keepdims=True))

    def arrays(matrix: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * k), pa.array(matrix.ravel()))

    def full(column: pa.Array) -> np.ndarray:
        """For each row from ``k`` on, whether the ``k`` values before it are known."""
        known = np.concatenate([[0], np.cumsum(column.is_valid().to_numpy(zero_copy_only=False))])
        return known[k:-1] - known[:-k - 1] == k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[pa.RecordBatch] = []

        def flush(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
            table = pa.Table.from_batches(held).combine_chunks()
            rows = {c: table[c].chunk(0) for c in table.column_names}
            out = None
            if table.num_rows > k:
                fits = (rows["_row"].to_numpy() > k)[k:] & rows["_own"].to_numpy(zero_copy_only=False)[k:] & full(rows["rate"])
                at = np.flatnonzero(fits) + k
                if len(at):
                    windows, mu, sd = cut(rows["rate"], at)
                    scale = np.maximum(sd, mu * SIGMA_FLOOR) + EPSILON
                    columns = [rows[c].take(pa.array(at)) for c in names]
                    columns += [pa.array(mu[:, 0]), pa.array(scale[:, 0]), arrays(windows / scale)]
                    if use_lag:
                        windows, _, sd = cut(rows["lag"], at)
                        columns.append(arrays(np.where(sd < 1e-6, 0.0, windows / (sd + 1e-8))))
                    out = pa.RecordBatch.from_arrays(columns, names=[*names, *[f.name for f in made]])
            return out, table.slice(max(table.num_rows - k, 0)).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                out, carried = flush(carried + held)
                held = []
                if out is not None:
                    yield out
        if any(b.num_rows for b in held):
            out, _ = flush(carried + held)
            if out is not None:
                yield out

    return ordered.mapInArrow(run, T.StructType([*plain.schema.fields, *made]))


def trend_residual(windows: DataFrame, column: str = "norm", k: int = K,
                   kernel: int = 5) -> DataFrame:
    """Columns ``trend`` and ``residual`` of a window array; null until it is full."""
    both = fw.linear_map(F.col(column), fw.trend_residual_matrix(k, kernel))
    return windows.withColumn("_both", both).withColumns({
        "trend": F.slice("_both", 1, k), "residual": F.slice("_both", k + 1, k)}).drop("_both")


def spectral(windows: DataFrame, column: str = "norm", k: int = K, cut: int = 10) -> DataFrame:
    """Column ``spectrum``: real, then imaginary parts of the lowest ``cut`` frequencies; null
    until the window is full."""
    return windows.withColumn(
        "spectrum", fw.linear_map(F.col(column), fw.low_frequency_matrix(k, cut)))
