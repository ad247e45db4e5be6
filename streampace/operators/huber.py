"""Linear regression under the plain Huber loss, by iteratively reweighted least squares.

The loss is half the square of a residual up to ``delta`` and ``delta`` times the rest beyond. Each round gives a row the
weight ``min(1, delta / |residual|)`` and solves the weighted normal equations. The tasks sum up outer products of
their rows; Spark adds the sums, and only a matrix of the features' size comes to the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streampace.functions import windows as fw
from streampace.plans.durable import durable
from streampace.plans.packed import pack, unpack
from streampace.session import ship

BATCH = 4096      # rows whose outer products are made at once


class LinearMap(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Column ``prediction``: coefficients times the vector ``features``, plus the intercept."""

    coefficients = Param(Params._dummy(), "coefficients", "one for each feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "constant term", TypeConverters.toFloat)

    def __init__(self, coefficients: list[float] | None = None, intercept: float = 0.0) -> None:
        super().__init__()
        self._set(coefficients=coefficients or [], intercept=float(intercept))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = np.array(self.getOrDefault(self.coefficients))
        return dataset.withColumn("prediction", fw.dot(vector_to_array("features"), weights, self.getOrDefault(self.intercept)))


def packed(rows: DataFrame) -> DataFrame:
    """``rows(features, label)`` as ``packed`` rows of doubles, the label after the features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pack(matrix_of(batch))

    return rows.select("features", F.col("label").cast("double")).mapInArrow(run, "packed binary")


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    """A row for each of ``features, label``, the label last."""
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.column_stack([x, batch.column(1).to_numpy(zero_copy_only=False)])


def normal_sums(rows: DataFrame, beta: np.ndarray, delta: float = 1.0) -> DataFrame:
    """``i, j, value``: the sums of weight times feature i times feature j over ``rows(features, label)``, at the weights of the
    residuals of ``beta``. The constant is the last feature and the label the one after it; ``(-1, -1)`` holds the loss.
    ``rows`` may be :func:`packed`."""
    d = len(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = np.zeros((d + 1, d + 1)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unpack(batch.column(0), d * 8).view(np.float64) if batch.num_columns == 1 else matrix_of(batch)
            for start in range(0, len(rows), BATCH):
                full = np.insert(rows[start:start + BATCH], d - 1, 1.0, axis=1)
                residual = np.abs(full[:, d] - full[:, :d] @ beta)
                weight = delta / np.maximum(residual, delta)
                total += full.T @ (full * weight[:, None])
                loss += float(np.where(residual <= delta, residual ** 2 / 2, delta * (residual - delta / 2)).sum())
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at[0], -1), pa.int32()), pa.array(np.append(at[1], -1), pa.int32()),
             pa.array(np.append(total.ravel(), loss))], names=["i", "j", "value"])

    plain = rows if rows.columns == ["packed"] else rows.select("features", F.col("label").cast("double"))
    return plain.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def fit(rows: DataFrame, features: int, delta: float = 1.0, reg: float = 1e-6, max_iter: int = 50,
        tolerance: float = 1e-6, basis: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Coefficients (the constant last) and mean loss over ``rows(features array, label)``.

    ``rows`` may be stored :func:`packed` rows, which are read as they are. With ``basis``, a matrix of ``features`` rows, the features are ``basis`` times the array of a row.

    ``reg`` is a ridge per row on all but the constant, which makes collinear features share their weight.
    Rows without a label are left out.
    """
    ship(rows.sparkSession)
    stored = rows if rows.columns == ["packed"] else durable(packed(rows.filter(F.col("label").isNotNull())), "samples")
    basis = np.eye(features) if basis is None else basis
    lift = np.zeros((features + 2, basis.shape[1] + 2))      # constant and label stay what they are
    lift[:features, :-2], lift[-2, -2], lift[-1, -1] = basis, 1.0, 1.0
    beta, loss = np.zeros(features + 1), 0.0
    for _ in range(max_iter):
        sums = np.zeros((basis.shape[1] + 2, basis.shape[1] + 2))
        for r in normal_sums(stored, beta @ lift[:-1, :-1], delta).collect():
            if r.i < 0:
                loss = r.value
            else:
                sums[r.i, r.j] = r.value
        sums = lift @ sums @ lift.T
        left, right = sums[:-1, :-1], sums[:-1, -1]
        rows_weight = left[-1, -1]
        if rows_weight == 0:
            raise ValueError("no rows to fit")
        ridge = reg * rows_weight * np.eye(features + 1)
        ridge[-1, -1] = 0.0
        after = np.linalg.solve(left + ridge, right)
        moved = np.abs(after - beta).max()
        beta = after
        if moved <= tolerance:
            break
    return beta, loss
