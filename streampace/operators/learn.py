"""Forecasters fitted on supervised windows, as Spark ML pipelines.

Models read the row that ``with_window`` makes and predict in the window's normalised space. Training
is distributed: only coefficients or tree nodes pass through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from streampace.functions import windows as fw
from streampace.operators import features as feat
from streampace.operators import boost, huber
from streampace.operators.features import K
from streampace.operators.forecast import Forecaster
from streampace.operators.score import error_report, score
from streampace.plans.durable import durable


class WindowFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Turn a window row into the vector ``features`` of one of three kinds.

    ``flat`` is the normalised window, ``trend`` its moving average and the rest, ``spectral`` its low
    frequencies. With ``lag`` the normalised lag window is appended.
    """

    kind = Param(Params._dummy(), "kind", "flat, trend or spectral", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "window length", TypeConverters.toInt)
    lag = Param(Params._dummy(), "lag", "append the lag window", TypeConverters.toBoolean)

    def __init__(self, kind: str = "flat", k: int = K, lag: bool = False) -> None:
        super().__init__()
        self._set(kind=kind, k=k, lag=lag)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kind, k = self.getOrDefault(self.kind), self.getOrDefault(self.k)
        rows = dataset
        if "norm" not in rows.columns:
            rows = feat.with_norm(rows)
        array = F.col("norm")
        if kind != "flat":
            array = fw.linear_map(array, _matrix(kind, k))
        if self.getOrDefault(self.lag):
            if "lag_norm" not in rows.columns:
                rows = feat.with_lag_norm(rows)
            array = F.concat(array, F.col("lag_norm"))
        return rows.withColumn("features", array_to_vector(array))


def _matrix(kind: str, k: int) -> np.ndarray:
    """The linear map of a normalised window that makes the features of ``kind``."""
    if kind == "trend":
        return fw.trend_residual_matrix(k)
    return fw.low_frequency_matrix(k, SPECTRUM) if kind == "spectral" else np.eye(k)


SPECTRUM = 10     # frequencies that ``low_frequency_matrix`` keeps

# Least scale of a label, in units of the rate. A window of zeros has scale 1e-8; the rate that ends such
# a quiet time would otherwise be a label of 1e8 and outweigh all other rows of the fit.
LABEL_SCALE = 0.05


def samples(series: DataFrame, k: int = K, lag: bool = False, least_scale: float = LABEL_SCALE) -> DataFrame:
    """Supervised rows with ``norm`` (and ``lag_norm``) arrays and ``label``; other columns are kept.

    Labels are bounded by ``least_scale``; every row is kept, and forecasts are scaled as ever.
    """
    return feat.normal_windows(series, k, lag).withColumn("label", (F.col("rate") - F.col("mu")) / F.greatest(
        F.col("scale"), F.lit(float(least_scale))))


def _inputs(train: DataFrame, lag: bool) -> DataFrame:
    """``features, label``: the normalised window, and with ``lag`` the lag window after it. What :func:`stored` gave stays."""
    if train.columns == ["packed"]:
        return train
    array = F.concat("norm", "lag_norm") if lag else F.col("norm")
    return train.select(array.alias("features"), "label")


def stored(train: DataFrame, lag: bool = False) -> DataFrame:
    """Samples stored once for several linear fits, which must have the same ``lag``."""
    return durable(huber.packed(_inputs(train, lag).filter(F.col("label").isNotNull())), "samples")


def _fit_huber(name: str, train: DataFrame, kind: str, k: int, lag: bool, delta: float, max_iter: int) -> Forecaster:
    made = WindowFeatures(kind, k, lag)
    # The features are a linear map of the windows, so only the windows are stored and summed up.
    matrix = _matrix(kind, k)
    basis = np.zeros((len(matrix) + k * lag, k + k * lag))
    basis[:len(matrix), :k] = matrix
    if lag:
        basis[len(matrix):, k:] = np.eye(k)
    beta, _ = huber.fit(_inputs(train, lag), len(basis), delta, max_iter=max_iter, basis=basis)
    return Forecaster(name, model=PipelineModel([made, huber.LinearMap(beta[:-1].tolist(), float(beta[-1]))]))


def fit_trend_linear(train: DataFrame, name: str = "trend_linear", k: int = K, lag: bool = False,
                     max_iter: int = 50, delta: float = 1.0) -> Forecaster:
    """Linear in the moving average and the residual of the window, under a Huber loss."""
    return _fit_huber(name, train, "trend", k, lag, delta, max_iter)


def fit_spectral(train: DataFrame, name: str = "spectral_linear", k: int = K, lag: bool = False,
                 max_iter: int = 50, delta: float = 1.0) -> Forecaster:
    """Linear in the low frequencies of the window, under a Huber loss."""
    return _fit_huber(name, train, "spectral", k, lag, delta, max_iter)


def fit_window_trees(train: DataFrame, name: str = "window_trees", k: int = K, lag: bool = False,
                     max_iter: int = 10, max_depth: int = 4, seed: int = 42) -> Forecaster:
    """A nonlinear map of the flat window: boosted trees under the absolute loss."""
    trees = boost.fit(_inputs(train, lag), k + k * lag, max_iter, max_depth, seed=seed)
    return Forecaster(name, model=PipelineModel([WindowFeatures("flat", k, lag), boost.BoostedTrees(trees, k + k * lag)]))


def validation_report(validation: DataFrame, models: Sequence[Forecaster]) -> DataFrame:
    """MAE, RMSE and three-way direction accuracy in normalised space, per model."""
    rows = validation
    for m in models:
        before = rows.columns
        rows = m.model.transform(rows).select(*before, F.col("prediction").alias(f"pred_{m.name}"))
    long = rows.select(
        F.col("label").alias("actual"), F.element_at("norm", -1).alias("current"),
        *[f"pred_{m.name}" for m in models],
    ).unpivot(["actual", "current"], [f"pred_{m.name}" for m in models], "model", "pred")
    named = long.withColumn("model", F.substring("model", len("pred_") + 1, 1000))
    return error_report(score(named, ties="three_way")).drop("mape")


def save_models(models: Sequence[Forecaster], path: str) -> None:
    for m in models:
        m.model.write().overwrite().save(f"{path}/{m.name}_predictor")


def load_models(path: str, names: Sequence[str], missing: str = "skip") -> dict[str, Forecaster]:
    """Load saved models by name; a missing one is skipped or, with ``missing="fail"``, an error."""
    found: dict[str, Forecaster] = {}
    spark = SparkSession.active()
    for name in names:
        folder = f"{path}/{name}_predictor"
        try:
            spark.read.text(f"{folder}/metadata").limit(1).count()
        except AnalysisException:
            if missing == "fail":
                raise FileNotFoundError(folder) from None
            continue
        found[name] = Forecaster(name, model=PipelineModel.load(folder))
    return found
