"""Forecasts of the next rate, one column per model, and ensembles of them.

Predictions stay wide (``pred_<model>`` columns of the row that made them): adding a model or an
ensemble is one more expression and no shuffle. :func:`to_long` and :func:`to_wide` convert.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streampace.functions import windows as fw
from streampace.operators.features import K, with_window
from streampace.plans.chunks import CHUNK_SIZE

ALPHAS = (0.1, 0.2, 0.3, 0.5, 0.7)   # fixed grid of smoothing factors


@dataclass(frozen=True)
class Forecaster:
    """A named model. ``column`` maps ``(window, k)`` to a rate; or ``model`` is a fitted pipeline
    that reads a window row and adds a normalised ``prediction``; or ``members`` are averaged with
    ``weights`` (1 where none is given)."""

    name: str
    column: Callable[[Column, int], Column] | None = None
    model: PipelineModel | None = None
    members: tuple[str | Forecaster, ...] = ()
    weights: Mapping[str, float] | None = None


_REGISTRY: dict[str, Forecaster] = {}


def register(name: str, column: Callable[[Column, int], Column] | None = None,
             model: PipelineModel | None = None) -> Forecaster:
    """Make a forecaster known by name. ``column`` may be a pandas UDF over the window array."""
    if (column is None) == (model is None):
        raise ValueError("give either a column function or a fitted model")
    _REGISTRY[name] = Forecaster(name, column, model)
    return _REGISTRY[name]


def registered() -> list[str]:
    return list(_REGISTRY)


register("last", lambda win, k: fw.last_of(win))
register("sma", lambda win, k: fw.full_mean(win, k))
register("ema", lambda win, k: fw.ema_of(win, 0.3, k))


def ema_forecaster(name: str, alpha: float) -> Forecaster:
    return Forecaster(name, lambda win, k: fw.ema_of(win, alpha, k))


def ensemble_forecaster(name: str, members: Sequence[str | Forecaster],
                        weights: Mapping[str, float] | None = None) -> Forecaster:
    """The weighted mean of other forecasters, usable wherever a forecaster is."""
    return Forecaster(name, members=tuple(members), weights=weights)


def tuned_ema(validation: DataFrame, name: str = "ema", k: int = K) -> Forecaster:
    """The average whose smoothing factor has the least error on the validation series."""
    best = tune_ema(validation, k=k).filter("is_best").select("alpha").first()
    return ema_forecaster(name, best.alpha)


def _named(model: str | Forecaster) -> Forecaster:
    return _REGISTRY[model] if isinstance(model, str) else model


def predict_all(windows: DataFrame, models: Sequence[str | Forecaster], k: int = K) -> DataFrame:
    """Add ``pred_<name>`` for each model; null until the window is full.

    ``windows`` comes from :func:`~streampace.operators.features.with_window`. A linear model can fall
    below zero: its forecast is 0 then, and ``raw_<name>`` keeps what ensembles average.
    """
    chosen = [_named(m) for m in models]
    for m in list(chosen):
        chosen += [c for c in map(_named, m.members) if c.name not in {x.name for x in chosen}]
    columns = {
        f"pred_{m.name}": F.when(F.col("ready"), F.greatest(m.column(F.col("win"), k), F.lit(0.0)))
        for m in chosen if m.column is not None
    }
    result = windows.withColumns(columns) if columns else windows
    for m in chosen:
        if m.model is None:
            continue
        before = result.columns
        scored = m.model.transform(result)
        raw = F.when(F.col("ready"), F.col("prediction") * F.col("scale") + F.col("mu"))
        result = scored.select(*before, raw.alias(f"raw_{m.name}")).withColumn(
            f"pred_{m.name}", F.greatest(F.col(f"raw_{m.name}"), F.lit(0.0)))
    for m in chosen:
        if m.members:
            result = ensemble(result, m.name, [_named(c).name for c in m.members], m.weights)
    return result


def forecasts(series: DataFrame, models: Sequence[str | Forecaster], k: int = K,
              size: int = CHUNK_SIZE) -> DataFrame:
    """Window, predict and pair with the next rate; only steps with a full window and a next rate.

    If the series has a column ``lag``, models fitted with lag windows find theirs.
    """
    windows = with_window(series, k, "lag" in series.columns, following=True, size=size)
    ready = windows.filter(F.col("ready") & F.col("actual").isNotNull())
    return predict_all(ready, models, k).withColumn("current", F.col("rate"))


def sma(series: DataFrame, k: int = K, size: int = CHUNK_SIZE) -> DataFrame:
    """Column ``pred``: mean of the last ``k`` rates, null until there are ``k``."""
    return predict_all(with_window(series, k, size=size), ["sma"], k).withColumnRenamed(
        "pred_sma", "pred").drop("win", "mu", "scale", "ready")


def ema(series: DataFrame, alpha: float = 0.3, k: int = K, size: int = CHUNK_SIZE) -> DataFrame:
    """Column ``pred``: exponential average folded over the last ``k`` rates."""
    windows = with_window(series, k, size=size)
    return predict_all(windows, [ema_forecaster("ema", alpha)], k).withColumnRenamed(
        "pred_ema", "pred").drop("win", "mu", "scale", "ready")


def warmup_forecast(windows: DataFrame, model: str = "ema", k: int = K) -> DataFrame:
    """Columns ``pred`` and ``confidence`` where a window that is not full gives its plain mean and
    confidence 0; full ones keep the model's forecast and the given ``confidence`` (1 if absent)."""
    known = F.col("confidence") if "confidence" in windows.columns else F.lit(1.0)
    return windows.withColumns({
        "pred": F.when(F.col("ready"), F.col(f"pred_{model}"))
                 .otherwise(fw.warmup_of(F.col("win"))),
        "confidence": F.when(F.col("ready"), known).otherwise(F.lit(0.0)),
    })


def tune_ema(series: DataFrame, alphas: Sequence[float] = ALPHAS, k: int = K,
             size: int = CHUNK_SIZE) -> DataFrame:
    """Mean absolute error per smoothing factor: rows ``(alpha, mae, is_best)``; the first of equal
    factors is best. All factors are scored in one pass over the windows."""
    models = [ema_forecaster(str(i), a) for i, a in enumerate(alphas)]
    scored = forecasts(series, models, k, size)
    totals = scored.agg(*[
        F.avg(F.abs(F.col(f"pred_{i}") - F.col("actual"))).alias(f"m{i}")
        for i in range(len(alphas))])
    rows = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(a)).alias("alpha"), F.col(f"m{i}").alias("mae"))
        for i, a in enumerate(alphas)])
    best = F.array_min(F.transform(F.col("g"), lambda r: F.struct(r["mae"], r["i"])))["i"]
    return totals.select(rows.alias("g")).select(
        F.explode("g").alias("r"), best.alias("b")
    ).select("r.alpha", "r.mae", (F.col("r.i") == F.col("b")).alias("is_best"))


def weighted_mean(members: Mapping[str, float | Column], known: Sequence[str] = ()) -> Column:
    """Weighted average of the members' forecasts, unbounded ones (``raw_<member>``) where ``known``
    columns have them; only the average is bounded below by 0."""
    def lit(w: float | Column) -> Column:
        return w if isinstance(w, Column) else F.lit(float(w))
    def forecast_of(m: str) -> Column:
        return F.col(f"raw_{m}" if f"raw_{m}" in known else f"pred_{m}")
    terms = [forecast_of(m) * lit(w) for m, w in members.items()]
    weights = [lit(w) for w in members.values()]
    return F.greatest(sum(terms[1:], terms[0]) / sum(weights[1:], weights[0]), F.lit(0.0))


def ensemble(wide: DataFrame, name: str, members: Sequence[str],
             weights: Mapping[str, float] | DataFrame | None = None) -> DataFrame:
    """Add ``pred_<name>``, the weighted mean of the members.

    ``weights`` may be a mapping or a table ``(model, weight)``, a row per model; a member without one
    weighs 1. A table enters as one scalar subquery, so nothing is joined.
    """
    if isinstance(weights, DataFrame):
        table = weights.agg(F.map_from_entries(F.collect_list(F.struct("model", "weight"))).alias("m"))
        known = table.select("m").scalar()
        by_member = {m: F.coalesce(F.try_element_at(known, F.lit(m)), F.lit(1.0)) for m in members}
    else:
        by_member = {m: float((weights or {}).get(m, 1.0)) for m in members}
    return wide.withColumn(f"pred_{name}", weighted_mean(by_member, wide.columns))


# Published ensemble recipes: the recurrent pair, the recommended three, one of each family.
RECURRENT = ("lstm", "gru")
TOP_THREE = ("lstm", "gru", "tide")
FAMILIES = ("tcn", "tide", "attn")


def ensembles(wide: DataFrame, models: Sequence[str], weights: DataFrame | None = None,
              recipes: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Add the ensemble columns that the available models allow.

    ``ens_mean`` averages all models, ``ens_wtd`` weighs them by ``weights`` (from
    :func:`~streampace.operators.score.inverse_error_weights`). ``recipes`` name further ensembles by
    their members; one with fewer than two available members is left out.
    """
    result = ensemble(wide, "ens_mean", models)
    if weights is not None:
        result = ensemble(result, "ens_wtd", models, weights)
    for name, members in (recipes if recipes is not None else named_recipes(models)).items():
        present = [m for m in members if m in models]
        if len(present) >= 2:
            result = ensemble(result, name, present)
    return result


def named_recipes(models: Sequence[str], best_recurrent: str | None = None
                  ) -> dict[str, tuple[str, ...]]:
    """The three fixed-name recipes; ``best_recurrent`` heads the diverse one."""
    head = best_recurrent or next((m for m in RECURRENT if m in models), None)
    return {
        "ens_rnn": RECURRENT,
        "ens_top3": TOP_THREE,
        "ens_diverse": ((head,) if head else ()) + FAMILIES,
    }


def extended(learned: Sequence[Forecaster], validation: DataFrame, ema: str | Forecaster = "ema") -> list[str | Forecaster]:
    """The learned models, the two baselines, and the ensembles of learned models that these allow.

    ``validation(model, mae)`` has a row for each learned model: it weighs ``ens_wtd`` by 1 / MAE and names the best
    recurrent one, which heads ``ens_diverse``. Baselines are members of no ensemble.
    """
    by_name = {m.name: m for m in learned}
    maes = {r.model: r.mae for r in validation.select("model", "mae").collect() if r.model in by_name}
    total = sum(1 / mae for mae in maes.values())
    recurrent = [m for m in RECURRENT if m in by_name]
    best = min(recurrent, key=lambda m: maes.get(m, float("inf")), default=None)
    found: list[str | Forecaster] = [*learned, "sma", ema]
    if learned:
        found += [ensemble_forecaster("ens_mean", list(learned)),
                  ensemble_forecaster("ens_wtd", [by_name[m] for m in maes], {m: 1 / mae / total for m, mae in maes.items()})]
    for name, members in named_recipes(list(by_name), best).items():
        present = [by_name[m] for m in members if m in by_name]
        if len(present) >= 2:
            found.append(ensemble_forecaster(name, present))
    return found


def confidence(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Column ``confidence`` from how far the models' normalised forecasts lie apart."""
    spread = [(F.col(f"pred_{m}") - F.col("mu")) / F.col("scale") for m in models]
    return wide.withColumn("confidence", fw.dispersion_confidence(spread))


def to_long(wide: DataFrame, models: Sequence[str],
            keep: Sequence[str] = ("series_id", "step", "actual", "current")) -> DataFrame:
    """One row per step and model, with columns ``model`` and ``pred``."""
    return wide.unpivot(list(keep), [f"pred_{m}" for m in models], "model", "pred").withColumn(
        "model", F.substring("model", len("pred_") + 1, 1000))


def to_wide(scored: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per step with ``pred_``, ``abserr_`` and ``mape_`` columns per model."""
    columns = []
    for m in models:
        hit = F.col("model") == m
        columns += [F.max(F.when(hit, F.col(src))).alias(f"{out}_{m}")
                    for src, out in (("pred", "pred"), ("abs_err", "abserr"), ("mape", "mape"))]
    return scored.groupBy("series_id", "step", "actual").agg(*columns)
