"""Forecast errors, reports and rankings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streampace.functions import rates
from streampace.plans import chunks
from streampace.plans.chunks import CHUNK_SIZE
from streampace.plans.quantiles import exact_quantiles
from streampace.session import ship


def score(predictions: DataFrame, ties: str = "two_way") -> DataFrame:
    """Add ``abs_err``, ``mape`` and ``dir_ok`` to long predictions with ``actual`` and ``current``."""
    error = F.abs(F.col("pred") - F.col("actual"))
    return predictions.withColumns({
        "abs_err": error,
        "mape": rates.percentage_error(error, F.col("actual")),
        "dir_ok": rates.same_direction(
            F.col("pred"), F.col("actual"), F.col("current"), ties).cast("int"),
    })


def with_actual(predictions: DataFrame, series: DataFrame) -> DataFrame:
    """Pair stored predictions, made at ``step``, with the rate one step later."""
    outcome = series.select(
        "series_id", (F.col("step") - 1).alias("step"), F.col("rate").alias("actual"))
    return predictions.join(outcome, ["series_id", "step"])


def error_report(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """MAE, RMSE, MAPE, direction accuracy and count per group.

    An idle step (``actual`` 0) makes MAPE huge; ``mape_active`` is the mean over the other steps.
    """
    return scored.groupBy(*by).agg(
        F.avg("abs_err").alias("mae"),
        F.sqrt(F.avg(F.col("abs_err") * F.col("abs_err"))).alias("rmse"),
        F.avg("mape").alias("mape"),
        F.avg(F.when(F.col("actual") > 0, F.col("mape"))).alias("mape_active"),
        (F.avg("dir_ok") * 100).alias("dir_acc"),
        F.count(F.lit(1)).alias("n"),
    )


def error_quantiles(scored: DataFrame, by: Sequence[str] = ("model", "regime")) -> DataFrame:
    """MAE, median and 95th percentile of the absolute error per group."""
    return exact_quantiles(
        scored, list(by), "abs_err", {"median": 0.5, "p95": 0.95},
        {"mae": "mean", "n": "count"})


def by_regime(scored: DataFrame) -> DataFrame:
    """One row per step, model and regime tag (see ``with_regime``)."""
    return scored.withColumn("regime", F.explode("regimes")).drop("regimes")


def lift_vs(report: DataFrame, baseline: str, by: Sequence[str] = (),
            out: str = "lift_pct") -> DataFrame:
    """How much smaller the MAE is than the baseline model's, in percent, within each ``by`` group.

    Reports have one row per model and group, so a group's window is as small as the model list.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    base = F.max(F.when(F.col("model") == baseline, F.col("mae"))).over(group)
    return report.withColumn(out, (1 - F.col("mae") / base) * 100)


def shape_matrix(scored: DataFrame, models: Sequence[str]) -> DataFrame:
    """MAE per shape of the target step, one column per model."""
    return scored.groupBy("shape").agg(*[
        F.avg(F.when(F.col("model") == m, F.col("abs_err"))).alias(f"mae_{m}") for m in models])


def rolling_report(scored: DataFrame, n: int = 50, size: int = CHUNK_SIZE) -> DataFrame:
    """Trailing MAE and direction accuracy over the last ``n`` scored steps of a series and model."""
    keys = ("model", "series_id")
    frame = chunks.in_chunk(keys).rowsBetween(-(n - 1), 0)
    halo = chunks.with_halo(scored, before=n - 1, size=size)
    return chunks.trim(halo.withColumns({
        "rolling_mae": F.avg("abs_err").over(frame),
        "rolling_dir_acc": F.avg("dir_ok").over(frame) * 100,
    }), size)


def _newest(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the rows of a task, the last ``n`` of each model."""
    order = [("series_id", "descending"), ("step", "descending")]

    def top(rows: pa.Table) -> pa.Array:
        if rows["series_id"].null_count or rows["step"].null_count:     # which a selection would leave out
            return pc.sort_indices(rows, order, null_placement="at_end")[:n]
        return pc.select_k_unstable(rows, n, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str | None, pa.Table] = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for model in rows["model"].unique():
                its = pc.is_null(rows["model"]) if model.as_py() is None else pc.equal(rows["model"], model)
                name, part = model.as_py(), rows.filter(pc.fill_null(its, False))
                both = pa.concat_tables([kept[name], part]) if name in kept else part
                # The rows are taken together so that no kept row holds on to its batch.
                kept[name] = both.take(top(both)).combine_chunks()
        for part in kept.values():
            yield from part.to_batches()
    return run


def rolling_latest(scored: DataFrame, n: int = 50) -> DataFrame:
    """MAE and direction accuracy of each model over its last ``n`` scores of all series, in
    ``(series_id, step)`` order. Nothing is sorted as a whole: each task keeps ``n`` rows per model, and only
    these are shuffled."""
    ship(scored.sparkSession)
    rows = scored.select("model", "series_id", "step", "abs_err", "dir_ok")
    newest = Window.partitionBy("model").orderBy(F.desc("series_id"), F.desc("step"))
    last = rows.mapInArrow(_newest(n), rows.schema).withColumn(
        "_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n)
    return last.groupBy("model").agg(
        F.avg("abs_err").alias("mae"), (F.avg("dir_ok") * 100).alias("dir_acc"),
        F.count(F.lit(1)).alias("n"))


def leaderboard(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank models by MAE (name breaks ties) and mark the best one of each group."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    place = F.row_number().over(group.orderBy("mae", "model"))
    return report.withColumn("place", place).withColumn("is_best", F.col("place") == 1)


def top_k(report: DataFrame, k: int = 6, exclude: Sequence[str] = ("sma", "ema"),
          exclude_prefix: str = "ens_") -> DataFrame:
    """The best ``k`` models that are neither baselines nor ensembles."""
    models = report.filter(
        ~F.col("model").isin(*exclude) & ~F.col("model").startswith(exclude_prefix))
    return leaderboard(models).filter(F.col("place") <= k)


def best_of(report: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: the named model with the least MAE; the one named first wins a tie."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("model"))
    return report.filter(place > 0).agg(
        F.min(F.struct("mae", place.alias("place"), "model")).alias("b")
    ).select("b.model", "b.mae").filter(F.col("model").isNotNull())


def inverse_error_weights(report: DataFrame) -> DataFrame:
    """Weights ``(model, weight)`` proportional to 1 / MAE."""
    inverse = 1 / F.col("mae")
    total = F.sum(inverse).over(Window.partitionBy(F.lit(0)))   # a row per model
    return report.select("model", (inverse / total).alias("weight"))


def agreement(live: DataFrame, replay: DataFrame, keys: Sequence[str], value: str,
              tolerance: float = 1e-9) -> DataFrame:
    """Compare two result tables row by row: counts of equal, different and unmatched rows."""
    left = live.select(*keys, F.col(value).alias("_live"), F.lit(True).alias("_in_live"))
    right = replay.select(*keys, F.col(value).alias("_replay"), F.lit(True).alias("_in_replay"))
    both = F.col("_in_live").isNotNull() & F.col("_in_replay").isNotNull()
    near = F.coalesce(F.abs(F.col("_live") - F.col("_replay")) <= tolerance,
                      F.col("_live").isNull() & F.col("_replay").isNull())
    def count(condition):
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))
    return left.join(right, list(keys), "full").agg(
        count(both & near).alias("same"), count(both & ~near).alias("different"),
        count(F.col("_in_replay").isNull()).alias("live_only"),
        count(F.col("_in_live").isNull()).alias("replay_only"))
