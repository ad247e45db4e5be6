"""One query per operator or report, on the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streampace.operators import (
    control, events, features, forecast, huber, lag, learn, policy, progress, score, series,
)
from streampace.sources.progress import progress_frame
from streampace.sources.readers import read_results, replay_events
from streampace.sources.replay import drain, replay_by_time, replay_whole
from streampace.streaming import late, recommend, sinks
from streampace.functions import intervals as fi
from streampace.functions import messages as fm
from streampace.plans.durable import durable
from streampace.session import zoned
from streampace.workloads import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MODELS = (
    "last", "sma", "ema",
    forecast.ema_forecaster("ema_slow", 0.1), forecast.ema_forecaster("ema_fast", 0.7),
)
NAMES = ("last", "sma", "ema", "ema_slow", "ema_fast")
STEADY = ("sma", "ema")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, for comparison with another engine.

    Percentage errors of idle steps are of the order of 1e10, where no engine has six decimals: they
    are rounded to multiples of 100,000.
    """
    def fixed(name: str) -> Column:
        value = F.round(F.col(name), digits)
        if name.startswith("mape"):
            value = F.when(F.col(name) >= 1e5, F.round(F.col(name) / 1e5) * 1e5).otherwise(value)
        return value.alias(name)
    return df.select(*[
        fixed(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def micros(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in columns})


def scored_users(spark: SparkSession, sf: str) -> DataFrame:
    wide = forecast.forecasts(b.hourly_by_user(spark, sf), MODELS)
    return score.score(forecast.to_long(wide, NAMES))


def scored_types(spark: SparkSession, sf: str, models: Sequence = MODELS) -> DataFrame:
    names = [m if isinstance(m, str) else m.name for m in models]
    return score.score(forecast.to_long(forecast.forecasts(b.hourly(spark, sf), models), names))


# Messages and latency ------------------------------------------------------------------------------

@query
def parse_messages(spark, sf):
    parsed = events.parse_messages(b.messages_of(b.events(spark, sf)))
    return rounded(micros(parsed, "ingest_ts", "event_time"))


def _latency(spark, sf, truncate=False):
    return events.with_latency(b.measured(spark, sf), F.col("done_ts"), truncate)


@query
def latency_rows(spark, sf):
    return rounded(events.latency_rows(_latency(spark, sf)))


@query
def latency_rows_truncated(spark, sf):
    return rounded(events.latency_rows(_latency(spark, sf, True)))


@query
def latency_stats_exact(spark, sf):
    return rounded(events.latency_stats(_latency(spark, sf)))


@query
def latency_stats_approx(spark, sf):
    return rounded(events.latency_stats(_latency(spark, sf), exact=False))


@query
def latency_distribution(spark, sf):
    return rounded(events.latency_distribution(_latency(spark, sf)))


@query
def latency_stats_bracketed(spark, sf):
    """The same quantiles by brackets and slots, as for groups that no task can hold."""
    return rounded(events.latency_stats(_latency(spark, sf), small_group=50))


@query
def windowed_count(spark, sf):
    counted = events.windowed_count(b.events(spark, sf), "1 hour", ts="ts")
    return micros(counted, "window_start", "window_end")


@query
def windowed_stats(spark, sf):
    timed = b.measured(spark, sf).withColumn("event_time", fm.event_time(F.col("producer_ts")))
    stats = events.windowed_stats(timed, "15 minutes", watermark=None)
    return rounded(micros(stats, "window_start", "window_end"))


@query
def count_by_phase(spark, sf):
    phased = b.events(spark, sf).withColumn(
        "phase", F.when(F.col("value") > 50, "burst").otherwise("normal"))
    return events.count_by(phased, "phase")


@query
def events_per_mode(spark, sf):
    folder = b.scratch(spark, "modes")
    rows = events.latency_rows(_latency(spark, sf)).withColumn(
        "mode", F.when(F.col("second") < 8, "fixed_500ms").when(F.col("second") < 16, "fixed_2s")
        .otherwise("fixed_5s"))
    # A directory for each mode, as separate benchmark runs would leave them, in one write.
    rows.write.partitionBy("mode").json(folder)
    return events.events_per_mode(read_results(spark, folder))


# Progress logs -------------------------------------------------------------------------------------

@query
def progress_dedup(spark, sf):
    kept = progress.dedup_progress(progress.for_app(b.progress(spark, sf), "front"))
    return rounded(micros(kept, "ts").drop("rows_dropped_by_watermark"))


@query
def progress_first_app(spark, sf):
    return progress.for_app(b.progress(spark, sf)).groupBy("app_name", "run_id").agg(
        F.count(F.lit(1)).alias("reports"))


@query
def burst_flags(spark, sf):
    flagged = progress.burst_flags(progress.dedup_progress(b.progress(spark, sf)), threshold=4)
    return flagged.select("run_id", "batch_id", "num_input_rows", "is_burst")


@query
def idle_series(spark, sf):
    """Batches of every user with an idle report after each that is followed by a quiet hour."""
    log = b.progress_with_idle(spark, sf)
    rates = progress.progress_series(progress.dedup_progress(log))
    return rounded(rates)


@query
def recent_batches(spark, sf):
    kept = progress.dedup_progress(b.progress(spark, sf))
    return rounded(series.recent(progress.progress_series(kept), 30))


@query
def duration_compare(spark, sf):
    kept = progress.dedup_progress(b.progress(spark, sf)).withColumnRenamed("run_id", "mode")
    return rounded(progress.compare_modes(progress.duration_summary(kept), "click"))


# Series --------------------------------------------------------------------------------------------

@query
def rate_series(spark, sf):
    return b.hourly_by_user(spark, sf)


@query
def rate_series_orders(spark, sf):
    return b.daily_orders(spark, sf)


@query
def rate_summary(spark, sf):
    return rounded(series.rate_summary(b.hourly_by_user(spark, sf)))


@query
def regimes(spark, sf):
    tagged = series.with_regime(b.trace(spark, sf), 200.0, 50.0)
    return tagged.select("series_id", "step", F.explode("regimes").alias("regime"))


@query
def label_steps(spark, sf):
    rates = b.hourly(spark, sf)
    return series.label_steps(rates, b.labels(rates))


@query
def asof_schedule(spark, sf):
    start = b.events(spark, sf).agg(F.min("ts").alias("t")).select("t").scalar()
    elapsed = (F.unix_micros("ts") - F.unix_micros(start)) / 3_600_000_000
    ticks = b.events(spark, sf).select("event_id", (elapsed % 120).alias("elapsed"))
    return rounded(series.asof_schedule(ticks, b.SCHEDULE))


@query
def asof_schedule_table(spark, sf):
    """The schedule is itself a table: hourly event counts, looked up for every order of magnitude
    of delay of each event."""
    start = b.events(spark, sf).agg(F.min("ts").alias("t")).select("t").scalar()
    seconds = (F.unix_micros("ts") - F.unix_micros(start)) / 1e6
    ticks = b.events(spark, sf).select("event_id", seconds.alias("elapsed"))
    busy = b.hourly(spark, sf).groupBy("step").agg(F.sum("rate").alias("target")).filter(
        F.col("target") > 15).select((F.col("step") * 3600 + 1800).alias("start"), "target")
    return rounded(series.asof_schedule(ticks, busy))


@query
def cap_series(spark, sf):
    return rounded(series.cap_series(series.floor_rate(b.trace(spark, sf)), 400.0))


@query
def split_series(spark, sf):
    return b.split_users(spark, sf).groupBy("split", "series_id").agg(
        F.count(F.lit(1)).alias("steps"))


# Features ------------------------------------------------------------------------------------------

@query
def window_norm(spark, sf):
    windows = features.with_norm(features.with_window(b.hourly(spark, sf)))
    return rounded(windows.select(
        "series_id", "step", "ready", "mu", "scale", F.posexplode("norm").alias("pos", "x")))


@query
def window_norm_chunked(spark, sf):
    """The same windows over chunks of 64 steps, as for series that no task can hold."""
    windows = features.with_norm(features.with_window(b.hourly(spark, sf), size=64))
    return rounded(windows.select(
        "series_id", "step", "ready", "mu", "scale", F.posexplode("norm").alias("pos", "x")))


@query
def warmup(spark, sf):
    windows = forecast.predict_all(features.with_window(b.hourly_by_user(spark, sf)), ["ema"])
    return rounded(forecast.warmup_forecast(windows).select(
        "series_id", "step", "pred", "confidence"))


def _lagged(spark, sf):
    return lag.with_rolling_lag(b.hourly(spark, sf))


@query
def lag_constant(spark, sf):
    return rounded(lag.with_lag(b.hourly(spark, sf), 2.3))


@query
def lag_rolling(spark, sf):
    return rounded(_lagged(spark, sf))


@query
def lag_rolling_chunked(spark, sf):
    return rounded(lag.with_rolling_lag(b.hourly(spark, sf), size=64))


@query
def lag_rolling_draining(spark, sf):
    return rounded(lag.with_rolling_lag(b.hourly(spark, sf), hold_idle=False))


@query
def lag_norm(spark, sf):
    windows = features.with_lag_norm(features.with_window(
        lag.with_lag(b.hourly(spark, sf), 2.3), lag=True).filter("ready"))
    return rounded(windows.select(
        "series_id", "step", F.posexplode("lag_norm").alias("pos", "x")))


@query
def supervised_windows(spark, sf):
    samples = features.supervised(b.split_users(spark, sf))
    # Bound as a lambda variable, so that the features of a row are made once.
    summary = F.transform(F.array("features"), lambda x: F.struct(
        F.element_at(x, 1).alias("oldest"), F.element_at(x, -1).alias("newest"),
        F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v).alias("power")))
    return rounded(samples.select(
        "series_id", "step", "split", "label", "mu", "scale", F.inline(summary)))


@query
def supervised_lag(spark, sf):
    """Training samples with the consumer lag beside the rate."""
    samples = features.supervised(lag.with_lag(b.hourly(spark, sf), 2.3), use_lag=True)
    ends = F.transform(F.array("features"), lambda x: F.struct(
        F.element_at(x, 1)["rate"].alias("oldest_rate"), F.element_at(x, -1)["rate"].alias("newest_rate"),
        F.element_at(x, 1)["lag"].alias("oldest_lag"), F.element_at(x, -1)["lag"].alias("newest_lag")))
    return rounded(samples.select("series_id", "step", "label", F.inline(ends)))


@query
def trend_residual(spark, sf):
    windows = features.with_norm(features.with_window(b.hourly(spark, sf)).filter("ready"))
    parts = features.trend_residual(windows)
    return rounded(parts.select(
        "series_id", "step",
        F.posexplode(F.arrays_zip("trend", "residual")).alias("pos", "p")
    ).select("series_id", "step", "pos", "p.trend", "p.residual"))


@query
def spectral(spark, sf):
    windows = features.with_norm(features.with_window(b.hourly(spark, sf)).filter("ready"))
    return rounded(features.spectral(windows).select(
        "series_id", "step", F.posexplode("spectrum").alias("pos", "x")))


# Forecasts -----------------------------------------------------------------------------------------

@query
def sma(spark, sf):
    return rounded(forecast.sma(b.hourly_by_user(spark, sf)))


@query
def ema(spark, sf):
    return rounded(forecast.ema(b.hourly_by_user(spark, sf), 0.3))


@query
def tune_ema(spark, sf):
    validation = b.split_users(spark, sf).filter(F.col("split") == "val")
    return rounded(forecast.tune_ema(validation))


def _validation(split: DataFrame) -> DataFrame:
    rows = split.filter(F.col("split") == "val")
    return score.error_report(score.score(
        forecast.to_long(forecast.forecasts(rows, MODELS), NAMES)))


@query
def ensemble_recipes(spark, sf):
    """Every model and ensemble on the test series; weights come from the validation series."""
    split = b.split_users(spark, sf)
    weights = durable(score.inverse_error_weights(_validation(split)))
    wide = forecast.ensembles(
        forecast.forecasts(split.filter(F.col("split") == "test"), MODELS), NAMES, weights,
        {"ens_pair": ("ema", "ema_fast"), "ens_top3": ("sma", "ema", "ema_slow"),
         "ens_absent": ("sma", "unknown")})
    names = [*NAMES, "ens_mean", "ens_wtd", "ens_pair", "ens_top3"]
    report = score.error_report(score.score(forecast.to_long(wide, names)))
    return rounded(report)


@query
def tuned_ema_report(spark, sf):
    """The average tuned on the validation series, on the test series beside the fixed one."""
    split = durable(b.split_users(spark, sf))
    tuned = forecast.tuned_ema(split.filter(F.col("split") == "val"), "ema_tuned")
    wide = forecast.forecasts(split.filter(F.col("split") == "test"), ["ema", tuned])
    return rounded(score.error_report(score.score(forecast.to_long(wide, ["ema", "ema_tuned"]))))


@query
def ensemble_weights(spark, sf):
    return rounded(score.inverse_error_weights(_validation(b.split_users(spark, sf))))


@query
def best_of_family(spark, sf):
    return rounded(score.best_of(_validation(b.split_users(spark, sf)), STEADY))


@query
def confidence(spark, sf):
    wide = forecast.forecasts(b.hourly(spark, sf), MODELS)
    return rounded(forecast.confidence(wide, NAMES).select("series_id", "step", "confidence"))


# Error reports -------------------------------------------------------------------------------------

@query
def ema_error_report(spark, sf):
    """Flagship: events to hourly user series to forecasts to ranked errors."""
    return rounded(score.leaderboard(score.error_report(scored_users(spark, sf))))


@query
def error_report_all(spark, sf):
    return rounded(score.error_report(scored_users(spark, sf)))


@query
def error_quantiles_by_regime(spark, sf):
    tagged = series.with_regime(b.trace(spark, sf))
    wide = forecast.forecasts(tagged, MODELS)
    long = forecast.to_long(wide, NAMES, ("series_id", "step", "regimes", "actual", "current"))
    report = score.error_quantiles(score.by_regime(score.score(long)))
    return rounded(score.lift_vs(report, "ema", ["regime"]))


@query
def shape_error_matrix(spark, sf):
    rates = b.hourly(spark, sf)
    shaped = series.with_next(series.label_steps(rates, b.labels(rates)), "shape", "next_shape")
    wide = forecast.forecasts(shaped, MODELS).withColumn("shape", F.col("next_shape"))
    long = forecast.to_long(wide, NAMES, ("series_id", "step", "shape", "actual", "current"))
    return rounded(score.shape_matrix(score.score(long), NAMES), 9)


@query
def rolling_report(spark, sf):
    rolled = score.rolling_report(scored_types(spark, sf))
    return rounded(rolled.select(
        "model", "series_id", "step", "rolling_mae", "rolling_dir_acc"))


@query
def rolling_report_chunked(spark, sf):
    rolled = score.rolling_report(scored_types(spark, sf), size=64)
    return rounded(rolled.select("model", "series_id", "step", "rolling_mae", "rolling_dir_acc"))


@query
def rolling_latest(spark, sf):
    return rounded(score.rolling_latest(scored_users(spark, sf)))


@query
def top_neural(spark, sf):
    """The best two models once the baselines are left out."""
    report = score.error_report(scored_types(spark, sf))
    return rounded(score.top_k(report, 2, exclude=STEADY))


@query
def predictions_wide(spark, sf):
    return rounded(forecast.to_wide(scored_types(spark, sf), NAMES))


@query
def predictions_csv(spark, sf):
    """The wide report written as CSV and read back."""
    folder = b.scratch(spark, "csv")
    sinks.write_predictions_csv(scored_types(spark, sf), folder, NAMES)
    return rounded(spark.read.csv(folder, header=True, inferSchema=True).withColumn("step", F.col("step").cast("long")))


@query
def summary_csv(spark, sf):
    """A run per event type: seconds it spans, whether it had errors, and its events, as CSV."""
    folder = b.scratch(spark, "csv")
    seconds = F.unix_micros("ts") / 1e6
    runs = b.events(spark, sf).groupBy(F.col("event_type").alias("approach")).agg(
        F.round(F.max(seconds) - F.min(seconds), 3).alias("elapsed_sec"),
        F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("exit_code"), F.count(F.lit(1)).alias("stdout_lines"))
    sinks.write_summary_csv(runs, folder)
    return spark.read.csv(folder, header=True, schema="approach string, elapsed_sec double, exit_code int, stdout_lines long")


@query
def stored_predictions(spark, sf):
    """Predictions without outcomes, joined to the series afterwards."""
    rates = b.hourly_by_user(spark, sf)
    made = forecast.ema(rates).filter(F.col("pred").isNotNull()).withColumnRenamed("rate", "current")
    paired = score.with_actual(made, rates).withColumn("model", F.lit("ema"))
    return rounded(score.error_report(score.score(paired, "three_way")))


# Learned forecasters -------------------------------------------------------------------------------

def _learned(spark, sf, fit):
    """Fit on the train series, report on the test series. The coefficients of a fit are no engine's
    to repeat, so of the learned model only its sanity is shown: as many forecasts as the average has,
    all finite and not negative, with at most twice its error."""
    split = durable(b.split_users(spark, sf))
    model = fit(learn.samples(split.filter(F.col("split") == "train")))
    wide = forecast.forecasts(split.filter(F.col("split") == "test"), [model, "ema"])
    scored = score.score(forecast.to_long(wide, [model.name, "ema"]))
    report = scored.groupBy("model").agg(
        F.avg("abs_err").alias("mae"), F.count(F.lit(1)).alias("n"),
        F.bool_and((F.col("pred") >= 0) & (F.col("pred") < float("inf"))).alias("sound"))
    lift = score.lift_vs(report, "ema")
    ema = F.col("model") == "ema"
    return rounded(lift.select("model", "n", F.when(ema, F.col("mae")).alias("mae"),
                               (F.col("sound") & (F.col("lift_pct") >= -100)).alias("sound")))


@query
def huber_sums(spark, sf):
    """Weighted normal equations of the first round of a Huber fit to the train series: window rates, constant, label."""
    rows = learn.samples(b.split_users(spark, sf).filter(F.col("split") == "train"))
    sums = huber.normal_sums(rows.withColumnRenamed("norm", "features"), np.zeros(features.K + 1))
    return rounded(sums, 3)


@query
def trend_linear(spark, sf):
    return _learned(spark, sf, learn.fit_trend_linear)


@query
def extended_models(spark, sf):
    """Learned models, baselines and ensembles of the learned ones on the test series. The errors of a fit are no engine's
    to repeat, so of ensembles it is shown that they are their members' weighted means, in every row."""
    split = durable(b.split_users(spark, sf))
    train = learn.stored(learn.samples(split.filter(F.col("split") == "train")))
    fitted = [learn.fit_trend_linear(train, "tide"), learn.fit_spectral(train, "tcn"),
              learn.fit_trend_linear(train, "gru", delta=0.2)]
    names = [m.name for m in fitted]
    held = forecast.forecasts(split.filter(F.col("split") == "val"), fitted)
    report = durable(score.error_report(score.score(forecast.to_long(held, names))))
    models = forecast.extended(fitted, report, "ema")
    everyone = [m if isinstance(m, str) else m.name for m in models]
    wide = forecast.forecasts(split.filter(F.col("split") == "test"), models)
    weights = {r.model: 1 / r.mae for r in report.collect()}
    mean = lambda w: F.greatest(sum((F.col(f"raw_{m}") * x for m, x in w.items()), F.lit(0.0)) / sum(w.values()), F.lit(0.0))
    want = {"ens_mean": mean(dict.fromkeys(names, 1.0)), "ens_wtd": mean(weights), "ens_top3": mean({"gru": 1.0, "tide": 1.0}),
            "ens_diverse": mean({"gru": 1.0, "tcn": 1.0, "tide": 1.0})}
    close = [F.bool_and(F.abs(F.col(f"pred_{m}") - want[m]) <= 1e-9 * (1 + want[m]) if m in want else F.col(f"pred_{m}") >= 0)
             .alias(m) for m in everyone]
    errors = [F.avg(F.abs(F.col(f"pred_{m}") - F.col("actual"))).alias(f"mae_{m}") for m in ("sma", "ema")]
    whole = wide.agg(F.count(F.lit(1)).alias("n"), *close, *errors)
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("sound"), (
        F.col(f"mae_{m}") if m in ("sma", "ema") else F.lit(None).cast("double")).alias("mae")) for m in everyone])
    return rounded(whole.select("n", F.inline(rows)))


@query
def stored_model(spark, sf):
    """A fitted model written, read back and used."""
    def fit(rows):
        folder = b.scratch(spark, "models")
        learn.save_models([learn.fit_trend_linear(rows, "stored_model")], folder)
        return learn.load_models(folder, ["stored_model"], missing="fail")["stored_model"]
    return _learned(spark, sf, fit)


@query
def spectral_linear(spark, sf):
    return _learned(spark, sf, learn.fit_spectral)


@query
def window_trees(spark, sf):
    return _learned(spark, sf, learn.fit_window_trees)


# Intervals -----------------------------------------------------------------------------------------

def _recommended(spark, sf):
    """EMA forecasts of the traces with their dispersion confidence and live interval."""
    wide = forecast.confidence(forecast.forecasts(b.trace(spark, sf), MODELS), NAMES)
    return control.with_interval(wide.select(
        "series_id", (F.col("step") - (features.K - 1)).alias("step"), "rate",
        F.col("pred_ema").alias("pred"), F.round("confidence", 6).alias("confidence")), "pred", "confidence")


@query
def interval_agent(spark, sf):
    rates = b.trace(spark, sf).withColumn("conf", F.least(F.col("rate") / 240.0, F.lit(1.0)))
    out = control.with_interval(rates, "rate", "conf")
    return rounded(out.withColumn("effective_ms", control.effective_interval(
        F.when(F.col("rate") > 0, F.col("raw_ms")).otherwise(F.lit(-1)), F.lit(1000))))


@query
def interval_backtest(spark, sf):
    return rounded(control.with_interval(b.trace(spark, sf), "rate", rule=fi.BACKTEST))


@query
def smoothed_intervals(spark, sf):
    smoothed = control.smooth_intervals(control.with_interval(b.trace(spark, sf), "rate"))
    return smoothed.withColumn("large_change", F.abs(F.col("raw_ms") - F.col("smoothed_ms")) > 100)


@query
def smoothed_intervals_chunked(spark, sf):
    smoothed = control.smooth_intervals(control.with_interval(b.trace(spark, sf), "rate"), size=64)
    return smoothed.withColumn("large_change", F.abs(F.col("raw_ms") - F.col("smoothed_ms")) > 100)


@query
def interval_changes(spark, sf):
    smoothed = control.smooth_intervals(control.with_interval(b.trace(spark, sf), "rate"))
    return control.interval_changes(smoothed).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("changes"))


def _failing(spark, sf):
    """Forecasts fail in hours of at most two events."""
    raw = control.with_interval(b.trace(spark, sf), "rate")
    return raw.withColumn("raw_ms", F.when(F.col("rate") > 2 * b.TRACE_SCALE, F.col("raw_ms")))


@query
def fallback_intervals(spark, sf):
    return control.smooth_intervals(_failing(spark, sf), failures=True)


@query
def fallback_intervals_chunked(spark, sf):
    return control.smooth_intervals(_failing(spark, sf), failures=True, size=64)


@query
def fallback_intervals_stuck(spark, sf):
    return control.smooth_intervals(_failing(spark, sf), failures=True, recovers=False)


@query
def fallback_rate(spark, sf):
    return rounded(control.fallback_rate(
        control.smooth_intervals(_failing(spark, sf), failures=True)))


@query
def convergence(spark, sf):
    """Cycles until the smoothed interval is near eight seconds."""
    smoothed = control.smooth_intervals(_recommended(spark, sf))
    return control.convergence(smoothed.withColumn("goal", F.lit(8000)), "goal")


# Trigger policies ----------------------------------------------------------------------------------

@query
def policy_fixed(spark, sf):
    batches = policy.fixed_batches(b.trace(spark, sf), policy.FIXED_INTERVALS_MS)
    return rounded(policy.policy_metrics(batches))


@query
def policy_fixed_many(spark, sf):
    """All users' traces; a policy too slow to fire within a trace still gets its row."""
    users = b.hourly_by_user(spark, sf)
    intervals = (1000, 100_000)
    expected = b.user_ids(spark, sf).withColumn("policy", F.explode(F.array(
        *[F.lit(f"fixed_{ms}ms") for ms in intervals])))
    metrics = policy.policy_metrics(policy.fixed_batches(users, intervals), expected=expected)
    return rounded(metrics)


@query
def policy_adaptive_ema(spark, sf):
    return rounded(policy.adaptive_batches(b.trace(spark, sf), "ema"))


@query
def policy_reactive(spark, sf):
    return rounded(policy.reactive_batches(b.trace(spark, sf)))


@query
def policy_compare(spark, sf):
    return rounded(policy.compare_policies(b.trace(spark, sf), ("ema", "sma")))


ENS_TOP3 = forecast.ensemble_forecaster("ens_top3", ("sma", "ema", MODELS[3]))


@query
def policy_compare_ensemble(spark, sf):
    """An ensemble sets the intervals as any model does."""
    return rounded(policy.compare_policies(b.trace(spark, sf), ("ema", ENS_TOP3)))


@query
def policy_adaptive_tuned(spark, sf):
    """The average tuned on the traces sets the intervals."""
    trace = durable(b.trace(spark, sf), "trace")
    return rounded(policy.adaptive_batches(trace, forecast.tuned_ema(trace, "ema_tuned")))


@query
def policy_compare_chunked(spark, sf):
    return rounded(policy.compare_policies(b.trace(spark, sf), ("ema", "sma"), size=400))


# Streams -------------------------------------------------------------------------------------------

def _replay(spark, sf):
    return zoned(replay_events(spark, f"{sf}/events*.parquet"))


def _finish(stream: DataFrame, spark: SparkSession, name: str, fmt: str = "parquet", trigger: str | None = "available") -> str:
    folder = b.scratch(spark, name)
    start = sinks.to_json if fmt == "json" else sinks.to_parquet
    query = start(stream, f"{folder}/out", f"{folder}/checkpoint", trigger)
    if trigger is None:
        drain(query)
    else:
        query.awaitTermination()
    return f"{folder}/out"


@query
def stream_windowed_stats(spark, sf):
    """The whole recording at one trigger; the closing mark closes the last window."""
    recorded = replay_whole(spark, f"{sf}/events*.parquet", "ts", "5 seconds", 2 * b.HOUR, ["ts", "props"])
    timed = recorded.select(
        F.col("ts").alias("event_time"),
        F.get_json_object("props", "$.k").cast("int").alias("rate_target"))
    stats = events.windowed_stats(timed, "1 hour", watermark=None)
    done = spark.read.parquet(_finish(stats, spark, "stats"))
    return rounded(micros(done, "window_start", "window_end"))


@query
def running_latency(spark, sf):
    """Sketches of daily windows, stored as they close and merged over the recording."""
    recorded = replay_by_time(spark, f"{sf}/events.parquet", "ts", "5 seconds", 15 * b.DAY, 2 * b.DAY, ["ts", "value", "props"])
    measured = recorded.select(
        F.col("ts").alias("event_time"), F.get_json_object("props", "$.k").cast("int").alias("rate_target"),
        fm.latency_ms(b.done_at(F.col("ts"), F.col("value")), fm.epoch_seconds(F.col("ts"))).alias("e2e_latency_ms"))
    stored = spark.read.parquet(_finish(events.latency_sketches(measured, "1 day"), spark, "sketches", trigger=None))
    return rounded(events.merged_latency(stored))


@query
def stream_event_table(spark, sf):
    """Messages as an event-time table, written by a stream."""
    parsed = events.event_table(b.messages_of(_replay(spark, sf)).drop("process_ts"))
    return rounded(micros(spark.read.parquet(_finish(parsed, spark, "event-table")), "ingest_ts", "event_time"))


@query
def late_reconciled(spark, sf):
    """Files that hold rows of all times come one by one, so most rows are late: with them every window is whole."""
    folder = b.scratch(spark, "scattered")
    table = b.events(spark, sf).select("event_id", "ts")
    for part in range(3):
        table.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    # A closing row moves the watermark past the last window; its filter names the event time, so it stays behind.
    last = table.agg(F.max(F.unix_micros("ts"))).first()[0]
    spark.range(1).select(F.lit(None).cast(table.schema["event_id"].dataType).alias("event_id"), F.timestamp_micros(
        F.lit(last + 3 * b.HOUR * 1_000_000)).alias("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    stream = lambda: late.accepted(replay_events(spark, f"{folder}/log"), "event_id", "ts", "1 hour")
    counted = events.windowed_count(stream().filter(F.unix_micros("ts") <= last), "1 hour", "ts")
    done = spark.read.parquet(_finish(counted, spark, "counted"))
    in_time = spark.read.parquet(_finish(stream().select("event_id"), spark, "accepted"))
    missed = late.late_rows(table, in_time, "event_id")
    whole = late.reconciled(done, missed, "1 hour", "ts")
    return micros(whole, "window_start", "window_end").select(
        "window_start", "window_end", "events", (F.col("late") <= F.col("events")).alias("within"))


@query
def running_complete(spark, sf):
    """Running statistics in complete mode, as a small table of the driver."""
    rows = _replay(spark, sf).select(
        F.get_json_object("props", "$.k").cast("int").alias("rate_target"),
        fm.latency_ms(b.done_at(F.col("ts"), F.col("value")), fm.epoch_seconds(F.col("ts"))).alias("e2e_latency_ms"))
    name = f"running_{uuid.uuid4().hex}"
    sinks.to_memory(events.latency_stats(rows, exact=False), name, "complete", "available").awaitTermination()
    return rounded(spark.table(name))


@query
def stream_latency_json(spark, sf):
    parsed = events.parse_messages(b.messages_of(_replay(spark, sf)).drop("process_ts"))
    rows = events.latency_rows(events.with_latency(parsed))
    written = spark.read.json(_finish(rows, spark, "latency", "json"))
    return events.count_by(written.filter(F.col("producer_ts").isNotNull()), "rate_target", "second")


@query
def stream_progress_dedup(spark, sf):
    folder = b.scratch(spark, "progress")
    b.progress(spark, sf).repartitionByRange("ts").write.parquet(f"{folder}/log")
    # Files written side by side have no order in time; the replay has.
    log = replay_by_time(spark, f"{folder}/log", "ts", None, 15 * b.DAY)
    kept = progress.dedup_progress_stream(log, within="2 hours")
    done = spark.read.parquet(_finish(kept, spark, "dedup", trigger=None))
    return done.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("num_input_rows").alias("input_rows"))


def _recommendations(spark, sf):
    """Closed hourly buckets are written by one query and read by the stateful one, some files at a time. The measurements
    of the first four hours of each day are lost."""
    recorded = replay_by_time(spark, f"{sf}/events.parquet", "ts", "5 seconds", 15 * b.DAY, 2 * b.HOUR, ["ts", "event_type"])
    rates = recommend.rate_stream(recorded, ["event_type"], b.HOUR, None, unit_seconds=b.TRACE_SCALE * b.HOUR)
    measured = rates.withColumn("rate", F.when(F.col("bucket") % 24 >= 4, F.col("rate")))
    stored = replay_events(spark, _finish(measured, spark, "rates", trigger=None), max_files_per_trigger=8)
    return spark.read.parquet(_finish(recommend.recommend_stream(stored, b.HOUR), spark, "recommend"))


@query
def stream_recommend(spark, sf):
    return rounded(_recommendations(spark, sf))


@query
def stream_agreement(spark, sf):
    """Live recommendations against the batch operators on the same rates."""
    live = durable(_recommendations(spark, sf), "live")
    base = live.agg(F.min("step").alias("s")).select("s").scalar()
    steps = live.withColumn("step", F.col("step") - base)
    known = series.reindexed(steps.filter("rate IS NOT NULL").select(
        "series_id", F.col("step").alias("at"), "rate"), "at")
    wide = forecast.confidence(forecast.predict_all(features.with_window(known), MODELS), NAMES)
    found = forecast.warmup_forecast(wide.withColumn("confidence", F.round("confidence", 6))).select(
        "series_id", F.col("at").alias("step"), "pred", "confidence")
    paced = control.with_interval(found, "pred", "confidence")
    replay = control.smooth_intervals(steps.select("series_id", "step").join(paced, ["series_id", "step"], "left"), failures=True)
    return score.agreement(steps, replay, ["series_id", "step"], "smoothed_ms")


@query
def stream_progress_capture(spark, sf):
    """The progress log of a real replay, read through the same operators as stored logs."""
    folder = b.scratch(spark, "capture")
    counted = _replay(spark, sf).select("event_id", "event_type")
    running = sinks.to_parquet(counted, f"{folder}/out", f"{folder}/checkpoint", "available")
    running.awaitTermination()
    log = progress.dedup_progress(progress_frame(running))
    return log.agg(F.sum("num_input_rows").alias("input_rows"))
