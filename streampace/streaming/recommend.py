"""Interval recommendations for a live stream.

Two queries follow each other, because Spark allows no arbitrary state after a streaming aggregation:

1. :func:`rate_stream` counts events per stream and time bucket, with partial counts on the map side,
   and writes each closed bucket once to a table (see ``sinks.to_parquet``);
2. :func:`recommend_stream` reads that table as a stream, some files at a time, and keeps the last ``k`` rates, the
   smoothed interval and the count of failures of each stream in its state.

So a hot stream sends one row per bucket into its state, however many events it has.

All closed buckets of a stream that one micro-batch of the first query writes are in one file, so the
second query may read as few files at a trigger as its memory asks for, and still sees a stream in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from streampace.functions.intervals import LIVE, IntervalRule, interval_of
from streampace.functions.windows import ema_rows, mean_rows
from streampace.operators.control import UNSET, Smoothing
from streampace.operators.features import K
from streampace.operators.series import series_key

OUTPUT = ("series_id string, step long, rate double, pred double, confidence double, raw_ms long, "
          "smoothed_ms long, failed_run int, fallback boolean, late_buckets long")
STATE = "last_step long, window array<double>, smoothed long, failed int, late long"
PIECE = 4096      # steps that are forecast at once

Rows = Callable[[np.ndarray], np.ndarray]
#: Live counterparts of the registered forecasters: a matrix of full windows to one forecast each.
LIVE_MODELS: dict[str, Rows] = {"last": lambda rows: rows[:, -1], "sma": mean_rows, "ema": lambda rows: ema_rows(rows, 0.3),
                                "ema_slow": lambda rows: ema_rows(rows, 0.1), "ema_fast": lambda rows: ema_rows(rows, 0.7)}


def rate_stream(events: DataFrame, keys: Sequence[str], bucket_seconds: int, watermark: str | None,
                ts: str = "ts", unit_seconds: float | None = None) -> DataFrame:
    """Closed buckets of a stream: ``(series_id, bucket, rate)`` with ``bucket`` an epoch number.

    ``unit_seconds`` turns counts into rates per that many seconds. ``watermark=None`` keeps the one that
    ``events`` has. The rows of a stream that close together go to one file.
    """
    factor = 1.0 if unit_seconds is None else unit_seconds / bucket_seconds
    timed = events.withWatermark(ts, watermark) if watermark else events
    counted = (
        timed.groupBy(series_key(keys).alias("series_id"),
                      F.window(ts, f"{bucket_seconds} seconds").alias("w"))
        .agg((F.count(F.lit(1)).cast("double") * factor).alias("rate"))
    )
    return counted.select(
        "series_id", F.floor(F.unix_seconds("w.start") / bucket_seconds).alias("bucket"), "rate"
    ).repartition("series_id")


def _confidence(forecasts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """1 / (1 + 10 s), to six digits, where s is the deviation of the normalised forecasts (a row each)."""
    spread = np.sqrt(np.mean((forecasts - forecasts.mean(0)) ** 2, 0)) / scale
    return np.round(np.clip(1.0 / (1.0 + spread * 10), 0.0, 1.0), 6)


class Pacer:
    """The state of one stream and what a run of steps makes of it."""

    def __init__(self, state: tuple | None, models: Sequence[Rows], chosen: int, k: int, rule: IntervalRule,
                 smoothing: Smoothing, recovers: bool):
        self.last, window, self.smoothed, self.failed, self.late = state or (None, [], UNSET, 0, 0)
        self.window = np.array(window, dtype=float)
        self.models, self.chosen, self.k = models, chosen, k
        self.rule, self.smoothing, self.recovers = rule, smoothing, recovers

    def state(self) -> tuple:
        return self.last, self.window.tolist(), self.smoothed, self.failed, self.late

    def forecast(self, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forecast and confidence after each of the rates; a window that is not full gives its mean and 0."""
        known = np.concatenate([self.window, rates])
        before = len(self.window)
        self.window = known[-self.k:]
        pred, confidence = np.empty(len(rates)), np.zeros(len(rates))
        full = max(0, min(len(rates), self.k - 1 - before))
        for i in range(full):
            pred[i] = mean_rows(known[None, :before + i + 1])[0]
        if full < len(rates):
            rows = np.lib.stride_tricks.sliding_window_view(known[max(0, before + full + 1 - self.k):], self.k)
            each = np.stack([m(rows) for m in self.models])
            mu, sd = rows.mean(1), rows.std(1)
            pred[full:] = np.maximum(each[self.chosen], 0.0)
            confidence[full:] = _confidence(np.maximum(each, 0.0), np.maximum(sd, mu * 0.05) + 1e-8)
        return pred, confidence

    def advance(self, steps: np.ndarray, rates: np.ndarray) -> pd.DataFrame:
        """Recommendations for consecutive steps; a rate that is not a number is a failed measurement."""
        good = ~np.isnan(rates)
        pred, confidence = np.full(len(rates), np.nan), np.zeros(len(rates))
        pred[good], confidence[good] = self.forecast(rates[good])
        raw: list[int | None] = []
        smoothed, failed = [], []
        for ok, p, c in zip(good.tolist(), pred.tolist(), confidence.tolist(), strict=True):
            target = interval_of(p, c, self.rule) if ok else None
            self.failed = 0 if ok else self.failed + 1
            if ok:
                self.smoothed = self.smoothing.step(self.smoothed, target)
            elif self.smoothing.falls_back(self.failed, self.recovers):
                self.smoothed = self.smoothing.fallback_ms
            raw.append(target)
            smoothed.append(self.smoothed)
            failed.append(self.failed)
        self.last = int(steps[-1])
        number = lambda values: pd.array([None if v != v else v for v in values], dtype="Float64")
        return pd.DataFrame({
            "step": steps, "rate": number(rates), "pred": number(pred), "confidence": confidence,
            "raw_ms": pd.array(raw, dtype="Int64"), "smoothed_ms": smoothed, "failed_run": np.array(failed, dtype=np.int32),
            "fallback": np.array(failed) >= self.smoothing.failures, "late_buckets": self.late})


def recommend_stream(rates: DataFrame, bucket_seconds: int, model: str = "ema", spread: Sequence[str] = tuple(LIVE_MODELS),
                     models: dict[str, Rows] = LIVE_MODELS, k: int = K, rule: IntervalRule = LIVE,
                     smoothing: Smoothing = Smoothing(), recovers: bool = True, expire_buckets: int = 24 * 30,
                     delay_buckets: int | None = None) -> DataFrame:
    """Forecast, confidence, interval and smoothed interval for every bucket of every stream, in append mode.

    ``rates`` streams the table written from :func:`rate_stream`. ``model`` sets the interval; its confidence is the
    agreement of the forecasts of ``spread``. Until the window is full the forecast is its mean, with confidence 0.

    Buckets without events are rates of 0, made from the bucket numbers, since an empty micro-batch calls no
    function. A null rate is a failed measurement: it gives no forecast, leaves the window alone and keeps the interval,
    and the third one in a row falls back, as in :func:`~streampace.operators.control.smooth_intervals`.
    A bucket that was already passed is ignored and counted in ``late_buckets``.

    A stream that is silent for ``expire_buckets`` loses its state when the watermark, ``delay_buckets`` (by default as
    many) behind the newest bucket of all streams, has passed that time; if it comes back later it begins anew, whether
    the timer came first or not. So no gap is filled with more zeros than that.
    """
    if model not in spread:
        raise ValueError("the confidence of a model needs it among the forecasters of the spread")
    chosen, used = list(spread).index(model), [models[s] for s in spread]
    delay = (expire_buckets if delay_buckets is None else delay_buckets) * bucket_seconds
    timed = rates.select("series_id", "bucket", "rate", F.timestamp_seconds((F.col("bucket") + 1) * bucket_seconds).alias(
        "closed_at")).withWatermark("closed_at", f"{delay} seconds")

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fresh = lambda kept: Pacer(kept, used, chosen, k, rule, smoothing, recovers)
        pacer = fresh(state.get if state.exists else None)
        seen = pd.concat([f[["bucket", "rate"]] for f in frames]).sort_values("bucket")
        buckets, values = seen["bucket"].to_numpy(), seen["rate"].to_numpy(dtype=float, na_value=np.nan)
        if pacer.last is not None:
            pacer.late += int((buckets <= pacer.last).sum())
        at = 0
        while at < len(buckets):
            if pacer.last is not None and buckets[at] <= pacer.last:
                at += 1
                continue
            if pacer.last is not None and buckets[at] - pacer.last > expire_buckets:
                pacer = fresh((None, [], UNSET, 0, pacer.late))
            # As many buckets, with the zeros between them, as fit into one piece.
            start = int(buckets[at]) if pacer.last is None else pacer.last + 1
            room = buckets[at:] < start + PIECE
            near = np.diff(buckets[at:], prepend=buckets[at]) <= expire_buckets
            stop = at + int(np.argmin(room & near)) if not (room & near).all() else len(buckets)
            end = int(buckets[stop - 1]) if stop > at else start + PIECE - 1
            steps = np.arange(start, end + 1)
            run = np.zeros(len(steps))
            run[buckets[at:stop] - start] = values[at:stop]
            yield pacer.advance(steps, run).assign(series_id=key[0])
            at = stop
        if pacer.last is None:
            return
        state.update(pacer.state())
        silent = (pacer.last + 1 + expire_buckets) * bucket_seconds * 1000
        state.setTimeoutTimestamp(max(silent, state.getCurrentWatermarkMs() + 1))

    return timed.groupBy("series_id").applyInPandasWithState(
        advance, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
