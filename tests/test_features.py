"""Windows, lag and forecasts against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from streampace.operators import features, forecast, lag

K = 6
rng = np.random.default_rng(5)
RATES = {
    "a": rng.integers(0, 300, 40).astype(float), "flat": np.full(31, 7.0), "zeros": np.zeros(20),
    "short": np.array([3.0, 5.0]), "one": np.array([9.0]), "exact": rng.random(K) * 100,
}
SIZES = [8, 1 << 16]


def scale(w):
    return max(w.std(), 0.05 * w.mean()) + 1e-8


@pytest.mark.parametrize("size", SIZES)
def test_windows(make_series, by_series, size):
    df = features.with_norm(features.with_window(
        make_series(RATES), K, following=True, size=size)).cache()
    cols = {c: by_series(df, c) for c in ("win", "mu", "scale", "ready", "norm", "actual")}
    for s, r in RATES.items():
        for t in range(len(r)):
            w = r[max(0, t - K + 1):t + 1]
            assert cols["win"][s][t] == list(w)
            assert cols["mu"][s][t] == pytest.approx(w.mean())
            assert cols["scale"][s][t] == pytest.approx(scale(w), abs=1e-9)
            assert cols["ready"][s][t] == (len(w) == K)
            assert cols["norm"][s][t] == pytest.approx(list((w - w.mean()) / scale(w)), abs=1e-6)
            assert cols["actual"][s][t] == (r[t + 1] if t + 1 < len(r) else None)


def queue(rates, capacity):
    out = [0.0]
    for t in range(1, len(rates)):
        out.append(max(0.0, out[-1] + rates[t] - capacity))
    return out


def rolling_queue(rates, k, hold):
    level, out = 0.0, []
    for t, rate in enumerate(rates):
        if not (hold and rate == 0):
            level = max(0.0, level + rate - 1.2 * np.mean(rates[max(0, t - k + 1):t + 1]))
        out.append(level)
    return out


@pytest.mark.parametrize("size", SIZES)
def test_lag(make_series, by_series, size):
    df = make_series(RATES)
    got = by_series(lag.with_lag(df, 100.0, size=size), "lag")
    for s, r in RATES.items():
        assert got[s] == pytest.approx(queue(r, 120.0), abs=1e-9)
    for hold in (True, False):
        got = by_series(lag.with_rolling_lag(df, K, hold_idle=hold, size=size), "lag")
        for s, r in RATES.items():
            assert got[s] == pytest.approx(rolling_queue(r, K, hold), abs=1e-9)


@pytest.mark.parametrize("size", SIZES)
def test_supervised(make_series, size):
    df = lag.with_lag(make_series(RATES), 100.0)
    rows = features.supervised(df, K, use_lag=True, size=size).collect()
    assert len(rows) == sum(max(0, len(r) - K) for r in RATES.values())
    for row in rows:
        r, j = RATES[row["series_id"]], row["step"]
        w, q = r[j - K:j], np.array(queue(r, 120.0))[j - K:j]
        norm_lag = np.zeros(K) if q.std() < 1e-6 else (q - q.mean()) / (q.std() + 1e-8)
        assert [f["rate"] for f in row["features"]] == pytest.approx(
            list((w - w.mean()) / scale(w)), abs=1e-6)
        assert [f["lag"] for f in row["features"]] == pytest.approx(list(norm_lag), abs=1e-6)
        assert row["label"] == pytest.approx((r[j] - w.mean()) / scale(w), rel=1e-9, abs=1e-6)


def test_trend_and_spectrum(make_series):
    windows = features.with_norm(features.with_window(make_series(RATES), 30))
    both = features.spectral(features.trend_residual(windows, k=30), k=30).collect()
    assert any(r["ready"] for r in both)
    for row in both:
        if not row["ready"]:
            assert row["trend"] is None and row["spectrum"] is None
            continue
        x = np.array(row["norm"])
        padded = np.concatenate([x[:2], x, x[-2:]])
        trend = np.array([padded[i:i + 5].mean() for i in range(30)])
        wave = np.fft.rfft(x)[:10]
        assert row["trend"] == pytest.approx(list(trend), abs=1e-9)
        assert row["residual"] == pytest.approx(list(x - trend), abs=1e-9)
        assert row["spectrum"] == pytest.approx([*wave.real, *wave.imag], abs=1e-9)


def fold(w, alpha):
    acc = w[0]
    for v in w[1:]:
        acc = alpha * v + (1 - alpha) * acc
    return acc


def test_forecasters_and_warmup(make_series, by_series):
    @pandas_udf("double")
    def peak(win):
        return win.map(max)

    forecast.register("peak", lambda win, k: peak(win))
    assert {"last", "sma", "ema", "peak"} <= set(forecast.registered())
    models = ["last", "sma", "ema", "peak", forecast.ema_forecaster("fast", 0.7)]
    df = forecast.warmup_forecast(forecast.predict_all(
        features.with_window(make_series(RATES), K), models, K), "ema", K).cache()
    got = {m: by_series(df, f"pred_{m}") for m in ("last", "sma", "ema", "peak", "fast")}
    warm, conf = by_series(df, "pred"), by_series(df, "confidence")
    for s, r in RATES.items():
        for t in range(len(r)):
            w = r[max(0, t - K + 1):t + 1]
            if len(w) < K:
                assert all(got[m][s][t] is None for m in got)
                assert (warm[s][t], conf[s][t]) == (pytest.approx(w.mean()), 0.0)
            else:
                assert got["last"][s][t] == w[-1] and got["peak"][s][t] == w.max()
                assert got["sma"][s][t] == pytest.approx(w.mean())
                assert got["ema"][s][t] == fold(w, 0.3)      # the same operations, bit by bit
                assert got["fast"][s][t] == fold(w, 0.7)
                assert conf[s][t] == 1.0
    with pytest.raises(ValueError):
        forecast.register("nothing")


def test_tuning_prefers_the_first_of_equals(make_series):
    flat = make_series({"a": [5.0] * 20})
    rows = sorted(forecast.tune_ema(flat, (0.5, 0.25), K).collect(), key=lambda r: r["alpha"])
    assert [(r["alpha"], r["is_best"]) for r in rows] == [(0.25, False), (0.5, True)]
    rates = {"a": RATES["a"]}
    rows = forecast.tune_ema(make_series(rates), (0.1, 0.7), K).collect()
    for row in rows:
        r = rates["a"]
        want = np.mean([abs(fold(r[t - K + 1:t + 1], row["alpha"]) - r[t + 1])
                        for t in range(K - 1, len(r) - 1)])
        assert row["mae"] == pytest.approx(want)
    assert sum(r["is_best"] for r in rows) == 1


def test_ensembles(spark):
    wide = spark.createDataFrame(
        [("s", 0, 10.0, 20.0, 60.0)],
        "series_id string, step long, pred_lstm double, pred_gru double, pred_tcn double")
    names = ["lstm", "gru", "tcn"]
    weights = spark.createDataFrame([("lstm", 3.0), ("tcn", 0.0)], "model string, weight double")
    row = forecast.ensembles(wide, names, weights).collect()[0].asDict()
    assert row["pred_ens_mean"] == pytest.approx(30.0)
    assert row["pred_ens_wtd"] == pytest.approx((3 * 10 + 20) / 4)      # gru weighs 1 by default
    assert row["pred_ens_rnn"] == pytest.approx(15.0)
    assert row["pred_ens_top3"] == pytest.approx(15.0)                  # one of the three is absent
    assert row["pred_ens_diverse"] == pytest.approx(35.0)
    few = forecast.ensembles(wide.select("series_id", "step", "pred_tcn"), ["tcn"])
    assert "pred_ens_rnn" not in few.columns and "pred_ens_diverse" not in few.columns


def test_extended_models_are_learned_ones_baselines_and_their_ensembles(spark):
    models = [forecast.Forecaster(n, lambda win, k, v=v: F.lit(float(v))) for n, v in (("lstm", 10), ("gru", 20), ("tcn", 60))]
    report = spark.createDataFrame([("lstm", 4.0), ("gru", 1.0), ("tcn", 2.0), ("sma", 0.1)], "model string, mae double")
    found = forecast.extended(models, report, forecast.ema_forecaster("tuned", 0.5))
    members = {m.name: ([x.name for x in m.members], m.weights) for m in found if not isinstance(m, str) and m.members}
    assert [m if isinstance(m, str) else m.name for m in found[:5]] == ["lstm", "gru", "tcn", "sma", "tuned"]
    assert members["ens_mean"][0] == ["lstm", "gru", "tcn"] and members["ens_rnn"][0] == members["ens_top3"][0] == ["lstm", "gru"]
    assert members["ens_diverse"][0] == ["gru", "tcn"]                  # the better recurrent one by validation
    assert members["ens_wtd"][1] == pytest.approx({"lstm": 1 / 7, "gru": 4 / 7, "tcn": 2 / 7})
    assert [m for m in forecast.extended([], report)] == ["sma", "ema"]


def test_confidence(make_series):
    df = make_series({"a": [1.0]}).select(
        F.lit(10.0).alias("pred_x"), F.lit(30.0).alias("pred_y"), F.lit(20.0).alias("mu"),
        F.lit(10.0).alias("scale"))
    got = forecast.confidence(df, ["x", "y"]).collect()[0]["confidence"]
    assert got == pytest.approx(1 / (1 + 10 * 1.0))
    assert forecast.confidence(df, ["x"]).collect()[0]["confidence"] == 1.0
