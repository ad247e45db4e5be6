"""Fitted forecasters."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from streampace.operators import boost, features, forecast, huber, learn
from streampace.plans.durable import durable

K = 30


@pytest.fixture(scope="module")
def waves(spark):
    rows = []
    for s in range(6):
        for t in range(90):
            rows.append((f"s{s}", t, float(100 + 50 * np.sin(t / 4 + s) + s), float(t % 7)))
    return spark.createDataFrame(rows, "series_id string, step long, rate double, lag double").cache()


def test_linear_models_learn_a_wave_and_round_trip(spark, waves, tmp_path):
    samples = learn.samples(waves, K).cache()
    models = [learn.fit_trend_linear(samples, max_iter=20), learn.fit_spectral(samples, max_iter=20)]
    report = {r["model"]: r for r in learn.validation_report(samples, models).collect()}
    assert set(report) == {"trend_linear", "spectral_linear"}
    wide = forecast.forecasts(waves, [*models, "ema"], K)
    error = {m: wide.selectExpr(f"avg(abs(pred_{m} - actual)) e").collect()[0]["e"]
             for m in ("trend_linear", "spectral_linear", "ema")}
    assert error["trend_linear"] < error["ema"] / 2 and error["spectral_linear"] < error["ema"] / 2

    learn.save_models(models, str(tmp_path))
    loaded = learn.load_models(str(tmp_path), ["trend_linear", "spectral_linear", "absent"])
    assert set(loaded) == {"trend_linear", "spectral_linear"}
    with pytest.raises(FileNotFoundError):
        learn.load_models(str(tmp_path), ["absent"], missing="fail")
    again = forecast.forecasts(waves, [loaded["trend_linear"]], K)
    left = {(r["series_id"], r["step"]): r["pred_trend_linear"] for r in wide.collect()}
    for r in again.collect():
        assert r["pred_trend_linear"] == pytest.approx(left[(r["series_id"], r["step"])])


def test_trees_with_lag(waves):
    samples = learn.samples(waves, K, lag=True)
    model = learn.fit_window_trees(samples, lag=True, max_iter=2, max_depth=3)
    windows = features.with_window(waves, K, lag=True)
    wide = forecast.predict_all(windows, [model], K).filter("ready")
    assert wide.filter("pred_window_trees is null or pred_window_trees < 0").count() == 0


def reweighted(x, y, delta, reg, rounds=200):
    """The same loop on whole arrays."""
    full, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        w = delta / np.maximum(np.abs(y - full @ beta), delta)
        ridge = reg * w.sum() * np.eye(len(beta))
        ridge[-1, -1] = 0
        beta = np.linalg.solve(full.T @ (full * w[:, None]) + ridge, full.T @ (y * w))
    return beta


@pytest.mark.parametrize("delta", [1.0, 0.2])
def test_huber_equals_a_loop_and_shrugs_off_outliers(spark, delta):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(scale=0.1, size=3000)
    y[::10] += rng.exponential(1000, 300)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)] + [([0.0, 0.0, 0.0], None)],
                                 "features array<double>, label double").repartition(7)
    beta, loss = huber.fit(rows, 3, delta, tolerance=1e-10, max_iter=200)
    assert beta == pytest.approx(reweighted(x, y, delta, 1e-6), abs=1e-6)
    assert beta[:3] == pytest.approx([1.0, -2.0, 0.5], abs=0.05)
    r = np.abs(y - np.column_stack([x, np.ones(3000)]) @ beta)
    assert loss == pytest.approx(np.where(r <= delta, r ** 2 / 2, delta * (r - delta / 2)).sum(), rel=1e-6)
    with pytest.raises(ValueError):
        huber.fit(rows.limit(0), 3)


@pytest.mark.parametrize("fit,kind,lag", [(learn.fit_trend_linear, "trend", False), (learn.fit_spectral, "spectral", True)])
def test_learned_forecasts_equal_those_of_a_loop(waves, fit, kind, lag):
    rows = learn.samples(waves, K, lag=lag)
    model = fit(rows, lag=lag, max_iter=200)
    made = learn.WindowFeatures(kind, K, lag).transform(rows).select("features", "label").collect()
    x, y = np.array([r.features.toArray() for r in made]), np.array([r.label for r in made])
    beta = reweighted(x, y, 1.0, 1e-6)
    got = model.model.transform(rows).select("prediction").collect()
    assert [r.prediction for r in got] == pytest.approx(x @ beta[:-1] + beta[-1], abs=1e-4)
    report = learn.validation_report(rows, [model]).collect()[0]
    assert report["mae"] == pytest.approx(np.abs(y - x @ beta[:-1] - beta[-1]).mean(), abs=1e-4)


def test_samples_equal_the_supervised_windows(spark, waves):
    """Arrays cut from batches against Spark's frames: chunks with halos, few rows a batch, nulls, short and quiet series."""
    rows = [("null", t, None if t % 40 == 7 else float(t % 5), float(t)) for t in range(100)]
    rows += [("short", t, 1.0, 1.0) for t in range(K)] + [("quiet", t, 0.0, 2.0) for t in range(50)]
    series = waves.unionByName(spark.createDataFrame(rows, waves.schema)).withColumn("split", F.lit("train"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        for size, held in ((1 << 16, 1), (32, 4096)):
            old, features.ROWS = features.ROWS, held
            got = features.normal_windows(series, K, True, size).collect()
            features.ROWS = old
            want = {(r.series_id, r.step): r for r in features.supervised(series, K, True, size).collect()}
            assert len(got) == len(want) and {(r.series_id, r.step) for r in got} == set(want)
            for r in got:
                w = want[r.series_id, r.step]
                assert (r.rate, r.lag, r.split) == (w.rate, w.lag, w.split)
                assert [r.mu, r.scale, *r.norm, *r.lag_norm] == pytest.approx(
                    [w.mu, w.scale, *[x.rate for x in w.features], *[x.lag for x in w.features]], abs=1e-9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_boosted_trees_equal_those_of_spark(spark, tmp_path):
    """Few values a feature, so both have the same bounds; and no row is dropped."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 9, (4000, 4)).astype(float)
    y = x[:, 0] * 3 + np.where(x[:, 1] > 4, 10, 0) * x[:, 2] + rng.normal(scale=0.5, size=4000)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)] + [([0.0] * 4, None)],
                                 "features array<double>, label double").repartition(5).cache()
    trees = boost.fit(rows, 4, 5, 3)
    vectors = rows.withColumn("features", array_to_vector("features"))
    theirs = GBTRegressor(maxIter=5, maxDepth=3, lossType="absolute").fit(vectors.filter("label is not null"))
    mine = boost.BoostedTrees(trees, 4)
    mine.write().overwrite().save(str(tmp_path / "trees"))
    for model in (mine, boost.BoostedTrees.load(str(tmp_path / "trees"))):
        both = model.transform(vectors).withColumnRenamed("prediction", "mine")
        both = theirs.transform(both).filter("label is not null")
        assert both.filter("abs(mine - prediction) > 1e-9").count() == 0
    doubles = huber.packed(rows.filter("label is not null"))
    stored = boost.binned(doubles, boost.bounds_of(doubles, 4, 1))
    seen = boost.histograms(stored, 4, [], [], []).agg(F.sum("n"), F.sum("total")).first()
    assert seen[0] == 4 * 4000 and seen[1] == pytest.approx(4 * y.sum())


def test_continuous_features_get_bins(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 2))
    y = np.sign(x[:, 0]) * 5 + x[:, 1]
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "features array<double>, label double")
    bounds = boost.bounds_of(huber.packed(rows), 2, 1)
    assert all(len(b) == boost.BINS - 1 for b in bounds)
    trees = boost.fit(rows, 2, 3, 3)
    assert np.abs(boost.value_of(np.ascontiguousarray(x.T), trees) - y).mean() < 1
    with pytest.raises(ValueError):
        boost.fit(rows.limit(0), 2)


def test_fits_store_no_derived_features(spark, waves, monkeypatch):
    stored = []
    monkeypatch.setattr(huber, "durable", lambda df, name: stored.append(durable(df, name)) or stored[-1])
    learn.fit_trend_linear(learn.samples(waves), max_iter=2)
    assert stored[0].columns == ["packed"]
    assert stored[0].agg(F.sum(F.octet_length("packed"))).first()[0] == 6 * (90 - K) * (K + 1) * 8


def test_samples_stored_once_give_the_same_fit(waves, monkeypatch):
    samples = learn.samples(waves)
    kept = learn.stored(samples)
    first = learn.fit_trend_linear(samples, max_iter=5).model.stages[-1]
    monkeypatch.setattr(huber, "durable", None)      # nothing is stored again
    again = learn.fit_trend_linear(kept, max_iter=5).model.stages[-1]
    assert again.getOrDefault(again.coefficients) == pytest.approx(first.getOrDefault(first.coefficients), abs=1e-9)
