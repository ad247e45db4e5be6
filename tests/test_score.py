"""Errors, reports, rankings and exact quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streampace.operators import forecast, score, series
from streampace.plans.quantiles import exact_quantiles


@pytest.fixture
def predictions(spark):
    rows = [("s", 0, "m", 12.0, 10.0, 10.0), ("s", 1, "m", 5.0, 0.0, 5.0), ("s", 2, "m", 9.0, 8.0, 7.0),
            ("s", 0, "n", 10.0, 10.0, 10.0), ("s", 1, "n", 6.0, 0.0, 5.0)]
    return spark.createDataFrame(
        rows, "series_id string, step long, model string, pred double, actual double, current double")


def test_report_by_hand(predictions):
    got = {r["model"]: r for r in score.error_report(score.score(predictions)).collect()}
    m = got["m"]
    assert (m["mae"], m["n"]) == (pytest.approx(8 / 3), 3)
    assert m["rmse"] == pytest.approx(np.sqrt((4 + 25 + 1) / 3))
    assert m["mape"] == pytest.approx((20 + 5 / 1e-8 * 100 + 12.5) / 3, rel=1e-6)
    # Unchanged counts as down: up/down, down/down, up/up.
    assert m["dir_acc"] == pytest.approx(200 / 3)
    strict = {r["model"]: r for r in score.error_report(
        score.score(predictions, ties="three_way")).collect()}
    assert strict["m"]["dir_acc"] == pytest.approx(100 / 3)
    assert strict["n"]["dir_acc"] == pytest.approx(50.0)
    with pytest.raises(ValueError):
        score.score(predictions, ties="other")


def test_rankings(spark):
    report = spark.createDataFrame(
        [("gru", 2.0), ("lstm", 2.0), ("sma", 1.0), ("ens_mean", 1.5), ("tcn", 4.0)],
        "model string, mae double")
    board = score.leaderboard(report).orderBy("place").collect()
    assert [r["model"] for r in board] == ["sma", "ens_mean", "gru", "lstm", "tcn"]
    assert [r["is_best"] for r in board] == [True] + [False] * 4
    assert [r["model"] for r in score.top_k(report, 2).orderBy("place").collect()] == ["gru", "lstm"]
    assert score.best_of(report, ("lstm", "gru")).collect()[0]["model"] == "lstm"
    assert score.best_of(report, ("absent",)).count() == 0
    lift = {r["model"]: r["lift_pct"] for r in score.lift_vs(report, "gru").collect()}
    assert lift == {"gru": 0.0, "lstm": 0.0, "sma": 50.0, "ens_mean": 25.0, "tcn": -100.0}
    weights = {r["model"]: r["weight"] for r in score.inverse_error_weights(
        report.filter("model in ('sma', 'tcn')")).collect()}
    assert weights == {"sma": pytest.approx(0.8), "tcn": pytest.approx(0.2)}


@pytest.mark.parametrize("size", [60, 1 << 16])
def test_rolling(spark, size):
    rng = np.random.default_rng(1)
    errors = {("m", "a"): rng.random(150), ("m", "b"): rng.random(70), ("n", "a"): rng.random(10)}
    rows = [(m, s, i, float(e), int(e > 0.5)) for (m, s), v in errors.items() for i, e in enumerate(v)]
    df = spark.createDataFrame(
        rows, "model string, series_id string, step long, abs_err double, dir_ok int")
    for r in score.rolling_report(df, 50, size).collect():
        v = errors[(r["model"], r["series_id"])][max(0, r["step"] - 49):r["step"] + 1]
        assert r["rolling_mae"] == pytest.approx(v.mean())
        assert r["rolling_dir_acc"] == pytest.approx((v > 0.5).mean() * 100)
    latest = {r["model"]: r for r in score.rolling_latest(df, 100).collect()}
    tail = np.concatenate([errors[("m", "a")], errors[("m", "b")]])[-100:]
    assert (latest["m"]["mae"], latest["m"]["n"]) == (pytest.approx(tail.mean()), 100)
    assert latest["n"]["n"] == 10


def test_stored_predictions_meet_the_next_rate(spark, make_series):
    made = spark.createDataFrame([("a", 0, 5.0), ("a", 2, 6.0)], "series_id string, step long, pred double")
    paired = score.with_actual(made, make_series({"a": [1, 2, 3]})).collect()
    assert [(r["step"], r["actual"]) for r in paired] == [(0, 2.0)]


def test_wide_and_long_forms(predictions):
    wide = forecast.to_wide(score.score(predictions), ["m", "n"]).orderBy("step").collect()
    assert [r["pred_m"] for r in wide] == [12.0, 5.0, 9.0]
    assert [r["abserr_n"] for r in wide] == [0.0, 6.0, None]


def test_shapes_and_regimes(predictions):
    shaped = score.score(predictions).withColumn("shape", F.when(F.col("step") == 1, "wall").otherwise("noise"))
    matrix = {r["shape"]: r for r in score.shape_matrix(shaped, ["m", "n"]).collect()}
    assert (matrix["wall"]["mae_m"], matrix["noise"]["mae_m"], matrix["wall"]["mae_n"]) == (5.0, 1.5, 6.0)
    tagged = score.by_regime(score.score(predictions).withColumn(
        "regimes", F.array(F.lit("all"), F.lit("burst"))))
    assert tagged.count() == 10


def test_agreement(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0)], "k int, v double")
    right = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, None), (5, 5.0)], "k int, v double")
    got = score.agreement(left, right, ["k"], "v").collect()[0]
    assert tuple(got) == (2, 1, 1, 1)


@pytest.mark.parametrize("small_group", [0, 10**6])
def test_exact_quantiles(spark, small_group):
    """Both ways agree with NumPy, on ties, heavy tails, tiny groups, nulls and a hot group."""
    rng = np.random.default_rng(2)
    groups = {
        "hot": rng.lognormal(0, 3, 40000), "ties": rng.integers(0, 4, 5000).astype(float),
        "constant": np.full(300, 2.5), "one": np.array([7.0]), "two": np.array([1.0, 2.0]),
        "negative": -rng.random(999),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    rows += [("ties", None), (None, 4.0), (None, 6.0), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_quantiles(
        df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "lo": 0.0, "hi": 1.0},
        {"n": "rows", "known": "count", "mean": "mean", "least": "min", "most": "max"}, small_group).collect()}
    for g, values in groups.items():
        for name, q in (("p50", 50), ("p95", 95), ("p99", 99), ("lo", 0), ("hi", 100)):
            assert got[g][name] == pytest.approx(np.percentile(values, q), rel=1e-12), (g, name)
        assert (got[g]["known"], got[g]["least"], got[g]["most"]) == (len(values), values.min(), values.max())
        assert got[g]["mean"] == pytest.approx(values.mean(), rel=1e-12)
    assert got[None]["p50"] == 5.0 and got["ties"]["n"] == 5001
    assert got["empty"]["p50"] is None and got["empty"]["n"] == 1 and got["empty"]["known"] == 0
    whole = exact_quantiles(df, [], "v", {"m": 0.5}, small_group=small_group).collect()[0]
    everything = np.concatenate([*groups.values(), [4.0, 6.0]])
    assert whole["m"] == pytest.approx(np.median(everything), rel=1e-12)


def test_next_rate_is_scored_to_the_last_point(make_series):
    wide = forecast.forecasts(make_series({"a": range(35)}), ["last"], 30)
    assert sorted(r["step"] for r in wide.collect()) == [29, 30, 31, 32, 33]
    assert series.with_next(make_series({"a": [1, 2]})).count() == 2


def test_latest_scores_sort_no_table(spark):
    """Each task keeps its newest rows; null names and ids keep their places, and no sort comes before that."""
    rows = [(m, s, t, float(t % 9), t % 2) for m in ("a", None) for s in ("x", "y", None, "z") for t in range(40)]
    rows += [("few", "q", t, 1.0, 1) for t in range(3)]
    df = spark.createDataFrame(rows, "model string, series_id string, step long, abs_err double, dir_ok int").repartition(7)
    got = {r["model"]: (r["mae"], r["n"]) for r in score.rolling_latest(df, 130).collect()}
    want = sorted([r for r in rows if r[0] == "a"], key=lambda r: (r[1] is not None, r[1] or "", r[2]))[-130:]
    mae = sum(r[3] for r in want) / 130
    assert got == {"a": (mae, 130), None: (mae, 130), "few": (1.0, 3)}
    plan = score.rolling_latest(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan[plan.index("MapInArrow"):]
