"""SQL counterparts of the queries, for DuckDB on the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

SHAPES = "['noise','ramp','wall','plateau','cliff','double_peak','sawtooth']"
NAMES = ("last", "sma", "ema", "ema_slow", "ema_fast")
TRACE = "(rate * 60.0::DOUBLE)"


def series_sql(key: str, table: str = "events", ts: str = "ts", seconds: int = 3600,
               rate: str = "count(b.bucket)::DOUBLE") -> str:
    """CTEs ending in ``r(series_id, step, rate)``."""
    return f"""
b AS (SELECT {key}::VARCHAR AS series_id, epoch_us({ts}) // {seconds * 1_000_000} AS bucket
      FROM {table}),
span AS (SELECT series_id, min(bucket) AS lo, max(bucket) AS hi FROM b GROUP BY 1),
grid AS (SELECT series_id, lo, unnest(range(0, hi - lo + 1)) AS step FROM span),
r AS (SELECT g.series_id, g.step::BIGINT AS step, {rate} AS rate
      FROM grid g LEFT JOIN b
        ON b.series_id = g.series_id AND b.bucket = g.lo + g.step GROUP BY 1, 2)"""


TYPES = series_sql("event_type")
USERS = series_sql("user_id")
TICKS = series_sql("event_type", rate="count(b.bucket)::DOUBLE * 60.0::DOUBLE")


def with_sql(*parts: str, recursive: bool = False) -> str:
    *ctes, body = parts
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(c.strip() for c in ctes)} {body}"


# The last 30 rates of each step with mean and scale.
WINDOWS = """
w0 AS (SELECT *, list(rate) OVER f AS win, avg(rate) OVER f AS mu, stddev_pop(rate) OVER f AS sd,
              lead(rate) OVER (PARTITION BY series_id ORDER BY step) AS actual
       FROM r WINDOW f AS (PARTITION BY series_id ORDER BY step ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
w AS (SELECT *, greatest(sd, mu * 0.05::DOUBLE) + 1e-8::DOUBLE AS scale, len(win) = 30 AS ready FROM w0)"""


def ema_sql(alpha: float, win: str = "win") -> str:
    a = f"{alpha}::DOUBLE"
    return f"list_reduce({win}, lambda acc, v: {a} * v + (1 - {a}) * acc)"


PREDS = {
    "last": "win[-1]", "sma": "list_sum(win) / len(win)", "ema": ema_sql(0.3),
    "ema_slow": ema_sql(0.1), "ema_fast": ema_sql(0.7),
}
FORECASTS = "fc AS (SELECT *, rate AS cur, " + ", ".join(
    f"greatest({sql}, 0) AS pred_{n}" for n, sql in PREDS.items()
) + " FROM w WHERE ready AND actual IS NOT NULL)"


def scored_sql(names=NAMES, source: str = "fc", extra: str = "") -> str:
    """CTE ``sc``: one row per step and model with errors."""
    union = " UNION ALL ".join(
        f"SELECT series_id, step, actual, cur, {extra} '{n}' AS model, pred_{n} AS pred FROM {source}"
        for n in names)
    return f"""sc AS (SELECT *, abs(pred - actual) AS abs_err,
      abs(pred - actual) / (actual + 1e-8::DOUBLE) * 100 AS mape,
      CASE WHEN (pred > cur) = (actual > cur) THEN 1 ELSE 0 END AS dir_ok FROM ({union}))"""


ERRORS = """avg(abs_err) AS mae, sqrt(avg(abs_err * abs_err)) AS rmse, avg(mape) AS mape,
 avg(mape) FILTER (actual > 0) AS mape_active, avg(dir_ok) * 100 AS dir_acc, count(*) AS n"""


def rounded_mape(value: str) -> str:
    return f"CASE WHEN {value} >= 1e5 THEN round({value} / 1e5) * 1e5 ELSE round({value}, 6) END"


def rounds(columns: str) -> str:
    return ", ".join(f"{rounded_mape(c) if c.startswith('mape') else f'round({c}, 6)'} AS {c}"
                     for c in map(str.strip, columns.split(",")))


SPLIT = """
ids AS (SELECT series_id, row_number() OVER (ORDER BY series_id) - 1 AS i, count(*) OVER () AS n
        FROM (SELECT DISTINCT series_id FROM r)),
parts AS (SELECT series_id, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train'
            WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
          FROM ids)"""

# Messages and latency ------------------------------------------------------------------------------

MEASURED = """m AS (SELECT epoch_us(ts) / 1e6::DOUBLE AS producer_ts,
  json_extract_string(props, '$.k')::INTEGER AS rate_target, hour(ts)::INTEGER AS second, event_type,
  value AS v, epoch_us(ts) AS us, epoch_us(ts) + round(value * 500)::BIGINT AS ingest_us,
  epoch_us(ts) + round(value * 1000)::BIGINT AS done_us FROM events)"""
LATENCY = """l AS (SELECT *, (done_us / 1e6::DOUBLE - producer_ts) * 1000 AS e2e_latency_ms,
  (done_us / 1e6::DOUBLE - ingest_us / 1e6::DOUBLE) * 1000 AS kafka_latency_ms FROM m)"""

ORACLES["parse_messages"] = with_sql(MEASURED, """
SELECT CASE WHEN ok THEN round(producer_ts, 6) END AS producer_ts,
  CASE WHEN ok THEN floor(v)::INTEGER END AS value, CASE WHEN ok THEN rate_target END AS rate_target,
  CASE WHEN ok THEN second END AS second, CASE WHEN ok THEN event_type END AS payload,
  ingest_us AS ingest_ts,
  CASE WHEN ok THEN trunc(producer_ts * 1000)::BIGINT * 1000 END AS event_time
FROM (SELECT *, event_type <> 'error' AS ok FROM m)""")
ORACLES["latency_rows"] = with_sql(MEASURED, LATENCY, """
SELECT round(producer_ts, 6) AS producer_ts, rate_target, second,
  round(e2e_latency_ms, 6) AS e2e_latency_ms, round(kafka_latency_ms, 6) AS kafka_latency_ms FROM l""")
ORACLES["latency_rows_truncated"] = with_sql(MEASURED, """
SELECT round(producer_ts, 6) AS producer_ts, rate_target, second,
  round(((done_us // 1000000)::DOUBLE - producer_ts) * 1000, 6) AS e2e_latency_ms,
  round(((done_us // 1000000)::DOUBLE - (ingest_us // 1000000)::DOUBLE) * 1000, 6) AS kafka_latency_ms
FROM m""")
ORACLES["latency_stats_exact"] = with_sql(MEASURED, LATENCY, """
SELECT rate_target, count(*) AS events, round(avg(e2e_latency_ms), 6) AS avg_latency_ms,
  round(quantile_cont(e2e_latency_ms, 0.5), 6) AS p50_ms,
  round(quantile_cont(e2e_latency_ms, 0.95), 6) AS p95_ms,
  round(quantile_cont(e2e_latency_ms, 0.99), 6) AS p99_ms FROM l GROUP BY 1""")
ORACLES["latency_distribution"] = with_sql(MEASURED, LATENCY, """
d AS (SELECT rate_target, floor(e2e_latency_ms) AS latency_ms, count(*) AS events FROM l GROUP BY 1, 2)""", """
SELECT rate_target, latency_ms, events, round(sum(events) OVER (PARTITION BY rate_target ORDER BY latency_ms)
  / sum(events) OVER (PARTITION BY rate_target), 6) AS cumulative FROM d""")
ORACLES["windowed_count"] = """
SELECT h * 3600000000 AS window_start, (h + 1) * 3600000000 AS window_end, count(*) AS events
FROM (SELECT epoch_us(ts) // 3600000000 AS h FROM events) GROUP BY h"""
ORACLES["windowed_stats"] = with_sql(MEASURED, """
SELECT q * 900000000 AS window_start, (q + 1) * 900000000 AS window_end, count(*) AS event_count,
  round(avg(rate_target::DOUBLE), 6) AS avg_rate_target
FROM (SELECT us // 900000000 AS q, rate_target FROM m) GROUP BY q""")
ORACLES["count_by_phase"] = """
SELECT CASE WHEN value > 50 THEN 'burst' ELSE 'normal' END AS phase, count(*) AS events
FROM events GROUP BY 1"""
ORACLES["events_per_mode"] = with_sql(MEASURED, """
SELECT CASE WHEN second < 8 THEN 'fixed_500ms' WHEN second < 16 THEN 'fixed_2s' ELSE 'fixed_5s' END AS mode,
  count(*) AS events FROM m GROUP BY 1""")

# Progress logs -------------------------------------------------------------------------------------

PROGRESS = """p AS (SELECT event_type AS run_id, epoch_us(ts) // 3600000000 AS batch_id,
  count(*) AS num_input_rows, round(sum(value))::BIGINT AS batch_duration_ms,
  CASE WHEN event_type < 'h' THEN 'front' ELSE 'back' END AS app_name FROM events GROUP BY ALL)"""

ORACLES["progress_dedup"] = with_sql(PROGRESS, """
SELECT app_name, run_id, batch_id, (batch_id + 1) * 3600000000 AS ts, num_input_rows,
  round(num_input_rows / 3600::DOUBLE, 6) AS input_rows_per_second, batch_duration_ms
FROM p WHERE app_name = 'front'""")
ORACLES["progress_first_app"] = with_sql(PROGRESS, """
SELECT app_name, run_id, 2 * count(*) AS reports FROM p
WHERE app_name = (SELECT app_name FROM p ORDER BY batch_id, app_name LIMIT 1) GROUP BY 1, 2""")
ORACLES["burst_flags"] = with_sql(PROGRESS, """
SELECT run_id, batch_id, num_input_rows, num_input_rows > 4 AS is_burst FROM p""")
ORACLES["recent_batches"] = with_sql(PROGRESS, """
SELECT run_id AS series_id, row_number() OVER (PARTITION BY run_id ORDER BY batch_id) - 1 AS step, round(num_input_rows / 3600::DOUBLE, 6) AS rate
FROM p QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY batch_id DESC) <= 30""")
ORACLES["duration_compare"] = with_sql(PROGRESS, """
s AS (SELECT run_id AS mode, count(*) AS batches, avg(batch_duration_ms) AS mean_ms,
  quantile_cont(batch_duration_ms::DOUBLE, 0.5) AS median_ms,
  quantile_cont(batch_duration_ms::DOUBLE, 0.95) AS p95_ms FROM p GROUP BY 1)""", """
SELECT s.mode, s.batches, round(s.mean_ms, 6) AS mean_ms, round(s.median_ms, 6) AS median_ms,
  round(s.p95_ms, 6) AS p95_ms, round((s.mean_ms / c.mean_ms - 1) * 100, 6) AS mean_ms_change_pct,
  round((s.median_ms / c.median_ms - 1) * 100, 6) AS median_ms_change_pct,
  round((s.p95_ms / c.p95_ms - 1) * 100, 6) AS p95_ms_change_pct
FROM s, (SELECT * FROM s WHERE mode = 'click') c""")

# Series --------------------------------------------------------------------------------------------

ORACLES["rate_series"] = with_sql(USERS, "SELECT * FROM r")
ORACLES["rate_series_orders"] = with_sql(
    series_sql("o_orderpriority", "orders", "o_orderdate", 86400), "SELECT * FROM r")
ORACLES["rate_summary"] = with_sql(USERS, """
SELECT series_id, min(rate) AS min, max(rate) AS max, round(avg(rate), 6) AS mean,
  round(quantile_cont(rate, 0.25), 6) AS p25, round(quantile_cont(rate, 0.75), 6) AS p75
FROM r GROUP BY 1""")
REGIMES = """tagged AS (SELECT *, list_concat(['all'], CASE WHEN rate > 200 THEN ['burst'] ELSE [] END,
  CASE WHEN abs(rate - prev) > 50 THEN ['transition'] ELSE [] END) AS regimes
  FROM (SELECT *, lag(rate) OVER (PARTITION BY series_id ORDER BY step) AS prev FROM r))"""
ORACLES["regimes"] = with_sql(
    TICKS, REGIMES, "SELECT series_id, step, unnest(regimes) AS regime FROM tagged")
LABELS = f"""
lab AS (SELECT series_id, step AS s0, step + CASE WHEN shape = 'wall' THEN 60 ELSE 32 END AS s1, shape
  FROM (SELECT series_id, step, ({SHAPES})[((step // 48) % 7 + 1)::INTEGER] AS shape
        FROM r WHERE step % 48 = 0)),
shaped AS (SELECT r.series_id, r.step, r.rate, coalesce(arg_max(lab.shape, lab.s0), 'noise') AS shape
  FROM r LEFT JOIN lab ON r.series_id = lab.series_id AND r.step >= lab.s0 AND r.step < lab.s1
  GROUP BY 1, 2, 3)"""
ORACLES["label_steps"] = with_sql(TYPES, LABELS, "SELECT * FROM shaped")
ORACLES["asof_schedule"] = """
WITH s(start, target) AS (VALUES (0, 50), (15, 500), (30, 50), (45, 800), (55, 300), (70, 50),
  (85, 1200), (95, 50), (110, 50)),
t AS (SELECT event_id, ((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 3600000000::DOUBLE) % 120
  AS elapsed FROM events)
SELECT t.event_id, round(t.elapsed, 6) AS elapsed, s.target AS rate_target
FROM t ASOF JOIN s ON t.elapsed >= s.start"""
ORACLES["asof_schedule_table"] = with_sql(TYPES, """
busy AS (SELECT step * 3600 + 1800 AS start, sum(rate) AS target FROM r GROUP BY step HAVING sum(rate) > 15),
t AS (SELECT event_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6::DOUBLE AS elapsed
  FROM events)""", """
SELECT t.event_id, round(t.elapsed, 6) AS elapsed,
  coalesce(busy.target, (SELECT arg_min(target, start) FROM busy)) AS rate_target
FROM t ASOF LEFT JOIN busy ON t.elapsed >= busy.start""")
ORACLES["cap_series"] = with_sql(TICKS, """
SELECT series_id, step, round(greatest(rate, 1) * least(1, 400::DOUBLE
  / max(greatest(rate, 1)) OVER (PARTITION BY series_id)), 6) AS rate FROM r""")
ORACLES["split_series"] = with_sql(USERS, SPLIT, """
SELECT split, series_id, count(*) AS steps FROM r JOIN parts USING (series_id) GROUP BY 1, 2""")

# Features ------------------------------------------------------------------------------------------

ORACLES["window_norm"] = with_sql(TYPES, WINDOWS, """
SELECT series_id, step, ready, round(mu, 6) AS mu, round(scale, 6) AS scale,
  (pos - 1)::INTEGER AS pos, round((win[pos] - mu) / scale, 6) AS x
FROM (SELECT *, unnest(range(1, len(win) + 1)) AS pos FROM w)""")
ORACLES["warmup"] = with_sql(USERS, WINDOWS, f"""
SELECT series_id, step, round(CASE WHEN ready THEN {ema_sql(0.3)} ELSE list_sum(win) / len(win) END, 6)
  AS pred, CASE WHEN ready THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM w""")


def lag_sql(inflow: str, source: str = "r") -> str:
    """CTE ``q(series_id, step, rate, lag)``, computed step by step."""
    return f"""x AS (SELECT series_id, step, rate, {inflow} AS x FROM {source}),
q AS (SELECT series_id, step, rate, greatest(0, x)::DOUBLE AS lag FROM x WHERE step = 0
  UNION ALL SELECT x.series_id, x.step, x.rate, greatest(0, q.lag + x.x)::DOUBLE
  FROM q JOIN x ON x.series_id = q.series_id AND x.step = q.step + 1)"""


CONSTANT = "CASE WHEN step = 0 THEN 0 ELSE rate - 2.3::DOUBLE * 1.2::DOUBLE END"
ROLLING = """rate - avg(rate) OVER (PARTITION BY series_id ORDER BY step
  ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) * 1.2::DOUBLE"""
LAGGED = "SELECT series_id, step, rate, round(lag, 6) AS lag FROM q"
ORACLES["lag_constant"] = with_sql(TYPES, lag_sql(CONSTANT), LAGGED, recursive=True)
ORACLES["lag_rolling"] = with_sql(
    TYPES, lag_sql(f"CASE WHEN rate = 0 THEN 0 ELSE {ROLLING} END"), LAGGED, recursive=True)
ORACLES["lag_rolling_draining"] = with_sql(TYPES, lag_sql(ROLLING), LAGGED, recursive=True)
ORACLES["lag_norm"] = with_sql(TYPES, lag_sql(CONSTANT), """
lw AS (SELECT series_id, step, list(lag) OVER f AS win, avg(lag) OVER f AS m, stddev_pop(lag) OVER f AS sd
  FROM q WINDOW f AS (PARTITION BY series_id ORDER BY step ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))""", """
SELECT series_id, step, (pos - 1)::INTEGER AS pos, round(CASE WHEN sd < 1e-6 THEN 0
  ELSE (win[pos] - m) / (sd + 1e-8::DOUBLE) END, 6) AS x
FROM (SELECT *, unnest(range(1, 31)) AS pos FROM lw WHERE len(win) = 30)""", recursive=True)
ORACLES["supervised_windows"] = with_sql(USERS, SPLIT, """
s0 AS (SELECT series_id, step, rate, list(rate) OVER f AS win, avg(rate) OVER f AS mu,
    stddev_pop(rate) OVER f AS sd FROM r WINDOW f AS (PARTITION BY series_id ORDER BY step
    ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, greatest(sd, mu * 0.05::DOUBLE) + 1e-8::DOUBLE AS scale FROM s0 WHERE len(win) = 30)""", """
SELECT series_id, step, split, round((rate - mu) / scale, 6) AS label, round(mu, 6) AS mu,
  round(scale, 6) AS scale, round((win[1] - mu) / scale, 6) AS oldest,
  round((win[30] - mu) / scale, 6) AS newest,
  round(list_sum(list_transform(win, lambda v: ((v - mu) / scale) * ((v - mu) / scale))), 6) AS power
FROM s JOIN parts USING (series_id)""")
# Residuals of the zero model are the labels; their scale is at least 0.05.
ORACLES["huber_sums"] = with_sql(USERS, SPLIT, """
s0 AS (SELECT series_id, step, rate, list(rate) OVER f AS win, avg(rate) OVER f AS mu,
    stddev_pop(rate) OVER f AS sd FROM r WINDOW f AS (PARTITION BY series_id ORDER BY step
    ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
s1 AS (SELECT *, greatest(sd, mu * 0.05::DOUBLE) + 1e-8::DOUBLE AS scale FROM s0 JOIN parts USING (series_id)
  WHERE len(win) = 30 AND split = 'train'),
s2 AS (SELECT *, (rate - mu) / greatest(scale, 0.05::DOUBLE) AS label FROM s1),
x AS (SELECT list_concat(list_transform(win, lambda v: (v - mu) / scale), [1.0::DOUBLE, label]) AS f, label,
  1 / greatest(abs(label), 1.0::DOUBLE) AS weight FROM s2),
p AS (SELECT i, j FROM range(32) a(i), range(32) b(j))""", """
SELECT i::INTEGER AS i, j::INTEGER AS j, round(sum(weight * f[i + 1] * f[j + 1]), 3) AS value FROM x, p GROUP BY i, j
UNION ALL
SELECT -1, -1, round(sum(CASE WHEN abs(label) <= 1 THEN label * label / 2 ELSE abs(label) - 0.5::DOUBLE END), 3) FROM x""")
NORM = """n AS (SELECT series_id, step, list_transform(win, lambda v: (v - mu) / scale) AS x
  FROM w WHERE ready)"""
ORACLES["trend_residual"] = with_sql(TYPES, WINDOWS, NORM, """
t AS (SELECT series_id, step, x, list_concat(x[1:2], x, x[29:30]) AS p, unnest(range(1, 31)) AS pos FROM n)""", """
SELECT series_id, step, (pos - 1)::INTEGER AS pos, round(list_sum(p[pos:pos + 4]) / 5, 6) AS trend,
  round(x[pos] - list_sum(p[pos:pos + 4]) / 5, 6) AS residual FROM t""")
ORACLES["spectral"] = with_sql(TYPES, WINDOWS, NORM, """
e AS (SELECT series_id, step, unnest(x) AS v, unnest(range(0, 30)) AS i FROM n),
f AS (SELECT unnest(range(0, 10)) AS k),
d AS (SELECT series_id, step, k, sum(v * cos(2 * pi() * k * i / 30)) AS re,
  -sum(v * sin(2 * pi() * k * i / 30)) AS im FROM e, f GROUP BY 1, 2, 3)""", """
SELECT series_id, step, k::INTEGER AS pos, round(re, 6) + 0.0 AS x FROM d
UNION ALL SELECT series_id, step, (k + 10)::INTEGER, round(im, 6) + 0.0 FROM d""")

# Forecasts -----------------------------------------------------------------------------------------

ORACLES["sma"] = with_sql(USERS, WINDOWS, """
SELECT series_id, step, rate, CASE WHEN ready THEN round(list_sum(win) / 30, 6) END AS pred FROM w""")
ORACLES["ema"] = with_sql(USERS, WINDOWS, f"""
SELECT series_id, step, rate, CASE WHEN ready THEN round({ema_sql(0.3)}, 6) END AS pred FROM w""")
VALIDATION = "rv AS (SELECT r.* FROM r JOIN parts USING (series_id) WHERE split = 'val')"
W_VAL = WINDOWS.replace("FROM r WINDOW", "FROM rv WINDOW")
ORACLES["tune_ema"] = with_sql(USERS, SPLIT, VALIDATION, W_VAL, "g AS (" + " UNION ALL ".join(
    f"SELECT {i} AS i, {a}::DOUBLE AS alpha, avg(abs(greatest({ema_sql(a)}, 0) - actual)) AS mae "
    "FROM w WHERE ready AND actual IS NOT NULL" for i, a in enumerate((0.1, 0.2, 0.3, 0.5, 0.7))) + ")",
    """SELECT alpha, round(mae, 6) AS mae, i = (SELECT arg_min(i, mae) FROM g) AS is_best FROM g""")
VAL_REPORT = f"vr AS (SELECT model, {ERRORS} FROM sc GROUP BY 1)"
WEIGHTS = "wt AS (SELECT model, (1 / mae) / (SELECT sum(1 / mae) FROM vr) AS weight FROM vr)"
ORACLES["ensemble_weights"] = with_sql(
    USERS, SPLIT, VALIDATION, W_VAL, FORECASTS, scored_sql(), VAL_REPORT, WEIGHTS,
    "SELECT model, round(weight, 6) AS weight FROM wt")
ORACLES["best_of_family"] = with_sql(
    USERS, SPLIT, VALIDATION, W_VAL, FORECASTS, scored_sql(), VAL_REPORT, """
SELECT model, round(mae, 6) AS mae FROM vr WHERE model IN ('sma', 'ema') ORDER BY vr.mae LIMIT 1""")
W_ALL = (WINDOWS.replace("w0 AS", "u0 AS").replace("w AS (", "u AS (").replace("FROM w0", "FROM u0"))
ENSEMBLES = """
ens AS (SELECT fcu.*,
  (pred_last + pred_sma + pred_ema + pred_ema_slow + pred_ema_fast) / 5.0::DOUBLE AS pred_ens_mean,
  (""" + " + ".join(f"pred_{n} * (SELECT weight FROM wt WHERE model = '{n}')" for n in NAMES) + """)
   / (SELECT sum(weight) FROM wt) AS pred_ens_wtd,
  (pred_ema + pred_ema_fast) / 2.0::DOUBLE AS pred_ens_pair,
  (pred_sma + pred_ema + pred_ema_slow) / 3.0::DOUBLE AS pred_ens_top3
  FROM fcu JOIN parts USING (series_id) WHERE split = 'test')"""
ALL_NAMES = (*NAMES, "ens_mean", "ens_wtd", "ens_pair", "ens_top3")
ORACLES["ensemble_recipes"] = with_sql(
    USERS, SPLIT, VALIDATION, W_VAL, FORECASTS, scored_sql(), VAL_REPORT, WEIGHTS, W_ALL,
    FORECASTS.replace("fc AS", "fcu AS").replace("FROM w ", "FROM u "), ENSEMBLES,
    scored_sql(ALL_NAMES, "ens").replace("sc AS", "se AS"), """
SELECT model, """ + rounds("mae, rmse, mape, mape_active, dir_acc") + f", n FROM (SELECT model, {ERRORS} FROM se GROUP BY 1)")
ORACLES["confidence"] = with_sql(TYPES, WINDOWS, FORECASTS, "c AS (SELECT series_id, step, [" + ", ".join(
    f"(pred_{n} - mu) / scale" for n in NAMES) + "] AS z FROM fc)", """
SELECT series_id, step, round(least(greatest(1 / (1 + sd * 10), 0), 1), 6) AS confidence
FROM (SELECT series_id, step, sqrt(list_sum(list_transform(z, lambda v: (v - m) * (v - m))) / 5) AS sd
  FROM (SELECT *, list_sum(z) / 5 AS m FROM c))""")

# Error reports -------------------------------------------------------------------------------------

REPORT_COLUMNS = "mae, rmse, mape, mape_active, dir_acc"
ORACLES["ema_error_report"] = with_sql(
    USERS, WINDOWS, FORECASTS, scored_sql(),
    f"rep AS (SELECT model, {ERRORS} FROM sc GROUP BY 1)",
    f"""SELECT model, {rounds(REPORT_COLUMNS)}, n,
  row_number() OVER (ORDER BY rep.mae, model)::INTEGER AS place,
  row_number() OVER (ORDER BY rep.mae, model) = 1 AS is_best FROM rep""")
ORACLES["error_report_all"] = with_sql(
    USERS, WINDOWS, FORECASTS, scored_sql(), f"rep AS (SELECT model, {ERRORS} FROM sc GROUP BY 1)",
    f"SELECT model, {rounds(REPORT_COLUMNS)}, n FROM rep")
ORACLES["error_quantiles_by_regime"] = with_sql(
    TICKS, REGIMES, WINDOWS.replace("FROM r WINDOW", "FROM tagged WINDOW"), FORECASTS,
    scored_sql(extra="regimes,"), """
rep AS (SELECT model, regime, avg(abs_err) AS mae, quantile_cont(abs_err, 0.5) AS median,
  quantile_cont(abs_err, 0.95) AS p95, count(*) AS n
  FROM (SELECT *, unnest(regimes) AS regime FROM sc) GROUP BY 1, 2)""", """
SELECT rep.model, rep.regime, round(rep.mae, 6) AS mae, round(rep.median, 6) AS median,
  round(rep.p95, 6) AS p95, rep.n, round((1 - rep.mae / e.mae) * 100, 6) AS lift_pct
FROM rep JOIN (SELECT regime, mae FROM rep WHERE model = 'ema') e USING (regime)""")
ORACLES["shape_error_matrix"] = with_sql(
    TYPES, LABELS, """nx AS (SELECT *, lead(shape) OVER (PARTITION BY series_id ORDER BY step)
  AS next_shape FROM shaped)""", WINDOWS.replace("FROM r WINDOW", "FROM nx WINDOW"), FORECASTS,
    scored_sql(extra="next_shape,"), "SELECT next_shape AS shape, " + ", ".join(
        f"round(avg(abs_err) FILTER (model = '{n}'), 9) AS mae_{n}" for n in NAMES)
    + " FROM sc GROUP BY 1")
ORACLES["rolling_report"] = with_sql(TYPES, WINDOWS, FORECASTS, scored_sql(), """
SELECT model, series_id, step, round(avg(abs_err) OVER f, 6) AS rolling_mae,
  round(avg(dir_ok) OVER f * 100, 6) AS rolling_dir_acc FROM sc
WINDOW f AS (PARTITION BY model, series_id ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
ORACLES["rolling_latest"] = with_sql(USERS, WINDOWS, FORECASTS, scored_sql(), """
SELECT model, round(avg(abs_err), 6) AS mae, round(avg(dir_ok) * 100, 6) AS dir_acc, count(*) AS n
FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY model ORDER BY series_id DESC, step DESC) <= 50)
GROUP BY 1""")
ORACLES["top_neural"] = with_sql(
    TYPES, WINDOWS, FORECASTS, scored_sql(),
    f"rep AS (SELECT model, {ERRORS} FROM sc WHERE model NOT IN ('sma', 'ema') GROUP BY 1)",
    f"""SELECT model, {rounds(REPORT_COLUMNS)}, n,
  row_number() OVER (ORDER BY rep.mae, model)::INTEGER AS place,
  row_number() OVER (ORDER BY rep.mae, model) = 1 AS is_best
FROM rep QUALIFY row_number() OVER (ORDER BY rep.mae, model) <= 2""")
ORACLES["predictions_wide"] = with_sql(
    TYPES, WINDOWS, FORECASTS, scored_sql(), "SELECT series_id, step, actual, " + ", ".join(
        (rounded_mape if out == "mape" else "round({}, 6)".format)(f"max({src}) FILTER (model = '{n}')")
        + f" AS {out}_{n}" for n in NAMES
        for src, out in (("pred", "pred"), ("abs_err", "abserr"), ("mape", "mape")))
    + " FROM sc GROUP BY 1, 2, 3")
ORACLES["stored_predictions"] = with_sql(USERS, WINDOWS, FORECASTS, scored_sql(("ema",)), f"""
SELECT model, {rounds(REPORT_COLUMNS)}, n FROM (SELECT model, {ERRORS} FROM (SELECT * REPLACE (
  CASE WHEN sign(pred - cur) = sign(actual - cur) THEN 1 ELSE 0 END AS dir_ok) FROM sc) GROUP BY 1)""")

# Intervals -----------------------------------------------------------------------------------------


def live_sql(rate: str, conf: str = "1.0::DOUBLE") -> str:
    whole = f"trunc(1000::DOUBLE / greatest({rate}, 1) * 1000)"
    return (f"CASE WHEN {conf} >= 0.1::DOUBLE AND {rate} > 0 THEN greatest(100, least(trunc({conf} * {whole}"
            f" + (1 - {conf}) * 2000), 30000)) ELSE 2000 END::BIGINT")


BACK = "least(greatest(500::DOUBLE / greatest({r}, 0.1::DOUBLE) * 1000, 100), 5000)"
ORACLES["interval_agent"] = with_sql(
    TICKS, "c AS (SELECT *, least(rate / 240::DOUBLE, 1) AS conf FROM r)", f"""
SELECT series_id, step, rate, round(conf, 6) AS conf, {live_sql('rate', 'conf')} AS raw_ms,
  CASE WHEN rate > 0 THEN {live_sql('rate', 'conf')} ELSE 1000 END AS effective_ms FROM c""")
ORACLES["interval_backtest"] = with_sql(TICKS, f"""
SELECT series_id, step, rate, round({BACK.format(r='rate')}, 6) AS raw_ms FROM r""")


def smooth_step(current: str, target: str) -> str:
    mixed = f"trunc(0.3::DOUBLE * {target} + (1 - 0.3::DOUBLE) * {current})"
    limited = f"least(greatest({mixed}, trunc({current} * 0.5::DOUBLE)), trunc({current} * 2.0::DOUBLE))"
    return f"(CASE WHEN {current} <= 0 THEN {target} ELSE least(greatest({limited}, 100), 30000) END)::BIGINT"


def smooth_sql(source: str = "i") -> str:
    """CTE ``s`` from ``i(series_id, step, rate, raw_ms)``."""
    return f"""s AS (SELECT series_id, step, rate, raw_ms, raw_ms AS smoothed_ms FROM {source} WHERE step = 0
  UNION ALL SELECT i.series_id, i.step, i.rate, i.raw_ms, {smooth_step('s.smoothed_ms', 'i.raw_ms')}
  FROM s JOIN {source} i ON i.series_id = s.series_id AND i.step = s.step + 1)"""


LIVE = f"i AS (SELECT series_id, step, rate, {live_sql('rate')} AS raw_ms FROM r)"
ORACLES["smoothed_intervals"] = with_sql(
    TICKS, LIVE, smooth_sql(), "SELECT *, abs(raw_ms - smoothed_ms) > 100 AS large_change FROM s",
    recursive=True)
ORACLES["interval_changes"] = with_sql(TICKS, LIVE, smooth_sql(), """
SELECT series_id, count(*) AS changes FROM s WHERE abs(raw_ms - smoothed_ms) > 100 GROUP BY 1""",
    recursive=True)
FAILING = f"i AS (SELECT series_id, step, rate, CASE WHEN rate > 120 THEN {live_sql('rate')} END AS raw_ms FROM r)"


def fallback_sql(recovers: bool) -> str:
    """CTE ``s`` with failures: the error counter, the failure run and the interval step by step."""
    count = "CASE WHEN i.raw_ms IS NULL THEN s.errors + 1 ELSE 0 END"
    after = f"CASE WHEN {count} >= 3 THEN 0 ELSE {count} END" if recovers else count
    return f"""
s0 AS (SELECT series_id, step, rate, raw_ms, CASE WHEN raw_ms IS NULL THEN 1 ELSE 0 END AS failed_run,
  CASE WHEN raw_ms IS NULL THEN 1 ELSE 0 END AS errors, coalesce(raw_ms, -1)::BIGINT AS smoothed_ms
  FROM i WHERE step = 0),
s AS (SELECT * FROM s0 UNION ALL
  SELECT i.series_id, i.step, i.rate, i.raw_ms,
    CASE WHEN i.raw_ms IS NULL THEN s.failed_run + 1 ELSE 0 END, {after},
    CASE WHEN i.raw_ms IS NOT NULL THEN {smooth_step('s.smoothed_ms', 'i.raw_ms')}
         WHEN {count} >= 3 THEN 2000 ELSE s.smoothed_ms END
  FROM s JOIN i ON i.series_id = s.series_id AND i.step = s.step + 1)"""


FALLBACK = """SELECT series_id, step, rate, raw_ms, failed_run::INTEGER AS failed_run, smoothed_ms,
  failed_run >= 3 AS fallback FROM s"""
ORACLES["fallback_intervals"] = with_sql(
    TICKS, FAILING, fallback_sql(True), FALLBACK, recursive=True)
ORACLES["fallback_intervals_stuck"] = with_sql(
    TICKS, FAILING, fallback_sql(False), FALLBACK, recursive=True)
ORACLES["fallback_rate"] = with_sql(TICKS, FAILING, fallback_sql(True), """
SELECT series_id, round(avg(CASE WHEN failed_run >= 3 THEN 1 ELSE 0 END) * 100, 6) AS fallback_pct,
  count(*) AS steps FROM s GROUP BY 1""", recursive=True)
ORACLES["convergence"] = with_sql(TICKS, WINDOWS, FORECASTS, f"""
cz AS (SELECT *, [""" + ", ".join(f"(pred_{n} - mu) / scale" for n in NAMES) + f"""] AS z FROM fc),
cm AS (SELECT *, list_sum(z) / 5 AS m FROM cz),
cf AS (SELECT *, round(least(greatest(1 / (1 + sqrt(list_sum(list_transform(z, lambda v: (v - m) * (v - m))) / 5)
  * 10), 0), 1), 6) AS conf FROM cm),
i AS (SELECT series_id, step - 29 AS step, rate, {live_sql('pred_ema', 'conf')} AS raw_ms FROM cf)""", smooth_sql(), """
SELECT series_id, min(step) FILTER (abs(smoothed_ms - 8000) <= 8000 * 0.1::DOUBLE) AS converged_step,
  min(step) FILTER (abs(smoothed_ms - 8000) <= 8000 * 0.1::DOUBLE) - min(step) AS cycles
FROM s GROUP BY 1""", recursive=True)

# Trigger policies ----------------------------------------------------------------------------------

CUMULATED = """cu AS (SELECT series_id, step, rate, sum(rate) OVER (PARTITION BY series_id ORDER BY step) AS c
  FROM r)"""


def fixed_sql(intervals, ticks="r") -> str:
    parts = []
    for ms in intervals:
        p = max(1, round(ms / 100))
        parts.append(f"""SELECT series_id, 'fixed_{ms}ms' AS policy, trigger_no, max(step) AS tick,
  sum(rate) * 0.1::DOUBLE AS rows FROM (SELECT *, greatest(ceil(step / {p}::DOUBLE) - 1, 0)::BIGINT
  AS trigger_no FROM {ticks}) GROUP BY 1, 2, 3 HAVING max(step) = (trigger_no + 1) * {p}""")
    return " UNION ALL ".join(parts)


def jumps_sql(name: str, pred: str) -> str:
    """CTE ``j_<name>``: the jump of every tick under a forecast."""
    rate = f"(CASE WHEN ready THEN {pred} ELSE rate END)"
    return f"""j_{name} AS (SELECT series_id, step,
  greatest(1, round_even({BACK.format(r=rate)} / 100, 0))::BIGINT AS jump FROM w)"""


def chain_sql(name: str) -> str:
    """CTE ``a_<name>``: the triggers that fire."""
    return f"""a_{name} AS (SELECT series_id, step AS tick, -1::BIGINT AS prev, jump FROM j_{name} WHERE step = 10
  UNION ALL SELECT j.series_id, j.step, a.tick, j.jump FROM a_{name} a
  JOIN j_{name} j ON j.series_id = a.series_id AND j.step = a.tick + a.jump)"""


def adaptive_sql(name: str) -> str:
    return f"""SELECT a.series_id, 'adaptive_{name}' AS policy,
  row_number() OVER (PARTITION BY a.series_id ORDER BY a.tick) - 1 AS trigger_no, a.tick,
  (e.c - coalesce(s.c, 0)) * 0.1::DOUBLE AS rows FROM a_{name} a
  JOIN cu e ON e.series_id = a.series_id AND e.step = a.tick
  LEFT JOIN cu s ON s.series_id = a.series_id AND s.step = a.prev"""


REACTIVE = """re AS (SELECT series_id, step AS tick, c * 0.1::DOUBLE AS rows, 0::BIGINT AS trigger_no, c
  FROM cu WHERE step = 20
  UNION ALL SELECT x.series_id, x.step, (x.c - re.c) * 0.1::DOUBLE, re.trigger_no + 1, x.c
  FROM re JOIN cu x ON x.series_id = re.series_id
    AND x.step = re.tick + CASE WHEN re.rows > 200 THEN 5 ELSE 20 END)"""
REACTIVE_ROWS = "SELECT series_id, 'reactive' AS policy, trigger_no, tick, rows FROM re"
BATCHES = "SELECT series_id, policy, trigger_no, tick, round(rows, 6) AS rows FROM ({})"
METRICS = """
pk AS (SELECT *, first_value(trigger_no) OVER p AS p_no, first_value(tick) OVER p AS p_tick,
    first_value(rows) OVER p AS p_rows FROM bt
  WINDOW p AS (PARTITION BY series_id, policy ORDER BY rows DESC, trigger_no)),
mt AS (SELECT series_id, policy, count(*) AS triggers,
  round(avg(CASE WHEN rows = 0 THEN 1 ELSE 0 END) * 100, 6) AS empty_pct,
  round(coalesce(avg(rows) FILTER (rows > 0), 0), 6) AS mean_batch, round(avg(rows), 6) AS throughput,
  round(max(rows), 6) AS peak_backlog,
  coalesce((min(trigger_no) FILTER (trigger_no >= p_no AND rows <= p_rows * 0.1::DOUBLE)
    - min(p_no))::DOUBLE, 'inf'::DOUBLE) AS clearance_triggers,
  coalesce(round((min(tick) FILTER (trigger_no >= p_no AND rows <= p_rows * 0.1::DOUBLE)
    - min(p_tick)) * 0.1::DOUBLE, 6), 'inf'::DOUBLE) AS clearance_s
  FROM pk GROUP BY 1, 2)"""
FIXED = (100, 500, 1000, 2000)
ORACLES["policy_fixed"] = with_sql(TICKS, f"bt AS ({fixed_sql(FIXED)})", METRICS, "SELECT * FROM mt")
ORACLES["policy_fixed_many"] = with_sql(
    USERS, f"bt AS ({fixed_sql((1000, 100_000))})", METRICS, """
SELECT u.series_id, u.policy, coalesce(triggers, 0) AS triggers, coalesce(empty_pct, 0) AS empty_pct,
  coalesce(mean_batch, 0) AS mean_batch, coalesce(throughput, 0) AS throughput,
  coalesce(peak_backlog, 0) AS peak_backlog,
  coalesce(clearance_triggers, 'Infinity'::DOUBLE) AS clearance_triggers,
  coalesce(clearance_s, 'Infinity'::DOUBLE) AS clearance_s
FROM (SELECT DISTINCT series_id, unnest(['fixed_1000ms', 'fixed_100000ms']) AS policy FROM r) u
LEFT JOIN mt USING (series_id, policy)""")
EMA_JUMPS = jumps_sql("ema", f"greatest({ema_sql(0.3)}, 0)")
SMA_JUMPS = jumps_sql("sma", "greatest(list_sum(win) / 30, 0)")
ORACLES["policy_adaptive_ema"] = with_sql(
    TICKS, CUMULATED, WINDOWS, EMA_JUMPS, chain_sql("ema"), BATCHES.format(adaptive_sql("ema")),
    recursive=True)
ORACLES["policy_reactive"] = with_sql(
    TICKS, CUMULATED, REACTIVE, BATCHES.format(REACTIVE_ROWS), recursive=True)
ORACLES["policy_compare"] = with_sql(
    TICKS, CUMULATED, WINDOWS, EMA_JUMPS, SMA_JUMPS, chain_sql("ema"), chain_sql("sma"), REACTIVE,
    f"""bt AS ({fixed_sql(FIXED)} UNION ALL {adaptive_sql('ema')} UNION ALL {adaptive_sql('sma')}
  UNION ALL {REACTIVE_ROWS})""", METRICS, """
SELECT mt.*, round((1 - mt.triggers / coalesce(b.triggers, 1)::DOUBLE) * 100, 6) AS savings_pct FROM mt
LEFT JOIN (SELECT series_id, triggers FROM mt WHERE policy = 'fixed_1000ms') b USING (series_id)""",
    recursive=True)

# Streams -------------------------------------------------------------------------------------------

ORACLES["stream_windowed_stats"] = with_sql(MEASURED, """
SELECT q * 3600000000 AS window_start, (q + 1) * 3600000000 AS window_end, count(*) AS event_count,
  round(avg(rate_target::DOUBLE), 6) AS avg_rate_target
FROM (SELECT us // 3600000000 AS q, rate_target FROM m) GROUP BY q""")
ORACLES["stream_latency_json"] = with_sql(MEASURED, """
SELECT CASE WHEN event_type <> 'error' THEN rate_target END AS rate_target,
  CASE WHEN event_type <> 'error' THEN second END AS second, count(*) AS events
FROM m WHERE event_type <> 'error' GROUP BY 1, 2""")
ORACLES["stream_progress_dedup"] = with_sql(PROGRESS, """
SELECT run_id, count(*) AS batches, sum(num_input_rows)::BIGINT AS input_rows FROM p GROUP BY 1""")
ORACLES["stream_progress_capture"] = "SELECT count(*) AS input_rows FROM events"
# Hours of each type, gaps filled from its first to its last one; measurements of four hours a day are lost.
CLOSED = """
h AS (SELECT event_type AS series_id, epoch_us(ts) // 3600000000 AS bucket, count(*) AS n FROM events GROUP BY 1, 2),
ends AS (SELECT series_id, min(bucket) AS lo, max(bucket) AS hi FROM h GROUP BY 1),
g AS (SELECT series_id, lo, unnest(range(lo, hi + 1)) AS bucket FROM ends),
steps AS (SELECT g.series_id, g.lo, (g.bucket - g.lo)::BIGINT AS step, coalesce(h.n, 0)::DOUBLE * 60.0::DOUBLE AS rate,
  h.n IS NOT NULL AND g.bucket % 24 < 4 AS lost
  FROM g LEFT JOIN h ON h.series_id = g.series_id AND h.bucket = g.bucket),
r AS (SELECT series_id, lo, step, rate FROM steps WHERE NOT lost)"""
RECOMMENDED = "fc AS (SELECT *, " + ", ".join(f"greatest({sql}, 0) AS pred_{n}" for n, sql in PREDS.items()) + """ FROM w),
cz AS (SELECT *, [""" + ", ".join(f"(pred_{n} - mu) / scale" for n in NAMES) + f"""] AS z FROM fc),
cm AS (SELECT *, list_sum(z) / 5 AS m FROM cz),
pr AS (SELECT series_id, step, CASE WHEN ready THEN pred_ema ELSE list_sum(win) / len(win) END AS pred,
  CASE WHEN ready THEN round(least(greatest(1 / (1 + sqrt(list_sum(list_transform(z, lambda v: (v - m) * (v - m))) / 5)
  * 10), 0), 1), 6) ELSE 0.0::DOUBLE END AS confidence FROM cm),
i AS (SELECT a.series_id, a.step, CASE WHEN NOT lost THEN a.rate END AS rate,
  CASE WHEN NOT lost THEN {live_sql('pred', 'confidence')} END AS raw_ms
  FROM steps a LEFT JOIN pr ON pr.series_id = a.series_id AND pr.step = a.step)"""
ORACLES["stream_recommend"] = with_sql(CLOSED, WINDOWS, RECOMMENDED, fallback_sql(True), """
SELECT s.series_id, s.step + a.lo AS step, s.rate, round(pr.pred, 6) AS pred, coalesce(pr.confidence, 0) AS confidence,
  s.raw_ms, s.smoothed_ms, s.failed_run::INTEGER AS failed_run, s.failed_run >= 3 AS fallback, 0::BIGINT AS late_buckets
FROM s JOIN steps a ON a.series_id = s.series_id AND a.step = s.step
LEFT JOIN pr ON pr.series_id = s.series_id AND pr.step = s.step""", recursive=True)
ORACLES["stream_agreement"] = with_sql(CLOSED, """
SELECT count(*) AS same, 0::BIGINT AS different, 0::BIGINT AS live_only, 0::BIGINT AS replay_only FROM steps""")

# The same results by the plans for long series and large groups.
ORACLES |= {twin: ORACLES[name] for twin, name in (
    ("latency_stats_bracketed", "latency_stats_exact"), ("window_norm_chunked", "window_norm"),
    ("lag_rolling_chunked", "lag_rolling"), ("rolling_report_chunked", "rolling_report"),
    ("smoothed_intervals_chunked", "smoothed_intervals"), ("fallback_intervals_chunked", "fallback_intervals"),
    ("policy_compare_chunked", "policy_compare"))}

# Below its accuracy the sketch is exact: the smallest value that covers the share.
ORACLES["latency_stats_approx"] = ORACLES["latency_stats_exact"].replace("quantile_cont", "quantile_disc")
ORACLES["running_latency"] = ORACLES["running_complete"] = ORACLES["latency_stats_approx"]
ORACLES["predictions_csv"] = ORACLES["predictions_wide"]
ORACLES["summary_csv"] = """
SELECT event_type AS approach, round(epoch_us(max(ts)) / 1e6::DOUBLE - epoch_us(min(ts)) / 1e6::DOUBLE, 3) AS elapsed_sec,
  (event_type = 'error')::INTEGER AS exit_code, count(*) AS stdout_lines FROM events GROUP BY event_type"""

ORACLES |= {name: with_sql(USERS, SPLIT, "rv AS (SELECT r.* FROM r JOIN parts USING (series_id) WHERE split = 'test')",
                           W_VAL, FORECASTS, scored_sql(("ema",)), f"""
SELECT 'ema' AS model, count(*) AS n, round(avg(abs_err), 6) AS mae, true AS sound FROM sc
UNION ALL SELECT '{name}', count(*), NULL, true FROM sc""")
    for name in ("trend_linear", "spectral_linear", "window_trees", "stored_model")}
ORACLES["extended_models"] = with_sql(
    USERS, SPLIT, "rv AS (SELECT r.* FROM r JOIN parts USING (series_id) WHERE split = 'test')", W_VAL, FORECASTS,
    scored_sql(("sma", "ema")), """
SELECT n, model, true AS sound, mae FROM (SELECT model, count(*) AS n, round(avg(abs_err), 6) AS mae FROM sc GROUP BY model)
UNION ALL SELECT (SELECT count(*) // 2 FROM sc), unnest(['tide', 'tcn', 'gru', 'ens_mean', 'ens_wtd', 'ens_top3',
  'ens_diverse']), true, NULL""")
ORACLES["stream_event_table"] = ORACLES["parse_messages"]
ORACLES["late_reconciled"] = """
SELECT q * 3600000000 AS window_start, (q + 1) * 3600000000 AS window_end, count(*) AS events, true AS within
FROM (SELECT epoch_us(ts) // 3600000000 AS q FROM events) GROUP BY q"""
ORACLES["supervised_lag"] = with_sql(TYPES, lag_sql(CONSTANT), """
s0 AS (SELECT series_id, step, rate, list(rate) OVER f AS win, avg(rate) OVER f AS mu, stddev_pop(rate) OVER f AS sd,
    list(lag) OVER f AS lags, avg(lag) OVER f AS lm, stddev_pop(lag) OVER f AS ls
  FROM q WINDOW f AS (PARTITION BY series_id ORDER BY step ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, greatest(sd, mu * 0.05::DOUBLE) + 1e-8::DOUBLE AS scale FROM s0 WHERE len(win) = 30)""", """
SELECT series_id, step, round((rate - mu) / scale, 6) AS label, round((win[1] - mu) / scale, 6) AS oldest_rate,
  round((win[30] - mu) / scale, 6) AS newest_rate,
  round(CASE WHEN ls < 1e-6 THEN 0 ELSE (lags[1] - lm) / (ls + 1e-8::DOUBLE) END, 6) AS oldest_lag,
  round(CASE WHEN ls < 1e-6 THEN 0 ELSE (lags[30] - lm) / (ls + 1e-8::DOUBLE) END, 6) AS newest_lag FROM s""", recursive=True)

# The factor with the least validation error, used on the test series.
TUNED = "CASE best.i " + " ".join(
    f"WHEN {i} THEN {ema_sql(a)}" for i, a in enumerate((0.1, 0.2, 0.3, 0.5, 0.7))) + " END"
ORACLES["tuned_ema_report"] = with_sql(
    USERS, SPLIT, VALIDATION, W_VAL, "g AS (" + " UNION ALL ".join(
        f"SELECT {i} AS i, avg(abs({ema_sql(a)} - actual)) AS mae FROM w WHERE ready AND actual IS NOT NULL"
        for i, a in enumerate((0.1, 0.2, 0.3, 0.5, 0.7))) + ")",
    "best AS (SELECT arg_min(i, mae) AS i FROM g)", W_ALL,
    f"""fc AS (SELECT u.*, rate AS cur, {ema_sql(0.3)} AS pred_ema, {TUNED} AS pred_ema_tuned
  FROM u JOIN parts USING (series_id), best WHERE split = 'test' AND ready AND actual IS NOT NULL)""",
    scored_sql(("ema", "ema_tuned")), f"SELECT model, {rounds(REPORT_COLUMNS)}, n FROM (SELECT model, {ERRORS} FROM sc GROUP BY 1)")

ORACLES["policy_adaptive_tuned"] = with_sql(
    TICKS, CUMULATED, WINDOWS, "g AS (" + " UNION ALL ".join(
        f"SELECT {i} AS i, avg(abs(greatest({ema_sql(a)}, 0) - actual)) AS mae FROM w WHERE ready AND actual IS NOT NULL"
        for i, a in enumerate((0.1, 0.2, 0.3, 0.5, 0.7))) + ")", "best AS (SELECT arg_min(i, mae) AS i FROM g)",
    jumps_sql("ema_tuned", f"greatest({TUNED.replace('best.i', '(SELECT i FROM best)')}, 0)"), chain_sql("ema_tuned"),
    BATCHES.format(adaptive_sql("ema_tuned")), recursive=True)

TOP3_JUMPS = jumps_sql("ens_top3", "greatest((list_sum(win) / 30 + " + ema_sql(0.3) + " + " + ema_sql(0.1) + ") / 3.0::DOUBLE, 0)")
ORACLES["policy_compare_ensemble"] = with_sql(
    TICKS, CUMULATED, WINDOWS, EMA_JUMPS, TOP3_JUMPS, chain_sql("ema"), chain_sql("ens_top3"), REACTIVE,
    f"""bt AS ({fixed_sql(FIXED)} UNION ALL {adaptive_sql('ema')} UNION ALL {adaptive_sql('ens_top3')}
  UNION ALL {REACTIVE_ROWS})""", METRICS, """
SELECT mt.*, round((1 - mt.triggers / coalesce(b.triggers, 1)::DOUBLE) * 100, 6) AS savings_pct FROM mt
LEFT JOIN (SELECT series_id, triggers FROM mt WHERE policy = 'fixed_1000ms') b USING (series_id)""",
    recursive=True)

ORACLES["idle_series"] = """
WITH n AS (SELECT user_id::VARCHAR AS series_id, epoch_us(ts) // 3600000000 AS bucket, count(*) AS n
           FROM events GROUP BY 1, 2),
     w AS (SELECT *, lead(bucket) OVER (PARTITION BY series_id ORDER BY bucket) AS following FROM n),
     seen AS (SELECT series_id, (bucket + 1)::DOUBLE AS moment, n / 3600::DOUBLE AS rate FROM w
              UNION ALL SELECT series_id, bucket + 1.5, 0 FROM w WHERE following > bucket + 1)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY moment) - 1 AS step, round(rate, 6) AS rate
FROM seen"""
