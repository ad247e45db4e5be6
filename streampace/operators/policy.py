"""Back-tests of trigger policies on recorded tick traces.

A trace is a rate series whose steps are ticks of ``tick_ms``. A policy cuts it into batches
``(series_id, policy, trigger_no, tick, rows)``; :func:`policy_metrics` summarises them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streampace.functions.intervals import BACKTEST, IntervalRule, interval_ms, ticks_of
from streampace.operators.features import K, over_frame, with_window
from streampace.operators.forecast import Forecaster, predict_all
from streampace.plans import chunks, folds
from streampace.plans.chunks import CHUNK, CHUNK_SIZE
from streampace.plans.durable import durable

TICK_MS = 100
FIRST_TRIGGER_MS = 1000
FIXED_INTERVALS_MS = (100, 500, 1000, 2000)   # fixed values of the published comparison
BASELINE = "fixed_1000ms"
BATCH_COLUMNS = ("series_id", "policy", "trigger_no", "tick", "rows")


def _half_even_ticks(interval: float, tick_ms: int) -> int:
    return max(1, round(interval / tick_ms))


def fixed_batches(trace: DataFrame, intervals: Sequence[int], tick_ms: int = TICK_MS) -> DataFrame:
    """Batches of fixed-interval triggers, all intervals in one pass.

    A trigger fires every ``p`` ticks and takes the ticks since the one before; the first batch has
    one tick more. The batch of a tick is arithmetic, so this is a plain aggregation. An unfinished
    last batch is dropped.
    """
    plans = F.array(*[
        F.struct(F.lit(f"fixed_{ms}ms").alias("policy"),
                 F.lit(_half_even_ticks(ms, tick_ms)).cast("long").alias("p"))
        for ms in intervals])
    placed = trace.select("series_id", "step", "rate", F.explode(plans).alias("_plan")).select(
        "series_id", "step", "rate", "_plan.policy", "_plan.p")
    number = F.greatest(F.ceil(F.col("step") / F.col("p")) - 1, F.lit(0).cast("long"))
    return (
        placed.groupBy("series_id", "policy", "p", number.alias("trigger_no"))
        .agg(F.sum("rate").alias("_rate"), F.max("step").alias("tick"))
        .filter(F.col("tick") == (F.col("trigger_no") + 1) * F.col("p"))
        .select("series_id", "policy", "trigger_no", "tick",
                (F.col("_rate") * (tick_ms / 1000)).alias("rows"))
    )


def _chunk_chains(ticks: DataFrame, widths: Sequence[int], size: int) -> DataFrame:
    """Stored pointers of every chunk of every trace and policy: ``series_id, policy, _chunk, _initial, rates, next``.

    Tick ``i`` of a chunk of ``n``, reached in mode ``m``, is node ``m * n + i``. ``next`` names the node of the trigger
    after it. Beyond the chunk it is ``modes * n`` plus the state in which the next chunk is entered:
    ``sum(widths[:mode])`` plus the tick counted from that chunk's beginning.
    """
    bases = F.array(*[F.lit(int(b)) for b in np.concatenate(([0], np.cumsum(widths)[:-1]))])
    whole = chunks.with_chunk(ticks, size).groupBy("series_id", "_source", CHUNK).agg(
        F.array_sort(F.collect_list(F.struct("step", "rate", "plans"))).alias("ticks")
    ).withColumn("n", F.size("ticks"))
    each = whole.select("series_id", CHUNK, "n", F.col("ticks.rate").alias("rates"), "ticks",
                        F.posexplode(F.col("ticks")[0]["plans"]).alias("p", "plan")).select(
        "series_id", F.col("plan.policy").alias("policy"), CHUNK, F.col("plan._initial").alias("_initial"), "n", "rates",
        F.transform("ticks", lambda t: t["plans"][F.col("p")]).alias("plans"))

    def pointers(m: int) -> Column:
        def after(t: Column, i: Column) -> Column:
            then, mode = i + t[f"_jump{m}"], t[f"_mode{m}"]
            return F.when(then < F.col("n"), mode * F.col("n") + then).otherwise(
                F.col("n") * (len(widths) - 1) + F.element_at(bases, mode + 1) + then)
        return F.transform("plans", after)

    return durable(each.select("series_id", "policy", CHUNK, "_initial", "rates", F.concat(
        *[pointers(m) for m in range(len(widths))]).alias("next")), "chains")


def _doubled(pointers: Column, inside: Column) -> Column:
    """Pointers of twice the length; those that have left the chunk stay."""
    return F.transform(pointers, lambda x: F.when(x < inside, F.element_at(pointers, x + 1)).otherwise(x))


def _leaving(next_: Column, rounds: Column) -> Column:
    """Where the chain from each node leaves the chunk."""
    return F.aggregate(F.sequence(F.lit(1), rounds), next_, lambda p, _: _doubled(p, F.size(p)))


def _entering(chains: DataFrame, widths: Sequence[int], size: int) -> DataFrame | None:
    """State in which each chunk that follows another one is entered; None if no trace has two."""
    keys = ["series_id", "policy"]
    later = F.lead(CHUNK).over(Window.partitionBy(*keys).orderBy(CHUNK))
    held = chains.select(*keys, CHUNK).withColumn("_next", later).filter("_next IS NOT NULL")
    if held.isEmpty():
        return None
    inside, n = F.size("next"), F.size("rates")
    bases = [int(b) for b in np.concatenate(([0], np.cumsum(widths)))]
    left = _leaving(F.col("next"), _rounds(n)).alias("leave")

    def state(m: int) -> Column:
        def ends(offset: Column) -> Column:
            return F.when(offset < n, F.element_at("leave", offset + 1 + n * m) - inside).otherwise(offset - n + bases[m])
        return F.transform(F.sequence(F.lit(0), F.lit(widths[m] - 1)), ends)

    maps = chains.join(held, [*keys, CHUNK]).select("*", left).select(
        *keys, CHUNK, "_next", "_initial", F.sequence(F.lit(0), F.lit(bases[-1] - 1)).cast("array<bigint>").alias("starts"),
        F.concat(*[state(m) for m in range(len(widths))]).cast("array<bigint>").alias("ends"))
    return folds.chained(durable(maps, "maps"), keys, folds.dense_pairs)


def _rounds(n: Column) -> Column:
    """Doublings after which a pointer over ``n`` ticks has left them."""
    return F.ceil(F.log2(n.cast("double"))).cast("int") + 1


def _batch_parts(chains: DataFrame, entering: DataFrame | None, widths: Sequence[int], size: int) -> DataFrame:
    """``series_id, policy, tick, rate, closed``: the rates of each batch in each chunk, and whether its trigger is there.

    From the entering state on, the triggers of a chunk double with each doubling of the pointers; only they are marked.
    """
    keys = ["series_id", "policy"]
    n, inside = F.size("rates"), F.size("next")
    bases = [int(b) for b in np.cumsum([0, *widths])]
    if entering is None:
        known = chains.withColumn("_state", F.col("_initial"))
    else:
        known = chains.join(entering, [*keys, CHUNK], "left").withColumn("_state", F.coalesce("_enter", "_initial"))
    mode, offset = F.lit(0), F.col("_state").cast("int")
    for m in range(1, len(widths)):
        later = F.col("_state") >= bases[m]
        mode, offset = F.when(later, m).otherwise(mode), F.when(later, (F.col("_state") - bases[m]).cast("int")).otherwise(offset)
    at = known.withColumns({"_mode": mode, "_offset": offset}).withColumn(
        "_found", F.when(F.col("_offset") < n, F.array(F.col("_mode") * n + F.col("_offset"))).otherwise(F.array().cast("array<int>")))

    def further(a: Column, _: Column) -> Column:
        ahead = F.filter(F.transform(a["found"], lambda x: F.element_at(a["next"], x + 1)), lambda x: x < inside)
        return F.struct(_doubled(a["next"], inside).alias("next"), F.concat(a["found"], ahead).alias("found"))

    begin = F.struct(F.col("next"), F.col("_found").alias("found"))
    walked = at.withColumn("_walk", F.aggregate(F.sequence(F.lit(1), _rounds(n)), begin, further)).select(
        *keys, CHUNK, "rates", "_offset", F.array_sort(F.transform("_walk.found", lambda x: x % n)).alias("at"),
        F.when(F.size("_found") > 0, F.element_at("_walk.next", F.element_at("_found", 1) + 1) - inside).alias("out"))
    # The trigger after the last one: where the state in which the next chunk is entered says.
    beyond = F.col("out")
    for m in range(1, len(widths)):
        beyond = F.when(F.col("out") >= bases[m], F.col("out") - bases[m]).otherwise(beyond)
    opened = F.coalesce(n + beyond, F.col("_offset"))
    ends = F.concat("at", F.array(opened.cast("int")))

    def part(end: Column, i: Column) -> Column:
        start = F.when(i > 0, F.element_at(F.col("at"), F.greatest(i, F.lit(1))) + 1).otherwise(0)
        length = F.least(end + 1, n) - start
        rate = F.aggregate(F.slice("rates", start + 1, F.greatest(length, F.lit(0))), F.lit(0.0), lambda a, r: a + r)
        return F.struct((F.col(CHUNK) * size + end).alias("tick"), rate.alias("rate"), (i < F.size("at")).alias("closed"))

    return walked.select(*keys, F.inline(F.transform(ends, part)))


def _chain_batches(ticks: DataFrame, widths: Sequence[int], tick_ms: int,
                   size: int) -> DataFrame:
    """Follow the trigger chain of each trace and policy and sum the ticks of each batch.

    ``ticks`` has, per policy of ``plans`` and for every mode ``m`` in which a trigger can be reached, the ticks to the
    next one (``_jump{m}``, at most ``widths[m]``) and the mode that one is reached in (``_mode{m}``). Chains
    start in mode 0 at tick ``_initial``, which is less than ``widths[0]``. Traces begin at step 0.
    """
    if max(widths) > size:
        raise ValueError(f"a jump of {max(widths)} ticks exceeds the chunk size {size}")
    chains = _chunk_chains(ticks, widths, size)
    parts = _batch_parts(chains, _entering(chains, widths, size), widths, size)
    batches = parts.groupBy("series_id", "policy", "tick").agg(
        F.sum("rate").alias("rate"), F.max("closed").alias("closed")).filter("closed")
    return chunks.numbered(
        batches.select("series_id", "policy", "tick", (F.col("rate") * (tick_ms / 1000)).alias("rows")),
        "trigger_no", ("series_id", "policy"), "tick", size).select(*BATCH_COLUMNS)


def _plan(name: str, first: int, jumps: Sequence[tuple[Column, Column]]) -> Column:
    fields = [F.lit(name).alias("policy"), F.lit(first).cast("long").alias("_initial")]
    for m, (jump, mode) in enumerate(jumps):
        fields += [jump.cast("int").alias(f"_jump{m}"), mode.cast("int").alias(f"_mode{m}")]
    return F.struct(*fields)


def _ticks(rows: DataFrame, plans: Sequence[Column], source: str) -> DataFrame:
    """One row per tick with what each policy would do there."""
    return rows.select("series_id", "step", "rate", F.array(*plans).alias("plans"), F.lit(source).alias("_source"))


def _adaptive_ticks(trace: DataFrame, models: Sequence[str | Forecaster], tick_ms: int, k: int,
                    rule: IntervalRule, modes: int, size: int) -> DataFrame:
    windows = predict_all(with_window(trace, k, "lag" in trace.columns, size=size), models, k)
    first = _half_even_ticks(FIRST_TRIGGER_MS, tick_ms)
    plans = []
    for model in models:
        name = model if isinstance(model, str) else model.name
        forecast = F.when(F.col("ready"), F.col(f"pred_{name}")).otherwise(F.col("rate"))
        jump = ticks_of(interval_ms(forecast, rule=rule), tick_ms)
        plans.append(_plan(f"adaptive_{name}", first, [(jump, F.lit(0))] * modes))
    return _ticks(windows, plans, "adaptive")


def _adaptive_width(tick_ms: int, rule: IntervalRule) -> int:
    return max(_half_even_ticks(rule.max_ms, tick_ms),
               _half_even_ticks(FIRST_TRIGGER_MS, tick_ms) + 1)


def adaptive_batches(trace: DataFrame, models: str | Forecaster | Sequence[str | Forecaster],
                     tick_ms: int = TICK_MS, k: int = K, rule: IntervalRule = BACKTEST,
                     size: int = CHUNK_SIZE) -> DataFrame:
    """Batches of policies that set each interval from a forecast, one policy per model.

    The first trigger is one second in. At a trigger the forecast from the last ``k`` ticks (the
    current rate while there are fewer) gives the interval to the next. Forecasts and jumps of all
    ticks are computed side by side; only following the jumps is ordered. Traces begin at step 0.
    """
    chosen = [models] if isinstance(models, (str, Forecaster)) else list(models)
    ticks = _adaptive_ticks(trace, chosen, tick_ms, k, rule, 1, size)
    return _chain_batches(ticks, [_adaptive_width(tick_ms, rule)], tick_ms, size)


def _reactive_ticks(trace: DataFrame, threshold: float, spans: Sequence[int], tick_ms: int,
                    size: int) -> DataFrame:
    def sums(_, order) -> dict[str, Column]:
        cols = {f"_sum{m}": F.sum("rate").over(order.rowsBetween(-(p - 1), 0))
                for m, p in enumerate(spans)}
        # The very first batch holds one tick more.
        cols["_opening"] = F.sum("rate").over(order.rowsBetween(-spans[0], 0))
        return cols

    summed = over_frame(trace, -spans[0], 0, sums, size).withColumn(
        "_sum0", F.when(F.col("step") == spans[0], F.col("_opening")).otherwise(F.col("_sum0")))
    jumps = []
    for m in (0, 1):
        burst = F.col(f"_sum{m}") * (tick_ms / 1000) > threshold
        jumps.append((F.when(burst, spans[1]).otherwise(spans[0]), F.when(burst, 1).otherwise(0)))
    return _ticks(summed, [_plan("reactive", spans[0], jumps)], "reactive")


def _reactive_spans(normal_ms: int, burst_ms: int, tick_ms: int) -> list[int]:
    return [_half_even_ticks(normal_ms, tick_ms), _half_even_ticks(burst_ms, tick_ms)]


def reactive_batches(trace: DataFrame, threshold: float = 200.0, normal_ms: int = 2000,
                     burst_ms: int = 500, tick_ms: int = TICK_MS,
                     size: int = CHUNK_SIZE) -> DataFrame:
    """Batches of a policy that shortens the interval after a batch above ``threshold`` rows.

    It reacts one batch late: the batch that shows the burst was still cut at the old interval. A
    trigger reached in either mode has summed that mode's number of ticks, so the next jump follows
    from two rolling sums, and the chain has two modes.
    """
    spans = _reactive_spans(normal_ms, burst_ms, tick_ms)
    ticks = _reactive_ticks(trace, threshold, spans, tick_ms, size)
    return _chain_batches(ticks, [spans[0] + 1, spans[1]], tick_ms, size)


def policy_metrics(batches: DataFrame, tick_ms: int = TICK_MS,
                   expected: DataFrame | None = None, size: int = CHUNK_SIZE) -> DataFrame:
    """One row per trace and policy.

    ``triggers``, ``empty_pct``, ``mean_batch`` (of non-empty ones), ``throughput`` (rows per trigger),
    ``peak_backlog``, ``clearance_triggers`` and ``clearance_s``: how many triggers, and seconds, from
    the first peak to the first batch of at most a tenth of it; infinite if there is none. Pairs of
    ``expected`` ``(series_id, policy)`` without batches get zeros and infinity.
    """
    keys = ("series_id", "policy")
    peaked = chunks.attach_carry(
        chunks.with_chunk(batches, size, "trigger_no"),
        {"_top": F.min(F.struct((-F.col("rows")).alias("neg"), "trigger_no", "tick"))},
        lambda _, whole: {"_peak": F.min("_top").over(whole)}, keys)
    cleared = (F.col("trigger_no") >= F.col("_peak.trigger_no")) & (
        F.col("rows") <= -F.col("_peak.neg") * 0.1)
    infinite = F.lit(float("inf"))
    metrics = peaked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("triggers"),
        (F.avg(F.when(F.col("rows") == 0, 1.0).otherwise(0.0)) * 100).alias("empty_pct"),
        F.coalesce(F.avg(F.when(F.col("rows") > 0, F.col("rows"))), F.lit(0.0)).alias("mean_batch"),
        F.avg("rows").alias("throughput"),
        F.max("rows").alias("peak_backlog"),
        F.min("_peak").alias("_p"),
        F.min(F.when(cleared, F.struct("trigger_no", "tick"))).alias("_c"),
    ).select(
        *keys, "triggers", "empty_pct", "mean_batch", "throughput", "peak_backlog",
        F.coalesce((F.col("_c.trigger_no") - F.col("_p.trigger_no")).cast("double"), infinite)
        .alias("clearance_triggers"),
        F.coalesce((F.col("_c.tick") - F.col("_p.tick")) * (tick_ms / 1000), infinite)
        .alias("clearance_s"),
    )
    if expected is None:
        return metrics
    values = {c: 0 for c in ("triggers", "empty_pct", "mean_batch", "throughput", "peak_backlog")}
    values |= {"clearance_triggers": float("inf"), "clearance_s": float("inf")}
    return expected.select(*keys).join(metrics, list(keys), "left").fillna(values)


def savings_vs(metrics: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Add ``savings_pct``: triggers saved against the baseline policy of the same trace.

    A missing or empty baseline counts as one trigger.
    """
    base = F.max(F.when(F.col("policy") == baseline, F.col("triggers"))).over(
        Window.partitionBy("series_id"))
    floor = F.when(F.coalesce(base, F.lit(0)) == 0, F.lit(1)).otherwise(base)
    return metrics.withColumn("savings_pct", (1 - F.col("triggers") / floor) * 100)


def order_policies(metrics: DataFrame) -> DataFrame:
    """Fixed policies by name first, then the others."""
    return metrics.orderBy("series_id", ~F.col("policy").startswith("fixed"), "policy")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def compare_policies(trace: DataFrame, models: Sequence[str | Forecaster] = ("ema",),
                     intervals: Sequence[int] = FIXED_INTERVALS_MS, reactive: bool = True,
                     tick_ms: int = TICK_MS, k: int = K, size: int = CHUNK_SIZE) -> DataFrame:
    """Metrics and savings of fixed, reactive and adaptive policies on every trace.

    All policies with a trigger chain are followed in the same pass. A policy that never triggers on a
    trace keeps its row.
    """
    names = [f"fixed_{ms}ms" for ms in intervals] + [
        f"adaptive_{m if isinstance(m, str) else m.name}" for m in models] + ["reactive"] * reactive
    expected = trace.select("series_id").distinct().withColumn(
        "policy", F.explode(F.array(*[F.lit(n) for n in names])))
    parts = [fixed_batches(trace, intervals, tick_ms)] if intervals else []
    chained, widths = [], [1, 1]
    if models:
        chained.append(_adaptive_ticks(trace, models, tick_ms, k, BACKTEST, 2, size))
        widths[0] = _adaptive_width(tick_ms, BACKTEST)
    if reactive:
        spans = _reactive_spans(2000, 500, tick_ms)
        chained.append(_reactive_ticks(trace, 200.0, spans, tick_ms, size))
        widths = [max(widths[0], spans[0] + 1), spans[1]]
    if chained:
        parts.append(_chain_batches(union_all(chained), widths, tick_ms, size))
    return savings_vs(policy_metrics(durable(union_all(parts), "batches"), tick_ms, expected, size))
