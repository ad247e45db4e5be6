"""Rate series: from events to dense ``(series_id, step, rate)`` tables, and what is joined to them."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streampace.functions import rates
from streampace.plans import chunks
from streampace.plans.chunks import CHUNK, CHUNK_SIZE
from streampace.plans.durable import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, durable, stored_bytes
from streampace.plans.quantiles import exact_quantiles
from streampace.plans.ranks import dense_index

ROWS_PER_TASK = 4_000_000


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _pieces(spans: DataFrame, size: int) -> DataFrame:
    """One row per chunk that the steps ``first..last`` touch: ``step`` is the first one in it."""
    return spans.withColumn(CHUNK, F.explode(F.sequence(
        chunks.chunk_of("first", size), chunks.chunk_of("last", size)))
    ).withColumn("step", F.greatest("first", F.col(CHUNK) * size))


def series_key(keys: Sequence[str]) -> Column:
    if len(keys) == 1:
        return F.col(keys[0]).cast("string")
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys])


def bucket_counts(events: DataFrame, keys: Sequence[str], bucket_seconds: int = 3600,
                  ts: str = "ts") -> DataFrame:
    """Events per series and time bucket (an epoch number), only where there are any."""
    bucket = F.floor(F.unix_micros(ts) / F.lit(bucket_seconds * 1_000_000))
    return events.groupBy(series_key(keys).alias("series_id"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


def filled(counts: DataFrame, size: int = CHUNK_SIZE, span: str = "series") -> DataFrame:
    """``(series_id, step, n)`` for every bucket between the first and the last one of a series.

    ``span="table"`` takes the first and last bucket of the whole table for every series, which makes
    series x span rows. ``counts`` is stored. One shuffle moves the counts and one opening mark per chunk
    of a series; the zeros up to the next mark are made after it. The partition count follows from the
    buckets to be made, because adaptive execution would merge these few rows without knowing how many
    they become.
    """
    spans = counts.groupBy("series_id").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    if span == "table":
        whole = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
        spans = spans.select("series_id", whole.select("lo").scalar().alias("lo"),
                             whole.select("hi").scalar().alias("hi"))
    elif span != "series":
        raise ValueError(f"unknown span {span!r}")
    spans = durable(spans.select("series_id", "lo", F.lit(0).cast("long").alias("first"),
                                 (F.col("hi") - F.col("lo")).alias("last")), "spans")
    rows, held, size_of = spans.agg(
        F.coalesce(F.sum(F.col("last") + 1), F.lit(0)), F.count(F.lit(1)),
        F.coalesce(F.sum(F.octet_length("series_id") + 32), F.lit(0))).first()
    few = held <= BROADCAST_ROWS and size_of <= BROADCAST_BYTES
    zero = F.lit(0).cast("long").alias("n")
    known = counts.join(F.broadcast(spans) if few else spans, "series_id")
    marks = known.select("series_id", (F.col("bucket") - F.col("lo")).alias("step"), "n", "last").unionByName(
        _pieces(spans, size).select("series_id", "step", zero, "last"))
    parts = max(_partitions(counts), -(-rows // ROWS_PER_TASK))
    placed = chunks.with_chunk(marks, size).repartition(parts, "series_id", CHUNK)
    once = placed.groupBy("series_id", CHUNK, "step").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    end = F.least((F.col(CHUNK) + 1) * size, F.col("last") + 1)
    following = F.coalesce(F.lead("step").over(chunks.in_chunk()), end)
    steps = once.withColumn("_next", following - 1).withColumn(
        "_at", F.explode(F.sequence("step", "_next")))
    return steps.select("series_id", F.col("_at").alias("step"),
                        F.when(F.col("_at") == F.col("step"), F.col("n")).otherwise(zero).alias("n"))


def rates_of(counts: DataFrame, bucket_seconds: int, unit_seconds: float | None = None, size: int = CHUNK_SIZE,
             span: str = "series") -> DataFrame:
    """The series of stored :func:`bucket_counts`; see :func:`rate_series`."""
    rate = F.col("n").cast("double")
    if unit_seconds is not None:
        rate = rate * (unit_seconds / bucket_seconds)
    return filled(counts, size, span).select("series_id", "step", rate.alias("rate"))


def rate_series(events: DataFrame, keys: Sequence[str], bucket_seconds: int = 3600,
                ts: str = "ts", unit_seconds: float | None = None,
                size: int = CHUNK_SIZE, span: str = "series") -> DataFrame:
    """Events per time bucket and key; buckets without events get rate 0.

    A series covers the buckets between its own first and last event, so ``step`` is dense and one stray
    event makes one series long, not all; ``span="table"`` gives all series the span of the table.
    ``unit_seconds`` turns counts into rates per that many seconds.

    The counts, far fewer than the events, are stored in the shared folder: the time spans, the list of
    series and all operators on the result then read them, and the events are scanned once.
    """
    counts = durable(bucket_counts(events, keys, bucket_seconds, ts), "counts")
    return rates_of(counts, bucket_seconds, unit_seconds, size, span)


def reindexed(df: DataFrame, order: str, size: int = CHUNK_SIZE) -> DataFrame:
    """Replace a gapped order column by dense steps from 0, as the other operators expect."""
    return chunks.numbered(df, "step", step=order, size=size)


def with_previous(series: DataFrame, value: str = "rate", out: str = "previous",
                  size: int = CHUNK_SIZE) -> DataFrame:
    halo = chunks.with_halo(series, before=1, size=size)
    return chunks.trim(halo.withColumn(out, F.lag(value).over(chunks.in_chunk())), size)


def with_next(series: DataFrame, value: str = "rate", out: str = "actual",
              size: int = CHUNK_SIZE) -> DataFrame:
    """The value one step later; null on the last step."""
    halo = chunks.with_halo(series, after=1, size=size)
    return chunks.trim(halo.withColumn(out, F.lead(value).over(chunks.in_chunk())), size)


def with_regime(series: DataFrame, burst_above: float = 200.0, step_above: float = 50.0,
                size: int = CHUNK_SIZE) -> DataFrame:
    """Array column ``regimes`` with the tags of each step."""
    return with_previous(series, out="_previous", size=size).withColumn(
        "regimes", rates.regimes(F.col("rate"), F.col("_previous"), burst_above, step_above)
    ).drop("_previous")


def floor_rate(series: DataFrame, least: float = 1.0) -> DataFrame:
    return series.withColumn("rate", rates.floored(F.col("rate"), least))


def cap_series(series: DataFrame, max_rate: float = 2000.0,
               scaled: Sequence[str] = ("rate",), size: int = CHUNK_SIZE) -> DataFrame:
    """Scale a series so that its maximum is at most ``max_rate``, keeping its shape."""
    topped = chunks.attach_carry(
        chunks.with_chunk(series, size), {"_top": F.max("rate")},
        lambda _, whole: {"_peak": F.max("_top").over(whole)})
    scale = F.least(F.lit(1.0), F.lit(float(max_rate)) / F.greatest("_peak", F.lit(1.0)))
    return topped.withColumns({c: F.col(c) * scale for c in scaled}).drop("_peak", CHUNK)


def _visible(pieces: DataFrame, size: int) -> DataFrame:
    """Disjoint intervals ``series_id, _chunk, step, _end, shape`` of overlapping pieces ``first..last`` of a chunk.

    A sweep over the pieces' starts and ends keeps the open ones in a heap, the one that wins on top.
    """
    def sweep(part: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(part["first"].tolist(), part["last"].tolist(), part["_start"].tolist(), part["shape"].tolist(), strict=True))
        marks = sorted({f for f, *_ in rows} | {last + 1 for _, last, *_ in rows})
        rows.sort()
        # Latest start first, then the greater name: a rank that a heap of smallest values understands.
        order = {key: i for i, key in enumerate(sorted({(r[2], r[3]) for r in rows}, reverse=True))}
        open_, out, at = [], [], 0
        for mark, after in zip(marks, marks[1:], strict=False):
            while at < len(rows) and rows[at][0] <= mark:
                heapq.heappush(open_, (order[rows[at][2:]], rows[at][1], rows[at][3]))
                at += 1
            while open_ and open_[0][1] < mark:
                heapq.heappop(open_)
            if open_:
                out.append((mark, after - 1, open_[0][2]))
        return pd.DataFrame(out, columns=["step", "_end", "shape"]).assign(
            series_id=part["series_id"].iloc[0], **{CHUNK: part[CHUNK].iloc[0]})

    return pieces.select("series_id", CHUNK, F.col("step").alias("first"), F.least(
        "last", (F.col(CHUNK) + 1) * size - 1).alias("last"), "_start", "shape").groupBy("series_id", CHUNK).applyInPandas(
        sweep, f"step long, _end long, shape string, series_id string, {CHUNK} long")


def label_steps(series: DataFrame, labels: DataFrame, default: str = "noise",
                size: int = CHUNK_SIZE) -> DataFrame:
    """Shape of each step from half-open segments ``(series_id, start, end, shape)``.

    A segment that starts later wins an overlap (the greater shape name, on equal starts); steps
    outside all segments get ``default``. Segments are clipped to their series and cut at chunks, one row for each
    chunk that they touch; a sweep makes them disjoint, and then the steps of a chunk take the interval that began last,
    in one window over steps and intervals. A shape that is null counts as none.
    """
    extent = series.groupBy("series_id").agg(
        F.min("step").alias("_min"), F.max("step").alias("_max"))
    spans = labels.filter(F.col("shape").isNotNull()).join(extent, "series_id").select(
        "series_id", "shape", F.col("start").alias("_start"),
        F.greatest("start", "_min").alias("first"),
        F.least(F.col("end") - 1, F.col("_max")).alias("last"),
    ).filter("first <= last")
    marks = _visible(_pieces(spans, size), size).select(
        "series_id", CHUNK, "step", F.struct("_end", "shape").alias("_mark"), F.lit(0).alias("_kind"))
    steps = chunks.with_chunk(series.withColumn("_kind", F.lit(1)), size)
    here = Window.partitionBy("series_id", CHUNK).orderBy("step", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = steps.unionByName(marks, allowMissingColumns=True).withColumn("_seen", F.last("_mark", ignorenulls=True).over(here))
    inside = F.col("_seen._end") >= F.col("step")
    return seen.filter("_kind = 1").select(
        *[c for c in series.columns], F.when(inside, F.col("_seen.shape")).otherwise(F.lit(default)).alias("shape"))


def asof_schedule(ticks: DataFrame, schedule: Sequence[tuple[float, float]] | DataFrame,
                  elapsed: str = "elapsed", out: str = "rate_target", parts: int | None = None) -> DataFrame:
    """Last schedule entry that starts at or before ``elapsed``; before the first one, the first.

    A Python list becomes one constant expression. A table ``(start, target)`` may have any size: its rows and
    the ticks are dealt together into ranges of time with as many rows each, also where many ticks have the same time,
    and the entry valid at the beginning of a range, one for each, is carried over from the ranges before. Of
    entries with equal starts the greater target counts.
    """
    if not isinstance(schedule, DataFrame):
        first, *rest = sorted(schedule, key=lambda row: row[0])
        target = F.lit(first[1])
        for start, value in rest:
            target = F.when(F.col(elapsed) >= start, F.lit(value)).otherwise(target)
        return ticks.withColumn(out, target)

    marks = schedule.select(F.col("start").cast("double").alias("_at"), F.struct("start", "target").alias("_entry"),
                            F.lit(0).alias("_kind"))
    timed = ticks.withColumns({"_at": F.col(elapsed).cast("double"), "_kind": F.lit(1)})
    merged = timed.unionByName(marks, allowMissingColumns=True).withColumn("_tie", F.monotonically_increasing_id())
    # Stored, because sampled bounds of ranges may differ between two evaluations.
    placed = durable(merged.repartitionByRange(parts or _partitions(ticks), "_at", "_kind", "_tie").withColumn(
        "_range", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("_range").orderBy("_at", "_kind", "_entry").rowsBetween(Window.unboundedPreceding, 0)
    newest = placed.groupBy("_range").agg(F.max("_entry").alias("_newest"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition.
    carried = F.broadcast(newest.select("_range", F.last("_newest", ignorenulls=True).over(before).alias("_carry")))
    opening = schedule.agg(F.min(F.struct("start", "target")).alias("e")).select("e.target").scalar()
    return placed.withColumn("_seen", F.last("_entry", ignorenulls=True).over(here)).filter("_kind = 1").join(
        carried, "_range").withColumn(out, F.coalesce(F.col("_seen.target"), F.col("_carry.target"), opening)).drop(
        "_at", "_kind", "_entry", "_seen", "_carry", "_tie", "_range")


def rate_summary(series: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Minimum, maximum, mean and quartiles of the rates."""
    return exact_quantiles(
        series, list(by), "rate", {"p25": 0.25, "p75": 0.75},
        {"min": "min", "max": "max", "mean": "mean"})


def with_split(series: DataFrame, train: float = 0.70, validation: float = 0.15,
               ids: DataFrame | None = None) -> DataFrame:
    """Column ``split``: the first series (by id) train, the next validate, the rest test.

    Whole series go to one side, so no window of a test series is ever seen in training. ``ids`` may
    give the column ``series_id`` from a cheaper table than ``series``.
    """
    named = durable((series if ids is None else ids).select("series_id").filter("series_id IS NOT NULL").distinct(), "ids")
    few = stored_bytes(named) <= BROADCAST_BYTES and named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def sides(index: DataFrame, count: Column) -> DataFrame:
        n_train, n_val = F.floor(count * F.lit(train)), F.floor(count * F.lit(validation))
        side = F.when(F.col("_index") < n_train, "train").when(F.col("_index") < n_train + n_val, "val").otherwise("test")
        return index.select("series_id", side.alias("split"))

    if few:     # as many rows as a broadcast may have: one task numbers them
        whole = Window.partitionBy(F.lit(0))
        numbered = named.withColumns({"_index": F.row_number().over(whole.orderBy("series_id")) - 1,
                                      "_count": F.count(F.lit(1)).over(whole)})
        return series.join(F.broadcast(sides(numbered, F.col("_count"))), "series_id")
    index = dense_index(named, "series_id", "_index")
    count = index.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return series.join(broadcast_if_small(durable(sides(index, count), "parts")), "series_id")


def recent(df: DataFrame, k: int, keys: Sequence[str] = ("series_id",),
           order: str = "step") -> DataFrame:
    """The last ``k`` rows per key. The rank filter is also applied before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(newest)).filter(
        F.col("_rank") <= k).drop("_rank")
