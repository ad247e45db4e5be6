"""Exact quantiles of groups of any size, from one scan of the input.

The rows are counted by group and value, partly before they are shuffled, and the counts are stored; all else reads the
counts. Where no group has many distinct values, a running sum in order of the values finds each rank. Otherwise
the counts are dealt by ranges of (group, value), so that a large group lies in many tasks; the totals of the
ranges say which of them hold a wanted rank, and only these are summed up in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streampace.plans.durable import durable

SMALL_GROUP = 1_000_000  # distinct values up to which one task may order a group

# What can be said of a group besides its quantiles: rows, values that are not null, and of these the rest.
SUMMARIES = ("rows", "count", "mean", "min", "max")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str,
                    quantiles: Mapping[str, float],
                    extra: Mapping[str, str] | None = None,
                    small_group: int = SMALL_GROUP) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per name in ``quantiles``.

    ``extra`` names further columns and which of ``SUMMARIES`` they hold. Null values are ignored by all but ``rows``.
    """
    if not by:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, quantiles, extra,
                               small_group).drop("_all")
    extra = dict(extra or {})
    if not set(extra.values()) <= set(SUMMARIES):
        raise ValueError(f"summaries are {SUMMARIES}")
    groups = [f"_g{j}" for j in range(len(by))]
    # 0.0 + v turns the negative zero into zero, so that both are one value.
    counts = durable(df.groupBy(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)],
                                (F.col(value).cast("double") + 0.0).alias("_v")).agg(F.count(F.lit(1)).alias("_c")), "counts")
    known = counts.filter("_v IS NOT NULL")
    valued = F.when(F.col("_v").isNotNull(), F.col("_c"))
    summary = counts.groupBy(*groups).agg(
        F.sum("_c").alias("_rows"), F.coalesce(F.sum(valued), F.lit(0)).alias("_n"), F.min("_v").alias("_min"),
        F.max("_v").alias("_max"), (F.sum(F.col("_v") * F.col("_c")) / F.sum(valued)).alias("_mean"))
    rank = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in quantiles.items()}

    most = counts.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    if most <= small_group:
        whole = Window.partitionBy(*groups)
        end = F.sum("_c").over(whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
        placed = known.withColumns({"_n": F.sum("_c").over(whole), "_end": end})
    else:
        placed = _in_ranges(known, groups, list(rank.values()))

    def at(position: Column) -> Column:
        here = (F.col("_end") - F.col("_c") <= position) & (position < F.col("_end"))
        return F.max(F.when(here, F.col("_v")))

    ends = placed.groupBy(*groups).agg(*[
        F.struct(at(F.floor(r)).alias("a"), at(F.ceil(r)).alias("z"), F.max(r - F.floor(r)).alias("w")).alias(f"_q_{name}")
        for name, r in rank.items()])
    found = summary.alias("s").join(
        ends.alias("e"), [F.col(f"s.{g}").eqNullSafe(F.col(f"e.{g}")) for g in groups], "left")
    names = {"rows": "_rows", "count": "_n", "mean": "_mean", "min": "_min", "max": "_max"}
    return found.select(
        *[F.col(f"s.{g}").alias(c) for g, c in zip(groups, by, strict=True)],
        *[F.col(f"s.{names[kind]}").alias(name) for name, kind in extra.items()],
        *[(q["a"] + F.when(q["w"] > 0, (q["z"] - q["a"]) * q["w"]).otherwise(0.0)).alias(name)
          for name, q in ((name, F.col(f"_q_{name}")) for name in rank)])


def _in_ranges(known: DataFrame, groups: list[str], ranks: list[Column]) -> DataFrame:
    """The rows of ``known`` in the ranges that hold a wanted rank, with ``_n`` and the running sum ``_end``."""
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Stored, because sampled bounds of ranges may differ between two evaluations.
    ranged = durable(known.repartitionByRange(parts, *groups, "_v").withColumn("_range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*groups, "_range").agg(F.sum("_c").alias("_t"))
    whole = Window.partitionBy(*groups)
    before = F.sum("_t").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    hit = F.lit(False)
    for r in ranks:
        hit = hit | ((F.col("_before") <= F.ceil(r)) & (F.col("_before") + F.col("_t") > F.floor(r)))
    wanted = totals.withColumns({"_n": F.sum("_t").over(whole), "_before": F.coalesce(before, F.lit(0))}).filter(hit)
    running = Window.partitionBy(*groups, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"w.{g}")) for g in groups] + [F.col("r._range") == F.col("w._range")]
    return ranged.alias("r").join(wanted.alias("w"), same).select("r.*", "w._n", "w._before").withColumn(
        "_end", F.col("_before") + F.sum("_c").over(running))
