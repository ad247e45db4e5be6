"""Global positions in a total order, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streampace.plans.durable import durable


def dense_index(df: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """0-based rank of each distinct value of ``column``: one row ``(column, out)`` per value.

    Values are range-partitioned, so each task sorts its own range; the offset of a range is the
    number of values in the ranges before it (one row per partition). The partitioned values are
    materialised because sampled range bounds may differ between two evaluations.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(
        values.repartitionByRange(parts, column).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    # One offset per shuffle partition: the table is bounded by the configured partition count.
    return ranged.join(F.broadcast(offsets), "_range").select(
        column, (F.col("_offset") + inside).alias(out))
