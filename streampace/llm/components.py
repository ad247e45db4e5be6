"""Connected components of a table of links, by alternating star steps.

Every node of the result carries the smallest node of its component. A step replaces the links of a node
by links to the smallest of its neighbours; nodes with many links are spread by ``common.lookup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streampace.llm.common import lookup
from streampace.plans.durable import durable


def _star(links: DataFrame, out_of: str) -> DataFrame:
    """Link each ``dst`` of a node to the smallest node around it. ``links`` has ``src, dst``."""
    least = durable(links.groupBy("src").agg(F.min("dst").alias("least"), F.count(F.lit(1)).alias("n")
                                             ).withColumn("least", F.least("src", "least")), "least")
    joined = lookup(links, least, "src", "n")
    if out_of == "large":
        return joined.filter("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    own = least.select("src", F.col("least").alias("dst"))
    others = joined.select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return own.unionByName(others)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Stored ``(node, root)`` for every node of ``links(a, b)``; rows with ``a = b`` are ignored."""
    state = durable(links.filter("a <> b").select(
        F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct(), "links")
    before = None if not state.isEmpty() else (0, None)
    for _ in range(most_rounds):
        both = durable(state.unionByName(state.select(F.col("dst").alias("src"), F.col("src").alias("dst"))),
                       "both")
        large = durable(_star(both, "large").filter("src <> dst").distinct(), "large")
        state = durable(_star(large, "small").filter("src <> dst").distinct(), "small")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    roots = state.select("dst").distinct().select(F.col("dst").alias("node"), F.col("dst").alias("root"))
    return durable(state.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots),
                   "components")
