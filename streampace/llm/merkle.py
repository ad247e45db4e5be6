"""Merkle manifest of a table, with a membership proof for every row.

Rows are leaves; the leaves of a part (say, a language) are hashed together run by run, in the order of
their ids, until one digest is left, and the digests of the parts in the same way. A run is ``fanout``
consecutive nodes; the last one of a level may hold fewer, and a single node is hashed alone as well.

A node's rank, written in base ``fanout``, names its place in the tree. Ranks are cut into blocks of
``fanout ** depth`` nodes, and inside a block the digit columns are grouped away one after the other, lowest
first: each grouping nests the children as structs below the digest of their run. A block is shuffled once,
as its key stays the leading part of all grouping keys. The block digests are the nodes of the next
tier. Back from the top, each block gets the steps above it as one more row of its group, then nested
``transform`` calls put the siblings in front of the steps, and an ``explode`` emits the proofs: no join.

Fields are hashed as ``-`` for null, else as the number of their UTF-8 bytes, a colon and the value.
Null parts and ids are allowed and come first. Rows with equal ids are ordered by leaf, so the digests do not
depend on how the table is stored; repeated rows are leaves of their own. Empty texts are ``0:``, long texts
are read once per leaf and left behind. Other columns do not matter, whatever their names, and do not come back. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streampace.plans.durable import broadcast_if_small, durable

FANOUT = 2
DEPTH = 8                  # levels of a block; a block has FANOUT ** DEPTH nodes
ROWS_PER_RANGE = 1_000_000
_STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row's fields."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes(part, ...)`` with ``rank`` in the part by ``order`` and ``n``, the nodes of the part.

    ``nodes`` is stored. It is dealt by ranges of (part, order), so a large part lies in many tasks; the counts
    of the ranges, one row for each part in each range, give what precedes a range.
    """
    spark = nodes.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() // ROWS_PER_RANGE)
    placed = durable(nodes.repartitionByRange(ranges, "part", *order).sortWithinPartitions("part", *order).withColumns(
        {"place": F.monotonically_increasing_id(), "range": F.spark_partition_id()}), "ranged")
    counts = placed.groupBy("part", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy("part")
    before = F.coalesce(F.sum("m").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = durable(counts.select(F.col("part").alias("owner"), F.col("range").alias("at"), (before - F.col("first")).alias(
        "offset"), F.sum("m").over(whole).alias("n")), "offsets")
    same = F.col("part").eqNullSafe(F.col("owner")) & (F.col("range") == F.col("at"))
    return placed.join(broadcast_if_small(offsets), same).withColumn("rank", F.col("place") + F.col("offset")).drop(
        "owner", "at", "offset", "place", "range")


def _blocks(nodes: DataFrame, carried: Sequence[str], fanout: int, depth: int) -> DataFrame:
    """Stored ``part, block, n, tree``: the digits of ``nodes(part, rank, n, digest, *carried)`` grouped away."""
    digits = [f"digit{k}" for k in range(depth)]
    rows = nodes.select("part", F.expr(f"rank div {fanout ** depth}").alias("block"), "n",
                        *[F.expr(f"rank div {fanout ** k} % {fanout}").cast("int").alias(d) for k, d in enumerate(digits)],
                        F.struct("digest", *carried).alias("tree")).repartition("part", "block")
    for k in range(depth):
        children = F.col("children.tree.digest")
        run = F.when(F.col("n") > fanout ** k, digest(F.concat_ws("", children))).otherwise(children[0])
        rows = rows.groupBy("part", "block", "n", *digits[k + 1:]).agg(
            F.array_sort(F.collect_list(F.struct(digits[k], "tree"))).alias("children")
        ).withColumn("tree", F.struct(run.alias("digest"), "children")).drop("children")
    return durable(rows, "blocks")


def _children(k: int, fanout: int) -> Callable[[Column], Column]:
    """From a node at level ``k + 1`` to its children, each with the step to its parent in front."""

    def below(at: Column) -> Column:
        digests = at["node"]["children"]["tree"]["digest"]

        def child(c: Column, i: Column) -> Column:
            step = F.struct(F.concat_ws("", F.slice(digests, F.lit(1), i)).alias("before"),
                            F.concat_ws("", F.slice(digests, i + 2, F.lit(fanout))).alias("after"))
            steps = F.when(F.col("n") > fanout ** k, F.concat(F.array(step), at["steps"])).otherwise(at["steps"])
            return F.struct(c["tree"].alias("node"), steps.alias("steps"), (at["rank"] * fanout + c[f"digit{k}"]).alias("rank"))

        return F.transform(at["node"]["children"], child)

    return below


def _emitted(blocks: DataFrame, above: DataFrame, known: Sequence[str], fanout: int, depth: int) -> DataFrame:
    """``part, node, steps, rank, *known`` for every node of ``blocks``.

    ``above(part, block, steps, *known)`` holds what leads from each block to the top.
    """
    lines = blocks.unionByName(above, allowMissingColumns=True)
    whole = lines.groupBy("part", "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "tree", "steps", *known)])
    found = F.array(F.struct(F.col("tree").alias("node"), "steps", F.col("block").alias("rank")))
    for k in reversed(range(depth)):
        found = F.flatten(F.transform(found, _children(k, fanout)))
    return whole.select("part", *known, F.explode(found).alias("found")).select("part", "found.*", *known)


def _tiers(nodes: DataFrame, carried: Sequence[str], fanout: int, depth: int) -> list[DataFrame]:
    """Blocks of the nodes, of their digests, and so on, up to one block a part."""
    tiers = [_blocks(nodes, carried, fanout, depth)]
    left = tiers[0].agg(F.max("n")).first()[0] or 0
    while left > fanout ** depth:
        upper = tiers[-1].select("part", F.col("block").alias("rank"), F.ceil(F.col("n") / fanout ** depth).alias("n"),
                                 F.col("tree.digest").alias("digest"))
        tiers.append(_blocks(upper, [], fanout, depth))
        left = -(-left // fanout ** depth)
    return tiers


def _descend(tiers: list[DataFrame], above: DataFrame, known: Sequence[str], fanout: int, depth: int) -> DataFrame:
    """The steps of every node of the lowest tier. ``above`` has one row a part."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tiers[1:]):
        above = _emitted(blocks, above, known, fanout, depth).withColumnRenamed("rank", "block").drop("node")
    return _emitted(tiers[0], above, known, fanout, depth)


def proofs(rows: DataFrame, fields: Sequence[str], part: str, order: str, carry: Mapping[str, Column] | None = None,
           fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``id, part, leaf, subroot, root, steps`` and the columns of ``carry`` for every row.

    ``fields`` are hashed in this order. ``steps`` leads from the leaf to the root: the siblings' digests
    before and after the node on each level. ``carry`` holds columns computed from the row.
    """
    if fanout < 2 or depth < 1:
        raise ValueError("need fanout >= 2 and depth >= 1")
    carry = dict(carry or {})
    leaves = durable(rows.select(
        F.col(part).alias("part"), F.col(order).alias("id"), leaf([F.col(f) for f in fields]).alias("digest"),
        F.struct(F.lit(0).alias("none"), *[c.alias(name) for name, c in carry.items()]).alias("carried"),
        F.monotonically_increasing_id().alias("tie")), "leaves")
    tiers = _tiers(_ranked(leaves, ["id", "digest", "tie"]), ["id", "carried"], fanout, depth)
    subroots = durable(tiers[-1].select(F.col("part").alias("of"), F.lit(0).alias("part"), F.col("tree.digest").alias("digest")),
                       "subroots")
    upper = _tiers(_ranked(subroots, ["of"]), ["of"], fanout, depth)
    top = upper[-1].select("part", F.col("tree.digest").alias("root"), F.array().cast(_STEPS).alias("steps"))
    parts = durable(_descend(upper, top, ["root"], fanout, depth).select(
        F.col("node.of").alias("part"), F.col("node.digest").alias("subroot"), "root", "steps"), "parts")
    found = _descend(tiers, parts, ["subroot", "root"], fanout, depth)
    return found.select(F.col("node.id").alias("id"), "part", F.col("node.digest").alias("leaf"), "subroot", "root", "steps",
                        *[F.col("node.carried")[name].alias(name) for name in carry])


def folded(leaf_digest: Column, steps: Column) -> Column:
    """The root to which a leaf and its proof lead."""
    return F.aggregate(steps, leaf_digest, lambda node, s: digest(s["before"], node, s["after"]))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf up."""
    return digest(F.concat_ws("", F.transform(steps, lambda s: F.concat(s["before"], s["after"]))))
