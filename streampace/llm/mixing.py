"""Mixing sources to target weights with exact block quotas.

A document is cut into blocks of words. Each source's target is its weighted share of the wanted total,
but at most ``most`` times its size; what is cut off goes to the other sources by weight. A source is
taken in whole passes and a rest: every pass has its own permutation of the source's blocks, and the last
one ends where the words come nearest to the target, within half a block. The numbers of drawn blocks are
the quotas of a splitting tree: at each node the quotas of a range of output shards are divided by a
multivariate hypergeometric draw between its halves, so every shard gets its exact share of blocks with
the composition of a random sample. A shard takes the next blocks of each source's permutations, so
shards are disjoint, and orders them by another hash.

Permutations are hashes of the seed, the id and the text, so reruns agree whatever the partitioning.
Sources sort by code point with null last. Null and wordless texts have size 0 and nothing is taken of
them; if no words remain all targets are 0. Repeated rows are documents of their own. Texts of any length
are measured whole. Columns are taken by name; whole documents come back with all their columns, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streampace.llm.common import aside, lookup, running_start, with_row
from streampace.plans.durable import durable
from streampace.plans.ranks import dense_index

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 512
MOST_BLOCKS = 500_000_000   # what a hypergeometric draw can hold, with room for repeats
SHARDS = 64


class Mix(NamedTuple):
    """All stored. ``rows``: documents; ``sources``: targets; ``draws``: blocks with their shard."""

    rows: DataFrame
    sources: DataFrame
    draws: DataFrame


def measured(docs: DataFrame, doc_id: str, text: str, source: str, seed: int, carry: Sequence[str]) -> DataFrame:
    """``row, key, doc_id, source_key, size`` and ``carry``; the key names a document in permutations."""
    return durable(docs.select(
        *carry, F.col(doc_id).alias("doc_id"),
        F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name")
                 ).alias("source_key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), doc_id, F.col(text)).alias("key"),
    ).withColumn("row", F.monotonically_increasing_id()), "rows")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources(source_key, source_size, ...)`` with ``target``, by raising a common level of words per
    weight until nothing is left over; a few sums over the sources for each rise."""
    order = dense_index(sources, "source_key", "_place")
    named = F.array(*[F.lit(float(w)) for w in weights])
    table = durable(sources.join(order, "source_key").withColumn(
        "_weight", F.element_at(named, (F.col("_place") % len(weights) + 1).cast("int"))).withColumn(
        "_cap", F.col("source_size") * float(most)), "sources")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        capped = F.col("_cap") <= F.col("_weight") * level
        now, held, weight = table.agg(
            F.count_if(capped), F.coalesce(F.sum(F.when(capped, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("_weight"))), F.lit(0.0))).first()
        if now == full or not weight:
            break
        full, level = now, max(level, (total - held) / weight)
    return table.withColumn("target", F.least(F.col("_cap"), F.col("_weight") * level)).drop("_place", "_weight", "_cap")


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (sources x shards). Shards get equal counts within one."""
    draw = np.random.default_rng(seed)
    out = np.zeros((len(quotas), shards), np.int64)
    total = int(quotas.sum())
    nodes = [(0, shards, quotas.astype(np.int64))]
    while nodes:
        lo, hi, have = nodes.pop()
        if hi - lo == 1:
            out[:, lo] = have
            continue
        mid = (lo + hi) // 2
        # Shard i holds the blocks from total * i // shards on.
        left = total * mid // shards - total * lo // shards
        taken = draw.multivariate_hypergeometric(have, left, method="marginals")
        nodes += [(mid, hi, have - taken), (lo, mid, taken)]
    return out


def mix(docs: DataFrame, share: float = 1.5, weights: Sequence[float] = WEIGHTS, most: float = 2.0,
        block_words: int | None = BLOCK_WORDS, shards: int = SHARDS, seed: int = 1, doc_id: str = "doc_id",
        text: str = "text", source: str = "source", carry: Sequence[str] = ()) -> Mix:
    """Draw ``share`` times all words. ``block_words=None`` takes documents whole.

    Blocks grow beyond ``block_words`` where there would be more than ``MOST_BLOCKS`` of them. The driver
    holds one count for each source and shard.
    """
    rows = measured(docs, doc_id, text, source, seed, carry)
    sources = durable(rows.groupBy("source_key").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sizes")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    sources = durable(targets(sources, weights, share, most), "targets")

    per = F.greatest(F.col("size"), F.lit(1)) if block_words is None else F.lit(
        max(block_words, -(-int(total * max(share, 1)) // MOST_BLOCKS)))
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    known = lookup(rows.filter("size > 0").select("row", "key", "source_key", "size"), sources, "source_key", "n")
    cut = known.withColumn("per", per).withColumn("passes", passes).withColumn(
        "pass", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int")))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / F.col("per")).cast("int") - 1)))
    blocks = durable(cut.select(
        "row", "key", "source_key", "pass", "block", "passes",
        F.least(F.col("per"), F.col("size") - F.col("block") * F.col("per")).cast("long").alias("words"),
        (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"), F.lit(1).cast("long").alias("one")),
        "blocks")
    placed = running_start(blocks, ["source_key", "pass"], ["key", "block", "pass"],
                           {"start": "words", "rank": "one"}, ["row"])
    drawn = durable(placed.filter((F.col("pass") < F.col("passes")) | (
        F.col("start") + F.col("words") / 2 <= F.col("rest"))), "drawn")

    counts = drawn.groupBy("source_key", "pass").agg(F.count(F.lit(1)).alias("n")).collect()
    names = sorted({c.source_key for c in counts})
    at = {name: i for i, name in enumerate(names)}
    quotas, before = np.zeros(len(names), np.int64), []
    for c in sorted(counts, key=lambda c: (c.source_key, c["pass"])):
        before.append((c.source_key, c["pass"], int(quotas[at[c.source_key]]), c.n))
        quotas[at[c.source_key]] += c.n
    ends = split_quotas(quotas, shards, seed).cumsum(1) if len(names) else np.zeros((0, shards), int)
    spark = docs.sparkSession
    kind = rows.schema["source_key"].dataType.simpleString()
    plan = durable(spark.createDataFrame(
        [(name, p, b, n, ends[at[name]].tolist()) for name, p, b, n in before],
        f"source_key {kind}, pass int, before long, n long, ends array<long>"), "plan")
    place = F.col("before") + F.col("rank")
    draws = lookup(drawn, plan, ["source_key", "pass"], "n").select(
        "row", "source_key", "pass", "block", "words",
        F.size(F.filter("ends", lambda e: e <= place)).alias("shard"),
        F.xxhash64(F.lit("shuffle"), "key", "block", "pass").alias("position"))
    return Mix(rows, sources, durable(draws, "draws"))


def taken(mixed: Mix) -> DataFrame:
    """Per document the words taken: the columns carried and ``doc_id, size, source_size, target, taken``."""
    words = mixed.draws.groupBy("row").agg(F.sum("words").alias("taken"))
    known = lookup(mixed.rows, mixed.sources, "source_key", "n")
    carried = [c for c in mixed.rows.columns if c not in ("row", "key", "source_key", "doc_id", "size")]
    return known.join(words, "row", "left").select(
        *carried, "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, share: float = 1.5, weights: Sequence[float] = WEIGHTS, most: float = 2.0,
                    seed: int = 1, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Whole documents, each as often as the mix takes it, with the columns of ``docs``."""
    docs, back = aside(docs, ["_row", "_times"])
    stored = with_row(docs)
    found = mix(stored.select("_row", doc_id, text, source), share, weights, most, None, 1, seed, doc_id, text,
                source, ["_row"])
    times = found.draws.groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    drawn = found.rows.select("row", "_row").join(times, "row").drop("row")
    return back(stored.join(drawn, "_row").withColumn(
        "_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_row", "_times"))
