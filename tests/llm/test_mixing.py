import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from streampace.llm import mixing


def water_level(sizes, weights, total, most):
    """Targets by sorting: fill the source that stops first, then share the rest."""
    left, rest, out = dict(sizes), total, {}
    while left:
        weight = sum(weights[s] for s in left)
        full = [s for s in left if most * sizes[s] <= rest * weights[s] / weight]
        if not full:
            return out | {s: rest * weights[s] / weight for s in left}
        for s in full:
            out[s] = most * left.pop(s)
        rest = total - sum(out.values())
    return out


def documents(n=300):
    rows = []
    for i in range(n):
        source = [None, "b", "a", "é", "Z", ""][min(i % 11, 5)]
        rows.append((i, source, " ".join(["w x"] * (i * 37 % 90)) + " \t\n\x0b\x0c\r "))
    return [*rows, (1, "a", None), (2, "a", ""), (3, "b", "same row"), (3, "b", "same row"), (None, "b", "x " * 9000)]


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts)


def test_targets_and_taken_words(spark):
    rows = documents()
    mixed = mixing.mix(frame(spark, rows), block_words=16, shards=8)
    got = mixing.taken(mixed).collect()
    words = [len(re.findall(mixing.WORD, t or "")) for _, _, t in rows]
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, n) for (d, _, _), n in zip(rows, words, strict=True))
    sizes = defaultdict(int)
    for (_, s, _), n in zip(rows, words, strict=True):
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    want = water_level(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    by_target = defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r.size
        by_target[r.source_size, round(r.target, 6)] += r.taken
    assert set(by_target) == {(sizes[s], round(want[s], 6)) for s in sizes}
    for (_, target), n in by_target.items():
        assert abs(n - target) <= 8
    again = mixing.taken(mixing.mix(frame(spark, rows, 3), block_words=16, shards=8)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    # Shards: even numbers of blocks, each block of a pass once.
    draws = mixed.draws.collect()
    counts = Counter(d.shard for d in draws)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert max(Counter((d.row, d["pass"], d.block) for d in draws).values()) == 1


def test_splitting_keeps_every_quota():
    quotas = np.array([1000, 1, 0, 250])
    split = mixing.split_quotas(quotas, 7, 3)
    assert (split.sum(1) == quotas).all() and split.min() >= 0
    assert split.sum(0).max() - split.sum(0).min() <= 1
    assert (split == mixing.split_quotas(quotas, 7, 3)).all()
    mean = np.mean([mixing.split_quotas(quotas, 7, s)[0] for s in range(300)], 0)
    assert np.allclose(mean, 1000 / 7, atol=1.5)


def test_whole_documents_and_edges(spark):
    rows = documents(60)
    docs = frame(spark, rows).withColumn("size", F.lit("clash")).withColumn("row", F.lit(1))
    got = mixing.mixed_documents(docs, share=1.0)
    assert got.columns == docs.columns
    counts = Counter((r.doc_id, r.source, r.text) for r in got.collect())
    assert max(counts.values()) <= 4 and not any(t is None or not t.split() for _, _, t in counts)
    assert mixing.taken(mixing.mix(docs.limit(0))).count() == 0
    empty = frame(spark, [(1, "a", None), (2, None, " ")], 1)
    assert [(r.taken, r.target) for r in mixing.taken(mixing.mix(empty)).collect()] == [(0, 0.0)] * 2
