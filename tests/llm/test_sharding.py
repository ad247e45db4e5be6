import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from streampace.llm import sharding
from streampace.plans.durable import durable


def check(rows, got, shards):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
        (d, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r.law for r in got} <= {"rows"} and all(r.grown_shard is None for r in got)


@pytest.mark.parametrize(("shards", "sizes"), [
    (24, [1] * 200 + [2] * 60 + [3] * 20 + [40, 150]), (4, [97]), (3, [1] * 50 + [5] * 9)])
def test_counts_slots_and_groups(spark, shards, sizes):
    texts = [f"text {g} ü" for g, n in enumerate(sizes) for _ in range(n)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign_shards(docs, shards).collect()
    check(rows, got, shards)
    where = defaultdict(Counter)
    by_id = dict(rows)
    for r in got:
        where[by_id[r.doc_id]][r.shard] += 1
    quota = -(-len(rows) // shards)
    split = [t for t, c in where.items() if len(c) > 1]
    # Small groups stay whole where unlinked rows leave room; a large one needs no more shards than it must.
    if sizes.count(1) * 3 > len(rows):
        assert len(split) <= sum(n > quota for n in sizes) + 2
    for t, c in where.items():
        assert sum(c.values()) == texts.count(t)


def test_rounds_only_lower_the_cut_and_keep_quotas(spark):
    groups = durable(spark.createDataFrame([(bytes([g]), 2 + g % 5) for g in range(120)], "`group` binary, n long"))
    total = groups.agg(F.sum("n")).first()[0] + 100
    state, cuts = durable(sharding.dealt(groups, 6)), []
    for _ in range(4):
        cuts.append(sharding.cut_links(state))
        assert all(r.load <= r.quota for r in sharding.quotas(state, 6, total).collect())
        assert {(r.group, r.k) for r in state.groupBy("group").agg(F.sum("k").alias("k")).collect()} == {
            (r.group, r.n) for r in groups.collect()}
        state, moved = sharding.round_of_moves(state, 6, total)
        if not moved:
            break
    assert cuts == sorted(cuts, reverse=True) and cuts[-1] < cuts[0] / 3


@pytest.mark.parametrize("others", [0, 2, 3])
def test_a_group_larger_than_a_quota_takes_as_few_shards_as_it_can(spark, others):
    big, total, shards = 8000, 24_000, 24
    sizes = [big, 600] + [others] * ((total - big - 600) // others if others else 0)
    groups = durable(spark.createDataFrame([(b"%d" % g, n) for g, n in enumerate(sizes)], "`group` binary, n long"))
    state = sharding.propagated(groups, shards, total)
    assert all(r.load <= r.quota for r in sharding.quotas(state, shards, total).collect())
    where = defaultdict(dict)
    for r in state.collect():
        where[bytes(r.group)][r.shard] = r.k
    assert all(sum(where[b"%d" % g].values()) == n for g, n in enumerate(sizes))
    assert len(where[b"0"]) == big * shards // total and len(where[b"1"]) == 1


def test_edges_and_kept_columns(spark):
    rows = [(1, None), (2, None), (3, ""), (3, ""), (None, "x"), (4, "y" * 100_000)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, slot int")
    got = sharding.assign_shards(docs, 24).collect()
    check([r for r in rows if r[0]], [r for r in got if r.doc_id], 24)
    assert sharding.assign_shards(docs.limit(0), 24).count() == 0
    whole = sharding.sharded(docs, 2)
    assert whole.columns == ["doc_id", "text", "shard", "slot"] and whole.count() == 6
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
