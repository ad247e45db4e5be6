import random

import numpy as np
import pytest
import xxhash

from streampace.llm import simhash
from streampace.llm.components import components
from streampace.plans.durable import durable

BASE = " ".join(f"w{i * 7919 % 1000}" for i in range(300))


def print_of(text, width):
    words = ["".join(c.lower() if c.isascii() else c for c in w)
             for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    runs = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or (
        [" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(nodes, near):
    """Smallest node reachable, by brute force."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_fingerprints_equal_bit_by_bit_counts():
    texts = ["", None, "one", "one two", "A b C", BASE, "É b c d", "x " * 3000, BASE * 3]
    got = simhash.fingerprints([simhash.shingle_hashes((t or "").encode().lower(), 3) for t in texts])
    assert [int(x) & (1 << 64) - 1 for x in got] == [print_of(t, 3) for t in texts]


@pytest.mark.parametrize(("bucket", "distance"), [(None, 0), (None, 2), (3, 2), (3, 4)])
def test_links_connect_the_same_prints_as_brute_force(spark, bucket, distance):
    rng = random.Random(distance)
    prints = {0, -1, 1}
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            prints.add((value if value < 1 << 63 else value - (1 << 64)))
            for _ in range(rng.randint(0, 3)):
                value ^= 1 << rng.randrange(64)
    table = durable(spark.createDataFrame([(p,) for p in prints], "print long"))
    found = simhash.links(table, distance, bucket).collect()
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= distance
    assert all(near(a, b) for a, b in found)
    roots = {r.node: r.root for r in components(spark.createDataFrame(found or [(0, 0)], "a long, b long")).collect()}
    assert {p: roots.get(p, p) for p in prints} == classes(sorted(prints), near)


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "print long"), 1)


@pytest.mark.parametrize("total", [10, 10**5, 10**10])
def test_thresholds_keep_the_pigeonhole(total):
    both = np.full((64, 64), total / 4)
    np.fill_diagonal(both, total / 2)
    plan = simhash.allocate(total, both, 2)
    assert sum(t + 1 for _, t in plan) == 3
    bits = [b for g, _ in plan for b in g]
    assert len(bits) == len(set(bits))
    if total == 10**10:  # wide partitions where a narrow one would hold thousands
        assert min(len(g) for g, _ in plan) >= 32


def test_partitions_hold_correlated_bits():
    both = np.full((64, 64), 25.0)
    np.fill_diagonal(both, 50.0)
    for a, b in ((0, 40), (0, 63), (40, 63)):
        both[a, b] = both[b, a] = 48.0
    assert any({0, 40, 63} <= set(g) for g in simhash.partitions(100, both, 3))


def test_long_chain_is_one_component(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(pairs).collect()}
    assert got == {i: 0 for i in range(61)} | {1000: 1000, 1001: 1000}


def test_rows_of_the_operator(spark):
    near = BASE.replace("w0 ", "changed ", 1)
    texts = [None, "", "a", "A", BASE, BASE.upper(), near, "b c", BASE + " end", "zz " * 5000] + ["copy of one"] * 40
    rows = [(i + 5, t, 1) for i, t in enumerate(texts)] + [(5, None, 1), (None, "a", 1), (None, "alone", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = simhash.near_duplicates(docs, width=3)
    assert got.columns == ["doc_id", "fingerprint", "component_id", "kept"]
    prints = [print_of(t, 3) for _, t, _ in rows]
    roots = classes(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (d, _, _), p in zip(rows, prints, strict=True):
        if d is not None:
            least[roots[p]] = min(d, least.get(roots[p], d))
    want = [(d, f"{p:016x}", least.get(roots[p])) for (d, _, _), p in zip(rows, prints, strict=True)]
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == sorted(want, key=repr)
    kept = simhash.drop_near_duplicates(docs, width=3)
    assert kept.columns == docs.columns and kept.count() == len({roots[p] for p in prints})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
