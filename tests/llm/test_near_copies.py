import random

import corpus_pipeline
import numpy as np
from streampace.llm import near_copies
from streampace.plans.durable import durable
from test_simhash import classes


def runs(text, width=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + width]) for i in range(max(len(words) - width, 0) + 1)) if words else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept(rows):
    """Smallest id of each group, over all pairs."""
    sets = [runs(t) for _, t in rows]
    least = classes(range(len(rows)), lambda i, j: similarity(sets[i], sets[j]) >= 0.8)
    return sorted(min(rows[i][0] for i in least if least[i] == root) for root in set(least.values()))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.getrandbits(40)}"
    return words


def documents(rng, bases, copies, length=150):
    texts = [None, "", "a b", "A  b", "one two three four five six"]
    for b in range(bases):
        base = [f"w{b}_{i}" for i in range(length)]
        texts += [" ".join(edited(rng, base, rng.randrange(7))) for _ in range(copies)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_every_group_over_the_similarity_and_no_other(spark):
    rows = documents(random.Random(1), 12, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == kept(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicated(spark, docs, "").collect()) == kept(rows)
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_crowded_buckets_connect_the_same_documents(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CELL", 3)
    monkeypatch.setattr(near_copies, "BLOCK", 5)
    rows = documents(random.Random(2), 2, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies.drop_near_copies(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == kept(rows)


def test_a_family_whose_members_stay_apart(spark, monkeypatch):
    """Copies with many edits of their own, crowded around a few light ones; some agree with each other only."""
    monkeypatch.setattr(near_copies, "CELL", 4)
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(edited(rng, base, n)) for n in [0, 1, 2, 3] * 6 + [4, 5, 6, 7, 9, 12] * 9]
    for t in rng.sample(texts[24:], 12):
        texts.append(" ".join(edited(rng, t.split(), 1)))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)
    assert 5 < len(kept(rows)) < 70


def test_the_prefix_join_finds_every_similar_pair(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "DISTANCE", 128)
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    rng = random.Random(7)
    sets = [frozenset(rng.sample(range(40), rng.randint(3, 30))) for _ in range(60)]
    sets += [frozenset(rng.sample(sorted(s), max(1, len(s) - rng.randrange(3)))) | {100 + i} for i, s in enumerate(sets)]
    about = spark.createDataFrame([(i, len(s), 0, 0, i) for i, s in enumerate(sets)],
                                  "node long, size long, bits0 long, bits1 long, root long")
    runs = spark.createDataFrame([(i, np.array(sorted(s), np.int64).tobytes()) for i, s in enumerate(sets)],
                                 "node long, shingles binary")
    for t in (0.5, 0.8, 1.0):
        want = {(i, j) for j in range(len(sets)) for i in range(j) if similarity(sets[i], sets[j]) >= t}
        found = {(r.a, r.b) for r in near_copies._by_prefixes(durable(runs), durable(about), t).distinct().collect()}
        assert want <= found and len(found) < 60 * 119


def test_bands_and_bits_find_pairs_at_the_bound():
    draw = np.random.default_rng(3)
    missed = far = 0
    for _ in range(300):  # 160 of 200 shared: similarity 0.8
        h = draw.integers(0, 1 << 64, 200, np.uint64)
        bands, bits = near_copies.signatures([h[:180], h[20:]])
        missed += not (bands[0] == bands[1]).any()
        far += int(np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum()) > near_copies.DISTANCE
    assert missed == far == 0
