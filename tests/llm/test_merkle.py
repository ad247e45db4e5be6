import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from streampace.llm import merkle

SCHEMA = "doc_id long, lang string, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def level_by_level(nodes, fanout):
    """Root, and for each node its siblings before and after it, level by level."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, place in enumerate(at):
            first = place // fanout * fanout
            steps[i].append(("".join(level[first:place]), "".join(level[place + 1:first + fanout])))
            at[i] = place // fanout
        level = [h(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], steps


def brute(rows, fanout):
    parts = defaultdict(list)
    for d, p, t in rows:
        parts[p].append((d is not None, d or 0, h(field(d), field(p), field(t)), d))
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    below = {p: level_by_level([r[2] for r in sorted(parts[p])], fanout) for p in order}
    root, above = level_by_level([below[p][0] for p in order], fanout)
    return sorted(((r[3], p, r[2], below[p][0], root, s + above[i]) for i, p in enumerate(order)
                   for r, s in zip(sorted(parts[p]), below[p][1], strict=True)), key=repr)


def found(df):
    return sorted(((*r[:5], [tuple(s) for s in r.steps]) for r in df.collect()), key=repr)


def proofs(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", digest string")
    return merkle.proofs(docs, ["doc_id", "lang", "text"], "lang", "doc_id", **how)


@pytest.mark.parametrize("fanout,depth", [(2, 2), (3, 1), (2, 8)])
def test_proofs_equal_level_by_level_hashing(spark, fanout, depth):
    rng = random.Random(fanout)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice(["b", "é", "", None]), "x" * (i % 5)) for i in range(70)]
    rows += [(3, "hot", "x" * 3), (3, "hot", "y"), (None, "b", None), (9, "alone", "long " * 9000), (None, "hot", "")]
    rng.shuffle(rows)
    assert found(proofs(spark, rows, fanout=fanout, depth=depth)) == brute(rows, fanout)


def test_folding_and_the_digest_of_the_siblings(spark):
    rows = [(i, "ab"[i % 2], f"text {i}") for i in range(11)]
    changed = merkle.leaf([F.col("doc_id"), F.col("lang"), F.concat("text", F.lit("!"))])
    checked = proofs(spark, rows, carry={"changed": changed}).select(
        "id", "root", merkle.folded(F.col("leaf"), F.col("steps")).alias("same"),
        merkle.folded(F.col("changed"), F.col("steps")).alias("other"), merkle.proof_digest(F.col("steps")).alias("p"))
    want = {r[0]: r[5] for r in brute(rows, 2)}
    for r in checked.collect():
        assert r.root == r.same != r.other
        assert r.p == h(*[a + b for a, b in want[r.id]])


def test_one_row_and_no_rows(spark):
    (row,) = proofs(spark, [(4, None, "t")]).collect()
    assert row.leaf == row.subroot == row.root and row.steps == []
    assert proofs(spark, [(4, None, "t")]).limit(0).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.proofs(empty, ["text"], "lang", "doc_id").count() == 0
