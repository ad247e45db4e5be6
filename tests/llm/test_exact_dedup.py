import hashlib
from collections import defaultdict

import pytest

from streampace.llm.exact_dedup import exact_groups

TEXTS = ["", None, "Abc", "abc", "ABC", "É", "é", "abcd", "abcdabcd", "abcdabcd" * 9, "ABCDABCD" * 9,
         "abcdabcd" * 9 + "x", "x" + "abcdabcd" * 9, "ab" * 150, "ab" * 150 + "c"]


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").encode().lower()].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        at = ids.index(keep)
        out += [(d, keep, len(ids), i == at, hashlib.sha256(t).hexdigest()) for i, d in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [3, 16, 4096])
def test_groups_equal_brute_force(spark, size):
    rows = [(i * 7 % 11 + i, t) for i, t in enumerate(TEXTS)] + [(None, "abc"), (None, "alone"), (5, "abcd"),
                                                                (5, "abcd")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, name string")
    assert sorted(map(tuple, exact_groups(docs, size=size).collect()), key=repr) == brute(rows)


def test_hashes_that_collide_are_seeded_anew(spark):
    def weak(block, seed):
        return bytes([len(block) if seed < 2 else block[0] if block else 0])

    rows = [(1, "a"), (2, "b"), (3, "A")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact_groups(docs, size=4, digest=weak).collect()), key=repr) == brute(rows)


def test_one_group_of_most_rows_and_no_rows(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact_groups(docs, size=4).collect()), key=repr) == brute(rows)
    assert exact_groups(docs.limit(0)).count() == 0
