import random

import numpy as np
import pytest

from streampace.llm import decontaminate as d


def best_edits(passage, text):
    """Edits of the best place of the whole passage, by the plain table."""
    cost = [0] * (len(text) + 1)
    for k, a in enumerate(passage, 1):
        row = [k]
        for j, b in enumerate(text, 1):
            row.append(min(cost[j - 1] + (a != b), cost[j] + 1, row[-1] + 1))
        cost = row
    return min(cost)


def edited(text, n, rng):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out) or 1)
        kind = rng.randrange(3) if out else 2
        if kind == 0:
            out[i] = rng.choice("xyz")
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, rng.choice("xyz"))
    return "".join(out)


def words(n, rng):
    return " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(n))


def test_codes_tell_runs_apart():
    data = np.frombuffer(b"abcabcabcd" * 5 + bytes(range(256)), np.uint8)
    for q in (1, 3, 7, 10, 16):
        runs = [bytes(data[i:i + q]) for i in range(len(data) - q + 1)]
        codes = d.gram_codes(data, q)
        assert len(codes) == len(runs) and len(set(codes.tolist())) == len(set(runs))
        assert len(set(zip(codes.tolist(), runs, strict=True))) == len(set(runs))
    assert len(d.gram_codes(data[:3], 4)) == 0


@pytest.mark.parametrize(("q", "share"), [(4, 0.1), (3, 0.2), (10, 0.06)])
def test_occurrences_equal_the_whole_table(q, share):
    rng = random.Random(q)
    items = [(i, words(n, rng).encode()) for i, n in enumerate([30, 12, 9, 40, 2, 1])] + [(9, b""), (10, b"ab")]
    p = d.prepare(items, q, share)
    for trial in range(60):
        parts = [words(rng.randint(0, 30), rng)]
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(p.texts).decode()
            parts += [edited(t, rng.randint(0, d.budget(len(t), q, share) + 2), rng), words(rng.randint(0, 5), rng)]
        text = " ".join(parts).strip().encode()
        if trial % 7 == 0 and len(parts) > 1:
            text = parts[1].encode()
        want = {k: best_edits(t, text) for k, t in enumerate(p.texts)}
        want = {k: e for k, e in want.items() if e <= p.edits[k]}
        got = {k: (e, a, b) for k, e, a, b in d.occurrences(text, p, q)}
        assert {k: v[0] for k, v in got.items()} == want
        for k, (e, a, b) in got.items():
            assert best_edits(p.texts[k], text[a:b]) == e


def test_rows_parts_and_edges(spark):
    rng = random.Random(5)
    passage, other = words(40, rng), words(25, rng)
    bench = spark.createDataFrame([(1, passage), (2, other), (2, other), (3, None), (4, ""), (None, "zq")],
                                  "item_id long, text string")
    rows = [(1, f"{words(50, rng)}\n{passage.upper()} {words(9, rng)}"), (2, words(2000, rng)), (3, None), (4, ""),
            (5, other.replace(" ", "\n  ")), (None, edited(passage, 3, rng)), (7, passage[:80]), (5, other),
            (8, "x" * 200_000 + " " + other), (9, "a zq b")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    want = sorted([(1, 1), (5, 2), (5, 2), (5, 2), (5, 2), (None, 1), (8, 2), (8, 2), (9, -1)], key=repr)
    for most in (d.PART, 60):
        got = d.matches(docs, bench, most=most)
        assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=repr) == want
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 7]
    assert d.matches(docs, bench.limit(0)).count() == 0 == d.matches(docs.limit(0), bench).count()
    assert d.drop_contaminated(docs, bench.limit(0)).count() == len(rows)
