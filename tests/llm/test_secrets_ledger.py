import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from streampace.llm import secrets_ledger as ledger

SCHEMA = "path string, version int, content string, blob string"
# The rules as they are stated, for Python's matcher.
STATED = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
PIECES = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "ſecret", "Kpikey", "=", ":", " = ", "'", '"', " ", "abc",
          "abcdef", "AKIA", "AKIA" + "Z9" * 8, "deadbeef" * 3, "0" * 23, "é", "\U0001f511", "\n", "a=b", "+/_.-", "AKI"]


def brute(text):
    found = []
    for order, (kind, pattern, long_enough) in enumerate(STATED, 1):
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text or "") if long_enough(m)]
    return sorted(found)


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(n)]


def result(spark, rows, path, rules=ledger.BASE):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.path, r.version): [tuple(s) for s in r.spans] for r in ledger.findings(df, path, rules).collect()}


def test_spans_equal_those_of_another_matcher(spark, tmp_path):
    rows = [(f"f{i}", 0, t, "x") for i, t in enumerate(texts(400, 1))]
    rows += [("empty", 0, "", "x"), ("none", 0, None, "x"), ("long", 0, "a token: abcdefg " * 5000 + "deadbeef" * 4, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    ledger.scan(df, str(tmp_path / "l"), ledger.BASE)
    assert result(spark, rows, str(tmp_path / "l")) == {(r[0], r[1]): brute(r[2]) for r in rows}


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    path = str(tmp_path / "l")
    one, two, three = "token=abcdef", "password: 1234567", "AKIA" + "B" * 20
    first = [("a", 1, one, ""), ("b", 1, one, ""), ("a", 2, two, "")]
    later = first + [("a", 3, one, ""), ("c", 1, three, ""), (None, None, three, ""), ("c", 1, three, "")]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert ledger.scan(frame(first), path, ledger.BASE) == 2 * 3
    assert ledger.scan(frame(first), path, ledger.BASE) == 0
    assert ledger.scan(frame(later), path, ledger.BASE) == 3
    assert result(spark, later, path) == {(r[0], r[1]): brute(r[2]) for r in later}
    assert ledger.findings(frame(later), path, ledger.BASE).count() == len(later)
    # A new version of one rule is scanned over all blobs; the spans of the old one no longer count.
    newer = (ledger.Rule("assign", 2, "password: [0-9]+"), *ledger.BASE[1:])
    assert ledger.scan(frame(later), path, newer) == 3
    assert result(spark, later, path, newer)["a", 1] == []
    assert result(spark, later, path, newer)["a", 2] == [(0, 1, "assign", 17)]
    assert ledger.scan(frame(later), path, ledger.BASE) == 0


def test_a_scan_that_was_lost_leaves_no_trace(spark, tmp_path):
    rows = [("a", 1, "token=abcdef", ""), ("b", 1, "AKIA" + "B" * 20, "")]
    df, path = spark.createDataFrame(rows, SCHEMA), tmp_path / "l"
    ledger.scan(df, str(path), ledger.BASE)
    shutil.move(path / "pairs", tmp_path / "lost")          # the spans are there, their pairs are not
    assert ledger.scan(df, str(path), ledger.BASE) == 6
    assert result(spark, rows, str(path)) == {(r[0], r[1]): brute(r[2]) for r in rows}


def test_one_blob_of_most_versions_and_no_versions(spark, tmp_path):
    path = str(tmp_path / "l")
    rows = [(f"f{i}", 0, "secret = hunter22" if i % 3 else f"token:{i}00000", "") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert ledger.scan(df, path, ledger.BASE) == 3 * 1001
    assert result(spark, rows, path) == {(r[0], r[1]): brute(r[2]) for r in rows}
    assert ledger.scan(df.limit(0), path) == 0 and ledger.findings(df.limit(0), path).count() == 0
    assert ledger.findings(df, str(tmp_path / "new")).filter(F.size("spans") > 0).count() == 0


def test_issued_formats(spark, tmp_path):
    text = "-----BEGIN RSA PRIVATE KEY-----\nghp_" + "Zz" * 18 + " xoxb-" + "1-" * 10 + " eyJh.eyJi.c ghp_short"
    df = spark.createDataFrame([("a", 1, text, "")], SCHEMA)
    ledger.scan(df, str(tmp_path / "l"))
    (row,) = ledger.findings(df, str(tmp_path / "l")).collect()
    assert [s["kind"] for s in row.spans] == ["private_key", "github", "slack", "jwt"]
    with pytest.raises(ValueError):
        ledger.scan(df, str(tmp_path / "l"), [ledger.Rule("a", 1, "x"), ledger.Rule("a", 2, "y")])
