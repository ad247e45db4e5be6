import itertools
import re
from math import log

import pytest

from streampace.llm import url_filter as u
from streampace.llm.queries import RULES, op1_url_filter

SF = "/root/testdata/sf0.001"
URLS = ["https://Www.Example.com/en/x?q", "http://example.com/en/", "http://a.example.com/en", "http://com/", "http://com",
        "ftp://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://a.org/en/12#z", "no scheme", "", None, "://",
        "http://h?x=/en/", "http://ÄB.COM/é", "x://y://z.com/p", "http://www.example.com/en/\nb", "http://xcom/"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def ruled(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_split_equals_all_splits():
    counts = {"the": 50, "rea": 5, "there": 2, "a": 9, "re": 7, "t": 1}
    total = sum(counts.values())

    def weight(words):
        return sum(log(counts[w] / total) if w in counts else log(10 / total) - len(w) * log(10) for w in words)

    for label in ("therea", "thea", "x", "areareat", "zzthe"):
        splits = [[label[a:b] for a, b in itertools.pairwise((0, *cuts, len(label)))]
                  for n in range(len(label)) for cuts in itertools.combinations(range(1, len(label)), n)]
        assert weight(u.split_label(label, counts, total)) == pytest.approx(max(map(weight, splits)))
        assert "".join(u.split_label(label, counts, total)) == label


def test_rules_parts_and_clashing_columns(spark):
    rows = [(i, url, None if i % 2 else "<p>Example the</p>", "x") for i, url in enumerate(URLS + URLS[:1])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    got = sorted(u.judge(pages, RULES).collect(), key=lambda r: r.page_id)
    assert u.judge(pages, RULES).columns == ["page_id", "host", "path", "rule", "verdict", "words", "block_score"]
    for r, (_, url, _, _) in zip(got, rows, strict=True):
        rule = ruled(*parts(url))
        assert (r.host, r.path) == parts(url)
        assert r.rule == (rule and rule.name)
        assert r.verdict == (rule.verdict if rule else "block" if r.block_score > 0.5 else "allow")
        assert "".join(r.words) == re.sub("[^a-z]", "", r.host)
    assert u.judge(pages.limit(0), RULES).count() == 0


def test_words_and_model_of_whole_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    got = op1_url_filter(spark, SF).toPandas()
    assert len(got) == len(pages)
    counts = {}
    for html in pages.html:
        for w in re.findall("[a-z]+", re.sub("<[^>]*>", " ", html).lower()):
            if len(w) <= u.LONGEST:
                counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    sides = {"allow": {}, "block": {}}
    seen = {"allow": 0, "block": 0}
    tokens = {}
    for r in got.itertuples():
        words = [w for label in re.split("[^a-z]+", r.host) if label for w in u.split_label(label, counts, total)]
        assert list(r.words) == words
        path = [("#" + str(len(t)) if re.fullmatch("[0-9]+", t) else t) for t in re.split(r"[\W_]+", r.path.lower()) if t]
        tokens[r.page_id] = ["h:" + w for w in words] + ["p:" + t for t in path]
        rule = ruled(r.host, r.path)
        if rule:
            seen[rule.verdict] += 1
            for t in tokens[r.page_id]:
                b = u.bucket(t)
                sides[rule.verdict][b] = sides[rule.verdict].get(b, 0) + 1
    def odds(t):
        rate = {s: (sides[s].get(u.bucket(t), 0) + 1) / (sum(sides[s].values()) + u.BUCKETS) for s in sides}
        return log(rate["block"] / rate["allow"])
    for r in got.itertuples():
        want = log((seen["block"] + 1) / (seen["allow"] + 1)) + sum(map(odds, tokens[r.page_id]))
        assert r.block_score == pytest.approx(1 / (1 + 2.718281828459045 ** -want), abs=1e-6)
