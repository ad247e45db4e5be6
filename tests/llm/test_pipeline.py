from collections import Counter

import corpus_pipeline
import pytest
from streampace.llm import language_id
from streampace.llm.decontaminate import plain
from streampace.plans.durable import durable
from test_near_copies import kept

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = spark.createDataFrame([(10**6, "12 34 !", "en", "src0", 7), (10**6 + 1, None, None, None, None),
                                   (None, "", "en", "src1", 0)], docs.schema)
    out = [docs.unionByName(noise)]
    for _, stage in corpus_pipeline.STAGES:
        out.append(durable(stage(spark, out[-1], SF)))
    return [o.toPandas() for o in out]


def test_columns_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash", "decontaminate", "mixing", "sharding"]


def test_language_stage_drops_only_what_has_no_letter(outputs):
    before, after = outputs[0], outputs[1]
    assert list(after.columns) == COLUMNS
    assert Counter(after.text) == Counter(t for t in before.text if language_id.has_letter(t))


def test_one_document_of_each_group_stays(outputs):
    """Against all pairs of the texts' own sets of word runs."""
    before, after = outputs[1], outputs[2]
    assert list(after.columns) == COLUMNS
    want = kept([(r.doc_id, r.text) for r in before.itertuples()])
    assert sorted(after.doc_id) == want and len(want) < len(before)


def test_contaminated_documents_go(spark, outputs):
    before, after = outputs[2], outputs[3]
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in before.itertuples() if any(i in plain(r.text) for i in items)}
    assert leaked and set(after.doc_id) == set(before.doc_id) - leaked


def test_mixing_repeats_whole_documents(outputs):
    before, after = outputs[3], outputs[4]
    assert list(after.columns) == COLUMNS
    words = {r.doc_id: len(r.text.split()) for r in before.itertuples()}
    times = Counter(after.doc_id)
    assert set(times) <= set(words) and max(times.values()) <= 2
    total = sum(words[d] * n for d, n in times.items())
    longest = max(words.values())
    assert abs(total - 1.5 * sum(words.values())) <= longest * before.source.nunique() / 2


def test_every_row_gets_a_place(outputs):
    before, after = outputs[4], outputs[5]
    assert Counter(after.doc_id) == Counter(before.doc_id)
    counts = after.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in after.groupby("shard"))
