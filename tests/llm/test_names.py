"""Stages keep columns of any name, also of names that the operators use inside."""

import corpus_pipeline
import pytest

from streampace.llm import language_id, mixing, near_copies, sharding, simhash

CLASHES = ["_row", "_times", "_found", "lead", "Print", "row", "n", "root", "m", "first", "_Row_aside"]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}", len(t), *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(
        ["the same words here again", "other words of another text", "The same words here again", "one more text of words"])]
    kept = [c for c in CLASHES if c != "_Row_aside"] + ["_Row_aside"]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *kept])


@pytest.mark.parametrize("stage", [
    near_copies.drop_near_copies, simhash.drop_near_duplicates, mixing.mixed_documents, sharding.sharded,
    lambda d: language_id.drop_undetermined(d, language_id.learn(d)), simhash.near_duplicates])
def test_clashing_columns_come_back(docs, stage):
    found = stage(docs)
    left_out = ["text"] if stage is simhash.near_duplicates else []
    assert [c for c in found.columns if c in docs.columns] == [c for c in docs.columns if c not in left_out]
    for r in found.collect():
        assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHES)
    assert found.count() >= 2 and corpus_pipeline.STAGES
