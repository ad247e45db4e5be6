import numpy as np
import pytest

from streampace.llm import language_id as li
from streampace.llm.queries import op7_language_id

SF = "/root/testdata/sf0.001"


@pytest.fixture
def model(spark):
    rows = [("en", "the thing that is with the other and the " * 9999),
            ("de", "der die das und einheit werden ein " * 9999),
            (None, "ignored"), ("xx", "123"), ("fr", None)]
    return li.learn(spark.createDataFrame(rows, "lang string, text string"))


def reference_share(text, model, langs):
    """Plain mixture fit of one text, one gram at a time."""
    found = li.grams(text)
    cols = [model.langs.index(x) for x in langs]
    p = np.exp(model.logp[found][:, cols].astype(float))
    share = np.full(len(langs), 1 / len(langs))
    for _ in range(li.ITERATIONS):
        share = np.mean([row * share / (row @ share) for row in p], 0)
    return share


def test_only_rows_with_language_and_letters_teach(model):
    assert model.langs == ["de", "en"]
    assert model.logp.shape == (li.GRAMS, 2)
    assert np.allclose(np.exp(model.logp.astype(float)).sum(0), 1)


def test_mixture_equals_gram_by_gram_fit(model):
    text = "the thing that is with the other " * 3 + "der die das und einheit werden " * 2
    (got,) = li.identify([text], model)
    assert got["langs"] == ["en", "de"]
    assert np.allclose(got["shares"], reference_share(text, model, ["en", "de"]), atol=1e-4)
    assert got["lang_pred"] == "en" and got["score"] == got["shares"][0]


def test_pure_texts_get_one_language_and_batches_do_not_matter(model):
    texts = ["the other thing", "der einheit", None, "", "12 !?", "ß", "the " * 50_000]
    got = li.identify(texts, model)
    assert [g["lang_pred"] for g in got] == ["en", "de", "und", "und", "und", got[5]["lang_pred"], "en"]
    assert got[2] == {"lang_pred": "und", "score": 0.0, "langs": [], "shares": []}
    assert [li.identify([t], model)[0] for t in texts] == got


def test_nothing_learned_and_empty_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string, doc_id long, score int")
    model = li.learn(empty)
    assert model.langs == []
    assert li.identify(["abc"], model)[0]["lang_pred"] == "und"
    assert li.drop_undetermined(empty, model).columns == ["lang", "text", "doc_id", "score"]
    assert li.drop_undetermined(empty, model).count() == 0


def test_held_out_accuracy_and_kept_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op7_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.93
    assert got.score.between(0, 1).all()
    mixed = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(None, None), (1, "..")], "doc_id long, text string"))
    kept = li.drop_undetermined(mixed, li.learn(docs))
    assert kept.columns == ["doc_id", "text"] and kept.count() == docs.count()
