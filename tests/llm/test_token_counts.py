import public_tokenizers
import sentencepiece

from streampace.llm.token_counts import Lengths, count_tokens, with_token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "  a  b  ", "\n", "a\n\n b", "▁", "a▁b", "▁▁ a ▁",
         "<s> </s> <unk>", "x" * 5000, "日本 語  テ\t\tx", "\x00 a\x00", "é" * 300 + " " * 40 + "b",
         "word and word, " * 20_000]


def whole(texts):
    encoder = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return [len(encoder.encode(t)) if t else 0 for t in texts]


def test_counts_equal_whole_encoding():
    assert count_tokens(TEXTS, MODEL) == whole(TEXTS)


def test_memory_of_segments_is_bounded(monkeypatch):
    monkeypatch.setattr("streampace.llm.token_counts.REMEMBERED", 3)
    known = Lengths(MODEL)
    known.learn({"a", "b"})
    known.learn({"c", "d"})
    assert set(known) == {"c", "d", ""}


def test_rows_nulls_and_clashing_columns(spark):
    rows = [(i % 3 or None, t, 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, n_tokens int")
    got = with_token_counts(docs, MODEL, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(d, len((t or "").encode()), n, n > 100)
            for (d, t, _), n in zip(rows + rows[:1], whole(TEXTS + TEXTS[:1]), strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert with_token_counts(docs.limit(0), MODEL).count() == 0
