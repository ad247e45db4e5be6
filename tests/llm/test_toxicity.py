import pytest

from streampace.llm import toxicity as t
from streampace.llm.queries import op5_toxicity

SF = "/root/testdata/sf0.01"
LEXICON = t.Lexicon(frozenset({"grub", "slug"}), frozenset({"vorm"}))


def by_hand(symbols):
    """The grammar as a loop over the words of a clause."""
    negated = reported = 0
    last, out = None, []
    for s in symbols:
        kind = None
        if s in (t.INSULT, t.THREAT):
            kind = f"{'negated' if negated else 'reported' if reported else 'plain'} {s}"
            out.append(f"aimed {kind}" if last == "target" else kind)
            last = "target" if last == "target" else kind
        elif s == t.TARGET:
            if last and last != "target":
                out.append(f"aiming {last}")
            last = "target"
        negated = t.REACH if s == t.NEGATION else max(negated - 1, 0)
        reported = t.REACH if s == t.SPEAKS else max(reported - 1, 0)
    return out


def test_composed_grammar_equals_a_loop():
    import random
    rng = random.Random(1)
    for _ in range(3000):
        symbols = [rng.choice(t.CLASSES) for _ in range(rng.randint(0, 9))]
        state, got = t.GRAMMAR.start, []
        for s in symbols:
            state, out = t.GRAMMAR.step[state, s]
            got += [out] if out else []
        assert got == by_hand(symbols)


@pytest.mark.parametrize(("text", "want"), [
    ("A grub fell.", {"plain insult": 1}), ("You are a GRUB!", {"aimed plain insult": 1}),
    ("not a grub", {"negated insult": 1}), ("wrote slug", {"reported insult": 1}),
    ("not that. A grub", {"plain insult": 1}), ("grub is he", {"plain insult": 1, "aiming plain insult": 1}),
    ("vormling, slugs", {"plain insult": 1}), ("will kill you", {"plain threat": 1, "aiming plain threat": 1}),
    (None, {}), ("", {}), ("nothing here", {}),
])
def test_patterns_of_clauses(text, want):
    assert t.patterns(text, LEXICON, {}) == want


def test_scores_follow_the_fitted_weights_and_edges(spark):
    bad, good = "you absolute grub of the {} day", "the mild weather of the {} day"
    rows = [(i, (bad if i % 4 == 0 else good).format(f"n{i}"), 9) for i in range(400)] + [(None, None, 9), (0, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (301, None)],
                                   "doc_id long, toxic int")
    model = t.learn(docs.filter("doc_id > 0 or doc_id is null"), labels)
    assert "grub" in model.lexicon.words
    got = docs.select("doc_id", "text", t.toxicity(docs, model).alias("p")).collect()
    assert len(got) == 402 and all(0 <= r.p <= 1 for r in got)
    assert all((r.p >= 0.5) == ("grub" in (r.text or "")) for r in got)
    long = spark.createDataFrame([(1, "calm " * 200_000 + "you absolute grub")], "doc_id long, text string")
    assert long.select(t.toxicity(long, model)).first()[0] > 0.5
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert t.learn(docs, none).lexicon == t.Lexicon(frozenset(), frozenset())
    assert docs.limit(0).select(t.toxicity(docs, model)).count() == 0


def test_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op5_toxicity(spark, SF)
    assert got.count() == docs.count()
    held = got.filter("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.toxic).mean() > 0.95
    assert ((held.score >= 0.5) == (held.predicted == 1)).all()
