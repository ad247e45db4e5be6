import random
import re
import zlib
from collections import Counter

import pytest

from streampace.llm import spelling


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters}
            | {a + c + b[1:] for a, b in cuts if b for c in letters}) - {word}


def brute(counts, ratio=5, least=6):
    letters = {c for w in counts for c in w}
    near = {w: sorted((-counts[o], o) for o in edits(w, letters) if o in counts) for w in counts}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= ratio * counts[w] else None for w in counts}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts.get(form[w], 0)) for w, n in counts.items())


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def invented(rng, n, letters, longest):
    words = {"".join(rng.choices(letters, k=rng.randint(6, longest))) for _ in range(n)}
    for w in list(words):
        words |= set(rng.sample(sorted(e for e in edits(w, "aé") if len(e) >= 6), 2))
    return {w: rng.choice([5, 6, 30, 200, 900, 5000]) for w in words}


@pytest.mark.parametrize("letters,n,longest,group", [("ab", 60, 9, 20_000), ("ab", 60, 9, 3), ("aéß", 80, 12, 20_000), ("abc", 100, 8, 2)])
def test_variants_equal_all_edits(spark, letters, n, longest, group):
    counts = invented(random.Random(n + group), n, letters, longest)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(words, group=group)) == brute(counts)


def test_the_acceptor_is_minimal_and_accepts_its_words():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops"})
    acceptor = spelling.Acceptor(words)
    assert len(acceptor.arcs) == 7        # "", s, s?, p s?, {a,o} p s?, op s?, top s?
    todo, accepted = [(acceptor.start, "")], []
    while todo:
        state, word = todo.pop()
        accepted += [word] * acceptor.final[state]
        todo += [(to, word + a) for a, to in acceptor.arcs[state].items()]
    assert sorted(accepted) == words
    pairs = list(spelling.one_edit_pairs(spelling.Acceptor(["aa", "aaa", "aab", "ab", "abb", "ba"]), 2))
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {("aa", "ab"), ("aa", "ba"), ("aa", "aaa"), ("aa", "aab"), ("ab", "aab"), ("ab", "abb"), ("ba", "aba")} - {("ba", "aba")}


def test_words_of_whole_texts(spark):
    rng = random.Random(5)
    stems = ["Straße", "straßen", "naïveté", "GRÜSSE", "letters", "Letters", "short", "x÷yzabc", "plain1text"]
    texts = [" ".join(rng.choices(stems, k=rng.randint(0, 60))) + rng.choice(["", "-", "\n"]) for _ in range(60)]
    rows = [(i if i % 9 else None, t, "clash") for i, t in enumerate(texts)] + [(7, None, ""), (8, "", ""), (9, "letters. " * 9000, "")]
    want = Counter()
    for d, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{word}".encode())
            want[word if h % 199 else word[:h % len(word)] + word[h % len(word) + 1:]] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    words = spelling.vocabulary(docs, damage=spelling.drop_letter)
    assert {r.word: r.n for r in words.collect()} == want
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0


def test_texts_are_cut_outside_of_words():
    text = "one two, three-four " * 50 + "x" * 100
    parts = list(spelling.pieces(text, 7))
    assert "".join(parts) == text and len(parts) > 90
    assert [w for p in parts for w in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


def test_frequent_words_are_summed_over_tasks_and_batches(spark):
    docs = spark.createDataFrame([(i, "common " * 40 + f"rare{'abcdefghij'[i % 10] * 6}") for i in range(400)], "doc_id long, text string")
    counted = spelling.word_counts(docs.repartition(4), "doc_id", "text", None, distinct=3)
    assert counted.count() > 11
    got = {r[0]: r[1] for r in counted.groupBy("word").sum("n").collect()}
    assert got["common"] == 16000 and len(got) == 11
