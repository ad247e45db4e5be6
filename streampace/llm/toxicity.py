"""Toxicity of whole texts by a weighted grammar over clauses.

Words that mark toxic texts are learned from labels: whole words and the beginnings of words, kept if
their odds are too uneven to be chance among all the candidates. A text is read clause by clause. Three
transducers are composed into one automaton: the first names each word's class (insult, threat, target,
negation, speech verb, other), the second tracks negation and reported speech over the next words, the
third joins insults and threats with a target in the same clause. Each match leaves one pattern; the
weights of the patterns are fitted to the labels, so the data decide how much a negated insult counts.

Null and empty texts match nothing and get the base rate's score. Labels of null count as none; if no row
is labelled, or only one class is, no word is learned and threats alone decide. Long texts are read
whole; repeated rows are scored one by one. Scores depend on the text only; columns are taken by name, others do not
matter. An empty table gives an empty result, and one without labels a model that learned nothing.

``SAMPLE`` labelled rows, those with the smallest hashes of the id, bound what is learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product
from math import exp, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streampace.llm.common import slices
from streampace.plans.durable import durable

SAMPLE = 40_000
STEM = range(3, 9)
CERTAINTY = 0.01        # chance that any of the learned words is there by accident
PRECISION = 0.85        # share of a learned term's texts that are toxic, one clean text added
REACH = 3               # words that a negation or a speech verb covers
# Function words of the grammar.
NEGATIONS = frozenset("not no never isn't aren't nicht kein keine nie pas jamais nunca".split())
SPEECH = frozenset("said says say called calls wrote quoted sagte nannte dit appelé dijo llamó".split())
TARGETS = frozenset("you your he she they them him her we i is are am be du ihr sie er bist sind ist "
                    "tu vous il elle es sont est usted eres son".split())
THREATS = frozenset("kill killing hurt destroy stab shoot burn die töten umbringen tuer matar".split())
_CLAUSE = re.compile(r"[.!?;:,\n\"“”„«»()]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

INSULT, THREAT, TARGET, NEGATION, SPEAKS, OTHER = "insult", "threat", "target", "negation", "speaks", "other"
CLASSES = (INSULT, THREAT, TARGET, NEGATION, SPEAKS, OTHER)


class Transducer(NamedTuple):
    """States are tuples; ``step`` gives the next state and the symbol passed on."""

    start: tuple
    step: dict[tuple[tuple, str], tuple[tuple, str]]


def scope() -> Transducer:
    """Insults and threats become ``plain``, ``negated`` or ``reported`` ones."""
    step = {}
    for negated, reported, symbol in product(range(REACH + 1), range(REACH + 1), CLASSES):
        out = symbol
        if symbol in (INSULT, THREAT):
            out = f"{'negated' if negated else 'reported' if reported else 'plain'} {symbol}"
        after = (REACH if symbol == NEGATION else max(negated - 1, 0),
                 REACH if symbol == SPEAKS else max(reported - 1, 0))
        step[(negated, reported), symbol] = after, out
    return Transducer((0, 0), step)


def aim() -> Transducer:
    """A match after a target, or before one, is aimed; each later target aims the match before it."""
    step = {}
    kinds = [f"{s} {k}" for s in ("plain", "negated", "reported") for k in (INSULT, THREAT)]
    for state, symbol in product(("none", "target", *kinds), (*kinds, TARGET, NEGATION, SPEAKS, OTHER)):
        out = ""
        after = state
        if symbol in kinds:
            out = f"aimed {symbol}" if state == "target" else symbol
            after = "target" if state == "target" else symbol
        elif symbol == TARGET:
            out = f"aiming {state}" if state in kinds else ""
            after = "target"
        step[(state,), symbol] = (after,), out
    return Transducer(("none",), step)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The second reads what the first writes; only states that can be reached are built."""
    start = first.start + second.start
    cut, step, todo, seen = len(first.start), {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in CLASSES:
            a, middle = first.step[state[:cut], symbol]
            b, out = second.step[state[cut:], middle]
            step[state, symbol] = a + b, out
            if a + b not in seen:
                seen.add(a + b)
                todo.append(a + b)
    return Transducer(start, step)


GRAMMAR = compose(scope(), aim())
PATTERNS = sorted({out for _, out in GRAMMAR.step.values() if out})
_AT = {p: i for i, p in enumerate(PATTERNS)}


class Lexicon(NamedTuple):
    words: frozenset[str]
    stems: frozenset[str]

    def insulting(self, word: str) -> bool:
        return word in self.words or any(word[:n] in self.stems for n in STEM)


class Model(NamedTuple):
    lexicon: Lexicon
    base: float
    weights: dict[str, float]


def class_of(word: str, lexicon: Lexicon) -> str:
    if lexicon.insulting(word):
        return INSULT
    for names, name in ((THREATS, THREAT), (NEGATIONS, NEGATION), (SPEECH, SPEAKS), (TARGETS, TARGET)):
        if word in names:
            return name
    return OTHER


def patterns(text: str | None, lexicon: Lexicon, known: dict[str, str]) -> Counter[str]:
    """How often each pattern matches. ``known`` remembers the classes of words."""
    found: Counter[str] = Counter()
    lowered = (text or "").lower()
    words = set(_WORD.findall(lowered))
    for word in words.difference(known):
        known[word] = class_of(word, lexicon)
    marked = {INSULT, THREAT}
    if marked.isdisjoint(map(known.__getitem__, words)):
        return found
    for clause in _CLAUSE.split(lowered):
        symbols = [known[word] if word in known else class_of(word, lexicon) for word in _WORD.findall(clause)]
        if not marked.isdisjoint(symbols):
            state = GRAMMAR.start
            for symbol in symbols:
                state, out = GRAMMAR.step[state, symbol]
                if out:
                    found[out] += 1
    return found


def features(found: Counter[str]) -> np.ndarray:
    """Logarithmic counts, so that a long text is not toxic by its length alone."""
    x = np.zeros(len(PATTERNS))
    for pattern, n in found.items():
        x[_AT[pattern]] = log(1 + n)
    return x


# ---- learning -----------------------------------------------------------------------------------

def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """``(text, toxic)`` of at most ``sample`` labelled rows, stored. The labels sent out are as many."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(
        (F.max(label) > 0).cast("int").alias("toxic")).orderBy(F.xxhash64(doc_id), doc_id).limit(sample)
    return durable(docs.select(doc_id, F.col(text).alias("text")).join(F.broadcast(chosen), doc_id)
                   .select("text", "toxic"), "labelled")


def term_counts(rows: DataFrame, stems: bool) -> DataFrame:
    """``(term, bad, n)``: in how many texts, and how many toxic ones, a word occurs, or its beginnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found: Counter[str] = Counter()
                bad: Counter[str] = Counter()
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(),
                                       strict=True):
                    terms = set(_WORD.findall((text or "").lower()))
                    if stems:
                        terms = {w[:n] for w in terms for n in STEM if len(w) > n}
                    found.update(terms)
                    if toxic:
                        bad.update(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), pa.array([bad[t] for t in found], pa.int64()),
                     pa.array(found.values(), pa.int64())], names=["term", "bad", "n"])

    return rows.mapInArrow(run, "term string, bad long, n long").groupBy("term").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n"))


def telling(counts: DataFrame, rate: float) -> frozenset[str]:
    """Terms nearly all of whose texts are toxic, and so many that chance is ruled out.

    The likelihood ratio against the share ``rate`` is held against the number of candidates, so the list
    stays short however many words there are.
    """
    counts = durable(counts.filter(F.col("bad") > 0), "terms")
    least = log(max(counts.count(), 1) / CERTAINTY)
    share = F.col("bad") / F.col("n")
    clean = 1 - share
    ratio = F.col("n") * (share * F.log(share / rate) + F.when(clean > 0, clean * F.log(clean / (1 - rate))).otherwise(0.0))
    sure = (share > rate) & (F.col("bad") >= PRECISION * (F.col("n") + 1))
    return frozenset(r.term for r in counts.filter(sure & (ratio > least)).select("term").collect())


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words, and beginnings of words that stand for families of words each too rare by itself."""
    total, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not bad or bad == total:
        return Lexicon(frozenset(), frozenset())
    return Lexicon(*[telling(term_counts(rows, stems), bad / total) for stems in (False, True)])


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression over rows that occur ``n`` times, with a ridge on all but the first column."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - penalty * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: int = SAMPLE) -> Model:
    """Words and weights from the labelled rows among ``docs``."""
    rows = labelled(docs, labels, doc_id, text, label, sample)
    lexicon = learn_lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            found = [features(patterns(t, lexicon, known)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f.tolist() for f in found], pa.list_(pa.float64())), batch.column("toxic")],
                names=["x", "toxic"])

    # Equal feature rows are counted; the sample bounds how many there are.
    seen = rows.mapInArrow(run, "x array<double>, toxic int").groupBy("x").agg(
        F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    if not seen:
        return Model(lexicon, -2.0, dict.fromkeys(PATTERNS, 1.0))
    x = np.array([[1.0, *r.x] for r in seen for _ in (0, 1)])
    y = np.tile([1.0, 0.0], len(seen))
    n = np.array([c for r in seen for c in (r.bad, r.n - r.bad)], float)
    w = fit(x, y, n)
    return Model(lexicon, float(w[0]), dict(zip(PATTERNS, map(float, w[1:]), strict=True)))


def score(text: str | None, model: Model, known: dict[str, str]) -> float:
    total = model.base + sum(model.weights[p] * log(1 + n) for p, n in patterns(text, model.lexicon, known).items())
    return 1 / (1 + exp(-min(max(total, -30.0), 30.0)))


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Score between 0 and 1 of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        known: dict[str, str] = {}
        return pa.array([score(t.as_py(), shared.value, known) for t in values], pa.float64())

    return run.asNondeterministic()(F.col(text))
