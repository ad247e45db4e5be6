"""Languages of whole texts as mixtures.

Every text is a bag of hashed byte trigrams drawn from a mixture of languages. Trigram counts per
language are learned in one pass; expectation-maximisation then estimates the proportions of the
languages in each text, and a language joins the set only if it raises the likelihood by more than a
penalty (half the logarithm of the independent observations, a third of the overlapping trigrams).

The model has ``GRAMS`` x languages entries whatever the size of the input. Null texts and texts
without a letter are undetermined (``und``, score 0); so is every text if nothing was learned. Texts of
any length are read whole. Equal likelihoods prefer the language that sorts first. Repeated rows are judged one by
one, columns may have any names, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streampace.llm.common import aside, slices

UNKNOWN = "und"
GRAMS = 1 << 16
ITERATIONS = 12
OVERLAP = 3
SMOOTHING = 0.5
RESULT = "lang_pred string, score double, langs array<string>, shares array<double>"
# ASCII bytes other than letters become spaces, so that digits and punctuation do not count.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


class Model(NamedTuple):
    langs: list[str]
    logp: np.ndarray    # (GRAMS, languages)


def grams(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased UTF-8 bytes, padded with a space on both sides."""
    b = _FOLD[np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)]
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return (code * np.uint32(2654435761)) >> 16


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = grams(text)
    if len(found) > 1500:  # counting all grams is then quicker than sorting those of the text
        n = np.bincount(found, minlength=GRAMS)
        ids = np.flatnonzero(n)
        return ids, n[ids]
    return np.unique(found, return_counts=True)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, gram, n)`` over all rows with a language and a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, text):
                for t, name in zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist(),
                                   strict=True):
                    if has_letter(t):
                        total = totals.setdefault(name, np.zeros(GRAMS, np.int64))
                        ids, n = counted(t)
                        total[ids] += n
        for name, total in totals.items():
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(ids), pa.string()), pa.array(ids, pa.int32()),
                 pa.array(total[ids], pa.int64())], names=["lang", "gram", "n"])

    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    return rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on all rows of ``docs``. The driver receives at most ``GRAMS`` counts per language."""
    found = gram_counts(docs, text, lang).toArrow()
    names = found.column("lang").to_pylist()
    langs = sorted(set(names))
    at = {name: i for i, name in enumerate(langs)}
    n = np.zeros((GRAMS, len(langs)))
    n[found.column("gram").to_numpy(), [at[x] for x in names]] = found.column("n").to_numpy()
    n += SMOOTHING
    return Model(langs, np.log(n / n.sum(0, keepdims=True)).astype(np.float32))


def _em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, of: np.ndarray,
        allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text; ``allowed`` marks the languages of its set."""
    total = np.add.reduceat(n, starts)
    share = (allowed / allowed.sum(1, keepdims=True)).astype(p.dtype)
    for _ in range(ITERATIONS):
        w = p * share[of]
        w *= (n / w.sum(1))[:, None]
        share = np.add.reduceat(w, starts) / total[:, None]
    return share, np.add.reduceat(n * np.log((p * share[of]).sum(1)), starts)


class Bags:
    """Grams of many texts end to end: likelihoods ``p`` relative to the best language of each gram."""

    def __init__(self, sizes: np.ndarray, n: np.ndarray, p: np.ndarray):
        self.sizes, self.n, self.p = sizes, n, p
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.of = np.repeat(np.arange(len(sizes)), sizes)

    def only(self, texts: np.ndarray) -> Bags:
        keep = np.zeros(len(self.sizes), bool)
        keep[texts] = True
        grams_kept = keep[self.of]
        return Bags(self.sizes[keep], self.n[grams_kept], self.p[grams_kept])


def mixtures(bags: list[tuple[np.ndarray, np.ndarray]], model: Model) -> np.ndarray:
    """Proportions (texts x languages); languages outside the selected set have 0.

    The likelihood is concave in the proportions, so its slope at a single language bounds what any
    mixture can gain; texts whose bound is below the penalty need no iteration.
    """
    ids = np.concatenate([i for i, _ in bags])
    n = np.concatenate([c for _, c in bags]).astype(np.float32)
    logp = model.logp[ids]
    logp -= logp.max(1, keepdims=True)
    every = Bags(np.array([len(i) for i, _ in bags]), n, np.exp(logp))
    count, rows = len(model.langs), np.arange(len(bags))
    alone = np.add.reduceat(n[:, None] * logp, every.starts)
    total = np.add.reduceat(n, every.starts)
    best = alone.argmax(1)
    share = np.zeros((len(bags), count))
    share[rows, best] = 1.0
    penalty = 0.5 * np.log(np.maximum(total / OVERLAP, 2.0))
    lead = every.p[np.arange(len(ids)), best[every.of]]
    slope = np.add.reduceat(every.p * (n / lead)[:, None], every.starts) - total[:, None]
    active = np.flatnonzero(slope.max(1) / OVERLAP > penalty)
    current = alone[rows, best] / OVERLAP
    order = None
    for k in range(2, count + 1):
        if not len(active):
            break
        some = every.only(active)
        if order is None:
            order = np.zeros((len(bags), count), int)
            first, _ = _em(some.p, some.n, some.starts, some.of, np.ones((len(active), count)))
            first[np.arange(len(active)), best[active]] = 2.0
            order[active] = np.argsort(-first, 1, kind="stable")
        allowed = np.zeros((len(active), count))
        np.put_along_axis(allowed, order[active, :k], 1.0, 1)
        tried, fit = _em(some.p, some.n, some.starts, some.of, allowed)
        better = fit / OVERLAP - penalty[active] > current[active]
        active = active[better]
        share[active] = tried[better]
        current[active] = fit[better] / OVERLAP
    return share


def identify(texts: list[str | None], model: Model) -> list[dict]:
    """Lead language, its share, and the selected set of each text."""
    none = {"lang_pred": UNKNOWN, "score": 0.0, "langs": [], "shares": []}
    known = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
    out = [none] * len(texts)
    if known:
        for i, share in zip(known, mixtures([counted(texts[i]) for i in known], model), strict=True):
            chosen = sorted(np.flatnonzero(share), key=lambda j: (-share[j], j))
            out[i] = {"lang_pred": model.langs[chosen[0]], "score": float(min(1.0, share[chosen[0]])),
                      "langs": [model.langs[j] for j in chosen], "shares": [float(share[j]) for j in chosen]}
    return out


def languages(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Struct column of ``lang_pred``, ``score``, ``langs`` and ``shares``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def run(values: pa.Array) -> pa.Array:
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()),
                          ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])
        out = []
        for part in slices(pa.RecordBatch.from_arrays([values], names=["t"]), "t"):
            out += identify(part.column("t").to_pylist(), shared.value)
        return pa.array(out, kind)

    return run.asNondeterministic()(F.col(text))


def drop_undetermined(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text has a language, with the columns of ``docs``."""
    docs, back = aside(docs, ["_found"])
    found = docs.withColumn("_found", languages(docs, model, text))
    return back(found.filter(F.col("_found.lang_pred") != UNKNOWN).drop("_found"))
