"""Token counts of whole texts, without the tokens.

A text is split where no token can reach across: before a run of spaces. Pieces of the vocabulary hold
the space mark only at their start, which is checked when the model is loaded, so the number of tokens
of a text is the sum over its segments. Segments unknown to the worker are encoded in one batch, only
their lengths are kept, and the batches are cut by bytes.

Null and empty texts have no tokens. A segment of any length is encoded as one. Repeated rows are
counted one by one, an empty table gives an empty result, and other columns pass through untouched. Columns called
like those of the result are replaced.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from streampace.llm.common import slices

MARK = "▁"
REMEMBERED = 400_000
_SEGMENT = re.compile(" +[^ ]*")


class Lengths(dict):
    """Token counts of segments seen so far; emptied when it holds ``REMEMBERED`` of them."""

    def __init__(self, model: str):
        super().__init__()
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = map(self.encoder.id_to_piece, range(self.encoder.get_piece_size()))
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces)
        if self.encoder.encode("a", out_type=str)[0][0] != MARK:
            self.splits = False

    def segments(self, text: str) -> list[str]:
        """Parts of a text whose counts add up. Each stands for itself with one space before it."""
        if not text or not self.splits:
            return [text] if text else []
        spaced = " " + text.replace(MARK, " ")
        if "  " in spaced or spaced[-1] == " ":
            return [s[1:] for s in _SEGMENT.findall(spaced)]
        return spaced[1:].split(" ")

    def learn(self, segments: set[str]) -> None:
        missing = list(segments.difference(self))
        if len(self) + len(missing) > REMEMBERED:
            self.clear()
            missing = list(segments)
        self.update(zip(missing, map(len, self.encoder.encode(missing, num_threads=1)), strict=True))
        self[""] = 1  # a single space at the end


@functools.cache
def lengths(model: str) -> Lengths:
    return Lengths(model)


def count_tokens(texts: list[str | None], model: str) -> list[int]:
    """Tokens of each text, as encoding it whole would give."""
    known = lengths(model)
    parts = [known.segments(t) if t else [] for t in texts]
    known.learn(set().union(*parts))
    return [sum(map(known.__getitem__, p)) for p in parts]


def with_token_counts(docs: DataFrame, model: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Columns of ``docs`` with these names are replaced.
    """
    made = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c not in (text, *made)]
    schema = T.StructType([docs.schema[c] for c in kept]).add("n_bytes", "long").add(
        "n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                texts = batch.column(text).to_pylist()
                n = count_tokens(texts, model)
                yield pa.RecordBatch.from_arrays(
                    [*map(batch.column, kept),
                     pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                     pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=[*kept, *made])

    return docs.select(*kept, text).mapInArrow(run, schema)
