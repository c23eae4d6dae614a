"""Token taggers: anything with ``scores(text, tokens) -> matrix (tokens x labels)`` and ``labels`` can be plugged in."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlake.functions.udfs import trim

_UNIT = re.compile(r"[^\W_]+|[^\w\s]|_")


class Tagger(Protocol):
    labels: Sequence[str]

    def scores(self, text: str, tokens: Sequence[tuple[int, int]]) -> np.ndarray: ...


class GazetteerTagger:
    """Longest match of known names over tokens, as one-hot scores; not a neural tagger."""

    def __init__(self, names: Sequence[str], label: str = "cell_type"):
        self.labels = ["O", f"B-{label}", f"I-{label}"]
        self.known: dict[tuple[str, ...], bool] = {}
        self.longest = 1
        for n in names:
            key = tuple(m.group().lower() for m in _UNIT.finditer(n))
            if key:
                self.known[key] = True
                self.longest = max(self.longest, len(key))

    def scores(self, text: str, tokens: Sequence[tuple[int, int]]) -> np.ndarray:
        words = [text[a:b].lower() for a, b in tokens]
        out = np.zeros((len(words), 3))
        i = 0
        while i < len(words):
            n = next((n for n in range(min(self.longest, len(words) - i), 0, -1) if tuple(words[i : i + n]) in self.known), 0)
            if n:
                out[i, 1] = 1
                out[i + 1 : i + n, 2] = 1
            else:
                out[i, 0] = 1
            i += n or 1
        return out


#: Rows of tokens that are handed back at a time.
ROWS = 16_384


def scored(batch: pa.RecordBatch, names: Sequence[str], tagger: Tagger, length: int, step: int, stride: int) -> Iterator[pa.RecordBatch]:
    """The rows of `tag` of some passages, `ROWS` and a window's at most at a time, however long the texts are."""
    at, spans, scores = [], [], []  # a row's passage; window, start, end; a matrix a window

    def made() -> pa.RecordBatch:
        values = np.concatenate(scores).astype(np.float64)
        offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        window, start, end = (pa.array(c, pa.int32()) for c in np.array(spans, dtype=np.int32).T)
        kept = batch.select(list(names)).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns, window, start, end, pa.ListArray.from_arrays(offsets, values.ravel())], names=[*names, "window", "start", "end", "scores"])

    for i, text in enumerate(batch.column("text")):
        text = text.as_py() or ""
        tokens = [m.span() for m in _UNIT.finditer(text)]
        for w, first in enumerate(range(0, max(1, len(tokens) - stride), step) if tokens else ()):
            some = tokens[first : first + length]
            got = np.asarray(tagger.scores(text, some))[: len(some)]
            at += [i] * len(got)
            spans += [(w, a, b) for a, b in some[: len(got)]]
            scores.append(got)
            if len(at) >= ROWS:
                yield made()
                at, spans, scores = [], [], []
    if at:
        yield made()


def tag(passages: DataFrame, tagger: Tagger, length: int = 510, stride: int = 128) -> DataFrame:
    """Scores of every token in every window: the passage's columns but its text, window, start, end, scores.

    A text's tokens are cut into overlapping windows, each scored alone."""
    keys = [f for f in passages.schema if f.name != "text"]
    names = [f.name for f in keys]
    step = max(1, length - stride)

    def run(parts):
        for part in parts:
            yield from scored(part, names, tagger, length, step, stride)
        trim()

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keys] + ["window int", "start int", "end int", "scores array<double>"])
    return passages.mapInArrow(run, schema)


def tags(rows: DataFrame, tagger: Tagger, keys: Sequence[str]) -> DataFrame:
    """The tag of each token from its mean scores."""
    from mentionlake.operators.decode import best_label, mean_scores

    k = [*keys, "start", "end"]
    best = best_label(mean_scores(rows, k), k)
    return best.withColumn("tag", F.get(F.array(*[F.lit(x) for x in tagger.labels]), F.col("label_id")))
