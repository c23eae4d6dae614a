"""Quality rules by repetition coverage.

Rolling hashes of several word n-gram lengths, taken over whole texts in numpy, mark the words that
stand inside n-grams which occurred before in the same text; prefix sums turn the marks into
code points. The first occurrence does not count, so one repeated line costs a text its length once. Equal lines are found by hashing whole lines. A text is kept when the share of its
characters inside repeated n-grams stays at or below each length's limit, the share inside repeated
lines below its own, and the basic counts hold.

One narrow pass: no shuffle, no state between documents, so a hot source or a long text costs only
its own bytes. Null and empty texts count zero everywhere and fail. Repeated rows get equal results;
an empty table gives an empty table; other columns pass through, and a column that bears the name
of the output column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlake.llm import _text as X
from mentionlake.llm._spark import text_udf

#: Largest share of a text's word characters inside n-grams of a length that occurred before.
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
SYMBOL_LIMIT = 0.10
MIN_WORDS = 10
REPEAT_PERCENT = 20

SCHEMA = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "base_failed:boolean,kept:boolean,dup_line_chars:bigint,gram_coverage:double>"
)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_DOC_KEY = X.U64(0x8CB92BA72F3D8DD7)


def _covered(keys: np.ndarray, n: int, words: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """Words inside windows of n words that occur at least twice in their text: in all of them, and in all but the first."""
    m = len(words.doc)
    inside, later = np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
    gram = X.grams(keys, n)
    if len(gram):
        whole = np.flatnonzero(words.doc[: len(gram)] == words.doc[n - 1 :])
        gram = gram[whole] ^ X.mix((words.doc[whole].astype(np.uint64) + X.U64(1)) * _DOC_KEY)
        i = np.flatnonzero(X.repeated(gram))
        again = np.ones(len(i), dtype=bool)
        again[np.unique(gram[i], return_index=True)[1]] = False
        for marks, at in ((inside, whole[i]), (later, whole[i[again]])):
            marks[at] += 1
            marks[at + n] -= 1
    return np.cumsum(inside[:m]) > 0, np.cumsum(later[:m]) > 0


def _measure(data: np.ndarray, offs: np.ndarray, limits: dict[int, float], line_limit: float, symbol_limit: float, min_words: int) -> dict[str, np.ndarray]:
    words = X.Words(data, offs)
    prefix = words.prefix()
    keys = words.span_hash(prefix, words.start, words.end)
    points = X.code_points(data)
    chars = points[words.end] - points[words.start]
    word_chars = X.per_doc(X.summed(chars), words.bounds)
    out = {"n_words": words.counts.astype(np.int64), "word_chars": word_chars, "n_symbols": X.per_doc(X.summed(_SYMBOL[data]), offs)}

    # lines: cut after each \n and at document borders
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(offs[:-1], breaks + 1)
    start = start[start < len(data)]
    doc = np.searchsorted(offs, start, side="right") - 1
    end = np.minimum(np.append(start[1:], len(data)), offs[doc + 1]) if len(start) else start
    end = np.where((end > start) & (data[np.maximum(end - 1, 0)] == 10), end - 1, end) if len(start) else end
    n_before = np.searchsorted(words.start, start)
    n_after = np.searchsorted(words.start, end)
    real = np.flatnonzero(n_after > n_before)
    start, end, doc = start[real], end[real], doc[real]
    line = words.span_hash(prefix, start, end) ^ X.mix((doc.astype(np.uint64) + X.U64(1)) * _DOC_KEY)
    order = np.argsort(line, kind="stable")
    later = np.zeros(len(line), dtype=bool)
    if len(line) > 1:
        later[order[1:]] = line[order[1:]] == line[order[:-1]]
    n = len(offs) - 1
    out["n_dup_lines"] = np.bincount(doc[later], minlength=n).astype(np.int64)
    line_chars = X.summed(chars)
    inside = line_chars[n_after[real]] - line_chars[n_before[real]]
    out["dup_line_chars"] = np.bincount(doc[later], weights=inside[later], minlength=n).astype(np.int64)

    kept = np.ones(n, dtype=bool)
    coverage = np.zeros(n)
    for length in sorted({5, *limits}):
        marked, again = _covered(keys, length, words)
        if length == 5:
            out["n_repeat_words"] = X.per_doc(X.summed(marked), words.bounds)
        if length in limits:
            share = X.per_doc(X.summed(chars * again), words.bounds) / np.maximum(word_chars, 1)
            coverage = np.maximum(coverage, share)
            kept &= share <= limits[length]
    out["gram_coverage"] = coverage
    out["base_failed"] = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    kept &= out["dup_line_chars"] <= line_limit * word_chars
    kept &= out["n_symbols"] <= symbol_limit * np.maximum(word_chars, 1)
    out["kept"] = kept & ~out["base_failed"]
    return out


_TYPES = {"base_failed": pa.bool_(), "kept": pa.bool_(), "gram_coverage": pa.float64()}
_NAMES = [x.split(":")[0] for x in SCHEMA[7:-1].split(",")]


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    out: str = "rules",
    gram_limits: dict[int, float] = GRAM_LIMITS,
    line_limit: float = LINE_LIMIT,
    symbol_limit: float = SYMBOL_LIMIT,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Adds the struct column `out`: the counts, `base_failed`, `kept`, characters inside repeated lines and the largest n-gram coverage.

    Null or empty text: zeros, ``base_failed`` true, ``kept`` false.
    """
    limits = dict(gram_limits)

    def measure(column: pa.Array) -> pa.Array:
        parts = [_measure(d, o, limits, line_limit, symbol_limit, min_words) for _, _, d, o in X.chunks(column)]
        if not parts:
            parts = [_measure(np.zeros(0, np.uint8), np.zeros(1, np.int64), limits, line_limit, symbol_limit, min_words)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts]), _TYPES.get(k, pa.int64())) for k in _NAMES], names=_NAMES)

    return docs.withColumn(out, text_udf(docs.sparkSession, SCHEMA, measure)(F.col(text)))
