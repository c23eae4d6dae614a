"""Functions that built-in expressions can't express, over Arrow batches."""

from __future__ import annotations

import ctypes
import difflib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# types as objects: workers import this module too, and have no context to parse a string in
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FORMS = T.ArrayType(T.StructType([T.StructField("short", T.StringType()), T.StructField("long", T.StringType())]))


def _folded(text: str) -> str:
    return " ".join(text.casefold().split())


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of two folded texts by matching blocks, the first against the second; two empty texts are alike."""
    return pd.Series([difflib.SequenceMatcher(None, _folded(a or ""), _folded(b or "")).ratio() for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def best_ratio(text: pd.Series, names: pd.Series) -> pd.Series:
    """The largest `sequence_ratio` of a text and any of some names; pairs that repeat are computed once a batch."""
    known: dict[tuple, float] = {}

    def ratio(pair: tuple) -> float:
        if pair not in known:
            known[pair] = difflib.SequenceMatcher(None, _folded(pair[0] or ""), _folded(pair[1] or "")).ratio()
        return known[pair]

    return pd.Series([max((ratio((a, b)) for b in some), default=None) for a, some in zip(text, names)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def key_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of two abbreviation keys, case-sensitive; 0 if either is empty."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right)], dtype="float64")


_SPACED = re.compile(r"\S+")
_UNITS = re.compile(r"[^\W_]+|[^\w\s]|_")


#: Texts that are Python objects at a time; Spark's batches may hold ten times as many.
PIECE = 1_000


def trim() -> None:
    """Gives freed memory back to the system; idle workers would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def span_lists(texts: pa.Array, spans: Callable[[str], Iterable[tuple[int, int]]]) -> pa.Array:
    """Each text's (start, end) pairs as a list. The numbers lie in flat buffers: as an object a pair takes thirty times the room."""
    offsets, starts, ends = array("i", [0]), array("i"), array("i")
    for at in range(0, len(texts), PIECE):
        for t in texts.slice(at, PIECE).to_pylist():
            for a, b in spans(t or ""):
                starts.append(a)
                ends.append(b)
            offsets.append(len(starts))
    flat = lambda x: pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)])
    return pa.ListArray.from_arrays(flat(offsets), pa.StructArray.from_arrays([flat(starts), flat(ends)], names=["start", "end"]))


def _span_udf(spans: Callable[[str], Iterable[tuple[int, int]]]):
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield span_lists(part, spans)
        trim()

    return F.arrow_udf(run, SPANS)


def spaced_tokens(text):
    """Offsets of the parts between white space, in code points."""
    return _span_udf(lambda t: (m.span() for m in _SPACED.finditer(t)))(text)


def word_tokens(text):
    """Offsets of word runs and single punctuation marks, in code points."""
    return _span_udf(lambda t: (m.span() for m in _UNITS.finditer(t)))(text)


def long_form(short: str, before: str) -> str | None:
    """Schwartz and Hearst (2003): the shortest end of the text before a parenthesis that spells the short form."""
    i = len(before) - 1
    for s in range(len(short) - 1, -1, -1):
        c = short[s].lower()
        if not c.isalnum():
            continue
        while i >= 0 and (before[i].lower() != c or (s == 0 and i > 0 and before[i - 1].isalnum())):
            i -= 1
        if i < 0:
            return None
        i -= 1
    return before[i + 1 :].strip() or None


_PAREN = re.compile(r"\(([^()]{2,12})\)")


def short_forms(text: str) -> list[tuple[str, str]]:
    """(short form, long form) pairs defined in a text."""
    out = []
    for m in _PAREN.finditer(text):
        short = m[1].strip().split(",")[0].split(";")[0].strip()
        if not (2 <= len(short) <= 10 and short[0].isalnum() and any(c.isalpha() for c in short) and len(short.split()) <= 2):
            continue
        n = min(len(short) + 5, 2 * len(short))
        window = " ".join(text[: m.start()].rsplit(None, n)[-n:])
        found = long_form(short, window)
        if found and len(found) > len(short) and short not in found.split():
            out.append((short, found))
    return out


def form_lists(texts: pa.Array) -> pa.Array:
    """Each text's (short, long) pairs as a list."""
    kind = pa.list_(pa.struct([("short", pa.string()), ("long", pa.string())]))
    parts = (texts.slice(at, PIECE).to_pylist() for at in range(0, len(texts), PIECE))
    made = [pa.array([[{"short": a, "long": b} for a, b in short_forms(t or "")] for t in part], kind) for part in parts]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def detect_abbreviations(text):
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield form_lists(part)
        trim()

    return F.arrow_udf(run, FORMS)(text)


def chunk_spans(text: str, width: int) -> list[tuple[int, int]]:
    """Cuts a text into parts of at most `width`: after the last sentence end, else at the last space, else hard."""
    out, at = [], 0
    while len(text) - at > width:
        part = text[at : at + width]
        cut = max(part.rfind(c) for c in ".!?\n") + 1 or part.rfind(" ") + 1 or width
        out.append((at, at + cut))
        at += cut
    if at < len(text):
        out.append((at, len(text)))
    return out


def text_chunks(width: int):
    return _span_udf(lambda t: chunk_spans(t, width))
