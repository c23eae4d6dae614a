"""Text encoders: anything with ``vectors(list of texts) -> float32 matrix`` can be plugged in."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    def vectors(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEncoder:
    """Signed hashed character n-grams; deterministic, no claim to semantics."""

    def __init__(self, dims: int = 64, lengths: Sequence[int] = (2, 3, 4)):
        self.dims, self.lengths = dims, tuple(lengths)

    def vectors(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for i, t in enumerate(texts):
            padded = f" {(t or '').lower()} "
            for n in self.lengths:
                for k in range(len(padded) - n + 1):
                    h = zlib.crc32(padded[k : k + n].encode())
                    out[i, (h >> 1) % self.dims] += 1 if h & 1 else -1
        return out


class TableEncoder:
    """Vectors from a table of known texts; unknown texts are zero."""

    def __init__(self, known: dict[str, Sequence[float]]):
        self.known = known
        self.dims = len(next(iter(known.values()))) if known else 0

    def vectors(self, texts: Sequence[str]) -> np.ndarray:
        zero = np.zeros(self.dims, dtype=np.float32)
        return np.array([self.known.get(t, zero) for t in texts], dtype=np.float32).reshape(len(texts), self.dims)


def encode(df: DataFrame, encoder: Encoder, column: str, out: str = "vector", batch: int = 128) -> DataFrame:
    """Adds the vector of a text column; the encoder is unpickled once per worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            rows = [v for i in range(0, len(texts), batch) for v in encoder.vectors(texts[i : i + batch])]
            yield pd.Series(rows, dtype=object)

    return df.withColumn(out, run(F.col(column)))
