"""Language identification with averaged hashed subword embeddings and a linear softmax.

Subwords are the byte n-grams of each lower-cased word with its surrounding spaces, hashed into
`BUCKETS` vectors. A document is the mean of its subwords' vectors; a linear softmax reads the
language from it. Vectors and weights are trained together by stochastic gradient descent in numpy
on a bounded sample of labelled rows. A part of that sample is set aside to fit the temperature of
the softmax and the score under which a prediction is rejected.

Since the layer is linear, vectors and weights are multiplied once after training, and scoring is a
sum of table rows over the whole text: one narrow pass, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlake.llm import _text as X
from mentionlake.llm._spark import text_udf
from mentionlake.llm._sample import sample_by_label

BUCKETS = 1 << 15
DIMENSIONS = 16
LENGTHS = (2, 3, 4)
#: Labelled rows of each language that training reads at most (in expectation).
PER_LANGUAGE = 1_500
EPOCHS = 6
#: A small sample is read more often, until so many documents have been seen.
MIN_STEPS = 8_000
#: Share of correct calibration documents that rejection may lose.
LOST = 0.001
UNKNOWN = "und"

_MULTIPLIER = X.U64(0x9E3779B97F4A7C15)


def _normal(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, white space as spaces."""
    out = X.ASCII_LOWER[data]
    out[X.WHITE[data]] = 32
    if len(out) > 1:
        upper = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def subwords(data: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS, lengths=LENGTHS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, document by document within a length, as (buckets, document of each)."""
    norm = _normal(data)
    at = X.eights(norm)
    n = len(norm)
    white = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(norm == 32, out=white[1:])
    end = np.repeat(offs[1:], np.diff(offs))
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    pos = np.arange(n)
    shift = X.U64(64 - int(buckets).bit_length() + 1)
    keys, docs = [], []
    for k in lengths:
        m = max(0, n - k + 1)
        ok = pos[:m] + k <= end[:m]
        if k > 2:
            ok &= white[k - 1 : m + k - 1] == white[1 : m + 1]
        else:
            ok &= white[k : m + k] - white[:m] < k
        i = np.flatnonzero(ok)
        key = (at[i] & X.U64((1 << (8 * k)) - 1)) + X.U64(k << 56)
        keys.append(((X.mix(key) * _MULTIPLIER) >> shift).astype(np.int32))
        docs.append(doc[i])
    return np.concatenate(keys), np.concatenate(docs)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


class Model:
    """Languages, one table row of logits per bucket, bias, temperature and the score under which to reject."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, floor: float = 0.0):
        self.labels, self.table, self.bias, self.temperature, self.floor = labels, table, bias, temperature, floor

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        out = np.zeros((n, len(self.labels)))
        total = np.zeros(n)
        key, doc = subwords(data, offs, len(self.table))
        total += np.bincount(doc, minlength=n)
        cut = np.flatnonzero(np.diff(doc, prepend=-1))
        if len(cut):
            sums = np.add.reduceat(self.table[key], cut, axis=0, dtype=np.float64)
            np.add.at(out, doc[cut], sums)
        return (out / np.maximum(total, 1)[:, None] + self.bias) / self.temperature


def train(texts: pa.Array, labels: list[str], held: np.ndarray, epochs: int = EPOCHS, buckets: int = BUCKETS, dims: int = DIMENSIONS, seed: int = 1) -> Model:
    """Fits on the rows where `held` is false; the others set temperature and rejection."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    docs = []
    for _, _, data, offs in X.chunks(texts):
        key, doc = subwords(data, offs, buckets)
        order = np.argsort(doc, kind="stable")
        bounds = np.searchsorted(doc[order], np.arange(len(offs)))
        for a, b in zip(bounds[:-1], bounds[1:]):
            one, count = np.unique(key[order[a:b]], return_counts=True)
            docs.append((one, (count / max(1, b - a)).astype(np.float32)))
    e = (rng.standard_normal((buckets, dims)) / dims).astype(np.float32)
    w = np.zeros((dims, len(names)), dtype=np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    learn = np.flatnonzero(~held & np.array([len(k) > 0 for k, _ in docs], dtype=bool))
    epochs = max(epochs, min(100, -(-MIN_STEPS // max(1, len(learn)))))
    for epoch in range(epochs):
        rate = np.float32(0.5 * (1 - epoch / epochs))
        for i in rng.permutation(learn):
            key, share = docs[i]
            own = e[key]
            mean = share @ own
            g = _softmax(mean @ w + bias)
            g[y[i]] -= 1
            back = w @ g
            w -= rate * np.outer(mean, g)
            bias -= rate * g * np.float32(0.1)
            e[key] = own - np.outer(share * (rate * np.float32(20)), back)
    model = Model(names, (e @ w).astype(np.float32), bias.astype(np.float64))
    z = np.array([c @ model.table[k] if len(k) else np.zeros(len(names)) for k, c in docs]) + model.bias
    z, t = z[held], y[held]
    if len(t):
        grid = np.exp(np.linspace(-3, 3, 61))
        nll = [-np.log(np.maximum(_softmax(z / g)[np.arange(len(t)), t], 1e-12)).mean() for g in grid]
        model.temperature = float(grid[int(np.argmin(nll))])
        p = _softmax(z / model.temperature)
        right = p.argmax(axis=1) == t
        if right.any():
            model.floor = float(np.quantile(p.max(axis=1)[right], LOST))
    return model


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", may_learn: str = "true", per_language: int = PER_LANGUAGE, **options) -> Model | None:
    """A model from rows with text and lang for which the SQL condition `may_learn` holds; None if there are none.
    Rows that repeat a doc_id are sampled together; of the sample, rows are read in an order that ties don't change."""
    known = docs.filter(F.expr(may_learn) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    some = sample_by_label(known, lang, doc_id, per_language)
    got = some.select(F.col(text).alias("t"), F.col(lang).alias("l"), (F.pmod(F.xxhash64(doc_id, F.lit(9)), F.lit(5)) == 0).alias("held")).orderBy(F.xxhash64(doc_id), F.xxhash64(text)).toArrow()
    if not got.num_rows:
        return None
    held = got.column("held").to_numpy().astype(bool)
    if held.all():
        held = np.zeros(len(held), dtype=bool)
    return train(got.column("t").combine_chunks(), got.column("l").to_pylist(), held, **options)


_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _lettered(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out = X.per_doc(X.summed(_ASCII_LETTER[data]), offs) > 0
    for d in np.flatnonzero(~out & (np.diff(offs) > 1)):
        out[d] = any(c.isalpha() for c in data[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


PREDICTION = "struct<lang_pred:string,score:double,rejected:boolean>"


def identify(docs: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """Adds the struct column `out` (replaced if it exists): lang_pred, score, rejected.

    Null, empty and letterless texts are `und` with score 0 and rejected; without a model every text is. Of languages
    that score alike the first by name is predicted. A very long text is read whole. Repeated rows get equal results;
    an empty table gives an empty table; other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(column: pa.Array) -> pa.Array:
        m = shared.value
        name, score, no = [], [], []
        for _, _, data, offs in X.chunks(column):
            seen = _lettered(data, offs) if m is not None else np.zeros(len(offs) - 1, dtype=bool)
            p = _softmax(m.logits(data, offs)) if m is not None else np.zeros((len(seen), 1))
            best = p.argmax(axis=1)
            top = np.where(seen, p[np.arange(len(p)), best], 0.0)
            name += [m.labels[b] if s else UNKNOWN for b, s in zip(best, seen)]
            score.append(top)
            no.append(~seen | (top < (m.floor if m is not None else 1)))
        return pa.StructArray.from_arrays(
            [pa.array(name, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64()), pa.array(np.concatenate(no) if no else [], pa.bool_())],
            names=["lang_pred", "score", "rejected"],
        )

    return docs.withColumn(out, text_udf(docs.sparkSession, PREDICTION, predict)(F.col(text)))
