"""Quality classifier: naive Bayes support vectors.

A document is a set of n-gram indicators: byte n-grams and word n-grams hashed into `BUCKETS`, and
a few that tell whether word 5-grams occur again in the same text. Indicators are scaled by
the log ratio of their smoothed class counts, and a linear hinge-loss model is fitted on them by
dual coordinate descent in numpy, over a bounded sample of labelled rows. The final weights are
interpolated with their mean magnitude, and a logistic curve over rows set aside turns margins into scores.

Scoring sums weights over a document's distinct indicators: one narrow pass over whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlake.llm import _text as X
from mentionlake.llm._spark import text_udf
from mentionlake.llm._sample import sample_by_label

BUCKETS = 1 << 16
EXTRA = 64
LENGTHS = (1, 2, 4)
#: Labelled rows of each class that training reads at most (in expectation).
PER_CLASS = 4_000
EPOCHS = 12
PENALTY = 1.0
BETA = 0.6
THRESHOLD = 0.7

_DOC_KEY = X.U64(0x8CB92BA72F3D8DD7)
_MULTIPLIER = X.U64(0x9E3779B97F4A7C15)


def indicators(data: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS):
    """For each document the sorted distinct indicators."""
    n = len(offs) - 1
    words = X.Words(data, offs)
    shift = X.U64(64 - int(buckets).bit_length() + 1)
    at = X.eights(data)
    key = words.hashes()
    streams = []
    for k in LENGTHS:
        h = (X.mix((at[: len(data)] & X.U64((1 << (8 * k)) - 1)) + X.U64(k << 56)) * _MULTIPLIER) >> shift
        streams.append((h.astype(np.int64), offs, k))
    streams.append(((X.mix(key + X.U64(77)) >> shift).astype(np.int64), words.bounds, 1))
    streams.append(((X.grams(key, 2) >> shift).astype(np.int64), words.bounds, 2))
    # words inside 5-grams that occur again, as a binned share; and the binned number of words
    marked = np.zeros(len(key) + 1, dtype=np.int64)
    five = X.grams(key, 5)
    if len(five):
        whole = np.flatnonzero(words.doc[: len(five)] == words.doc[4:])
        twice = whole[X.repeated(five[whole] ^ X.mix((words.doc[whole].astype(np.uint64) + X.U64(1)) * _DOC_KEY))]
        marked[twice] += 1
        marked[twice + 5] -= 1
    again = X.per_doc(X.summed(np.cumsum(marked[:-1]) > 0), words.bounds) / np.maximum(words.counts, 1)
    bins = buckets + np.searchsorted([0.0001, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8], again, side="right")
    size = buckets + 16 + np.minimum(np.log2(words.counts + 1).astype(np.int64), 20)
    flags = np.zeros(buckets + EXTRA, dtype=bool)
    for d in range(n):
        for h, bounds, k in streams:
            flags[h[bounds[d] : max(bounds[d], bounds[d + 1] - k + 1)]] = True
        flags[bins[d]] = True
        flags[size[d]] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        yield found


class Model:
    """Weights by indicator, bias, and the logistic curve's slope and offset."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(max(1, len(found)))) + self.bias


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, penalty: float = PENALTY, epochs: int = EPOCHS, seed: int = 2) -> np.ndarray:
    """L1 hinge loss with L2 regularisation: one dual variable a row, updated in random order. `y` is -1 or 1."""
    w = np.zeros(size)
    alpha = np.zeros(len(rows))
    norm = np.array([v @ v for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            k, v = rows[i]
            step = (1 - y[i] * (w[k] @ v)) / norm[i]
            new = min(max(alpha[i] + step, 0.0), penalty)
            if new != alpha[i]:
                w[k] += (new - alpha[i]) * y[i] * v
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-4 * penalty:
            break
    return w


def _curve(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin, with smoothed targets, by Newton steps."""
    n1, n0 = positive.sum(), (~positive).sum()
    t = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def train(texts: pa.Array, label: np.ndarray, held: np.ndarray, buckets: int = BUCKETS, epochs: int = EPOCHS, penalty: float = PENALTY) -> Model:
    """Fits on rows where `held` is false; the curve on the others (on all, if they lack a class)."""
    docs = [f for _, _, d, o in X.chunks(texts) for f in indicators(d, o, buckets)]
    positive = label.astype(bool)
    size = buckets + EXTRA
    learn = np.flatnonzero(~held)
    count = np.ones((2, size))
    for i in learn:
        count[int(positive[i])][docs[i]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    # a constant indicator at the end is the bias
    rows = [(np.append(docs[i], size), np.append(ratio[docs[i]] / np.sqrt(max(1, len(docs[i]))), 1.0)) for i in learn]
    w = dual_descent(rows, np.where(positive[learn], 1.0, -1.0), size + 1, penalty, epochs)
    inner = (1 - BETA) * np.abs(w[:size]).mean() + BETA * w[:size]
    model = Model((ratio * inner), float(BETA * w[size]))
    test = np.flatnonzero(held)
    if len(set(positive[test])) < 2:
        test = np.arange(len(docs))
    if len(test):
        model.slope, model.offset = _curve(np.array([model.margin(docs[i]) for i in test]), positive[test])
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", may_learn: str = "true", per_class: int = PER_CLASS, **options) -> Model | None:
    """A model from documents with a label for which the SQL condition `may_learn` holds. The sample is drawn from
    the labels, so what is sent to the documents is bounded by `per_class`. Several labels of a document count as the largest;
    a document's label without a text is not used. None if there is nothing to learn from."""
    known = labels.filter(F.expr(may_learn) & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    some = sample_by_label(known, "_y", "_id", per_class).groupBy("_id").agg(F.max("_y").alias("_y"))
    # documents that repeat a doc_id give the label one text, the first by its hash: the sample keeps its bound
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("t")).join(F.broadcast(some), "_id")
    got = texts.groupBy("_id").agg(F.min_by(F.struct("t", "_y"), F.struct(F.xxhash64("t"), F.length("t"))).alias("x")).select("_id", "x.*")
    got = got.withColumn("held", F.pmod(F.xxhash64("_id", F.lit(8)), F.lit(5)) == 0).orderBy(F.xxhash64("_id"), F.xxhash64("t")).toArrow()
    if not got.num_rows:
        return None
    return train(got.column("t").combine_chunks(), got.column("_y").to_numpy(), got.column("held").to_numpy().astype(bool), **options)


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score (0 to 1, likelier label 1 the higher) as column `out`, which is replaced if it exists.
    Null and empty texts are scored as having no n-grams; without a model every score is 0.5. A very long text is
    read whole. Repeated rows get equal scores; an empty table gives an empty table; other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(column: pa.Array) -> pa.Array:
        m = shared.value
        if m is None:
            return pa.array(np.full(len(column), 0.5))
        z = np.array([m.margin(f) for _, _, d, o in X.chunks(column) for f in indicators(d, o, len(m.weights) - EXTRA)])
        return pa.array(1 / (1 + np.exp(-np.clip(m.slope * z + m.offset, -30, 30))), pa.float64())

    return docs.withColumn(out, text_udf(docs.sparkSession, "double", rate)(F.col(text)))
