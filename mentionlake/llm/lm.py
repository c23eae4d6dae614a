"""Language-model scoring with a weighted backoff automaton.

The model is a word n-gram model (order 3 by default), each order smoothed by a Dirichlet prior over
the order below, down to the unigram base. Every n-gram seen in training that is shorter than the
order is a state, as are the root and the start of a text. A state has an arc for each word that
followed it in training, and a failure arc to the state of its longest proper suffix, so failures
form chains that end at the root; the root has an arc for every word, unknown ones included. The
weight of an arc is the log10 probability of its word in that state, a failure arc's weight the log10
of the mass its state leaves to the state below. A text is scored in one traversal from left to right
that carries the state, follows failure arcs until an arc for the next word is found, and adds up the
weights. Many walkers move in step, each over its own stretch of a text; a walker that starts inside
a text first takes the `order` - 1 words before its stretch, after which its state is the one a walker
from the text's start would have.

Counts cover the whole corpus. Documents are hashed into blocks of bounded size; a block asks for the
n-grams it holds, each once, as sorted hashes with the block's own training counts, range by range of
the hashes. A range adds up the counts of all blocks and answers each block, in the order it asked,
with what the other blocks hold. The block then has all arcs that its texts can take. No table of the
vocabulary is ever broadcast, collected or held in one task, and no count is pruned. What is exchanged
is in proportion to the texts; it comes in no more rows than blocks times ranges, and ranges cover the
n-grams of several blocks each, nor in more rows than there are n-grams.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlake.llm import _text as X
from mentionlake.llm._spark import trim

#: Weights of the priors of orders 2, 3, ..., in occurrences; their number sets the model's order.
PRIORS = (300.0, 6.0)
#: UTF-8 bytes of a block's texts, on average.
BLOCK_BYTES = 12 << 20
#: UTF-8 bytes of the texts whose n-grams of one length fall into one range, on average.
RANGE_BYTES = 48 << 20
#: N-grams of two words and more are told apart by this many bits more than it takes to number the corpus's bytes:
#: an n-gram not seen in training is taken for one that was with a probability under 2 ** -SPARE_BITS.
SPARE_BITS = 26
#: Tokens of a walker's stretch.
STRETCH = 256

_END = X.U64(0x5851F42D4C957F2D)
_START = X.U64(0x14057B7EF767814F)
_PAIR = X.U64(0xD1342543DE82EF95)


def _planes(x: np.ndarray) -> bytes:
    """A number array by byte planes, so that leading zeros stand together, compressed."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unplanes(raw: bytes, dtype) -> np.ndarray:
    size, n = np.dtype(dtype).itemsize, int.from_bytes(raw[:8], "little")
    flat = pa.decompress(raw[8:], decompressed_size=n * size, codec="zstd") if n else b""
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def _packed(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=X.U64(0)))


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, np.uint64), dtype=np.uint64)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text's words in lower case and its end; and the texts' bounds."""
    parts, counts = [], []
    for _, _, data, offs in X.chunks(column):
        words = X.Words(X.ASCII_LOWER[data], offs)
        n = words.counts + 1
        ends = np.cumsum(n)
        out = np.empty(int(ends[-1]), dtype=np.uint64)
        inside = np.ones(len(out), dtype=bool)
        inside[ends - 1] = False
        out[inside] = words.hashes()
        out[ends - 1] = _END
        parts.append(out)
        counts.append(n)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(counts)))


def _levels(token: np.ndarray, bounds: np.ndarray, order: int, bits: int):
    """For each length n the positions at which an n-gram ends (start and words) and the keys of these n-grams, in `bits` bits."""
    gram = token
    yield np.arange(len(token), dtype=np.int32), gram
    first = bounds[:-1]
    inside = np.arange(len(token), dtype=np.int32) - np.repeat(first.astype(np.int32), np.diff(bounds))
    for n in range(2, order + 1):
        before = np.empty_like(gram)
        before[1:] = gram[:-1]
        if n == 2:
            before[first] = _START
        gram = X.mix(before * _PAIR + token)
        del before
        where = np.flatnonzero(inside >= n - 2).astype(np.int32)
        yield where, gram[where] >> X.U64(64 - bits)


class _Grams:
    """Distinct n-grams of one length in a block: sorted keys, counts in the block's training texts, a place of each, and the number of each occurrence's."""

    def __init__(self, where: np.ndarray, keys: np.ndarray, training: np.ndarray, starts: int | None):
        self.keys, place, self.which = np.unique(keys, return_index=True, return_inverse=True)
        self.place, self.which = where[place], self.which.astype(np.int32)
        self.own = np.bincount(self.which[training[where]], minlength=len(self.keys)).astype(np.uint32)
        if starts is not None:  # texts in training follow the start; it stands among the words
            at = int(np.searchsorted(self.keys, _START))
            self.start = at
            self.keys, self.own, self.place = np.insert(self.keys, at, _START), np.insert(self.own, at, np.uint32(starts)), np.insert(self.place, at, 0)
            self.which += self.which >= at


def _block(table: pa.Table, order: int, bits: int):
    """The texts' bounds, and where n-grams of each length end and which there are, length by length."""
    token, bounds = tokens(table.column("text"))
    learn = table.column("learn").to_numpy().astype(bool)
    training = np.repeat(learn, np.diff(bounds))
    levels = enumerate(_levels(token, bounds, order, bits), 1)
    return bounds, ((where, _Grams(where, keys, training, int(learn.sum()) if n == 1 else None)) for n, (where, keys) in levels)


def _edges(ranges: int, bits: int) -> np.ndarray:
    return np.array([(i << bits) // ranges for i in range(1, ranges)], dtype=np.uint64)


_ASK = "shard long, block long, keys binary, counts binary"
_ASK_PA = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _ask(table: pa.Table, order: int, bits: int, ranges: int) -> pa.Table:
    block, rows = table.column("block")[0].as_py(), []
    for n, (_, grams) in enumerate(_block(table, order, bits)[1]):
        cut = [0, *np.searchsorted(grams.keys, _edges(ranges, 64 if n == 0 else bits)).tolist(), len(grams.keys)]
        for r, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a or n == 0:  # every range of the words tells each block its totals
                rows.append((n * ranges + r, block, _packed(grams.keys[a:b]), _planes(grams.own[a:b])))
        del grams
    out = pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ASK_PA)], schema=_ASK_PA)
    trim()
    return out


_ANSWER = "shard long, block long, others binary, n long, v long"
_ANSWER_PA = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("others", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
#: Keys that a range sorts at once.
_TOGETHER = 1 << 20


def _answer(table: pa.Table, ranges: int) -> pa.Table:
    """What each block's n-grams count in the other blocks, in the order asked; for words also how many occurrences and known words the range holds."""
    shard = table.column("shard")[0].as_py()
    asked = [_unpacked(x.as_py()) for x in table.column("keys")]
    own = [_unplanes(x.as_py(), np.uint32) for x in table.column("counts")]
    others = [np.zeros(len(k), dtype=np.uint64) for k in asked]
    full = [k for k in asked if len(k)]
    low, high = (min(int(k[0]) for k in full), max(int(k[-1]) for k in full)) if full else (0, 0)
    pieces = max(1, sum(map(len, full)) // _TOGETHER)
    edges = np.array([low + (high + 1 - low) * i // pieces for i in range(1, pieces)], dtype=np.uint64)
    cuts = [[0, *np.searchsorted(k, edges).tolist(), len(k)] for k in asked]
    n = v = 0
    for p in range(pieces):
        spans = [slice(c[p], c[p + 1]) for c in cuts]
        mine = np.concatenate([c[s] for c, s in zip(own, spans)]).astype(np.int64)
        distinct, which = np.unique(np.concatenate([k[s] for k, s in zip(asked, spans)]), return_inverse=True)
        total = np.bincount(which, weights=mine, minlength=len(distinct)).astype(np.int64)
        if shard < ranges:
            known = (total > 0) & (distinct != _START)
            n, v = n + int(total[known].sum()), v + int(known.sum())
        rest, at = total[which] - mine, 0
        for out, s in zip(others, spans):
            out[s] = rest[at : at + s.stop - s.start]
            at += s.stop - s.start
    k = table.num_rows
    done = pa.Table.from_arrays([table.column("shard"), table.column("block"), pa.array([_planes(x) for x in others], pa.binary()), pa.array([n] * k, pa.int64()), pa.array([v] * k, pa.int64())], schema=_ANSWER_PA)
    del asked, own, others
    trim()
    return done


class Automaton:
    """The states and arcs that a block's texts can meet.

    State 0 is the root; the other states and all arcs are n-grams, numbered length by length in the
    order of their keys. ``arc[d]`` is the arc at each position that leaves a state of d words, -1 if
    there is none; ``weight`` and ``target`` belong to arcs, ``fail``, ``below`` and ``depth`` to states.
    """

    def __init__(self, bounds: np.ndarray, levels: list[tuple[np.ndarray, _Grams]], counts: list[np.ndarray], n: int, v: int, priors: tuple[float, ...]):
        self.order, self.bounds = len(priors) + 1, bounds
        size = int(bounds[-1])
        words, count = levels[0][1], counts[0]
        real = count * (words.keys != _START)
        p = (real + 0.5) / (n + 0.5 * (v + 1))
        self.known, self.base, self.start = real > 0, np.log10(p), 1 + words.start
        self.arc = np.full((self.order, size), -1, dtype=np.int32)
        self.arc[0] = words.which
        state = np.where(count > 0, 1 + np.arange(len(count)), 0)  # the longest suffix of each n-gram that is a state
        weight, target = [self.base], [state]
        fail, below, depth = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int8)]
        suffix, base, gram = np.zeros(len(count), dtype=np.int64), 0, words.which
        for k in range(1, self.order):  # states of k words and the arcs that leave them
            fail.append(np.log10(priors[k - 1] / (count + priors[k - 1])))
            below.append(suffix)
            depth.append(np.full(len(count), k, dtype=np.int8))
            where, grams = levels[k]
            place, grams.place = grams.place, None
            context, tail = gram[np.maximum(place, 1) - 1], gram[place]
            if k == 1:  # at a text's first word the context is the start
                opening = np.zeros(size + 1, dtype=bool)
                opening[bounds[:-1]] = True
                context = np.where(opening[place], words.start, context)
            p = (counts[k] + priors[k - 1] * p[tail]) / (count[context] + priors[k - 1])
            base += len(count)
            self.arc[k][where] = np.where(counts[k] > 0, base + np.arange(len(grams.keys)), -1).astype(np.int32)[grams.which]
            suffix = state[tail]
            state = np.where((counts[k] > 0) & (k < self.order - 1), 1 + base + np.arange(len(grams.keys)), suffix)
            weight.append(np.log10(p))
            target.append(state)
            gram = np.zeros(size, dtype=np.int32)
            gram[where] = grams.which
            count = counts[k]
        self.weight, self.target = np.concatenate(weight), np.concatenate(target)
        self.fail, self.below, self.depth = np.concatenate(fail), np.concatenate(below), np.concatenate(depth)

    def traverse(self, stretch: int = STRETCH) -> np.ndarray:
        """Log10 probability of each text, from left to right."""
        length = np.diff(self.bounds)
        per = -(-length // stretch)
        text = np.repeat(np.arange(len(length)), per)
        begin = self.bounds[text] + stretch * (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per))
        end = np.minimum(begin + stretch, self.bounds[text + 1])
        early = np.where(begin == self.bounds[text], 0, self.order - 1)  # words to take before the stretch
        todo = end - begin + early
        order = np.argsort(-todo, kind="stable")
        text, todo, early = text[order], todo[order], early[order]
        at = begin[order] - early
        state = np.where(early == 0, self.start, 0)
        total = np.zeros(len(text))
        walking = np.searchsorted(-todo, -np.arange(int(todo[0]) if len(todo) else 0), side="left")
        for step, m in enumerate(walking.tolist()):
            here, now, pos = np.zeros(m), state[:m], at[:m] + step
            arc = self.arc[self.depth[now], pos]
            fails = np.flatnonzero(arc < 0)
            while len(fails):
                here[fails] += self.fail[now[fails]]
                now[fails] = self.below[now[fails]]
                arc[fails] = self.arc[self.depth[now[fails]], pos[fails]]
                fails = fails[arc[fails] < 0]
            here += self.weight[arc]
            total[:m] += np.where(step >= early[:m], here, 0.0)
            state[:m] = self.target[arc]
        return np.bincount(text, weights=total, minlength=len(length))


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORED_PA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(docs: pa.Table, answers: pa.Table, priors: tuple[float, ...], bits: int, ranges: int) -> pa.Table:
    if not docs.num_rows:
        return pa.Table.from_batches([], schema=_SCORED_PA)
    order = len(priors) + 1
    bounds, levels = _block(docs, order, bits)
    levels = list(levels)
    shard, others = answers.column("shard").to_numpy(), answers.column("others")
    told = np.argsort(shard)
    counts = []
    for k, (_, grams) in enumerate(levels):
        parts = [_unplanes(others[int(i)].as_py(), np.uint64) for i in told if shard[i] // ranges == k]
        counts.append((grams.own + np.concatenate(parts)).astype(np.float64))
        grams.own = None
    n, v = int(answers.column("n").to_numpy().sum()), int(answers.column("v").to_numpy().sum())
    length = np.diff(bounds)
    word, first = levels[0][1].which, bounds[:-1]
    model = Automaton(bounds, levels, counts, n, v, priors)
    del levels, counts
    out = [
        docs.column("doc_id"),
        pa.array(~docs.column("learn").to_numpy().astype(bool)),
        pa.array(length),
        pa.array(np.add.reduceat(model.known[word].astype(np.int64), first)),
        pa.array(np.full(len(length), n)),
        pa.array(np.add.reduceat(model.base[word], first)),
        pa.array(model.traverse()),
    ]
    done = pa.Table.from_arrays([c.cast(f.type) for c, f in zip(out, _SCORED_PA)], schema=_SCORED_PA)
    del model, word
    trim()
    return done


def score_texts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    held_out: str | None = None,
    priors: tuple[float, ...] = PRIORS,
    block_bytes: int = BLOCK_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    `held_out` is an SQL condition (default: crc32 of doc_id as text, modulo 5, is 1); where it is null
    the document counts as training. Null and empty texts are their end alone. Rows that repeat a
    doc_id are scored and counted each; those equal in text as well share a block. Very long texts are
    a block's own and are scored in stretches. Other columns are not looked at, whatever their names.
    An empty table gives an empty table.
    """
    held = held_out or f"crc32(cast({doc_id} as string)) % 5 = 1"
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, ranges = max(1, -(-size // block_bytes)), max(1, -(-size // range_bytes))
    bits = min(64, SPARE_BITS + math.ceil(math.log2(size + 2)))
    order = len(priors) + 1
    work = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        (~F.coalesce(F.expr(held), F.lit(False))).alias("learn"),
        # of rows with one doc_id no more than equal texts share a block
        F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)).alias("block"),
    )
    asked = work.groupBy("block").applyInArrow(lambda t: _ask(t, order, bits, ranges), _ASK)
    answers = asked.groupBy("shard").applyInArrow(lambda t: _answer(t, ranges), _ANSWER)
    return work.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda d, a: _score(d, a, priors, bits, ranges), _SCORED)
