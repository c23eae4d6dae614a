"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Documents are tokenised where they lie; whole texts are cut at single spaces, where the vocabulary's
pre-tokeniser cuts as well, and the ids of each distinct chunk are kept in a bounded table, so a word
is encoded once per worker and not once per occurrence. Documents longer than a sequence are cut into
pieces of full length after a first, shorter one.

Pieces of equal length are interchangeable, so the packing problem is the histogram of lengths: at
most `capacity` numbers whatever the corpus holds. A chromosome is a set of groups: bin contents with
multiplicities. The first one is plain best-fit's, the others are built bin by bin. Crossover injects another parent's fullest bins whole, removes the receiver's bins
that then hold too many pieces of a length, and best-fits the displaced pieces. Islands evolve in
separate tasks and pass their elites around a ring between epochs. The winner's bins are laid out as
runs of sequences, and every piece finds its place by its number within its length; these numbers
are counted in two levels, so a length that a third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import functools
import json
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionlake.llm import _text as X
from mentionlake.llm._spark import materialise, text_udf, trim

CAPACITY = 1024
END = 2
ISLANDS = 6
#: Epochs at most, and how many without a better bin count end the search.
EPOCHS, PATIENCE = 4, 2
GENERATIONS = 6
POPULATION = 6
#: Share of the capacity from which on a bin counts as well filled.
FULL = 0.995
SEED = 11
#: Chunks whose ids one worker keeps; the table is emptied when it is full.
KEPT_CHUNKS = 250_000
#: Bytes of text whose new chunks are encoded in one call.
TOGETHER = 1 << 20
#: Rows numbered by one task.
NUMBERED = 100_000


@functools.cache
def _encoder(path: str):
    """The vocabulary of a byte-level BPE tokenizer file: ids by chunk, and the file's own special strings."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), special


@functools.cache
def _hf(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_NONE = np.zeros(0, dtype="<u4")


class _Tokens:
    """Ids of whole texts, many at once. A text is cut before each space that stands between two characters
    that aren't white space; the pre-tokeniser cuts there too, so each part has ids of its own. Only the
    distinct parts that aren't known yet are encoded, all in one call."""

    def __init__(self, path: str):
        self.path = path
        self.encoder, self.special = _encoder(path)
        self.width = np.zeros(self.encoder.n_vocab, dtype=np.int64)
        for token, i in self.encoder._mergeable_ranks.items():
            self.width[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.key, self.at, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), _NONE

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode_ordinary(text), dtype="<u4")

    def learn(self, key: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> None:
        n = end - start
        easy = (data[start] == 32) & (n > 1) & ~X.WHITE[data[np.minimum(start + 1, len(data) - 1)]] & ~X.WHITE[data[end - 1]]
        i = np.flatnonzero(easy)
        ids, size = [], np.zeros(len(key), np.int64)
        if len(i):
            ends = np.cumsum(n[i])
            joined = data[np.arange(ends[-1]) + np.repeat(start[i] - ends + n[i], n[i])]
            some = self.plain(joined.tobytes().decode())
            cuts = np.searchsorted(np.cumsum(self.width[some]), ends) + 1
            size[i] = np.diff(cuts, prepend=0)
            ids.append(some)
        j = np.flatnonzero(~easy)
        for k in j:
            ids.append(self.plain(data[start[k] : end[k]].tobytes().decode()))
            size[k] = len(ids[-1])
        order = np.concatenate([i, j])
        at = np.cumsum(size[order]) - size[order] + len(self.pool)
        self.pool = np.concatenate([self.pool, *ids])
        key, at, size = (np.concatenate(x) for x in ((self.key, key[order]), (self.at, at), (self.size, size[order])))
        order = np.argsort(key)
        self.key, self.at, self.size = key[order], at[order], size[order]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and each document's offsets in them."""
        n = len(data)
        if not n:
            return _NONE, np.zeros(len(offs), np.int64)
        white = X.WHITE[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[1 : n - 1] = (data[1:-1] == 32) & ~white[:-2] & ~white[2:]
        cut[offs[1:] - 1] = False  # a text's last character
        cut[offs] = True
        start = np.flatnonzero(cut[:n])
        end = np.append(start[1:], n)
        words = X.Words.__new__(X.Words)
        words.data = data
        h = words.span_hash(words.prefix(), start, end)
        key, first, which = np.unique(h, return_index=True, return_inverse=True)
        for again in (False, True):
            at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
            new = np.flatnonzero(self.key[at] != key) if len(self.key) else np.arange(len(key))
            if not len(new):
                break
            if len(self.key) + len(new) > KEPT_CHUNKS:
                self.forget()
                new = np.arange(len(key))
            self.learn(key[new], start[first[new]], end[first[new]], data)
        size = self.size[at][which]
        ends = np.cumsum(size)
        flat = self.pool[np.arange(ends[-1]) + np.repeat(self.at[at][which] - ends + size, size)]
        return flat, np.append(0, ends)[np.searchsorted(start, offs)]

    def texts(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Ids of each text. Texts with white space beyond ASCII's six or with a special string go through their encoders whole."""
        n = len(offs) - 1
        whole = np.zeros(n, dtype=bool)
        odd = np.flatnonzero(_ODD[data])
        if len(odd):
            pair = data[np.minimum(odd + 1, len(data) - 1)]
            odd = odd[(data[odd] < 32) | (_ODD_PAIRS[data[odd], pair])]
            whole[np.searchsorted(offs, odd, side="right") - 1] = True
        flat, at = self.encode(data, offs)
        out = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        raw = data.tobytes()
        rare = any(s.encode() in raw for s in self.special)
        for d in range(n) if rare else np.flatnonzero(whole):
            text = raw[offs[d] : offs[d + 1]].decode()
            if any(s in text for s in self.special):
                out[d] = np.array(_hf(self.path).encode(text, add_special_tokens=False).ids, dtype="<u4")
            elif whole[d]:
                out[d] = self.plain(text)
        return out


_ODD = np.zeros(256, dtype=bool)
_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ODD_PAIRS = np.zeros((256, 256), dtype=bool)
for _a, _b in ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)):
    _ODD_PAIRS[_a, _b] = True


@functools.cache
def _tokens(path: str) -> _Tokens:
    return _Tokens(path)


def _pieces(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one document's ids."""
    n = len(ids)
    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
    return [(i, a, b - a, zlib.crc32(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


PIECE = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
_PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, text: str = "text", out: str = "pieces", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Adds the array column `out` with every piece of a document; null text is empty, so its only id is `end`."""
    tail = np.array([end], dtype="<u4")

    def cut(column: pa.Array) -> pa.Array:
        offsets, rows = [0], []
        for _, _, data, offs in X.chunks(column, TOGETHER):
            for ids in _tokens(path).texts(data, offs):
                rows += _pieces(np.concatenate([ids, tail]), capacity)
                offsets.append(len(rows))
        flat = [pa.array([r[k] for r in rows], _PIECE.field(k).type) for k in range(4)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, names=[f.name for f in _PIECE]))

    def done() -> None:
        _tokens(path).forget()
        trim()

    return docs.withColumn(out, text_udf(docs.sparkSession, PIECE, cut, done)(F.col(text)))


# The grouping genetic algorithm over a histogram. A bin is a descending tuple of lengths.


def best_fit(groups: Counter, loose: Counter, capacity: int, order: list[int] | None = None) -> Counter:
    """Adds the loose pieces to the bins, each to the fullest bin that takes it, whole runs of equal bins at a time."""
    room: list[dict[tuple, int]] = [{} for _ in range(capacity + 1)]
    for g, m in groups.items():
        if m:
            room[capacity - sum(g)][g] = m
    free = [r for r in range(1, capacity + 1) if room[r]]
    for length in order or sorted(loose, reverse=True):
        left = loose[length]
        while left:
            at = next((r for r in free if r >= length and room[r]), 0)
            if not at:
                each = min(capacity // length, left)
                g, m = (length,) * each, left // each
            else:
                old, have = next(iter(room[at].items()))
                each = min(at // length, left)
                m = min(have, left // each)
                if m == have:
                    del room[at][old]
                else:
                    room[at][old] = have - m
                g = tuple(sorted(old + (length,) * each, reverse=True))
            r = capacity - sum(g)
            room[r][g] = room[r].get(g, 0) + m
            left -= each * m
            if r and r not in free:
                free.append(r)
                free.sort()
    return Counter({g: m for bins in room for g, m in bins.items()})


def filled(loose: Counter, capacity: int, rng: random.Random | None = None) -> Counter:
    """Bins built one after the other: the longest piece left, then the pieces whose lengths add up nearest to the
    room beside it, found over the bits of one number; each bin as many times as its pieces allow. With `rng` the
    lengths are tried in another order, so that other sets of pieces with such a sum are found."""
    left, groups = +loose, Counter()
    lengths = sorted(left, reverse=True)
    while left:
        while not left[lengths[0]]:
            del left[lengths[0]], lengths[0]
            if not lengths:
                return groups
        top = lengths[0]
        room = capacity - top
        mask = (2 << room) - 1
        some = [n for n in lengths if n <= room and left[n] > (n == top)]
        if rng:
            some.sort(key=lambda n: -n * rng.uniform(0.7, 1.0))
        reach = [1]
        for n in some:
            bits = reach[-1]
            for _ in range(min(left[n] - (n == top), room // n)):
                more = (bits | bits << n) & mask
                if more == bits:
                    break
                bits = more
            reach.append(bits)
            if bits >> room & 1:
                break
        at, own = reach[-1].bit_length() - 1, [top]
        for n, before in zip(reversed(some[: len(reach) - 1]), reversed(reach[:-1])):
            while not before >> at & 1:
                own.append(n)
                at -= n
        times = min(left[n] // k for n, k in Counter(own).items())
        groups[tuple(sorted(own, reverse=True))] += times
        for n in own:
            left[n] -= times
    return groups


def n_bins(groups: Counter) -> int:
    return sum(groups.values())


def fitness(groups: Counter, capacity: int) -> float:
    """Mean squared fill: prefers few full bins to many half-full ones."""
    return sum(m * (sum(g) / capacity) ** 2 for g, m in groups.items()) / max(1, n_bins(groups))


def crossover(into: Counter, donor: Counter, capacity: int, demand: Counter, rng: random.Random) -> Counter:
    """Injects a random share of the donor's well-filled bins whole; bins of `into` that then hold surplus
    pieces go, and what they also held is displaced and best-fitted."""
    injected: Counter = Counter()
    for g, m in donor.items():
        if sum(g) >= FULL * capacity and rng.random() < 0.5:
            injected[g] = m
    need = Counter(demand)
    for g, m in injected.items():
        for length in g:
            need[length] -= m
    child = Counter(injected)
    kept = sorted(into.items(), key=lambda x: (-sum(x[0]), rng.random()))
    for g, m in kept:
        own = Counter(g)
        fits = min([m, *(need[length] // k for length, k in own.items())])
        if fits > 0:
            child[g] += fits
            for length, k in own.items():
                need[length] -= k * fits
    return best_fit(child, +need, capacity)


def mutate(groups: Counter, capacity: int, rng: random.Random) -> Counter:
    """Dissolves the emptiest bins and a share of the others, builds full bins of their pieces and best-fits the rest."""
    child = Counter(groups)
    loose: Counter = Counter()
    worst = sorted(child, key=lambda g: (sum(g), rng.random()))
    share = rng.choice((0.02, 0.1, 0.3))
    for g in worst[: max(1, len(worst) // 20)] + [g for g in worst if rng.random() < share]:
        m = child.pop(g, 0)
        if m > 1 and sum(g) == capacity:  # a part of a full bin's copies may stay
            child[g] = rng.randrange(m)
            m -= child[g]
        for length in g:
            loose[length] += m
    for g, m in filled(loose, capacity, rng).items():
        if sum(g) >= FULL * capacity:
            child[g] += m
            for length in g:
                loose[length] -= m
    return best_fit(child, +loose, capacity)


def evolve(population: list[Counter], demand: Counter, capacity: int, generations: int, rng: random.Random, size: int) -> list[Counter]:
    """The population after some generations, the fewest bins first; the first chromosome is plain best-fit's."""
    lower = -(-sum(k * m for k, m in demand.items()) // capacity)
    rank = lambda g: (n_bins(g), -fitness(g, capacity))
    population.append(best_fit(Counter(), demand, capacity))
    while len(population) < size and n_bins(min(population, key=rank)) > lower:
        population.append(filled(demand, capacity, rng))
    population.sort(key=rank)
    for _ in range(generations):
        if n_bins(population[0]) <= lower:
            break
        a, b = rng.randrange(len(population)), rng.randrange(len(population))
        child = crossover(population[min(a, b)], population[max(a, b)], capacity, demand, rng)
        population += [mutate(child, capacity, rng), mutate(population[0], capacity, rng), child]
        population.sort(key=rank)
        del population[size:]
    return population


def _dump(groups: Counter) -> str:
    return json.dumps([[list(g), m] for g, m in sorted(groups.items())])


def _load(text: str) -> Counter:
    return Counter({tuple(g): m for g, m in json.loads(text)})


def pack_histogram(spark, demand: Counter, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, seed: int = SEED) -> Counter:
    """Bins with multiplicities that hold exactly the demanded pieces. What travels is bounded by the capacity,
    not by the corpus: one histogram out, one elite back per island and epoch."""
    need = json.dumps(sorted(demand.items()))
    elites: list[str | None] = [None] * islands
    lower, fewest, idle = -(-sum(k * m for k, m in demand.items()) // capacity), None, 0
    for epoch in range(epochs):
        rows = [(i, [e for e in {elites[i], elites[i - 1]} if e]) for i in range(islands)]  # the ring

        def island(batches, epoch=epoch):
            for batch in batches:
                for i, seeds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rng = random.Random(f"{seed}/{epoch}/{i}")
                    best = evolve([_load(s) for s in sorted(seeds)], Counter(dict(json.loads(need))), capacity, generations, rng, population)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([_dump(best)])], names=["island", "elite"])

        df = spark.createDataFrame(rows, "island long, seeds array<string>").repartition(islands, "island")
        elites = [r.elite for r in sorted(df.mapInArrow(island, "island long, elite string").collect())]
        best = min(elites, key=lambda e: (n_bins(_load(e)), -fitness(_load(e), capacity)))
        now = n_bins(_load(best))
        idle = idle + 1 if fewest is not None and now >= fewest else 0
        fewest = now if fewest is None else min(now, fewest)
        if fewest <= lower or idle >= PATIENCE:
            break
    return _load(best)


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece with the id `end`; very long texts are cut into as many pieces as they
    need. Rows that repeat a doc_id are packed each on its own, alike pieces taking the places of their length in
    any order. Other columns are not looked at, whatever their names. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    cut = pieces(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path, "text", "pieces", capacity, end)
    flat = materialise(cut.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*"))
    per = flat.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    demand = Counter({int(r.length): int(r.n) for r in per})
    total = sum(demand.values())
    bins = pack_histogram(spark, Counter({k: m for k, m in demand.items() if k < capacity}), capacity, **options) if total else Counter()
    if demand.get(capacity):
        bins[(capacity,)] += demand[capacity]

    # runs: the pieces number `first` .. of a length stand at `offset` of consecutive sequences
    used: Counter = Counter()
    runs, sequence = [], 0
    for g, m in sorted(bins.items(), reverse=True):
        offset = 0
        for length in g:
            runs.append((length, used[length], m, sequence, offset))
            used[length] += m
            offset += length
        sequence += m
    table: dict[int, list] = {}
    for length, *run in runs:
        table.setdefault(length, []).append(run)
    # bounded by the lengths and the distinct bins, about 40 bytes a run
    packed = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in table.items()})

    buckets = max(1, -(-total // NUMBERED))
    spread = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    marked = flat.withColumn("bucket", spread)
    counts = marked.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = marked.withColumn("number", F.row_number().over(order) - 1)
    # both sides lie by length and bucket; the numbers are plain columns before rows go to Python
    numbered = numbered.join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number"))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        ln, no = length.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False)
        seq, off = np.zeros(len(ln), np.int64), np.zeros(len(ln), np.int64)
        for k in np.unique(ln):
            i = np.flatnonzero(ln == k)
            run = packed.value[int(k)]
            j = np.searchsorted(run[:, 0], no[i], side="right") - 1
            seq[i] = run[j, 2] + no[i] - run[j, 0]
            off[i] = run[j, 3]
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(off)], names=["sequence_id", "offset"])

    placed = numbered.withColumn("_at", place("length", "number"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
