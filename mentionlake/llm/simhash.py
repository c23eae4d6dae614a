"""SimHash near-duplicates by tiled exact comparison.

Fingerprints come from XXH64 of word shingles, computed for a whole batch at once; bit votes are
summed as bytes packed into 64-bit words. Equal fingerprints become one class, so groups of copies,
however large, are counted and never paired.

Classes are laid out in tiles by the population counts of the fingerprint's parts (four 16-bit parts;
more for very many fingerprints, so that the work stays near proportion). Two fingerprints within the radius differ by at most the radius in the sum of absolute
differences of these counts, so a tile is compared only with tiles inside that distance, about one
pair of tiles in a hundred; the rest is skipped unseen. Inside a pair of tiles every pair is compared
by exclusive-or and bit count. Each tile travels as packed bytes, 8 a fingerprint, and large tiles
are cut into blocks, so no task holds more than two blocks. The comparison is exact: no candidate is
lost or capped. A fingerprint has at most 2,080 others within 2 bits, which bounds the links.

Null, empty and word-less texts have fingerprint zero and are linked like any other. Rows that
repeat a doc_id each count as a document. Empty tables give empty tables.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mentionlake.llm import _text as X
from mentionlake.llm._spark import components, fresh, materialise, row_key, text_udf

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Parts of a fingerprint whose population counts make a tile's place, by the number of fingerprints: more parts
#: skip more pairs of tiles (about 99%, 99.8% and all but one in ten million) and send each tile to more others.
PARTS = ((4_000_000, 4), (1_000_000_000, 8), (2**63, 16))
#: Fingerprints in one block of a tile.
BLOCK = 4096

_LANES = X.U64(0x0101010101010101)


def _votes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of each document's hashes have each bit set: (documents, 64)."""
    n = len(bounds) - 1
    out = np.zeros((n, 64), dtype=np.int64)
    counts = np.diff(bounds)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    pieces = (counts[full] + 254) // 255  # at most 255 summands, so that no byte overflows
    doc = np.repeat(full, pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = bounds[doc] + 255 * nth
    first = np.searchsorted(doc, full)
    for k in range(8):
        sums = np.add.reduceat((h >> X.U64(k)) & _LANES, start)
        lanes = np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[full, k::8] = np.add.reduceat(lanes, first, axis=0)
    return out


def _fingerprints(data: np.ndarray, offs: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    words = X.Words(data, offs)
    n = len(offs) - 1
    out = np.zeros(n, dtype=np.uint64)
    if not len(words.start):
        return out
    flat, start, end = X.compact(words, lower=True)
    size = np.where(words.counts >= shingle, words.counts - shingle + 1, np.minimum(words.counts, 1))
    bounds = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(n), size)
    first = words.bounds[doc] + np.arange(len(doc)) - bounds[doc]
    last = np.minimum(first + shingle, words.bounds[doc + 1]) - 1
    votes = _votes(X.xxh64(flat, start[first], end[last], seed), bounds)
    bits = (2 * votes > size[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1).copy()


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Adds the fingerprint as a long (two's complement) in column `out`, which is replaced if it exists."""

    def fingerprint(column: pa.Array) -> pa.Array:
        parts = [_fingerprints(d, o, shingle, seed) for _, _, d, o in X.chunks(column)]
        return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))

    return docs.withColumn(out, text_udf(docs.sparkSession, "long", fingerprint)(F.col(text)))


def _near(parts: int, radius: int) -> list[list[int]]:
    """Offsets between cells that may hold a link, one of each opposite two."""
    span = range(-radius, radius + 1)
    some = [list(d) for d in itertools.product(span, repeat=parts) if sum(map(abs, d)) <= radius] if parts <= 4 else _sparse(parts, radius)
    return [d for d in some if d >= [0] * parts]


def _sparse(parts: int, radius: int) -> list[list[int]]:
    found = {tuple([0] * parts)}
    for _ in range(radius):
        found |= {tuple(x + s * (i == j) for j, x in enumerate(d)) for d in found for i in range(parts) for s in (-1, 1)}
    return [list(d) for d in found]


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def near_pairs(classes: DataFrame, fp: str = "fp", radius: int = RADIUS, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """All pairs (a, b) of the distinct fingerprints in `classes` at 1 to `radius` differing bits, each once."""
    if parts is None:
        n = classes.count()
        parts = next(p for most, p in PARTS if n <= most)
    width = 64 // parts
    mask = (1 << width) - 1
    base = width + 1 + 2 * radius  # room for a step to either side
    code = F.lit(0).cast("long")
    for k in range(parts):
        code = code * base + F.bit_count(F.shiftrightunsigned(F.col(fp), k * width).bitwiseAND(F.lit(mask).cast("long"))).cast("long") + radius
    cells = classes.select(F.col(fp).alias("fp"), code.alias("cell"))
    # at most (width + 1) ** parts rows: a proven bound
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
    cells = cells.join(F.broadcast(sizes) if parts <= 4 else sizes, "cell")
    tiles = (
        cells.groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("block"))
        .agg(F.collect_list("fp").alias("fps"))
        .select("cell", "block", "fps")
    )
    steps = [sum(x * base ** (parts - 1 - i) for i, x in enumerate(d)) for d in _near(parts, radius)]
    left = tiles.select(
        F.explode(F.array(*[F.lit(s).cast("long") for s in steps])).alias("step"), F.col("cell").alias("from"), F.col("block").alias("from_block"), F.col("fps").alias("ours")
    ).withColumn("cell", F.col("from") + F.col("step"))
    pairs = left.join(tiles, "cell").filter("step <> 0 or from_block <= block").select("ours", "fps", (F.col("step").eqNullSafe(F.lit(0)) & (F.col("from_block") == F.col("block"))).alias("same"))

    def compare(batches):
        for batch in batches:
            found_a, found_b = [], []
            for ours, theirs, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                x = ours.values.to_numpy(zero_copy_only=False).view(np.uint64)
                y = theirs.values.to_numpy(zero_copy_only=False).view(np.uint64)
                rows = max(1, (1 << 20) // max(1, len(y)))
                for at in range(0, len(x), rows):
                    close = np.bitwise_count(x[at : at + rows, None] ^ y[None, :]) <= radius
                    i, j = np.nonzero(close)
                    i += at
                    if same:  # each pair once; by value, since the two lists may differ in order
                        once = x[i] < y[j]
                        i, j = i[once], j[once]
                    found_a.append(x[i].view(np.int64))
                    found_b.append(y[j].view(np.int64))
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], schema=_PAIR)

    return pairs.mapInArrow(compare, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, fp (long), n_near (other documents linked directly) and component_id
    (smallest doc_id reachable). Rows with null doc_id are documents too, but lend no component their id."""
    marked = materialise(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp", shingle, seed).select("doc_id", "fp"))
    classes = materialise(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    pairs = materialise(near_pairs(classes, "fp", radius))
    both = pairs.union(pairs.select("b", "a"))
    linked = both.join(classes.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    label = components(pairs)
    # a component's name: its smallest doc_id, not its smallest fingerprint
    named = label.join(classes.select(F.col("fp").alias("node"), "least"), "node")
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(F.col("node").alias("fp"), "component_id")
    facts = classes.join(linked, "fp", "left").join(named, "fp", "left").select(
        "fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), F.coalesce("component_id", "least").alias("component_id")
    )
    return marked.join(facts, "fp").select("doc_id", "fp", "n_near", "component_id")


def hex16(fp) -> F.Column:
    """16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component: of those with the smallest doc_id (null last), one with the smallest digest of its text.

    Rows are told apart by doc_id and text, and components by fingerprint: rows that share a doc_id, or have
    none, and whose texts are not near each other are kept each; rows alike in both are one. Null, empty and
    word-less texts are near each other. An empty table gives an empty table; the input's own columns pass
    through, whatever their names."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    classes = materialise(fingerprints(keyed, "text", "fp").select("doc_id", "key", "fp").groupBy("fp").agg(first))
    label = components(materialise(near_pairs(classes, "fp", radius))).select(F.col("node").alias("fp"), "component")
    named = classes.join(label, "fp", "left").select(F.coalesce("component", "fp").alias("component"), "first")
    (name,) = fresh(docs, "row_key")
    keep = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.key").alias(name))
    return docs.withColumn(name, row_key(doc_id, text)).join(keep, name, "left_semi").dropDuplicates([name]).drop(name)
