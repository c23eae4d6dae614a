"""Sharding by histogram sort.

Rows are ordered by (64-bit hash of the text, doc_id). Splitters are found by counting: each round
counts the exact bytes between candidate keys over all partitions and keeps, for every splitter, the
interval that holds its target, until the counts around it meet the tolerance or the interval holds
no more than one row or one key. Only then are the rows exchanged, once, by ranges.

Equal texts share a hash, so a group of copies stays in one shard as long as the tolerance allows; a
group too large for that (it may hold a third of all bytes) is split by a second search over its
doc_ids. Rows equal in both are alike and are split by their number only if one key alone exceeds
the tolerance.

Slots come from counts too: shards are cut into ranges of bounded size, a range starts at the rows
counted before it, and rows are numbered inside their range, so that no task holds a shard. Only rows
alike in text and doc_id and beyond the tolerance are numbered together.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionlake.llm._spark import fresh, materialise, with_small

SHARDS = 8
#: Largest distance of a splitter from its target, as a share of an even shard's bytes.
TOLERANCE = 0.005
PROBES = 256
#: Rows numbered by one task.
RANGE_ROWS = 20_000

_LOW, _HIGH = -(2**63), 2**63 - 1


def _below(table: DataFrame, column: str, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and number of the rows with column < probe, for each of the sorted probes. What returns is bounded by the probes."""
    n = len(probes) + 1

    def count(batches):
        total, rows = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(total, at, batch.column(1).to_numpy(zero_copy_only=False))
            rows += np.bincount(at, minlength=n)
        i = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(total[i]), pa.array(rows[i])], names=["at", "bytes", "n"])

    found = table.select(column, "size").mapInArrow(count, "at long, bytes long, n long").groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    size, rows = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for r in found:
        size[r["at"]], rows[r["at"]] = r["bytes"], r["n"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def _splitters(table: DataFrame, column: str, goals: list[float], slack: float, probes: int) -> list[tuple[int, int, int, int, int]]:
    """For each goal (bytes below) the interval (key, next key, bytes below key, bytes below next key, rows inside) around
    it: one of its ends meets the slack, or it is a single key, or it holds a single row, which can't be cut."""
    span = [[_LOW, _HIGH, 0, None, None] for _ in goals]
    done = lambda s, g: s[3] is not None and (min(g - s[2], s[3] - g) <= slack or s[1] - s[0] <= 1 or s[4] <= 1)
    while True:
        # distinct open intervals share the probes
        open_ = sorted({(s[0], s[1]) for s, g in zip(span, goals) if not done(s, g)})
        if not open_:
            return [tuple(s) for s in span]
        keys = sorted({lo + (hi - lo) * k // probes for lo, hi in open_ for k in range(probes + 1)} | {hi for _, hi in open_})
        sums, rows = _below(table, column, np.array(keys, dtype=np.int64))
        for s, g in zip(span, goals):
            if done(s, g):
                continue
            i = max(0, int(np.searchsorted(sums, g, side="right")) - 1)
            while i + 1 < len(keys) and keys[i + 1] <= s[0]:
                i += 1
            j = min(i + 1, len(keys) - 1)
            s[:] = [keys[i], keys[j], int(sums[i]), int(sums[j]), int(rows[j] - rows[i])]
            if i == j:
                s[:] = [keys[i], keys[i] + 1, int(sums[i]), int(sums[i]), 0]


def text_key(text: str) -> F.Column:
    """Key of a text; null and empty texts differ from each other. The largest long is left free as an upper bound."""
    return F.least(F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text)), F.lit(_HIGH - 1).cast("long"))


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE, probes: int = PROBES) -> DataFrame:
    """Adds size (UTF-8 bytes of the text plus 1), shard and slot to every row; columns of these names are replaced,
    all others pass through, whatever their names.

    Law `bytes`: every shard's bytes are within about the tolerance of an even share, as far as single
    rows allow. Null text has size 1. A null doc_id sorts first. Tables of fewer rows than shards
    leave some shards empty; an empty table gives an empty table.
    """
    docs = docs.select([c for c in docs.columns if c.lower() not in {"size", "shard", "slot"}])
    key, sub, nth, band, fine, inside = fresh(docs, "key", "sub", "nth", "band", "fine", "inside")
    work = docs.withColumns({"size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1, key: text_key(text), sub: F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOW).cast("long"))})
    table = materialise(work.select(key, sub, "size"))
    total, rows = table.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    slack = tolerance * total / shards
    goals = [total * k / shards for k in range(1, shards)]
    cuts: list[tuple[int, int, int]] = []  # the first key, sub-key and number of the shard behind the cut
    found = _splitters(table, key, goals, slack, probes) if rows else []
    for (lo, hi, below, above, held), goal in zip(found, goals):
        if min(goal - below, above - goal) <= slack or held <= 1:
            cuts.append((lo, _LOW, 0) if goal - below <= above - goal else (hi, _LOW, 0))
            continue
        own = table.filter(F.col(key) == lo)  # one group of copies, larger than the tolerance
        (a, b, under, over, held), rest = _splitters(own, sub, [goal - below], slack, probes)[0], goal - below
        if min(rest - under, over - rest) <= slack or held <= 1:
            cuts.append((lo, a, 0) if rest - under <= over - rest else (lo, b, 0))
        else:
            size = own.filter(F.col(sub) == a).agg(F.max("size")).first()[0]
            cuts.append((lo, a, round((rest - under) / size)))
    tied = {(k, s) for k, s, n in cuts if n}
    bits = max(1, (-(-(rows or 0) // RANGE_ROWS) - 1).bit_length() + 1)

    def place(df: DataFrame) -> DataFrame:
        """Adds the number of rows alike in key and doc_id where they are more than the tolerance allows, shard and range of keys."""
        if tied:
            alike = reduce(lambda x, y: x | y, [(F.col(key) == k) & (F.col(sub) == s) for k, s in tied])
            number = F.row_number().over(Window.partitionBy(key, sub).orderBy(F.lit(1))) - 1
            df = df.filter(alike).withColumn(nth, number).union(df.filter(~alike).withColumn(nth, F.lit(0)))
        else:
            df = df.withColumn(nth, F.lit(0))
        here, at = F.struct(key, sub, nth), F.lit(0)
        for k, s, n in sorted(cuts):
            at = at + (here >= F.struct(F.lit(k).cast("long").alias(key), F.lit(s).cast("long").alias(sub), F.lit(n).alias(nth))).cast("int")
        return df.withColumn("shard", at).withColumn(band, F.shiftright(key, 64 - bits))

    # ranges of keys of about RANGE_ROWS rows; only a range that a hot text fills is cut further, by doc_id's hash
    more, share, first = fresh(docs, "bits", "share", "first")
    counted = place(table)
    part = F.count("*") / F.lit(float(RANGE_ROWS))
    hot = materialise(counted.groupBy("shard", band).agg(part.alias(share)).filter(F.col(share) > 4).select("shard", band, F.ceil(F.log2(share)).cast("int").alias(more)))
    finer = F.when(F.col(more) > 0, F.expr(f"shiftright(xxhash64(`{sub}`), 64 - `{more}`)")).otherwise(F.lit(0).cast("long"))
    cell = ["shard", band, fine]
    marks = with_small(counted, hot, ["shard", band], "left", salt=sub).withColumn(fine, finer).groupBy(*cell).agg(F.count("*").alias(share))
    # a row in RANGE_ROWS / 2 at most
    starts = materialise(marks.withColumn(first, F.sum(share).over(Window.partitionBy("shard").orderBy(band, fine)) - F.col(share)).drop(share))
    placed = with_small(place(work), hot, ["shard", band], "left", salt=sub).withColumn(fine, finer)
    number = F.row_number().over(Window.partitionBy(*cell).orderBy(key, sub, nth)) - 1
    # rows lie by cell after the numbering, so the join moves only the counts
    return placed.withColumn(inside, number).join(starts, cell).select(*docs.columns, "size", "shard", (F.col(first) + F.col(inside)).cast("long").alias("slot"))
