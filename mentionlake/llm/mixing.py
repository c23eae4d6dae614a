"""Mixing sources to target weights by capped water-filling.

Every source starts with its weight's share of all words. Sources whose target exceeds `max_epochs`
times their size are clamped there and the excess is dealt to the others by weight, again and again
until no target is above its cap. Each round is one aggregate over the table of sources; sources are
never collected.

A source is then taken in whole repetitions plus one fractional one: documents in a seeded order
(MD5 of seed and doc_id) are taken whole until the target is met, and the document that crosses it
is taken in part, so that a source's words meet its target up to one word. The running
sums are two-level (buckets of the seeded order, then documents of a bucket), and buckets grow in number with the table,
so a source that holds a third of all rows is spread over many tasks of bounded size.

A mixture can be had with that document cut (`mixed`, to the word) or in whole documents
(`mixed_whole`, as near the target as the documents around it allow; what the pipeline uses).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionlake.llm._spark import fresh, materialise, row_key, with_small

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Documents in a bucket of a source's order, on average, and the fewest and most buckets of a source.
BUCKET_ROWS, FEWEST, MOST = 50_000, 16, 1 << 20
SEED = "mix-1"
#: Documents on either side of the point where a source meets its target among which `mixed_whole` chooses.
NEAR = 16
#: Largest number of bits for the sums of their sizes.
SUM_BITS = 1 << 22


def n_words(text) -> F.Column:
    """Words of a text; null has none."""
    t = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(t, " "), lambda x: x != "")).cast("long")


def _ranked(sources: DataFrame, weights) -> DataFrame:
    """Weights in code point order, null last. The table of sources is sorted into ranges, which are numbered inside
    and then moved on by the rows of the ranges before: no task holds all sources."""
    part = F.spark_partition_id()
    ordered = materialise(sources.select("source").orderBy(F.col("source").asc_nulls_last()).withColumn("part", part))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    start = ordered.groupBy("part").agg(F.count("*").alias("n"))
    start = start.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # a row a range
    rank = F.col("start") + F.col("inside")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int"))
    return ordered.withColumn("inside", inside).join(start, "part").select(F.col("source").alias("_s"), w.cast("long").alias("weight"))


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size): weight and target. A source without words gets target zero. Each round clamps a
    source at least or is the last, so the rounds end; in practice they are few, whatever the number of sources."""
    named = _ranked(sizes, weights)
    table = materialise(sizes.join(named, sizes.source.eqNullSafe(named._s)).select("source", "source_size", "weight", (F.col("source_size") * max_epochs).alias("cap")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        # clamped at this level: a source stays clamped, since the level only rises
        clamped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("cap")
        row = table.agg(F.sum(F.when(clamped, F.col("cap")).otherwise(0)).alias("c"), F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("w")).first()
        if not row.w:
            break
        new = (total - row.c) / row.w
        if level is not None and new <= level:
            break
        level = new
    return table.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level or 0.0))).alias("target"))


def _runs(docs: DataFrame, doc_id: str, text: str, source: str, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, buckets: int | None = None, key: list | None = None) -> DataFrame:
    """A row per document: the words before it in its source's seeded order (`start`), the source's whole
    repetitions and the words of its fractional one (`rest`); `key` names columns whose digest is carried along."""
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    sized = materialise(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), order.alias("ord"), *([row_key(*key).alias("_row_key")] if key else []))
    )
    if buckets is None:
        buckets = min(MOST, max(FEWEST, -(-sized.count() // BUCKET_ROWS)))
    sized = sized.withColumn("bucket", F.floor(F.conv(F.substring("ord", 1, 6), 16, 10).cast("long") * buckets / 16**6).cast("int"))
    bucketed = materialise(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    # at most `buckets` short rows a source
    before = bucketed.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words"))
    goal = targets(bucketed.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    facts = before.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select(
        F.hash("b.source", F.col("b.source").isNull()).alias("_h"), F.col("b.source").alias("_source"), F.col("b.bucket").alias("bucket"), "before", "source_size", "target"
    )
    within = Window.partitionBy("source", "bucket").orderBy("ord", "size", *["_row_key"] * bool(key)).rowsBetween(Window.unboundedPreceding, -1)
    run = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("_h", F.hash("source", F.col("source").isNull()))
    joined = with_small(run, facts, ["_h", "bucket"], salt="ord").filter(F.col("source").eqNullSafe(F.col("_source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - whole * F.col("source_size") + 0.5).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", "ord", *["_row_key"] * bool(key), (F.col("before") + F.col("inside")).alias("start"), whole.alias("whole"), rest.alias("rest"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and the seeded key `ord`.

    Null text has size 0 and is never taken; a null source is a source of its own, last in order. Rows
    that repeat a doc_id are ordered by size among themselves, and equal rows are interchangeable.
    """
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    runs = _runs(docs, doc_id, text, source, weights, max_epochs, seed, buckets)
    return runs.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), "ord")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixture itself: the input's columns, a row per repetition; a fractional one carries the document's first words.

    An empty table gives an empty table; the input's own columns pass through, whatever their names."""
    i, size, taken, rows, n, part = fresh(docs, "id", "size", "taken", "rows", "n", "part")
    plan = mix(docs, doc_id, text, source, **options).filter("taken > 0").select(F.col("doc_id").alias(i), F.col("size").alias(size), F.col("taken").alias(taken))
    # rows that repeat a doc_id take the id's words together
    plan = plan.groupBy(i).agg(F.sum(size).alias(size), F.sum(taken).alias(taken), F.count("*").alias(rows))
    found = docs.join(plan, F.col(doc_id).eqNullSafe(F.col(i))).withColumn(n, n_words(F.col(text)))
    copies = F.floor(F.col(taken) / F.col(size)).cast("int")
    rest = F.ceil((F.col(taken) - copies * F.col(size)) * F.col(n) / F.col(size)).cast("int")
    found = found.withColumn(part, F.explode(F.concat(F.array_repeat(F.lit(-1), copies), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))))
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    cut = F.when(F.col(part) < 0, F.col(text)).otherwise(F.array_join(F.slice(words, 1, F.greatest(F.col(part), F.lit(1))), " "))
    return found.withColumn(text, cut).select(docs.columns)


def nearest_subset(sizes: list[int], goal: int) -> list[bool]:
    """Which of `sizes` to take for a sum as near `goal` as any (the lesser of two), early ones first. Sums are bits
    of one number; past ``SUM_BITS`` they are counted in coarser units."""
    if goal <= 0:
        return [False] * len(sizes)
    unit = -(-2 * goal // SUM_BITS)
    sizes, goal = [round(s / unit) for s in sizes], round(goal / unit)
    mask, reach = (1 << 2 * goal + 1) - 1, [1]  # beyond twice the goal, taking none is nearer
    for s in sizes:
        reach.append((reach[-1] | reach[-1] << s) & mask if s <= 2 * goal else reach[-1])
    below = (reach[-1] & ((1 << goal + 1) - 1)).bit_length() - 1
    above = reach[-1] >> goal
    above = goal + (above & -above).bit_length() - 1 if above else None
    at = below if above is None or goal - below <= above - goal else above
    taken = []
    for s, without in zip(reversed(sizes), reversed(reach[:-1])):
        taken.append(not without >> at & 1)
        at -= s * taken[-1]
    return taken[::-1]


def mixed_whole(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixture in whole documents: the input's rows, unchanged, a row per repetition.

    The fractional repetition takes documents in the seeded order; of the `NEAR` documents before and after
    the point where the target is met, those are taken whose words bring the source nearest to it. Rows are
    told apart by doc_id, source and text; rows alike in these share their repetitions evenly. Null and empty
    texts have no words and are left out; an empty table gives an empty table; the input's own columns pass
    through, whatever their names."""
    runs = materialise(_runs(docs, doc_id, text, source, key=[doc_id, source, text], **options).filter("size > 0").select("_row_key", "source", "size", "start", "whole", "rest"))
    inside = F.col("start") + F.col("size") <= F.col("rest")
    last = Window.partitionBy("source").orderBy(F.col("start").desc())
    first = Window.partitionBy("source").orderBy("start")
    near = runs.filter(inside).withColumn("_nth", F.row_number().over(last)).filter(F.col("_nth") <= NEAR)
    near = near.union(runs.filter(~inside).withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= NEAR))
    # at most 2 * NEAR short rows a source
    per = near.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("start", "size", "_row_key", inside.alias("inside")))).alias("c"), F.first("rest").alias("rest"))
    per = per.withColumn("goal", F.col("rest") - F.col("c")[0]["start"])

    @F.udf("array<int>")
    def pick(sizes, goal):
        return [int(x) for x in nearest_subset(sizes, goal)]

    picked = per.withColumn("taken", pick(F.col("c.size"), "goal"))
    moved = picked.select(F.explode(F.arrays_zip("c", "taken")).alias("x")).select("x.c._row_key", (F.col("x.taken") - F.col("x.c.inside").cast("int")).alias("n"), F.lit(0).alias("rows"))
    plan = runs.select("_row_key", (F.col("whole") + inside.cast("int")).alias("n"), F.lit(1).alias("rows")).union(moved.filter("n <> 0"))
    plan = plan.groupBy("_row_key").agg(F.sum("n").alias("_copies"), F.sum("rows").alias("_rows")).filter("_copies > 0")
    key, count, share_of, number, share, copy = fresh(docs, "row_key", "copies", "rows", "nth", "share", "copy")
    plan = plan.select(F.col("_row_key").alias(key), F.col("_copies").alias(count), F.col("_rows").alias(share_of))
    rows = docs.withColumn(key, row_key(doc_id, source, text)).join(plan, key)
    rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    each = F.floor(F.col(count) / F.col(share_of)).cast("int") + (F.col(number) <= F.col(count) % F.col(share_of)).cast("int")
    rows = rows.withColumn(share, each).filter(F.col(share) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(share)))).select(docs.columns)
