"""Predicates and projections over documents, mentions and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlake.functions import text as X
from mentionlake.sources import workspace


def processable(kind="entity_type", text="text", vague: str = "cell_vague") -> Column:
    """Not of the vague type and not blank; a missing type passes."""
    return ~F.col(kind).eqNullSafe(F.lit(vague)) & (F.trim(F.coalesce(text, F.lit(""))) != "")


def type_allowed(kind="entity_type", include: Sequence[str] = (), exclude: Sequence[str] = (), default: str = "cell_type") -> Column:
    k = F.lower(F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit(default)))
    out = ~k.isin([x.lower() for x in exclude]) if exclude else F.lit(True)
    return out & k.isin([x.lower() for x in include]) if include else out


def to_absolute(spans: DataFrame, offset: str = "passage_offset") -> DataFrame:
    return spans.withColumns({"start": F.col("start") + F.col(offset), "end": F.col("end") + F.col(offset)})


def compact(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """JSON of a row without null, empty maps and empty arrays."""
    kinds = dict(df.dtypes)
    parts = [F.when(F.size(c) > 0, F.col(c)).alias(c) if kinds[c].startswith(("map", "array")) else F.col(c) for c in columns or df.columns]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "true"})


def coerce_mentions(df: DataFrame, document_id: str | None = None) -> DataFrame:
    """Mention rows from any of the accepted columns: the first of text, mention and mention_text that isn't empty; a row
    that has none of them is an error. A missing end is start plus length; a missing type stays missing."""
    low = {c.lower(): c for c in df.columns}
    pick = lambda kind, *names: F.coalesce(*[F.col(low[n]).cast("string").try_cast(kind) for n in names if n in low], F.lit(None).cast(kind))
    words = [F.col(low[n]).cast("string") for n in ("text", "mention", "mention_text") if n in low]
    some = F.coalesce(*[F.nullif(w, F.lit("")) for w in words], *words, F.lit(None).cast("string"))
    mention = F.when(some.isNull(), F.raise_error(F.lit("a mention needs text, mention or mention_text")).cast("string")).otherwise(some)
    start = pick("int", "start", "offset")
    return df.select(
        mention.alias("mention"), F.coalesce(F.nullif(pick("string", "document_id", "doc_id", "document_key"), F.lit("")), F.lit(document_id).cast("string")).alias("document_id"),
        start.alias("start"), F.coalesce(pick("int", "end"), start + pick("int", "length")).alias("end"), pick("string", "entity_type", "type", "label").alias("entity_type"), pick("double", "score").alias("score"),
    )


def without_metadata(df: DataFrame, keep: Sequence[str] = ("input_ids", "attention_mask", "token_type_ids", "labels")) -> DataFrame:
    """What a model is given of tokenised rows: offsets, ids and texts stay behind."""
    return df.select([c for c in keep if c in df.columns])


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in the given order; partial per task, no sort of a whole group."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(*keys, "_f.*")


def numbered(df: DataFrame, order: Sequence[str], name: str = "example_idx") -> DataFrame:
    """Running number from 0 in the given order, by ranges: counts per range first, then numbers inside.

    The sorted ranges are written once: their borders are sampled and small ranges are merged at each run, so two runs
    need not agree on what range a row lies in. A row's place in its task is its place in its range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = workspace.table(ranged).withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND((1 << 33) - 1)})
    starts = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_s", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    return ranged.join(F.broadcast(starts.select("_p", "_s")), "_p").withColumn(name, F.col("_s") + F.col("_i")).drop("_p", "_i", "_s", "_m")


def subset(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows of an order: the limit that the caller asked for."""
    return df.orderBy(*order).limit(n)


def scores_over(df: DataFrame, threshold: float, score: str = "score_text") -> DataFrame:
    s = X.safe_double(score)
    return df.filter(s.isNotNull() & (s >= threshold))
