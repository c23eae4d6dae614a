"""Token windows, score averaging and BIO decoding and encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(tokens: str | Column, length: int, stride: int) -> Column:
    """Overlapping windows over an array: each of `length`, `stride` elements shared with the one before."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    step = max(1, length - stride)

    def cut(t: Column) -> Column:
        n = F.size(t)
        last = F.greatest(F.lit(0), F.ceil((n - length) / F.lit(step)).cast("int"))
        return F.when(n <= 0, F.array(t)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(t, i * step + 1, F.lit(length))))

    # bound to a name: as an expression the array would be computed again for every window
    return F.get(F.transform(F.array(t), cut), F.lit(0))


def mean_scores(rows: DataFrame, keys: Sequence[str] = ("sample_id", "start", "end")) -> DataFrame:
    """Mean score of each label over all windows that hold a token. `rows`: keys, scores array."""
    each = rows.select(*keys, F.posexplode("scores").alias("label_id", "score"))
    return each.groupBy(*keys, "label_id").agg(F.avg("score").alias("score"))


def best_label(means: DataFrame, keys: Sequence[str] = ("sample_id", "start", "end")) -> DataFrame:
    """Label of the highest mean; the lowest index on a tie."""
    return means.groupBy(*keys).agg(F.max_by("label_id", F.struct("score", -F.col("label_id"))).alias("label_id"))


def decode(tokens: DataFrame, sample: Sequence[str] = ("sample_id",), order: str = "start", tag: str = "tag", start: str = "start", end: str = "end") -> DataFrame:
    """Entities from BIO tags as gaps and islands: a new one on B, on the first tag that isn't O and on a change of label;
    O closes; tokens without width are skipped; a tag without prefix acts as B. Columns: sample, label, start, end."""
    t = tokens.filter(F.col(end) > F.col(start)) if end != start else tokens
    prefix = F.when(F.col(tag).contains("-"), F.substring_index(tag, "-", 1)).otherwise("B")
    label = F.when(F.col(tag).contains("-"), F.expr(f"substring({tag}, instr({tag}, '-') + 1)")).otherwise(F.col(tag))
    t = t.withColumn("_p", prefix).withColumn("_l", F.when(F.col(tag) != "O", label))
    w = Window.partitionBy(*sample).orderBy(order)
    new = F.col("_l").isNotNull() & ((F.col("_p") == "B") | ~F.lag("_l").over(w).eqNullSafe(F.col("_l")))
    t = t.withColumn("_n", new.cast("int")).withColumn("_island", F.sum("_n").over(w)).filter("_l is not null")
    out = t.groupBy(*sample, "_island").agg(F.min_by("_l", order).alias("label"), F.min(start).alias(start), F.max_by(end, order).alias(end))
    return out.drop("_island")


#: Positions in a bucket of the join of tokens and entities.
OWNER_BUCKET = 256


def owners(tokens: DataFrame, entities: DataFrame, sample: Sequence[str] = ("sample_id",), alignment: str = "expand", overlap: str = "last") -> DataFrame:
    """Entity that owns each token: `tokens` sample, start, end; `entities` sample, ent_idx, start, end, label.

    expand: any overlap; skip: entities that cut a token go; strict: they raise. Of several the last wins, or (error) it raises."""
    if alignment not in ("expand", "skip", "strict") or overlap not in ("last", "error"):
        raise ValueError("alignment is expand, skip or strict; overlap is last or error")
    e = entities.select(*sample, "ent_idx", F.col("start").alias("e_start"), F.col("end").alias("e_end"), "label")
    # both sides are filed under the buckets of positions they touch; a pair counts where the later of the two starts
    wide = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / OWNER_BUCKET), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / OWNER_BUCKET)))
    hit = tokens.filter(F.col("end") > F.col("start")).withColumn("_b", wide("start", "end")).join(e.withColumn("_b", wide("e_start", "e_end")), [*sample, "_b"])
    hit = hit.filter("start < e_end and e_start < end").filter(F.col("_b") == F.floor(F.greatest("start", "e_start") / OWNER_BUCKET)).drop("_b")
    if alignment != "expand":
        cut = F.max((F.col("start") < F.col("e_start")) | (F.col("end") > F.col("e_end"))).over(Window.partitionBy(*sample, "ent_idx"))
        hit = hit.withColumn("_cut", cut)
        hit = hit.filter(~F.col("_cut")) if alignment == "skip" else hit.withColumn("label", F.when(F.col("_cut"), F.raise_error(F.lit("an entity does not align to tokens"))).otherwise(F.col("label")))
    own = hit.groupBy(*sample, "start", "end").agg(F.max("ent_idx").alias("ent_idx"), F.max_by("label", "ent_idx").alias("label"), F.count("*").alias("_many"))
    if overlap == "error":
        own = own.withColumn("label", F.when(F.col("_many") > 1, F.raise_error(F.lit("a token belongs to several entities"))).otherwise(F.col("label")))
    return own.drop("_many")


def encode(tokens: DataFrame, owned: DataFrame, sample: Sequence[str] = ("sample_id",)) -> DataFrame:
    """BIO tag of each token: I after a token of the same owner, else B; O without owner. A token without width parts."""
    t = tokens.join(owned, [*sample, "start", "end"], "left")
    w = Window.partitionBy(*sample).orderBy("start", "end")
    same = F.lag("ent_idx").over(w) == F.col("ent_idx")
    return t.withColumn("tag", F.when(F.col("ent_idx").isNull(), "O").otherwise(F.concat(F.when(same, F.lit("I-")).otherwise(F.lit("B-")), F.col("label"))))


def label_schema(labels: DataFrame, label: str = "label") -> DataFrame:
    """label_id, tag: O first, then B- and I- of each label in order."""
    kinds = labels.select(label).distinct()
    w = Window.orderBy(label)  # one row a label
    tags = kinds.withColumn("_n", F.row_number().over(w) - 1).select("_n", F.explode(F.array(F.struct(F.lit(1).alias("k"), F.concat(F.lit("B-"), label).alias("tag")), F.struct(F.lit(2).alias("k"), F.concat(F.lit("I-"), label).alias("tag")))).alias("t"))
    tags = tags.select((2 * F.col("_n") + F.col("t.k")).cast("int").alias("label_id"), F.col("t.tag").alias("tag"))
    return labels.sparkSession.createDataFrame([(0, "O")], "label_id int, tag string").unionByName(tags)


def model_labels(id2label: dict) -> list[str]:
    """A model's labels in the order of their ids, which may be texts."""
    named = {int(i): str(x) for i, x in id2label.items()}
    return [named[i] for i in range(len(named))]


def aligned_labels(labels: Sequence[str], id2label: dict | None) -> list[str]:
    """Training labels in the order of the model they are to be used with. The training order stays where the model has
    no labels, only placeholders (LABEL_0 ...) or other labels."""
    if not id2label:
        return list(labels)
    theirs = model_labels(id2label)
    return theirs if sorted(theirs) == sorted(labels) else list(labels)


def label_order(tag) -> Column:
    """Sorts tags: O, then each label's B- before its I-, then the rest."""
    t = F.col(tag) if isinstance(tag, str) else tag
    pair = t.startswith("B-") | t.startswith("I-")
    return F.struct(F.when(t == "O", 0).when(pair, 1).otherwise(2).alias("kind"), F.when(pair, F.substring(t, 3, 1 << 20)).otherwise(t).alias("name"), t.startswith("I-").alias("inside"))


ENTITY_LIST = "array<struct<start:int,end:int,label:string>>"


def canonical_entities(raw) -> Column:
    """Entities of a JSON text, a list of (start, end, label): none for null and blank, an error where one lacks a part."""
    c = F.col(raw) if isinstance(raw, str) else raw
    none = F.array().cast(ENTITY_LIST)
    text = F.trim(c)
    parsed = F.from_json(text, ENTITY_LIST, {"mode": "PERMISSIVE"})
    bad = parsed.isNull() | ~text.startswith("[") | F.exists(parsed, lambda x: x.isNull() | x["start"].isNull() | x["end"].isNull() | x["label"].isNull())
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("not a list of entities: "), text)).cast(ENTITY_LIST)).otherwise(parsed)
    return F.when(c.isNull() | (text == ""), none).otherwise(checked)


def entity_metrics(rows: DataFrame, sample: Sequence[str], order: str = "start", gold: str = "gold", predicted: str = "predicted", ignore: str = "-100") -> DataFrame:
    """Precision, recall and F1 over entities of tag sequences: one counts if label and both borders agree."""
    from mentionlake.operators.evaluate import exact

    kept = rows.filter(F.col(gold) != ignore).withColumns({"_from": F.col(order), "_to": F.col(order) + 1})
    both = [decode(kept, sample, order, t, "_from", "_to") for t in (gold, predicted)]
    return exact(*both, [*sample, "label", "_from", "_to"])


def window_labels(window_tokens: DataFrame, tags: DataFrame, sample: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Tags of window tokens from the full text's; special tokens and tokens without width have none (-100 as label id)."""
    joined = window_tokens.join(tags.select(*sample, "start", "end", "tag"), [*sample, "start", "end"], "left")
    return joined.withColumn("tag", F.when(F.col("is_special") | (F.col("end") <= F.col("start")), F.lit("-100")).otherwise(F.coalesce("tag", F.lit("O"))))


def overlapping(spans: DataFrame, sample: Sequence[str], start: str = "start", end: str = "end", idx: str = "idx") -> DataFrame:
    """Pairs of overlapping spans inside a sample, each once: idx, other_idx.

    A span is filed under the one or two buckets it touches of those wider than itself (64 positions, 256, 1,024 ...), and
    looked up in these and in the wider buckets that other spans are filed under, so that neither long spans are copied
    many times nor a sample with many spans is compared in full. A pair is reported where the later of the two starts."""
    n = F.greatest(F.col(end) - F.col(start), F.lit(1)).cast("long")
    level = F.greatest(F.ceil(F.length(F.bin(n)) / 2).cast("int"), F.lit(3))
    a = spans.select(*sample, F.col(idx).alias("idx"), F.col(start).alias("_s"), F.col(end).alias("_e"), level.alias("_l")).filter("_s is not null and _e is not null")
    levels = sorted(r[0] for r in a.select("_l").distinct().collect())  # one for each power of four, sixteen at most
    bucket = lambda x, lv: F.floor(x / F.pow(F.lit(4.0), lv))
    touched = lambda lv: F.transform(F.sequence(bucket(F.col("_s"), lv), bucket(F.greatest("_e", F.col("_s") + 1) - 1, lv)), lambda b: F.struct(lv.alias("_l"), b.alias("_b")))
    filed = a.select(*sample, "idx", "_s", "_e", F.explode(touched(F.col("_l"))).alias("_k")).select(*sample, "idx", "_s", "_e", "_k.*")
    wider = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col("_l")) if levels else F.array().cast("array<int>")
    asked = a.select(*sample, F.col("idx").alias("_i2"), F.col("_s").alias("_s2"), F.col("_e").alias("_e2"), F.col("_l").alias("_l2"), F.explode(F.flatten(F.transform(wider, touched))).alias("_k")).select(*sample, "_i2", "_s2", "_e2", "_l2", "_k.*")
    hit = filed.join(asked, [*sample, "_l", "_b"]).filter("_s < _e2 and _s2 < _e").filter(F.col("_b") == bucket(F.greatest("_s", "_s2"), F.col("_l")))
    # two spans of one level meet twice, others once
    hit = hit.filter("idx < _i2 or (idx > _i2 and _l2 < _l)")
    return hit.select(*sample, F.least("idx", "_i2").alias("idx"), F.greatest("idx", "_i2").alias("other_idx"))


#: Positions in a bucket of the containment join.
BUCKET = 1_024


def contained(entities: DataFrame, passages: DataFrame, key: str | Sequence[str] = "document_id") -> DataFrame:
    """Entities joined to every passage of their document that contains them whole: a passage is filed under each
    bucket of positions it touches, an entity under that of its start, so a long document isn't compared in full."""
    keys = [key] if isinstance(key, str) else list(key)
    at = lambda c: F.floor(c / BUCKET)
    p = passages.select(*keys, "passage_id", F.col("passage_offset").alias("p_start"), (F.col("passage_offset") + F.length("text")).alias("p_end"))
    p = p.withColumn("_b", F.explode(F.sequence(at(F.col("p_start")), at(F.col("p_end")))))
    return entities.withColumn("_b", at(F.col("start"))).join(p, [*keys, "_b"]).filter("p_start <= start and end <= p_end").drop("_b")


def token_metrics(rows: DataFrame, gold: str = "gold", predicted: str = "predicted", ignore: str = "-100") -> DataFrame:
    """Token accuracy over tokens with a label."""
    kept = rows.filter(F.col(gold) != ignore)
    return kept.agg(F.count("*").alias("n_tokens"), F.coalesce(F.avg((F.col(gold) == F.col(predicted)).cast("double")), F.lit(0.0)).alias("token_accuracy"))
