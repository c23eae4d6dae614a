"""Span, normalisation and end-to-end metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlake.functions import text as X

BLACKLIST = ("cell", "cells")


def ratios(tp, fp, fn) -> dict[str, Column]:
    """Precision, recall and F1; 0 where a denominator is 0."""
    tp, fp, fn = (F.col(x) if isinstance(x, str) else x for x in (tp, fp, fn))
    z = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {"precision": z(tp, tp + fp), "recall": z(tp, tp + fn), "f1": z(2 * tp, 2 * tp + fp + fn)}


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(ratios("tp", "fp", "fn"))


def exact(gold: DataFrame, predicted: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One-to-one exact matching as multisets: copies of a key match as often as both sides have it."""
    every = [*by, *keys]
    g = gold.groupBy(*every).agg(F.count("*").alias("g"))
    p = predicted.groupBy(*every).agg(F.count("*").alias("p"))
    both = g.unionByName(p, allowMissingColumns=True).groupBy(*every).agg(F.coalesce(F.sum("g"), F.lit(0)).alias("g"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"))
    total = both.groupBy(*by).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum("p").alias("_p"), F.sum("g").alias("_g")) if by else both.agg(
        F.coalesce(F.sum(F.least("g", "p")), F.lit(0)).alias("tp"), F.coalesce(F.sum("p"), F.lit(0)).alias("_p"), F.coalesce(F.sum("g"), F.lit(0)).alias("_g")
    )
    return with_ratios(total.select(*by, "tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_g") - F.col("tp")).alias("fn")))


def match(rows: list) -> list[tuple[int, int, int]]:
    """(gold_idx, pred_idx, overlap): predictions in order take the free gold mention of the largest overlap (the first of equals).

    A row: side, idx, barred and places (offset, end, first token, last token); gold rows first, each side in order. Where
    both mentions touch tokens they meet in one, else in a character."""
    gold, out = [], []
    for r in rows:
        touched = [x for x in r.places if x["first"] <= x["last"]]
        if r.side == "gold":
            gold.append((r.idx, r.places, touched))
            continue
        if r.barred:
            continue
        best, most = None, -1
        for k, (_, places, theirs) in enumerate(gold):
            shared = sum(max(0, min(x["end"], y["end"]) - max(x["offset"], y["offset"])) for x in places for y in r.places)
            meets = any(x["first"] <= y["last"] and y["first"] <= x["last"] for x in theirs for y in touched) if theirs and touched else shared > 0
            if meets and shared > most:
                best, most = k, shared
        if best is not None:
            out.append((gold.pop(best)[0], r.idx, most))
    return out


def relaxed_matches(gold: DataFrame, predicted: DataFrame, by: Sequence[str] = (), blacklist: Sequence[str] = BLACKLIST) -> DataFrame:
    """Greedy one-to-one matches inside passages: gold_idx, pred_idx, overlap.

    Both sides: document_id, passage_key, passage_offset, passage_text, locations (sorted offset, length),
    text, idx (document order). Which tokens a mention touches is found where it lies, so texts don't move.
    Spans that can't reach each other, not even by a shared token, are independent, so each passage is cut
    into islands first and no task holds more than one island."""
    low = [w.lower() for w in blacklist]
    cols = [*by, "document_id", "passage_key", "passage_offset", "passage_text", "locations", "idx"]
    g = gold.select(*cols, F.lit("gold").alias("side"), F.lit(False).alias("barred"))
    p = predicted.select(*cols, F.lit("pred").alias("side"), X.normalize_mention("text").isin(low).alias("barred"))
    both = g.unionByName(p)
    group = [*by, "document_id", "passage_key"]
    text = F.coalesce("passage_text", F.lit(""))
    before = lambda at: F.substring(text, F.lit(1), F.greatest(at - F.col("passage_offset"), F.lit(0)))
    tokens = lambda t: F.size(F.regexp_extract_all(t, F.lit(r"(?U)\S+"), F.lit(0)))
    rest = lambda at: F.substring(text, F.greatest(at - F.col("passage_offset") + 1, F.lit(1)), F.length(text))

    def place(x: Column) -> Column:
        end = x["offset"] + x["length"]
        # a token that the offset cuts is one of those that begin before it
        inside = (before(x["offset"]).rlike(r"(?U)\S$") & rest(x["offset"]).rlike(r"(?U)^\S")).cast("int")
        return F.struct(x["offset"].alias("offset"), end.alias("end"), (tokens(before(x["offset"])) - inside).alias("first"), (tokens(before(end)) - 1).alias("last"))

    first = F.array_min(F.transform("locations", lambda x: x["offset"]))
    last = F.array_max(F.transform("locations", lambda x: x["offset"] + x["length"]))
    # out to the borders of the tokens that the ends touch
    lead = F.length(F.regexp_extract(before(first), r"(?U)\S*$", 0))
    tail = F.length(F.regexp_extract(rest(last), r"(?U)^\S*", 0))
    both = both.select(*group, "idx", "side", "barred", F.transform("locations", place).alias("places"), (first - lead).alias("_s"), (last + tail).alias("_e"))
    w = Window.partitionBy(*group).orderBy("_s", "_e", "side", "idx")
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_new", (F.coalesce(reach, F.lit(-1)) <= F.col("_s")).cast("int")).withColumn("_island", F.sum("_new").over(w))
    keys = [*group, "_island"]
    kinds = dict(both.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in by] + ["gold_idx bigint", "pred_idx bigint", "overlap bigint"])

    # an island with one side only holds no match; the others stand together, each in order
    sides = F.size(F.collect_set("side").over(Window.partitionBy(*keys)))
    ordered = both.withColumn("_sides", sides).filter("_sides = 2").sortWithinPartitions(*keys, "side", "idx").select(*keys, "side", "idx", "places", "barred")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # islands may go over the border of two batches
        island, now = [], None

        def close() -> list:
            return [(*now[: len(by)], *m) for m in match(island)] if island else []

        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if r[: len(keys)] != now:
                    out += close()
                    island, now = [], r[: len(keys)]
                island.append(r)
            yield _frame(out, by)
        yield _frame(close(), by)

    return ordered.mapInPandas(run, schema)


def _frame(rows: list, by: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*by, "gold_idx", "pred_idx", "overlap"], dtype=object)


def relaxed(gold: DataFrame, predicted: DataFrame, by: Sequence[str] = (), blacklist: Sequence[str] = BLACKLIST) -> DataFrame:
    """Relaxed span metrics; predictions on the blacklist get no credit and stay false positives."""
    m = relaxed_matches(gold, predicted, by, blacklist).select(*by, F.lit("m").alias("k"))
    every = reduce(DataFrame.unionByName, [m, gold.select(*by, F.lit("g").alias("k")), predicted.select(*by, F.lit("p").alias("k"))])
    n = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, 1)), F.lit(0)).cast("long")
    total = every.groupBy(*by).agg(n("m").alias("tp"), n("p").alias("_p"), n("g").alias("_g"))
    return with_ratios(total.select(*by, "tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_g") - F.col("tp")).alias("fn")))


def span_rows(gold: DataFrame, predicted: DataFrame, dataset: str, system: str, blacklist: Sequence[str] = BLACKLIST) -> DataFrame:
    """The two rows of a pair of mention tables: exact and relaxed."""
    one = exact(gold, predicted, ["document_id", "passage_key", "locations"]).withColumn("criterion", F.lit("exact_span"))
    two = relaxed(gold, predicted, blacklist=blacklist).withColumn("criterion", F.lit("relaxed_span"))
    both = one.unionByName(two).withColumns({"dataset": F.lit(dataset), "system": F.lit(system), "task": F.lit("NER")})
    return both.select("dataset", "system", "task", "criterion", "tp", "fp", "fn", "precision", "recall", "f1")


MACRO = "Macro average"


def with_macro(rows: DataFrame, keys: Sequence[str] = ("system", "task", "criterion"), dataset: str = "dataset") -> DataFrame:
    """Appends the average over datasets; counts stay empty there, earlier averages are left out of it."""
    mean = rows.filter(F.col(dataset) != MACRO).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return rows.unionByName(mean.withColumn(dataset, F.lit(MACRO)), allowMissingColumns=True)


# identifiers of gold annotations


def exact_ids(identifier: str = "identifier") -> Column:
    """The one identifier of an annotation that is exactly one and no related match; null otherwise."""
    i = F.trim(F.col(identifier))
    plain = ~F.lower(i).contains("none") & ~i.rlike("[;,]") & ~F.lower(i).contains("(skos:related)")
    got = X.clean_identifier(identifier)
    return F.when(plain & (got != "") & (got != "-"), F.array(got))


def single_id(identifier: str = "identifier") -> Column:
    """As exact_ids, but related matches count."""
    i = F.trim(F.col(identifier))
    got = X.clean_identifier(identifier)
    return F.when(~F.lower(i).contains("none") & ~i.rlike("[;,]") & (got != "") & (got != "-"), F.array(got))


def all_ids(identifier: str = "identifier") -> Column:
    got = X.split_identifiers(identifier)
    return F.when(F.size(got) > 0, got)


ITERATORS = {"exact_ids": exact_ids, "single_id": single_id, "all_ids": all_ids}


def surviving(ranked: DataFrame, threshold: float | None = 0.0, keys: Sequence[str] = ("doc_idx", "passage_id", "ann_idx")) -> DataFrame:
    """Predictions that count, with their new rank: placeholders and scores that are missing, no number or under the threshold go.

    A row is a prediction of an annotation (rank, pred_id, score_text), or an annotation with all of its own as `candidates`:
    these are ranked where they lie, and nothing moves."""

    def counts(pred_id: Column, score_text: Column) -> Column:
        given = pred_id.isNotNull() & ~F.lower(pred_id).isin("", "-", "none")
        s = X.safe_double(score_text)
        return given if threshold is None else given & s.isNotNull() & (s >= threshold)

    if "candidates" in ranked.columns:
        kept = F.filter(F.array_sort(F.transform("candidates", lambda x: F.struct(x["rank"].alias("rank"), x["pred_id"].alias("pred_id"), x["score_text"].alias("score_text")))), lambda x: counts(x["pred_id"], x["score_text"]))
        rest = [c for c in ranked.columns if c != "candidates"]
        return ranked.select(*rest, F.posexplode(kept).alias("_at", "_c")).select(*rest, "_c.*", (F.col("_at") + 1).alias("place"))
    r = ranked.filter(counts(F.col("pred_id"), F.col("score_text")))
    return r.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")))


def _found(kind: str, place: str, ks: Sequence[int]) -> list[Column]:
    """Aggregates over keys: those that either side has, those of the reference, and for each k those among the k best and the hits."""
    n = lambda c: F.count(F.when(c, 1))
    r, p = F.col(kind).isNotNull(), F.col(place)
    per = F.array(*[F.struct(F.lit(k).alias("topk"), n(r & (p <= k)).alias("numerator"), n(p <= k).alias("precision_denominator"), n(r).alias("recall_denominator")) for k in ks])
    return [n(r | p.isNotNull()), per]


def _scored(counts: DataFrame) -> DataFrame:
    z = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.withColumns({
        "precision": z("numerator", "precision_denominator"), "recall": z("numerator", "recall_denominator"),
        "f1": F.when(F.col("precision_denominator") + F.col("recall_denominator") > 0, 2 * F.col("numerator") / (F.col("precision_denominator") + F.col("recall_denominator"))).otherwise(F.lit(0.0)),
    })


def topk_metrics(reference: DataFrame, predicted: DataFrame, keys: Sequence[str], by: Sequence[str] = (), ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Set metrics of the k best for each k in one pass. `reference`: by, keys; `predicted`: by, keys, place."""
    every = [*by, *keys]
    rows = reference.select(*every, F.lit(1).alias("_r")).unionByName(predicted.select(*every, F.col("place").alias("_place")), allowMissingColumns=True)
    both = rows.groupBy(*every).agg(F.max("_r").alias("_r"), F.min("_place").alias("_place"))
    any_, per = _found("_r", "_place", ks)
    out = both.groupBy(*by).agg(any_.alias("_any"), per.alias("_k")).filter("_any > 0")
    return _scored(out.select(*by, F.explode("_k").alias("k")).select(*by, "k.*"))


def normalisation(gold: DataFrame, ranked: DataFrame, iterator: str, types: Sequence[str], end_to_end: bool = False, threshold: float | None = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Gold-span or strict end-to-end metrics of one iterator and set of types.

    `gold`: passage_key, entity_type, identifier, locations. `ranked` rows carry the same and rank,
    pred_id, score_text. Gold-span scoring takes only predictions on annotations that the iterator keeps."""
    kept = F.col("entity_type").isin(list(types))
    ids = ITERATORS[iterator]
    reference = gold.filter(kept).withColumn("pred_id", F.explode(ids()))
    p = ranked.filter(kept)
    if not end_to_end:
        p = p.filter(ids().isNotNull())
    keys = ["passage_key", "entity_type", *(["locations"] if end_to_end else []), "pred_id"]
    return topk_metrics(reference, surviving(p, threshold, (*by, "doc_idx", "passage_id", "ann_idx")), keys, by)


#: Iterators and type sets of a corpus with graded identifiers, and of any other.
GRID = [(i, t) for i in ("exact_ids", "all_ids") for t in (("cell_phenotype",), ("cell_hetero",), ("cell_phenotype", "cell_hetero"), ("cell_type",))]
PLAIN_GRID = [("single_id", ("cell_type",))]


def grid(gold: DataFrame, ranked: DataFrame, settings: Sequence[tuple[str, Sequence[str]]] = tuple(GRID), end_to_end: bool = False, threshold: float | None = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """`normalisation` of several settings (iterator, types) in one pass: columns iterator and entity_types tell them apart.

    Each annotation is read once and handed to the settings that take it."""

    kinds = sorted({x for _, ts in settings for x in ts})
    iterators = list(dict.fromkeys(i for i, _ in settings))
    ids = {i: ITERATORS[i]() for i in iterators}
    none = F.array().cast("array<string>")
    keys = [*by, "passage_key", "entity_type", *(["locations"] if end_to_end else []), "pred_id"]
    of_type = F.col("entity_type").isin(kinds)
    # the type is part of the key, so a setting is a sum over types: rows move once, and not for each setting
    named = gold.filter(of_type).withColumns({f"_ids{n}": F.coalesce(ids[i], none) for n, i in enumerate(iterators)})
    named = named.withColumn("pred_id", F.explode(F.array_distinct(F.concat(*[f"_ids{n}" for n in range(len(iterators))]))))
    reference = named.select(*keys, *[F.when(F.array_contains(f"_ids{n}", F.col("pred_id")), 1).alias(f"_r{n}") for n in range(len(iterators))])
    # a prediction's place among those of its annotation is the same in every setting
    taken = ranked.filter(of_type).withColumns({f"_t{n}": F.lit(True) if end_to_end else ids[i].isNotNull() for n, i in enumerate(iterators)})
    placed = surviving(taken, threshold, (*by, "doc_idx", "passage_id", "ann_idx"))
    predicted = placed.select(*keys, *[F.when(F.col(f"_t{n}"), F.col("place")).alias(f"_p{n}") for n in range(len(iterators))])
    rows = reference.unionByName(predicted, allowMissingColumns=True)
    both = rows.groupBy(*keys).agg(*[f(f"{c}{n}").alias(f"{c}{n}") for n in range(len(iterators)) for f, c in ((F.max, "_r"), (F.min, "_p"))])
    made = []
    for n in range(len(iterators)):
        any_, per = _found(f"_r{n}", f"_p{n}", (1, 5, 10))
        made += [any_.alias(f"_any{n}"), per.alias(f"_k{n}")]
    counted = both.groupBy(*by, "entity_type").agg(*made)  # a row a type
    one = F.array(*[F.when(F.col("entity_type").isin(list(ts)), F.struct(F.lit(i).alias("iterator"), F.lit("+".join(ts)).alias("entity_types"), F.col(f"_any{iterators.index(i)}").alias("any"), F.col(f"_k{iterators.index(i)}").alias("ks"))) for i, ts in settings])
    flat = counted.select(*by, F.explode(F.filter(one, lambda x: x.isNotNull())).alias("s")).filter("s.any > 0").select(*by, "s.iterator", "s.entity_types", F.explode("s.ks").alias("k"))
    names = ("numerator", "precision_denominator", "recall_denominator")
    return _scored(flat.groupBy(*by, "iterator", "entity_types", "k.topk").agg(*[F.sum(f"k.{c}").alias(c) for c in names]))


def pivoted(rows: DataFrame, datasets: Sequence[str], value: str = "f1", row: str = "system", column: str = "dataset") -> DataFrame:
    """Systems by datasets; the datasets are given, so no pass is spent on finding them."""
    return rows.groupBy(row).pivot(column, list(datasets)).agg(F.first(value))


def markdown(rows: DataFrame) -> str:
    """A small result table as Markdown (a report; its rows are systems)."""
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows.collect())])


def throughput(mentions: int, seconds: float) -> dict[str, float | None]:
    """Mentions a second and milliseconds a mention; None where undefined."""
    return {"mentions_per_second": mentions / seconds if mentions and seconds else None, "ms_per_mention": 1000 * seconds / mentions if mentions and seconds else None}
