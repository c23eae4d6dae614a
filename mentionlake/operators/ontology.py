"""Ontology resources: alias merge, records, and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionlake.functions import text as X


def merge_aliases(concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds aliases of known concepts that are new: neither the name nor a synonym yet. Adds the column n_added."""
    new = aliases.join(concepts.select("identifier", "name", "synonyms"), "identifier").filter("trim(alias) <> '' and alias <> name and not array_contains(synonyms, alias)")
    grouped = new.groupBy("identifier").agg(F.collect_set("alias").alias("_new"))
    out = concepts.join(grouped, "identifier", "left").withColumn("_new", F.coalesce("_new", F.array().cast("array<string>")))
    return out.withColumn("synonyms", F.array_sort(F.array_union("synonyms", "_new"))).withColumn("n_added", F.size("_new")).drop("_new")


def records(concepts: DataFrame, keep_obsolete: bool = False) -> DataFrame:
    """Resource records in id order: sorted arrays, no synonym that equals the label."""
    rows = concepts if keep_obsolete else concepts.filter("not is_obsolete")
    return rows.select(
        F.col("identifier").alias("norm_concept_id"), F.col("name").alias("norm_preferred_label"), F.array_sort(F.array_except("synonyms", F.array("name"))).alias("synonyms"),
        "namespace", F.array_sort("alt_ids").alias("alt_ids"), "definition", F.array_sort("parents").alias("parents"),
    ).orderBy("norm_concept_id")


def validate(terms: DataFrame) -> DataFrame:
    """Counts of a resource: concepts, terms, terms without normalised name."""
    return terms.agg(F.countDistinct("identifier").alias("concepts"), F.count("*").alias("terms"), F.coalesce(F.sum((F.trim("name") == "").cast("long")), F.lit(0)).alias("blank"))


def alias_pairs(terms: DataFrame, per_concept: int | None = None, seed: int = 13) -> DataFrame:
    """Unordered pairs of distinct names of a concept, each once; `per_concept` samples that many by a seeded hash.

    The sample's pairs are those of the smallest hashes, a sampling operator of the training set."""
    names = terms.select("identifier", F.trim("raw_name").alias("n")).filter("n <> ''").distinct()
    pairs = names.withColumnRenamed("n", "text_a").join(names.withColumnRenamed("n", "text_b"), "identifier").filter("text_a < text_b")
    if per_concept is None:
        return pairs
    w = Window.partitionBy("identifier").orderBy(F.xxhash64("text_a", "text_b", F.lit(seed)), "text_a", "text_b")
    return pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_concept).drop("_r")


def dedupe_pairs(pairs: DataFrame, order: str = "line") -> DataFrame:
    """First of each unordered pair, trimmed; pairs with a blank side go."""
    p = pairs.withColumns({"text_a": F.trim("text_a"), "text_b": F.trim("text_b")}).filter("text_a <> '' and text_b <> '' and text_a <> text_b")
    key = F.array_sort(F.array("text_a", "text_b"))
    return p.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct("text_a", "text_b", order), order).alias("p")).select("p.*")


def shuffled(pairs: DataFrame, seed: int = 13) -> DataFrame:
    """Seeded global order."""
    return pairs.orderBy(F.xxhash64("text_a", "text_b", F.lit(seed)), "text_a", "text_b")


def closure(concepts: DataFrame, rounds: int = 30) -> DataFrame:
    """Ancestors over the parents' edges (an extension): identifier, ancestor. Doubles path lengths each round."""
    edges = concepts.select("identifier", F.explode("parents").alias("ancestor")).distinct()
    now, n = edges, -1
    for _ in range(rounds):
        step = now.alias("a").join(now.alias("b"), F.col("a.ancestor") == F.col("b.identifier")).select(F.col("a.identifier"), F.col("b.ancestor"))
        now = now.union(step).distinct()
        m = now.count()
        if m == n:
            return now
        n = m
    raise RuntimeError("the hierarchy is deeper than the rounds allow")


def pair_key(a="text_a", b="text_b"):
    return F.array_join(F.array_sort(F.array(X.fold(a), X.fold(b))), "|")
