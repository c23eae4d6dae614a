"""Abbreviation tables and the short form cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionlake.functions import text as X
from mentionlake.functions.udfs import detect_abbreviations, key_ratio


def lookup(rows: DataFrame) -> DataFrame:
    """(key, short_form, identifier, line_no): blank or placeholder rows go, of several ids the first counts."""
    kept = rows.filter("coalesce(trim(short_form), '') <> '' and coalesce(trim(identifier), '') not in ('', '-', 'None', 'none')")
    kept = kept.withColumn("identifier", X.first_identifier("identifier")).withColumn("key", X.abbreviation_key("short_form")).withColumn("short_form", F.trim("short_form"))
    return kept.filter("identifier is not null and key <> ''").select("key", "short_form", "identifier", "line_no")


def keys(table: DataFrame) -> DataFrame:
    """One row per key: how many ids, and for a direct key its longest short form (the first of equals) and id."""
    return table.groupBy("key").agg(
        F.countDistinct("identifier").alias("n_ids"),
        F.max_by("short_form", F.struct(F.length("short_form"), -F.col("line_no"))).alias("short_form"),
        F.min_by("identifier", "line_no").alias("identifier"),
        F.array_sort(F.collect_set("identifier")).alias("identifiers"),
    )


def direct(table: DataFrame) -> DataFrame:
    return keys(table).filter("n_ids = 1").select("key", "short_form", "identifier")


def ambiguous(table: DataFrame) -> DataFrame:
    return keys(table).filter("n_ids > 1").select("key", "identifiers")


def document_long_forms(texts: DataFrame) -> DataFrame:
    """(document_key, short_key, long_form) defined in the documents; the last definition of a key wins."""
    found = texts.select("document_key", F.posexplode(detect_abbreviations("text")).alias("pos", "a"))
    found = found.select("document_key", X.abbreviation_key("a.short").alias("short_key"), F.col("a.long").alias("long_form"), "pos")
    return found.groupBy("document_key", "short_key").agg(F.max_by("long_form", "pos").alias("long_form"))


def match_keys(mentions: DataFrame, table: DataFrame, encoder=None) -> DataFrame:
    """Key of the abbreviation table that each abbreviation-like mention matches: matched_key, method, key_score.

    A key whose threshold is 1 (four characters and less) matches itself alone. A longer one matches the nearest
    key by the encoder at or over its threshold: itself, if the table has it."""
    from mentionlake.encoders import encode
    from mentionlake.operators.linking import retrieve

    m = mentions.select("mention_text").distinct().filter(X.is_abbreviation_like("mention_text")).withColumn("key", X.abbreviation_key("mention_text"))
    known = keys(table).select(F.col("key").alias("matched_key"))
    method = F.when(X.abbreviation_threshold("key") == 1.0, "exact_short_abbreviation").otherwise("encoder_abbreviation_match")
    exact = m.join(known, F.col("key") == F.col("matched_key")).select("mention_text", "matched_key", method.alias("method"), F.lit(1.0).alias("key_score"))
    if encoder is None:
        return exact
    long_ = m.filter(X.abbreviation_threshold("key") < 1.0)
    rest = long_.join(exact.select("mention_text"), "mention_text", "left_anti").withColumn("query_idx", F.xxhash64("mention_text"))
    vectors = encode(rest, encoder, "key", "vector")
    numbered = encode(known.withColumn("term_idx", F.xxhash64("matched_key")), encoder, "matched_key", "vector")
    near = retrieve(vectors, numbered, 1).join(numbered.select("term_idx", "matched_key"), "term_idx").join(rest, "query_idx")
    near = near.filter(F.col("score") + 1 >= X.abbreviation_threshold("key"))
    return exact.unionByName(near.select("mention_text", "matched_key", F.lit("encoder_abbreviation_match").alias("method"), (F.col("score") + 1).alias("key_score")))


def detector_pairs(found) -> list[tuple[str, str]]:
    """(short form, long form) of what a detector returns: a mapping, or a list of pairs, mappings or objects; blanks go."""
    names = (("short_form", "short", "abbr", "abbreviation"), ("long_form", "long", "expansion"))

    def of(x) -> tuple:
        if isinstance(x, dict):
            return tuple(next((x[k] for k in some if x.get(k)), "") for some in names)
        if isinstance(x, (list, tuple)):
            return tuple(x[:2]) if len(x) > 1 else ("", "")
        return tuple(next((getattr(x, k) for k in some[:2] if hasattr(x, k)), "") for some in names)

    rows = found.items() if isinstance(found, dict) else map(of, found) if isinstance(found, list) else ()
    clean = [(str(a).strip(), str(b).strip()) for a, b in rows]
    return [(a, b) for a, b in clean if a and b]


def expand(wanted: DataFrame, long_forms: DataFrame) -> DataFrame:
    """Long form of (document_key, matched_key): exact key, else plural variant, else the most similar key at or over
    the threshold. Adds expanded_long_form, long_form_method, long_form_key, long_form_score."""
    pairs = wanted.select("document_key", "matched_key").distinct().join(long_forms, "document_key")
    variant = F.exists(X.abbreviation_variants("matched_key"), lambda v: v == F.col("short_key"))
    kind = F.when(F.col("short_key") == F.col("matched_key"), 0).when(variant, 1).otherwise(2)
    graded = pairs.withColumn("kind", kind)
    # similarity is only computed where neither key nor variant fits
    best = graded.groupBy("document_key", "matched_key").agg(F.min("kind").alias("best"))
    graded = graded.join(best, ["document_key", "matched_key"]).filter("kind = best")
    sure = graded.filter("kind < 2").withColumn("s", F.lit(1.0))
    # a similarity can't exceed what the lengths allow, and only equal keys reach 1: both are settled without Python
    a, b, least = F.length("matched_key"), F.length("short_key"), X.abbreviation_threshold("matched_key")
    fuzzy = graded.filter((F.col("kind") == 2) & (least < 1.0) & (2 * F.least(a, b) >= least * (a + b))).withColumn("s", key_ratio("matched_key", "short_key")).filter(F.col("s") >= X.abbreviation_threshold("matched_key"))
    w = Window.partitionBy("document_key", "matched_key").orderBy(F.desc("s"), "short_key")
    out = sure.unionByName(fuzzy).withColumn("r", F.row_number().over(w)).filter("r = 1")
    method = F.element_at(F.array(F.lit("exact_key"), F.lit("exact_variant"), F.lit("fuzzy_shortform")), F.col("kind") + 1)
    return out.select("document_key", "matched_key", F.col("long_form").alias("expanded_long_form"), method.alias("long_form_method"), F.col("short_key").alias("long_form_key"), F.col("s").alias("long_form_score"))


def resolve(mentions: DataFrame, table: DataFrame, long_forms: DataFrame, encoder=None) -> DataFrame:
    """Decision for each (document_key, mention_text): direct, ambiguous_long_form, ambiguous_unresolved or null."""
    matched = match_keys(mentions, table, encoder)
    m = mentions.select("document_key", "mention_text").distinct().join(matched, "mention_text", "left")
    m = m.join(keys(table).withColumnRenamed("key", "matched_key"), "matched_key", "left")
    hits = expand(m.filter("n_ids > 1"), long_forms)
    m = m.join(hits, ["document_key", "matched_key"], "left")
    kind = F.when(F.col("n_ids") == 1, "direct").when(F.col("expanded_long_form").isNotNull(), "ambiguous_long_form").when(F.col("n_ids") > 1, "ambiguous_unresolved")
    return m.withColumn("resolution", kind)
