"""Registered queries of this subpackage and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm import ann, classifier, html_text, langid, lm, mixing, packing, quality_rules, sharding, simhash

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer's file; the files are installed beside the libraries, not in the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).select("doc_id", "rules.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    model = langid.fit(docs, may_learn="crc32(cast(doc_id as string)) % 4 <> 2")
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "n_near", "component_id")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit(docs, _table(spark, sf_dir, "labels"), may_learn="crc32(cast(doc_id as string)) % 4 <> 2")
    out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    scored = classifier.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"))


def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(_table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    return sharded.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours,
        op2_quality_rules,
        op3_language_id,
        op4_best_fit_packing,
        op5_source_mixing,
        op6_simhash_near_duplicates,
        op7_lm_scoring,
        op8_html_extraction,
        op9_quality_classifier,
        op10_histogram_sharding,
    )
}

_CRC_TABLE = []
for _i in range(256):
    for _ in range(8):
        _i = _i >> 1 ^ (0xEDB88320 if _i & 1 else 0)
    _CRC_TABLE.append(_i)


def _crc32_sql(octets: str) -> str:
    """CRC-32 of a list of octets, which DuckDB doesn't have, by its table."""
    step = f"lambda x, y: xor(x >> 8, CAST([{', '.join(map(str, _CRC_TABLE))}] AS BIGINT[])[(xor(x, y) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}), 4294967295::BIGINT)"


#: CRC-32 of doc_id as text (ASCII)
CRC32_SQL = _crc32_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))")

#: op5: targets by the closed form of water-filling, words by the running sum in the seeded order.
OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 3 * source_size AS cap, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM per
), stepped AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS own,
         (SELECT CAST(sum(source_size) AS BIGINT) FROM weighed) AS total, (SELECT CAST(sum(weight) AS BIGINT) FROM weighed) AS all_weight
  FROM weighed
), prefixed AS (
  SELECT *, row_number() OVER o AS k,
         CAST(total - coalesce(CAST(sum(cap) OVER b AS BIGINT), 0) AS DOUBLE) / CAST(all_weight - coalesce(CAST(sum(weight) OVER b AS BIGINT), 0) AS DOUBLE) AS step
  FROM stepped WINDOW o AS (ORDER BY own, source NULLS LAST), b AS (ORDER BY own, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT coalesce(arg_min(step, k) FILTER (own >= step), 0) AS level FROM prefixed
), aimed AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * level) AS target,
         CASE WHEN source_size > 0 THEN CAST(floor(least(CAST(cap AS DOUBLE), weight * level) / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM weighed, leveled
), run AS (
  SELECT d.doc_id, d.size, a.source_size, a.target, a.whole,
         CAST(floor(a.target - a.whole * a.source_size + 0.5) AS BIGINT) AS rest,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM run
"""



def _op2_sql() -> str:
    """Windows of words as text, repeats by counting them per document, coverage by a running maximum."""
    r = quality_rules
    lengths = sorted({5, *r.GRAM_LIMITS})
    leads = ", ".join(f"lead(w0, {k}) OVER o AS w{k}" for k in range(1, max(lengths)))
    # words hold no space, so joined windows are exact; a window over the end is null
    grams = ", ".join(" || ' ' || ".join(f"w{k}" for k in range(n)) + f" AS g{n}" for n in lengths)
    twice = ", ".join(f"g{n} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY i) > 1 AS t{n}" for n in lengths)
    twice += ", g5 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g5) > 1 AS t0"
    inside = ", ".join(f"max(CAST(t{n} AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m{n}" for n in lengths)
    inside += ", max(CAST(t0 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m0"
    sums = ", ".join(f"CAST(sum(c * m{n}) AS DOUBLE) / greatest(sum(c), 1) AS s{n}" for n in lengths)
    limits = " AND ".join(f"coalesce(s{n}, 0) <= CAST({x} AS DOUBLE)" for n, x in r.GRAM_LIMITS.items())
    most = ", ".join(f"coalesce(s{n}, 0)" for n in r.GRAM_LIMITS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), u AS (
  SELECT doc_id, unnest(w) AS w0, generate_subscripts(w, 1) AS i FROM d
), v AS (
  SELECT doc_id, i, w0, {leads} FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT doc_id, i, length(w0) AS c, {grams} FROM v
), t AS (
  SELECT doc_id, i, c, {twice} FROM g
), m AS (
  SELECT doc_id, i, c, {inside} FROM t
), per AS (
  SELECT doc_id, CAST(sum(c) AS BIGINT) AS word_chars, CAST(sum(m0) AS BIGINT) AS n_repeat_words, {sums} FROM m GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d
), again AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS BIGINT) AS c FROM again WHERE nth > 1 GROUP BY doc_id
), one AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup.c, 0) AS dup_line_chars, greatest({most}) AS gram_coverage,
         len(w) < {r.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {r.REPEAT_PERCENT} * len(w) AS base_failed, {limits} AS within
  FROM d LEFT JOIN per USING (doc_id) LEFT JOIN dup USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, dup_line_chars, gram_coverage,
       NOT base_failed AND within AND dup_line_chars <= CAST({r.LINE_LIMIT} AS DOUBLE) * word_chars AND n_symbols <= CAST({r.SYMBOL_LIMIT} AS DOUBLE) * greatest(word_chars, 1) AS kept
FROM one
"""


def _op7_sql() -> str:
    """The trigram model by joins: a probability is its own count's share where there is one, else what the failure leaves to the order below."""
    two, three = lm.PRIORS
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, crc32_rest = 1 AS held_out,
         list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), ['']) AS w
  FROM (SELECT doc_id, text, {CRC32_SQL} % 5 AS crc32_rest FROM documents)
), t AS (
  SELECT r, doc_id, held_out, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM d
), g AS (
  SELECT r, doc_id, held_out, i, c, coalesce(lag(c, 1) OVER o, ' ') AS b, CASE WHEN i = 1 THEN NULL ELSE coalesce(lag(c, 2) OVER o, ' ') END AS a
  FROM t WINDOW o AS (PARTITION BY r ORDER BY i)
), one AS (
  SELECT c, count(*) AS k FROM g WHERE NOT held_out GROUP BY c
), context AS (
  SELECT b, count(*) AS k FROM g WHERE NOT held_out GROUP BY b
), two AS (
  SELECT b, c, count(*) AS k FROM g WHERE NOT held_out GROUP BY b, c
), three AS (
  SELECT a, b, c, count(*) AS k FROM g WHERE NOT held_out AND a IS NOT NULL GROUP BY a, b, c
), size AS (
  SELECT CAST(sum(k) AS BIGINT) AS n, count(*) AS v FROM one
), p AS (
  SELECT g.r, g.doc_id, g.held_out, one.k IS NOT NULL AS known, n, (coalesce(one.k, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)) AS p1,
         coalesce(context.k, 0) AS x2, coalesce(two.k, 0) AS k2, g.a IS NOT NULL AS deep, coalesce(before.k, 0) AS x3, coalesce(three.k, 0) AS k3
  FROM g CROSS JOIN size LEFT JOIN one ON one.c = g.c LEFT JOIN context ON context.b = g.b LEFT JOIN two ON two.b = g.b AND two.c = g.c
  LEFT JOIN two AS before ON before.b = g.a AND before.c = g.b LEFT JOIN three ON three.a = g.a AND three.b = g.b AND three.c = g.c
), q AS (
  SELECT *, (k2 + {two}::DOUBLE * p1) / (x2 + {two}::DOUBLE) AS p2 FROM p
)
SELECT any_value(doc_id) AS doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, CAST(sum(CAST(known AS INTEGER)) AS BIGINT) AS n_known, any_value(n) AS train_tokens,
       fsum(log10(p1)) AS base_score, fsum(log10(CASE WHEN deep THEN (k3 + {three}::DOUBLE * p2) / (x3 + {three}::DOUBLE) ELSE p2 END)) AS score
FROM q GROUP BY r
"""


ORACLE_SQL: dict[str, str] = {"op2_quality_rules": _op2_sql(), "op5_source_mixing": OP5_SQL, "op7_lm_scoring": _op7_sql()}
