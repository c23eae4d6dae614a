"""Registered queries over the driver tables, each with its SQL twin.

The driver tables hold no ontology and no gold annotations, so relational surrogates drive the same
operator code. Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionlake.functions import infons as I
from mentionlake.functions import text as X
from mentionlake.functions import udfs
from mentionlake.operators import abbreviations as A
from mentionlake.operators import decode as D
from mentionlake.operators import evaluate as E
from mentionlake.operators import filters, linking
from mentionlake.operators import ontology as O
from mentionlake.sources import resources as R
from mentionlake.taggers import GazetteerTagger, tag, tags

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# pieces of SQL
TOKEN_SQL = r"'[\p{L}\p{N}]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x{85}]|_|,'"
PLURAL_SQL = """CASE WHEN NOT ends_with(t, 's') THEN t WHEN ends_with(t, 'viruses') THEN left(t, length(t) - 2)
  WHEN ends_with(t, 'ies') AND NOT ends_with(t, 'eies') AND NOT ends_with(t, 'aies') THEN left(t, length(t) - 3) || 'y'
  WHEN ends_with(t, 'es') AND NOT ends_with(t, 'aes') AND NOT ends_with(t, 'ees') AND NOT ends_with(t, 'oes') THEN CASE WHEN ends_with(t, 'sses') THEN left(t, length(t) - 2) ELSE left(t, length(t) - 1) END
  WHEN ends_with(t, 'us') OR ends_with(t, 'ss') THEN t ELSE left(t, length(t) - 1) END"""


def _tokens_sql(x: str) -> str:
    return f"regexp_extract_all({x}, {TOKEN_SQL})"


def _fold_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


def _norm_sql(x: str) -> str:
    return f"array_to_string(list_transform({_tokens_sql(x)}, lambda t: {PLURAL_SQL}), ' ')"


def _jaccard_sql(a: str, b: str) -> str:
    """Words between white space of the folded texts, as sets."""
    ta, tb = (rf"list_distinct(regexp_extract_all({_fold_sql(x)}, '\S+'))" for x in (a, b))
    return f"(CASE WHEN len({ta}) = 0 OR len({tb}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({ta}, {tb})) AS DOUBLE) / len(list_distinct(list_concat({ta}, {tb}))) END)"


KEY_SQL = r"regexp_replace(trim({x}), '[-\x{2010}-\x{2014}\x{2212}\s]', '', 'g')"


def _key_sql(x: str) -> str:
    return KEY_SQL.replace("{x}", x)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# scalar functions


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents)")
def split_tokens(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", X.split_tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT doc_id, md5({_norm_sql('text')}) AS digest FROM documents")
def plural_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize_text("text")).alias("digest"))


@query(f"SELECT p_partkey, {_norm_sql(chr(39) + 'bodies ' + chr(39) + ' || p_name || ' + chr(39) + 's, viruses classes' + chr(39))} AS name FROM part")
def plural_variants(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", X.normalize_text(F.concat(F.lit("bodies "), "p_name", F.lit("s, viruses classes"))).alias("name"))


# hyphens, plus signs and digits stay inside words; case folds
_LEFT = "p_name || CASE WHEN p_size % 3 = 0 THEN '-Cell CD' || (p_size % 4) || '+' ELSE '  cell, x' END"
_RIGHT = "upper(p_name) || CASE WHEN p_size % 2 = 0 THEN ' cell cd' || (p_size % 4) ELSE '-cell CD0+' END || ' ' || p_type"


@query(f"SELECT p_partkey, round({_jaccard_sql('l', 'r')}, 9) AS jaccard FROM (SELECT p_partkey, {_LEFT} AS l, {_RIGHT} AS r FROM part)")
def token_jaccard(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.expr(_LEFT).alias("l"), F.expr(_RIGHT).alias("r"))
    return p.select("p_partkey", F.round(X.token_jaccard("l", "r"), 9).alias("jaccard"))


_OUTER = "CASE WHEN p_size % 5 = 0 THEN 'x ()' WHEN p_size % 5 = 1 THEN p_name ELSE p_name || ' (x ( ' || CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE lower(p_type) END || ') y) (z)' END"
_INNER = "CASE WHEN p_size % 10 = 0 THEN ' ' WHEN p_size % 7 = 0 THEN 'b (' || p_name || ')' WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END"


def _inside_sql(outer: str, inner: str) -> str:
    return rf"list_contains(list_transform(regexp_extract_all({outer}, '\(([^()]*)\)', 1), lambda x: {_fold_sql('x')}), {_fold_sql(inner)})"


@query(f"SELECT p_partkey, CAST(CASE WHEN {_inside_sql('a', 'b')} OR {_inside_sql('b', 'a')} THEN 1 ELSE 0 END AS DOUBLE) AS related FROM (SELECT p_partkey, {_OUTER} AS a, {_INNER} AS b FROM part)")
def parenthetical(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.expr(_OUTER).alias("a"), F.expr(_INNER).alias("b"))
    return p.select("p_partkey", X.has_parenthetical_relation("a", "b").alias("related"))


@query(rf"""SELECT conv_id, turn, md5(regexp_replace({_fold_sql('text')}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS digest FROM conversations""")
def mention_norm(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.normalize_mention("text")).alias("digest"))


_SHORT = "p_brand || '-' || p_type || CASE WHEN p_size % 3 = 0 THEN 's' ELSE '' END"


@query(
    f"""SELECT p_partkey, k AS key, CASE WHEN length(k) <= 4 THEN 1.0 WHEN length(k) <= 7 THEN 0.95 ELSE 0.9 END AS threshold,
  CASE WHEN ends_with(k, 's') THEN k || '|' || left(k, length(k) - 1) ELSE k || '|' || k || 's' END AS variants
  FROM (SELECT p_partkey, {_key_sql(_SHORT)} AS k FROM part)"""
)
def abbreviation_keys(spark, sf_dir):
    k = _t(spark, sf_dir, "part").select("p_partkey", X.abbreviation_key(F.expr(_SHORT)).alias("key"))
    return k.select("p_partkey", "key", X.abbreviation_threshold("key").cast("double").alias("threshold"), F.array_join(X.abbreviation_variants("key"), "|").alias("variants"))


@query(
    rf"""SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (length(k) > 1 AND (regexp_matches(x, '[A-Z]') OR regexp_matches(x, '[0-9]') OR regexp_matches(x, '[+/-]') OR (length(k) <= 12 AND NOT contains(x, ' ')))) AS BIGINT) AS n_like
  FROM (SELECT kind, x, {_key_sql('x')} AS k FROM (SELECT 'name' AS kind, p_name AS x FROM part UNION ALL SELECT 'type', lower(p_type) FROM part UNION ALL SELECT 'brand', p_brand FROM part UNION ALL SELECT 'customer', lower(replace(c_name, '#', ' long name ')) FROM customer)) GROUP BY kind"""
)
def abbreviation_like(spark, sf_dir):
    p, c = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "customer")
    x = p.select(F.lit("name").alias("kind"), F.col("p_name").alias("x")).union(p.select(F.lit("type"), F.lower("p_type"))).union(p.select(F.lit("brand"), "p_brand"))
    x = x.union(c.select(F.lit("customer"), F.lower(F.replace("c_name", F.lit("#"), F.lit(" long name ")))))
    return x.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(X.is_abbreviation_like("x"), 1)).alias("n_like"))


_IDENT = "CASE WHEN p_size % 5 = 0 THEN 'None' WHEN p_size % 5 = 1 THEN 'CL:' || p_size || ' (skos:related)' WHEN p_size % 5 = 2 THEN 'CL:' || p_size || ';CL:' || (p_size + 1) || ',-' WHEN p_size % 5 = 3 THEN ' CL:' || p_size || ' (skos:exact)' ELSE '-' END"


@query(
    f"""SELECT p_partkey, trim(replace(replace(trim(i), '(skos:exact)', ''), '(skos:related)', '')) AS cleaned,
  array_to_string(list_filter(list_transform(regexp_split_to_array(trim(replace(replace(trim(i), '(skos:exact)', ''), '(skos:related)', '')), '[;,]'), lambda x: trim(x)), lambda x: x <> '' AND x <> '-' AND lower(x) <> 'none'), '|') AS ids,
  CASE WHEN p_size % 5 = 3 THEN 'CL:' || p_size END AS exact_id, CASE WHEN p_size % 5 IN (1, 3) THEN 'CL:' || p_size END AS single_id
  FROM (SELECT p_partkey, p_size, {_IDENT} AS i FROM part)"""
)
def identifier_fields(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("identifier", F.expr(_IDENT))
    return p.select("p_partkey", X.clean_identifier("identifier").alias("cleaned"), F.array_join(X.split_identifiers("identifier"), "|").alias("ids"), F.get(E.exact_ids(), F.lit(0)).alias("exact_id"), F.get(E.single_id(), F.lit(0)).alias("single_id"))


@query(r"""SELECT c_custkey, regexp_replace(trim('cl_' || c_custkey), '(?i)^cl[_:]', 'CL:') AS concept, TRY_CAST(replace(c_name, 'Customer#', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'x' END) AS INTEGER) AS number, printf('%.8f', c_acctbal) AS score_text FROM customer""")
def safe_casts(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    n = F.replace("c_name", F.lit("Customer#"), F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.lit("x")))
    return c.select("c_custkey", X.concept_id(F.concat(F.lit("cl_"), F.col("c_custkey").cast("string"))).alias("concept"), X.safe_int(n, None).alias("number"), X.score_text("c_acctbal").alias("score_text"))


@query("SELECT doc_id, CAST(strlen(left(text, CAST(n_chars // 2 AS INTEGER))) AS BIGINT) AS middle_byte, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def byte_offsets(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", X.byte_offset("text", F.expr("n_chars div 2")).cast("long").alias("middle_byte"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(
    """SELECT CASE WHEN upper(role) = 'USER' THEN 'USER' ELSE 'OTHER' END AS side, CAST(count(*) AS BIGINT) AS n FROM conversations
  WHERE trim(text) <> '' AND lower(role) IN ('user', 'assistant') AND lower(role) <> 'system' GROUP BY 1"""
)
def type_filters(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").filter(filters.processable("role", "text", "none") & filters.type_allowed("role", ["User", "ASSISTANT"], ["System"]))
    return c.groupBy(F.when(F.upper("role") == "USER", "USER").otherwise("OTHER").alias("side")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(unnest([length(r) FOR r IN [regexp_extract(text, '^\\S+')]]) AS BIGINT) AS first_length, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n_tokens FROM documents".replace("\\\\", "\\"))
def spaced_token_spans(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", udfs.spaced_tokens("text").alias("t"))
    first = F.get("t", F.lit(0))
    return d.select("doc_id", F.when(first["start"] == 0, first["end"]).otherwise(0).cast("long").alias("first_length"), F.size("t").cast("long").alias("n_tokens"))


@query()
def sequence_similarity(spark, sf_dir):
    """Matching-block similarity has no SQL form; held against a plain implementation in the tests."""
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", udfs.sequence_ratio("p_name", F.concat("p_type", F.lit(" "), "p_name")).alias("ratio"))


@query(
    r"""WITH c AS (SELECT conv_id, upper(left(w[1], 1)) || upper(left(w[2], 1)) AS short, lower(w[1]) || ' ' || lower(w[2]) AS long FROM (SELECT conv_id, regexp_extract_all(text, '[A-Za-z]{4,9}') AS w FROM conversations WHERE turn = 0) WHERE len(w) > 1)
  SELECT CAST(conv_id AS VARCHAR) AS document_key, short AS short_key, long AS long_form FROM c WHERE lower(left(short, 1)) <> lower(right(short, 1))
  AND NOT contains(substr(split_part(long, ' ', 1), 2), lower(right(short, 1))) AND NOT contains(split_part(long, ' ', 2)[2:], lower(right(short, 1)))"""
)
def long_forms(spark, sf_dir):
    """Definitions made of the first two words of each conversation; those that two readings fit are left out."""
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]{4,9}"), F.lit(0))
    c = _t(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").cast("string").alias("document_key"), w.alias("w")).filter("size(w) > 1")
    c = c.withColumns({"a": F.lower(F.col("w")[0]), "b": F.lower(F.col("w")[1])})
    first, last = F.substring("a", 1, 1), F.substring("b", 1, 1)
    c = c.filter((first != last) & ~F.expr("substring(a, 2)").contains(last) & ~F.expr("substring(b, 2)").contains(last))
    text = F.concat(F.lit("We saw 12 "), "a", F.lit(" "), "b", F.lit(" ("), F.upper(F.concat(first, last)), F.lit(") in it (see below)."))
    return A.document_long_forms(c.select("document_key", text.alias("text")))


@query("SELECT CAST(count(*) AS BIGINT) AS documents FROM documents")
def long_form_scan(spark, sf_dir):
    """The detector over every document: how many it was given."""
    d = _t(spark, sf_dir, "documents").select(udfs.detect_abbreviations("text").alias("a"))
    return d.agg(F.count(F.when(F.size("a") >= 0, 1)).alias("documents"))


@query()
def sentence_chunks(spark, sf_dir):
    """Parts of at most 2,000 characters; tests check that they tile the text."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(udfs.text_chunks(2000)("text")).alias("chunk", "c"))
    return d.select("doc_id", "chunk", "c.start", "c.end")


# sources


@query(
    """SELECT doc_id, CAST(passage_id AS INTEGER) AS passage_id, CAST(coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY passage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS passage_offset, CAST(length(p) AS BIGINT) AS n_chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS passage_id FROM documents)"""
)
def passage_split(spark, sf_dir):
    return _passages(spark, sf_dir).select("doc_id", "passage_id", "passage_offset", F.length("text").cast("long").alias("n_chars"))


def _passages(spark, sf_dir):
    # offsets inside the row: no shuffle
    parts = F.split("text", "\n")
    start = F.expr("aggregate(p, struct(0L as at, cast(array() as array<bigint>) as o), (s, x) -> struct(s.at + length(x) + 1 as at, concat(s.o, array(s.at)) as o)).o")
    d = _t(spark, sf_dir, "documents").select("doc_id", parts.alias("p")).select("doc_id", F.posexplode(F.arrays_zip(F.col("p").alias("text"), start.alias("o"))).alias("passage_id", "z"))
    return d.select("doc_id", "passage_id", F.col("z.o").alias("passage_offset"), F.col("z.text").alias("text"))


@query("SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS passages, CAST(sum(n_chars) AS BIGINT) AS characters FROM documents")
def collection_counts(spark, sf_dir):
    p = _passages(spark, sf_dir)
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), (F.max(F.col("passage_offset") + F.length("text"))).alias("c")).agg(F.count("*").alias("documents"), F.sum("n").alias("passages"), F.sum("c").alias("characters"))


@query(
    """WITH c AS (SELECT p_brand AS id, 'label ' || p_brand AS label, list_sort(list(DISTINCT p_name)) AS syn, dense_rank() OVER (ORDER BY p_brand) AS line FROM part GROUP BY p_brand),
  f AS (SELECT id, label, line, unnest(list_concat([label], syn)) AS raw_name, unnest(range(0, len(syn) + 1)) AS pos FROM c)
  SELECT CAST(line * 65536 + pos AS BIGINT) AS term_idx, """
    + _norm_sql("raw_name")
    + """ AS name, raw_name, id AS identifier, label AS preferred_label, pos = 0 AS is_preferred FROM f"""
)
def ontology_terms(spark, sf_dir):
    return R.ontology_terms(_concept_rows(spark, sf_dir)).drop("namespace")


def _concept_rows(spark, sf_dir):
    c = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("norm_concept_id")).agg(F.array_sort(F.collect_set("p_name")).alias("synonyms"))
    w = Window.orderBy("norm_concept_id")  # one row a brand
    return c.select("norm_concept_id", F.concat(F.lit("label "), "norm_concept_id").alias("norm_preferred_label"), "synonyms", F.lit("cell").alias("namespace"), F.dense_rank().over(w).cast("long").alias("line"))


@query(
    """SELECT p_brand AS identifier, 'label ' || p_brand AS preferred_label, 'cell' AS namespace, CAST(count(DISTINCT p_name) AS BIGINT) AS n_synonyms,
  md5(array_to_string(list_sort(list_concat(['label ' || p_brand], list(DISTINCT p_name))), '|')) AS names FROM part GROUP BY p_brand"""
)
def concept_names(spark, sf_dir):
    m = R.concept_metadata(R.ontology_terms(_concept_rows(spark, sf_dir)))
    return m.select("identifier", "preferred_label", "namespace", F.size("synonyms").cast("long").alias("n_synonyms"), F.md5(F.array_join("names", "|")).alias("names"))


_ABBR = "(SELECT upper(left(p_name, 1)) || upper(left(regexp_extract(p_name, ' (.*)$', 1), 1)) || CASE WHEN p_size % 2 = 0 THEN '-' || p_size ELSE '' END AS s, p_type || ';' || p_brand AS i, p_partkey AS line_no FROM part)"


def _abbreviations(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    s = F.concat(F.upper(F.substring("p_name", 1, 1)), F.upper(F.substring(F.regexp_extract("p_name", " (.*)$", 1), 1, 1)), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise(F.lit("")))
    return A.lookup(p.select(s.alias("short_form"), F.concat_ws(";", "p_type", "p_brand").alias("identifier"), F.col("p_partkey").alias("line_no")))


_ABBR_KEYS = f"(SELECT {_key_sql('s')} AS key, s, split_part(i, ';', 1) AS id, line_no FROM {_ABBR})"


@query(f"SELECT key, arg_max(s, (length(s), -line_no)) AS short_form, arg_min(id, line_no) AS identifier FROM {_ABBR_KEYS} GROUP BY key HAVING count(DISTINCT id) = 1")
def abbreviation_direct(spark, sf_dir):
    return A.direct(_abbreviations(spark, sf_dir))


@query(f"SELECT key, array_to_string(list_sort(list(DISTINCT id)), '|') AS identifiers FROM {_ABBR_KEYS} GROUP BY key HAVING count(DISTINCT id) > 1")
def abbreviation_ambiguous(spark, sf_dir):
    return A.ambiguous(_abbreviations(spark, sf_dir)).select("key", F.array_join("identifiers", "|").alias("identifiers"))


@query(
    f"""WITH k AS (SELECT key, count(DISTINCT id) AS n, arg_min(id, line_no) AS identifier FROM {_ABBR_KEYS} GROUP BY key),
  m AS (SELECT CAST(o_custkey AS VARCHAR) AS document_key, upper(left(o_orderpriority, 1)) || upper(substr(o_orderpriority, 3, 1)) AS short, chr(CAST(65 + o_custkey % 26 AS INTEGER)) || chr(CAST(65 + o_orderkey % 26 AS INTEGER)) || CASE WHEN o_orderkey % 3 = 0 THEN 's' ELSE '' END AS mention FROM orders),
  l AS (SELECT CAST(o_custkey AS VARCHAR) AS document_key, chr(CAST(65 + o_custkey % 26 AS INTEGER)) || chr(CAST(65 + o_orderkey % 26 AS INTEGER)) AS short_key, max('long ' || o_orderpriority) AS long_form FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
  SELECT d.document_key, d.mention AS mention_text, CASE WHEN k.n = 1 THEN 'direct' WHEN l.long_form IS NOT NULL THEN 'ambiguous_long_form' WHEN k.n > 1 THEN 'ambiguous_unresolved' END AS resolution, l.long_form AS expanded_long_form
  FROM (SELECT DISTINCT document_key, mention FROM m) d LEFT JOIN k ON k.key = d.mention LEFT JOIN l ON k.n > 1 AND l.document_key = d.document_key AND l.short_key = d.mention"""
)
def abbreviation_cascade(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    two = F.concat(F.char(65 + F.col("o_custkey") % 26), F.char(65 + F.col("o_orderkey") % 26))
    key = F.col("o_custkey").cast("string")
    m = o.select(key.alias("document_key"), F.concat(two, F.when(F.col("o_orderkey") % 3 == 0, F.lit("s")).otherwise(F.lit(""))).alias("mention_text"))
    forms = o.filter("o_orderstatus = 'F'").groupBy(key.alias("document_key"), two.alias("short_key")).agg(F.max(F.concat(F.lit("long "), "o_orderpriority")).alias("long_form"))
    table = _abbreviations(spark, sf_dir)
    matched = A.match_keys(m, table)
    keyed = m.distinct().join(matched, "mention_text", "left").join(A.keys(table).withColumnRenamed("key", "matched_key"), "matched_key", "left")
    hits = A.expand(keyed.filter("n_ids > 1"), forms).filter("long_form_method = 'exact_key'")
    r = keyed.join(hits, ["document_key", "matched_key"], "left")
    kind = F.when(F.col("n_ids") == 1, "direct").when(F.col("expanded_long_form").isNotNull(), "ambiguous_long_form").when(F.col("n_ids") > 1, "ambiguous_unresolved")
    return r.select("document_key", "mention_text", kind.alias("resolution"), "expanded_long_form")


# linking

_PAIRS = """(SELECT a.vec_id AS query_idx, b.vec_id AS term_idx, 'C' || b.label AS identifier, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) - 1 AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""
_HITS = f"(SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY round(score, 9) DESC, term_idx) - 1 AS rank FROM {_PAIRS} QUALIFY rank < 20)"
_BEST = f"(SELECT query_idx, identifier, max(score) AS embedding_score, min(rank) AS r, arg_min(term_idx, rank) AS term_idx FROM {_HITS} GROUP BY query_idx, identifier)"


def _embedded(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("name "), (F.col("vec_id") % 7).cast("string"), F.lit(" of C"), F.col("label").cast("string"))
    terms = e.select(F.col("vec_id").alias("term_idx"), F.col("embedding").alias("vector"), F.concat(F.lit("C"), F.col("label").cast("string")).alias("identifier"), name.alias("raw_name"), F.concat(F.lit("label C"), F.col("label").cast("string")).alias("preferred_label"), (F.col("vec_id") % 7 == 0).alias("is_preferred"))
    return e.select(F.col("vec_id").alias("query_idx"), F.col("embedding").alias("vector")), terms


def _hits(spark, sf_dir):
    queries, terms = _embedded(spark, sf_dir)
    found = linking.retrieve(queries, terms, 21).filter("query_idx <> term_idx")  # a vector isn't its own neighbour
    w = Window.partitionBy("query_idx").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(w) - 1).filter("rank < 20"), terms


@query(f"SELECT query_idx, CAST(rank AS INTEGER) AS rank, term_idx, identifier, round(score, 6) AS score FROM {_HITS}")
def cosine_topk(spark, sf_dir):
    hits, terms = _hits(spark, sf_dir)
    return hits.join(terms.select("term_idx", "identifier"), "term_idx").select("query_idx", "rank", "term_idx", "identifier", F.round("score", 6).alias("score"))


@query(f"SELECT query_idx, identifier, round(embedding_score, 6) AS embedding_score FROM {_BEST} QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY r) <= 5")
def best_alias_per_concept(spark, sf_dir):
    hits, terms = _hits(spark, sf_dir)
    return linking.best_per_concept(hits, terms, 5).select("query_idx", "identifier", F.round("embedding_score", 6).alias("embedding_score"))


@query(f"SELECT query_idx, identifier, round(embedding_score, 6) AS embedding_score FROM {_BEST} QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY r) = 1")
def link_concept(spark, sf_dir):
    hits, terms = _hits(spark, sf_dir)
    return linking.best_per_concept(hits, terms, 1).select("query_idx", "identifier", F.round("embedding_score", 6).alias("embedding_score"))


_QT = "'name ' || (query_idx % 5) || ' of C' || (query_idx % 10)"
_NO_SEQUENCE = linking.WEIGHTS | {"sequence": 0.0}


@query(
    f"""WITH b AS (SELECT *, term_idx % 7 = 0 AS pref FROM {_BEST} QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY r) <= 5),
  names AS (SELECT DISTINCT 'C' || label AS identifier, unnest(['name ' || (vec_id % 7) || ' of C' || label, 'label C' || label]) AS name FROM embeddings),
  f AS (SELECT b.query_idx, b.identifier, b.embedding_score, b.pref, b.r, max(CASE WHEN {_fold_sql('q')} = {_fold_sql('name')} THEN 1.0 ELSE 0.0 END) AS ex, max({_jaccard_sql('q', 'name')}) AS ov, max({_jaccard_sql('q', "'label ' || identifier")}) AS po
        FROM (SELECT *, {_QT} AS q FROM b) b JOIN names USING (identifier) GROUP BY ALL)
  SELECT query_idx, identifier, round(s, 6) AS final_score, CAST(row_number() OVER (PARTITION BY query_idx ORDER BY s DESC, embedding_score DESC, r) - 1 AS INTEGER) AS rank
  FROM (SELECT *, embedding_score + 0.35 * ex + 0.2 * ov + 0.15 * po + CASE WHEN pref THEN 0.03 ELSE 0 END AS s FROM f)"""
)
def rerank_features(spark, sf_dir):
    """All features but the sequence ratio, which SQL lacks."""
    return _reranked(spark, sf_dir, _NO_SEQUENCE).select("query_idx", "identifier", F.round("final_score", 6).alias("final_score"), "rank")


def _reranked(spark, sf_dir, weights):
    hits, terms = _hits(spark, sf_dir)
    text = F.concat(F.lit("name "), (F.col("query_idx") % 5).cast("string"), F.lit(" of C"), (F.col("query_idx") % 10).cast("string"))
    queries = _embedded(spark, sf_dir)[0].select("query_idx", text.alias("query_text"))
    concepts = terms.groupBy("identifier").agg(F.array_distinct(F.flatten(F.collect_set(F.array("raw_name", "preferred_label")))).alias("names"), F.min("preferred_label").alias("preferred_label"))
    return linking.rerank(linking.best_per_concept(hits, terms, 5), queries, concepts, weights)


@query()
def rerank_full(spark, sf_dir):
    """With the sequence ratio; tests hold it against a plain implementation."""
    return _reranked(spark, sf_dir, linking.WEIGHTS).select("query_idx", "identifier", "rank", "final_score", "sequence_ratio")


@query(f"SELECT token, CAST(min(doc_id) AS BIGINT) AS first_doc, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest({_tokens_sql('text')}) AS token FROM documents) GROUP BY token")
def mention_dedupe(spark, sf_dir):
    m = _t(spark, sf_dir, "documents").select("doc_id", F.explode(X.split_tokens("text")).alias("token"))
    return m.groupBy("token").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey, p_brand AS cl_label FROM (SELECT l_orderkey, arg_min(l_linenumber, (l_linenumber, l_partkey)) AS l_linenumber, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey) LEFT JOIN part ON p_partkey = l_partkey")
def first_seen_join_back(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    first = filters.first_seen(li, ["l_orderkey"], ["l_linenumber", "l_partkey"])
    return first.join(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("cl_label")), "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "cl_label")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS example_idx FROM orders")
def example_numbers(spark, sf_dir):
    return filters.numbered(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("example_idx").cast("long").alias("example_idx"))


# tokens and spans


@query(f"""SELECT doc_id, CAST(CASE WHEN n <= 128 THEN 1 ELSE CAST(ceil((n - 128) / 96.0) AS BIGINT) + 1 END AS BIGINT) AS n_windows, CAST(CASE WHEN n <= 128 THEN n ELSE n - 96 * CAST(ceil((n - 128) / 96.0) AS BIGINT) END AS BIGINT) AS last_size FROM (SELECT doc_id, len({_tokens_sql('text')}) AS n FROM documents)""")
def token_windows(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", D.windows(X.split_tokens("text"), 128, 32).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_windows"), F.size(F.try_element_at("w", F.lit(-1))).cast("long").alias("last_size"))


_SCORES = "[CAST((pos * 7 + w * 13 + j * 17 + conv_id) % 11 AS DOUBLE) for j in [0, 1, 2]]"


@query(
    f"""WITH t AS (SELECT conv_id, turn, unnest(range(0, len(x))) AS pos FROM (SELECT conv_id, turn, {_tokens_sql('text')} AS x FROM conversations)),
  w AS (SELECT conv_id, turn, pos, unnest(range(CAST(greatest(0, ceil((pos - 63) / 48.0)) AS BIGINT), pos // 48 + 1)) AS w FROM t),
  s AS (SELECT conv_id, turn, pos, j, avg(CAST((pos * 7 + w * 13 + j * 17 + conv_id) % 11 AS DOUBLE)) AS score FROM w, (SELECT unnest([0, 1, 2]) AS j) GROUP BY ALL),
  b AS (SELECT conv_id, turn, pos, arg_max(j, (score, -j)) AS label FROM s GROUP BY ALL)
  SELECT conv_id, turn, CAST(count(*) AS BIGINT) AS n_tokens, CAST(sum(label) AS BIGINT) AS labels FROM b GROUP BY ALL"""
)
def window_means(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(X.split_tokens("text")).alias("start", "tok"))
    low = F.greatest(F.lit(0), F.ceil((F.col("start") - 63) / 48.0).cast("int"))
    c = c.withColumn("w", F.explode(F.sequence(low, F.floor(F.col("start") / 48).cast("int"))))
    score = F.array(*[((F.col("start") * 7 + F.col("w") * 13 + j * 17 + F.col("conv_id")) % 11).cast("double") for j in range(3)])
    keys = ["conv_id", "turn", "start"]
    best = D.best_label(D.mean_scores(c.select(*keys, score.alias("scores")), keys), keys)
    return best.groupBy("conv_id", "turn").agg(F.count("*").alias("n_tokens"), F.sum("label_id").cast("long").alias("labels"))


_EVENT_TAG = "CASE event_type WHEN 'error' THEN 'O' WHEN 'click' THEN 'B-x' WHEN 'view' THEN 'I-x' WHEN 'signup' THEN 'I-y' ELSE 'B-y' END"


@query(
    f"""WITH t AS (SELECT user_id, event_id, {_EVENT_TAG} AS tag FROM events), l AS (SELECT *, CASE WHEN tag = 'O' THEN NULL ELSE substr(tag, 3) END AS label FROM t),
  n AS (SELECT *, label IS NOT NULL AND (tag LIKE 'B-%' OR lag(label) OVER w IS DISTINCT FROM label) AS fresh FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  i AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM n)
  SELECT user_id, label, CAST(min(event_id) AS BIGINT) AS first_event, CAST(max(event_id) AS BIGINT) AS last_event FROM i WHERE label IS NOT NULL GROUP BY user_id, island, label"""
)
def bio_decode(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("end"), F.expr(_EVENT_TAG).alias("tag"))
    return D.decode(e, ["user_id"]).select("user_id", "label", F.col("start").alias("first_event"), (F.col("end") - 1).alias("last_event"))


_LINE = "(SELECT DISTINCT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query(
    f"""WITH l AS {_LINE}, t AS (SELECT l_orderkey, l_linenumber * 10 AS s, l_linenumber * 10 + 10 AS e FROM l),
  n AS (SELECT l_orderkey, l_linenumber AS ent, l_linenumber * 10 - CAST(q AS INTEGER) % 7 AS s2, l_linenumber * 10 - CAST(q AS INTEGER) % 7 + CAST(q AS INTEGER) % 25 AS e2, f FROM l),
  o AS (SELECT t.l_orderkey, s, e, max(ent) AS ent, arg_max(f, ent) AS f FROM t JOIN n ON t.l_orderkey = n.l_orderkey AND s < e2 AND s2 < e GROUP BY ALL),
  g AS (SELECT t.l_orderkey, t.s, ent, f, lag(ent) OVER (PARTITION BY t.l_orderkey ORDER BY t.s) AS before FROM t LEFT JOIN o ON t.l_orderkey = o.l_orderkey AND t.s = o.s)
  SELECT l_orderkey, CAST(s AS INTEGER) AS start, CASE WHEN ent IS NULL THEN 'O' WHEN before = ent THEN 'I-' || f ELSE 'B-' || f END AS tag FROM g"""
)
def bio_encode(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("f"))
    tok = li.select("l_orderkey", (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 10).alias("end"))
    s = F.col("l_linenumber") * 10 - F.col("q") % 7
    ent = li.select("l_orderkey", F.col("l_linenumber").alias("ent_idx"), s.alias("start"), (s + F.col("q") % 25).alias("end"), F.col("f").alias("label"))
    tagged = D.encode(tok, D.owners(tok, ent, ["l_orderkey"]), ["l_orderkey"])
    return tagged.select("l_orderkey", F.col("start").cast("int").alias("start"), "tag")


@query("SELECT CAST(0 AS INTEGER) AS label_id, 'O' AS tag UNION ALL SELECT CAST(2 * (dense_rank() OVER (ORDER BY event_type) - 1) + k AS INTEGER), CASE k WHEN 1 THEN 'B-' ELSE 'I-' END || event_type FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest([1, 2]) AS k)")
def label_schema(spark, sf_dir):
    return D.label_schema(_t(spark, sf_dir, "events"), "event_type")


_SPANS = "(SELECT l_orderkey, l_linenumber AS idx, datediff('day', TIMESTAMP '1990-01-01', l_shipdate) AS s, datediff('day', TIMESTAMP '1990-01-01', l_shipdate) + CAST(l_quantity AS INTEGER) * 20 AS e FROM lineitem)"


@query(f"SELECT a.l_orderkey, a.idx, b.idx AS other_idx FROM {_SPANS} a JOIN {_SPANS} b ON a.l_orderkey = b.l_orderkey AND a.idx < b.idx AND a.s < b.e AND b.s < a.e")
def overlap_pairs(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    s = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date"))
    spans = li.select("l_orderkey", F.col("l_linenumber").alias("idx"), s.alias("start"), (s + F.col("l_quantity").cast("int") * 20).alias("end"))
    return D.overlapping(spans, ["l_orderkey"])


@query(
    """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS passage_id FROM documents),
  o AS (SELECT doc_id, passage_id, length(p) AS n, coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY passage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p),
  e AS (SELECT doc_id, unnest(range(0, n_chars, 97)) AS s FROM documents)
  SELECT o.doc_id, CAST(passage_id AS INTEGER) AS passage_id, CAST(count(*) AS BIGINT) AS n FROM e JOIN o ON e.doc_id = o.doc_id AND o.s <= e.s AND e.s + 20 <= o.s + o.n GROUP BY ALL"""
)
def passage_containment(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").filter("n_chars > 0")
    ents = d.select(F.col("doc_id").alias("document_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") - 1, F.lit(97).cast("long"))).alias("start")).withColumn("end", F.col("start") + 20)
    p = _passages(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
    return D.contained(ents, p).groupBy(F.col("document_id").alias("doc_id"), "passage_id").agg(F.count("*").alias("n"))


@query(r"""SELECT conv_id, turn, CAST(count(*) AS BIGINT) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\p{L}\p{N}_\s\p{Z}]|_')) AS t FROM conversations) WHERE t IN ('the', 'of', 'and', 'de', 'la', 'der') GROUP BY ALL""")
def gazetteer_tag(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    tagger = GazetteerTagger(["the", "of", "and", "de", "la", "der"])
    keys = ["conv_id", "turn"]
    found = D.decode(tags(tag(c, tagger, 64, 16), tagger, keys), keys)
    return found.groupBy(*keys).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, CAST(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS BIGINT) AS gap FROM events")
def next_offsets(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return _t(spark, sf_dir, "events").select("user_id", "event_id", (F.lead("event_id").over(w) - F.col("event_id")).alias("gap"))


# evaluation

_GOLD = "(SELECT l_returnflag AS f, l_suppkey AS a, CAST(l_quantity AS INTEGER) AS b FROM lineitem)"
_PRED = "(SELECT l_returnflag AS f, l_suppkey AS a, CAST(l_quantity AS INTEGER) + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS b FROM lineitem WHERE l_linenumber <> 2)"
_RATIO_SQL = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1"


_EXACT_SQL = f"""(WITH g AS (SELECT f, a, b, count(*) AS n FROM {_GOLD} GROUP BY ALL), p AS (SELECT f, a, b, count(*) AS n FROM {_PRED} GROUP BY ALL),
  j AS (SELECT f, coalesce(g.n, 0) AS g, coalesce(p.n, 0) AS p FROM g FULL JOIN p USING (f, a, b)),
  m AS (SELECT f, CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(p) - sum(least(g, p)) AS BIGINT) AS fp, CAST(sum(g) - sum(least(g, p)) AS BIGINT) AS fn FROM j GROUP BY f)
  SELECT f AS dataset, tp, fp, fn, {_RATIO_SQL} FROM m)"""


def _exact(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    b = F.col("l_quantity").cast("int")
    gold = li.select(F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("a"), b.alias("b"))
    pred = li.filter("l_linenumber <> 2").select(F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("a"), (b + F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0)).alias("b"))
    return E.exact(gold, pred, ["a", "b"], ["dataset"])


@query(f"SELECT dataset, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM {_EXACT_SQL}")
def eval_exact(spark, sf_dir):
    r = _exact(spark, sf_dir)
    return r.select("dataset", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"SELECT dataset, tp, round(f1, 9) AS f1 FROM {_EXACT_SQL} UNION ALL SELECT 'Macro average', NULL, round(avg(f1), 9) FROM {_EXACT_SQL}")
def macro_average(spark, sf_dir):
    rows = _exact(spark, sf_dir).withColumns({"system": F.lit("s"), "task": F.lit("NER"), "criterion": F.lit("exact_span")})
    return E.with_macro(rows).select("dataset", "tp", F.round("f1", 9).alias("f1"))


@query(f"SELECT 's' AS system, round(max(f1) FILTER (dataset = 'A'), 9) AS \"A\", round(max(f1) FILTER (dataset = 'N'), 9) AS \"N\", round(max(f1) FILTER (dataset = 'R'), 9) AS \"R\" FROM {_EXACT_SQL}")
def metrics_pivot(spark, sf_dir):
    rows = _exact(spark, sf_dir).select(F.lit("s").alias("system"), "dataset", F.round("f1", 9).alias("f1"))
    return E.pivoted(rows, ["A", "N", "R"])


@query()
def eval_relaxed(spark, sf_dir):
    """Greedy matching depends on order; held against a plain implementation in the tests."""
    li = _t(spark, sf_dir, "lineitem").withColumn("s", F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")))
    base = [F.col("l_returnflag").alias("dataset"), F.col("l_orderkey").cast("string").alias("document_id"), F.lit("p").alias("passage_key"), F.lit(0).alias("passage_offset"), F.lit("").alias("passage_text")]
    loc = lambda a: F.array(F.struct(a.alias("offset"), (F.col("l_quantity").cast("int") + 1).alias("length")))
    idx = (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("idx")
    gold = li.select(*base, loc(F.col("s")).alias("locations"), F.lit("x").alias("text"), idx)
    pred = li.select(*base, loc(F.col("s") + F.pmod("l_partkey", F.lit(60)).cast("int") - 30).alias("locations"), F.when(F.col("l_suppkey") % 9 == 0, "Cell.").otherwise("y").alias("text"), idx)
    return E.relaxed(gold, pred, ["dataset"])


_ANN = """(SELECT CAST(l_orderkey AS VARCHAR) AS passage_key, l_returnflag AS entity_type, l_linenumber, l_suppkey, l_partkey,
  CASE WHEN l_partkey % 6 = 0 THEN 'None' WHEN l_partkey % 6 = 1 THEN 'CL:' || (l_suppkey % 9) || ' (skos:related)' WHEN l_partkey % 6 = 2 THEN 'CL:' || (l_suppkey % 9) || ';CL:3' ELSE 'CL:' || (l_suppkey % 9) END AS identifier,
  l_linenumber * 100 AS o, CAST(l_quantity AS INTEGER) AS n FROM lineitem)"""


def _annotations(spark, sf_dir):
    k = (F.col("l_suppkey") % 9).cast("string")
    i = F.when(F.col("l_partkey") % 6 == 0, "None").when(F.col("l_partkey") % 6 == 1, F.concat(F.lit("CL:"), k, F.lit(" (skos:related)"))).when(F.col("l_partkey") % 6 == 2, F.concat(F.lit("CL:"), k, F.lit(";CL:3"))).otherwise(F.concat(F.lit("CL:"), k))
    loc = F.array(F.struct((F.col("l_linenumber") * 100).alias("offset"), F.col("l_quantity").cast("int").alias("length")))
    a = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("passage_key"), F.col("l_returnflag").alias("entity_type"), i.alias("identifier"), loc.alias("locations"),
        F.col("l_orderkey").alias("doc_idx"), F.col("l_linenumber").alias("passage_id"), (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("ann_idx"), "l_suppkey", "l_partkey",
    )
    ranked = a.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(2))))
    pid = F.when((F.col("l_partkey") + F.col("rank")) % 7 == 0, "-").otherwise(F.concat(F.lit("CL:"), ((F.col("l_suppkey") + F.col("rank") * F.col("l_partkey")) % 9).cast("string")))
    score = F.when((F.col("l_suppkey") + F.col("rank")) % 5 == 0, "-0.5").when((F.col("l_suppkey") + F.col("rank")) % 5 == 1, "bad").otherwise("0.25")
    return a, ranked.withColumns({"pred_id": pid, "score_text": score})


def _topk_sql(pass_filter: str, ref_ids: str, types: str, e2e: bool) -> str:
    loc = ", o, n" if e2e else ""
    gate = "" if e2e else f"AND {pass_filter}"
    return f"""(WITH a AS (SELECT * FROM {_ANN} WHERE entity_type IN ({types})),
  ref AS (SELECT DISTINCT passage_key, entity_type{loc}, unnest({ref_ids}) AS id FROM a WHERE {pass_filter}),
  r AS (SELECT *, CASE WHEN (l_partkey + k) % 7 = 0 THEN '-' ELSE 'CL:' || ((l_suppkey + k * l_partkey) % 9) END AS id, (l_suppkey + k) % 5 AS z FROM a, (SELECT unnest([0, 1, 2]) AS k) WHERE true {gate}),
  s AS (SELECT *, row_number() OVER (PARTITION BY passage_key, l_linenumber, l_partkey, l_suppkey ORDER BY k) AS place FROM r WHERE id <> '-' AND z NOT IN (0, 1)),
  p AS (SELECT passage_key, entity_type{loc}, id, min(place) AS place FROM s GROUP BY ALL),
  j AS (SELECT place, r.id IS NOT NULL AS in_ref FROM ref r FULL JOIN p ON r.passage_key = p.passage_key AND r.entity_type = p.entity_type AND r.id = p.id {'AND r.o = p.o AND r.n = p.n' if e2e else ''}),
  m AS (SELECT CAST(topk AS INTEGER) AS topk, count(*) FILTER (place <= topk AND in_ref) AS num, count(*) FILTER (place <= topk) AS pd, count(*) FILTER (in_ref) AS rd FROM j, (SELECT unnest([1, 5, 10]) AS topk) GROUP BY topk)
  SELECT topk, CAST(num AS BIGINT) AS numerator, CAST(pd AS BIGINT) AS precision_denominator, CAST(rd AS BIGINT) AS recall_denominator, round(CASE WHEN pd + rd > 0 THEN 2 * num / (pd + rd) ELSE 0 END, 9) AS f1 FROM m)"""


_ONE = "[trim(replace(identifier, '(skos:related)', ''))]"
_SINGLE = "NOT contains(lower(identifier), 'none') AND NOT contains(identifier, ';')"
_ALL = "list_filter(list_transform(string_split(trim(replace(identifier, '(skos:related)', '')), ';'), lambda x: trim(x)), lambda x: lower(x) <> 'none')"
_TYPES = "'A', 'N', 'R'"


def _scores(df):
    return df.select(*[c for c in ("iterator", "entity_types") if c in df.columns], "topk", "numerator", "precision_denominator", "recall_denominator", F.round("f1", 9).alias("f1"))


@query(f"SELECT * FROM {_topk_sql(_SINGLE, _ONE, _TYPES, False)}")
def eval_nen(spark, sf_dir):
    return _scores(E.normalisation(*_annotations(spark, sf_dir), "single_id", ["A", "N", "R"]))


@query(f"SELECT * FROM {_topk_sql(_SINGLE, _ONE, _TYPES, True)}")
def eval_end_to_end(spark, sf_dir):
    return _scores(E.normalisation(*_annotations(spark, sf_dir), "single_id", ["A", "N", "R"], end_to_end=True))


_EXACT_IDS = _SINGLE + " AND NOT contains(identifier, 'skos:related')"
_ANY = "NOT identifier = 'None'"


@query(
    " UNION ALL ".join(
        f"SELECT '{i}' AS iterator, '{'+'.join(t)}' AS entity_types, * FROM {_topk_sql(w, ids, ', '.join(repr(x) for x in t), False)}"
        for i, w, ids in (("exact_ids", _EXACT_IDS, _ONE), ("all_ids", _ANY, _ALL))
        for t in (("A",), ("N",), ("A", "N"), ("R",))
    )
)
def eval_grid(spark, sf_dir):
    gold, ranked = _annotations(spark, sf_dir)
    names = {"cell_phenotype": "A", "cell_hetero": "N", "cell_type": "R"}
    return _scores(E.grid(gold, ranked, [(i, [names[x] for x in t]) for i, t in E.GRID]))


@query("SELECT CAST(count(*) AS BIGINT) AS n_tokens, round(avg(CASE WHEN (n_chars > 100) = (quality = 1) THEN 1.0 ELSE 0.0 END), 9) AS token_accuracy FROM labels JOIN documents USING (doc_id)")
def label_accuracy(spark, sf_dir):
    j = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    r = j.select(F.col("quality").cast("string").alias("gold"), F.when(F.col("n_chars") > 100, "1").otherwise("0").alias("predicted"))
    return D.token_metrics(r).select("n_tokens", F.round("token_accuracy", 9).alias("token_accuracy"))


@query(
    """SELECT CAST((SELECT count(*) FROM (SELECT DISTINCT o_custkey % 100, o_orderpriority FROM orders INTERSECT SELECT DISTINCT c_custkey % 100, '2-HIGH' FROM customer)) AS BIGINT) AS matched,
  CAST((SELECT count(*) FROM (SELECT o_custkey % 100, o_orderpriority FROM orders UNION SELECT c_custkey % 100, '2-HIGH' FROM customer)) AS BIGINT) AS either,
  CAST((SELECT count(*) FROM (SELECT o_custkey % 100, o_orderpriority FROM orders EXCEPT SELECT c_custkey % 100, '2-HIGH' FROM customer)) AS BIGINT) AS missed"""
)
def tuple_sets(spark, sf_dir):
    a = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("k"), F.col("o_orderpriority").alias("v")).distinct().withColumn("a", F.lit(1))
    b = _t(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("k"), F.lit("2-HIGH").alias("v")).distinct().withColumn("b", F.lit(1))
    j = a.unionByName(b, allowMissingColumns=True).groupBy("k", "v").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return j.agg(F.count(F.expr("case when a = 1 and b = 1 then 1 end")).alias("matched"), F.count("*").alias("either"), F.count(F.expr("case when a = 1 and b is null then 1 end")).alias("missed"))


# resources and pairs


@query("SELECT 'R' || a.n_regionkey AS identifier, a.n_name AS text_a, b.n_name AS text_b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def alias_pairs(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("identifier"), F.col("n_name").alias("raw_name"))
    return O.alias_pairs(n)


_PAIR_ROWS = "(SELECT o_orderkey AS line, 'c' || (o_custkey % 40) AS a, 'c' || (o_orderkey % 40) AS b FROM orders)"


@query(f"SELECT arg_min(a, line) AS text_a, arg_min(b, line) AS text_b, CAST(min(line) AS BIGINT) AS line FROM {_PAIR_ROWS} WHERE a <> b GROUP BY least(a, b), greatest(a, b)")
def pair_dedupe(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    c = lambda k: F.concat(F.lit("c"), (F.col(k) % 40).cast("string"))
    return O.dedupe_pairs(o.select(F.col("o_orderkey").alias("line"), c("o_custkey").alias("text_a"), c("o_orderkey").alias("text_b")))


@query(
    """WITH c AS (SELECT p_brand AS identifier, min(p_name) AS name, list_sort(list(DISTINCT p_name) FILTER (p_size < 10)) AS syn FROM part GROUP BY p_brand),
  n AS (SELECT identifier, list_sort(list(DISTINCT p_name)) AS extra FROM c JOIN part ON p_brand = identifier WHERE p_name <> name AND NOT list_contains(coalesce(syn, []), p_name) GROUP BY identifier)
  SELECT c.identifier, CAST(len(coalesce(extra, [])) AS INTEGER) AS n_added, md5(array_to_string(list_sort(list_concat(coalesce(syn, []), coalesce(extra, []))), '|')) AS synonyms FROM c LEFT JOIN n USING (identifier)"""
)
def merge_aliases(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    c = p.groupBy(F.col("p_brand").alias("identifier")).agg(F.min("p_name").alias("name"), F.array_sort(F.collect_set(F.when(F.col("p_size") < 10, F.col("p_name")))).alias("synonyms"))
    m = O.merge_aliases(c, p.select(F.col("p_brand").alias("identifier"), F.col("p_name").alias("alias")))
    return m.select("identifier", "n_added", F.md5(F.array_join("synonyms", "|")).alias("synonyms"))


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new=' || user_id || '|k=' || json_extract_string(props, '$.k') ELSE 'k=' || user_id END AS infons,
  json_extract_string(props, '$.k') AS by_suffix FROM events"""
)
def infon_upsert(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("i", F.array(F.struct(F.lit("k").alias("key"), F.get_json_object("props", "$.k").alias("value"))))
    u = F.col("user_id").cast("string")
    out = F.when(F.col("event_id") % 2 == 0, I.upsert("i", [("new", u)])).otherwise(I.upsert("i", [("k", u)]))
    return e.select("event_id", F.array_join(F.transform(out, lambda x: F.concat_ws("=", x["key"], x["value"])), "|").alias("infons"), I.by_suffix("i", "k").alias("by_suffix"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs, regexp_extract(html, 'lang="((?:[^"\\]|\\.)*)"', 1) AS lang FROM pages""")
def html_fields(spark, sf_dir):
    h = _t(spark, sf_dir, "pages")
    return h.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long").alias("n_paragraphs"), X.quoted(F.regexp_extract("html", r'lang=("(?:[^"\\]|\\.)*")', 1)).alias("lang"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def turn_concat(spark, sf_dir):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(parts, "\n")).alias("digest"), F.count("*").alias("n"))


@query("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\"' || CASE WHEN n_regionkey > 0 THEN ',\"r\":' || n_regionkey ELSE '' END || '}' AS value FROM nation")
def compact_json(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("r"), F.array().cast("array<string>").alias("none"))
    return n.select("n_nationkey", filters.compact(n, ["n_name", "r", "none"]).alias("value"))


@query("SELECT c_custkey, CAST(c_custkey + 5 AS INTEGER) AS \"end\", coalesce(c_mktsegment, 'cell_type') AS entity_type FROM customer")
def coerced_mentions(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.col("c_name").alias("text"), F.col("c_custkey").alias("start"), F.lit(5).alias("length"), F.col("c_mktsegment").alias("type"))
    return filters.coerce_mentions(c).select(F.col("document_id").cast("long").alias("c_custkey"), "end", "entity_type")


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal >= 0 AND c_custkey % 2 = 0")
def score_threshold(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").withColumn("score_text", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal").cast("string")).otherwise("n/a"))
    return filters.scores_over(c, 0.0).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
