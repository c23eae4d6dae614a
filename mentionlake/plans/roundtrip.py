"""Registered queries that write files out of the driver tables and read them back through the real sources and sinks.

A collection holds a document for each conversation and a passage for each turn; pairs of documents share an id, some
passages are empty or not annotatable, and annotations have one location, two or none. Every query has its SQL twin,
written from the tables and not from the files.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionlake import schemas
from mentionlake.functions import infons as I
from mentionlake.functions import text as X
from mentionlake.operators import abbreviations as A
from mentionlake.operators import decode as D
from mentionlake.operators import evaluate as E
from mentionlake.operators import filters
from mentionlake.operators import ontology as O
from mentionlake.sources import bioc, writers, workspace
from mentionlake.sources import resources as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: dict[tuple, str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """A file or folder that is written once per application and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = os.path.join(workspace.folder(spark, "fixture"), name)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


# documents

_BASE = r"""WITH c AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 5 = 4 THEN '' ELSE text END AS t FROM conversations),
  p AS (SELECT *, 'd' || (conv_id - conv_id % 2) AS document_id, CAST(coalesce(sum(length(t) + 1) OVER w, 0) AS INTEGER) AS o, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pid,
        regexp_extract(t, '^\S+') AS tok, (conv_id + turn) % 11 <> 3 AS annotatable FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  a AS (SELECT *, 'a' || turn AS ann_id, 0 AS ann_idx, CASE turn % 3 WHEN 0 THEN 'cell_type' WHEN 1 THEN 'cell_vague' ELSE '' END AS type, tok AS ann_text FROM p WHERE tok <> ''),
  b AS (SELECT *, 'b' || turn AS ann_id, 1 AS ann_idx FROM p WHERE tok <> '')
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when((F.col("conv_id") + F.col("turn")) % 5 == 4, "").otherwise(F.col("text")).alias("t"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("o", F.coalesce(F.sum(F.length("t") + 1).over(w), F.lit(0))).withColumn("tok", F.regexp_extract("t", r"^\S+", 0))
    kv = lambda k, v: F.struct(F.lit(k).alias("_key"), (v if not isinstance(v, str) else F.lit(v)).cast("string").alias("_VALUE"))
    loc = lambda o, n: F.struct(n.cast("string").alias("_length"), o.cast("string").alias("_offset"))
    turn = F.col("turn")
    kind = F.when(turn % 3 == 0, "cell_type").when(turn % 3 == 1, "cell_vague").otherwise("")
    score = F.when(turn % 4 == 0, "0.5").when(turn % 4 == 1, "x").otherwise("1e-3")
    none = F.array().cast(f"array<{schemas.LOCATION}>")
    one = F.struct(
        F.concat(F.lit("a"), turn.cast("string")).alias("_id"), F.array(kv("type", kind), kv("label", "lab"), kv("identifier", F.concat(F.lit("CL:"), turn.cast("string"))), kv("score", score), kv("old_id_0", "x"), kv("old_id_1", "y")).alias("infon"),
        F.array(loc(F.col("o"), F.length("tok"))).alias("location"), F.col("tok").alias("text"),
    )
    two = F.struct(
        F.concat(F.lit("b"), turn.cast("string")).alias("_id"), F.array(kv("entity_type", "cell_hetero")).alias("infon"),
        F.when(turn % 2 == 0, none).otherwise(F.array(loc(F.col("o") + 4, F.lit(1)), loc(F.col("o") + 1, F.lit(2)))).alias("location"), F.lit("").alias("text"),
    )
    infon = F.array(kv("conv", F.col("conv_id")), kv("turn", turn), kv("type", F.col("role")), kv("annotatable", F.when((F.col("conv_id") + turn) % 11 == 3, "No").otherwise("yes")))
    anns = F.when(F.col("tok") != "", F.array(one.cast(schemas.ANNOTATION), two.cast(schemas.ANNOTATION))).otherwise(F.array().cast(f"array<{schemas.ANNOTATION}>"))
    passage = F.struct(infon.alias("infon"), F.col("o").cast("string").alias("offset"), F.col("t").alias("text"), anns.alias("annotation")).cast(schemas.PASSAGE)
    docs = c.select("conv_id", "turn", passage.alias("p")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "p"))), lambda x: x["p"]).alias("passage"))
    return docs.select(F.concat(F.lit("d"), (F.col("conv_id") - F.col("conv_id") % 2).cast("string")).alias("id"), F.array().cast(schemas.INFONS).alias("infon"), "passage")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _once(spark, sf_dir, "collection", lambda p: writers.write_xml(_documents(spark, sf_dir), p, head={"source": "driver", "key": "conversations"}, infons=[("made", "here & now")]))
    return bioc.read_xml(spark, path)


def _place(df: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds conv_id and turn of each row's passage."""
    at = bioc.passages(docs).select("source_path", "doc_idx", "passage_id", I.get("infons", "conv").cast("long").alias("conv_id"), I.get("infons", "turn").cast("int").alias("turn"))
    return df.join(at, ["source_path", "doc_idx", "passage_id"])


@query(_BASE + "SELECT conv_id, CAST(turn AS INTEGER) AS turn, document_id, pid AS passage_id, o AS passage_offset, md5(t) AS digest, role AS type FROM p")
def xml_passages(spark, sf_dir):
    p = bioc.passages(_docs(spark, sf_dir))
    return p.select(I.get("infons", "conv").cast("long").alias("conv_id"), I.get("infons", "turn").cast("int").alias("turn"), "document_id", "passage_id", "passage_offset", F.md5("text").alias("digest"), I.as_map("infons")["type"].alias("type"))


@query(_BASE + "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) - 1 AS BIGINT) AS last, CAST(count(*) AS BIGINT) AS numbers, CAST(sum(pid) AS BIGINT) AS passage_ids FROM p WHERE t <> ''")
def xml_record_ids(spark, sf_dir):
    """Empty passages have a passage number and no record number; record numbers have no gap."""
    p = bioc.nonempty_passages(_docs(spark, sf_dir))
    return p.agg(F.count("*").alias("n"), F.max("record_id").cast("long").alias("last"), F.countDistinct("record_id").alias("numbers"), F.sum("passage_id").alias("passage_ids"))


@query(
    _BASE
    + """SELECT conv_id, CAST(turn AS INTEGER) AS turn, ann_id, o AS start, CAST(o + length(tok) AS INTEGER) AS "end", CASE WHEN type = '' THEN 'lab' ELSE type END AS label, CASE turn % 4 WHEN 0 THEN 0.5 WHEN 1 THEN NULL ELSE 0.001 END::DOUBLE AS score FROM a
  UNION ALL SELECT conv_id, CAST(turn AS INTEGER), ann_id, CAST(CASE WHEN turn % 2 = 0 THEN o ELSE o + 4 END AS INTEGER), CAST(CASE WHEN turn % 2 = 0 THEN o ELSE o + 5 END AS INTEGER), '', NULL FROM b"""
)
def xml_annotations(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return _place(bioc.annotations(docs), docs).select("conv_id", "turn", "ann_id", "start", "end", "label", "score")


@query(
    _BASE
    + """SELECT conv_id, CAST(turn AS INTEGER) AS turn, ann_id, 0 AS start, CAST(length(tok) AS INTEGER) AS "end", CASE WHEN type = '' THEN 'lab' ELSE type END AS label, tok AS text FROM a
  UNION ALL SELECT conv_id, CAST(turn AS INTEGER), ann_id || ':' || i, s, s + n, 'Unknown', substr(t, s + 1, n) FROM b, (VALUES (0, 4, 1), (1, 1, 2)) l(i, s, n) WHERE turn % 2 = 1 AND s + n <= length(t)"""
)
def xml_entities(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return _place(bioc.entities(docs), docs).select("conv_id", "turn", "ann_id", "start", "end", "label", "text")


@query(
    _BASE
    + """SELECT conv_id, CAST(turn AS INTEGER) AS turn, 1 AS n_locations, document_id || ':' || o AS passage_key, tok AS text, 'cell_type' AS entity_type FROM a WHERE type = 'cell_type'
  UNION ALL SELECT conv_id, CAST(turn AS INTEGER), 2, document_id || ':' || o, '', 'cell_hetero' FROM b WHERE turn % 2 = 1"""
)
def xml_mentions(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return _place(bioc.mentions(docs), docs).select("conv_id", "turn", F.size("locations").alias("n_locations"), "passage_key", "text", "entity_type")


@query(_BASE + """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (kind = 1) AS BIGINT) AS n_cut FROM (SELECT 0 AS kind FROM a UNION ALL SELECT 1 FROM b)""")
def xml_unlimited_mentions(spark, sf_dir):
    """No type is left out, and mentions without a location stay: what a linking evaluation reads."""
    m = bioc.mentions(_docs(spark, sf_dir), include=(), exclude=(), need_location=False)
    return m.agg(F.count("*").alias("n"), F.count(F.when(F.col("ann_idx") == 1, 1)).alias("n_cut"))


@query(
    _BASE
    + """, l AS (SELECT document_id, conv_id, turn, tok FROM a WHERE annotatable AND type <> 'cell_vague')
  SELECT conv_id, CAST(turn AS INTEGER) AS turn, document_id AS document_key, tok AS mention_text FROM l"""
)
def xml_linkable(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return _place(bioc.linkable(docs), docs).select("conv_id", "turn", "document_key", "mention_text")


@query(_BASE + "SELECT document_id AS document_key, CAST(sum(length(t) + 1) - 1 AS BIGINT) AS n_chars, CAST(count(*) AS BIGINT) AS n_passages FROM p WHERE annotatable AND t <> '' GROUP BY document_id")
def xml_document_texts(spark, sf_dir):
    """Documents of one id share a key, and so a text; the passages of each are in order."""
    docs = _docs(spark, sf_dir)
    n = bioc.passages(docs).filter(bioc.annotatable()).filter("text <> ''").groupBy(F.col("document_id").alias("document_key")).agg(F.count("*").alias("n_passages"))
    return bioc.document_texts(docs).join(n, "document_key").select("document_key", F.length("text").cast("long").alias("n_chars"), "n_passages")


@query(_BASE + "SELECT CAST((SELECT count(DISTINCT conv_id) FROM p) AS BIGINT) AS documents, CAST((SELECT count(*) FROM p) AS BIGINT) AS passages, CAST(2 * (SELECT count(*) FROM a) AS BIGINT) AS annotations")
def xml_summary(spark, sf_dir):
    return bioc.collection_summary(_docs(spark, sf_dir)).select(*[F.col(c).cast("long").alias(c) for c in ("documents", "passages", "annotations")])


@query("SELECT 'driver' AS source, 'conversations' AS key, 'made=here & now' AS infons")
def xml_head(spark, sf_dir):
    _docs(spark, sf_dir)
    path = _WRITTEN[(spark.sparkContext.applicationId, sf_dir, "collection")]
    fields, infons = bioc.read_head(spark, bioc.input_files(path)[0])
    return spark.createDataFrame([(fields["source"], fields["key"], "|".join(f"{k}={v}" for k, v in infons))], "source string, key string, infons string")


_PREDICTED = """, f AS (SELECT DISTINCT document_id FROM p),
  made AS (SELECT 'd' || (conv_id - conv_id % 2) AS document_id, turn AS pid, turn * 3 AS start, turn * 3 + 4 AS e, 'x' || role AS label, conv_id, turn FROM conversations WHERE conv_id % 3 = 0)
"""


def _written(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """Writes documents and reads them again."""
    path = os.path.join(workspace.folder(spark, "written"), "xml")
    writers.write_xml(docs, path)
    return bioc.read_xml(spark, path)


@query(
    _BASE
    + _PREDICTED
    + """SELECT p.conv_id, CAST(p.turn AS INTEGER) AS turn, m.start, m.e AS "end", m.label, CASE WHEN m.turn % 4 = 0 THEN '0.25' WHEN m.turn % 4 = 1 THEN '1.5e-05' WHEN m.turn % 4 = 2 THEN '123457' ELSE '1e+06' END AS score, 'k=' || m.conv_id AS extra, true AS numbered
  FROM p JOIN made m ON p.document_id = m.document_id AND p.pid = m.pid
  UNION ALL SELECT conv_id, CAST(turn AS INTEGER), 7, 9, 'wild', NULL, '', true FROM p WHERE pid = 0"""
)
def predictions_written(spark, sf_dir):
    """Predictions by document id and passage number, and one for the first passage of every document; read back from the files."""
    docs = _docs(spark, sf_dir)
    c = _t(spark, sf_dir, "conversations").filter("conv_id % 3 = 0")
    score = F.when(F.col("turn") % 4 == 0, 0.25).when(F.col("turn") % 4 == 1, 1.5e-5).when(F.col("turn") % 4 == 2, 123456.7).otherwise(1e6)
    pred = c.select(
        F.concat(F.lit("d"), (F.col("conv_id") - F.col("conv_id") % 2).cast("string")).alias("document_id"), F.col("turn").cast("int").alias("passage_id"), (F.col("turn") * 3).cast("int").alias("start"), (F.col("turn") * 3 + 4).cast("int").alias("end"),
        F.concat(F.lit("x"), "role").alias("label"), F.lit("t").alias("text"), score.alias("score"), F.array(F.struct(F.lit("k").alias("key"), F.col("conv_id").cast("string").alias("value"))).alias("infons"),
    )
    wild = spark.createDataFrame([("", 0, 7, 9, "wild", "w", None, [])], "document_id string, passage_id int, start int, end int, label string, text string, score double, infons array<struct<key:string,value:string>>")
    out = _written(writers.with_predictions(docs, pred.unionByName(wild)), spark)
    a = _place(bioc.annotations(out), out)
    n = a.agg(F.count("*").alias("n"), F.countDistinct("ann_id").alias("d"), F.max(F.substring("ann_id", 2, 20).cast("long")).alias("m")).first()
    a = a.withColumn("numbered", F.lit(n.n == n.d and n.m == n.n - 1))
    extra = F.when(I.get("infons", "k").isNotNull(), F.concat(F.lit("k="), I.get("infons", "k"))).otherwise("")
    return a.select("conv_id", "turn", "start", "end", "label", I.get("infons", "score").alias("score"), extra.alias("extra"), "numbered")


@query(
    _BASE
    + """, s AS (SELECT conv_id, o + 1 AS start, o + 3 AS e, 'in' AS label FROM p WHERE length(t) > 5 UNION ALL SELECT conv_id, o + length(t) - 1, o + length(t) + 4, 'over' FROM p WHERE length(t) > 5)
  SELECT p.conv_id, CAST(p.turn AS INTEGER) AS turn, CAST(s.start AS INTEGER) AS start, CAST(s.e AS INTEGER) AS "end", s.label, CAST(row_number() OVER (PARTITION BY p.conv_id, p.turn ORDER BY s.start, s.e, s.label) AS BIGINT) AS nth
  FROM p JOIN s ON p.conv_id = s.conv_id AND p.o <= s.start AND s.e <= p.o + length(p.t)"""
)
def contained_written(spark, sf_dir):
    """Entities of a document in the passages that contain them; documents that share an id stay apart."""
    docs = _docs(spark, sf_dir)
    p = bioc.passages(docs).filter("length(text) > 5").withColumn("n", F.length("text"))
    e = p.select("source_path", "doc_idx", F.explode(F.array(
        F.struct((F.col("passage_offset") + 1).alias("start"), (F.col("passage_offset") + 3).alias("end"), F.lit("in").alias("label")),
        F.struct((F.col("passage_offset") + F.col("n") - 1).alias("start"), (F.col("passage_offset") + F.col("n") + 4).alias("end"), F.lit("over").alias("label")),
    )).alias("e")).select("source_path", "doc_idx", "e.*", F.lit("t").alias("text"))
    out = _written(writers.with_contained(docs, e), spark)
    a = _place(bioc.annotations(out), out)
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.substring("ann_id", 2, 20).cast("long"))).cast("long")
    return a.select("conv_id", "turn", "start", "end", "label", nth.alias("nth"))


_LINKS = """, l AS (SELECT * FROM a WHERE annotatable AND type <> 'cell_vague'), r AS (SELECT DISTINCT document_id, tok, length(tok) AS n FROM l)
"""


def _linked(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    r = bioc.linkable(docs).select("document_key", "normalized_text", F.length("mention_text").alias("n")).groupBy("document_key", "normalized_text").agg(F.min("n").alias("n"))
    r = r.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(1))))
    r = r.select("document_key", "normalized_text", "rank", F.concat(F.lit("CL:"), (F.col("n") * 10 + F.col("rank")).cast("string")).alias("identifier"), F.lit("label").alias("preferred_label"), F.lit("alias").alias("name"),
                 (F.lit(0.5) - F.col("rank") * 0.25).alias("final_score"), F.lit(-0.125).alias("embedding_score"), F.lit("model_normal").alias("source"), F.when(F.col("n") % 2 == 0, "exact_short_abbreviation").alias("abbreviation_method"), F.when(F.col("n") % 4 == 0, 0.95).alias("long_form_score"))
    return _written(writers.with_links(docs, r, "m"), spark)


@query(_BASE + _LINKS + """SELECT conv_id, CAST(turn AS INTEGER) AS turn, 'label' AS cl_label, 0.5::DOUBLE AS score, 'model_normal' AS source, CAST(1 AS BIGINT) AS n FROM l WHERE false
  UNION ALL SELECT conv_id, CAST(turn AS INTEGER), 'label', 0.5, 'model_normal', count(*) FROM l GROUP BY ALL""")
def links_written(spark, sf_dir):
    """The best candidate of each annotation, by the endings of its keys, read back from the files."""
    out = _linked(spark, sf_dir)
    p = bioc.predictions(out).withColumnRenamed("passage_index", "passage_id").filter("cl_label is not null")
    return _place(p, out).groupBy("conv_id", "turn", "cl_label", "score", "source").agg(F.count("*").alias("n"))


@query(
    _BASE
    + _LINKS
    + """, k AS (SELECT unnest(['m_match_source', 'm_abbreviation_method', 'm_ab3p_match_score', 'm_embedding_score_0', 'm_id_0', 'm_id_1', 'm_matched_alias_1', 'm_normalized_text', 'identifier', 'old_id_0', 'type']) AS key)
  SELECT key, CAST((SELECT count(*) FROM l) AS BIGINT) AS n FROM k WHERE key NOT IN ('m_abbreviation_method', 'm_ab3p_match_score', 'identifier', 'old_id_0', 'type')
  UNION ALL SELECT key, CAST((SELECT count(*) FROM a) AS BIGINT) FROM k WHERE key IN ('identifier', 'old_id_0', 'type')"""
)
def link_infons(spark, sf_dir):
    """How many annotations carry which key after linking: gold keys stay everywhere."""
    out = _linked(spark, sf_dir)
    keys = ["m_match_source", "m_embedding_score_0", "m_id_0", "m_id_1", "m_matched_alias_1", "m_normalized_text", "identifier", "old_id_0", "type"]
    return bioc.annotations(out).select(F.explode(F.array_distinct(F.transform("infons", lambda x: x["key"]))).alias("key")).filter(F.col("key").isin(keys)).groupBy("key").agg(F.count("*").alias("n"))


@query(
    _BASE
    + _LINKS
    + """SELECT conv_id, CAST(turn AS INTEGER) AS turn, CAST(k AS INTEGER) AS rank, CASE WHEN k = 0 THEN '0.50000000' ELSE '0.25000000' END AS score_text, 'CL:' || turn AS identifier FROM l, (VALUES (0), (1)) v(k)"""
)
def ranked_links(spark, sf_dir):
    """Every rank's prediction beside the gold identifier: what the linking evaluation reads."""
    out = _linked(spark, sf_dir)
    r = bioc.ranked_predictions(out, "m").filter("pred_id is not null")
    at = bioc.passages(out).select("doc_idx", "source_path", "passage_id", I.get("infons", "conv").cast("long").alias("conv_id"), I.get("infons", "turn").cast("int").alias("turn"))
    return r.join(at, ["source_path", "doc_idx", "passage_id"]).select("conv_id", "turn", "rank", "score_text", "identifier")


@query(_BASE + """SELECT key, CAST((SELECT count(*) FROM a) AS BIGINT) AS n FROM (SELECT unnest(['identifier', 'label', 'score', 'type', 'old_id_1']) AS key)
  UNION ALL SELECT key, CAST((SELECT count(*) FROM a WHERE annotatable AND type <> 'cell_vague') AS BIGINT) FROM (SELECT unnest(['m_id_1', 'm_identifier_name_1', 'm_identifier_score_1', 'm_embedding_score_1', 'm_matched_alias_0', 'm_matched_alias_1', 'm_normalized_text']) AS key)
  UNION ALL SELECT 'entity_type', CAST((SELECT count(*) FROM b) AS BIGINT)""")
def cleaned_infons(spark, sf_dir):
    """What is left after cleaning: the best candidate's keys and the old linker's are gone."""
    out = writers.cleaned(_linked(spark, sf_dir))
    return bioc.annotations(out).select(F.explode(F.array_distinct(F.transform("infons", lambda x: x["key"]))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query(_BASE + "SELECT CAST(max(turn) + 1 AS INTEGER) AS next_a, CAST(0 AS INTEGER) AS next_t FROM a")
def next_annotation_ids(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return spark.createDataFrame([(writers.next_annotation_id(docs, "a"), writers.next_annotation_id(docs, "T"))], "next_a int, next_t int")


@query(_BASE + "SELECT conv_id, CAST(turn AS INTEGER) AS turn, document_id, o AS passage_offset, md5(t) AS digest, role AS type, CASE WHEN tok = '' THEN NULL ELSE 2 END AS n_entities FROM p")
def passages_as_json_lines(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    path = _once(spark, sf_dir, "passages.jsonl", lambda p: writers.passage_jsonl(docs).write.text(p))
    r = bioc.read_jsonl(spark, path, "record_id long, document_id string, passage_offset int, text string, infons map<string,string>, entities array<struct<start:int,end:int,label:string>>")
    n = F.when(F.size("entities") > 0, F.size("entities"))
    return r.select(F.col("infons")["conv"].cast("long").alias("conv_id"), F.col("infons")["turn"].cast("int").alias("turn"), "document_id", "passage_offset", F.md5("text").alias("digest"), F.col("infons")["type"].alias("type"), n.alias("n_entities"))


# PubTator, plain text, sentences


_PUB = "(SELECT conv_id, turn, replace(replace(text, chr(10), ' '), chr(9), ' ') AS t FROM conversations WHERE turn < 2)"


@query(f"SELECT CAST(conv_id AS VARCHAR) AS document_id, 0 AS start, CAST(length(regexp_extract(t, '^\\S+')) AS INTEGER) AS \"end\", regexp_extract(t, '^\\S+') AS text, 'cell_type' AS entity_type FROM {_PUB} WHERE turn = 0 AND regexp_extract(t, '^\\S+') <> ''".replace("\\\\", "\\"))
def pubtator_round_trip(spark, sf_dir):
    """Titles, abstracts and annotation lines written and read; lines of other types and beyond the text are left out."""
    c = _t(spark, sf_dir, "conversations").filter("turn < 2").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("passage_id"), F.translate("text", "\n\t", "  ").alias("text"))

    def write(path: str) -> None:
        first = c.filter("passage_id = 0").withColumn("w", F.regexp_extract("text", r"^\S+", 0)).filter("w <> ''")
        a = first.select("document_id", "passage_id", F.lit(0).alias("start"), F.length("w").alias("end"), F.col("w").alias("text"), F.lit("cell_type").alias("label"))
        more = a.withColumn("label", F.lit("other")).unionByName(a.withColumns({"start": F.lit(5), "end": F.lit(10_000_000)}))
        writers.pubtator_lines(c, a.unionByName(more)).write.text(path)

    path = _once(spark, sf_dir, "pubtator", write)
    return bioc.pubtator(spark, path, ["CELL_TYPE"]).select("document_id", "start", "end", "text", "entity_type")


@query(
    """WITH s AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
  o AS (SELECT conv_id, turn, i, x, sum(length(x) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) - length(x) - 1 AS o FROM s)
  SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INTEGER) AS passage_id, CASE WHEN turn % 2 = 0 THEN 'sentence' ELSE 'passage' END AS container, CAST(100 + CASE WHEN turn % 2 = 0 THEN o ELSE 0 END AS INTEGER) AS base_offset,
         md5(rtrim(CASE WHEN turn % 2 = 0 THEN x ELSE (SELECT c.text FROM conversations c WHERE c.conv_id = o.conv_id AND c.turn = o.turn) END, ' ' || chr(10))) AS digest FROM o WHERE turn % 2 = 0 OR i = 1"""
)
def sentences_or_passages(spark, sf_dir):
    """Lines as sentences where a passage has them, cut at the next one's offset; else the passage."""
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("passage_id"), F.lit(100).alias("passage_offset"), "text")
    parts = F.split("text", "\n")
    s = c.filter("passage_id % 2 = 0").select("document_id", "passage_id", F.posexplode(parts).alias("i", "x"))
    w = Window.partitionBy("document_id", "passage_id").orderBy("i")
    s = s.select("document_id", "passage_id", (100 + F.sum(F.length("x") + 1).over(w) - F.length("x") - 1).cast("int").alias("offset"), F.lit("").alias("text"))
    u = bioc.text_units(s, c)
    return u.select("document_id", "passage_id", "container", F.col("base_offset").cast("int").alias("base_offset"), F.md5(F.regexp_replace("text", r"[ \n]+$", "")).alias("digest"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(r_name)) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS offsets FROM region")
def text_files(spark, sf_dir):
    """A plain text file for each region, read as one passage each."""

    def write(path: str) -> None:
        os.makedirs(path)
        for r in _t(spark, sf_dir, "region").toLocalIterator():  # five rows
            with open(os.path.join(path, f"{r.r_regionkey}.txt"), "w", encoding="utf-8") as f:
                f.write(r.r_name)

    p = bioc.text_passages(spark, _once(spark, sf_dir, "texts", write))
    return p.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.sum("passage_offset").alias("offsets"))


# resources

_CONCEPT = "(SELECT p_partkey AS k, 'CL:' || lpad(CAST(p_partkey % 1500 AS VARCHAR), 7, '0') AS id, p_name AS name, p_type AS syn, p_brand AS syn2, p_size FROM part)"
_LAST = f"(SELECT * FROM {_CONCEPT} QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1)"


def _concepts(spark, sf_dir):
    i = F.concat(F.lit("CL:"), F.lpad((F.col("p_partkey") % 1500).cast("string"), 7, "0"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), i.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("syn"), F.col("p_brand").alias("syn2"), "p_size")


def _lines(df: DataFrame, value, path: str) -> None:
    """Lines in the order of k."""
    df.select("k", value.alias("value")).orderBy("k").select("value").write.text(path)


@query(
    f"""SELECT id AS identifier, name, CASE WHEN p_size % 2 = 0 THEN 'a "' || syn2 || '" cell' ELSE '' END AS definition, array_to_string(list_sort(list_distinct([syn, syn2])), '|') AS synonyms,
  CASE WHEN p_size % 3 = 0 THEN 'CL:0000001|CL:0000002' ELSE '' END AS parents, p_size % 5 = 0 AS is_obsolete FROM {_LAST}"""
)
def obo_terms(spark, sf_dir):
    """Stanzas of an OBO file: quoted fields with escapes, several synonyms and parents, other stanzas and prefixes; the last of equal ids wins."""

    def write(path: str) -> None:
        c = _concepts(spark, sf_dir)
        cell = F.concat_ws(
            "\n", F.lit("[Term]"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("name: "), "name"), F.lit("name: not this one"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('def: "a \\"'), "syn2", F.lit('\\" cell" [x:y]'))),
            F.concat(F.lit('synonym: "'), "syn", F.lit('" EXACT []')), F.concat(F.lit('synonym: "'), "syn2", F.lit('" RELATED []')), F.when(F.col("p_size") % 3 == 0, F.lit("is_a: CL:0000002 ! b\nrelationship: part_of CL:0000001 ! a")),
            F.when(F.col("p_size") % 5 == 0, F.lit("is_obsolete: true")), F.lit(""),
        )
        other = F.lit("[Typedef]\nid: part_of\nname: part of\n\n[Term]\nid: GO:1\nname: not a cell\n")
        _lines(c, F.when(F.col("k") % 50 == 0, F.concat_ws("\n", other, cell)).otherwise(cell), path)

    o = R.read_obo(spark, _once(spark, sf_dir, "terms.obo", write))
    return o.select("identifier", "name", F.coalesce("definition", F.lit("")).alias("definition"), F.array_join("synonyms", "|").alias("synonyms"), F.array_join("parents", "|").alias("parents"), F.coalesce("is_obsolete", F.lit(False)).alias("is_obsolete"))


@query(f"SELECT id AS identifier, name, array_to_string(list_sort(list_distinct([syn, syn2])), '|') AS synonyms FROM {_LAST}")
def concept_json_lines(spark, sf_dir):
    """Concept records under several field names, aliases as lists and as joined texts."""

    def write(path: str) -> None:
        c = _concepts(spark, sf_dir)
        a = F.to_json(F.struct(F.replace("id", F.lit("CL:"), F.lit("CL_")).alias("concept_id"), F.col("name").alias("label"), F.array("syn").alias("synonyms"), F.col("syn2").alias("alias")))
        b = F.to_json(F.struct("id", "name", F.concat_ws("|", "syn", "syn2").alias("aliases")))
        _lines(c, F.when(F.col("k") % 2 == 0, a).otherwise(b), path)

    r = R.read_concepts_jsonl(spark, _once(spark, sf_dir, "concepts.jsonl", write))
    return r.select("identifier", "name", F.array_join("synonyms", "|").alias("synonyms"))


@query(
    f"""SELECT id AS identifier, arg_min(name, k) AS name, array_to_string(list_sort(list_distinct(list_concat(list_concat(list(syn), list(syn2)), list(name)))), '|') AS synonyms FROM {_CONCEPT} GROUP BY id"""
)
def concept_table(spark, sf_dir):
    """A table whose first row of an id names the concept; later rows add aliases."""

    def write(path: str) -> None:
        c = _concepts(spark, sf_dir).orderBy("k")
        c.coalesce(1).select("id", "name", F.concat_ws(";", "syn", "syn2").alias("aliases")).write.option("sep", "\t").option("header", True).csv(path)

    r = R.read_concepts_table(spark, _once(spark, sf_dir, "concepts.tsv", write))
    return r.select("identifier", "name", F.array_join("synonyms", "|").alias("synonyms"))


@query(f"SELECT id AS identifier, syn AS alias, CAST(count(*) AS BIGINT) AS n FROM {_CONCEPT} GROUP BY ALL")
def alias_file(spark, sf_dir):
    path = _once(spark, sf_dir, "aliases.tsv", lambda p: _concepts(spark, sf_dir).select(F.col("id").alias("CL_ID"), F.col("syn").alias("Synonym")).write.option("sep", "\t").option("header", True).csv(p))
    return R.read_aliases(spark, path).groupBy("identifier", "alias").agg(F.count("*").alias("n"))


@query(f"SELECT syn AS text_a, syn2 AS text_b, CAST(count(*) AS BIGINT) AS n FROM {_CONCEPT} GROUP BY ALL")
def pair_file(spark, sf_dir):
    path = _once(spark, sf_dir, "pairs.tsv", lambda p: writers.write_pairs(_concepts(spark, sf_dir).select(F.col("syn").alias("text_a"), F.col("syn2").alias("text_b")), p))
    return R.read_pairs(spark, path).groupBy("text_a", "text_b").agg(F.count("*").alias("n"))


@query(
    f"""WITH l AS (SELECT *, array_to_string(list_sort(list_filter(list_distinct([syn, syn2]), lambda x: x <> name)), '|') AS s FROM {_LAST} WHERE p_size % 5 <> 0)
  SELECT id AS norm_concept_id, name AS norm_preferred_label, s AS synonyms FROM l"""
)
def resource_file(spark, sf_dir):
    """Concepts as records without the obsolete ones, written in order and read by the strict reader."""
    obo_terms(spark, sf_dir)  # writes the file, if it isn't there
    obo = R.read_obo(spark, _WRITTEN[(spark.sparkContext.applicationId, sf_dir, "terms.obo")])
    path = _once(spark, sf_dir, "resource.jsonl", lambda p: writers.write_resource(O.records(obo, False), p))
    t = R.read_ontology(spark, path)
    m = R.concept_metadata(t)
    return m.select(F.col("identifier").alias("norm_concept_id"), F.col("preferred_label").alias("norm_preferred_label"), F.array_join("synonyms", "|").alias("synonyms"))


@query(
    r"""SELECT key, CAST(count(DISTINCT id) AS BIGINT) AS n_ids, arg_min(id, k) AS identifier FROM (SELECT p_partkey AS k, 'A-' || p_partkey % 700 AS s, 'A' || p_partkey % 700 AS key, p_brand AS id FROM part WHERE p_size % 7 <> 0) GROUP BY key"""
)
def abbreviation_file(spark, sf_dir):
    """A table of short forms with a header, blank ids and placeholders; of several ids the first counts."""

    def write(path: str) -> None:
        p = _t(spark, sf_dir, "part").orderBy("p_partkey").coalesce(1)
        i = F.when(F.col("p_size") % 7 == 0, F.element_at(F.array(F.lit("-"), F.lit("None"), F.lit(" ")), (F.col("p_partkey") % 3 + 1).cast("int"))).otherwise(F.concat("p_brand", F.lit(";CL:9")))
        rows = p.select(F.concat(F.lit("A–"), (F.col("p_partkey") % 700).cast("string")).alias("short_form"), i.alias("matched_cl_id"))
        folder = path + ".parts"
        rows.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(folder)
        os.rename(next(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".csv")), path)

    rows = R.read_abbreviations(spark, _once(spark, sf_dir, "short.tsv", write))
    return A.keys(A.lookup(rows)).select("key", "n_ids", "identifier")


# scalar functions and small operators


@query(
    """SELECT event_id, CASE WHEN amount >= 100 THEN 'big' END AS label, TRY_CAST(printf('%.6g', amount) AS DOUBLE) = TRY_CAST(printf('%.6g', amount) AS DOUBLE) AS same,
  printf('%.6g', x) AS text FROM (SELECT event_id, amount, CASE event_id % 5 WHEN 0 THEN amount WHEN 1 THEN amount / 1e7 WHEN 2 THEN amount * 1e5 WHEN 3 THEN CAST(event_id AS DOUBLE) ELSE 0.0 END AS x FROM (SELECT event_id, value AS amount FROM events))"""
)
def significant_digits(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.col("value").alias("amount"))
    k = F.col("event_id") % 5
    x = F.when(k == 0, F.col("amount")).when(k == 1, F.col("amount") / 1e7).when(k == 2, F.col("amount") * 1e5).when(k == 3, F.col("event_id").cast("double")).otherwise(0.0)
    return e.select("event_id", F.when(F.col("amount") >= 100, "big").alias("label"), F.lit(True).alias("same"), X.significant(x).alias("text"))


_FIELDS = "CASE p_size % 4 WHEN 0 THEN p_name || '|' || p_type || '| ' WHEN 1 THEN p_name || '; ' || p_type WHEN 2 THEN p_name ELSE NULL END"


@query(
    f"""SELECT p_partkey, array_to_string(list_filter(list_transform(CASE WHEN contains(f, '|') THEN string_split(f, '|') ELSE string_split(f, ';') END, lambda x: trim(x)), lambda x: x <> ''), '/') AS listed,
  coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN ' ' END), ''), nullif(trim(p_brand), '')) AS first, regexp_replace(p_brand || '/' || p_name || '.x', '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM (SELECT *, coalesce({_FIELDS}, '') AS f FROM part)"""
)
def list_fields(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("f", F.expr(_FIELDS)).withColumn("blank", F.when(F.col("p_size") % 3 == 0, " "))
    return p.select("p_partkey", F.array_join(X.as_list("f"), "/").alias("listed"), X.first_nonempty("blank", "p_brand").alias("first"), X.file_safe(F.concat("p_brand", F.lit("/"), "p_name", F.lit(".x"))).alias("safe"))


_IV = "(SELECT l_orderkey, l_linenumber, l_partkey % 40 AS s1, l_partkey % 40 + CAST(l_quantity AS INTEGER) AS e1, l_suppkey % 40 AS s2, l_suppkey % 40 + l_linenumber AS e2 FROM lineitem)"


@query(f"SELECT l_linenumber, CAST(count(*) FILTER (greatest(s1, s2) < least(e1, e2)) AS BIGINT) AS n_overlap, CAST(sum(greatest(0, least(e1, e2) - greatest(s1, s2))) AS BIGINT) AS n_shared FROM {_IV} GROUP BY l_linenumber")
def interval_overlaps(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").selectExpr("l_linenumber", "l_partkey % 40 AS s1", "l_partkey % 40 + CAST(l_quantity AS INT) AS e1", "l_suppkey % 40 AS s2", "l_suppkey % 40 + l_linenumber AS e2")
    return li.groupBy("l_linenumber").agg(F.count(F.when(X.spans_overlap("s1", "e1", "s2", "e2"), 1)).alias("n_overlap"), F.sum(X.overlap_length("s1", "e1", "s2", "e2").cast("long")).alias("n_shared"))


_ENTS = "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '  ' ELSE '[{\"start\": ' || event_id || ', \"end\": ' || (event_id + 3) || ', \"label\": \"' || event_type || '\"}, {\"end\": 9, \"start\": 1, \"label\": \"x\", \"more\": 1}]' END"


@query("SELECT event_id, unnest(CASE WHEN event_id % 4 < 2 THEN [] ELSE [event_id, 1] END) AS start, unnest(CASE WHEN event_id % 4 < 2 THEN [] ELSE [event_id + 3, 9] END) AS \"end\", unnest(CASE WHEN event_id % 4 < 2 THEN [] ELSE [event_type, 'x'] END) AS label FROM events")
def entity_lists(spark, sf_dir):
    """Entities from JSON texts: none for null and blank ones, further fields ignored."""
    e = _t(spark, sf_dir, "events").select("event_id", F.expr(_ENTS.replace('\\"', '"')).alias("raw"))
    x = e.select("event_id", F.explode(D.canonical_entities("raw")).alias("e"))
    return x.select("event_id", F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end"), "e.label")


@query("SELECT tag, CAST(row_number() OVER (ORDER BY CASE WHEN tag = 'O' THEN 0 WHEN tag LIKE 'B-%' OR tag LIKE 'I-%' THEN 1 ELSE 2 END, CASE WHEN tag LIKE 'B-%' OR tag LIKE 'I-%' THEN substr(tag, 3) ELSE tag END, tag LIKE 'I-%') AS INTEGER) AS place FROM (SELECT unnest(['O', 'I-' || event_type, 'B-' || event_type, event_type]) AS tag FROM (SELECT DISTINCT event_type FROM events)) GROUP BY tag")
def label_orders(spark, sf_dir):
    t = _t(spark, sf_dir, "events").select("event_type").distinct()
    tags = t.select(F.explode(F.array(F.lit("O"), F.concat(F.lit("I-"), "event_type"), F.concat(F.lit("B-"), "event_type"), "event_type")).alias("tag")).distinct()
    return tags.select("tag", F.row_number().over(Window.orderBy(D.label_order("tag"))).alias("place"))  # four rows a label


_TAGS = "CASE event_type WHEN 'error' THEN 'O' WHEN 'click' THEN 'B-x' WHEN 'view' THEN 'I-x' WHEN 'signup' THEN 'I-y' ELSE 'B-y' END"


def _islands_sql(name: str, tag: str) -> str:
    return f"""{name}l AS (SELECT user_id, event_id, {tag} AS tag, CASE WHEN {tag} = 'O' THEN NULL ELSE substr({tag}, 3) END AS label FROM e),
  {name}n AS (SELECT *, label IS NOT NULL AND (tag LIKE 'B-%' OR lag(label) OVER w IS DISTINCT FROM label) AS fresh FROM {name}l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  {name}i AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM {name}n),
  {name} AS (SELECT user_id, label, min(event_id) AS s, max(event_id) AS t FROM {name}i WHERE label IS NOT NULL GROUP BY user_id, island, label)"""


@query(
    f"""WITH e AS (SELECT user_id, event_id, {_TAGS} AS gold, CASE WHEN event_id % 7 = 0 THEN 'O' ELSE {_TAGS} END AS predicted FROM events WHERE event_id % 11 <> 0), {_islands_sql('g', 'gold')}, {_islands_sql('p', 'predicted')},
  c AS (SELECT CAST((SELECT count(*) FROM g JOIN p USING (user_id, label, s, t)) AS BIGINT) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng)
  SELECT tp, CAST(np - tp AS BIGINT) AS fp, CAST(ng - tp AS BIGINT) AS fn, round(2 * tp / (np + ng), 9) AS f1 FROM c"""
)
def entity_sequence_metrics(spark, sf_dir):
    """Entity precision, recall and F1 of tag sequences; tokens without a gold label (-100) don't exist."""
    e = _t(spark, sf_dir, "events").withColumn("gold", F.expr(_TAGS))
    e = e.select("user_id", F.col("event_id").alias("start"), F.when(F.col("event_id") % 11 == 0, "-100").otherwise(F.col("gold")).alias("gold"), F.when(F.col("event_id") % 7 == 0, "O").otherwise(F.col("gold")).alias("predicted"))
    return D.entity_metrics(e, ["user_id"]).select("tp", "fp", "fn", F.round("f1", 9).alias("f1"))


@query("SELECT CAST(conv_id AS VARCHAR) AS sample_id, pos AS start, CASE WHEN pos % 9 = 0 OR pos % 10 = 3 THEN '-100' WHEN pos % 4 = 0 THEN 'B-x' ELSE 'O' END AS tag FROM (SELECT conv_id, CAST(unnest(range(0, length(text) % 50)) AS INTEGER) AS pos FROM conversations WHERE turn = 0)")
def window_tags(spark, sf_dir):
    """Labels of window tokens from the full text's: -100 for special ones and those without width, O where unknown."""
    c = _t(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").cast("string").alias("sample_id"), (F.length("text") % 50).alias("n")).filter("n > 0")
    tok = c.select("sample_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    tok = tok.withColumns({"end": F.when(F.col("start") % 10 == 3, F.col("start")).otherwise(F.col("start") + 1), "is_special": F.col("start") % 9 == 0})
    tags = tok.filter("start % 4 = 0").select("sample_id", "start", "end", F.lit("B-x").alias("tag"))
    return D.window_labels(tok, tags).select("sample_id", "start", "tag")


@query("SELECT doc_id, text_length FROM (SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length FROM documents ORDER BY source NULLS LAST, doc_id) ORDER BY 1")
def tokenised_columns(spark, sf_dir):
    """What a model is given: metadata columns stay behind."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("input_ids"), F.length("text").cast("long").alias("labels"), "source", "text")
    return filters.without_metadata(d).select(F.col("input_ids").alias("doc_id"), F.col("labels").alias("text_length"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def first_examples(spark, sf_dir):
    return filters.subset(_t(spark, sf_dir, "orders"), 100, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey % 50 + l_suppkey AS BIGINT) AS start, CAST(l_partkey % 50 + 5 + l_suppkey AS BIGINT) AS \"end\" FROM lineitem")
def absolute_spans(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + 5).alias("end"), F.col("l_suppkey").alias("passage_offset"))
    return filters.to_absolute(li).select("l_orderkey", "l_linenumber", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_SHORTS = """shorts AS (SELECT o_custkey AS c, 'K' || (o_custkey % 7) || CASE WHEN o_custkey % 3 = 0 THEN 's' ELSE '' END AS want FROM orders GROUP BY o_custkey),
  forms AS (SELECT o_custkey AS c, 'K' || (o_orderkey % 7) AS short, max('long ' || o_orderpriority) AS long FROM orders GROUP BY ALL)"""


@query(
    f"""WITH {_SHORTS}, m AS (SELECT s.c, s.want, f.short, f.long, CASE WHEN f.short = s.want THEN 0 WHEN f.short || 's' = s.want OR f.short = s.want || 's' THEN 1 END AS kind FROM shorts s JOIN forms f ON s.c = f.c)
  SELECT CAST(c AS VARCHAR) AS document_key, want AS matched_key, long AS expanded_long_form, CASE kind WHEN 0 THEN 'exact_key' ELSE 'exact_variant' END AS method, 1.0::DOUBLE AS score
  FROM m WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c, want ORDER BY kind, short) = 1"""
)
def long_form_variants(spark, sf_dir):
    """Long forms by the key itself, else by its plural; short keys match nothing by similarity."""
    o = _t(spark, sf_dir, "orders")
    key = F.col("o_custkey").cast("string").alias("document_key")
    want = o.select(key, F.concat(F.lit("K"), (F.col("o_custkey") % 7).cast("string"), F.when(F.col("o_custkey") % 3 == 0, "s").otherwise("")).alias("matched_key")).distinct()
    forms = o.groupBy(key, F.concat(F.lit("K"), (F.col("o_orderkey") % 7).cast("string")).alias("short_key")).agg(F.max(F.concat(F.lit("long "), "o_orderpriority")).alias("long_form"))
    return A.expand(want, forms).select("document_key", "matched_key", "expanded_long_form", F.col("long_form_method").alias("method"), F.col("long_form_score").alias("score"))


@query(
    """WITH t AS (SELECT DISTINCT regexp_replace(p_brand, '[#]', '-') AS k FROM part), m AS (SELECT DISTINCT replace(p_brand, '#', CASE WHEN p_size % 2 = 0 THEN ' ' ELSE '–' END) AS mention FROM part UNION SELECT DISTINCT 'B' || (p_size % 30) FROM part)
  SELECT mention AS mention_text, replace(replace(mention, ' ', ''), '–', '') AS matched_key, CASE WHEN length(replace(replace(mention, ' ', ''), '–', '')) <= 4 THEN 'exact_short_abbreviation' ELSE 'encoder_abbreviation_match' END AS method
  FROM m WHERE replace(replace(mention, ' ', ''), '–', '') IN (SELECT replace(k, '-', '') FROM t UNION SELECT 'B' || v FROM (SELECT unnest(range(0, 20)) AS v))"""
)
def short_form_keys(spark, sf_dir):
    """Which key of the table a mention matches; the method tells whether its length allows similarity at all."""
    p = _t(spark, sf_dir, "part")
    rows = p.select(F.replace("p_brand", F.lit("#"), F.lit("-")).alias("short_form")).distinct().union(spark.range(20).select(F.concat(F.lit("B"), F.col("id").cast("string"))))
    table = A.lookup(rows.select("short_form", F.lit("CL:1").alias("identifier"), F.lit(0).cast("long").alias("line_no")))
    m = p.select(F.replace("p_brand", F.lit("#"), F.when(F.col("p_size") % 2 == 0, F.lit(" ")).otherwise(F.lit("–"))).alias("mention_text")).union(p.select(F.concat(F.lit("B"), (F.col("p_size") % 30).cast("string"))))
    return A.match_keys(m, table).select("mention_text", "matched_key", "method")


@query("SELECT identifier, CAST(least(5, count(*)) AS BIGINT) AS n, true AS ordered FROM (SELECT 'R' || (a.p_size % 10) AS identifier FROM (SELECT DISTINCT p_size % 10 AS p_size, p_name FROM part) a JOIN (SELECT DISTINCT p_size % 10 AS p_size, p_name FROM part) b ON a.p_size = b.p_size AND a.p_name < b.p_name) GROUP BY identifier")
def sampled_pairs(spark, sf_dir):
    """A seeded sample of at most five pairs a concept: which ones is the sampler's choice, how many is not."""
    p = _t(spark, sf_dir, "part").select(F.concat(F.lit("R"), (F.col("p_size") % 10).cast("string")).alias("identifier"), F.col("p_name").alias("raw_name")).distinct()
    s = O.alias_pairs(p, 5)
    return s.groupBy("identifier").agg(F.count("*").alias("n"), F.min(F.col("text_a") < F.col("text_b")).alias("ordered"))


@query("SELECT CAST(count(*) AS BIGINT) AS terms, CAST(count(DISTINCT identifier) AS BIGINT) AS concepts FROM (SELECT p_brand AS identifier, p_name FROM part WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY ALL UNION ALL SELECT p_brand, '' FROM part WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY p_brand)")
def namespace_terms(spark, sf_dir):
    """Terms of the concepts of some namespaces only."""
    p = _t(spark, sf_dir, "part").filter("p_type in ('ECONOMY', 'PROMO')")
    c = p.groupBy(F.col("p_brand").alias("norm_concept_id")).agg(F.array_sort(F.collect_set("p_name")).alias("synonyms"))
    rows = c.select("norm_concept_id", F.concat(F.lit("label "), "norm_concept_id").alias("norm_preferred_label"), "synonyms", F.lit("cell").alias("namespace"), F.xxhash64("norm_concept_id").alias("line"))
    other = rows.withColumns({"namespace": F.lit("other"), "norm_concept_id": F.concat(F.lit("x"), "norm_concept_id")})
    t = R.ontology_terms(rows.unionByName(other), ["cell"])
    return t.agg(F.count("*").alias("terms"), F.countDistinct("identifier").alias("concepts"))


@query(
    "WITH g AS (SELECT l_returnflag AS d, l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS q FROM lineitem), n AS (SELECT d, l_orderkey, l_linenumber * 100 AS o, q FROM g GROUP BY ALL HAVING count(*) > 0)"
    " SELECT 'set' AS dataset, 'sys' AS system, criterion, CAST(count(*) AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn FROM (SELECT unnest(['exact_span', 'relaxed_span']) AS criterion FROM g WHERE l_linenumber = 1) GROUP BY criterion"
)
def span_row_pair(spark, sf_dir):
    """The two rows of a pair of files, here of equal ones: every mention matches by both criteria."""
    li = _t(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
    loc = F.array(F.struct((F.col("l_linenumber") * 100).alias("offset"), (F.col("l_quantity").cast("int") + 1).alias("length")))
    g = li.select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("document_id"), F.lit("p").alias("passage_key"), F.lit(0).alias("passage_offset"), F.lit("").alias("passage_text"), loc.alias("locations"), F.lit("y").alias("text"), F.lit("cell_type").alias("entity_type"), F.col("l_partkey").cast("long").alias("idx"))
    return E.span_rows(g, g, "set", "sys").select("dataset", "system", "criterion", "tp", "fp", "fn")


# linking through the pipeline's API


_VECTORS = "(SELECT vec_id, 'v' || vec_id AS name, 'CL:' || lpad(CAST(label AS VARCHAR), 7, '0') AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(
    f"""WITH v AS {_VECTORS}, q AS (SELECT * FROM v WHERE vec_id % 25 = 0), hits AS (SELECT q.vec_id AS query, v.vec_id, v.id, list_cosine_similarity(q.e, v.e) - 1 AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.vec_id) AS place FROM q, v QUALIFY place <= 30),
  best AS (SELECT query, id, max(s) AS s, row_number() OVER (PARTITION BY query ORDER BY max(s) DESC) AS prior FROM hits GROUP BY query, id QUALIFY prior <= 3),
  scored AS (SELECT b.query, b.id, s + CASE WHEN q.id = b.id THEN 0.55 ELSE 0 END AS f FROM best b JOIN q ON q.vec_id = b.query),
  dense AS (SELECT query, id, f, row_number() OVER (PARTITION BY query ORDER BY f DESC) - 1 AS rank FROM scored)
  SELECT 'v' || query AS mention_text, CAST(rank AS INTEGER) AS rank, id AS identifier, round(f, 6) AS final_score, 'model_normal' AS source FROM dense WHERE query % 50 <> 0
  UNION ALL SELECT name, 0, id, 1.0, 'abbreviation_direct' FROM q WHERE vec_id % 100 = 0
  UNION ALL SELECT 'v' || query, CAST(rank AS INTEGER), id, round(f, 6), 'model_normal' FROM dense WHERE query % 100 = 50"""
)
def link_mentions(spark, sf_dir):
    """Mentions through the linker: direct abbreviations, ambiguous ones without a long form, and the dense rest.

    The encoder is a table of the driver's vectors, so its size is theirs."""
    from mentionlake.encoders import TableEncoder
    from mentionlake.operators.linking import WEIGHTS
    from mentionlake.plans.pipeline import Pipeline, PipelineConfig

    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), F.concat(F.lit("CL:"), F.lpad(F.col("label").cast("string"), 7, "0")).alias("id"), "embedding")

    def ontology(path: str) -> None:
        c = e.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("s"), F.min("vec_id").alias("k"))
        _lines(c, F.to_json(F.struct(F.col("id").alias("norm_concept_id"), F.concat(F.lit("label "), "id").alias("norm_preferred_label"), F.split("s", r"\|").alias("synonyms"), F.lit("cell").alias("namespace"))), path)

    def short(path: str) -> None:
        rows = e.filter("vec_id % 50 = 0").orderBy("vec_id").select("vec_id", "name", "id").collect()  # a fixture's file
        with open(path, "w", encoding="utf-8") as f:
            f.write("short_form\tmatched_cl_id\n" + "".join(f"{r.name}\t{r.id}\n" + (f"{r.name}\tCL:9\n" if r.vec_id % 100 else "") for r in rows))

    table = TableEncoder({r.name: [float(x) for x in r.embedding] for r in e.collect()})
    config = PipelineConfig(_once(spark, sf_dir, "vectors.jsonl", ontology), _once(spark, sf_dir, "vectors.tsv", short), encoder=table, weights=WEIGHTS | {"sequence": 0.0})
    m = e.filter("vec_id % 25 = 0").select(F.lit("").alias("document_key"), F.col("name").alias("mention_text"))
    found = Pipeline(spark, config).link(m, 3)
    return found.select("mention_text", "rank", "identifier", F.round("final_score", 6).alias("final_score"), "source")


# what a run leaves behind


@query("SELECT l_returnflag AS dataset, CAST(count(*) AS BIGINT) AS tp, round(avg(l_quantity), 6) AS f1, CAST(max(l_suppkey) AS BIGINT) AS more FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'z', 1, 0.5, NULL")
def metric_files(spark, sf_dir):
    """Metric rows of several tables as one CSV, read back: fixed fields first, others behind."""
    a = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("dataset")).agg(F.max("l_suppkey").alias("more"), F.round(F.avg("l_quantity"), 6).alias("f1"), F.count("*").alias("tp"))
    b = spark.createDataFrame([("z", 1, 0.5)], "dataset string, tp long, f1 double")
    path = _once(spark, sf_dir, "metrics", lambda p: writers.write_metrics(writers.union_rows([a, b]), p))
    return spark.read.option("header", True).schema("dataset string, tp long, f1 double, more long").option("enforceSchema", False).csv(path)


@query("SELECT 'lines' AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (o_custkey % 3 = 0) AS BIGINT) AS n_null FROM orders UNION ALL SELECT 'array', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (o_custkey % 3 = 0) AS BIGINT) FROM orders UNION ALL SELECT 'compact', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (o_custkey % 3 = 0) AS BIGINT) FROM orders")
def prediction_files(spark, sf_dir):
    """Predictions as JSON lines and as JSON arrays, nulls written, and as compact lines, nulls left out."""
    p = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus")).alias("label"))

    def write(path: str) -> None:
        writers.write_predictions(p, path)
        writers.write_jsonl(p, os.path.join(path, "compact"))

    path = _once(spark, sf_dir, "predictions", write)
    schema = "o_orderkey long, label string"
    parts = [("lines", spark.read.schema(schema).json(f"{path}/predictions.jsonl")), ("array", spark.read.schema(schema).option("multiLine", True).json(f"{path}/predictions.json")), ("compact", spark.read.schema(schema).json(f"{path}/compact"))]
    return writers.union_rows([df.agg(F.count("o_orderkey").alias("n"), F.count(F.when(F.col("label").isNull(), 1)).alias("n_null")).select(F.lit(k).alias("kind"), "n", "n_null") for k, df in parts])


@query("SELECT sha256(string_agg(r_name, chr(10) ORDER BY r_regionkey)) AS digest, round(count(*) / 2.0, 6) AS per_second, round(2000.0 / count(*), 6) AS ms FROM region")
def digests_and_rates(spark, sf_dir):
    """A file's digest, and the rates of a run that took two seconds."""

    def write(path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write("\n".join(r.r_name for r in _t(spark, sf_dir, "region").orderBy("r_regionkey").collect()))  # five rows

    rate = E.throughput(_t(spark, sf_dir, "region").count(), 2.0)
    row = (writers.folder_digest(_once(spark, sf_dir, "regions.txt", write)), rate["mentions_per_second"], rate["ms_per_mention"])
    return spark.createDataFrame([row], "digest string, per_second double, ms double").select("digest", F.round("per_second", 6).alias("per_second"), F.round("ms", 6).alias("ms"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_name) - 1 AS INTEGER) AS place, n_name AS name, 'gold/' || n_name AS gold, 'pred/' || n_name AS predicted FROM nation")
def paired_files(spark, sf_dir):
    """Gold and predicted files paired by name, in order of the names."""
    names = [r.n_name for r in _t(spark, sf_dir, "nation").select("n_name").collect()]  # arguments of a command
    pairs = R.paired_paths([f"{n}=gold/{n}" for n in names], [f"{n}=pred/{n}" for n in reversed(names)])
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "place int, name string, gold string, predicted string")


@query("SELECT CAST(r_regionkey AS INTEGER) AS place, r_name || '.xml' AS name FROM region")
def file_lists(spark, sf_dir):
    """Files of folders and of their own paths, each once, in order; markers and hidden files are none."""

    def write(path: str) -> None:
        for r in _t(spark, sf_dir, "region").collect():  # five rows
            folder = os.path.join(path, str(r.r_regionkey))
            os.makedirs(folder)
            for name in (f"{r.r_name}.xml", "_SUCCESS", ".hidden.xml"):
                with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
                    f.write("<collection/>")

    path = _once(spark, sf_dir, "lists", write)
    first = bioc.input_files(path)
    found = bioc.input_files([path, first[0], os.path.join(path, "0", "..", "0")])
    return spark.createDataFrame([(i, os.path.basename(f)) for i, f in enumerate(found)], "place int, name string")


@query("SELECT 'json' AS kind, CAST(count(*) AS BIGINT) AS n, md5(string_agg(p_name, '|' ORDER BY p_partkey)) AS digest FROM part UNION ALL SELECT 'csv', CAST(count(*) AS BIGINT), md5(string_agg(p_name, '|' ORDER BY p_partkey)) FROM part")
def dataset_files(spark, sf_dir):
    """Datasets by the ending of their first file; the columns that hold text and ids are inferred."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ID"), F.col("p_name").alias("Text"))
    j = _once(spark, sf_dir, "data.jsonl", lambda x: p.write.json(x))
    c = _once(spark, sf_dir, "data.csv", lambda x: p.write.option("header", True).csv(x))
    out = []
    for kind, path in (("json", j), ("csv", c)):
        d = R.read_dataset(spark, [path])
        names = R.infer_columns(d.columns)
        rows = F.array_sort(F.collect_list(F.struct(F.col(names["record_id"]).cast("long").alias("k"), F.col(names["text"]).alias("t"))))
        out.append(d.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.md5(F.array_join(F.transform(rows, lambda x: x["t"]), "|")).alias("digest")))
    return writers.union_rows(out)


@query("SELECT CAST(n AS INTEGER) AS line, value FROM (SELECT 0 AS n, '| system | A | N | R |' AS value UNION ALL SELECT 1, '|---|---|---|---|' UNION ALL SELECT 2, '| s | ' || printf('%.3f', avg(l_discount) FILTER (l_returnflag = 'A')) || ' | ' || printf('%.3f', avg(l_discount) FILTER (l_returnflag = 'N')) || ' | ' || printf('%.3f', avg(l_discount) FILTER (l_returnflag = 'R')) || ' |' FROM lineitem)")
def markdown_table(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("dataset")).agg(F.avg("l_discount").alias("f1")).withColumn("system", F.lit("s"))
    text = E.markdown(E.pivoted(rows, ["A", "N", "R"]))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, value string")
