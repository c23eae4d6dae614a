"""Sinks: document-structured XML, JSONL, resources, pairs and metrics."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence
from datetime import datetime, timezone
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake import schemas
from mentionlake.functions import infons as I
from mentionlake.functions import text as X
from mentionlake.operators import filters
from mentionlake.sources import bioc

_NO_ANNOTATIONS = f"array<{schemas.ANNOTATION}>"


def write_xml(docs: DataFrame, path: str, mode: str = "errorifexists", head: dict[str, str] | None = None, infons: list[tuple[str, str]] = ()) -> None:
    """Documents (id, infon, passage) as XML files under a folder; each file is a collection with the given head (source,
    date, key) and infons, which `bioc.read_head` reads."""
    one = docs.select(F.to_xml(F.struct("id", "infon", "passage"), {"rowTag": "document", "ignoreSurroundingSpaces": "false"}).alias("value"))
    fields = "".join(f"<infon key={quoteattr(k)}>{escape(v)}</infon>" for k, v in infons) + "".join(f"<{k}>{escape(v)}</{k}>" for k, v in (head or {}).items())

    def framed(batches):
        yield pa.RecordBatch.from_arrays([pa.array([f'<?xml version="1.0" encoding="UTF-8"?>\n<collection>{fields}'])], names=["value"])
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array(["</collection>"])], names=["value"])

    one.mapInArrow(framed, "value string").write.mode(mode).text(path)


def text_document(spark: SparkSession, text: str, document_id: str = "doc0", kind: str | None = None) -> DataFrame:
    """One document with one passage."""
    infon = [(("type", kind))] if kind else []
    row = spark.createDataFrame([(document_id, text, infon)], "id string, text string, infon array<struct<_key:string,_VALUE:string>>")
    passage = F.struct(F.col("infon"), F.lit("0").alias("offset"), "text", F.array().cast(_NO_ANNOTATIONS).alias("annotation"))
    return row.select("id", F.array().cast(schemas.INFONS).alias("infon"), F.array(passage).cast(f"array<{schemas.PASSAGE}>").alias("passage"))


def _annotation(number: Column, prefix: str, infons: Column) -> Column:
    location = F.array(F.struct((F.col("end") - F.col("start")).cast("string").alias("_length"), F.col("start").cast("string").alias("_offset")))
    return F.struct(F.concat(F.lit(prefix), number).alias("_id"), I.to_xml(infons).alias("infon"), location.alias("location"), F.col("text").alias("text")).cast(schemas.ANNOTATION)


def _with_annotations(docs: DataFrame, made: DataFrame, keep: bool) -> DataFrame:
    """Puts annotation lists (source_path, doc_idx, passage_id, made) into the documents' passages."""
    by_doc = made.groupBy("source_path", "doc_idx").agg(F.map_from_entries(F.collect_list(F.struct("passage_id", "made"))).alias("_m"))
    joined = docs.join(by_doc, ["source_path", "doc_idx"], "left")
    none = F.array().cast(_NO_ANNOTATIONS)

    def one(p: Column, i: Column) -> Column:
        old = F.coalesce(p["annotation"], none) if keep else none
        new = F.coalesce(F.try_element_at(F.col("_m"), i), none)
        return F.struct(p["infon"].alias("infon"), p["offset"].alias("offset"), p["text"].alias("text"), F.concat(old, new).alias("annotation")).cast(schemas.PASSAGE)

    return joined.withColumn("passage", F.transform("passage", one)).drop("_m")


def _keys(table: DataFrame) -> list[str]:
    """What tells documents apart: their place in their file, if the table knows it, else their id, which may repeat."""
    return ["source_path", "doc_idx"] if {"source_path", "doc_idx"} <= set(table.columns) else ["document_id"]


def with_predictions(docs: DataFrame, predicted: DataFrame, clear: bool = True, model: str | None = None, order: Sequence[str] = ("start", "end", "label")) -> DataFrame:
    """Writes predictions (document_id, passage_id, start, end, label, text, score, and infons if they have any) into passages.

    A prediction with source_path and doc_idx goes to that document; else to every document of its id, and with the
    id '' to every document. `order` names the columns that give the order of the input. Ids run from T0 over all."""
    p = bioc.passages(docs).select("source_path", "doc_idx", "document_id", "passage_id")
    if _keys(predicted) != ["document_id"]:
        hit = p.drop("document_id").join(predicted, ["source_path", "doc_idx", "passage_id"])
    else:
        own = p.join(predicted.filter("document_id <> ''"), ["document_id", "passage_id"])
        wild = p.join(predicted.filter("document_id = ''").drop("document_id"), "passage_id")
        hit = own.unionByName(wild)
    # those of the document's own id stand first
    hit = hit.withColumn("_wild", F.lit(False) if "document_id" not in hit.columns else F.col("document_id") == "")
    hit = filters.numbered(hit, ["source_path", "doc_idx", "passage_id", "_wild", *order], "_n")
    entry = lambda k, v: F.array(F.struct(F.lit(k).alias("key"), v.alias("value")))
    none = F.array().cast(schemas.KEY_VALUES)
    more = F.filter(F.coalesce("infons", none), lambda x: x["key"] != "type") if "infons" in predicted.columns else none
    infons = F.concat(entry("type", F.col("label")), entry("model", F.lit(model)) if model else none, more, F.when(F.col("score").isNotNull(), entry("score", X.significant("score"))).otherwise(none))
    made = hit.select("source_path", "doc_idx", "passage_id", "_n", _annotation(F.col("_n"), "T", infons).alias("a"))
    lists = made.groupBy("source_path", "doc_idx", "passage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "a"))), lambda x: x["a"]).alias("made"))
    return _with_annotations(docs, lists, keep=not clear)


def with_contained(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Replaces annotations by entities (start, end, label, text) in every passage of their document that contains them,
    sorted by start, end and label, ids from T1 over all. Documents are told apart by source_path and doc_idx where the
    entities have them, else by document_id."""
    from mentionlake.operators.decode import contained

    key = ["source_path", "doc_idx"]
    p = bioc.passages(docs).select(*key, "passage_id", "passage_offset", "text")
    if _keys(entities) != key:
        entities = entities.join(docs.select(*key, F.coalesce("id", F.lit("")).alias("document_id")), "document_id")
    hit = contained(entities.select(*key, "start", "end", "label", F.col("text").alias("e_text")), p, key)
    hit = hit.withColumnRenamed("e_text", "text")
    hit = filters.numbered(hit, ["source_path", "doc_idx", "passage_id", "start", "end", "label"], "_n")
    made = hit.select("source_path", "doc_idx", "passage_id", "_n", _annotation(F.col("_n") + 1, "T", F.array(F.struct(F.lit("type").alias("key"), F.col("label").alias("value")))).alias("a"))
    lists = made.groupBy("source_path", "doc_idx", "passage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "a"))), lambda x: x["a"]).alias("made"))
    return _with_annotations(docs, lists, keep=False)


#: What the best candidate may say of its abbreviation, and the key it is written under.
DETAILS = [("abbreviation_method", "abbreviation_method"), ("expanded_long_form", "expanded_long_form"), ("long_form_method", "ab3p_method"), ("long_form_key", "ab3p_matched_key"), ("long_form_score", "ab3p_match_score")]


def with_links(docs: DataFrame, results: DataFrame, model: str) -> DataFrame:
    """Writes ranked candidates into annotations: `results` document_key, normalized_text, rank, identifier, preferred_label,
    name, final_score, embedding_score, source, and `DETAILS` where known. Present keys change in place, new entries stand
    in front of old ones, the last first."""
    own = [c for c, _ in DETAILS if c in results.columns]
    per = results.groupBy("document_key", "normalized_text").agg(F.array_sort(F.collect_list(F.struct("rank", "identifier", "preferred_label", "name", "final_score", "embedding_score", "source", *own))).alias("c"))
    hit = bioc.linkable(docs).join(per, ["document_key", "normalized_text"])
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    named = lambda what, x: F.concat(F.lit(f"{model}_{what}_"), x["rank"].cast("string"))
    ranks = F.flatten(F.transform("c", lambda x: F.array(
        pair(named("id", x), x["identifier"]), pair(named("identifier_name", x), x["preferred_label"]), pair(named("matched_alias", x), x["name"]),
        pair(named("identifier_score", x), X.score_text(x["final_score"])), pair(named("embedding_score", x), X.score_text(x["embedding_score"])),
    )))
    best = F.get("c", F.lit(0))
    value = lambda c: X.score_text(best[c]) if c == "long_form_score" else F.nullif(best[c], F.lit(""))
    details = F.filter(F.array(pair(F.lit(f"{model}_match_source"), best["source"]), *[pair(F.lit(f"{model}_{k}"), F.when(best[c].isNotNull(), value(c))) for c, k in DETAILS if c in own]), lambda x: x["value"].isNotNull())
    new = F.concat(F.array(pair(F.lit(f"{model}_normalized_text"), F.col("normalized_text"))), ranks, details)
    merged = I.upsert_all("infons", new)
    by = hit.select("source_path", "doc_idx", F.struct("passage_id", "ann_idx").alias("k"), merged.alias("i"))
    by = by.groupBy("source_path", "doc_idx").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "k.passage_id", "k.ann_idx"), I.to_xml("i")))).alias("_m"))

    def one(p: Column, i: Column) -> Column:
        def ann(a: Column, j: Column) -> Column:
            found = F.try_element_at(F.col("_m"), F.concat_ws(":", i, j))
            return F.struct(a["_id"].alias("_id"), F.coalesce(found, a["infon"]).alias("infon"), a["location"].alias("location"), a["text"].alias("text")).cast(schemas.ANNOTATION)

        return F.struct(p["infon"].alias("infon"), p["offset"].alias("offset"), p["text"].alias("text"), F.transform(p["annotation"], ann).alias("annotation")).cast(schemas.PASSAGE)

    return docs.join(by, ["source_path", "doc_idx"], "left").withColumn("passage", F.transform("passage", one)).drop("_m")


def cleaned(docs: DataFrame) -> DataFrame:
    """Drops predicted entries of all annotations and keeps the gold identifier."""

    def ann(a: Column) -> Column:
        return F.struct(a["_id"].alias("_id"), I.to_xml(I.clean_for_linking(I.from_xml(a["infon"]))).alias("infon"), a["location"].alias("location"), a["text"].alias("text")).cast(schemas.ANNOTATION)

    def one(p: Column) -> Column:
        return F.struct(p["infon"].alias("infon"), p["offset"].alias("offset"), p["text"].alias("text"), F.transform(p["annotation"], ann).alias("annotation")).cast(schemas.PASSAGE)

    return docs.withColumn("passage", F.transform("passage", one))


def next_annotation_id(docs: DataFrame, prefix: str = "T") -> int:
    """One more than the largest number after the prefix; other ids are ignored."""
    top = bioc.annotations(docs).agg(F.max(F.regexp_extract("ann_id", rf"^{prefix}(\d+)$", 1).try_cast("int"))).first()[0]
    return 0 if top is None else top + 1


def passage_jsonl(docs: DataFrame, key: str = "record_id", with_entities: bool = True) -> DataFrame:
    """Passage rows as JSON lines (column value): entities and infons only where there are any."""
    p = bioc.passages(docs)
    s = bioc.spans(docs).groupBy("source_path", "doc_idx", "passage_id").agg(F.array_sort(F.collect_list(F.struct("ann_idx", F.struct("start", "end", "label", "text", "score").alias("e")))).alias("_e"))
    out = p.join(s, ["source_path", "doc_idx", "passage_id"], "left") if with_entities else p.withColumn("_e", F.lit(None).cast("array<struct<ann_idx:int,e:struct<start:int>>>"))
    rows = out.select(F.col("record_id").alias(key), "document_id", "passage_id", "passage_offset", "text", I.as_map("infons").alias("infons"), F.transform("_e", lambda x: x["e"]).alias("entities"))
    return rows.select(filters.compact(rows).alias("value"))


def write_passages(docs: DataFrame, path: str, key: str = "id", with_entities: bool = True) -> int:
    """Passages with a text as JSON lines under a folder; how many they are."""
    rows = passage_jsonl(docs, key, with_entities)
    rows.write.mode("errorifexists").text(path)
    return docs.sparkSession.read.text(path).count()


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as compact JSON lines."""
    df.select(filters.compact(df).alias("value")).write.mode("errorifexists").text(path)


def write_predictions(df: DataFrame, folder: str) -> None:
    """Predictions as JSON lines (predictions.jsonl) and as files that are a JSON array each (predictions.json)."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.mode("errorifexists").text(os.path.join(folder, "predictions.jsonl"))

    def array(batches):
        before = "["
        for batch in batches:
            lines = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([(before if not i else ",") + x for i, x in enumerate(lines)], pa.string())], names=["value"])
            before = "," if lines else before
        yield pa.RecordBatch.from_arrays([pa.array([("[" if before == "[" else "") + "]"])], names=["value"])

    rows.mapInArrow(array, "value string").write.mode("errorifexists").text(os.path.join(folder, "predictions.json"))


def write_resource(concepts: DataFrame, path: str) -> None:
    """Concept records in order of their id, keys sorted, nulls written."""
    key = "norm_concept_id" if "norm_concept_id" in concepts.columns else concepts.columns[0]
    concepts.select(key, F.to_json(F.struct(*sorted(concepts.columns)), {"ignoreNullFields": "false"}).alias("value")).orderBy(key).select("value").write.mode("errorifexists").text(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select("text_a", "text_b").write.mode("errorifexists").option("sep", "\t").option("header", True).csv(path)


#: Order of the fields of metric tables; further columns follow.
METRIC_FIELDS = ("dataset", "system", "task", "criterion", "tp", "fp", "fn", "precision", "recall", "f1")


def write_metrics(rows: DataFrame, path: str, fields: Sequence[str] = METRIC_FIELDS) -> None:
    """Metrics as CSV: the known fields in their order, others behind."""
    some = [c for c in fields if c in rows.columns]
    rows.select(*some, *[c for c in rows.columns if c not in some]).write.mode("errorifexists").option("header", True).csv(path)


def union_rows(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of several tables: all their columns in the order in which they are first seen, null where a table lacks one."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def pubtator_lines(passages: DataFrame, annotations: DataFrame) -> DataFrame:
    """PubTator text: title and abstract lines, then annotation lines, by document."""
    head = passages.select("document_id", F.lit(0).alias("o"), "passage_id", F.lit(0).alias("s"), F.concat(F.col("document_id"), F.when(F.col("passage_id") == 0, "|t|").otherwise("|a|"), F.translate("text", "\n\t", "  ")).alias("value"))
    body = annotations.select("document_id", F.lit(1).alias("o"), "passage_id", F.col("start").alias("s"), F.concat_ws("\t", "document_id", F.col("start").cast("string"), F.col("end").cast("string"), "text", "label").alias("value"))
    return head.union(body).orderBy("document_id", "o", "passage_id", "s").select("value")


def folder_digest(path: str) -> str:
    """SHA-256 over the names and contents of a file or folder."""
    h = hashlib.sha256()
    files = [path] if os.path.isfile(path) else sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)
    for f in files:
        h.update(os.path.relpath(f, path).encode() if f != path else b"")
        with open(f, "rb") as r:
            for part in iter(lambda: r.read(1 << 20), b""):
                h.update(part)
    return h.hexdigest()


def write_manifest(path: str, **facts) -> None:
    """A JSON sidecar with the time in UTC."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"created_utc": datetime.now(timezone.utc).isoformat(), **facts}, f, indent=2, sort_keys=True)

