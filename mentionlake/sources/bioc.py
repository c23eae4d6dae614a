"""Scans of document-structured XML, JSONL and plain text into passage and annotation tables."""

from __future__ import annotations

import html
import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionlake import schemas
from mentionlake.functions import infons as I
from mentionlake.functions import text as X


#: Documents that are numbered together.
SPAN = 100_000


def input_files(paths: str | Sequence[str]) -> list[str]:
    """Files of a mix of files and folders (folders recursively, sorted, but for hidden files and markers), each
    once, where it first stands; a missing one raises."""
    out = []
    for p in [paths] if isinstance(paths, str) else paths:
        if os.path.isdir(p):
            out += sorted(os.path.join(d, f) for d, _, names in os.walk(p) for f in names if not f.startswith((".", "_")))
        elif os.path.exists(p):
            out.append(p)
        else:
            raise FileNotFoundError(p)
    first: dict[str, str] = {}
    for p in out:
        first.setdefault(os.path.realpath(p), p)
    return list(first.values())


_XML = {"ignoreSurroundingSpaces": "false", "nullValue": "\u0000"}


def read_xml(spark: SparkSession, paths: str | Sequence[str], strip_namespaces: bool = False) -> DataFrame:
    """One row per document in file order: doc_idx, source_path, id, infon, passage. White space in texts stays.

    Files are cut after each closing document tag, so that a large collection is read by many tasks; one whose
    tags carry namespaces is read as a whole."""
    files = input_files(paths)
    if strip_namespaces:
        reader = spark.read.format("xml").options(rowTag="document", ignoreNamespace="true", **_XML)
        docs = reader.schema(schemas.DOCUMENT_XML).load(files).select("*", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_at"))
    else:
        raw = spark.read.text(files, lineSep="</document>").select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_at"))
        one = F.concat(F.regexp_extract("value", r"(?s)<document(?:\s[^>]*)?>.*$", 0), F.lit("</document>"))
        docs = raw.filter(F.col("value").rlike(r"<document[\s>]")).select("source_path", "_at", F.from_xml(one, schemas.DOCUMENT_XML, _XML).alias("d")).select("d.*", "source_path", "_at")
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    # the number inside a file is what identifies a document, since ids may repeat: numbers inside a split, which is
    # read in order, after the rows of the splits before it. Only a row a split moves.
    splits = docs.groupBy("source_path", "_at").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source_path").orderBy("_at")) - F.col("_n")
    starts = splits.select("source_path", "_at", (before - F.col("_first")).alias("_shift"))
    return docs.join(starts, ["source_path", "_at"]).withColumn("doc_idx", (F.col("_row") + F.col("_shift")).cast("int")).drop("_at", "_row", "_shift")


def read_head(spark: SparkSession, path: str) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """A collection's source, date and key, and its own infons, read up to the first document."""
    head = ""
    with open(path, encoding="utf-8", errors="replace") as f:
        while "<document" not in head and (part := f.read(1 << 16)):
            head += part
    head = head.split("<document", 1)[0].split("</collection>", 1)[0]
    unescape = lambda t: html.unescape(t.strip())
    fields = {k: unescape(m[1]) for k in ("source", "date", "key") if (m := re.search(rf"<{k}>(.*?)</{k}>", head, re.S))}
    return fields, [(html.unescape(k), unescape(v)) for k, v in re.findall(r'<infon\s+key="([^"]*)"\s*>(.*?)</infon>', head, re.S)]


def passages(docs: DataFrame) -> DataFrame:
    """One row per passage, empty texts included: record_id runs over all files, passage_id inside a document."""
    flat = docs.select("source_path", "doc_idx", F.coalesce("id", F.lit("")).alias("document_id"), F.posexplode("passage").alias("passage_id", "p"))
    flat = flat.select(
        "source_path",
        "doc_idx",
        "document_id",
        "passage_id",
        X.safe_int(F.col("p.offset")).alias("passage_offset"),
        F.coalesce("p.text", F.lit("")).alias("text"),
        I.from_xml("p.infon").alias("infons"),
        F.coalesce("p.annotation", F.array().cast(f"array<{schemas.ANNOTATION}>")).alias("annotation"),
    )
    return with_record_id(flat)


def with_record_id(flat: DataFrame, name: str = "record_id") -> DataFrame:
    """Running number over files, documents and passages: inside a document, after the passages of the documents
    before. Documents are numbered by a row each, in groups of `SPAN`, so no task sees all of a file's."""
    key = ["source_path", "doc_idx"]
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("passage_id")) - 1
    per = flat.groupBy(*key).agg(F.count("*").alias("_n")).withColumn("_g", F.floor(F.col("doc_idx") / SPAN))
    groups = per.groupBy("source_path", "_g").agg(F.sum("_n").alias("_all"))
    groups = groups.select("source_path", "_g", (F.sum("_all").over(Window.orderBy("source_path", "_g")) - F.col("_all")).alias("_base"))
    start = per.withColumn("_o", F.sum("_n").over(Window.partitionBy("source_path", "_g").orderBy("doc_idx")) - F.col("_n")).join(groups, ["source_path", "_g"])
    start = start.select(*key, (F.col("_base") + F.col("_o")).alias("_start"))
    return flat.withColumn("_in", inside).join(start, key).withColumn(name, F.col("_start") + F.col("_in")).drop("_in", "_start")


def nonempty_passages(docs: DataFrame) -> DataFrame:
    """Passages with a text; passage_id still counts the others, record_id does not."""
    return with_record_id(passages(docs).drop("record_id").filter("length(text) > 0"))


def collection_summary(docs: DataFrame) -> DataFrame:
    n = F.coalesce(F.size("passage"), F.lit(0))
    a = F.aggregate(F.coalesce("passage", F.array().cast(f"array<{schemas.PASSAGE}>")), F.lit(0), lambda s, p: s + F.greatest(F.size(F.coalesce(p["annotation"], F.array().cast(f"array<{schemas.ANNOTATION}>"))), F.lit(0)))
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).alias("passages"), F.coalesce(F.sum(a), F.lit(0)).alias("annotations"))


def _locations(location: Column) -> Column:
    """Sorted valid (offset, length) pairs."""
    pairs = F.transform(F.coalesce(location, F.array().cast(f"array<{schemas.LOCATION}>")), lambda x: F.struct(X.safe_int(x["_offset"], None).alias("offset"), X.safe_int(x["_length"], None).alias("length")))
    return F.array_sort(F.filter(pairs, lambda x: (x["offset"] >= 0) & (x["length"] > 0)))


def _exploded(docs: DataFrame, outer: bool = False) -> DataFrame:
    p = passages(docs)
    keep = [c for c in p.columns if c != "annotation"]
    fn = F.posexplode_outer if outer else F.posexplode
    out = p.select(*keep, fn("annotation").alias("ann_idx", "a"))
    return out.withColumn("ann_infons", I.from_xml("a.infon"))


def annotations(docs: DataFrame) -> DataFrame:
    """Flat annotations with absolute offsets: first location, else the whole passage position; a score that is no number is null."""
    a = _exploded(docs)
    first = F.get("a.location", F.lit(0))
    text = F.coalesce("a.text", F.lit(""))
    start = F.coalesce(X.safe_int(first["_offset"], None), F.col("passage_offset"))
    return a.select(
        "source_path", "doc_idx", "document_id", "passage_id", "passage_offset", "ann_idx",
        F.coalesce("a._id", F.lit("")).alias("ann_id"),
        start.alias("start"),
        (start + F.coalesce(X.safe_int(first["_length"], None), F.length(text))).alias("end"),
        F.coalesce(X.first_nonempty(I.get("ann_infons", "type"), I.get("ann_infons", "label")), F.lit("")).alias("label"),
        text.alias("text"),
        X.safe_double(I.get("ann_infons", "score")).alias("score"),
        F.col("ann_infons").alias("infons"),
    )


def spans(docs: DataFrame) -> DataFrame:
    """Passage-relative spans."""
    a = annotations(docs)
    return a.withColumns({"start": F.col("start") - F.col("passage_offset"), "end": F.col("end") - F.col("passage_offset")})


def entities(docs: DataFrame, overlap_policy: str = "warn") -> DataFrame:
    """One entity per location, relative to its passage; without location, of no length or out of bounds: dropped.
    With several locations ids carry the location's index. ``overlap_policy='error'`` raises on overlaps."""
    a = _exploded(docs)
    n = F.size(F.coalesce("a.location", F.array().cast(f"array<{schemas.LOCATION}>")))
    each = a.withColumn("_n", n).select("*", F.posexplode("a.location").alias("loc_idx", "loc"))
    start = X.safe_int(F.col("loc._offset"), None) - F.col("passage_offset")
    end = start + X.safe_int(F.col("loc._length"), None)
    out = each.select(
        "source_path", "doc_idx", "document_id", "passage_id", "passage_offset", "ann_idx", "loc_idx",
        F.when(F.col("_n") > 1, F.concat_ws(":", F.coalesce("a._id", F.lit("")), F.col("loc_idx"))).otherwise(F.coalesce("a._id", F.lit(""))).alias("ann_id"),
        start.alias("start"), end.alias("end"),
        F.coalesce(X.first_nonempty(I.get("ann_infons", "type"), I.get("ann_infons", "label")), F.lit("Unknown")).alias("label"),
        F.col("text").alias("passage_text"),
    ).filter("start >= 0 and end > start and end <= length(passage_text)")
    out = out.withColumn("text", F.substring("passage_text", F.col("start") + 1, F.col("end") - F.col("start"))).drop("passage_text")
    if overlap_policy == "error":
        w = Window.partitionBy("source_path", "doc_idx", "passage_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
        reach = F.coalesce(F.max("end").over(w), F.lit(-1))
        out = out.withColumn("start", F.when(reach > F.col("start"), F.raise_error(F.lit("overlapping entities"))).otherwise(F.col("start")))
    return out


def passage_key(document_id="document_id", infons="infons", offset="passage_offset") -> Column:
    """Evaluators' key: passage_id, else the article id, else document and offset."""
    return F.coalesce(F.nullif(I.get(infons, "passage_id"), F.lit("")), F.nullif(I.get(infons, "article-id_pmid"), F.lit("")), F.concat_ws(":", F.col(document_id), F.col(offset)))


def document_key(document_id="document_id", infons="infons") -> Column:
    """The linker's key: article id, else document id, else passage_id; none of them is an error."""
    got = F.coalesce(F.nullif(I.get(infons, "article-id_pmid"), F.lit("")), F.nullif(F.col(document_id), F.lit("")), F.nullif(I.get(infons, "passage_id"), F.lit("")))
    return F.coalesce(got, F.raise_error(F.lit("a passage has no document key")).cast("string"))


def mentions(docs: DataFrame, include: Sequence[str] = ("cell_type", "cell_phenotype", "cell_hetero"), exclude: Sequence[str] = ("cell_vague",), need_location: bool = True) -> DataFrame:
    """Evaluation mentions: all valid locations sorted; type from type, entity_type or label; a missing text is cut from
    the passage where the location lies inside it. An empty `include` or `exclude` sets no limit."""
    a = _exploded(docs).withColumn("locations", _locations(F.col("a.location")))
    kind = F.coalesce(X.first_nonempty(*[I.get("ann_infons", k) for k in ("type", "entity_type", "label")]), F.lit("cell_type"))
    one = F.get("locations", F.lit(0))
    at = one["offset"] - F.col("passage_offset")
    cut = F.when((F.size("locations") == 1) & (at >= 0) & (at + one["length"] <= F.length("text")), F.substring(F.col("text"), at + 1, one["length"]))
    out = a.select(
        "source_path", "doc_idx", "document_id", "passage_id", "passage_offset", "ann_idx",
        passage_key().alias("passage_key"), F.col("text").alias("passage_text"), "locations",
        F.trim(F.coalesce(F.nullif(F.trim("a.text"), F.lit("")), cut, F.lit(""))).alias("text"), kind.alias("entity_type"), F.col("ann_infons").alias("infons"),
    )
    low = F.lower("entity_type")
    if include:
        out = out.filter(low.isin([x.lower() for x in include]))
    if exclude:
        out = out.filter(~low.isin([x.lower() for x in exclude]))
    return out.filter(F.size("locations") > 0) if need_location else out


def annotatable(infons: str = "infons") -> Column:
    return ~F.lower(F.trim(F.coalesce(I.get(infons, "annotatable"), F.lit("true")))).isin("false", "0", "no")


def linkable(docs: DataFrame) -> DataFrame:
    """Annotations that the linker takes: annotatable passage, not of the vague type, not blank."""
    a = _exploded(docs).filter(annotatable()).withColumn("document_key", document_key())
    kind, raw = I.get("ann_infons", "type"), F.coalesce("a.text", F.lit(""))
    return a.filter(~kind.eqNullSafe(F.lit("cell_vague")) & (F.trim(raw) != "")).select(
        "source_path", "doc_idx", "document_id", "document_key", "passage_id", "ann_idx", raw.alias("mention_text"), X.normalize_text(raw).alias("normalized_text"), F.col("ann_infons").alias("infons")
    )


def document_texts(docs: DataFrame) -> DataFrame:
    """Text of each document key: passage texts in order, empty ones left out, joined by newlines."""
    p = passages(docs).filter(annotatable()).filter("text <> ''").withColumn("document_key", document_key())
    parts = F.array_sort(F.collect_list(F.struct("source_path", "doc_idx", "passage_id", "text")))
    return p.groupBy("document_key").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def predictions(docs: DataFrame) -> DataFrame:
    """Best prediction written on each annotation: first entries with the rank-0 suffixes."""
    a = annotations(docs)
    return a.select(
        "source_path", "doc_idx", "document_id", F.col("passage_id").alias("passage_index"), F.col("text").alias("mention"), "start", "end", F.col("label").alias("entity_type"),
        I.by_suffix("infons", "_id_0").alias("cl_id"), I.by_suffix("infons", "_identifier_name_0").alias("cl_label"),
        X.safe_double(I.by_suffix("infons", "_identifier_score_0")).alias("score"), I.by_suffix("infons", "_match_source").alias("source"),
    )


def ranked_predictions(docs: DataFrame, model: str, most: int = 10) -> DataFrame:
    """Every rank's prediction of a model on each annotation, with the type, locations and gold identifier."""
    a = _exploded(docs).withColumn("locations", _locations(F.col("a.location")))
    base = a.select(
        "source_path", "document_id", passage_key().alias("passage_key"), "doc_idx", "passage_id", "ann_idx", "locations",
        F.coalesce(I.get("ann_infons", "type"), F.lit("")).alias("entity_type"), I.get("ann_infons", "identifier").alias("identifier"), F.col("ann_infons").alias("_i"),
        F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("rank"),
    )
    at = lambda name: F.try_element_at(F.filter("_i", lambda x: x["key"] == F.concat(F.lit(f"{model}_{name}_"), F.col("rank"))), F.lit(-1))["value"]
    return base.select("*", F.trim(at("id")).alias("pred_id"), at("identifier_score").alias("score_text")).drop("_i")


def text_passages(spark: SparkSession, path: str) -> DataFrame:
    """Each plain text file as one passage at offset 0."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    t = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source_path"))
    name = F.regexp_extract("source_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return t.select(name.alias("document_id"), F.lit(0).alias("passage_id"), F.lit(0).alias("passage_offset"), "text", "source_path", F.lit(0).cast("bigint").alias("record_id"))


def string_passage(spark: SparkSession, text: str, document_id: str = "doc0") -> DataFrame:
    if not isinstance(text, str):
        raise TypeError("text must be a string")
    return spark.createDataFrame([(document_id, 0, 0, text, "", 0)], "document_id string, passage_id int, passage_offset int, text string, source_path string, record_id bigint")


def pubtator(spark: SparkSession, path: str, types: Sequence[str] | None = None) -> DataFrame:
    """Annotation lines of a tab-separated PubTator file; titles and abstracts bound the offsets."""
    raw = spark.read.text(path)
    head = raw.select(F.regexp_extract("value", r"^([^|\t]+)\|([ta])\|(.*)$", 1).alias("document_id"), F.regexp_extract("value", r"^([^|\t]+)\|([ta])\|(.*)$", 2).alias("k"), F.regexp_extract("value", r"^([^|\t]+)\|([ta])\|(.*)$", 3).alias("t")).filter("document_id <> ''")
    text = head.groupBy("document_id").agg(F.concat_ws(" ", F.max(F.when(F.col("k") == "t", F.col("t"))), F.max(F.when(F.col("k") == "a", F.col("t")))).alias("_text"))
    f = F.split("value", "\t")
    rows = raw.filter(F.size(f) >= 5).select(f[0].alias("document_id"), X.safe_int(f[1], None).alias("start"), X.safe_int(f[2], None).alias("end"), f[3].alias("text"), f[4].alias("entity_type"), F.get(f, F.lit(5)).alias("identifier"))
    if types:
        rows = rows.filter(F.lower("entity_type").isin([t.lower() for t in types]))
    return rows.join(text, "document_id", "left").filter("start >= 0 and end > start and (_text is null or end <= length(_text))").drop("_text")


def text_units(sentences: DataFrame, passage_rows: DataFrame) -> DataFrame:
    """Sentences where a passage has them, else the passage; a sentence without text runs to the next one's offset."""
    w = Window.partitionBy("document_id", "passage_id").orderBy("offset")
    s = sentences.withColumn("_next", F.lead("offset").over(w)).join(passage_rows.select("document_id", "passage_id", F.col("text").alias("_p"), "passage_offset"), ["document_id", "passage_id"])
    at = F.col("offset") - F.col("passage_offset")
    cut = F.expr("substring(_p, int(offset - passage_offset + 1), int(coalesce(_next - offset, length(_p) - (offset - passage_offset))))")
    own = s.select("document_id", "passage_id", F.lit("sentence").alias("container"), F.coalesce(F.nullif("text", F.lit("")), F.rtrim(cut)).alias("text"), F.col("offset").alias("base_offset")).filter(at.isNotNull())
    rest = passage_rows.join(sentences.select("document_id", "passage_id").distinct(), ["document_id", "passage_id"], "left_anti")
    return own.unionByName(rest.select("document_id", "passage_id", F.lit("passage").alias("container"), "text", F.col("passage_offset").alias("base_offset")))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema else reader).json(path)
