"""Recognition, linking and extraction as one API over DataFrames and files."""

from __future__ import annotations

import os
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.encoders import Encoder, HashingEncoder, encode
from mentionlake.functions import text as X
from mentionlake.operators import abbreviations as A
from mentionlake.operators import decode, filters, linking
from mentionlake.sources import bioc, resources, workspace, writers
from mentionlake.taggers import GazetteerTagger, Tagger, tag, tags

LONG_FORM_K, LONG_FORM_TOPN = 50, 5


@dataclass
class PipelineConfig:
    ontology_path: str
    abbreviations_path: str | Sequence[str] | None = None
    disable_abbreviations: bool = False
    namespaces: Sequence[str] | None = None
    encoder: Encoder = field(default_factory=HashingEncoder)
    tagger: Tagger | None = None
    model_label: str = "link"
    window: int = 510
    stride: int = 128
    weights: dict[str, float] = field(default_factory=lambda: dict(linking.WEIGHTS))


def model_label(reference: str, known: Sequence[tuple[str, str]] = ()) -> str:
    """Prefix of a model's infons: that of the first known name which the reference contains, whatever the case, else the
    last part of its path with dashes for underscores."""
    low = reference.lower()
    return next((label for part, label in known if part.lower() in low), (os.path.basename(reference.rstrip("/")) or reference).replace("_", "-"))


class Pipeline:
    """Lazy plans; resources are read once and kept."""

    def __init__(self, spark: SparkSession, config: PipelineConfig):
        self.spark, self.config = spark, config
        terms = resources.read_ontology(spark, config.ontology_path, config.namespaces)
        self.concepts = resources.concept_metadata(terms)
        self.terms = encode(terms, config.encoder, "name", "vector").cache()
        off = config.disable_abbreviations or not config.abbreviations_path
        self.abbreviations = None if off else A.lookup(resources.read_abbreviations(spark, config.abbreviations_path)).cache()

    def _tagger(self) -> Tagger:
        if self.config.tagger is None:
            # names of one ontology: bounded by the resource, not by the corpus
            self.config.tagger = GazetteerTagger([r[0] for r in self.terms.select("raw_name").distinct().collect()])
        return self.config.tagger

    # recognition

    def recognize(self, passages: DataFrame) -> DataFrame:
        """Entities of passages (document_id, passage_id, passage_offset, text): absolute start and end, label, text. Passages
        that know their file keep source_path and doc_idx, so that documents of one id stay apart."""
        tagger = self._tagger()
        keys = [*[c for c in ("source_path", "doc_idx") if "doc_idx" in passages.columns], "document_id", "passage_id"]
        scored = tag(passages.select(*keys, "text"), tagger, self.config.window, self.config.stride)
        spans = decode.decode(tags(scored, tagger, keys), keys)
        out = spans.join(passages.select(*keys, "passage_offset", F.col("text").alias("_t")), keys)
        out = out.withColumn("text", F.expr("substring(_t, start + 1, end - start)")).drop("_t").withColumn("score", F.lit(None).cast("double"))
        return filters.to_absolute(out)

    def warm_up(self, text: str = "A short text to start with.", runs: int = 1) -> None:
        """Runs recognition a few times, so that workers have loaded their models before anything is timed."""
        for _ in range(runs):
            self.recognize_text(text).count()

    def recognize_text(self, text: str, document_id: str = "doc0") -> DataFrame:
        return self.recognize(bioc.string_passage(self.spark, text, document_id))

    def recognize_bioc(self, input_xml: str, output_xml: str, overwrite: bool = True) -> DataFrame:
        """Annotates every passage that contains an entity, and writes the documents."""
        self._may_write(output_xml, overwrite)
        docs = bioc.read_xml(self.spark, input_xml)
        p = bioc.nonempty_passages(docs)
        out = writers.with_contained(docs, self.recognize(p))
        self._write(out, output_xml, self._head(input_xml))
        return bioc.annotations(bioc.read_xml(self.spark, output_xml))

    # linking

    def link(self, mentions: DataFrame, topn: int = 1, texts: DataFrame | None = None) -> DataFrame:
        """Candidates of distinct (document_key, mention_text): direct abbreviations, ambiguous ones by their document's
        long form, and dense linking for the rest. `texts`: document_key, text."""
        m = mentions.select(F.coalesce("document_key", F.lit("")).alias("document_key"), "mention_text").distinct()
        m = m.withColumn("normalized_text", X.normalize_text("mention_text"))
        details = ["abbreviation_method", "expanded_long_form", "long_form_method", "long_form_key", "long_form_score"]
        cols = ["document_key", "mention_text", "normalized_text", "rank", "identifier", "name", "preferred_label", "embedding_score", "final_score", "source", *details]
        if self.abbreviations is None:
            return self._dense(m, topn, "model_normal").select(*cols)
        empty = self.spark.createDataFrame([], "document_key string, short_key string, long_form string")
        forms = A.document_long_forms(texts) if texts is not None else empty
        r = workspace.table(A.resolve(m, self.abbreviations, forms, self.config.encoder).join(m, ["document_key", "mention_text"]))
        hit = r.filter("resolution = 'direct'").join(self.concepts.select("identifier", F.col("preferred_label").alias("_label")), "identifier", "left")
        direct = hit.select(
            "document_key", "mention_text", "normalized_text", F.lit(0).alias("rank"), "identifier", F.col("short_form").alias("name"),
            F.coalesce(F.nullif("_label", F.lit("")), "short_form").alias("preferred_label"), F.col("key_score").alias("embedding_score"), F.col("key_score").alias("final_score"), F.lit("abbreviation_direct").alias("source"),
            F.col("method").alias("abbreviation_method"), *[F.lit(None).cast(t).alias(c) for c, t in zip(details[1:], ("string", "string", "string", "double"))],
        )
        long_ = r.filter("resolution = 'ambiguous_long_form'")
        told = long_.select("document_key", "mention_text", F.col("method").alias("abbreviation_method"), *details[1:])
        via = self._dense(long_.withColumn("query_text", X.normalize_text("expanded_long_form")), LONG_FORM_TOPN, "abbreviation_ambiguous_via_long_form", LONG_FORM_K).filter(F.col("rank") < topn)
        via = via.drop(*details).join(told, ["document_key", "mention_text"])
        rest = r.filter("resolution is null or resolution = 'ambiguous_unresolved'")
        return direct.select(*cols).unionByName(via.select(*cols)).unionByName(self._dense(rest, topn, "model_normal").select(*cols))

    def _dense(self, m: DataFrame, topn: int, source: str, initial_k: int | None = None) -> DataFrame:
        if "query_text" not in m.columns:
            m = m.withColumn("query_text", F.col("normalized_text"))
        found = linking.link_texts(m, self.terms, self.concepts, self.config.encoder, topn, initial_k, self.config.weights)
        return m.select("document_key", "mention_text", "normalized_text", "query_text").join(found.drop("query_text").join(m.select("query_text").distinct().withColumn("query_idx", F.xxhash64("query_text")), "query_idx"), "query_text").withColumns({"source": F.lit(source), **{c: F.lit(None).cast("double" if c == "long_form_score" else "string") for c in ("abbreviation_method", "expanded_long_form", "long_form_method", "long_form_key", "long_form_score")}})

    def normalize_mentions(self, mentions: Sequence[Any] | DataFrame, document_text: str | None = None, topn: int = 1) -> DataFrame:
        """Candidates of strings, dicts or rows; a document text lends its abbreviations to mentions without document."""
        if not isinstance(mentions, DataFrame):
            rows = [{"mention": x} if isinstance(x, str) else {k: v for k, v in dict(x).items() if v is not None} for x in mentions]
            names = sorted({k for r in rows for k in r} | {"mention"})
            mentions = self.spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))
        m = filters.coerce_mentions(mentions).select(F.coalesce("document_id", F.lit("")).alias("document_key"), F.col("mention").alias("mention_text"))
        texts = self.spark.createDataFrame([("", document_text)], "document_key string, text string") if document_text else None
        return self.link(m, topn, texts)

    def normalize_bioc(self, input_xml: str, output_xml: str, topn: int = 1, overwrite: bool = True) -> DataFrame:
        """Links every annotation that can be linked and writes the candidates into it."""
        self._may_write(output_xml, overwrite)
        docs = bioc.read_xml(self.spark, input_xml)
        wanted = bioc.linkable(docs).select("document_key", F.col("normalized_text").alias("mention_text")).distinct()
        wanted = workspace.table(wanted)
        began, unique = time.perf_counter(), wanted.count()
        found = workspace.table(self.link(wanted, topn, bioc.document_texts(docs)).withColumn("normalized_text", F.col("mention_text")))
        label = self.config.model_label
        facts = [("normalization_model", label), ("normalization_unique_mentions", str(unique)), ("normalization_elapsed_seconds", f"{time.perf_counter() - began:.6f}")]
        self._write(writers.with_links(docs, found, label), output_xml, self._head(input_xml), facts)
        return bioc.predictions(bioc.read_xml(self.spark, output_xml))

    # extraction

    def extract(self, passages: DataFrame) -> DataFrame:
        """Linked entities of passages: document_id, passage_index, mention, start, end, entity_type, cl_id, cl_label, score, source."""
        found = workspace.table(self.recognize(passages))
        texts = passages.groupBy(F.col("document_id").alias("document_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("passage_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
        linked = self.link(found.select(F.col("document_id").alias("document_key"), F.col("text").alias("mention_text")), 1, texts).filter("rank = 0")
        joined = found.join(linked.select(F.col("document_key").alias("document_id"), F.col("mention_text").alias("text"), "identifier", F.col("preferred_label").alias("cl_label"), F.col("final_score").alias("_s"), "source"), ["document_id", "text"], "left")
        return joined.select(
            "document_id", F.col("passage_id").alias("passage_index"), F.col("text").alias("mention"), "start", "end", F.col("label").alias("entity_type"),
            F.col("identifier").alias("cl_id"), "cl_label", F.col("_s").alias("score"), "source",
        )

    def extract_text(self, text: str, document_id: str = "doc0") -> DataFrame:
        return self.extract(bioc.string_passage(self.spark, text, document_id).filter("trim(text) <> ''"))

    def extract_text_file(self, path: str) -> DataFrame:
        return self.extract(bioc.text_passages(self.spark, path))

    def extract_bioc(self, input_xml: str, output_xml: str, topn: int = 1, overwrite: bool = True) -> DataFrame:
        """Recognition, then linking of what was recognised; both in the written documents."""
        middle = output_xml.rstrip("/") + ".recognized"
        self._may_write(output_xml, overwrite)
        self.recognize_bioc(input_xml, middle)
        return self.normalize_bioc(middle, output_xml, topn, overwrite)

    @staticmethod
    def _may_write(path: str, overwrite: bool) -> None:
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)

    def _head(self, path: str) -> tuple[dict[str, str], list[tuple[str, str]]]:
        return bioc.read_head(self.spark, bioc.input_files(path)[0])

    @staticmethod
    def _write(docs: DataFrame, path: str, head: tuple[dict, list], facts: Sequence[tuple[str, str]] = ()) -> None:
        """The documents under their collection's head; facts change its infons in place or stand in front of them."""
        fields, infons = head
        for k, v in facts:
            at = next((i for i, x in enumerate(infons) if x[0] == k), None)
            infons = [(k, v), *infons] if at is None else [*infons[:at], (k, v), *infons[at + 1 :]]
        writers.write_xml(docs, path, "overwrite", fields, infons)
