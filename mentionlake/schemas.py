"""Schemas of the document model, in one place."""

from __future__ import annotations

from pyspark.sql import types as T


def _parse(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


INFON = "struct<_key:string,_VALUE:string>"
INFONS = f"array<{INFON}>"
LOCATION = "struct<_length:string,_offset:string>"
ANNOTATION = f"struct<_id:string,infon:{INFONS},location:array<{LOCATION}>,text:string>"
PASSAGE = f"struct<infon:{INFONS},offset:string,text:string,annotation:array<{ANNOTATION}>>"
#: One row of a BioC XML scan.
DOCUMENT_XML = f"id string, infon {INFONS}, passage array<{PASSAGE}>"

#: Ordered infons: the order is observable, so an array and not a map.
KEY_VALUES = "array<struct<key:string,value:string>>"
SPAN = "struct<start:int,end:int,label:string,text:string,score:double,infons:map<string,string>>"
PASSAGES = "document_id string, passage_id int, passage_offset int, text string, infons map<string,string>, source_path string, record_id bigint"
ENTITIES = "document_id string, passage_id int, start int, end int, label string, text string, score double"
TERMS = "term_idx bigint, name string, raw_name string, identifier string, preferred_label string, is_preferred boolean"
CONCEPTS = "identifier string, preferred_label string, namespace string, synonyms array<string>, names array<string>"
ABBREVIATIONS = "key string, short_form string, identifier string, line_no bigint"
MENTIONS = "document_key string, mention_text string"
CANDIDATES = (
    "document_key string, mention_text string, normalized_text string, rank int, identifier string, name string, preferred_label string, "
    "embedding_score double, final_score double, source string"
)
ONTOLOGY_JSON = "norm_concept_id string, norm_preferred_label string, synonyms array<string>, namespace string, alt_ids array<string>, definition string, parents array<string>"
METRICS = "dataset string, system string, task string, criterion string, tp bigint, fp bigint, fn bigint, precision double, recall double, f1 double"
