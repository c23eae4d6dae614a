"""From raw documents to packed sequences: five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm import langid, mixing, packing, quality_rules, simhash
from mentionlake.llm._spark import fresh, shared_folder
from mentionlake.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; what the model rejects goes, and so do null, empty and letterless texts.

    The model learns from rows that have a lang; where none has, nothing can be told and an error is raised, unless
    the table is empty and so is the result. Rows that repeat a doc_id, or lack one, are judged each by their own
    text; other columns pass through, whatever their names."""
    model = langid.fit(docs)
    if model is None and docs.limit(1).count():
        raise ValueError("no row has both a text and a lang to learn from")
    (name,) = fresh(docs, "language")
    return langid.identify(docs, model, out=name).filter(~F.col(name)["rejected"]).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the repetition rules. Null, empty and very short texts fail; a long text is measured
    whole. Each row is judged on its own, so repeated rows fare alike; an empty table gives an empty table; other
    columns pass through, whatever their names."""
    (name,) = fresh(docs, "rules")
    return quality_rules.quality_rules(docs, out=name).filter(F.col(name)["kept"]).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the smallest doc_id (null last; of several with
    that id, that with the smallest digest of its text). Nulls, repeated rows and clashes: see `simhash.deduplicate`."""
    return simhash.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins out sources to their target weights in whole documents: a row per repetition. A null source is
    a source of its own; texts without words are left out. Ties, repeated rows and clashes: see `mixing.mixed_whole`."""
    return mixing.mixed_whole(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixture's tokens: a row per piece. Every repetition of a document is packed on its own. Nulls, very
    long texts, ties and empty tables: see `packing.pack`."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("source_mixing", mixture),
    ("best_fit_packing", sequences),
]

#: Two stages rest on trained or hashed decisions that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
