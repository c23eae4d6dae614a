"""Ontology, abbreviation, alias and training-pair sources."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionlake import schemas
from mentionlake.functions import text as X


def _here(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def _numbered(raw: DataFrame, name: str = "line") -> DataFrame:
    """Adds each row's number in the order of the files' paths and of their lines. A scan packs files and splits into
    tasks by size, so a running number over tasks alone follows neither; only a row a split is counted apart."""
    seen = raw.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"))
    splits = seen.groupBy("_path", "_at").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    shift = (F.sum("_n").over(Window.orderBy("_path", "_at")) - F.col("_n") - F.col("_first")).alias("_shift")
    return seen.join(F.broadcast(splits.select("_path", "_at", shift)), ["_path", "_at"]).withColumn(name, F.col("_row") + F.col("_shift")).drop("_path", "_at", "_row", "_shift")


def ontology_terms(concepts: DataFrame, namespaces: Sequence[str] | None = None) -> DataFrame:
    """Terms of concept rows (norm_concept_id, norm_preferred_label, synonyms, namespace, line): the label first, then
    synonyms in order, none merged. Rows without id or label are skipped."""
    rows = concepts.filter("coalesce(trim(norm_concept_id), '') <> '' and coalesce(trim(norm_preferred_label), '') <> ''")
    if namespaces:
        rows = rows.filter(F.col("namespace").isin([namespaces] if isinstance(namespaces, str) else list(namespaces)))
    names = F.concat(F.array("norm_preferred_label"), F.coalesce("synonyms", F.array().cast("array<string>")))
    flat = rows.select("line", F.col("norm_concept_id").alias("identifier"), F.col("norm_preferred_label").alias("preferred_label"), "namespace", F.posexplode(names).alias("pos", "raw_name"))
    flat = flat.filter("coalesce(trim(raw_name), '') <> ''")
    return flat.select((F.col("line") * 65536 + F.col("pos")).alias("term_idx"), X.normalize_text("raw_name").alias("name"), "raw_name", "identifier", "preferred_label", (F.col("pos") == 0).alias("is_preferred"), "namespace")


def read_ontology(spark: SparkSession, path: str, namespaces: Sequence[str] | None = None) -> DataFrame:
    """Strict JSONL: malformed lines and synonyms that are no list fail the read; blank lines are skipped."""
    raw = spark.read.schema(schemas.ONTOLOGY_JSON).option("mode", "FAILFAST").json(_here(path))
    return ontology_terms(_numbered(raw), namespaces)


def concept_metadata(terms: DataFrame) -> DataFrame:
    """One row per concept: first label and namespace; all synonyms and names."""
    return terms.groupBy("identifier").agg(
        F.min_by("preferred_label", "term_idx").alias("preferred_label"),
        F.min_by("namespace", "term_idx").alias("namespace"),
        F.array_sort(F.collect_set(F.when(~F.col("is_preferred"), F.col("raw_name")))).alias("synonyms"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("raw_name", "preferred_label"))))).alias("names"),
    )


ABBREVIATION_HEADER = ("short_form", "matched_cl_id")


def is_abbreviation_file(path: str) -> bool:
    """A .tsv whose first line that isn't blank starts with the two header cells."""
    if not path.endswith(".tsv") or not os.path.isfile(path):
        return False
    with open(path, encoding="utf-8") as f:
        first = next((x for x in f if x.strip()), "")
    return tuple(c.strip() for c in first.rstrip("\n").split("\t")[:2]) == ABBREVIATION_HEADER


def read_abbreviations(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Rows (short_form, identifier, line_no) of abbreviation files; other files add none. A header is one on a file's
    first line alone: further down such a row is data."""
    good = [p for p in ([paths] if isinstance(paths, str) else paths) if is_abbreviation_file(p)]
    if not good:
        return spark.createDataFrame([], "short_form string, identifier string, line_no bigint")
    f = F.split("value", "\t")
    raw = _numbered(spark.read.text(good).select("value", "_metadata"), "line_no").select("value", "line_no", F.col("_metadata.file_path").alias("file"))
    first = raw.groupBy("file").agg(F.min("line_no").alias("line_no")).withColumn("first", F.lit(True))  # a row a file
    rows = raw.filter("trim(value) <> ''").join(F.broadcast(first), ["file", "line_no"], "left").withColumns({"short_form": f[0], "identifier": F.get(f, F.lit(1))})
    head = F.coalesce("first", F.lit(False)) & (F.trim("short_form") == ABBREVIATION_HEADER[0]) & F.coalesce(F.trim("identifier") == ABBREVIATION_HEADER[1], F.lit(False))
    return rows.filter(~head).select("short_form", "identifier", "line_no")


_OBO_TAGS = ("id", "name", "namespace", "def", "is_obsolete")


def read_obo(spark: SparkSession, path: str, keep_other: bool = False) -> DataFrame:
    """[Term] stanzas: first value of single tags, all synonyms, alternative ids and parents; the last of equal ids wins."""
    stanza = _numbered(spark.read.option("lineSep", "\n[").text(_here(path)))
    stanza = stanza.filter(F.col("value").rlike(r"^\[?Term\]"))
    one = lambda tag: F.trim(F.regexp_extract("value", rf"(?m)^{tag}:[ \t]*(.*)$", 1))
    every = lambda tag: F.regexp_extract_all("value", F.lit(rf"(?m)^{tag}:[ \t]*(.*)$"), F.lit(1))
    cells = F.filter(F.transform(F.concat(every("is_a"), every("relationship")), lambda x: F.regexp_extract(x, r"(CL:\d+)", 1)), lambda x: x != "")
    out = stanza.select(
        "line", one("id").alias("identifier"), one("name").alias("name"), one("namespace").alias("namespace"), X.quoted(one("def")).alias("definition"),
        F.array_sort(F.array_distinct(F.filter(F.transform(every("synonym"), lambda x: X.quoted(x)), lambda x: x != ""))).alias("synonyms"),
        F.array_sort(F.array_distinct(F.filter(F.transform(every("alt_id"), lambda x: F.trim(x)), lambda x: x != ""))).alias("alt_ids"),
        F.array_sort(F.array_distinct(cells)).alias("parents"), (F.lower(one("is_obsolete")) == "true").alias("is_obsolete"),
    ).filter("identifier <> '' and name <> ''")
    if not keep_other:
        out = out.filter(F.col("identifier").startswith("CL:"))
    return _last(out)


def _last(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("identifier").orderBy(F.desc("line"))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


_ID = ("norm_concept_id", "concept_id", "identifier", "id", "cl_id")
_NAME = ("norm_preferred_label", "preferred_label", "label", "name")
_ALIASES = ("synonyms", "aliases", "names", "alias", "synonym")


def read_concepts_jsonl(spark: SparkSession, path: str, keep_other: bool = False) -> DataFrame:
    """Permissive JSONL: several field names; a row without id or name fails; the last of equal ids wins."""
    raw = _numbered(spark.read.text(_here(path))).filter("trim(value) <> ''")
    at = lambda k: F.get_json_object("value", f"$.{k}")
    listed = lambda k: F.coalesce(F.when(F.substring(at(k), 1, 1) == "[", F.from_json(at(k), "array<string>")), X.as_list(at(k)))
    need = lambda c, what: F.coalesce(c, F.raise_error(F.lit(f"a concept without {what}")).cast("string"))
    out = raw.select(
        "line", X.concept_id(need(X.first_nonempty(*map(at, _ID)), "id")).alias("identifier"), need(X.first_nonempty(*map(at, _NAME)), "name").alias("name"),
        F.coalesce(at("namespace"), F.lit("")).alias("namespace"), F.coalesce(at("definition"), F.lit("")).alias("definition"),
        F.array_sort(F.array_distinct(F.concat(*map(listed, _ALIASES)))).alias("synonyms"), F.array_sort(listed("alt_ids")).alias("alt_ids"), F.array_sort(listed("parents")).alias("parents"),
        F.coalesce(F.lower(at("is_obsolete")) == "true", F.lit(False)).alias("is_obsolete"),
    )
    if not keep_other:
        out = out.filter(F.col("identifier").startswith("CL:"))
    return _last(out)


def _column(df: DataFrame, names: Sequence[str]):
    low = {c.lower(): c for c in df.columns}
    have = [F.col(f"`{low[n]}`") for n in names if n in low]
    return X.first_nonempty(*have) if have else F.lit(None).cast("string")


def read_concepts_table(spark: SparkSession, path: str, keep_other: bool = False) -> DataFrame:
    """CSV or TSV with header: the first row of an id names the concept, later ones add aliases."""
    raw = _numbered(spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(_here(path)))
    rows = raw.select("line", X.concept_id(_column(raw, _ID)).alias("identifier"), _column(raw, _NAME).alias("name"), F.concat(*[X.as_list(_column(raw, [a])) for a in _ALIASES]).alias("aliases"), _column(raw, ["namespace"]).alias("namespace"))
    rows = rows.filter("identifier is not null")
    if not keep_other:
        rows = rows.filter(F.col("identifier").startswith("CL:"))
    return rows.groupBy("identifier").agg(
        F.min("line").alias("line"), F.min_by("name", "line").alias("name"), F.coalesce(F.min_by("namespace", "line"), F.lit("")).alias("namespace"), F.lit("").alias("definition"),
        F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list("aliases")), F.collect_set("name")))).alias("synonyms"),
        F.array().cast("array<string>").alias("alt_ids"), F.array().cast("array<string>").alias("parents"), F.lit(False).alias("is_obsolete"),
    )


_ALIAS_ID = ("cl_id", "concept_id", "norm_concept_id", "identifier", "id")
_ALIAS = ("alias", "synonym", "name", "mention", "text")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(identifier, alias) rows of a TSV, CSV or JSONL; a missing field fails."""
    if path.endswith((".jsonl", ".json")):
        raw = spark.read.text(_here(path)).filter("trim(value) <> ''")
        at = lambda k: F.get_json_object("value", f"$.{k}")
        i, a = X.first_nonempty(*map(at, _ALIAS_ID)), X.first_nonempty(*map(at, _ALIAS))
    else:
        raw = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(_here(path))
        i, a = _column(raw, _ALIAS_ID), _column(raw, _ALIAS)
    need = lambda c, what: F.coalesce(c, F.raise_error(F.lit(f"an alias row without {what}")).cast("string"))
    return raw.select(X.concept_id(need(i, "id")).alias("identifier"), need(a, "alias").alias("alias"))


_LEFT, _RIGHT = ("text_a", "sentence1", "left", "name1"), ("text_b", "sentence2", "right", "name2")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Positive pairs of a TSV (known header skipped) or JSONL with several field names, in order."""
    if path.endswith((".jsonl", ".json")):
        raw = _numbered(spark.read.text(_here(path))).filter("trim(value) <> ''")
        at = lambda k: F.get_json_object("value", f"$.{k}")
        return raw.select("line", F.coalesce(*map(at, _LEFT)).alias("text_a"), F.coalesce(*map(at, _RIGHT)).alias("text_b"))
    raw = spark.read.option("sep", "\t").option("quote", "").schema("text_a string, text_b string").csv(_here(path))
    raw = _numbered(raw)
    return raw.select("line", "text_a", "text_b").filter(~(F.col("text_a").isin(*_LEFT) & F.col("text_b").isin(*_RIGHT)))


def read_dataset(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """JSON lines or CSV by the first path's ending."""
    first = _here(paths[0])
    if first.endswith((".json", ".jsonl")):
        return spark.read.json(list(paths))
    if first.endswith(".csv"):
        return spark.read.option("header", True).csv(list(paths))
    raise ValueError(f"unknown kind of dataset: {first}")


def infer_columns(columns: Sequence[str]) -> dict[str, str | None]:
    """Which columns hold text, entities and ids."""
    low = {c.lower(): c for c in columns}
    pick = lambda *names: next((low[n] for n in names if n in low), None)
    found = {
        "text": pick("text", "passage", "sentence", "content"), "entities": pick("entities", "spans", "annotations", "labels"),
        "document_id": pick("document_id", "doc_id", "pmid"), "passage_id": pick("passage_id",), "passage_offset": pick("passage_offset", "offset"), "record_id": pick("record_id", "id"),
    }
    if found["text"] is None:
        raise ValueError("no text column")
    return found


def reference_split(names: Sequence[str]) -> str:
    """train, else validation, else test, else the first."""
    return next((n for n in ("train", "validation", "test") if n in names), names[0])


def named_paths(values: Sequence[str]) -> dict[str, str]:
    out = {}
    for v in values:
        name, path = v.split("=", 1) if "=" in v else (os.path.splitext(os.path.basename(v))[0], v)
        out[name.strip()] = path
    return out


def paired_paths(gold: Sequence[str], predicted: Sequence[str]) -> list[tuple[str, str, str]]:
    g, p = named_paths(gold), named_paths(predicted)
    if g.keys() != p.keys():
        raise ValueError(f"names differ: {sorted(g)} and {sorted(p)}")
    return [(n, g[n], p[n]) for n in sorted(g)]


def is_local_model(reference: str) -> bool:
    """A path on disk, as against a hub's name."""
    return os.path.exists(os.path.expanduser(reference))
