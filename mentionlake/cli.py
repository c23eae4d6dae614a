"""Command line: predict-bioc, normalize-bioc, predict-text, convert, evaluate, evaluate-linking, benchmark, tables, build-ontology, make-pairs."""

from __future__ import annotations

import argparse
import csv
import os
import re
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mentionlake")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **more):
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a, **({} if not a.startswith("--") else {"required": True}))
        for a, options in more.items():
            v.add_argument("--" + a.replace("_", "-"), **options)
        return v

    linked = {"ontology": {"required": True}, "abbreviations": {"default": None}, "topn": {"type": int, "default": 1}}
    verb("predict-bioc", "input", "output", **linked)
    verb("normalize-bioc", "input", "output", **linked)
    verb("predict-text", text={"default": None}, input={"default": None}, output={"required": True}, **linked)
    verb("convert", "input", "output")
    pairs = {"gold": {"nargs": "+", "required": True}, "predicted": {"nargs": "+", "required": True}, "system": {"default": "system"}}
    verb("evaluate", "output", **pairs)
    verb("evaluate-linking", "output", model={"default": "link"}, end_to_end={"action": "store_true"}, graded={"action": "store_true"}, threshold={"type": float, "default": 0.0}, **pairs)
    bench = verb("benchmark", "output", manifest={"default": None}, skip_existing={"action": "store_true"}, continue_on_error={"action": "store_true"}, keep_predicted={"action": "store_true"}, **linked)
    bench.add_argument("mode", choices=("ner", "normalize", "full"))
    bench.add_argument("--input", nargs="+", required=True)
    verb("tables", "input", "output", datasets={"nargs": "+", "required": True})
    verb("build-ontology", "input", "output", aliases={"default": None}, keep_obsolete={"action": "store_true"})
    verb("make-pairs", "ontology", "output", per_concept={"type": int, "default": None})
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    from mentionlake.operators import evaluate, ontology
    from mentionlake.plans.pipeline import Pipeline, PipelineConfig
    from mentionlake.sources import bioc, resources, writers

    if args.verb in ("predict-bioc", "normalize-bioc", "predict-text"):
        pipe = Pipeline(spark, PipelineConfig(args.ontology, args.abbreviations))
        if args.verb == "predict-bioc":
            pipe.extract_bioc(args.input, args.output, args.topn)
        elif args.verb == "normalize-bioc":
            pipe.normalize_bioc(args.input, args.output, args.topn)
        else:
            if (args.text is None) == (args.input is None):
                raise ValueError("give either --text or --input")
            found = pipe.extract_text(args.text) if args.text is not None else pipe.extract_text_file(args.input)
            writers.write_jsonl(found, args.output)
    elif args.verb == "convert":
        writers.passage_jsonl(bioc.read_xml(spark, args.input)).write.text(args.output)
    elif args.verb == "evaluate":
        rows = []
        for name, gold, predicted in resources.paired_paths(args.gold, args.predicted):
            g, p = (bioc.mentions(bioc.read_xml(spark, x)).withColumn("idx", _idx()) for x in (gold, predicted))
            rows.append(evaluate.span_rows(g, p, name, args.system))
        writers.write_metrics(evaluate.with_macro(writers.union_rows(rows)), args.output)
    elif args.verb == "evaluate-linking":
        rows = []
        for name, gold, predicted in resources.paired_paths(args.gold, args.predicted):
            g, r = (bioc.ranked_predictions(bioc.read_xml(spark, x), args.model) for x in (gold, predicted))
            found = evaluate.grid(g.filter("rank = 0").drop("pred_id", "rank", "score_text"), r, evaluate.GRID if args.graded else evaluate.PLAIN_GRID, args.end_to_end, args.threshold)
            rows.append(found.select(F.lit(name).alias("dataset"), F.lit(args.system).alias("system"), F.lit("NEN+NER" if args.end_to_end else "NEN").alias("task"), F.concat_ws(":", "iterator", "entity_types", "topk").alias("criterion"), *found.columns))
        writers.write_metrics(evaluate.with_macro(writers.union_rows(rows)), args.output)
    elif args.verb == "benchmark":
        failed = benchmark(spark, Pipeline(spark, PipelineConfig(args.ontology, args.abbreviations)), args)
        if failed:
            raise RuntimeError(f"{failed} of the inputs failed")
    elif args.verb == "tables":
        rows = spark.read.option("header", True).option("inferSchema", True).csv(args.input)
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(evaluate.markdown(evaluate.pivoted(rows, args.datasets)) + "\n")
    elif args.verb == "build-ontology":
        read = resources.read_obo if args.input.endswith(".obo") else resources.read_concepts_jsonl if args.input.endswith((".json", ".jsonl")) else resources.read_concepts_table
        concepts = read(spark, args.input)
        if args.aliases:
            concepts = ontology.merge_aliases(concepts, resources.read_aliases(spark, args.aliases))
        records = ontology.records(concepts, args.keep_obsolete)
        writers.write_resource(records, args.output)
        # read again by the strict reader: what can't be read, or lost a concept, is an error
        facts = ontology.validate(resources.read_ontology(spark, args.output)).first()
        if facts.concepts != records.count():
            raise RuntimeError("the written resource lacks concepts")
        writers.write_manifest(args.output.rstrip("/") + ".manifest.json", source=args.input, aliases=args.aliases, concepts=facts.concepts, terms=facts.terms, blank_terms=facts.blank, sha256=writers.folder_digest(args.input))
    elif args.verb == "make-pairs":
        writers.write_pairs(ontology.alias_pairs(resources.read_ontology(spark, args.ontology), args.per_concept), args.output)


def dataset_name(path: str) -> str:
    """A name for an input: its file's, without endings, with odd characters as underscores."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", re.sub(r"(\.bioc)?\.xml$", "", os.path.basename(path.rstrip("/")), flags=re.I)).strip("_") or "input"


def counted(spark: SparkSession, path: str) -> tuple[int, int]:
    """Passages and annotations of a collection; zeros where it can't be read."""
    from mentionlake.sources import bioc

    try:
        row = bioc.collection_summary(bioc.read_xml(spark, path)).first()
        return int(row.passages), int(row.annotations)
    except Exception:  # noqa: BLE001 - a count for a report, which an unreadable file mustn't stop
        return 0, 0


def benchmark(spark: SparkSession, pipe, args: argparse.Namespace) -> int:
    """Runs a mode over every input and writes a manifest with a row each; how many failed. Inputs of one name are an error."""
    from mentionlake.sources import bioc, workspace, writers

    files = bioc.input_files(args.input)
    names = [dataset_name(f) for f in files]
    if not files:
        raise FileNotFoundError("no input files")
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"several inputs are called {', '.join(twice)}")
    rows, failed = [], 0
    for name, path in zip(names, files):
        out = os.path.join(args.output, name)
        passages, annotations = counted(spark, path)
        row = {"dataset": name, "mode": args.mode, "input": path, "output": out, "status": "ok", "input_passages": passages, "input_annotations": annotations}
        began = time.perf_counter()
        if args.skip_existing and os.path.exists(out):
            row["status"] = "skipped"
        else:
            try:
                if args.mode == "ner":
                    pipe.recognize_bioc(path, out)
                elif args.mode == "full":
                    pipe.extract_bioc(path, out, args.topn)
                else:
                    source = path
                    if not args.keep_predicted:  # what an earlier linker wrote goes, gold identifiers stay
                        source = os.path.join(workspace.folder(spark, "cleaned"), "xml")
                        writers.write_xml(writers.cleaned(bioc.read_xml(spark, path)), source)
                    pipe.normalize_bioc(source, out, args.topn)
                row["elapsed_seconds"] = round(time.perf_counter() - began, 3)
            except Exception as e:  # noqa: BLE001 - the manifest records failures
                row["status"] = f"failed: {type(e).__name__}: {e}"[:500]
                failed += 1
        row["output_annotations"] = counted(spark, out)[1]
        rows.append(row)
        if failed and not args.continue_on_error:
            break
    fields = list(dict.fromkeys(k for r in rows for k in r))
    path = args.manifest or os.path.join(args.output, "run_manifest.csv")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.DictWriter(f, fields)
        w.writeheader()
        w.writerows(rows)
    return failed


def _idx():
    # document order: documents, passages and annotations of one file
    return F.col("doc_idx").cast("long") * (1 << 40) + F.col("passage_id").cast("long") * (1 << 20) + F.col("ann_idx").cast("long")


def main(argv: list[str] | None = None) -> int:
    """0 when done, 1 on an error, 130 when interrupted."""
    args = _parser().parse_args(argv)
    try:
        run(args, SparkSession.builder.appName("mentionlake").getOrCreate())
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
