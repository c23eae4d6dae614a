import csv
import json
import re

import pytest
from pyspark.sql import functions as F

from mentionlake.cli import _parser, main
from mentionlake.plans.pipeline import Pipeline, PipelineConfig, model_label
from mentionlake.sources import bioc
from mentionlake.streaming import ingest
from mentionlake.taggers import GazetteerTagger, tag, tags

ONTOLOGY = [
    {"norm_concept_id": "CL:9000077", "norm_preferred_label": "mesothelial cell", "synonyms": ["mesothelial cells"], "namespace": "cell"},
    {"norm_concept_id": "CL:9000001", "norm_preferred_label": "smooth muscle cell", "synonyms": ["SMC"], "namespace": "cell"},
    {"norm_concept_id": "CL:9000002", "norm_preferred_label": "endothelial cell", "synonyms": [], "namespace": "cell"},
]


@pytest.fixture
def pipe(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text("\n".join(map(json.dumps, ONTOLOGY)))
    (tmp_path / "a.tsv").write_text("short_form\tmatched_cl_id\nSMC\tCL:9000001\nEC\tCL:9000002\nEC\tCL:9000077\n")
    return Pipeline(spark, PipelineConfig(str(tmp_path / "o.jsonl"), str(tmp_path / "a.tsv")))


def test_extract_text(pipe):
    r = pipe.extract_text("The mesothelial cell and SMC bundles lay in rows.").orderBy("start").collect()
    assert [(x.start, x.end, x.mention, x.cl_id, x.source) for x in r] == [(4, 20, "mesothelial cell", "CL:9000077", "model_normal"), (25, 28, "SMC", "CL:9000001", "abbreviation_direct")]
    assert pipe.extract_text("  ").count() == 0
    with pytest.raises(TypeError):
        pipe.extract_text(3)
    with pytest.raises(FileNotFoundError):
        pipe.extract_text_file("/nowhere.txt")


def test_ambiguous_by_long_form(pipe):
    r = pipe.normalize_mentions(["EC"], document_text="The endothelial cell (EC) grew.").filter("rank = 0").first()
    assert (r.identifier, r.source) == ("CL:9000002", "abbreviation_ambiguous_via_long_form")
    assert pipe.normalize_mentions([{"text": "mesothelial cells", "start": 3}], topn=2).count() == 2


def test_bioc_round_trip(spark, pipe, tmp_path):
    (tmp_path / "in.xml").write_text("<collection><document><id>d</id><passage><offset>10</offset><text>SMC and mesothelial cells.</text></passage></document></collection>")
    out = str(tmp_path / "out")
    rows = pipe.extract_bioc(str(tmp_path / "in.xml"), out).orderBy("start").collect()
    assert [(r.start, r.end, r.cl_id) for r in rows] == [(10, 13, "CL:9000001"), (18, 35, "CL:9000077")]
    head, infons = bioc.read_head(spark, bioc.input_files(out)[0])
    assert dict(infons)["normalization_model"] == "link" and dict(infons)["normalization_unique_mentions"] == "2"
    keys = {i.key: i.value for r in bioc.annotations(bioc.read_xml(spark, out)).filter("start = 10").collect() for i in r.infons}
    assert keys["link_abbreviation_method"] == "exact_short_abbreviation" and keys["link_match_source"] == "abbreviation_direct"
    with pytest.raises(FileExistsError):
        pipe.extract_bioc(str(tmp_path / "in.xml"), out, overwrite=False)


def test_windows_agree_with_one_window(spark):
    text = "the SMC of mesothelial cell or endothelial cell and SMC again " * 6
    t = GazetteerTagger(["SMC", "mesothelial cell", "endothelial cell"])
    df = spark.createDataFrame([("d", 0, text)], "document_id string, passage_id int, text string")
    got = lambda *w: sorted((r.start, r.tag) for r in tags(tag(df, t, *w), t, ["document_id", "passage_id"]).collect())
    assert [x for x, y in got(1000, 0) if y != "O"] == [m.start() for m in re.finditer("SMC|mesothelial|endothelial|(?<=al )cell", text)]


def test_tagger_hands_back_bounded_batches(monkeypatch):
    import pyarrow as pa

    from mentionlake import taggers

    monkeypatch.setattr(taggers, "ROWS", 100)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "text": ["SMC a " * 500, None, "b SMC"]})
    got = list(taggers.scored(batch, ["id"], GazetteerTagger(["SMC"]), 64, 48, 16))
    assert max(b.num_rows for b in got) < 164 and len(got) > 10
    rows = [r for b in got for r in b.to_pylist()]
    assert {(r["id"], r["start"]) for r in rows} == {(1, 6 * i + k) for i in range(500) for k in (0, 4)} | {(3, 0), (3, 2)}
    assert all((r["scores"][1] == 1) == (r["end"] - r["start"] == 3) for r in rows)


def test_cli(tmp_path):
    verbs = _parser().format_help()
    assert all(v in verbs for v in ("predict-bioc", "normalize-bioc", "predict-text", "convert", "evaluate", "build-ontology", "make-pairs"))
    assert main(["predict-text", "--text", "x", "--output", str(tmp_path / "o"), "--ontology", "/nowhere.jsonl"]) == 1


XML = "<collection><document><id>d</id><passage><offset>0</offset><text>SMC and mesothelial cells.</text><annotation id='a'><infon key='type'>cell_type</infon><infon key='identifier'>CL:9000001</infon><infon key='old_id_0'>CL:0</infon><location offset='0' length='3'/><text>SMC</text></annotation></passage></document></collection>"


def test_benchmark_and_evaluators(tmp_path, pipe):
    for n in ("one", "two"):
        (tmp_path / f"{n}.xml").write_text(XML)
    (tmp_path / "bad.xml").write_text("<collection><document><id>d</id><passage><offset>0</offset><text>x</text><annotation id='a'><infon key='type'>cell_type</infon><text>y</text></annotation></passage></document></collection>")
    out, given = tmp_path / "out", ["--ontology", str(tmp_path / "o.jsonl"), "--abbreviations", str(tmp_path / "a.tsv"), "--input"]
    assert main(["benchmark", str(out), "normalize", *given, str(tmp_path / "one.xml"), str(tmp_path / "two.xml")]) == 0
    rows = list(csv.DictReader((out / "run_manifest.csv").open()))
    assert [(r["dataset"], r["status"], r["input_annotations"], r["output_annotations"]) for r in rows] == [("one", "ok", "1", "1"), ("two", "ok", "1", "1")]
    assert main(["benchmark", str(out), "ner", "--skip-existing", *given, str(tmp_path / "one.xml")]) == 0
    assert next(csv.DictReader((out / "run_manifest.csv").open()))["status"] == "skipped"
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.xml").write_text(XML)
    assert main(["benchmark", str(out), "ner", *given, str(tmp_path / "one.xml"), str(tmp_path / "deep" / "one.xml")]) == 1  # one name twice
    pairs = ["--gold", f"x={tmp_path}/one.xml", "--predicted", f"x={out}/one"]
    assert main(["evaluate", str(tmp_path / "m1"), *pairs]) == 0
    assert main(["evaluate-linking", str(tmp_path / "m2"), *pairs]) == 0
    read = lambda p: [r for f in p.iterdir() if f.suffix == ".csv" for r in csv.DictReader(f.open())]
    assert {(r["dataset"], r["criterion"], r["f1"]) for r in read(tmp_path / "m1")} == {(d, c, "1.0") for d in ("x", "Macro average") for c in ("exact_span", "relaxed_span")}
    assert {(r["criterion"], r["f1"]) for r in read(tmp_path / "m2") if r["dataset"] == "x"} == {(f"single_id:cell_type:{k}", "1.0") for k in (1, 5, 10)}
    assert main(["tables", str(tmp_path / "m1"), str(tmp_path / "t.md"), "--datasets", "x"]) == 0 and "1.000" in (tmp_path / "t.md").read_text()


def test_resource_is_read_again(tmp_path, spark):
    (tmp_path / "c.jsonl").write_text('{"id": "CL:1", "name": "a", "synonyms": ["b"]}\n{"id": "CL:2", "name": "c"}\n')
    assert main(["build-ontology", str(tmp_path / "c.jsonl"), str(tmp_path / "r")]) == 0
    facts = json.loads((tmp_path / "r.manifest.json").read_text())
    assert (facts["concepts"], facts["terms"]) == (2, 3)


def test_streaming_linking(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"document_id": f"d{i}", "passage_id": 0, "passage_offset": 0, "text": "SMC here"}) + "\n")
    t = GazetteerTagger(["SMC"])
    step = lambda b: tags(tag(b.select("document_id", "passage_id", "text"), t), t, ["document_id", "passage_id"]).filter("tag <> 'O'")
    q = ingest.run(ingest.passages(spark, str(tmp_path / "in"), files_per_batch=2), step, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(r.document_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["d0", "d1", "d2"]


def test_string_passage(spark):
    assert bioc.string_passage(spark, "x").first().document_id == "doc0"
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_model_labels():
    known = [("sapbert", "Best-Sapbert")]
    assert model_label("models/My_SapBERT_x", known) == "Best-Sapbert" and model_label("a/b_c/") == "b-c" and model_label("x_y") == "x-y"
