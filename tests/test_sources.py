import json

import pytest
from pyspark.sql import functions as F

from mentionlake.operators import ontology as O
from mentionlake.sources import bioc, resources, writers

XML = """<?xml version="1.0"?><collection><source>s</source><document><id>d1</id>
<passage><infon key="article-id_pmid">77</infon><offset>100</offset><text>SMC clusters grew in a row. </text>
<annotation id="a1"><infon key="type">cell_type</infon><infon key="identifier">CL:1</infon><infon key="score">0.5</infon><location offset="100" length="3"/><text>SMC</text></annotation>
<annotation id="a2"><infon key="label">cell_vague</infon><location offset="999" length="3"/><location offset="104" length="8"/><text></text></annotation></passage>
<passage><offset>x</offset><text></text></passage>
<passage><infon key="annotatable">No</infon><text> two  spaces</text></passage></document>
<document><id>d1</id><passage><offset>0</offset><text>Second</text></passage></document></collection>"""


@pytest.fixture
def docs(spark, tmp_path):
    p = tmp_path / "in.xml"
    p.write_text(XML)
    return bioc.read_xml(spark, str(p))


def test_passages_keep_blank_ones(docs):
    rows = bioc.passages(docs).orderBy("record_id").collect()
    assert [(r.doc_idx, r.passage_id, r.passage_offset, r.text) for r in rows] == [(0, 0, 100, "SMC clusters grew in a row. "), (0, 1, 0, ""), (0, 2, 0, " two  spaces"), (1, 0, 0, "Second")]
    assert [r.record_id for r in rows] == [0, 1, 2, 3]
    assert [(r.passage_id, r.record_id) for r in bioc.nonempty_passages(docs).orderBy("record_id").collect()] == [(0, 0), (2, 1), (0, 2)]


def test_annotations_and_entities(docs):
    a = bioc.annotations(docs).orderBy("ann_idx").collect()
    assert [(x.ann_id, x.start, x.end, x.label, x.score) for x in a] == [("a1", 100, 103, "cell_type", 0.5), ("a2", 999, 1002, "cell_vague", None)]
    e = bioc.entities(docs).orderBy("start").collect()
    assert [(x.ann_id, x.start, x.end, x.text) for x in e] == [("a1", 0, 3, "SMC"), ("a2:1", 4, 12, "clusters")]
    m = bioc.mentions(docs).collect()
    assert [(x.passage_key, x.entity_type, x.text) for x in m] == [("77", "cell_type", "SMC")]
    assert bioc.collection_summary(docs).first()[:] == (2, 4, 2)


def test_overlapping_entities_raise(docs):
    assert bioc.entities(docs, "error").count() == 2


def test_linkable_and_texts(docs):
    assert [(x.document_key, x.normalized_text) for x in bioc.linkable(docs).collect()] == [("77", "SMC")]
    assert {x.document_key: x.text for x in bioc.document_texts(docs).collect()} == {"77": "SMC clusters grew in a row. ", "d1": "Second"}


def test_round_trip_with_predictions(spark, docs, tmp_path):
    pred = spark.createDataFrame([("d1", 0, 104, 112, "cell_type", "clusters", 0.98765), ("", 2, 1, 4, "cell_type", "two", None)], "document_id string, passage_id int, start int, end int, label string, text string, score double")
    out = str(tmp_path / "out")
    writers.write_xml(writers.with_predictions(docs, pred, model="m"), out)
    back = bioc.annotations(bioc.read_xml(spark, [str(p) for p in sorted((tmp_path / "out").glob("part*"))]))
    rows = back.orderBy("ann_id").collect()
    assert [(r.ann_id, r.start, r.end, r.label) for r in rows] == [("T0", 104, 112, "cell_type"), ("T1", 1, 4, "cell_type"), ("T2", 104, 112, "cell_type")]
    assert rows[0].score == pytest.approx(0.98765)


def test_links_go_to_the_front_and_gold_stays(spark, docs, tmp_path):
    found = spark.createDataFrame([("77", "SMC", 0, "CL:9", "label", "name", 0.5, -0.1, "model_normal")], "document_key string, normalized_text string, rank int, identifier string, preferred_label string, name string, final_score double, embedding_score double, source string")
    linked = writers.with_links(docs, found, "m")
    a = [x for x in bioc.annotations(linked).collect() if x.ann_id == "a1"][0]
    keys = [x.key for x in a.infons]
    assert keys[-3:] == ["type", "identifier", "score"] and "m_id_0" in keys and keys[0] == "m_match_source"
    p = [x for x in bioc.predictions(linked).collect() if x.start == 100][0]
    assert (p.cl_id, p.cl_label, p.score, p.source) == ("CL:9", "label", 0.5, "model_normal")
    r = [x for x in bioc.ranked_predictions(linked, "m").collect() if x.pred_id]
    assert [(x.rank, x.pred_id, x.score_text, x.identifier) for x in r] == [(0, "CL:9", "0.50000000", "CL:1")]
    c = [x for x in bioc.annotations(writers.cleaned(linked)).collect() if x.ann_id == "a1"][0]
    assert [x.key for x in c.infons] == ["m_matched_alias_0", "m_normalized_text", "type", "identifier", "score"]


def test_jsonl(docs):
    rows = [json.loads(r.value) for r in writers.passage_jsonl(docs).collect()]
    first = [r for r in rows if r["record_id"] == 0][0]
    assert first["entities"][0]["start"] == 0 and first["infons"] == {"article-id_pmid": "77"}
    assert "entities" not in [r for r in rows if r["record_id"] == 1][0]


def test_missing_file():
    with pytest.raises(FileNotFoundError):
        bioc.input_files("/nowhere/x.xml")


ONTOLOGY = """{"norm_concept_id":"CL:9000010","norm_preferred_label":"smooth muscle cell","synonyms":["SMC","myocytes"],"namespace":"cell"}
{"norm_concept_id":"CL:9000011","norm_preferred_label":"endothelial cells","synonyms":null,"namespace":"cell"}

{"norm_concept_id":"CL:9000010","norm_preferred_label":"other label","synonyms":["SMC"],"namespace":"x"}
{"norm_concept_id":"","norm_preferred_label":"dropped","synonyms":[]}
"""


def test_ontology(spark, tmp_path):
    p = tmp_path / "o.jsonl"
    p.write_text(ONTOLOGY)
    t = resources.read_ontology(spark, str(p))
    assert [r.name for r in t.orderBy("term_idx").collect()] == ["smooth muscle cell", "SMC", "myocyte", "endothelial cell", "other label", "SMC"]
    m = {r.identifier: r for r in resources.concept_metadata(t).collect()}
    assert len(m) == 2 and m["CL:9000010"].preferred_label == "smooth muscle cell" and m["CL:9000010"].namespace == "cell" and len(m["CL:9000010"].names) == 4
    assert resources.read_ontology(spark, str(p), "cell").count() == 4
    p.write_text('{"norm_concept_id":"CL:1","norm_preferred_label":"a","synonyms":"text"}\n')
    with pytest.raises(Exception):
        resources.read_ontology(spark, str(p)).count()


OBO = """format-version: 1.2

[Term]
id: CL:9000020
name: test cell
def: "A \\"quoted\\" definition." [X:1]
synonym: "tc" EXACT []
is_a: CL:9000010 ! smooth muscle cell
relationship: part_of CL:9000011 ! other

[Term]
id: GO:0000001
name: not kept

[Typedef]
id: part_of

[Term]
id: CL:9000021
name: old cell
is_obsolete: true
"""


def test_obo(spark, tmp_path):
    p = tmp_path / "o.obo"
    p.write_text(OBO)
    t = resources.read_obo(spark, str(p))
    assert t.count() == 2
    r = O.records(t).collect()
    assert [x.norm_concept_id for x in r] == ["CL:9000020"]
    assert (r[0].definition, r[0].synonyms, r[0].parents) == ('A "quoted" definition.', ["tc"], ["CL:9000010", "CL:9000011"])


def test_tables_and_aliases(spark, tmp_path):
    t = tmp_path / "t.tsv"
    t.write_text("id\tname\tsynonyms\nCL_1\ta\tx|y\nCL:1\tb\tz\nGO:1\tc\t\n")
    c = resources.read_concepts_table(spark, str(t))
    row = c.first()
    assert (row.identifier, row.name, sorted(row.synonyms)) == ("CL:1", "a", ["a", "b", "x", "y", "z"])
    a = tmp_path / "a.tsv"
    a.write_text("cl_id\talias\nCL:1\tx\nCL:1\tnew\nCL:7\tother\n")
    m = O.merge_aliases(c, resources.read_aliases(spark, str(a))).first()
    assert m.n_added == 1 and "new" in m.synonyms


def test_pairs(spark, tmp_path):
    df = spark.createDataFrame([(0, "x", "y"), (1, "y", "x"), (2, "x ", "y"), (3, "", "z")], "line int, text_a string, text_b string")
    assert [(r.text_a, r.text_b) for r in O.dedupe_pairs(df).collect()] == [("x", "y")]
    names = spark.createDataFrame([("C", n) for n in "abc"], "identifier string, raw_name string")
    assert sorted((r.text_a, r.text_b) for r in O.alias_pairs(names).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert O.alias_pairs(names, 2).count() == 2


def test_columns_and_names():
    assert resources.infer_columns(["ID", "Text"])["text"] == "Text"
    assert resources.reference_split(["test", "validation"]) == "validation"
    assert resources.paired_paths(["b=1", "a=2"], ["a=3", "b=4"]) == [("a", "2", "3"), ("b", "1", "4")]
    with pytest.raises(ValueError):
        resources.paired_paths(["a=1"], ["b=1"])


def test_documents_that_share_an_id_stay_apart(spark, tmp_path):
    (tmp_path / "x.xml").write_text(
        "<collection><source>s &amp; t</source><date>2020</date><key>k</key><infon key='n'>no</infon><infon key=\"m\">a &lt; b</infon>"
        + "".join(f"<document><id>d</id><passage><offset>0</offset><text>{t} SMC</text></passage></document>" for t in ("one", "three"))
        + "</collection>"
    )
    docs = bioc.read_xml(spark, str(tmp_path / "x.xml"))
    assert [r.doc_idx for r in docs.orderBy("doc_idx").collect()] == [0, 1]
    p = bioc.passages(docs)
    e = p.select("source_path", "doc_idx", (F.length("text") - 3).alias("start"), F.length("text").alias("end"), F.lit("cell").alias("label"), F.lit("SMC").alias("text"))
    a = bioc.annotations(writers.with_contained(docs, e)).collect()
    assert sorted((r.doc_idx, r.start, r.ann_id) for r in a) == [(0, 4, "T1"), (1, 6, "T2")]
    # by id alone both documents are meant
    both = bioc.annotations(writers.with_contained(docs, e.drop("source_path", "doc_idx").withColumn("document_id", F.lit("d")))).collect()
    assert sorted((r.doc_idx, r.start) for r in both) == [(0, 4), (1, 4), (1, 6)]
    head, infons = bioc.read_head(spark, str(tmp_path / "x.xml"))
    assert head == {"source": "s & t", "date": "2020", "key": "k"} and infons == [("m", "a < b")]
    out = str(tmp_path / "out")
    writers.write_xml(docs, out, head=head, infons=infons)
    assert bioc.read_head(spark, bioc.input_files(out)[0]) == (head, infons)
    again = bioc.read_xml(spark, out)
    assert sorted(r.text for r in bioc.passages(again).collect()) == ["one SMC", "three SMC"]


def test_large_files_are_cut_between_documents(spark, tmp_path):
    body = "".join(f"<document><id>{i}</id><passage><offset>0</offset><text>{'w' * (i % 50)} {i}</text></passage></document>\n" for i in range(3000))
    (tmp_path / "x.xml").write_text(f"<collection>{body}</collection>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        docs = bioc.read_xml(spark, str(tmp_path / "x.xml"))
        assert docs.rdd.getNumPartitions() > 5
        assert all(int(r.id) == r.doc_idx for r in docs.select("id", "doc_idx").collect()) and docs.count() == 3000
        r = bioc.nonempty_passages(docs).select("document_id", "record_id").collect()
        assert all(int(x.document_id) == x.record_id for x in r) and len(r) == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_outputs(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(5)], "n int, t string")
    writers.write_predictions(df.coalesce(1), str(tmp_path / "p"))
    part = next(f for f in (tmp_path / "p" / "predictions.json").iterdir() if f.suffix == ".txt")
    assert json.loads(part.read_text()) == [{"n": i, "t": None if i % 2 else "x"} for i in range(5)]
    assert spark.read.json(str(tmp_path / "p" / "predictions.jsonl")).count() == 5
    rows = spark.createDataFrame([(0.5, "d", "extra")], "f1 double, dataset string, more string")
    writers.write_metrics(rows, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == ["dataset", "f1", "more"]
    assert writers.union_rows([rows, df]).columns == ["f1", "dataset", "more", "n", "t"]


def test_header_counts_on_the_first_line_alone(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("short_form\tmatched_cl_id\nA\tCL:1\nshort_form\tmatched_cl_id\nB\tCL:2\textra\n")
    r = resources.read_abbreviations(spark, str(tmp_path / "a.tsv")).orderBy("line_no").collect()
    assert [(x.short_form, x.identifier) for x in r] == [("A", "CL:1"), ("short_form", "matched_cl_id"), ("B", "CL:2")]


def test_lines_of_several_files_keep_the_order_of_the_files(spark, tmp_path):
    """Scans pack files by size, the largest first: later files here are larger or smaller than those before."""
    parts = [3, 40, 1, 20]
    for kind, line in {"jsonl": '{{"id": "CL:1", "name": "n{0}", "alias": "{1}"}}\n', "obo": "[Term]\nid: CL:1\nname: n{0}\nsynonym: \"{1}\" EXACT []\n\n", "tsv": "CL:1\tn{0}\t{1}\n", "o": '{{"norm_concept_id": "CL:{0}", "norm_preferred_label": "n{0}", "synonyms": ["{1}"]}}\n'}.items():
        (tmp_path / f"x.{kind}").mkdir()
        for i, n in enumerate(parts):
            head = "id\tname\talias\n" if kind == "tsv" else ""
            (tmp_path / f"x.{kind}" / f"part-{i}").write_text(head + "".join(line.format(10 * i + k, "x" * 10 * n) for k in range(2)))
    for read in (resources.read_concepts_jsonl, resources.read_obo):
        kind = "obo" if read is resources.read_obo else "jsonl"
        assert [r.name for r in read(spark, str(tmp_path / f"x.{kind}")).collect()] == ["n31"]
    assert [r.name for r in resources.read_concepts_table(spark, str(tmp_path / "x.tsv")).collect()] == ["n0"]
    names = ["n0", "n1", "n10", "n11", "n20", "n21", "n30", "n31"]
    got = []
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.openCostInBytes", size)
        try:
            t = resources.read_ontology(spark, str(tmp_path / "x.o")).orderBy("term_idx").collect()
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
        got.append([r.term_idx for r in t])
        assert [r.raw_name for r in t if r.is_preferred] == names
    assert got[0] == got[1]  # however the files are packed
