import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from mentionlake.functions import infons as I
from mentionlake.functions import text as X
from mentionlake.functions import udfs


def one(spark, column, **cells):
    names = list(cells)
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{n} {'string' if isinstance(cells[n], str) or cells[n] is None else 'int'}" for n in names))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("CD8+ T cells", "CD8 + T cell"), ("T-cells", "T - cell"), ("mesothelial cells", "mesothelial cell"), ("viruses", "virus"), ("bodies", "body"), ("classes", "class"),
        ("buses", "buse"), ("nucleus", "nucleus"), ("mass", "mass"), ("oocytes", "oocyte"), ("natural_killer cells", "natural _ killer cell"), ("cell's", "cell ' "), ("", ""),
    ],
)
def test_plural_normalisation(spark, text, expected):
    assert one(spark, X.normalize_text("t"), t=text) == expected


def test_null_text_has_no_tokens(spark):
    assert one(spark, X.split_tokens("t"), t=None) == []


@pytest.mark.parametrize(
    ("left", "right", "jaccard", "ratio"),
    [("smooth muscle cell", "Smooth  muscle cell", 1.0, 1.0), ("T cell", "T lymphocyte", 1 / 3, 4 / 9), ("muscle cell", "smooth muscle cell", 2 / 3, 22 / 29), ("", "x", 0.0, 0.0), ("", " ", 0.0, 1.0), ("CD8+ T cell", "CD8 T cell", 0.5, 20 / 21), ("T-cell", "T cell", 0.0, 10 / 12), ("Straße", "strasse", 1.0, 1.0)],
)
def test_lexical_features(spark, left, right, jaccard, ratio):
    df = spark.createDataFrame([(left, right)], "l string, r string")
    row = df.select(X.token_jaccard("l", "r").alias("j"), udfs.sequence_ratio("l", "r").alias("s")).first()
    assert row.j == pytest.approx(jaccard) and row.s == pytest.approx(ratio)


def test_sequence_ratio_against_plain(spark):
    r = random.Random(5)
    rows = [("".join(r.choices("abC d", k=r.randint(0, 30))), "".join(r.choices("abc D", k=r.randint(0, 30)))) for _ in range(200)]
    got = spark.createDataFrame(rows, "l string, r string").select("l", "r", udfs.sequence_ratio("l", "r").alias("s")).collect()
    for g in got:
        a, b = " ".join(g.l.casefold().split()), " ".join(g.r.casefold().split())
        assert g.s == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())


def test_parenthetical(spark):
    df = spark.createDataFrame([("NK", "natural killer cell (NK)", 1.0), ("NK", "natural killer cell", 0.0), ("a (b (NK))", "nk", 1.0), ("x ()", " ", 1.0), ("x", "", 0.0)], "l string, r string, e double")
    for row in df.select(X.has_parenthetical_relation("l", "r").alias("x"), "e").collect():
        assert row.x == row.e


@pytest.mark.parametrize(
    ("mention", "key", "threshold", "like"),
    [("SMC", "SMC", 1.0, True), ("SMCs", "SMCs", 1.0, True), ("T-cells", "Tcells", 0.95, True), ("CD8 + T cell", "CD8+Tcell", 0.90, True), ("hESC–RPE", "hESCRPE", 0.95, True), ("a", "a", 1.0, False), ("fibroblast", "fibroblast", 0.90, True), ("squamous epithelial", "squamousepithelial", 0.90, False)],
)
def test_abbreviation_predicates(spark, mention, key, threshold, like):
    df = spark.createDataFrame([(mention,)], "m string")
    row = df.select(X.abbreviation_key("m").alias("k"), X.abbreviation_threshold(X.abbreviation_key("m")).alias("t"), X.is_abbreviation_like("m").alias("l")).first()
    assert (row.k, row.t, row.l) == (key, threshold, like)


@pytest.mark.parametrize(("field", "ids"), [("CL:10;CL:11 , - ,None", ["CL:10", "CL:11"]), ("CL:0 (skos:exact)", ["CL:0"]), (None, []), ("-", [])])
def test_identifiers(spark, field, ids):
    assert one(spark, X.split_identifiers("f"), f=field) == ids


def test_infons_keep_order(spark):
    df = spark.sql("select array(struct('a' as key, '1' as value), struct('m_id_0' as key, 'CL:1' as value), struct('x_id_0' as key, 'CL:2' as value), struct('a' as key, '3' as value)) as i")
    row = df.select(I.get("i", "a").alias("a"), I.by_suffix("i", "_id_0").alias("s"), I.as_map("i").alias("m"), I.upsert("i", [("n", F.lit("9")), ("m_id_0", F.lit("CL:7"))]).alias("u"), I.clean_for_linking("i").alias("c")).first()
    assert (row.a, row.s) == ("3", "CL:1")
    assert row.m == {"a": "3", "m_id_0": "CL:1", "x_id_0": "CL:2"}
    assert [(x.key, x.value) for x in row.u] == [("n", "9"), ("a", "1"), ("m_id_0", "CL:7"), ("x_id_0", "CL:2"), ("a", "3")]
    assert [x.key for x in row.c] == ["a", "a"]


def test_long_forms():
    assert udfs.short_forms("The smooth muscle cell (SMC) and natural killer (NK) types") == [("SMC", "smooth muscle cell"), ("NK", "natural killer")]
    assert udfs.short_forms("nothing here (see below)") == []


def test_chunks_tile_the_text():
    r = random.Random(2)
    for _ in range(50):
        t = "".join(r.choices("ab .\n", k=r.randint(0, 200)))
        cut = udfs.chunk_spans(t, 17)
        assert "".join(t[a:b] for a, b in cut) == t and all(b - a <= 17 for a, b in cut)


def test_case_folding_of_every_character(spark):
    """Against Python's over the basic plane; the JVM's tables differ from it in a few rare scripts only."""
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF and not 0xE000 <= c <= 0xF8FF and chr(c) != "\0"]
    got = spark.createDataFrame([(c,) for c in every], "t string").select("t", X.casefold("t").alias("f")).collect()
    odd = [r.t for r in got if r.f != r.t.casefold()]
    assert len(odd) < 250 and not any(c < "\u0370" for c in odd)
    assert one(spark, X.fold("t"), t="  ΑΣ\x1c ς \u2003Iı ") == "ας ς ıi".replace("ς", "σ").replace("ıi", "iı")


def test_mentions_are_lowered_not_folded(spark):
    """The rule of the span evaluation: lower case, white space runs as one space, edges stripped of what is no letter or digit."""
    plain = lambda t: re.sub(r"^[\W_]+|[\W_]+$", "", re.sub(r"\s+", " ", (t or "").strip().lower()))
    texts = ["(Straße \n GROẞ)", "ΑΣ ς \u017f", "\u0149a, İI\u0131", "CD8+ T  Cells,", "_\u00a0\x1cX\ty\u2003_", " -\n- ", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.normalize_mention("t").alias("n")).collect()
    assert [r.n for r in got] == [plain(t) for t in texts]
    assert got[0].n == "straße groß"


def test_six_digits(spark):
    r = random.Random(3)
    some = [0.5, 1e-7, 1e6, 123456.7, 999999.5, 1e-4, 1.5e-5, 0.0, -2.5, 1 / 3, 2e22, float("nan"), float("inf"), float("-inf"), *[r.uniform(-1, 1) * 10 ** r.randint(-9, 9) for _ in range(300)]]
    got = spark.createDataFrame([(x,) for x in some], "x double").select(X.significant("x").alias("s")).collect()
    assert [g.s for g in got] == [f"{x:.6g}" for x in some]


def test_upsert_changes_the_first_of_equal_keys(spark):
    df = spark.sql("select array(struct('a' as key, '1' as value), struct('a' as key, '2' as value)) as i")
    u = df.select(I.upsert("i", [("a", F.lit("9")), ("b", F.lit("1")), ("b", F.lit("2")), ("c", F.lit(None))]).alias("u")).first().u
    assert [(x.key, x.value) for x in u] == [("b", "2"), ("a", "9"), ("a", "2")]


def test_plural_of_a_lone_s(spark):
    df = spark.createDataFrame([("s",), ("as",), ("a",)], "k string")
    assert [r.v for r in df.select(X.abbreviation_variants("k").alias("v")).collect()] == [["s", "ss"], ["as", "a"], ["a", "as"]]
    assert one(spark, X.abbreviation_key("t"), t="a\u2014b\u2015c") == "ab\u2015c"


def test_spans_of_a_batch_take_little_room():
    """A batch of Spark's is up to 10,000 texts; pairs as objects took hundreds of bytes a token."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["ab cd " * 100, None, ""] * 500)
    tracemalloc.start()
    try:
        got = udfs.span_lists(texts, lambda t: (m.span() for m in re.finditer(r"\S+", t)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[0].as_py()[:2] == [{"start": 0, "end": 2}, {"start": 3, "end": 5}] and [len(x) for x in got[:3]] == [200, 0, 0]
    assert peak < 4_000_000  # 100,000 tokens, and a piece's texts


def test_long_forms_of_a_batch():
    import pyarrow as pa

    got = udfs.form_lists(pa.array(["the smooth muscle cell (SMC) of " * 2, None] * 700))
    assert len(got) == 1400 and got[0].as_py() == [{"short": "SMC", "long": "smooth muscle cell"}] * 2 and got[1399].as_py() == []
