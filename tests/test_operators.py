import random
import re
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionlake.encoders import HashingEncoder, TableEncoder, encode
from mentionlake.operators import abbreviations as A
from mentionlake.operators import decode as D
from mentionlake.operators import evaluate as E
from mentionlake.operators import filters
from mentionlake.operators import linking as L


def test_decode_worked_case(spark):
    tags = [(0, 1, "B-x"), (2, 7, "I-x"), (8, 11, "O"), (12, 13, "I-x"), (14, 19, "I-y"), (20, 22, "B-y"), (23, 23, "O"), (23, 25, "I-y")]
    df = spark.createDataFrame([("s", *t) for t in tags], "sample_id string, start int, end int, tag string")
    got = sorted((r.start, r.end, r.label) for r in D.decode(df).collect())
    assert got == [(0, 7, "x"), (12, 13, "x"), (14, 19, "y"), (20, 25, "y")]


def test_decode_against_plain(spark):
    r = random.Random(4)
    rows, want = [], []
    for s in range(40):
        active = None
        for i in range(r.randint(0, 15)):
            tag = r.choice(["O", "B-a", "I-a", "B-b", "I-b", "plain"])
            rows.append((s, i, i + 1, tag))
            if tag == "O":
                active = None
                continue
            p, label = tag.split("-") if "-" in tag else ("B", tag)
            if p == "B" or active is None or active[1] != label:
                active = [s, label, i, i + 1]
                want.append(active)
            else:
                active[3] = i + 1
    df = spark.createDataFrame(rows, "sample_id int, start int, end int, tag string")
    assert sorted(map(tuple, want)) == sorted((x.sample_id, x.label, x.start, x.end) for x in D.decode(df).collect())


def test_mean_and_ties(spark):
    df = spark.createDataFrame([("s", 4, 6, [1.0, 3.0]), ("s", 4, 6, [2.0, 0.0])], "sample_id string, start int, end int, scores array<double>")
    assert D.best_label(D.mean_scores(df)).first().label_id == 0


def test_encode_and_alignment(spark):
    tok = spark.createDataFrame([("s", 0, 1), ("s", 2, 7), ("s", 8, 11)], "sample_id string, start int, end int")
    ent = lambda *e: spark.createDataFrame([("s", *x) for x in e], "sample_id string, ent_idx int, start int, end int, label string")
    tags = lambda e, **k: [r.tag for r in D.encode(tok, D.owners(tok, e, **k)).orderBy("start").collect()]
    assert tags(ent((0, 0, 7, "x"))) == ["B-x", "I-x", "O"]
    assert tags(ent((0, 0, 7, "x"), (1, 2, 7, "y"))) == ["B-x", "B-y", "O"]
    assert tags(ent((0, 0, 5, "x"))) == ["B-x", "I-x", "O"]
    assert tags(ent((0, 0, 5, "x")), alignment="skip") == ["O", "O", "O"]
    for bad in ({"alignment": "strict"},):
        with pytest.raises(Exception):
            tags(ent((0, 0, 5, "x")), **bad)
    with pytest.raises(Exception):
        tags(ent((0, 0, 7, "x"), (1, 2, 7, "y")), overlap="error")
    with pytest.raises(ValueError):
        D.owners(tok, ent((0, 0, 5, "x")), alignment="other")


def test_windows(spark):
    for n in (0, 1, 9, 10, 11, 16, 17, 40):
        got = spark.range(1).select(D.windows(F.array_repeat(F.lit("t"), n), 10, 4).alias("w")).first().w
        want = [min(10, n - a) for a in range(0, max(1, n - 4), 6)] if n > 10 else [n]
        assert [len(x) for x in got] == want


def test_windows_compute_their_array_once(spark):
    """A text's tokens were computed anew for each of its windows."""
    tokens = F.split(F.col("t"), " ")
    plan = spark.range(1).select(F.lit("a b").alias("t")).select(D.windows(tokens, 10, 4).alias("w"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1


def test_overlaps_against_plain(spark):
    r = random.Random(9)
    rows = [(s, i, a, a + r.randint(1, 150)) for s in range(5) for i in range(20) for a in [r.randint(0, 400)]]
    got = {(x.s, x.idx, x.other_idx) for x in D.overlapping(spark.createDataFrame(rows, "s int, idx int, start int, end int"), ["s"]).collect()}
    assert got == {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3]}


def test_overlaps_of_spans_of_all_lengths(spark):
    r = random.Random(10)
    rows = [(s, i, a, a + r.choice((0, 1, 5, 63, 64, 300, 5_000, 70_000))) for s in range(3) for i in range(60) for a in [r.randint(-3_000, 90_000 if s else 400)]]
    df = spark.createDataFrame(rows, "s int, idx int, start int, end int")
    found = D.overlapping(df, ["s"])
    assert sorted(map(tuple, found.collect())) == sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3])
    # a span of a billion buckets of the old width couldn't be filed at all
    far = spark.createDataFrame([(0, 1, 5, 10**12), (0, 2, 7, 10**12), (0, 3, 9, 20)], "s int, idx int, start long, end long")
    assert sorted(map(tuple, D.overlapping(far, ["s"]).collect())) == [(0, 1, 2), (0, 1, 3), (0, 2, 3)]


def test_exact_metrics(spark):
    g = spark.createDataFrame([("A",), ("A",), ("B",)], "k string")
    p = spark.createDataFrame([("A",), ("A",), ("A",), ("C",)], "k string")
    r = E.exact(g, p, ["k"]).first()
    assert (r.tp, r.fp, r.fn) == (2, 2, 1)
    assert (r.precision, r.recall, r.f1) == (0.5, pytest.approx(2 / 3), pytest.approx(4 / 7))
    empty = g.limit(0)
    assert E.exact(empty, empty, ["k"]).first()[:3] == (0, 0, 0)


COLUMNS = "document_id string, passage_key string, passage_offset int, passage_text string, locations array<struct<offset:int,length:int>>, text string, idx bigint"


def _mentions(spark, rows):
    return spark.createDataFrame([("d", "p", 0, t, [tuple(x) for x in loc], w, i) for i, (t, loc, w) in enumerate(rows)], COLUMNS)


def test_relaxed_blacklist_and_order(spark):
    t = "T cells and B cells"
    g = _mentions(spark, [(t, [(0, 7)], "T cells"), (t, [(12, 7)], "B cells")])
    p = _mentions(spark, [(t, [(2, 5)], "cells"), (t, [(8, 5)], "and B")])
    assert E.relaxed(g, p).first()[:3] == (1, 1, 1)
    g = _mentions(spark, [("", [(0, 5)], "a"), ("", [(5, 5)], "b")])
    assert E.relaxed(g, _mentions(spark, [("", [(4, 2)], "x"), ("", [(0, 5)], "y")])).first().tp == 1
    assert E.relaxed(g, _mentions(spark, [("", [(0, 5)], "y"), ("", [(4, 2)], "x")])).first().tp == 2


def plain_matches(rows):
    """Predictions in order take the free gold mention of the largest overlap; tokens are found in the text."""
    text, at = rows[0].passage_text, rows[0].passage_offset
    tokens = [(at + m.start(), at + m.end()) for m in re.finditer(r"\S+", text)]
    gold, out = [], set()
    for r in rows:
        spans = [(x["offset"], x["offset"] + x["length"]) for x in r.locations]
        touched = {i for i, (a, b) in enumerate(tokens) for s, e in spans if a < e and s < b}
        if r.side == "gold":
            gold.append((r.idx, spans, touched))
            continue
        best, most = None, -1
        for k, (_, g, theirs) in enumerate(gold):
            shared = sum(max(0, min(e, e2) - max(s, s2)) for s, e in g for s2, e2 in spans)
            if (bool(theirs & touched) if theirs and touched else shared > 0) and shared > most:
                best, most = k, shared
        if best is not None:
            out.add((gold.pop(best)[0], r.idx, most))
    return out


def test_relaxed_islands_change_nothing(spark):
    r = random.Random(8)
    for text in ("", "ab cde f ghij kl mnop q rst uvw xyz " * 3):
        row = lambda i, side: SimpleNamespace(side=side, idx=i, locations=[{"offset": r.randint(7, 97), "length": r.randint(1, 9)}], passage_offset=7, passage_text=text)
        g, p = [row(i, "gold") for i in range(30)], [row(i, "pred") for i in range(30)]
        frame = lambda rows: spark.createDataFrame([("d", "p", 7, text, [(x.locations[0]["offset"], x.locations[0]["length"])], "w", x.idx) for x in rows], COLUMNS)
        got = {(m.gold_idx, m.pred_idx, m.overlap) for m in E.relaxed_matches(frame(g), frame(p)).collect()}
        assert got == plain_matches(g + p)


def test_normalisation_worked_case(spark):
    rows = [("CL:1", [("CL:1", "0.9")]), ("CL:1", [("CL:9", "-0.1"), ("CL:1", "0.2")]), ("CL:2;CL:3", []), ("CL:4 (skos:related)", [("CL:5", "0.5")]), ("None", [])]
    loc = [(0, 1)]
    gold = spark.createDataFrame([("p", "cell_type", i, loc, 0, 0, n) for n, (i, _) in enumerate(rows)], "passage_key string, entity_type string, identifier string, locations array<struct<offset:int,length:int>>, doc_idx int, passage_id int, ann_idx int")
    ranked = spark.createDataFrame(
        [("p", "cell_type", i, loc, 0, 0, n, k, pid, s) for n, (i, ps) in enumerate(rows) for k, (pid, s) in enumerate(ps)],
        "passage_key string, entity_type string, identifier string, locations array<struct<offset:int,length:int>>, doc_idx int, passage_id int, ann_idx int, rank int, pred_id string, score_text string",
    )
    for iterator, ids in (("exact_ids", {"CL:1"}), ("single_id", {"CL:1", "CL:4"}), ("all_ids", {"CL:1", "CL:2", "CL:3", "CL:4"})):
        got = gold.select(F.explode(E.ITERATORS[iterator]()).alias("x")).distinct().collect()
        assert {r.x for r in got} == ids
    r = E.normalisation(gold, ranked, "single_id", ["cell_type"]).filter("topk = 1").first()
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5)


def test_grid_moves_each_annotation_once(spark):
    """Every setting equals `normalisation` alone, whether predictions are rows or candidates, and no row moves for each setting."""
    r = random.Random(4)
    kinds = ("cell_phenotype", "cell_hetero", "cell_type", "other")
    some = ("CL:1", "CL:2", "CL:1;CL:3", "CL:2 (skos:related)", "None")
    rows = [(f"p{r.randint(0, 9)}", r.choice(kinds), r.choice(some), [(r.randint(0, 3), 1)], 0, 0, n, [(k, r.choice(("CL:1", "CL:2", "CL:3", "-")), r.choice(("0.5", "-1", "x", None))) for k in range(3)]) for n in range(120)]
    schema = "passage_key string, entity_type string, identifier string, locations array<struct<offset:int,length:int>>, doc_idx int, passage_id int, ann_idx int, candidates array<struct<rank:int,pred_id:string,score_text:string>>"
    packed = spark.createDataFrame(rows, schema)
    gold = packed.drop("candidates")
    ranked = packed.select(*gold.columns, F.explode("candidates").alias("c")).select(*gold.columns, "c.*")
    cols = ["topk", "numerator", "precision_denominator", "recall_denominator", "f1"]
    for end_to_end in (False, True):
        want = sorted((i, "+".join(t), *x) for i, t in E.GRID for x in E.normalisation(gold, ranked, i, t, end_to_end).select(*cols).collect())
        for form in (ranked, packed):
            got = E.grid(gold, form, E.GRID, end_to_end)
            assert sorted(map(tuple, got.select("iterator", "entity_types", *cols).collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 0 and plan.count("Generate explode") + plan.count("Generate posexplode") == 4


def test_macro(spark):
    rows = spark.createDataFrame([("a", "s", "NER", "exact", 1, 0.4, 0.4, 0.4), ("b", "s", "NER", "exact", 2, 0.8, 0.8, 0.8), (E.MACRO, "s", "NER", "exact", None, 9.0, 9.0, 9.0)], "dataset string, system string, task string, criterion string, tp int, precision double, recall double, f1 double")
    out = [r for r in E.with_macro(rows).collect() if r.dataset == E.MACRO]
    assert any(r.f1 == pytest.approx(0.6) and r.tp is None for r in out)
    assert "| 0.400 |" in E.markdown(E.pivoted(rows, ["a", "b"]))


def test_abbreviation_table(spark):
    rows = [("SMC", "CL:9000001"), ("S-MC", "CL:9000001"), ("EC", "CL:9000002"), ("EC", "CL:9000003"), ("NK", "CL:9000004;CL:9000005"), ("XX", "-")]
    t = A.lookup(spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "short_form string, identifier string, line_no bigint"))
    assert {r.key: (r.short_form, r.identifier) for r in A.direct(t).collect()} == {"SMC": ("S-MC", "CL:9000001"), "NK": ("NK", "CL:9000004")}
    assert {r.key: r.identifiers for r in A.ambiguous(t).collect()} == {"EC": ["CL:9000002", "CL:9000003"]}
    m = spark.createDataFrame([("d1", "EC"), ("d2", "EC"), ("d3", "EC"), ("d1", "SMC"), ("d1", "unknown phrase here")], "document_key string, mention_text string")
    forms = spark.createDataFrame([("d1", "EC", "endothelial cell"), ("d2", "ECs", "endothelial cells")], "document_key string, short_key string, long_form string")
    got = {(r.document_key, r.mention_text): (r.resolution, r.expanded_long_form, r.long_form_method) for r in A.resolve(m, t, forms).collect()}
    assert got[("d1", "EC")] == ("ambiguous_long_form", "endothelial cell", "exact_key")
    assert got[("d2", "EC")] == ("ambiguous_long_form", "endothelial cells", "exact_variant")
    assert got[("d3", "EC")][0] == "ambiguous_unresolved" and got[("d1", "SMC")][0] == "direct" and got[("d1", "unknown phrase here")][0] is None


def test_fuzzy_long_form(spark):
    w = spark.createDataFrame([("d", "ABCDEFGHIJ")], "document_key string, matched_key string")
    f = spark.createDataFrame([("d", "ABCDEFGHIX", "long"), ("d", "Q", "no")], "document_key string, short_key string, long_form string")
    assert A.expand(w, f).first().long_form_method == "fuzzy_shortform"


def test_retrieval_in_blocks_equals_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(120)] + [(200, [0.0] * 8)]
    terms = spark.createDataFrame(rows, "term_idx bigint, vector array<float>")
    queries = spark.createDataFrame(rows[:30], "query_idx bigint, vector array<float>")
    key = lambda df: sorted((r.query_idx, r["rank"], r.term_idx, round(r.score, 9)) for r in df.collect())
    whole = key(L.retrieve(queries, terms, 7))
    monkeypatch.setattr(L, "BROADCAST_TERMS", 10)
    assert key(L.retrieve(queries, terms, 7, block=25)) == whole and len(whole) == 210


def test_best_of_groups_equal_a_full_sort():
    rng = np.random.default_rng(5)
    q, x = rng.standard_normal((7, 6)), np.repeat(rng.standard_normal((900, 6)), 3, axis=0)  # each term three times: ties
    idx = rng.permutation(len(x))
    row, terms, _ = L._top(q, x, idx, 10)
    for i, s in enumerate(q @ x.T):
        assert terms[row == i].tolist() == idx[np.lexsort((idx, -s))[:10]].tolist()


def test_large_dictionaries_move_queries_only(spark, monkeypatch):
    """Queries were copied for each block of terms, terms for each part of the queries, and the blocks' best merged."""
    rows = spark.range(60).select(F.col("id").alias("query_idx"), F.array(F.sin("id"), F.cos("id")).alias("vector"))
    monkeypatch.setattr(L, "BROADCAST_TERMS", 10)
    monkeypatch.setattr(L, "PAIRS", 600)
    got = L.retrieve(rows, rows.withColumnRenamed("query_idx", "term_idx"), 3, block=7)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    assert got.count() == 180 and got.filter("rank = 0 and query_idx = term_idx").count() == 60


def test_rerank_score(spark):
    cand = spark.createDataFrame([(1, "C", 0, -0.1, "n", "smooth muscle cell", True)], "query_idx bigint, identifier string, prior int, embedding_score double, name string, preferred_label string, is_preferred boolean")
    concepts = spark.createDataFrame([("C", ["smooth muscle cell"], "smooth muscle cell")], "identifier string, names array<string>, preferred_label string")
    q = spark.createDataFrame([(1, "muscle cell")], "query_idx bigint, query_text string")
    assert L.rerank(cand, q, concepts).first().final_score == pytest.approx(0.201264, abs=1e-6)


def test_encoders(spark):
    h = HashingEncoder(16)
    assert (h.vectors(["a b"]) == h.vectors(["a b"])).all()
    df = encode(spark.createDataFrame([("a",), (None,)], "t string"), TableEncoder({"a": [1.0, 2.0]}), "t")
    assert {tuple(r.vector) for r in df.collect()} == {(1.0, 2.0), (0.0, 0.0)}


class OneLetter:
    """Counts of letters whatever their case, so that case alone never tells keys apart."""

    size = 26

    def vectors(self, texts):
        return np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], dtype=float)


def test_short_keys_match_themselves_alone(spark):
    rows = [("TC", "CL:1"), ("ABCDEFGH", "CL:2")]
    t = A.lookup(spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "short_form string, identifier string, line_no bigint"))
    m = spark.createDataFrame([("tc",), ("TC",), ("Tc",), ("ABCDEFGH",), ("abcdEFGH",)], "mention_text string")
    got = {r.mention_text: (r.matched_key, r.method) for r in A.match_keys(m, t, OneLetter()).collect()}
    assert got == {"TC": ("TC", "exact_short_abbreviation"), "ABCDEFGH": ("ABCDEFGH", "encoder_abbreviation_match"), "abcdEFGH": ("ABCDEFGH", "encoder_abbreviation_match")}


def test_detector_outputs():
    pair = SimpleNamespace(short="A", long="alpha")
    for found in ({"A": " alpha ", "": "x"}, [("A", "alpha", 3)], [["A", "alpha"]], [{"abbr": "A", "expansion": "alpha"}], [pair], [{"short": "A", "long_form": "alpha"}, ("x",), {}]):
        assert A.detector_pairs(found) == [("A", "alpha")]
    assert A.detector_pairs(None) == [] and A.detector_pairs("text") == []


def test_label_orders():
    labels = ["O", "B-a", "I-a"]
    assert D.aligned_labels(labels, None) == labels == D.aligned_labels(labels, {0: "LABEL_0", 1: "LABEL_1", 2: "LABEL_2"})
    assert D.aligned_labels(labels, {"1": "O", "0": "I-a", "2": "B-a"}) == ["I-a", "O", "B-a"]


def test_entity_lists_need_all_parts(spark):
    df = lambda t: spark.createDataFrame([(t,)], "t string").select(D.canonical_entities("t").alias("e"))
    assert df('[{"start": 1, "end": 2, "label": "x"}]').first().e[0].label == "x" and df(" ").first().e == [] and df(None).first().e == []
    for bad in ('[{"start": 1, "end": 2}]', '{"start": 1}', "nonsense"):
        with pytest.raises(Exception):
            df(bad).collect()


def test_mentions_need_a_text(spark):
    from mentionlake.operators import filters

    df = spark.createDataFrame([("t", "m"), ("", "m"), ("", None)], "text string, mention string")
    got = filters.coerce_mentions(df).collect()
    assert [(r.mention, r.entity_type) for r in got] == [("t", None), ("m", None), ("", None)]
    with pytest.raises(Exception):
        filters.coerce_mentions(spark.createDataFrame([(None, 1)], "text string, start int")).collect()


def test_full_rerank_against_plain(spark):
    """All features, by the definitions, in plain Python."""
    import difflib
    import re

    r = random.Random(5)
    word = lambda: r.choice(["T", "cell", "CD8+", "(NK)", "natural", "killer", "alpha-beta", "Straße", "STRASSE", "t"])
    text = lambda: " ".join(word() for _ in range(r.randint(1, 4)))
    concepts = {f"C{i}": (text(), sorted({text() for _ in range(3)})) for i in range(6)}
    queries = {i: text() for i in range(8)}
    cand = [(q, c, n, -r.random(), text(), text(), r.random() < 0.5) for q in queries for n, c in enumerate(r.sample(sorted(concepts) + ["C9"], 4))]
    fold = lambda t: " ".join(t.casefold().split())

    def jaccard(a, b):
        x, y = set(fold(a).split()), set(fold(b).split())
        return len(x & y) / len(x | y) if x and y else 0.0

    inside = lambda a, b: any(fold(x) == fold(b) for x in re.findall(r"\(([^()]*)\)", a))
    want = {}
    for q, c, n, e, name, label, preferred in cand:
        names = concepts[c][1] if c in concepts else [name, label]
        label = concepts[c][0] if c in concepts else label
        t = queries[q]
        s = e + 0.35 * any(fold(t) == fold(x) for x in names) + 0.2 * max(jaccard(t, x) for x in names) + 0.15 * jaccard(t, label)
        s += 0.1 * any(inside(t, x) or inside(x, t) for x in names) + 0.05 * max(difflib.SequenceMatcher(None, fold(t), fold(x)).ratio() for x in names) + 0.03 * preferred
        want[q, c] = (s, e, n)
    df = spark.createDataFrame(cand, "query_idx bigint, identifier string, prior int, embedding_score double, name string, preferred_label string, is_preferred boolean")
    con = spark.createDataFrame([(c, names, label) for c, (label, names) in concepts.items()], "identifier string, names array<string>, preferred_label string")
    got = L.rerank(df, spark.createDataFrame(list(queries.items()), "query_idx bigint, query_text string"), con).collect()
    for g in got:
        assert g.final_score == pytest.approx(want[g.query_idx, g.identifier][0])
    for q in queries:
        order = sorted((c for x, c in want if x == q), key=lambda c: (-want[q, c][0], -want[q, c][1], want[q, c][2]))
        assert [g.identifier for g in sorted((g for g in got if g.query_idx == q), key=lambda g: g["rank"])] == order


def test_numbers_have_no_gap_where_ranges_are_sampled(spark):
    """More rows than the borders' sample holds, in a plan whose two uses keep different columns."""
    df = spark.range(0, 400_000, 1, 8).select(F.expr("(id * 7919) % 400000").alias("k"), F.col("id"), F.lit("x").alias("more"))
    got = filters.numbered(df, ["k"], "n").agg(F.count("*").alias("n"), F.sum((F.col("n") != F.col("k")).cast("int")).alias("wrong"), F.sum("id").alias("ids")).first()
    assert tuple(got) == (400_000, 0, 400_000 * 399_999 // 2)
