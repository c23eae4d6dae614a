import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mentionlake.llm import _text as X
from mentionlake.llm import ann, classifier, html_text, langid, lm, mixing, packing, quality_rules, queries, sharding, simhash
from mentionlake.llm._spark import components
from tests.llm import brute

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
TOKENIZER = queries.tokenizer_path()

#: nulls, blanks, a very long text, ties, repeated rows, hostile separators
VOCABULARY = ["the", "The", "brébis", "ÉÀ", "x" * 40, "foo", "bar,", "日本語", "y" * 100, "##", "a", "of"]


def texts(seed: int = 1, n: int = 60) -> list:
    r = random.Random(seed)
    made = ["".join(r.choice(VOCABULARY) + r.choice([" ", " ", " ", "\n", "  ", "\t", "\x0b", "\xa0"]) for _ in range(r.randint(1, 90))) for _ in range(n)]
    same = "one text that stands in many rows of this table and has enough words to count"
    return ["", None, " \t\n", "a", "a b", *made, same, same, same, same.upper(), same + " more", "word " * 30_000, "line one of it\n" * 50]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s1", "Z"][i % 5], len(t or ""), "extra") for i, t in enumerate(texts())]
    # columns that clash with outputs of the operators
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").withColumns({"kept": F.lit("x"), "fp": F.lit("y"), "shard": F.lit("z"), "score": F.lit("w")}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def local(df):
    return {r.doc_id: r for r in df.collect()}


# text primitives


@pytest.mark.parametrize("limit", [200, 1 << 20])
def test_words_and_hashes(limit):
    import xxhash

    t = texts(3)
    for lo, hi, data, offs in X.chunks(pa.array(t), limit):
        w = X.Words(data, offs)
        flat, s, e = X.compact(w, lower=True)
        h = X.xxh64(flat, s, e)
        at = 0
        for d in range(lo, hi):
            words = brute.WORD.findall(t[d] or "")
            assert w.counts[d - lo] == len(words)
            for x in words[:500]:
                assert int(h[at]) == xxhash.xxh64_intdigest(brute.lower(x).encode(), 42)
                at += 1
            at += max(0, len(words) - 500)


def test_equal_spans_hash_alike():
    data, offs = X.buffers(pa.array(["ab cd ab", "cd ab"]))
    h = X.Words(data, offs).hashes()
    assert h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]


def test_sliced_and_chunked_columns():
    a = pa.array(["x", None, "yy", "zzz"])
    assert [int(x) for x in X.buffers(a[1:])[1]] == [0, 0, 2, 5]
    assert [int(x) for x in X.buffers(pa.chunked_array([a[:1], a[2:]]))[1]] == [0, 1, 3, 6]
    assert len(X.buffers(pa.array([], pa.string()))[1]) == 1


# 2 quality rules


def test_rules_against_brute_force(docs, empty):
    got = local(quality_rules.quality_rules(docs).select("doc_id", "text", "rules.*", F.col("size").alias("extra")))
    for r in got.values():
        want = brute.rules(r.text)
        assert {k: r[k] for k in want} == want
        assert r.kept == brute.kept(r.text, quality_rules.GRAM_LIMITS, quality_rules.LINE_LIMIT, quality_rules.SYMBOL_LIMIT)
        assert r.extra == "extra"
    assert not got[1].kept and got[1].base_failed
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.quality_rules(docs, out="kept").select("kept.kept").count() == docs.count()


# 6 SimHash


def test_simhash_against_brute_force(docs, empty):
    got = local(simhash.near_duplicates(docs))
    ids = sorted(got)
    t = {r.doc_id: r.text for r in docs.collect()}
    prints = [brute.simhash(t[i]) for i in ids]
    assert [got[i].fp & (2**64 - 1) for i in ids] == prints
    near, label = brute.groups(ids, prints)
    assert [got[i].n_near for i in ids] == near and [got[i].component_id for i in ids] == label
    kept = sorted(r.doc_id for r in simhash.deduplicate(docs).collect())
    assert kept == sorted(set(label))
    assert simhash.deduplicate(docs).columns == docs.columns
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("parts", [2, 4, 8, 16])
def test_tiles_lose_no_pair(spark, parts):
    r = random.Random(parts)
    prints = {r.getrandbits(64) for _ in range(200)} | {0, 2**64 - 1}
    for f in list(prints)[:100]:
        prints |= {f ^ (1 << r.randrange(64)), f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)), f ^ 7}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    got = {frozenset((x.a, x.b)) for x in simhash.near_pairs(df, parts=parts, block=16).collect()}
    rows = [(x.a, x.b) for x in simhash.near_pairs(df, parts=parts, block=16).collect()]
    p = sorted(prints)
    want = {frozenset((signed(a), signed(b))) for i, a in enumerate(p) for b in p[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert got == want and len(rows) == len(want)


def test_repeated_ids_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_near, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == [1, 2]


def test_no_group_is_lost_where_ids_repeat(spark):
    a, b, c, d = (" ".join(random.Random(k).choices([f"w{i}" for i in range(500)], k=40)) for k in range(4))
    rows = [(5, a), (5, b), (3, b), (None, c), (None, d), (None, d), (None, a), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 3, 7):
        got = simhash.deduplicate(df.repartition(parts)).collect()
        assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(5, a), (3, b), (0, c), (0, d), (9, "")])


def test_components(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 100)] + [(1000, r.randint(1001, 1100)) for _ in range(80)]
    got = {x.node: x.component for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[102] == 100 and all(v == 1000 for k, v in got.items() if k >= 1000)


# 3 language, 9 quality classifier


@needs_data
def test_language_accuracy(spark):
    truth = local(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"))
    rows = local(queries.op3_language_id(spark, SF))
    out = [r for r in rows.values() if r.held_out]
    assert all(r.held_out == brute.held(i, 4, 2) for i, r in rows.items())
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in out]) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_edge_cases(spark, docs, empty):
    model = langid.train(pa.array(["the of and to is that", "le la de et les des", "the this is and", "la une de que les"] * 10), ["en", "fr"] * 20, np.arange(40) % 5 == 0)
    df = spark.createDataFrame([(0, None), (1, ""), (2, "12 %% 3"), (3, "éà"), (4, "the of and is this"), (5, "la les des une")], "doc_id long, text string").withColumn("language", F.lit(1))
    got = {r.doc_id: r for r in langid.identify(df, model).select("doc_id", "language.*").collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in range(3))
    assert got[3].lang_pred in ("en", "fr") and (got[4].lang_pred, got[5].lang_pred) == ("en", "fr")
    assert langid.fit(empty) is None and langid.identify(docs, None).filter("language.lang_pred = 'und'").count() == docs.count()
    assert langid.identify(empty, model).count() == 0


@needs_data
def test_classifier_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = local(queries.op9_quality_classifier(spark, SF))
    out = [r for r in rows.values() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) >= 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_classifier_edge_cases(spark, docs, empty):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    model = classifier.fit(docs.select("doc_id", "text"), labels)
    assert classifier.score(docs, model).filter("score between 0 and 1").count() == docs.count()
    assert classifier.fit(docs, labels.limit(0)) is None
    assert classifier.score(docs.select("doc_id", "text"), None).filter("score = 0.5").count() == docs.count()
    assert classifier.score(empty, model).count() == 0


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(200) < 0.5, 1.0, -1.0)
    rows = [(np.array([0, 1, 2]), np.array([v * 2 + rng.normal() * 0.3, rng.normal(), 1.0])) for v in y]
    w = classifier.dual_descent(rows, y, 3)
    assert np.mean([(w[k] @ v > 0) == (t > 0) for (k, v), t in zip(rows, y)]) > 0.97


# 4 packing


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    some = [*texts(6), "x <|endoftext|> y", " lead", "trail ", "it's we'll 12 a3", "a　 b", "\x1c a \x1d", "\x85 x", "a  b", "a \n b"]
    got = [ids.tolist() for _, _, d, o in X.chunks(pa.array(some), 4000) for ids in packing._tokens(TOKENIZER).texts(d, o)]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in some]


def test_packing_is_an_exact_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack(docs, TOKENIZER, capacity=64, islands=2, epochs=1).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d in docs.select("doc_id", "text").collect():
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 2]
        parts = sorted(by_doc.pop(d.doc_id), key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and len(parts) == -(-len(ids) // 64)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:i]) for i in range(len(parts))]
        assert all(p.length == 64 for p in parts[1:]) and sum(p.length for p in parts) == len(ids)
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
    assert not by_doc
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_seq) <= 1.02 * -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_genetic_steps_keep_all_pieces(seed):
    r = random.Random(seed)
    demand = Counter(r.choices(range(1, 100), k=r.randint(1, 500)))
    count = lambda bins: sum((Counter({k: m * n for k, m in Counter(g).items()}) for g, n in bins.items()), Counter())
    found = packing.evolve([], demand, 100, 8, r, 5)
    assert all(count(g) == demand and all(sum(b) <= 100 for b in g) for g in found)
    child = packing.crossover(found[0], found[-1], 100, demand, r)
    assert count(child) == demand and count(packing.mutate(child, 100, r)) == demand
    assert packing.n_bins(found[0]) <= packing.n_bins(packing.best_fit(Counter(), demand, 100))


@pytest.mark.parametrize("lengths", [(200, 700), (300, 420), None])
def test_evolution_beats_its_first_chromosome(lengths):
    """Hard histograms: halves and thirds of a bin, and a few lengths of which many exact sums exist."""
    r = random.Random(1)
    some = [r.choice([257, 259, 341, 343, 511, 513, 170, 171, 128, 205]) if lengths is None else r.randint(*lengths) for _ in range(2000)]
    demand = Counter(some)
    count = lambda bins: sum((Counter({k: m * n for k, m in Counter(g).items()}) for g, n in bins.items()), Counter())
    made = packing.filled(demand, 1024, r)
    assert count(made) == demand and all(sum(g) <= 1024 for g in made)
    found = packing.evolve([], demand, 1024, packing.GENERATIONS, r, packing.POPULATION)[0]
    assert count(found) == demand and all(sum(g) <= 1024 for g in found)
    assert -(-sum(some) // 1024) <= packing.n_bins(found) < packing.n_bins(packing.best_fit(Counter(), demand, 1024))
    assert packing.filled(Counter(), 1024) == Counter()


# 5 mixing


def test_mixing_against_brute_force(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    t = {r.doc_id: r for r in docs.collect()}
    size = {i: len(brute.WORD.findall(r.text or "")) for i, r in t.items()}
    sizes = Counter()
    for i, r in t.items():
        sizes[r.source] += size[i]
    names = [*sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]), *([None] if None in sizes else [])]
    goal = brute.water(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)})
    taken = Counter()
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[r.source] and r.target == goal[r.source]
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes) and len(rows) == len(t)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert mixing.mix(empty).count() == 0


def test_mixture_has_the_words_taken(docs, empty):
    plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = Counter()
    for r in mixing.mixed(docs).collect():
        got[r.doc_id] += len(brute.WORD.findall(r.text or ""))
    assert got == Counter({k: v for k, v in plan.items() if v})
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_nearest_subset(seed):
    r = random.Random(seed)
    sizes, goal = [r.randint(1, 300) for _ in range(9)], r.randint(0, 900)
    sums = [sum(s for k, s in enumerate(sizes) if m >> k & 1) for m in range(1 << 9)]
    got = mixing.nearest_subset(sizes, goal)
    assert abs(sum(s for s, t in zip(sizes, got) if t) - goal) == min(abs(x - goal) for x in sums)
    assert mixing.nearest_subset([10**9, 3], 10**9) == [True, False]


def test_pipeline_mixture_has_whole_documents(spark, docs, empty):
    import corpus_pipeline as P

    assert P.mixture(spark, empty, "").count() == 0
    goal = {r.source: r.target for r in mixing.mix(docs).collect()}
    given = Counter((r.doc_id, r.text) for r in docs.collect())
    got, words = Counter(), Counter()
    for r in P.mixture(spark, docs, "").collect():
        got[r.doc_id, r.text] += 1
        words[r.source] += len(brute.WORD.findall(r.text))
    assert set(got) <= set(given) and max(got.values()) <= 3
    small = [s for s in goal if goal[s] < 20_000]
    assert len(small) >= 3 and all(abs(words[s] - goal[s]) <= 60 for s in small)
    # ids that are null or repeated: each row is counted on its own, alike rows share
    rows = [(None, f"n{i}\n " * (i % 7 + 1), "ab"[i % 2]) for i in range(60)] + [(1, "x y", "a")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r.source: r.target for r in mixing.mix(df).collect()}
    some = P.mixture(spark, df, "").collect()
    assert {(r.doc_id, r.text, r.source) for r in some} <= set(rows)
    assert all(abs(sum(len(r.text.split()) for r in some if r.source == s) - want[s]) <= 1 for s in "ab")


# 10 sharding


def check_shards(rows, tolerance):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    even = sum(r["size"] for r in rows) / 8
    biggest = max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in by[k]) - even) <= tolerance * even + 2 * biggest for k in range(8))
    return by


def test_sharding(spark, docs, empty):
    rows = sharding.shard(docs.filter("length(text) < 20000 or text is null")).collect()
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in rows)
    check_shards(rows, 0.01)
    assert sharding.shard(docs).count() == docs.count()
    assert sharding.shard(empty).count() == 0


def test_sharding_against_brute_force(spark):
    """Shards are runs of the order by (hash of the text, doc_id), cut where no other cut is nearer an even share by more than the tolerance."""
    r = random.Random(6)
    rows = [(i if i % 9 else None, None if i % 50 == 0 else "w" * int(r.paretovariate(0.9)) + str(r.randint(0, 400))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df).withColumn("h", sharding.text_key("text")).collect()
    assert Counter((x.doc_id, x.text) for x in got) == Counter(rows)
    order = sorted(got, key=lambda x: (x.h, -(2**63) if x.doc_id is None else x.doc_id, x.shard, x.slot))
    assert [x.shard for x in order] == sorted(x.shard for x in got)
    for k in range(8):
        part = [x for x in order if x.shard == k]
        assert [x.slot for x in part] == list(range(len(part)))
    below = np.append(0, np.cumsum([x["size"] for x in order]))
    even = below[-1] / 8
    for k in range(1, 8):
        cut = sum(x.shard < k for x in order)
        assert abs(below[cut] - k * even) <= max(sharding.TOLERANCE * even, np.abs(below - k * even).min())


def test_columns_that_clash_pass_through(spark):
    names = ["id", "size", "taken", "rows", "n", "part", "row_key", "copies", "nth", "share", "copy", "key", "sub", "band", "fine", "inside", "bits", "first", "_id", "_size", "_taken", "_keep", "_key", "_sub", "_row_key", "fp", "shard", "slot", "language", "rules", "_language", "_rules"]
    rows = [(i, f"text number {i % 30} of some words that are enough of them to be kept by all rules", "ab"[i % 2], "en") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({n: F.lit(f"mine {n}") for n in names})
    import corpus_pipeline as P

    for made in (mixing.mixed(df), mixing.mixed_whole(df), simhash.deduplicate(df), sharding.shard(df), P.identify_language(spark, df, ""), P.quality(spark, df, "")):
        replaced = {"size", "shard", "slot"} & set(made.columns) if "slot" in made.columns and made.schema["slot"].dataType.typeName() != "string" else set()
        got = made.collect()
        assert got and all(r[n] == f"mine {n}" for r in got for n in names if n not in replaced)


def test_hot_group_is_split_and_others_stay_whole(spark):
    r = random.Random(3)
    rows = [(i, "a hot text" if i % 3 == 0 else f"text {r.randint(0, 300)} " + "w" * 5) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), tolerance=0.01).collect()
    by = check_shards(got, 0.03)
    places = defaultdict(set)
    for k, part in by.items():
        for x in part:
            places[x.text].add(k)
    assert len(places["a hot text"]) >= 3
    assert sum(len(v) > 1 for t, v in places.items() if t != "a hot text") <= 7


def test_alike_rows_are_split(spark):
    got = sharding.shard(spark.createDataFrame([(7, "same")] * 400, "doc_id long, text string")).collect()
    check_shards(got, 0.05)


# 7 language model


@pytest.mark.parametrize("priors", [(300.0,), lm.PRIORS, (20.0, 5.0, 2.0)])
def test_lm_against_brute_force(spark, docs, empty, priors):
    t = {r.doc_id: r.text for r in docs.collect()}
    want = brute.backoff_scores(t, priors)
    for size in (1 << 30, 4000):  # one block and range, and many
        rows = local(lm.score_texts(docs, priors=priors, block_bytes=size, range_bytes=2 * size))
        assert rows.keys() == t.keys()
        for i, r in rows.items():
            n, known, total, base, score = want[i]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, brute.held(i, 5, 1))
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    assert lm.score_texts(empty, priors=priors).count() == 0


def test_lm_walkers_agree_and_rows_repeat(spark):
    r = random.Random(4)
    long = " ".join(r.choice("abcdefgh") for _ in range(3000))
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))) for i in range(200)] + [(7, "a b c"), (7, "a b c"), (None, "a"), (None, None), (900, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit(1), "learn": F.lit("x"), "keys": F.lit(2)})
    got = lm.score_texts(df, block_bytes=500, range_bytes=3000)
    assert got.count() == len(rows)
    table = pa.table({"text": [t for _, t in rows], "learn": [True] * len(rows)})
    bounds, levels = lm._block(table, 3, 40)
    levels = list(levels)
    counts = [g.own.astype(float) for _, g in levels]
    counts[2] = counts[2] * (np.arange(len(counts[2])) % 2)  # arcs that are missing, so that failures are taken
    model = lm.Automaton(bounds, levels, counts, 100, 9, lm.PRIORS)
    assert (model.arc[2] < 0).sum() > 1000 and model.below.max() > 0
    whole = model.traverse(1 << 20)
    for stretch in (2, 7, 64):
        assert np.allclose(model.traverse(stretch), whole, rtol=1e-12)


def test_number_packing():
    k = np.sort(np.random.default_rng(1).integers(0, 2**63, 999, dtype=np.uint64) * np.uint64(2))
    assert (lm._unpacked(lm._packed(k)) == k).all() and len(lm._unpacked(lm._packed(k[:0]))) == 0


# 8 pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="top">Head</header><nav><a href="/">Menu</a></nav>
<div class="cookie-notice">We use cookies</div><div id="wrap7"><div class="post-12"><h1>Title &amp; more</h1><p>First   paragraph
with <b>bold</b> text and enough words.<p>Second one&nbsp;here, with a fair number of words in it.</p><ul><li>item</ul><div class="ad">Buy</div>
<form><input value="x">Send</form><div class="comments"><p>a reader's comment that is long enough to matter, surely it is</p></div></div>
<aside>Side</aside></div><script>var p="<p>no</p>"</script><footer>Foot</footer></body></html>"""


def test_extraction(spark):
    want = "Title & more\nFirst paragraph with bold text and enough words.\nSecond one here, with a fair number of words in it.\nitem"
    assert html_text.extract(PAGE, []) == want
    rows = [(i, f"http://Host.example/{i}", PAGE.replace("post-12", f"post-{i}")) for i in range(5)]
    rows += [(5, None, None), (6, "nonsense", ""), (7, "http://host.example/x", "<p>only this"), (8, "http://host.example/y", PAGE[:-40]), (8, "http://host.example/y", PAGE[:-40])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("_paths", F.lit(1))
    got = defaultdict(list)
    for r in html_text.main_text(df).collect():
        got[r.page_id].append(r.text)
    assert all(got[i] == [want] for i in range(5)) and got[5] == [""] and got[6] == [""] and got[7] == ["only this"] and got[8] == [want, want]
    paths = {r._host: r._paths for r in html_text.host_paths(df).collect()}
    assert paths["host.example"][0].endswith("div.post-#")
    assert html_text.main_text(df.limit(0)).count() == 0


LONG = "a sentence of the article that is long enough to count for something, and goes on. "


@pytest.mark.parametrize("name", ["related-work", "search-methods", "article-header", "football-news", "post category-football", "content no-sidebar", "content-with-sidebar", "layout has-sidebar", "entry social", "tagline", "menus-of-antiquity"])
def test_names_that_belong_to_articles(name):
    page = f'<body><nav>menu</nav><article><h1>Head</h1><p>{LONG}</p><div class="{name}"><h2>More</h2><p>{LONG}</p></div></article></body>'
    assert html_text.extract(page, []) == f"Head\n{LONG.strip()}\nMore\n{LONG.strip()}"
    assert html_text.extract(f'<body><div class="{name}"><article><p>{LONG}</p></article></div></body>', []) == LONG.strip()


@pytest.mark.parametrize("name", ["ad", "adBanner", "cookie-notice", "comment-list", "reader-comments", "left-sidebar", "site-header", "footer", "newsletter-signup", "share-buttons", "related-posts", "search-form", "promo", "widget_area", "breadcrumbs"])
def test_names_around_articles(name):
    page = f'<body><article><h1>Head</h1><p>{LONG * 3}</p><div class="{name}"><p>Not this.</p></div><p>{LONG}</p></article><div id="{name}">Nor this.</div></body>'
    assert html_text.extract(page, []) == f"Head\n{(LONG * 3).strip()}\n{LONG.strip()}"
    # a name alone drops neither an article nor most of a page
    assert html_text.extract(f'<body><div class="{name}"><article><p>{LONG}</p></article></div></body>', []) == LONG.strip()
    assert html_text.extract(f'<body><div class="{name}"><p>{LONG}</p></div><p>x</p></body>', []).startswith(LONG.strip())


def test_consensus_outvotes_a_page(spark):
    """Most pages of a host keep their text in one place; a page whose comments are longer follows them."""
    page = '<body><div class="a"><p>{}</p></div><div class="b"><p>{}</p></div></body>'
    rows = [(i, "http://h.example/1", page.format(LONG * 4, "short")) for i in range(30)] + [(30, "http://h.example/2", page.format(LONG, LONG * 9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    # brute force: the path that most pages vote for
    votes = Counter(html_text.best_path(h)[0] for _, _, h in rows)
    top = [p for p, n in votes.most_common() if n >= html_text.SHARE * len(rows)]
    assert got == {i: html_text.extract(h, top) for i, _, h in rows}
    assert got[30] == LONG.strip()


@needs_data
def test_pages_give_their_documents(spark):
    known = {r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op8_html_extraction(spark, SF).collect()
    assert all(r.text.split("\n", 1)[1] in known for r in rows if "\n" in r.text) and all(r.n_chars == len(r.text) for r in rows)


# 1 nearest neighbours


def test_ann_recall_and_order(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16))
    x[1000:2000] = x[999]  # a third of all rows in one place
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)]
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [float("inf")] * 16), (3080, [1.0]), (None, [1.0] * 16), (3100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.search(df, leaf_rows=50, block=500, calibration=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    asked = [i for i in range(3000) if i % 20 == 0]
    assert sorted(got) == asked
    hits = 0
    for i in asked:
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(3000), -s)) if j != i][:20]
        found = got[i]
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(r.score == s[r.vec_id] for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found) and i not in [r.vec_id for r in found]
        hits += len(set(order) & {r.vec_id for r in found})
    assert hits / (20 * len(asked)) >= 0.9
    assert ann.search(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (21, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert ann.search(few).count() == 4


def test_ann_repeated_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    rows += [rows[0], rows[0], rows[30], (20, [float(v) for v in x[21]])]  # a query three times, a candidate twice, one id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"query": F.lit(1), "cell": F.lit(2), "leaf": F.lit("x")})
    got = defaultdict(list)
    for r in ann.search(df, recall=1.0, queries_at_once=5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 20))
    every = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows])
    for q, found in got.items():
        lists = [x[q]] if q != 20 else [x[20], x[21]]
        want = []
        for v in lists:
            s = (m * v).sum(axis=1)
            best = [j for j in np.lexsort((every, -s)) if every[j] != q][:20]
            want += [(n, int(every[j]), s[j]) for n, j in enumerate(best, 1)]
        assert sorted(found) == sorted(want)


def test_ann_multiplies_visited_leaves_only():
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((40, 16)) * 6
    x = centre[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16))
    tree = ann.Tree(x, 4000 // ann.LEAF_ROWS)
    leaf = tree.assign(x)
    size = np.bincount(leaf, minlength=len(tree.leaf_of))
    first, parts = ann.cells(size, 500)
    assert (parts == 1).all() and np.bincount(first, weights=size).max() <= 500
    big, several = ann.cells(np.array([3, 2000, 4, 5]), 500)
    assert big.tolist() == [0, 1, 5, 5] and several.tolist() == [1, 4, 1, 1]
    q = np.arange(0, 4000, 20)
    visits = [np.array(v) for v in tree.visits(x[q], 12)]
    found, products = ann.meet(q, q, x[q], visits, np.arange(4000), x, leaf, 20)
    assert products == sum(int(size[v].sum()) for v in visits) < 0.2 * len(q) * len(x)
    hits = 0
    for (_, _, ids, score, at), i in zip(found, q):
        s = (x * x[i]).sum(axis=1)
        assert (score == s[ids]).all() and (leaf[ids] == at).all()
        hits += len(set(ids) & {j for j in np.argsort(-s)[:21] if j != i})
    assert hits / (20 * len(q)) > 0.9


# the pipeline


@needs_data
def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "quality_rules", "near_duplicates", "source_mixing", "best_fit_packing"]
    now, before = docs, None
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert now.columns == docs.columns
        t = {r.doc_id: r for r in before.collect()}
        if name == "quality_rules":
            want = {i for i, r in t.items() if brute.kept(r.text, quality_rules.GRAM_LIMITS, quality_rules.LINE_LIMIT, quality_rules.SYMBOL_LIMIT)}
            assert {r.doc_id for r in now.collect()} == want
        if name == "near_duplicates":
            ids = sorted(t)
            assert sorted(r.doc_id for r in now.collect()) == sorted(set(brute.groups(ids, [brute.simhash(t[i].text) for i in ids])[1]))
        if name == "source_mixing":
            words = lambda df: sum(len(brute.WORD.findall(r.text)) for r in df.collect())
            assert abs(words(now) - words(before)) <= 20
    pieces = now.collect()
    assert len({r.sequence_id for r in pieces}) <= 1.02 * sum(r.length for r in pieces) / 1024 + 2


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = con.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(found.column_names) == columns
    order = lambda r: tuple((x is None, str(x) if not isinstance(x, float) else "") for x in r)
    want = sorted((tuple(r[c] for c in columns) for r in found.to_pylist()), key=order)
    have = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=order)
    assert len(want) == len(have)
    for a, b in zip(want, have):
        for x, y in zip(a, b):
            assert (x == pytest.approx(y, rel=1e-9)) if isinstance(x, float) else x == y
