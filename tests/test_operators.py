"""Operators on hand-made rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cooccur, deps, events, graph, likeness, reports, resolve, sections, spans


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()))


def test_span_map_takes_the_last(spark):
    df = spark.createDataFrame([("A", 1, 3, 0), ("B", 2, 2, 1), ("C", 9, 8, 2)], "coref string, start_token int, end_token int, pos int")
    assert rows(spans.span_token_map(df), "token_id", "coref") == [(1, "A"), (2, "B"), (3, "A")]


def test_islands(spark):
    df = spark.createDataFrame([(1, [10, 20, 21, 22, 50]), (2, []), (3, None)], "k int, ids array<int>")
    got = rows(spans.islands(df, "ids", ["k"]), "k", "run", "ids", "start", "stop")
    assert got == [(1, 0, [10], 0, 1), (1, 1, [20, 21, 22], 1, 4), (1, 2, [50], 4, 5), (2, 0, [], 0, 0), (3, 0, [], 0, 0)]


def test_pairs_and_edges(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (1, 1), (2, 7), (3, 1), (3, 2), (None, 1), (4, None)], "sentence_id int, canonical_id int")
    present = cooccur.presence(df)
    edges = cooccur.edges(cooccur.pairs(present), lists=True)
    assert rows(edges, "source_id", "target_id", "weight", "sentence_ids") == [(1, 2, 2, [1, 3]), (1, 3, 1, [1]), (2, 3, 1, [1])]
    assert rows(cooccur.occurrences(present)) == [(1, 2), (2, 2), (3, 1), (7, 1)]
    assert [r.weight for r in cooccur.top_pairs(edges, 1).collect()] == [2]
    assert cooccur.edges(cooccur.pairs(present.limit(0))).columns == ["source_id", "target_id", "weight"]


def test_weights_add_up_whatever_the_partitions(spark):
    rng = random.Random(1)
    data = [(rng.randrange(30), rng.randrange(12)) for _ in range(300)]
    want = sum(len(set(g)) * (len(set(g)) - 1) // 2 for g in ([e for s, e in data if s == k] for k in range(30)))
    df = spark.createDataFrame(data, "sentence_id int, canonical_id int")
    got = [rows(cooccur.edges(cooccur.pairs(cooccur.presence(df.repartition(n))))) for n in (1, 5)]
    assert got[0] == got[1] and sum(w for *_, w in got[0]) == want


def test_interval_join_includes_both_ends(spark):
    points = spark.createDataFrame([(i,) for i in (0, 1, 5, 6, 10, 269, 270, 271)], "x int")
    intervals = spark.createDataFrame([("a", 1, 5), ("b", 5, 10), ("c", 271, 900), ("d", 9, 2), ("e", None, 4)], "s string, lo int, hi int")
    for partitions in (1, 7):
        assert rows(spans.interval_join(points.repartition(partitions), intervals, "x", "lo", "hi"), "s", "x") == [("a", 1), ("a", 5), ("b", 5), ("b", 6), ("b", 10), ("c", 271)]


def test_sections(spark):
    own = spark.createDataFrame([("d", "one", 1, 10, 1, 5), ("d", "two", None, None, 4, 9)], "division string, section string, tok_lo int, tok_hi int, sent_lo int, sent_hi int")
    edges = spark.createDataFrame([(1, 2, [4, 9, 11])], "source_id int, target_id int, sentence_ids array<int>")
    assert rows(sections.section_edges(edges, own), "section", "sentence_id") == [("one", 4), ("two", 4), ("two", 9)]
    triples = spark.createDataFrame([("agent", "patient", "x", "y", "go", 10), ("patient", "agent", "x", "y", "go", 3)], "role_left string, role_right string, name_left string, name_right string, lemma string, index int")
    assert rows(sections.section_triples(triples, own), "section", "a", "b", "label") == [("one", "x", "y", "go")]


def test_ranges_from_markers(spark):
    df = spark.createDataFrame([(i, i in (3, 10, 20)) for i in range(1, 31)], "i int, m boolean")
    got = sections.ranges_from_markers(df, F.col("m"), "i", shifts={1: 5}, default_shift=2)
    assert rows(got, "section", "lo", "hi") == [(0, 5, 9), (1, 15, 19), (2, 22, 30)]


def test_flatten_filters_and_names(spark):
    schema = "id int, pos int, g struct<argmax:string>, agent array<struct<w:string,i:bigint>>, patient array<struct<w:string,i:bigint>>, mentions struct<proper:array<struct<n:string,c:bigint>>,common:array<struct<n:string,c:bigint>>>"
    data = [(1, 0, ("he",), [("go", 5), ("run", 6)], [("see", 9)], ([("Ann", 2)], [("girl", 1)])), (2, 1, None, None, None, ([], [])), (3, 2, None, [("sit", 7)], None, ([], [("man", 1)])), (4, 3, None, [("sit", 8)], None, ([], []))]
    flat = events.flatten_characters(spark.createDataFrame(data, schema))
    assert rows(flat, "character_id", "role", "word", "index") == [(1, "agent", "go", 5), (1, "agent", "run", 6), (1, "patient", "see", 9), (3, "agent", "sit", 7), (4, "agent", "sit", 8)]
    named = events.with_names(flat)
    assert {r.character_id for r in named.collect()} == {1, 3}
    allowed = spark.createDataFrame([(3,), (3,)], "character_id int")
    assert events.allow_common(named, allowed).count() == 4 and events.allow_common(named, allowed.limit(0)).count() == 3
    assert rows(events.explode_names(named).where("index = 5"), "name_pos", "name") == [(0, "Ann"), (1, "girl")]
    assert {r.gender for r in events.override(named, "character_id", [3], {"gender": "x"}).where("character_id = 3").collect()} == {"x"}


def test_triples(spark):
    data = [(1, "agent", 5, 0), (2, "patient", 5, 1), (1, "patient", 5, 2), (1, "agent", 5, 3), (3, "agent", 8, 4), (4, "patient", 9, 5)]
    df = spark.createDataFrame(data, "canonical_id int, role string, index int, pos int")
    tokens = spark.createDataFrame([(1, 5, "go", 5, "ROOT"), (1, 6, "not", 5, "neg"), (2, 7, "never", 8, "neg"), (3, 8, "be", 8, "ROOT")], "sentence_id int, token_id int, lemma string, head_id int, dep string")
    got = events.avp_triples(df, tokens)
    assert rows(got, "canonical_id_left", "index", "canonical_id_right", "pos_left", "lemma", "negated") == [(1, 5, 2, 0, "go", True)]
    assert events.avp_triples(df, span=(6, 9)).count() == 0
    # A negation in another sentence doesn't count.
    assert rows(events.negated_verbs(tokens)) == [(5, True)]


def test_combined_sources_prefer_the_first(spark):
    a = spark.createDataFrame([("avp", 1, 5, 2, 0)], "source string, l int, index int, r int, pos int")
    b = spark.createDataFrame([("svo", 1, 5, 2, 0), ("svo", 1, 6, 1, 1), ("svo", 1, 6, 1, 2)], a.schema)
    assert rows(events.combine(a, b, ["l", "index", "r"], ["pos"])) == [("avp", 1, 5, 2, 0), ("svo", 1, 6, 1, 1)]
    assert events.align(a, list("vwxyz")).columns == list("vwxyz")
    assert events.layout(a, ["r", "none"]).columns == ["r", "none"]


NAMES = [
    (8, "Ann Rogers", "Ann", None, "Rogers", "f", "Annie; The Cook", "cook"),
    (9, "Tom Rogers", "Tom", None, "Rogers", "m", None, "butler"),
    (10, "Philip James Lamb", "Philip", "James", "Lamb", "m", None, None),
]


@pytest.fixture()
def names(spark):
    df = spark.createDataFrame(NAMES, "id int, fullname string, firstname string, middlename string, surname string, gender string, aka string, profession string")
    return df.withColumn("row", F.col("id"))


def test_variants(names):
    got = {(r.variant, r.id) for r in resolve.name_variants(names).collect()}
    assert {("rogers", 8), ("rogers", 9), ("annie", 8), ("cook", 8), ("mr rogers", 9), ("mrs rogers", 8), ("miss ann rogers", 8), ("philip james", 10), ("philip lamb", 10), ("james", 10), ("mister tom rogers", 9)} <= got
    assert ("", 8) not in got and ("mr rogers", 8) not in got


def plain_match(name, gender, variants, threshold=60.0):
    """The rules, one query at a time: variants are (variant, id, gender)."""
    if gender not in ("m", "f"):
        return None, 0.0
    texts = sorted({v for v, *_ in variants}, key=lambda v: (min(i for w, i, _ in variants if w == v), v))
    scored = sorted(((-likeness.ratio(" ".join(sorted(name.split())), " ".join(sorted(v.split()))), k, v) for k, v in enumerate(texts)))[:10]
    for s, _, v in scored:
        if -s < threshold:
            break
        for i, g in sorted((i, g) for w, i, g in variants if w == v):
            if g == gender or -s * 0.8 >= threshold:
                return i, -s
    return None, 0.0


@pytest.mark.parametrize("block", [3, 50_000])
def test_match_names_follows_the_rules(spark, names, block, monkeypatch):
    monkeypatch.setattr(resolve.top_matches, "__defaults__", (10, 60.0, block))
    variants = [(r.variant, r.id, r.gender) for r in resolve.name_variants(names).collect()]
    asked = ["Rogers", "the cook", "Mr. Rogers", "Tom Rogers", "Rogers Tom", "Philip Lam", "Jams Lamb", "nobody", "", "x", "Butlr", "Mrs Ann Rogers", "fellow Lamb", "poor old James"]
    data = [(n, g, k) for k, (n, g) in enumerate(itertools.product(asked, "mfu"))]
    got = resolve.match_names(spark.createDataFrame(data, "name string, gender string, character_id int"), names, ["mr", "mrs"], ["fellow", "poor", "old"]).collect()
    assert len(got) == len(data)
    known = {t for v, *_ in variants for t in v.split()}
    for r in got:
        clean = r.name.lower().replace(".", "").removeprefix("the ")
        query = " ".join(t for t in clean.split() if t in known or t in ("mr", "mrs") or (t not in ("fellow", "poor", "old") and len(t) > 2))
        tries = [(query, 1.0)] + [(t, 0.9) for t in query.split() if t in known and len(t) > 2]
        want = next(((i, s * f) for q, f in tries if q for i, s in [plain_match(q, r.gender, variants)] if i is not None), (None, 0.0))
        assert (r.matched_id, pytest.approx(r.match_score)) == want
    by = {(r.name, r.gender): r for r in got}
    assert by["Rogers", "m"].matched_id == 8 and by["Rogers", "m"].corrected_gender == "f" and by["Rogers", "u"].matched_id is None


def test_other_gender_needs_three_quarters(spark):
    variants = spark.createDataFrame([("v", 1, 0, "f", "V"), ("w", 2, 1, "f", "W")], "variant string, id int, id_order int, gender string, fullname string")
    candidates = spark.createDataFrame([("a", "v", 75.0, 1), ("b", "v", 74.0, 1)], "query string, variant string, score double, place int")
    asked = spark.createDataFrame([(q, g) for q in "ab" for g in "mfu"], "query string, gender string")
    got = rows(resolve.gate(candidates, asked, variants), "query", "gender", "corrected_gender")
    assert got == sorted([("a", "f", None), ("a", "m", "f"), ("b", "f", None)], key=lambda r: (r[0], r[1]))


def test_canonical_ids_and_merge(spark):
    data = [(5, "Ann", 8, 100.0, "Ann", "agent", "go", 3, "f", 0), (2, "Annie", 8, 80.0, "Ann", "agent", "go", 3, "m", 1), (7, "Ann", None, 0.0, "Ann", "agent", "sit", 4, "u", 2), (9, "Zed", None, 0.0, "Zed", "agent", "sit", 4, "u", 3)]
    df = resolve.canonical_ids(spark.createDataFrame(data, "character_id int, name string, matched_id int, match_score double, matched_fullname string, role string, word string, index int, gender string, pos int"))
    assert {(r.character_id, r.canonical_id) for r in df.collect()} == {(5, 2), (2, 2), (7, 2), (9, 9)}
    assert rows(resolve.canonical_summary(df)) == [(2, "Ann", [2, 5, 7], 60.0), (9, "Zed", [9], 0.0)]
    assert rows(resolve.variants_seen(df)) == [(2, ["Ann", "Annie"]), (9, ["Zed"])]
    assert rows(resolve.merge(df), "canonical_id", "word", "gender", "name_variants") == [(2, "go", "f", ["Ann", "Annie"]), (2, "sit", "u", ["Ann", "Annie"])]


def test_lookups(spark):
    summary = spark.createDataFrame([(2, "Ann", [2, 5], 60.0), (9, "Zed", [9], 0.0), (11, "Bob", [5, 6], 70.0)], "canonical_id int, fullname string, original_ids array<int>, avg_score double")
    lookup = spans.coref_to_canonical(summary)
    assert rows(lookup) == [(2, 2, "Ann"), (5, 11, "Bob"), (6, 11, "Bob")]
    triples = spark.createDataFrame([(0, [3, 4, 5]), (1, [])], "k int, ids array<int>")
    token_map = spark.createDataFrame([(3, 9), (4, 6), (5, 9)], "token_id int, coref int")
    corefs = spans.ids_to_corefs(triples, token_map, "ids", "k")
    assert rows(corefs) == [(0, [9, 6]), (1, [])]
    assert rows(spans.first_canonical(corefs, lookup, "corefs", "k")) == [(0, 11, "Bob")]
    mentions = spark.createDataFrame([(6, 1, 4)], "coref int, start_token int, end_token int")
    assert rows(spans.mentions_in_sentences(mentions, spark.createDataFrame([(1, 1), (2, 4)], "sentence_id int, token_id int"))) == [(6, 1)]
    heads = spark.createDataFrame([(1, 10, 11), (1, 11, 11), (1, 12, 99)], "sentence_id int, token_id int, head_id int")
    assert rows(spans.heads_in_sentence(heads), "token_id", "head_place") == [(10, 1), (11, 1)]


def sentence(spark, words):
    return spark.createDataFrame([(1, 100 + i, w, w.lower(), p, p, d, 100 + h) for i, (w, p, d, h) in enumerate(words)], "sentence_id int, token_id int, word string, lemma string, pos string, tag string, dep string, head_id int")


def test_svo_patterns(spark):
    tokens = sentence(spark, [("Ann", "PROPN", "compound", 1), ("Lee", "PROPN", "nsubj", 4), ("did", "AUX", "aux", 4), ("not", "PART", "neg", 4), ("see", "VERB", "ROOT", 4), ("Tom", "PROPN", "dobj", 4), ("and", "CCONJ", "cc", 5), ("Kim", "PROPN", "conj", 5), ("but", "CCONJ", "cc", 4), ("heard", "VERB", "conj", 4), ("Bob", "PROPN", "dobj", 9)])
    got = rows(deps.svo_triples(tokens), "subject_text", "verb_text", "object_text", "negated")
    assert got == [("Ann Lee", "heard", "Bob", False), ("Ann Lee", "see", "Kim", True), ("Ann Lee", "see", "Tom", True)]
    clause = sentence(spark, [("He", "PRON", "nsubj", 1), ("wants", "VERB", "ROOT", 1), ("to", "PART", "aux", 3), ("keep", "VERB", "xcomp", 1), ("calm", "ADJ", "acomp", 3)])
    assert rows(deps.svo_triples(clause), "subject_text", "verb_text", "object_text", "object_pos") == [("He", "wants", "to keep calm", "VERB")]
    passive = sentence(spark, [("Tom", "PROPN", "nsubjpass", 2), ("was", "AUX", "auxpass", 2), ("seen", "VERB", "ROOT", 2), ("by", "ADP", "agent", 2), ("Ann", "PROPN", "pobj", 3)])
    assert rows(deps.svo_triples(passive), "subject_text", "verb_text", "object_text") == [("Tom", "seen", "Ann")]


def test_chunks_are_products_of_runs(spark):
    df = spark.createDataFrame([("a b c", [1, 2, 9], "x y", [4, 6], "v")], "subject_text string, subject_ids array<int>, object_text string, object_ids array<int>, verb_text string")
    got = rows(deps.chunked(df), "subject_text", "subject_ids", "object_text", "object_ids")
    assert got == [("a b", [1, 2], "x", [4]), ("a b", [1, 2], "y", [6]), ("c", [9], "x", [4]), ("c", [9], "y", [6])]


def graph_of(spark, pairs, section="s"):
    return spark.createDataFrame([(section, a, b) for a, b in pairs], "section string, a string, b string")


def test_closeness_of_two_components(spark):
    e = graph_of(spark, [("a", "b"), ("b", "c"), ("d", "e"), ("a", "b")])
    want = {"a": 2 / 3 * 2 / 4, "b": 2 / 2 * 2 / 4, "c": 2 / 3 * 2 / 4, "d": 1 / 4, "e": 1 / 4}
    got = {r.node: r.value for r in graph.measure(graph.simple(e, ["section"]), "closeness", ["section"]).collect()}
    assert got == pytest.approx(want)
    assert {r.node: r.closeness for r in graph.closeness_at_scale(e, ["section"]).collect()} == pytest.approx(want)
    assert {r.node: r.value for r in graph.evolution(e, ["section"], spark.createDataFrame([("s", "b"), ("s", "z")], "section string, node string")).collect()} == pytest.approx({"b": 2 / 1.5 * 2 / 4, "z": 0.0})


def test_measures_of_known_graphs():
    star = np.zeros((5, 5))
    star[0, 1:] = star[1:, 0] = 1
    assert graph.betweenness(star).tolist() == [1, 0, 0, 0, 0]
    assert graph.closeness(star) == pytest.approx([1, 4 / 7, 4 / 7, 4 / 7, 4 / 7])
    x, settled = graph.eigenvector(star)
    assert settled and x == pytest.approx([0.5**0.5] + [8**-0.5] * 4, abs=1e-6)
    x, settled = graph.katz(star)
    want = np.linalg.solve(np.eye(5) - 0.1 * star.T, np.ones(5))
    assert settled and x == pytest.approx(want / np.linalg.norm(want))
    assert not graph.katz(np.ones((20, 20)))[1]
    path = np.zeros((3, 3))
    path[0, 1] = path[1, 2] = 1
    assert graph.betweenness(path, directed=True).tolist() == [0, 0.5, 0] and graph.closeness(path) == pytest.approx([0, 0.5, 2 / 3])
    for f in (graph.closeness, graph.betweenness):
        assert f(np.zeros((1, 1))).tolist() == [0] and f(np.zeros((0, 0))).tolist() == []


def test_subgraph_degrees_and_contraction(spark):
    e = graph_of(spark, [("a", "b"), ("a", "b"), ("c", "x"), ("a", "c")])
    main = spark.createDataFrame([("a",), ("b",), ("c",), ("q",)], "node string")
    nodes, inside = graph.induced(e, main, ["section"])
    assert {r.node for r in nodes.collect()} == {"a", "b", "c"} and inside.count() == 3
    assert {r.node: r.centrality for r in graph.degree_centrality(inside, ["section"], nodes).collect()} == {"a": 1.5, "b": 1.0, "c": 0.5}
    assert rows(graph.weighted(e, ["section"]), "a", "b", "weight", "distance") == [("a", "b", 2, 0.5), ("a", "c", 1, 1.0), ("c", "x", 1, 1.0)]
    merged = graph.contract(e.withColumn("into", F.lit("a")), "b", "into")
    assert rows(merged, "a", "b") == [("a", "c"), ("c", "x")]
    own = spark.createDataFrame([("a",), ("b",), ("absent",)], "candidate string")
    got = {r.candidate: r.possible for r in graph.hypotheses(e, ["section"], "b", own).collect()}
    assert set(got) == {"a", "b"} and got["b"] is False
    assert rows(graph.summary(e, ["section"])) == [("s", 4, 4, 3, 2)]


def test_sentiment_of_edges(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("a", "c", 1)], "a string, b string, sentence_id int")
    scores = spark.createDataFrame([(1, 0.5), (2, -0.1)], "sentence_id int, compound double")
    pair = {(r.a, r.b): (r.total, r["mean"]) for r in graph.pair_sentiment(e, scores).collect()}
    assert pair["a", "b"] == pytest.approx((0.4, 0.2)) and pair["a", "c"] == pytest.approx((0.5, 0.5))
    with_scores = e.join(scores, "sentence_id").withColumnRenamed("compound", "sentiment")
    grid = spark.createDataFrame([("a",), ("z",)], "node string")
    assert {r.node: r["mean"] for r in graph.incident_sentiment(with_scores, grid=grid).collect()} == pytest.approx({"a": 0.3, "z": 0.0})


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", None)], "k string, v int")
    assert [tuple(r) for r in reports.value_counts(df, "k").collect()] == [("a", 2), ("b", 1)]
    (r,) = reports.statistics(df, {"one": F.col("v") == 1}).collect()
    assert (r.n, r.one, r.one_share) == (3, 1, pytest.approx(1 / 3))
    assert reports.distinct_over(df.select("k", F.col("k").alias("j")), ["k", "j"]).first().n == 2
