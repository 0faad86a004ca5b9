"""Chains of relations and of edges are followed to their ends."""

import pytest

from loomgraph.operators import deps, graph


def tokens_of(spark, rows):
    return spark.createDataFrame([(1, i, w, w.lower(), p, p, d, h) for i, w, p, d, h in rows], "sentence_id int, token_id int, word string, lemma string, pos string, tag string, dep string, head_id int")


def test_long_coordinations(spark):
    names = "Ann Ben Cat Dan Eve Fay Gus".split()
    rows = [(i + 1, n, "PROPN", "nsubj" if not i else "conj", i if i else 20) for i, n in enumerate(names)]
    rows += [(20, "came", "VERB", "ROOT", 20), (21, "saw", "VERB", "conj", 20), (22, "took", "VERB", "conj", 21), (23, "it", "PRON", "dobj", 22)]
    got = {(r.subject_text, r.verb_text, r.object_text) for r in deps.svo_triples(tokens_of(spark, rows)).collect()}
    assert got == {(n, "took", "it") for n in names}


def test_deep_compounds(spark):
    rows = [(i, f"n{i}", "NOUN", "compound", i + 1) for i in range(1, 16)] + [(16, "n16", "NOUN", "dobj", 16)]
    tokens = tokens_of(spark, rows)
    assert deps.compound_closure(tokens, tokens.where("dep = 'dobj'")).count() == 16


def test_distances_do_not_stop_silently(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "a string, b string")
    assert graph.hop_distances(chain).count() == 49 and graph.hop_distances(chain, rounds=6).count() == 49
    with pytest.raises(RuntimeError):
        graph.hop_distances(chain, rounds=5)
