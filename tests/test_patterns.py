"""Patterns of relations on made-up sentences."""

import pytest

from loomgraph.operators import deps

#: word, part, relation, head (a place in the sentence)
PURPOSE = [("He", "PRON", "nsubj", 1), ("tried", "VERB", "ROOT", 1), ("to", "PART", "aux", 3), ("keep", "VERB", "xcomp", 1), ("his", "PRON", "poss", 5), ("mind", "NOUN", "dobj", 3), ("on", "ADP", "prep", 3), ("the", "DET", "det", 8), ("job", "NOUN", "pobj", 6)]
MODIFIED = [("Men", "NOUN", "nsubj", 4), ("who", "PRON", "x", 2), ("dig", "VERB", "relcl", 0), ("wells", "NOUN", "dobj", 2), ("gave", "VERB", "ROOT", 4), ("us", "PRON", "dative", 4), ("water", "NOUN", "dobj", 4), ("and", "CCONJ", "cc", 4), ("left", "VERB", "conj", 4), ("for", "ADP", "prep", 8), ("town", "NOUN", "pobj", 9)]
CLAUSAL = [("That", "SCONJ", "mark", 2), ("it", "PRON", "nsubj", 2), ("rained", "VERB", "csubj", 3), ("pleased", "VERB", "ROOT", 3), ("farmers", "NOUN", "dobj", 3)]


def triples(spark, *sentences, patterns=deps.PATTERNS):
    rows = [(s, 100 * s + i, w, w.lower(), pos, pos, dep, 100 * s + head) for s, tokens in enumerate(sentences) for i, (w, pos, dep, head) in enumerate(tokens)]
    tokens = spark.createDataFrame(rows, "sentence_id int, token_id int, word string, lemma string, pos string, tag string, dep string, head_id int")
    return {(r.subject_text, r.verb_text, r.object_text) for r in deps.svo_triples(tokens, patterns).collect()}


def test_own_patterns(spark):
    assert triples(spark, PURPOSE, MODIFIED, CLAUSAL) == {("He", "tried", "to keep his mind on the job"), ("Men", "gave", "water"), ("That it rained", "pleased", "farmers")}


def test_more_patterns(spark):
    more = (*deps.PATTERNS, deps.MODIFIED, deps.RECIPIENT, deps.PREPOSITIONAL)
    assert triples(spark, MODIFIED, patterns=more) == {("Men", "dig", "wells"), ("Men", "gave", "water"), ("Men", "gave", "us"), ("Men", "left", "town")}


def test_paths_and_sides_that_nothing_reaches(spark):
    assert triples(spark, PURPOSE, patterns=(deps.PATTERNS[0],)) == triples(spark, PURPOSE, patterns=(deps.PATTERNS[2],)) == set()
    with pytest.raises(ValueError):
        triples(spark, PURPOSE, patterns=(deps.Pattern("subject", (("aside", ("nsubj",)),)),))
