"""From annotated tables to triples and networks, on a made-up page of text."""

import pytest
from pyspark.sql import functions as F

from loomgraph.plans.pipeline import Settings, analyse, extract

# sentence, token, word, part, relation, head
TOKENS = [
    (1, 1, "Mary", "PROPN", "compound", 2), (1, 2, "Stone", "PROPN", "nsubj", 4), (1, 3, "never", "ADV", "neg", 4), (1, 4, "saw", "VERB", "ROOT", 4), (1, 5, "Peter", "PROPN", "dobj", 4),
    (2, 6, "Peter", "PROPN", "nsubj", 7), (2, 7, "heard", "VERB", "ROOT", 7), (2, 8, "Mary", "PROPN", "dobj", 7), (2, 9, "and", "CCONJ", "cc", 8), (2, 10, "Paul", "PROPN", "conj", 8),
    (3, 11, "Paul", "PROPN", "nsubj", 12), (3, 12, "slept", "VERB", "ROOT", 12),
]
ENTITIES = [(70, 1, 2, 0), (71, 5, 5, 1), (71, 6, 6, 2), (70, 8, 8, 3), (72, 10, 10, 4), (72, 11, 11, 5)]
NAMES = [(1, "Mary Stone", "Mary", None, "Stone", "f", None, None), (2, "Peter Hill", "Peter", None, "Hill", "m", "Pete", None), (3, "Paul Wood", "Paul", None, "Wood", "m", None, "baker")]
CHARACTERS = [
    (70, "she/her", [("saw", 4)], [("heard", 7)], ["Mary", "Mary Stone"], []),
    (71, "he/him/his", [("heard", 7)], [("saw", 4)], ["Peter"], []),
    (72, "he/him/his", [("slept", 12)], [("heard", 7)], [], ["the baker"]),
    (73, "he/him/his", [("slept", 12)], [], [], ["a stranger"]),
]


@pytest.fixture()
def found(spark):
    tokens = spark.createDataFrame([(s, i, w, w.lower(), p, p, d, h) for s, i, w, p, d, h in TOKENS], "sentence_id int, token_id int, word string, lemma string, pos string, tag string, dep string, head_id int")
    entities = spark.createDataFrame(ENTITIES, "coref int, start_token int, end_token int, pos int")
    names = spark.createDataFrame(NAMES, "id int, fullname string, firstname string, middlename string, surname string, gender string, aka string, profession string").withColumn("row", F.col("id"))
    schema = "id bigint, pos int, g struct<argmax:string>, agent array<struct<w:string,i:bigint>>, patient array<struct<w:string,i:bigint>>, mentions struct<proper:array<struct<n:string,c:bigint>>,common:array<struct<n:string,c:bigint>>>"
    characters = spark.createDataFrame([(i, k, (g,), a, p, ([(n, 1) for n in proper], [(n, 1) for n in common])) for k, (i, g, a, p, proper, common) in enumerate(CHARACTERS)], schema)
    return extract(characters, tokens, entities, names, Settings(stop_words=["the", "a"], common_ids=[72]))


def test_extract(found):
    assert {(r.canonical_id, r.fullname, r.avg_score) for r in found["summary"].collect()} == {(70, "Mary Stone", 100.0), (71, "Peter Hill", 100.0), (72, "Paul Wood", 100.0)}
    avp = {(r.canonical_id_left, r.lemma, r.canonical_id_right, r.negated) for r in found["avp"].collect()}
    assert avp == {(70, "saw", 71, True), (71, "heard", 70, False), (71, "heard", 72, False)}
    svo = {(r.name_left, r.word, r.name_right, r.gender_left, r.negated) for r in found["svo"].collect()}
    assert svo == {("Mary Stone", "saw", "Peter Hill", "f", True), ("Peter Hill", "heard", "Mary Stone", "m", False), ("Peter Hill", "heard", "Paul Wood", "m", False)}
    combined = found["combined"].collect()
    assert len(combined) == 3 and {r.source for r in combined} == {"avp"} and {r.role_left for r in combined} == {"agent"}
    edges = {(r.source_name, r.target_name, r.weight, tuple(r.sentence_ids)) for r in found["edges"].collect()}
    assert edges == {("Mary Stone", "Peter Hill", 2, (1, 2)), ("Mary Stone", "Paul Wood", 1, (2,)), ("Peter Hill", "Paul Wood", 1, (2,))}
    assert {(r.fullname, r["count"]) for r in found["occurrences"].collect()} == {("Mary Stone", 2), ("Peter Hill", 2), ("Paul Wood", 2)}


def test_analyse_main_characters(spark):
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "a", "b"), ("s", "b", "c"), ("s", "c", "x")], "section string, a string, b string")
    main = spark.createDataFrame([("a",), ("b",), ("c",), ("gone",)], "node string")
    got = {(r.measure, r.node): r.value for r in analyse(edges, ["section"], main).collect()}
    assert len(got) == 15 and got["betweenness", "b"] == 1.0 and got["degree", "b"] == 1.5 and got["closeness", "a"] == pytest.approx(2 / 3)
