"""Benchmark passages without an item id."""

from loomgraph.llm import decontam


def test_passages_without_an_id(spark):
    one, two = "some words that stand here for a while", "quite another passage about seven brown foxes"
    docs = spark.createDataFrame([(1, "x " + one), (2, "y " + two), (3, one + " and " + two), (4, "none of them")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, one), (None, one), (None, two)], "item_id long, text string")
    for group in (10**6, 40):
        assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench, group_chars=group).collect()} == {(1, 5), (2, None), (3, 5), (3, None)}
        assert [r.doc_id for r in decontam.remove(docs, bench, group_chars=group).collect()] == [4]
    rows = {r.doc_id: (r.n_items, r.item_ids, r.contaminated) for r in decontam.summary(docs, bench).collect()}
    assert rows == {1: (1, "5", True), 2: (1, "null", True), 3: (2, "5,null", True), 4: (0, "", False)}
