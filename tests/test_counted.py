"""Edges counted by blocks of entities: the same as from pairs, and no row for a pair and sentence."""

import pytest

from loomgraph.operators import cooccur
from loomgraph.streaming import cooccur as stream


@pytest.mark.parametrize("entity, block", [("e", 4096), ("e", 7), ("concat('é', e)", 64)])
def test_as_pairs(spark, entity, block):
    rows = spark.range(3000).selectExpr("id % 700 as s", "pmod(xxhash64(id), 90) as e").selectExpr("case when s % 50 > 0 then s end as s", f"case when e % 30 > 0 then {entity} end as x")
    got = cooccur.counted(rows, "s", "x", block)
    want = cooccur.edges(cooccur.pairs(cooccur.presence(rows, "s", "x"), "s", "x"), "s")
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_empty(spark):
    assert cooccur.counted(spark.createDataFrame([], "s long, x string"), "s", "x").isEmpty()


def test_many_sentences_of_the_same(spark):
    """A thousand windows of 40 users: a few lists of users are shuffled, not 780 pairs for each."""
    rows = spark.range(1000).selectExpr("timestamp_seconds(id * 3600) as ts", "explode(sequence(0L, 39L)) as user_id")
    got = stream.edge_batch(rows, "ts", "user_id", "1 hour")
    assert {tuple(r) for r in got.collect()} == {(a, b, 1000) for a in range(40) for b in range(a + 1, 40)}
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "_all" not in text and "MapInArrow" in text
