"""Lists of entities are written once: they used to be shuffled once for every two blocks that meet."""

from loomgraph.operators import cooccur


def test_blocks_meet_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "AT_ONCE", 8)
    monkeypatch.setattr(cooccur, "CHUNKS", 3)  # chunks of more sentences than are counted at once
    monkeypatch.setattr(cooccur, "SIDES", 2)
    rows = spark.range(2000).selectExpr("id % 90 as s", "pmod(xxhash64(id), 300) as x")
    got = cooccur.counted(rows, "s", "x", 64)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    want = cooccur.edges(cooccur.pairs(cooccur.presence(rows, "s", "x"), "s", "x"), "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
