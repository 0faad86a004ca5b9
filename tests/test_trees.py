"""Subtrees as ranges of numbers, whatever the depth."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import trees


def below(ids, heads, linked, root):
    found, queue = {root}, [root]
    while queue:
        at = queue.pop()
        for t, h, on in zip(ids, heads, linked):
            if on and h == at and t != h and t not in found:
                found.add(t)
                queue.append(t)
    return found


def test_numbers_of_random_trees():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(0, 12)
        ids = sorted(rng.sample(range(50), n))
        heads = [rng.choice([*ids[: k + 1], 99]) for k in range(n)]  # heads come first, are the token itself, or are elsewhere
        linked = [rng.random() < 0.8 for _ in ids]
        top, pre, last = trees.walked(ids, heads, linked)
        assert sorted(pre) == list(range(n))
        for k, t in enumerate(ids):
            assert {ids[i] for i in range(n) if top[i] == top[k] and pre[k] <= pre[i] <= last[k]} == below(ids, heads, linked, t)


def test_circles_and_deep_chains():
    top, pre, last = trees.walked([1, 2, 3], [2, 1, 1], [True] * 3)
    assert set(top) == {1} and sorted(pre) == [0, 1, 2] and last[0] == 2
    n = 50_000
    top, pre, last = trees.walked(list(range(n)), [max(0, k - 1) for k in range(n)], [True] * n)
    assert pre == list(range(n)) and set(last) == {n - 1} and set(top) == {0}


def test_closures_over_batches(spark):
    rows = [(s, 100 * s + k, 100 * s + max(0, k - 1), "compound" if k % 3 else "x") for s in range(60) for k in range(40)]
    tokens = spark.createDataFrame(rows, "sentence_id int, token_id int, head_id int, dep string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    numbered = trees.forests(tokens, all=F.lit(True), compound=F.col("dep") == "compound")
    got = sorted(map(tuple, trees.under(numbered, tokens.where("token_id % 100 in (0, 37)"), "compound").collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((100 * s + r, 100 * s + k) for s in range(60) for r, ks in ((0, (0, 1, 2)), (37, (37, 38))) for k in ks)
    assert trees.under(numbered, tokens.where("token_id = 0"), "all").count() == 40
