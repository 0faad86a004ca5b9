"""Forms that run as joins give what forms in one task give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph


def edges_of(spark, seed, keys=("x", "y")):
    rng = random.Random(seed)
    rows = []
    for k, key in enumerate(keys):
        n = 14 + 6 * k
        rows += [(key, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice([0.5, 1.0, 1.5, 2.0, 0.25])) for _ in range(20 + 8 * k)]
        rows += [(key, "n1", "n2", 0.5), (key, "n1", "n2", 2.0), (key, "far1", "far2", 1.0), (key, "n3", "n3", 1.0)]
    return spark.createDataFrame(rows, "k string, a string, b string, w double")


@pytest.mark.parametrize("name, weight, directed", [("closeness", "w", True), ("betweenness", None, False)])
def test_joins_equal_tasks(spark, name, weight, directed):
    edges = edges_of(spark, 3)
    extra = spark.createDataFrame([("x", "alone"), ("z", "only")], "k string, node string")
    key = lambda rows: {(r.k, r.node): (r.value, r.converged) for r in rows}
    one = key(graph.measure(edges, name, ["k"], extra, weight, directed).collect())
    other = key(graph.measure(edges, name, ["k"], extra, weight, directed, small=17).collect())  # one graph by joins
    assert set(one) == set(other) and ("x", "alone") in one and ("z", "only") in one
    assert all(other[k] == (pytest.approx(v, rel=1e-6, abs=1e-8), settled) for k, (v, settled) in one.items())


@pytest.mark.parametrize("name, weight, directed", [("closeness", None, True), ("closeness", None, False), ("closeness", "w", False), ("betweenness", None, True), ("betweenness", None, False)])
def test_batches_of_sources_equal_all_at_once(spark, name, weight, directed):
    edges = edges_of(spark, 8)
    links, every = graph._lengths(edges, ["k"], weight, directed, name == "closeness"), graph.nodes_of(edges, ["k"])
    key = lambda rows: {(r.k, r.node): r.value for r in rows}
    want = key(graph.measure(edges, name, ["k"], None, weight, directed).collect())
    assert len(graph._batches(every, ["k"], 200, 64 if weight is None and name == "closeness" else 1)) > 1 or name == "closeness"
    for rows in (20, 10**9):
        got = key(graph.BY_JOINS[name](links, every, ["k"], directed=directed, rows=rows).collect())
        assert got == {k: pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in want.items()}


@pytest.mark.parametrize("n, share, directed", [(60, 0.05, False), (60, 0.6, True), (300, 0.02, False), (40, 1.0, False)])
def test_paths_by_matrix_products_are_those_along_edges(n, share, directed):
    rng = np.random.default_rng(n)
    adjacency = (rng.random((n, n)) < share).astype(float)
    np.fill_diagonal(adjacency, 0)
    adjacency = adjacency if directed else np.maximum(adjacency, adjacency.T)
    want = np.zeros(n)
    graph._through_edges(adjacency, want)
    got = sum(graph._through_levels(adjacency, np.arange(s, min(n, s + 25))) for s in range(0, n, 25))
    assert np.allclose(got, want)


@pytest.mark.parametrize("name", ["eigenvector", "katz"])
def test_rounds_by_joins_equal_those_in_a_task(spark, name):
    edges = edges_of(spark, 5, ("x",)).select("a", "b", "w")
    links = graph._lengths(edges, [], "w", True, False)
    names = sorted({x for r in edges.collect() for x in (r.a, r.b)})
    adjacency = np.zeros((len(names), len(names)))
    for r in links.collect():
        adjacency[names.index(r.a), names.index(r.b)] = r.w
    for rounds, tolerance in ((3, 1e-12), (6, 0.02)):
        values, settled = graph.MEASURES[name](adjacency, rounds=rounds, tolerance=tolerance)
        got = {r.node: r for r in graph.BY_JOINS[name](links, graph.nodes_of(edges), [], rounds=rounds, tolerance=tolerance).collect()}
        assert sorted(got) == names and {r.converged for r in got.values()} == {settled}
        assert np.allclose([got[n].value for n in names], values, equal_nan=True)


def test_hypotheses_equal_those_of_merged_graphs(spark):
    rng = random.Random(11)
    rows = [(k, f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for k in "xyz" for _ in range(13)] + [("w", "n1", "n2"), ("v", "n1", "n2"), ("v", "n3", "n4"), ("v", "n1", "n5")]
    edges = spark.createDataFrame(rows, "k string, a string, b string").where("a <> b")
    asked = spark.createDataFrame([(f"n{i}",) for i in range(13)], "candidate string")
    key = lambda df: {(r.k, r.candidate): (r["rank"], pytest.approx(r.value, abs=1e-9), r.possible) for r in df.collect()}
    want = {}
    for k in "vwxyz":
        own = edges.where(F.col("k") == k)
        for c in sorted({x for _, *e in own.collect() for x in e}):
            merged = graph.contract(own.withColumn("into", F.lit(c)), "n1", "into")
            values = {r.node: r.value for r in graph.measure(graph.simple(merged, ["k"]), "closeness", ["k"]).collect()} if k in "vwx" else {}
            if c in values:
                place = sorted(values, key=lambda n: (-round(values[n], 12), n)).index(c) + 1
                want[k, c] = (place, values[c], place == 1)
    got = graph.hypotheses(edges, ["k"], "n1", asked)
    have = {(r.k, r.candidate): (r["rank"], r.value, r.possible) for r in got.collect()}
    assert {k: (r, pytest.approx(v, abs=1e-9), p) for k, (r, v, p) in want.items()} == {k: v for k, v in have.items() if k[0] in "vwx"}
    assert len(want) > 15 and ("y", "n1") in have


def test_graphs_without_keys_scale(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", -4.0)], "a string, b string, v double")
    assert sorted(r.scaled for r in graph.display_scale(edges, "v").collect()) == [-1.0, 0.5]
