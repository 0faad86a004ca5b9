"""Closeness follows components: sources share a task or a word with those that they can reach, not with others."""

import random

import numpy as np
import pytest

from loomgraph.operators import graph


def some_edges(spark, seed):
    rng = random.Random(seed)
    rows = [(k, f"{c}{rng.randrange(n)}", f"{c}{rng.randrange(n)}") for k in "xy" for c, n in (("p", 7), ("r", 40)) for _ in range(2 * n)]
    rows += [("x", f"way{i}", f"way{i + 1}") for i in range(4)] + [("y", "hub", f"leaf{i}") for i in range(200)] + [("z", "alone", "alone")]
    return spark.createDataFrame(rows, "k string, a string, b string")


@pytest.mark.parametrize("directed", [False, True])
def test_tasks_equal_joins_and_whole_graphs(spark, directed, monkeypatch):
    edges = some_edges(spark, 4)
    key = lambda rows: {(r.k, r.node): r.value for r in rows}
    want = key(graph.measure(edges, "closeness", ["k"], directed=directed).collect())
    links, every = graph._lengths(edges, ["k"], None, directed, True), graph.nodes_of(edges, ["k"])
    monkeypatch.setattr(graph, "TASK_CELLS", 150)  # several slices
    for nodes, most in ((1 << 17, 1 << 22), (30, 50)):
        got = key(graph.closeness_by_joins(links, every, ["k"], directed, nodes=nodes, most=most).collect())
        assert got == {k: pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in want.items()}


def test_components(spark):
    edges = some_edges(spark, 6).where("k = 'x'").selectExpr("xxhash64(a) as a", "xxhash64(b) as b")
    own = {}

    def top(v):
        while own.setdefault(v, v) != v:
            v = own[v]
        return v

    for r in edges.where("a <> b").collect():
        x, y = top(r.a), top(r.b)
        own[max(x, y)] = min(x, y)
    assert {r.id: r.component for r in graph.components(edges).collect()} == {v: top(v) for v in own}


def test_copies_of_a_graph_cost_as_many_rows_each(spark, monkeypatch):
    """Words of 64 sources used to mix components, so that rows grew with the square of the copies."""
    asked = []
    monkeypatch.setattr(graph, "_reach_in_tasks", lambda inside, size, directed, f=graph._reach_in_tasks: (asked.append(inside.count()), f(inside, size, directed))[1])
    edges = spark.range(40 * 30).selectExpr("concat(id div 40, 'a', id % 8) as a", "concat(id div 40, 'b', id % 5) as b")
    values = graph.closeness_at_scale(edges).collect()
    assert asked == [40 * 30] and len(values) == 13 * 30 and len({round(r.closeness, 9) for r in values}) == 2


@pytest.mark.parametrize("block", [1, 7, 1 << 21])
def test_walk(block):
    rng = np.random.default_rng(block)
    n = 170
    a, b = rng.integers(0, n, 400), rng.integers(0, n, 400)
    d = np.full((n, n), np.inf)
    d[a, b] = 1
    d = graph.shortest(d)
    sources = np.arange(20, 150)
    met = np.isfinite(d[sources]) & (d[sources] > 0)
    reached, hops = graph.walk(n, a, b, sources, block)
    assert (reached == met.sum(axis=0)).all() and (hops == np.where(met, d[sources], 0).sum(axis=0)).all()
