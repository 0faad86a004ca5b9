"""A component of over 2^17 nodes is walked in tasks: it used to go by joins, with a row for each node and word of sources."""

import numpy as np

from loomgraph.operators import graph


def test_a_large_component_is_walked_in_tasks(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("by joins")

    monkeypatch.setattr(graph, "_reach_by_joins", refuse)
    n = (1 << 17) + 9
    edges = spark.range(n).selectExpr("concat('c', id) as a", "'hub' as b")
    got = {(r.node == "hub", round(r.closeness, 9)) for r in graph.closeness_at_scale(edges).collect()}
    assert got == {(True, 1.0), (False, round(n / (2 * n - 1), 9))}


def test_sides_of_a_graph():
    a, b = np.array([0, 1, 2, 0]), np.array([3, 3, 4, 4])
    lists = graph._lists(5, np.r_[a, b], np.r_[b, a])
    assert graph._sides(5, *lists).tolist() == [0, 0, 0, 1, 1]
    a, b = np.array([0, 1, 2]), np.array([1, 2, 0])
    assert graph._sides(3, *graph._lists(3, np.r_[a, b], np.r_[b, a])) is None
