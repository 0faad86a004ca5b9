"""Graphs as DataFrames of edges (a, b), one row for each parallel edge, keyed by any columns (say division and section).

Degrees, weights and summaries are aggregates. Shortest-path and iterative measures have two forms: small graphs, a whole
one per key, are measured in one task each; larger ones run as rounds of joins that are written to the shared checkpoint
folder (`distances`, `closeness_by_joins`, `betweenness_by_joins`, `eigenvector_by_joins`, `katz_by_joins`). `measure`
takes either form by a graph's number of nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_checkpoint, shuffled
from .ordered import numbered


def nodes_of(edges: DataFrame, keys: list[str] = []) -> DataFrame:
    return edges.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()


def both_ways(edges: DataFrame, keys: list[str] = [], *more: str) -> DataFrame:
    return edges.select(*keys, "a", "b", *more).unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), *more))


def induced(edges: DataFrame, main: DataFrame, keys: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the subgraph on main(node): nodes that the graph has, isolated ones among them."""
    kept = nodes_of(edges, keys).join(main.select("node").distinct(), "node", "left_semi")
    inside = edges.join(main.select(F.col("node").alias("a")).distinct(), "a", "left_semi").join(main.select(F.col("node").alias("b")).distinct(), "b", "left_semi")
    return kept, inside


def simple(edges: DataFrame, keys: list[str] = []) -> DataFrame:
    """Undirected edges once each, a < b, without self-loops."""
    return edges.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def weighted(edges: DataFrame, keys: list[str] = []) -> DataFrame:
    """simple() with weight, the number of parallel edges, and distance, its reciprocal; isolated nodes are lost."""
    ends = edges.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    return ends.groupBy(*keys, "a", "b").agg(F.count("*").alias("weight")).withColumn("distance", 1.0 / F.col("weight"))


def degree_centrality(edges: DataFrame, keys: list[str] = [], nodes: DataFrame | None = None) -> DataFrame:
    """(keys, node, degree, centrality): parallel edges count each, self-loops twice; degree / (N - 1), and 1 if N is 1."""
    every = nodes_of(edges, keys) if nodes is None else nodes
    degree = edges.select(*keys, F.explode(F.array("a", "b")).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("degree"))
    size = every.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = every.join(degree, [*keys, "node"], "left")
    joined = joined.join(size, keys) if keys else joined.crossJoin(size)
    value = F.coalesce("degree", F.lit(0))
    return joined.select(*keys, "node", value.alias("degree"), F.when(F.col("_n") == 1, 1.0).otherwise(value / (F.col("_n") - 1)).alias("centrality"))


def incident_sentiment(edges: DataFrame, keys: list[str] = [], value: str = "sentiment", grid: DataFrame | None = None) -> DataFrame:
    """(keys, node, mean): the mean over incident edges; rows of grid(keys, node) without edges get 0."""
    mean = both_ways(edges, keys, value).groupBy(*keys, F.col("a").alias("node")).agg(F.avg(value).alias("mean"))
    return mean if grid is None else grid.join(mean, [*keys, "node"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))


def pair_sentiment(instances: DataFrame, scores: DataFrame, keys: list[str] = [], on: str = "sentence_id") -> DataFrame:
    """(keys, a, b, total, mean): scores of the pair's sentences; every sentence was scored once."""
    joined = instances.join(scores, on)
    return joined.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("compound").alias("total"), F.avg("compound").alias("mean"))


def contract(edges: DataFrame, gone: str, into: str, keys: list[str] = []) -> DataFrame:
    """Edges with node `gone` merged into the one that column `into` names; self-loops that arise are dropped."""
    merged = edges.withColumns({c: F.when(F.col(c) == gone, F.col(into)).otherwise(F.col(c)) for c in ("a", "b")})
    return merged.where("a <> b")


def summary(edges: DataFrame, keys: list[str] = [], nodes: DataFrame | None = None) -> DataFrame:
    """(keys, n_nodes, n_edges, n_pairs, max_weight)."""
    size = (nodes_of(edges, keys) if nodes is None else nodes).groupBy(*keys).agg(F.count("*").alias("n_nodes"))
    weights = weighted(edges, keys).groupBy(*keys).agg(F.sum("weight").alias("n_edges"), F.count("*").alias("n_pairs"), F.max("weight").alias("max_weight"))
    return size.join(weights, keys, "left") if keys else size.crossJoin(weights)


# Measures of whole graphs in one task. adjacency[i, j] is the distance or weight of the edge from i to j, 0 if none.


def shortest(lengths: np.ndarray) -> np.ndarray:
    """All distances; lengths of absent edges are infinite."""
    d = lengths.copy()
    np.fill_diagonal(d, 0.0)
    for k in range(len(d)):
        np.minimum(d, d[:, k : k + 1] + d[k : k + 1], out=d)
    return d


def closeness(adjacency: np.ndarray) -> np.ndarray:
    """Scaled by the share of nodes that reach it: (r - 1) / sum of distances * (r - 1) / (N - 1), over incoming paths."""
    n = len(adjacency)
    d = shortest(np.where(adjacency > 0, adjacency, np.inf)).T
    reach = np.isfinite(d)
    r, total = reach.sum(axis=1), np.where(reach, d, 0).sum(axis=1)
    return np.where((total > 0) & (n > 1), (r - 1) / np.where(total > 0, total, 1) * (r - 1) / max(n - 1, 1), 0.0)


def betweenness(adjacency: np.ndarray, directed: bool = False) -> np.ndarray:
    """The share of shortest paths (in edges) through each node, over all pairs of others.

    Few paths are followed edge by edge; where nodes times edges are many, paths of a block of sources are counted by
    matrix products, level by level, over the nodes of a level only.
    """
    n = len(adjacency)
    out = np.zeros(n)
    if n < 3:
        return out
    if n * np.count_nonzero(adjacency) <= FEW_STEPS:
        _through_edges(adjacency, out)
    else:
        links = (adjacency > 0).astype(float)
        for start in range(0, n, SOURCES):
            out += _through_levels(links, np.arange(start, min(n, start + SOURCES)))
    return out / ((n - 1) * (n - 2))


def _through_edges(adjacency: np.ndarray, out: np.ndarray) -> None:
    links = [np.flatnonzero(row).tolist() for row in adjacency]
    n = len(links)
    for s in range(n):
        depth, paths, order = [-1] * n, [0.0] * n, [s]
        depth[s], paths[s] = 0, 1.0
        for v in order:
            for w in links[v]:
                if depth[w] < 0:
                    depth[w] = depth[v] + 1
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        through = [0.0] * n
        for v in reversed(order):
            for w in links[v]:
                if depth[w] == depth[v] + 1:
                    through[v] += paths[v] / paths[w] * (1 + through[w])
            if v != s:
                out[v] += through[v]


def _through_levels(links: np.ndarray, sources: np.ndarray) -> np.ndarray:
    rows = np.arange(len(sources))
    depth, paths = np.full((len(sources), len(links)), -1), np.zeros((len(sources), len(links)))
    depth[rows, sources], paths[rows, sources] = 0, 1
    front, level = paths.copy(), 0
    while True:
        own = np.flatnonzero(front.any(axis=0))
        ahead = front[:, own] @ links[own]
        fresh = (ahead > 0) & (depth < 0)
        if not fresh.any():
            break
        level += 1
        depth[fresh], paths[fresh] = level, ahead[fresh]
        front = np.where(fresh, ahead, 0)
    through = np.zeros_like(paths)
    for at in range(level, 0, -1):
        here = depth == at
        own = np.flatnonzero(here.any(axis=0))
        share = np.divide(1 + through[:, own], paths[:, own], out=np.zeros((len(rows), len(own))), where=here[:, own])
        through += np.where(depth == at - 1, share @ links[:, own].T * paths, 0)
    through[rows, sources] = 0
    return through.sum(axis=0)


def eigenvector(adjacency: np.ndarray, rounds: int = 1000, tolerance: float = 1e-12) -> tuple[np.ndarray, bool]:
    """Power iteration, shifted by the identity; (unit vector, whether it settled)."""
    n = len(adjacency)
    x = np.full(n, 1 / np.sqrt(max(n, 1)))
    for _ in range(rounds):
        y = x + adjacency.T @ x
        y /= np.linalg.norm(y) or 1
        if np.abs(y - x).sum() < n * tolerance:
            return y, True
        x = y
    return x, n == 0


def katz(adjacency: np.ndarray, alpha: float = 0.1, beta: float = 1.0, rounds: int = 1000, tolerance: float = 1e-12) -> tuple[np.ndarray, bool]:
    """x = alpha A'x + beta, normalised; (values, whether it settled: it doesn't if alpha is 1 / the largest eigenvalue or more)."""
    n = len(adjacency)
    x = np.zeros(n)
    for _ in range(rounds):
        y = alpha * (adjacency.T @ x) + beta
        if not np.isfinite(y).all():
            break
        if np.abs(y - x).sum() < n * tolerance:
            return y / (np.linalg.norm(y) or 1), True
        x = y
    return np.full(n, np.nan), n == 0


MEASURES: dict[str, Callable[[np.ndarray], object]] = {"closeness": closeness, "betweenness": betweenness, "eigenvector": eigenvector, "katz": katz}


#: Graphs of up to so many nodes are measured in a task each.
SMALL = 2000
#: Nodes times edges of graphs whose paths are followed edge by edge, and sources whose paths are counted together beyond that.
FEW_STEPS, SOURCES = 5_000_000, 256
#: Rows that the state of one batch of sources has at most, for measures by joins.
STATE_ROWS = 50_000_000
#: Components of up to so many nodes and links are walked in tasks, a slice of their sources in each; words of 64 sources that
#: such a task holds for all nodes together; words that a slice has at least, if there are as many, and at most, unless a
#: component has fewer cores' work. Neighbours of a list.
TASK_NODES, TASK_LINKS, TASK_CELLS, TASK_WORDS, MOST_WORDS, LIST = 1 << 20, 1 << 26, 1 << 24, 128, 1024, 1 << 18


def _lengths(edges: DataFrame, keys: list[str], weight: str | None, directed: bool, smallest: bool) -> DataFrame:
    """(keys, a, b, w): every edge once (both ways if undirected) without self-loops; of parallel edges the least length, or
    the greatest weight, counts."""
    rows = edges.select(*keys, F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).where("a <> b")
    rows = rows if directed else both_ways(rows, keys, "w")
    return rows.groupBy(*keys, "a", "b").agg((F.min if smallest else F.max)("w").alias("w")).where("w > 0")


def measure(edges: DataFrame, name: str, keys: list[str], nodes: DataFrame | None = None, weight: str | None = None, directed: bool = False, small: int | None = None) -> DataFrame:
    """(keys, node, value, converged) of every graph: those of up to `small` nodes in a task for each key, larger ones by joins.

    `weight` names the column that holds lengths (closeness) or weights (the others but betweenness, which counts
    edges); without it edges count 1. Of parallel edges the least length, or the greatest weight, counts. `nodes` adds
    isolated nodes; the keys must be given.
    """
    small = SMALL if small is None else small
    links = _lengths(edges, keys, weight, directed, name == "closeness")
    every = edges.select(*keys, F.explode(F.array(F.col("a").cast("string"), F.col("b").cast("string"))).alias("node"))
    every = every if nodes is None else every.unionByName(nodes.select(*keys, F.col("node").cast("string").alias("node")))
    every = every.distinct()
    large = shared_checkpoint(every.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > small).select(*keys))
    if large.isEmpty():
        return _in_tasks(links, every, name, keys)
    by = lambda df, how: df.join(large, keys, how)
    of_large = [shared_checkpoint(by(df, "left_semi")) for df in (links, every)]
    return _in_tasks(by(links, "left_anti"), by(every, "left_anti"), name, keys).unionByName(BY_JOINS[name](*of_large, keys, directed=directed))


def _in_tasks(links: DataFrame, every: DataFrame, name: str, keys: list[str]) -> DataFrame:
    own = MEASURES[name]
    rows = links.unionByName(every.select(*keys, F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("w")))

    def task(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(part["a"]) | set(part["b"]))
        index = {n: i for i, n in enumerate(names)}
        i, j = part["a"].map(index).to_numpy(), part["b"].map(index).to_numpy()
        adjacency = np.zeros((len(names), len(names)))
        adjacency[i, j] = part["w"]
        np.fill_diagonal(adjacency, 0.0)
        got = own(adjacency)
        values, settled = got if isinstance(got, tuple) else (got, True)
        return pd.DataFrame({**{k: [v] * len(names) for k, v in zip(keys, key)}, "node": names, "value": values, "converged": settled})

    kinds = ", ".join(f"`{k}` {dict(links.dtypes)[k]}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(task, f"{kinds}, node string, value double, converged boolean")


def distances(links: DataFrame, every: DataFrame, keys: list[str], sources: DataFrame | None = None) -> DataFrame:
    """(keys, source, node, d): the least length of a path from each of sources(keys, node), or of every node, to node, for
    all pairs that one joins.

    links: (keys, a, b, w). Rounds extend what got shorter in the round before, of all sources at once, until nothing
    does. As many rows as there are pairs of a source and a node.
    """
    step = shared_checkpoint(links.select(*keys, F.col("a").alias("node"), "b", "w"))
    found = shared_checkpoint((every if sources is None else sources).select(*keys, F.col("node").alias("source"), "node", F.lit(0.0).alias("d")))
    fresh = found
    while True:
        tried = fresh.join(step, [*keys, "node"]).groupBy(*keys, "source", F.col("b").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("_d"))
        # Sums of lengths in another order may differ by rounding: such a path is no shorter.
        merged = shared_checkpoint(found.join(tried, [*keys, "source", "node"], "full").withColumn("_new", F.col("_d").isNotNull() & (F.col("d").isNull() | (F.col("_d") < F.col("d") * (1 - 1e-12)))))
        fresh = merged.where("_new").select(*keys, "source", "node", F.col("_d").alias("d"))
        if fresh.isEmpty():
            return found
        found = merged.select(*keys, "source", "node", F.when(F.col("_new"), F.col("_d")).otherwise(F.col("d")).alias("d"))


def _batches(every: DataFrame, keys: list[str], rows: int, per_word: int = 1) -> list[DataFrame]:
    """every(keys, node), each with `word` and `bit`, in batches whose sources times nodes (by `per_word`) are about `rows`.

    `per_word` sources of a partition share a word. Only two numbers are collected.
    """
    numbered = shared_checkpoint(every.select(*keys, "node").withColumn("_id", F.monotonically_increasing_id()))
    # An id is the partition's number and, below it, the row's in the partition.
    numbered = numbered.select(*keys, "node", F.expr(f"_id div {per_word}").alias("word"), (F.col("_id") % per_word).cast("int").alias("bit"))
    pairs = numbered.groupBy(*keys).agg((F.count("*").cast("double") * F.countDistinct("word")).alias("n")).agg(F.sum("n")).first()[0] or 0
    count = max(1, int(-(-pairs // rows)))
    return [numbered] if count == 1 else [numbered.where(F.pmod(F.xxhash64("word"), F.lit(count)) == k) for k in range(count)]


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the numbers that links(a, b) join, whatever their direction: the least number of each component.

    Every number's greater neighbours are linked to the least of its neighbourhood, then its lesser ones, in turn until only
    stars are left; a round takes two shuffles of the links, and rounds grow with the logarithm of the longest paths.
    """
    now = shared_checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        near = both_ways(now)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
        large = near.where("b > a").join(shuffled(least), "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        own = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(shuffled(own), "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").unionByName(own.select("a", F.col("_m").alias("b")))
        now = shared_checkpoint(small.distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)"))).first()
        if state == before:
            return now.unionByName(now.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = state


def _reach(links: DataFrame, every: DataFrame, keys: list[str], directed: bool, rows: int, nodes: int, most: int) -> DataFrame:
    """(keys, node, _r, _d) by edges: how many other nodes reach it, and the sum of their hops.

    links may have parallel ones and self-loops; without directions they may be there one way or both ways. Nodes are numbered
    by their links, and links become lists of numbers. A source reaches its own component at most, so work follows
    components. Those of up to `nodes` nodes and `most` links are walked in tasks, others by joins.
    """
    ends = links.select(*keys, "a", "b") if directed else links.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ends = ends.where("a <> b")
    degree = ends.select(*keys, F.explode(F.array("a", "b")).alias("node"), F.lit(1).alias("_k")).unionByName(every.select(*keys, "node", F.lit(0).alias("_k")))
    names = numbered(shared_checkpoint(degree.groupBy(*keys, "node").agg(F.sum("_k").alias("_k"))), [], ["_k", *keys, "node"], "_place")
    names = shared_checkpoint(names.where("_k > 0").select(*keys, "node", F.col("_place").alias("_id")))
    if names.isEmpty():
        return every.select(*keys, "node", F.lit(0).cast("long").alias("_r"), F.lit(0).cast("long").alias("_d")).limit(0)
    kind = "int" if (names.agg(F.max("_id")).first()[0] or 0) < 2**31 else "long"
    numbers = [names.select(*keys, F.col("node").alias(c), F.col("_id").cast(kind).alias(f"_{c}")).hint("shuffle_hash") for c in "ab"]
    lists = ends.join(numbers[1], [*keys, "b"]).groupBy(*keys, "a", F.expr(f"_b div {LIST}").alias("_piece")).agg(F.collect_set("_b").alias("to"))
    lists = shared_checkpoint(lists.join(numbers[0], [*keys, "a"]).select(F.col("_a").alias("a"), "to"))
    placed = shared_checkpoint(components(lists.select("a", F.explode("to").alias("b")).mapInArrow(_stars, "a long, b long")))
    lists = shared_checkpoint(lists.join(shuffled(placed.select(F.col("id").alias("a"), "component")), "a"))
    inside = lists.select("component", "a", F.explode("to").alias("b"))
    size = placed.groupBy("component").agg(F.count("*").alias("_n")).join(shuffled(lists.groupBy("component").agg(F.sum(F.size("to")).alias("_m"))), "component")
    size = shared_checkpoint(size.withColumn("_light", (F.col("_n") <= nodes) & (F.col("_m") <= most)))
    parts = [_reach_in_tasks(inside, size.where("_light"), directed)]
    if not size.where("not _light").isEmpty():
        heavy = placed.join(shuffled(size.where("not _light").select("component")), "component").withColumnRenamed("id", "node")
        # A component's sources share words.
        heavy = shared_checkpoint(heavy.repartitionByRange("component", "node").sortWithinPartitions("component", "node"))
        own = inside.join(shuffled(size.where("not _light").select("component")), "component").select("component", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        parts.append(_reach_by_joins(own if directed else both_ways(own, ["component"]), heavy, ["component"], directed, rows).select(F.col("node").alias("id"), "_r", "_d"))
    return names.join(shuffled(reduce(DataFrame.unionByName, parts)), F.col("_id") == F.col("id")).select(*keys, "node", "_r", "_d")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): a link from each node of a task's links to the least number that they join it with, for components()."""
    held, more, size = np.zeros((2, 0), np.int64), [], 0

    def joined() -> np.ndarray:
        names, ends = np.unique(np.concatenate([held, *more], axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        least = np.arange(len(names))
        while len(a):
            low = np.minimum(least[a], least[b])
            for end in (a, b):
                np.minimum.at(least, least[end], low)
            while (least[least] != least).any():
                least = least[least]
            open_ = least[a] != least[b]
            a, b = a[open_], b[open_]
        return np.stack([names, names[least]])

    for batch in batches:
        more.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in "ab"]))
        size += more[-1].shape[1]
        if size > 1 << 22:
            held, more, size = joined(), [], 0
    a, b = joined()
    yield pa.RecordBatch.from_arrays([pa.array(x[a != b]) for x in (a, b)], names=["a", "b"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """links(component, a, b) with lists of a batch's ends in a row for each component."""
    for batch in batches:
        own = batch.column(0).to_numpy()
        order = np.argsort(own, kind="stable")
        own = own[order]
        begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
        cuts, order = pa.array(np.r_[begins, len(own)].astype(np.int32)), pa.array(order)
        yield pa.RecordBatch.from_arrays([pa.array(own[begins]), *[pa.ListArray.from_arrays(cuts, batch.column(k).take(order)) for k in (1, 2)]], names=["component", "a", "b"])


def _reach_in_tasks(inside: DataFrame, size: DataFrame, directed: bool) -> DataFrame:
    """(id, _r, _d) of components whose links(component, a, b) a task can hold: a task for each slice of a component's sources.
    Slices are so many that all cores have work, and no more, as each has the component's links, in lists."""
    cores = inside.sparkSession.sparkContext.defaultParallelism
    words, work = F.ceil(F.col("_n") / 64), F.col("_n") / 64 * F.col("_m")
    share = (size.agg(F.sum(work)).first()[0] or 0) / (2 * cores)
    wanted = F.greatest(F.ceil(work / max(share, 1)), F.ceil(words / MOST_WORDS))
    slices = shared_checkpoint(size.select("component", F.least(wanted, F.ceil(words / TASK_WORDS)).cast("int").alias("_slices")))
    tasks = slices.agg(F.sum("_slices")).first()[0] or 0
    kinds = dict(inside.dtypes)
    lists = inside.mapInArrow(_packed, f"component long, a array<{kinds['a']}>, b array<{kinds['b']}>")
    rows = lists.join(shuffled(slices), "component").select("component", "a", "b", "_slices", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"))
    # Few rows may be much work: they are not put together by their bytes.
    rows = rows.repartition(max(1, min(2000, 3 * tasks)), "component", "_slice")

    def task(part: pa.Table) -> pa.Table:
        k, of = part.column("_slice")[0].as_py(), part.column("_slices")[0].as_py()
        names, (a, b) = _named([np.concatenate([x.flatten().to_numpy() for x in part.column(c).chunks]) for c in "ab"])
        del part
        n = len(names)
        into = _lists(n, b, a) if directed else _lists(n, np.r_[a, b], np.r_[b, a])
        out = _lists(n, a, b) if directed else into
        del a, b
        reached, hops, sides, wide = np.zeros(n, np.int64), np.zeros(n, np.int64), None if directed else _sides(n, *into), max(1, min(64, TASK_CELLS // n)) * 64
        for begin in range(k * n // of, (k + 1) * n // of, wide):
            r, h = _walked(n, out, into, sides, np.arange(begin, min(begin + wide, (k + 1) * n // of)))
            reached += r
            hops += h
        return pa.table({"id": names.astype(np.int64), "_r": reached, "_d": hops})

    return rows.groupBy("component", "_slice").applyInArrow(task, "id long, _r long, _d long").groupBy("id").agg(F.sum("_r").alias("_r"), F.sum("_d").alias("_d"))


def _named(ends: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct numbers in order, and their places for all ends."""
    low, high = min(int(x.min()) for x in ends), max(int(x.max()) for x in ends)
    if high - low > 4 * len(ends[0]) + 1000:
        names = np.unique(np.concatenate(ends))
        return names, [np.searchsorted(names, x).astype(np.int32) for x in ends]
    there = np.zeros(high - low + 1, bool)
    for x in ends:
        there[x - low] = True
    place = np.cumsum(there, dtype=np.int32) - np.int32(1)
    return np.flatnonzero(there) + low, [place[x - low] for x in ends]


def _lists(n: int, of: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, to): the ends `to` of each of n nodes lie from its first to that of the next."""
    first = np.r_[0, np.cumsum(np.bincount(of, minlength=n))]
    keys = of.astype(np.uint64)
    keys <<= np.uint64(32)
    keys |= to.astype(np.uint64) if to.dtype != np.int32 else to.view(np.uint32)
    keys.sort()
    return first, keys.astype(np.uint32).view(np.int32)


def _sides(n: int, first: np.ndarray, to: np.ndarray) -> np.ndarray | None:
    """The side of every node of a connected graph whose links all cross from one side to the other; None if there is no such split."""
    side = np.full(n, -1, np.int8)
    side[0], now, turn = 0, np.zeros(1, np.int64), 0
    while len(now):
        turn = 1 - turn
        near = to[_spans(first[now], first[now + 1])]
        near = near[side[near] < 0]
        side[near] = turn
        now = np.unique(near)
    # In blocks of nodes, so that what is looked up at once stays small.
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        if (side[to[first[lo] : first[hi]]] == np.repeat(side[lo:hi], np.diff(first[lo : hi + 1]))).any():
            return None
    return side


def walk(n: int, a: np.ndarray, b: np.ndarray, sources: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """How many of the sources reach each of n nodes by links from a to b, itself left out, and the sum of their hops."""
    return _walked(n, _lists(n, a, b), _lists(n, b, a), None, sources, block)


def _walked(n: int, out: tuple, into: tuple, sides: np.ndarray | None, sources: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """walk() by lists of links. A node has a bit for each source that has reached it.

    The first hop, and the second if it is shorter than to ask all nodes, goes from each source to its neighbours. From then
    on nodes that lack bits put those before them together by OR, a few at a time, until they lack none. If all links
    cross from one side to the other, only the side after the one that got bits is asked.
    """
    (begin, ahead), (first, before) = out, into
    words = -(-len(sources) // 64)
    had = np.zeros((n, words), np.uint64)
    reached, hops, hop = np.zeros(n, np.int64), np.zeros(n, np.int64), 1
    degree, onward = np.diff(first), np.diff(begin)
    near = [ahead[begin[s] : begin[s + 1]] for s in sources]
    twice = sum(int(onward[x].sum()) for x in near) <= len(before) * (1 + words / 8)
    changed = np.zeros(n, bool)
    for w in range(words):
        # What is marked at random is a byte for each node: eight sources at once.
        levels = np.zeros((3 if twice else 2, n, 8), np.uint8)
        for e in range(8):
            at = slice(64 * w + 8 * e, 64 * w + 8 * e + 8)
            one, two = np.zeros(n, np.uint8), np.zeros(n if twice else 0, np.uint8)
            for i, (s, x) in enumerate(zip(sources[at], near[at])):
                bit = np.uint8(1 << i)
                levels[0, s, e] |= bit
                one[x] |= bit
                if twice and len(x):
                    two[np.concatenate([ahead[p:q] for p, q in zip(begin[x].tolist(), begin[x + 1].tolist())])] |= bit
            levels[1, :, e] = one
            if twice:
                levels[2, :, e] = two
        own, *later = levels.view(np.uint64)[..., 0]
        for h, level in enumerate(later, 1):
            level &= ~own
            own |= level
            count = np.bitwise_count(level)
            reached += count
            hops += count if h == 1 else count.astype(np.int64) * h
        changed |= later[-1] != 0
        had[:, w] = own
    hop = 2 if twice else 1
    full = np.bitwise_or.reduce(had[sources], axis=0)
    active = np.flatnonzero(changed)
    lacking = (had != full).any(axis=1) & (degree > 0)
    while len(active) and lacking.any():
        hop += 1
        if int(onward[active].sum()) <= n // 4:
            met = np.zeros(n, bool)
            met[ahead[_spans(begin[active], begin[active + 1])]] = True
            asked = np.flatnonzero(met & lacking)
        elif sides is None:
            asked = np.flatnonzero(lacking)
        else:
            turn = [s for s in (0, 1) if (sides[active] != s).any()]
            asked = np.flatnonzero(lacking & np.isin(sides, turn))
        level = np.zeros((len(asked), words), np.uint64)
        some = max(1, block // words // 8)
        for p in range(0, len(asked), some):
            _asked(level[p : p + some], had, full, asked[p : p + some], first, before, some)
        counts = np.zeros(len(asked), np.int64)
        for p in range(0, len(asked), 8 * some):
            own, bits = asked[p : p + 8 * some], level[p : p + 8 * some]
            was = had.take(own, axis=0)
            bits &= ~was
            counts[p : p + 8 * some] = np.bitwise_count(bits).sum(axis=1)
            was |= bits
            had[own] = was
            lacking[own] = (was != full).any(axis=1)
        reached[asked] += counts
        hops[asked] += hop * counts
        active = asked[counts > 0]
    return reached, hops


def _asked(level: np.ndarray, had: np.ndarray, full: np.ndarray, nodes: np.ndarray, first: np.ndarray, before: np.ndarray, some: int) -> None:
    """Put the bits of the neighbours before each node together in its row of level; `some` rows of 8 neighbours are looked up at once."""
    at, end, rows, wide = first[nodes], first[nodes + 1], np.arange(len(nodes)), 1
    want = full & ~had.take(nodes, axis=0)
    while len(rows):
        # Past its last neighbour a node looks that one up again.
        for p in range(0, len(rows), max(1, 8 * some // wide)):
            q = slice(p, p + max(1, 8 * some // wide))
            places = np.minimum(at[q, None] + np.arange(wide), end[q, None] - 1)
            level[rows[q]] |= np.bitwise_or.reduce(had.take(before.take(places), axis=0), axis=1)
        at = at + wide
        go = (at < end) & (want.take(rows, axis=0) & ~level.take(rows, axis=0)).any(axis=1)
        rows, at, end, wide = rows[go], at[go], end[go], min(2 * wide, 32)


def _spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers from each lo up to its hi."""
    size = hi - lo
    return np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def _reach_by_joins(links: DataFrame, every: DataFrame, keys: list[str], directed: bool, rows: int) -> DataFrame:
    """_reach() of graphs of any size. Sources are bits of words.

    A level is a row for each node and word that has fresh bits: those of the nodes before, put together by OR, less those
    that the node had. Without directions only the two levels before can have had them.
    """
    step = shared_checkpoint(links.select(*keys, F.col("a").alias("node"), F.col("b").alias("next")))
    parts = []
    for batch in _batches(every, keys, rows, 64):
        start = batch.groupBy(*keys, "node", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        levels = [shared_checkpoint(start)]
        while True:
            ahead = levels[-1].join(step, [*keys, "node"]).select(*keys, F.col("next").alias("node"), "word", F.col("bits").alias("_new"), F.lit(0).cast("long").alias("_old"))
            had = reduce(DataFrame.unionByName, levels if directed else levels[-2:]).select(*keys, "node", "word", F.lit(0).cast("long").alias("_new"), F.col("bits").alias("_old"))
            both = ahead.unionByName(had).groupBy(*keys, "node", "word").agg(F.bit_or("_new").bitwiseAND(F.bitwise_not(F.bit_or("_old"))).alias("bits"))
            level = shared_checkpoint(both.where("bits <> 0"))
            if level.isEmpty():
                break
            levels.append(level)
        hops = [x.groupBy(*keys, "node").agg(F.sum(F.bit_count("bits")).cast("long").alias("_r")).withColumn("_d", F.col("_r") * h) for h, x in enumerate(levels)]
        parts.append(shared_checkpoint(reduce(DataFrame.unionByName, hops[1:]).groupBy(*keys, "node").agg(F.sum("_r").alias("_r"), F.sum("_d").alias("_d"))) if hops[1:] else None)
    parts = [p for p in parts if p is not None]
    if not parts:
        return every.select(*keys, "node", F.lit(0).cast("long").alias("_r"), F.lit(0).cast("long").alias("_d"))
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "node").agg(F.sum("_r").alias("_r"), F.sum("_d").alias("_d"))


def closeness_by_joins(links: DataFrame, every: DataFrame, keys: list[str], directed: bool = True, rows: int = STATE_ROWS, nodes: int = TASK_NODES, most: int = TASK_LINKS) -> DataFrame:
    """closeness() of graphs of any size: batches of sources, one after the other, so that no more than `rows` pairs of a
    source (or of 64, where every edge counts 1) and a node exist at any time. Where every edge counts 1, components of up to
    `nodes` nodes and `most` links are walked in tasks, each for a slice of the sources."""
    if links.where("w <> 1").isEmpty():
        reach = _reach(links, every, keys, directed, rows, nodes, most)
    else:
        parts = [shared_checkpoint(distances(links, every, keys, batch).groupBy(*keys, "node").agg((F.count("*") - F.count_if(F.col("source") == F.col("node"))).alias("_r"), F.sum("d").alias("_d"))) for batch in _batches(every, keys, rows)]
        reach = reduce(DataFrame.unionByName, parts).groupBy(*keys, "node").agg(F.sum("_r").alias("_r"), F.sum("_d").alias("_d"))
    return _scaled(reach, every, keys)


def _scaled(reach: DataFrame, every: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, value, converged) of every node from what reaches it, (keys, node, _r, _d)."""
    size = every.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = (every.join(size, keys) if keys else every.join(F.broadcast(size))).join(reach, [*keys, "node"], "left")
    value = F.when((F.col("_d") > 0) & (F.col("_n") > 1), F.col("_r") / F.col("_d") * F.col("_r") / (F.col("_n") - 1)).otherwise(0.0)
    return joined.select(*keys, "node", value.alias("value"), F.lit(True).alias("converged"))


def betweenness_by_joins(links: DataFrame, every: DataFrame, keys: list[str], directed: bool = True, rows: int = STATE_ROWS) -> DataFrame:
    """betweenness() of graphs of any size: shortest paths of a batch of sources are counted level by level, and what passes
    through a node is gathered from the last level back. No more than `rows` pairs of a source and a node exist at any time."""
    step = shared_checkpoint(links.select(*keys, F.col("a").alias("node"), F.col("b").alias("next")))
    pair = [*keys, "source", "node"]
    total = []
    for batch in _batches(every, keys, rows):
        levels = [shared_checkpoint(batch.select(*keys, F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))]
        while True:
            ahead = levels[-1].join(step, [*keys, "node"]).groupBy(*keys, "source", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
            # Without directions, only the two levels before can have had a node.
            had = reduce(DataFrame.unionByName, levels if directed else levels[-2:]).select(*pair)
            level = shared_checkpoint(ahead.join(had, pair, "left_anti"))
            if level.isEmpty():
                break
            levels.append(level)
        behind = None  # (pair, paths, through) of the level after
        parts = []
        for level in reversed(levels[1:]):
            if behind is None:
                own = level.withColumn("through", F.lit(0.0))
            else:
                # Each node gives its share to those one level nearer to the source that it is reached from.
                given = behind.select(*keys, "source", F.col("node").alias("next"), ((1 + F.col("through")) / F.col("paths")).alias("_g")).join(step, [*keys, "next"]).groupBy(*pair).agg(F.sum("_g").alias("_g"))
                own = level.join(given, pair, "left").withColumn("through", F.col("paths") * F.coalesce("_g", F.lit(0.0))).drop("_g")
            behind = shared_checkpoint(own)
            parts.append(behind.groupBy(*keys, "node").agg(F.sum("through").alias("_t")))
        if parts:
            total.append(shared_checkpoint(reduce(DataFrame.unionByName, parts).groupBy(*keys, "node").agg(F.sum("_t").alias("_t"))))
    size = every.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = every.join(size, keys) if keys else every.join(F.broadcast(size))
    if total:
        joined = joined.join(reduce(DataFrame.unionByName, total).groupBy(*keys, "node").agg(F.sum("_t").alias("_t")), [*keys, "node"], "left")
    else:
        joined = joined.withColumn("_t", F.lit(0.0))
    value = F.when(F.col("_n") > 2, F.coalesce("_t", F.lit(0.0)) / ((F.col("_n") - 1) * (F.col("_n") - 2))).otherwise(0.0)
    return joined.select(*keys, "node", value.alias("value"), F.lit(True).alias("converged"))


def _iterated(links: DataFrame, every: DataFrame, keys: list[str], start, step, normal: bool, rounds: int, tolerance: float) -> DataFrame:
    """Rounds of x = step(x, sum over incoming edges of w x), of all graphs at once; each stops by its own change."""
    incoming = shared_checkpoint(links.select(*keys, F.col("a").alias("node"), "b", "w"))
    on = [*keys, "node"]
    size = every.groupBy(*keys).agg(F.count("*").alias("_n"))
    now = shared_checkpoint((every.join(size, keys) if keys else every.join(F.broadcast(size))).withColumn("x", start(F.col("_n"))))
    done = None
    for _ in range(rounds):
        got = now.join(incoming, on).groupBy(*keys, F.col("b").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("_s"))
        after = now.join(got, on, "left").withColumn("y", step(F.col("x"), F.coalesce("_s", F.lit(0.0)))).drop("_s")
        if normal:
            norm = after.groupBy(*keys).agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("_l"))
            after = (after.join(norm, keys) if keys else after.join(F.broadcast(norm))).withColumn("y", F.when(F.col("_l") > 0, F.col("y") / F.col("_l")).otherwise(F.col("y"))).drop("_l")
        change = after.groupBy(*keys).agg((F.sum(F.abs(F.col("y") - F.col("x"))) < F.max("_n") * tolerance).alias("_settled"), F.bool_and(F.col("y") < float("inf")).alias("_finite"))
        both = shared_checkpoint(after.join(change, keys) if keys else after.join(F.broadcast(change)))
        ended = both.where("_settled or not _finite").select(*on, "_n", F.when(F.col("_settled") & F.col("_finite"), F.col("y")).otherwise(float("nan")).alias("value"), (F.col("_settled") & F.col("_finite")).alias("converged"))
        done = ended if done is None else done.unionByName(ended)
        now = both.where("not _settled and _finite").select(*on, "_n", F.col("y").alias("x"))
        if now.isEmpty():
            break
    rest = now.select(*on, "_n", F.col("x").alias("value"), F.lit(False).alias("converged"))
    return rest if done is None else done.unionByName(rest)


def eigenvector_by_joins(links: DataFrame, every: DataFrame, keys: list[str], rounds: int = 1000, tolerance: float = 1e-12, directed: bool = True) -> DataFrame:
    """eigenvector() of graphs of any size."""
    return _iterated(links, every, keys, lambda n: 1 / F.sqrt(n), lambda x, s: x + s, True, rounds, tolerance).select(*keys, "node", "value", "converged")


def katz_by_joins(links: DataFrame, every: DataFrame, keys: list[str], alpha: float = 0.1, beta: float = 1.0, rounds: int = 1000, tolerance: float = 1e-12, directed: bool = True) -> DataFrame:
    """katz() of graphs of any size."""
    found = _iterated(links, every, keys, lambda n: F.lit(0.0), lambda x, s: alpha * s + beta, False, rounds, tolerance)
    norm = found.groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_l"))
    joined = found.join(norm, keys) if keys else found.join(F.broadcast(norm))
    return joined.select(*keys, "node", F.when(F.col("converged") & (F.col("_l") > 0), F.col("value") / F.col("_l")).otherwise(float("nan")).alias("value"), "converged")


BY_JOINS = {"closeness": closeness_by_joins, "betweenness": betweenness_by_joins, "eigenvector": eigenvector_by_joins, "katz": katz_by_joins}


def hop_distances(edges: DataFrame, keys: list[str] = [], rounds: int | None = None, directed: bool = False) -> DataFrame:
    """(keys, source, node, hops) between all nodes that a path joins, by rounds that extend the frontier of all sources at once.

    Goes on until nothing new is reached; with `rounds`, raises if that isn't so after as many.
    """
    links = (edges.select(*keys, "a", "b") if directed else both_ways(simple(edges, keys), keys)).distinct()
    links = shared_checkpoint(links)
    start = nodes_of(edges, keys).select(*keys, F.col("node").alias("source"), "node", F.lit(0).alias("hops"))
    found, frontier = start, start
    for hop in count(1):
        step = frontier.join(links.select(*keys, F.col("a").alias("node"), "b"), [*keys, "node"]).select(*keys, "source", F.col("b").alias("node")).distinct()
        frontier = shared_checkpoint(step.join(found.select(*keys, "source", "node"), [*keys, "source", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            return found
        if rounds is not None and hop > rounds:
            raise RuntimeError(f"paths did not end in {rounds} rounds")
        found = found.unionByName(frontier)


def closeness_at_scale(edges: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys, node, closeness) of undirected graphs, all by joins."""
    named = edges.select(*keys, *[F.col(c).cast("string").alias(c) for c in "ab"])
    every = shared_checkpoint(nodes_of(named, keys))
    return _scaled(_reach(named, every, keys, False, STATE_ROWS, TASK_NODES, TASK_LINKS), every, keys).select(*keys, "node", F.col("value").alias("closeness"))


def evolution(edges: DataFrame, keys: list[str], grid: DataFrame) -> DataFrame:
    """grid(keys, node) with value: weighted closeness (distances are reciprocal weights) in each section, 0 where absent."""
    found = measure(weighted(edges, keys), "closeness", keys, weight="distance").select(*keys, "node", "value")
    return grid.withColumn("node", F.col("node").cast("string")).join(found, [*keys, "node"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def hypotheses(edges: DataFrame, keys: list[str], gone: str, candidates: DataFrame, small: int | None = None) -> DataFrame:
    """(keys, candidate, rank, value, possible): `gone` is merged into each candidate in turn; possible if it ranks first.

    Ranks are by closeness in edges, ties by name. Merging a node into itself changes nothing; candidates that a section's
    graph doesn't have are left out. Graphs of up to `small` nodes keep one set of distances for all candidates: a path
    through the merged node is one that ends in either node and goes on from the other. Of larger ones each candidate's
    graph is measured by joins.
    """
    small = SMALL if small is None else small
    single = simple(edges.withColumns({c: F.col(c).cast("string") for c in "ab"}), keys)
    every = nodes_of(single, keys)
    present = every.join(candidates.select(F.col("candidate").cast("string").alias("node")).distinct(), "node", "left_semi")
    large = shared_checkpoint(every.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > small).select(*keys))
    if large.isEmpty():
        return _hypotheses_in_tasks(single, present, keys, gone)
    own, rest = (single.join(large, keys, how) for how in ("left_anti", "left_semi"))
    merged = contract(rest.join(present.withColumnRenamed("node", "candidate"), keys), gone, "candidate")
    values = measure(simple(merged, [*keys, "candidate"]), "closeness", [*keys, "candidate"], small=small)
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "candidate").orderBy(F.desc("value"), "node")))
    by_joins = ranked.where(F.col("node") == F.col("candidate")).select(*keys, "candidate", "rank", "value", (F.col("rank") == 1).alias("possible"))
    return _hypotheses_in_tasks(own, present.join(large, keys, "left_anti"), keys, gone).unionByName(by_joins)


def _hypotheses_in_tasks(single: DataFrame, present: DataFrame, keys: list[str], gone: str) -> DataFrame:
    rows = single.unionByName(present.select(*keys, F.col("node").alias("a"), F.lit(None).cast("string").alias("b")))

    def task(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        links, asked = part[part["b"].notna()], sorted(part.loc[part["b"].isna(), "a"])
        names = sorted(set(links["a"]) | set(links["b"]))
        index = {n: i for i, n in enumerate(names)}
        lengths = np.full((len(names), len(names)), np.inf)
        i, j = links["a"].map(index).to_numpy(int), links["b"].map(index).to_numpy(int)
        lengths[i, j] = lengths[j, i] = 1.0
        found = merged_closeness(shortest(lengths), index.get(gone), [index[c] for c in asked])
        asked, found = [c for c, v in zip(asked, found) if v[index[c]] >= 0], [v for c, v in zip(asked, found) if v[index[c]] >= 0]
        rank = [int((v > v[index[c]]).sum() + (v[: index[c]] == v[index[c]]).sum()) + 1 for c, v in zip(asked, found)]
        value = [float(v[index[c]]) for c, v in zip(asked, found)]
        return pd.DataFrame({**{k: [v] * len(asked) for k, v in zip(keys, key)}, "candidate": asked, "rank": pd.Series(rank, dtype="int32"), "value": value, "possible": [r == 1 for r in rank]})

    kinds = ", ".join(f"`{k}` {dict(single.dtypes)[k]}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(task, f"{kinds}, candidate string, rank int, value double, possible boolean")


def merged_closeness(d: np.ndarray, gone: int | None, candidates: list[int]) -> list[np.ndarray]:
    """Closeness of every node once `gone` is merged into each of the candidates, from distances d without directions; a node
    that isn't there any more, or is left without an edge, has -1.

    A merged node is as near as either was, and paths may go on from the one where they reach the other.
    """
    out = []
    for c in candidates:
        own, live = d, np.ones(len(d), bool)
        if gone is not None and c != gone:
            near = np.minimum(d[c], d[gone])
            own = np.minimum(d, near[:, None] + near)
            own[c, :], own[:, c] = near, near
            np.fill_diagonal(own, 0.0)
            live[gone] = False
            # Nodes whose only edge was inside the merged one are gone with it.
            live &= (np.where(live & (np.arange(len(d)) != c), near, np.inf).min() < np.inf) | (np.arange(len(d)) != c)
        own = np.where(live[:, None] & live, own, np.inf)
        reach = np.isfinite(own)
        r, total = reach.sum(axis=1), np.where(reach, own, 0).sum(axis=1)
        n = live.sum()
        out.append(np.where(live, np.where((total > 0) & (n > 1), (r - 1) / np.where(total > 0, total, 1) * (r - 1) / max(n - 1, 1), 0.0), -1.0))
    return out


def display_scale(edges: DataFrame, value: str, keys: list[str] = []) -> DataFrame:
    """edges with scaled, value as a share of the greatest absolute value of its key: for widths and colours of drawings."""
    top = edges.groupBy(*keys).agg(F.max(F.abs(F.col(value))).alias("_top"))
    joined = edges.join(top, keys) if keys else edges.join(F.broadcast(top))  # one row
    return joined.withColumn("scaled", F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(0.0)).drop("_top")
