"""Near-duplicate embeddings: exact threshold pairs by a dual traversal of cover trees.

For unit vectors a cosine of at least c is a distance of at most t = sqrt(2 - 2 c). The top levels of a label's tree are
made by joins: a cell with more vectors than a block is split around some of its own vectors until all fit, and pairs
of cells are followed from level to level, as long as their covering balls come within t. Each pair of blocks left is a
task: it goes on with a cover tree for either block (nested centres, radii halved from level to level, every node with
the true radius that covers its members) and walks both trees together. A pair of nodes is dropped if its centres are
further apart than both radii and t together; members of the pairs left at the lowest level are compared exactly, in
double precision. Distances are worked out for centres and for pairs of nodes that are still met, no others. Equal
vectors are one node with a count, so groups of copies cost one row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, connected_components, cut, join_by

COSINE = 0.93
#: Vectors of a block; a cell of up to twice as many is left whole.
BLOCK = 1536
#: A cell is split around at most so many of its vectors (a power of two).
SPLIT = 64
#: Levels above the blocks: cells that are still too large then are cut by hash, and the parts meet in pairs.
LEVELS = 5
#: Radii of the levels within a block; the first covers the unit sphere.
RADII = (2.0, 1.0, 0.5, 0.25)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit vectors, up to rounding(components)."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def rounding(components: int) -> float:
    """How far a distance of unit vectors may be off: the root of what a product of so many components may be off."""
    return math.sqrt(2 * (components + 8) * np.finfo(float).eps)


class Tree:
    """Levels of nodes: centre (a row), parent (a node of the level above), covering radius, and members by node.

    evaluated counts the distances that were worked out.
    """

    def __init__(self, points: np.ndarray, radii: tuple[float, ...] = RADII):
        self.points, self.evaluated = points, 0
        n = len(points)
        node = np.zeros(n, np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        centres = np.zeros(min(n, 1), np.int64)
        gap = self._gaps(0, np.arange(n)) if n else np.empty(0)
        for depth, radius in enumerate(radii):
            parents = np.zeros(len(centres), np.int64)
            if depth:
                centres, parents, node, gap = self._split(centres, node, gap, radius)
            cover = np.zeros(len(centres))
            np.maximum.at(cover, node, gap)
            self.levels.append((centres, parents, cover))
        self.node = node
        self.order = np.argsort(node, kind="stable")
        self.first = np.searchsorted(node[self.order], np.arange(len(centres) + 1))

    def _gaps(self, centre: int, members: np.ndarray) -> np.ndarray:
        self.evaluated += len(members)
        return distances(self.points[members], self.points[centre : centre + 1])[:, 0]

    def _split(self, centres: np.ndarray, node: np.ndarray, gap: np.ndarray, radius: float):
        """Nested centres of the next level: each old one, then the first member of its node that none covers yet."""
        parents, new = list(range(len(centres))), list(centres)
        index, gap = node.copy(), gap.copy()
        open_ = np.flatnonzero(gap > radius)
        open_ = open_[np.argsort(node[open_], kind="stable")]
        edges = np.flatnonzero(np.r_[True, node[open_][1:] != node[open_][:-1]]) if len(open_) else open_
        for own in np.split(open_, edges[1:]):
            while len(own):
                apart = self._gaps(own[0], own)
                apart[0] = 0
                taken = apart <= radius
                index[own[taken]], gap[own[taken]] = len(new), apart[taken]
                new.append(own[0])
                parents.append(node[own[0]])
                own = own[~taken]
        return np.array(new, np.int64), np.array(parents, np.int64), index, gap


def _children(parents: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(parents, kind="stable")
    return order, np.searchsorted(parents[order], np.arange(nodes + 1))


def dual(a: Tree, b: Tree, t: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Candidate pairs of members (of i < j if both trees are one) that no bound excludes, and the distances worked out."""
    i = j = np.zeros(min(1, len(a.points), len(b.points)), np.int64)
    if not len(i):
        return i, j, 0
    slack = 4 * rounding(a.points.shape[1])
    evaluated = 0
    for depth in range(1, len(a.levels)):
        (centres_a, up_a, cover_a), (centres_b, up_b, cover_b) = a.levels[depth], b.levels[depth]
        below_a, first_a = _children(up_a, len(a.levels[depth - 1][0]))
        below_b, first_b = _children(up_b, len(b.levels[depth - 1][0]))
        kept = []
        for p, some in _runs(i, j):
            own = below_a[first_a[p] : first_a[p + 1]]
            others = np.concatenate([below_b[first_b[q] : first_b[q + 1]] for q in some.tolist()])
            apart = distances(a.points[centres_a[own]], b.points[centres_b[others]])
            evaluated += apart.size
            near = apart <= cover_a[own][:, None] + cover_b[others] + (t + slack)
            if same:  # a node with itself meets each pair of its children twice
                near &= (up_b[others] != p) | (own[:, None] <= others)
            r, c = np.nonzero(near)
            kept.append((own[r], others[c]))
        i, j = (np.concatenate(x) for x in zip(*kept)) if kept else (i[:0], j[:0])
    i, j = _products(i, j, [a.order, b.order], [a.first, b.first])
    if same:
        keep = (a.node[i] != a.node[j]) | (i < j)
        i, j = np.minimum(i, j)[keep], np.maximum(i, j)[keep]
    return i, j, evaluated


def _runs(i: np.ndarray, j: np.ndarray):
    """Each value of i with the values of j that it is paired with."""
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    edges = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else np.zeros(1, int)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(i[lo]), j[lo:hi]


def _products(i: np.ndarray, j: np.ndarray, members: list[np.ndarray], bounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of nodes all pairs of their members."""
    n, m = bounds[0][i + 1] - bounds[0][i], bounds[1][j + 1] - bounds[1][j]
    size = n * m
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(m, size)
    return members[0][np.repeat(bounds[0][i], size) + at // wide], members[1][np.repeat(bounds[1][j], size) + at % wide]


def close_pairs(a: np.ndarray, b: np.ndarray | None, cosine: float, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b (or of a alone, i < j) with a cosine of at least `cosine`, by a dual traversal; `tally` gets the
    number of distances worked out."""
    t = math.sqrt(max(0.0, 2 - 2 * cosine))
    first = Tree(unit(a))
    second = first if b is None else Tree(unit(b))
    i, j, evaluated = dual(first, second, t, b is None)
    if tally is not None:
        tally.append(evaluated + len(i) + first.evaluated + (0 if b is None else second.evaluated))
    other = a if b is None else b
    keep = np.empty(len(i), bool)
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((other * other).sum(axis=1))
    for k in range(0, len(i), 100_000):
        p, q = i[k : k + 100_000], j[k : k + 100_000]
        keep[k : k + 100_000] = np.einsum("ij,ij->i", a[p], other[q]) / (norm_a[p] * norm_b[q]) >= cosine
    return i[keep], j[keep]


def _linked(nodes: np.ndarray, times: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Links of each node, and edges to the least node that this task's links reach."""
    links = np.bincount(i, times[j], len(nodes)) + np.bincount(j, times[i], len(nodes))
    least = nodes.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, i, before[j])
        np.minimum.at(least, j, least[i])
        if (least == before).all():
            break
    some = np.flatnonzero(links)
    return pd.DataFrame({"node": nodes[some], "root": least[some], "links": links[some].astype(np.int64)})


def _valid(vector: Column) -> Column:
    """The vector in double precision if it can link at all, else null."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(wide, lambda x: x != 0)
    return F.when(fine, wide)


def _gap(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def groups(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, they have as many components, and their cosine is at least
    `cosine`. n_links counts other rows linked directly (equal vectors among them), component_id is the smallest
    vec_id that links reach, kept is vec_id = component_id. Null, empty and zero vectors, those with null or
    non-finite components, and rows with a null label or id have no links and are their own component (null ids:
    null, not kept). Repeated rows count as vectors of their own; an empty table gives no rows; other columns are not
    looked at.
    """
    # A vector's name: 128 bits of hash, so that joins needn't carry it.
    name = [F.xxhash64(F.lit(k), F.col("v")).alias(c) for k, c in enumerate("xy")]
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id").isNotNull(), F.col("label")).alias("label"), _valid(F.col("embedding")).alias("v")).select("*", *name))
    live = rows.where("label is not null and v is not null")
    nodes = live.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"))
    nodes = cut(nodes.select(F.concat_ws("/", F.col("label").cast("string"), F.size("v").cast("string")).alias("part"), "label", "node", "times", "v", *name))
    t = math.sqrt(max(0.0, 2 - 2 * cosine))
    assigned, pairs = _blocks(nodes, t, block, split)
    sides = pairs.select("part", "block_a", "block_b", F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    dealt = assigned.join(sides, ["part", "block"])

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        side = (rows["block"] == rows["block_a"]).to_numpy()
        parts = [rows[side], rows[~side]]
        (a, b), ids = [np.stack(p["v"].to_numpy()) if len(p) else None for p in parts], [p["node"].to_numpy(np.int64) for p in parts]
        i, j = close_pairs(a, b, cosine)
        return _linked(np.concatenate(ids), np.concatenate([p["times"].to_numpy(np.float64) for p in parts]), i, j + (len(ids[0]) if b is not None else 0))

    found = cut(dealt.groupBy("part", "block_a", "block_b").applyInPandas(task, "node long, root long, links long"))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = nodes.drop("v").join(counted, "node", "left").join(member, "node", "left")
    whole = whole.select("label", "x", "y", "times", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    joined = join_by(live.select("vec_id", "label", "x", "y"), whole, ["label", "x", "y"], "times").select("vec_id", "n_links", "component_id")
    alone = rows.where("label is null or v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _blocks(nodes: DataFrame, t: float, block: int, split: int) -> tuple[DataFrame, DataFrame]:
    """(part, block, node, times, v) of every node, and the pairs (part, block_a, block_b) whose balls come within t.

    Every level splits the cells of over two blocks: around up to `split` of a cell's vectors, chosen by hash, each to
    the nearest. A cell's children are numbered from split times its own number on, so a cell knows its parent; pairs
    of cells are made from the pairs of their parents.
    """
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    parts = nodes.select("part").distinct()
    # Cells are few: one for each block of vectors. Rows carry their cell's number and their distance to its centre.
    at = nodes.select("part", F.lit(0).cast("long").alias("cell"), F.lit(2.0).alias("gap"), "node", "times", "v")
    unit_vectors = None
    balls = parts.select("part", F.lit(0).cast("long").alias("cell"), F.lit(None).cast("array<double>").alias("centre"), F.lit(2.0).alias("radius"))
    pairs = parts.select("part", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    key = F.concat_ws("#", "part", F.col("cell").cast("string"))
    for _ in range(LEVELS):
        counts = at.groupBy("part", "cell").agg(F.count("*").alias("n"))
        large = cut(counts.where(F.col("n") > 2 * block).select("part", "cell", F.least(F.lit(split), F.ceil(F.col("n") / block)).cast("int").alias("wanted")))
        if large.isEmpty():
            break
        if unit_vectors is None:
            # Norms and unit vectors are written before they are used: an expression within a lambda is worked out for each element.
            unit_vectors = cut(at.withColumn("norm", size))
            at = cut(unit_vectors.withColumn("u", F.transform("v", lambda x: x / F.col("norm"))).drop("norm"))
        units = at.join(large.drop("wanted"), ["part", "cell"], "left_semi").select("part", "cell", "node", "u").withColumn("key", key)
        # At most `split` vectors for each cell.
        seeds = bounded_sample(units, "node", split, by="key").groupBy("part", "cell").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("node").alias("h"), "u"))).alias("seeds"))
        centres = cut(seeds.join(large, ["part", "cell"]).select("part", "cell", F.slice(F.col("seeds.u"), 1, F.col("wanted")).alias("centres")))
        near = F.array_min(F.transform("centres", lambda c, k: F.struct(_gap(c, F.col("u")).alias("gap"), k.cast("long").alias("k"))))
        moved = at.join(centres, ["part", "cell"], "left").withColumn("best", F.when(F.col("centres").isNotNull(), near))
        at = cut(moved.select("part", (F.col("cell") * split + F.coalesce("best.k", F.lit(0))).alias("cell"), F.coalesce("best.gap", "gap").alias("gap"), "node", "times", "v", "u"))
        fresh = centres.select("part", "cell", F.posexplode("centres").alias("k", "centre")).select("part", (F.col("cell") * split + F.col("k")).alias("cell"), "centre")
        fresh = fresh.join(at.groupBy("part", "cell").agg(F.max("gap").alias("radius")), ["part", "cell"])
        still = balls.join(large.drop("wanted"), ["part", "cell"], "left_anti").select("part", (F.col("cell") * split).alias("cell"), "centre", "radius")
        balls = cut(fresh.unionByName(still))
        a, b = (balls.select("part", F.col("cell").alias(s), F.expr(f"cell div {split}").alias(f"up_{s}"), F.col("centre").alias(f"centre_{s}"), F.col("radius").alias(f"radius_{s}")) for s in "ab")
        met = pairs.select("part", F.col("a").alias("up_a"), F.col("b").alias("up_b")).join(a, ["part", "up_a"]).join(b, ["part", "up_b"])
        # A ball without a centre is the whole sphere; rounding is far below 1e-6 for distances made of differences.
        close = F.coalesce(_gap("centre_a", "centre_b") <= F.col("radius_a") + F.col("radius_b") + t + 1e-6, F.lit(True))
        pairs = cut(met.where((F.col("up_a") != F.col("up_b")) | (F.col("a") <= F.col("b"))).where(close | (F.col("a") == F.col("b"))).select("part", "a", "b"))
    cuts = cut(at.groupBy("part", "cell").agg(F.when(F.count("*") > 2 * block, F.ceil(F.count("*") / block)).otherwise(1).cast("long").alias("cuts")))
    number = lambda cell, cut_: F.col(cell) * (1 << 24) + cut_
    assigned = at.join(cuts, ["part", "cell"]).select("part", number("cell", F.pmod(F.xxhash64("node"), F.col("cuts"))).alias("block"), "node", "times", "v")
    for s in "ab":
        pairs = pairs.join(cuts.select("part", F.col("cell").alias(s), F.col("cuts").alias(f"cuts_{s}")), ["part", s])
    pairs = pairs.withColumn("cut_a", F.explode(F.expr("sequence(0L, cuts_a - 1)"))).withColumn("cut_b", F.explode(F.expr("sequence(0L, cuts_b - 1)")))
    pairs = pairs.where("a <> b or cut_a <= cut_b").select("part", number("a", F.col("cut_a")).alias("block_a"), number("b", F.col("cut_b")).alias("block_b"))
    return assigned, pairs


ORACLE_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(e.vec_id = component_id, false) AS kept
FROM embeddings e LEFT JOIN component c ON e.vec_id = c.a LEFT JOIN counted d ON e.vec_id = d.a"""
