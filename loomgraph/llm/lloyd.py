"""Centroid clustering: Lloyd's rounds by a dual traversal of two trees, exact in whole numbers.

Vectors are turned into whole numbers and dealt to blocks where they are read; every block gets a cover tree (nested
centres, radii halved from level to level, every node with the radius that covers its members, and their sum), written
once to the shared folder. Every round sends the centroids to all tasks, as many as are asked for, and makes a cover tree
of them; a block's tree and the centroids' tree are walked together. A pair of nodes is dropped if no vector of the one
can be nearer to any centroid of the other than to the best centre met so far. A node of vectors with a single centroid
left is assigned as a whole, by its sum; members of the other lowest nodes are compared exactly with the centroids left to
them. Tasks give a sum and a count for each centroid; the vectors themselves are never moved.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, stored

#: Vectors of a block, and levels of both trees below the root.
BLOCK, DEPTH = 4096, 6
#: Whole numbers are below this: squared distances then fit in 64 bits.
BOUND = 1 << 27
#: Pairs of a vector and a centroid that are compared in one go.
PAIRS = 40_000


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows, in doubles."""
    gap = a.astype(np.float64) - b
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


class Tree:
    """Levels of (centre's row, parent's node, covering radius); members of the lowest nodes, in `order` from `first` on."""

    def __init__(self, points: np.ndarray, depth: int = DEPTH, whole: bool = False):
        """With `whole` the lowest level has a node for each distinct point."""
        self.points = points
        n = len(points)
        node = np.zeros(n, np.int64)
        centres = np.zeros(min(n, 1), np.int64)
        gap = _apart(points, points[:1]) if n else np.empty(0)
        radius = float(gap.max(initial=0))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(depth + 1):
            parents = np.zeros(len(centres), np.int64)
            if level:
                radius = 0.0 if whole and level == depth else radius / 2
                centres, parents, node, gap = self._split(centres, node, gap, radius)
            cover = np.zeros(len(centres))
            np.maximum.at(cover, node, gap)
            self.levels.append((centres, parents, cover))
        self._members(node)

    def _members(self, node: np.ndarray) -> None:
        self.node = node
        self.order = np.argsort(node, kind="stable")
        self.first = np.searchsorted(node[self.order], np.arange(len(self.levels[-1][0]) + 1))

    def _split(self, centres: np.ndarray, node: np.ndarray, gap: np.ndarray, radius: float):
        """Nested centres of the next level: each old one, then the first member of its node that none covers yet."""
        parents, new = list(range(len(centres))), list(centres)
        index, gap = node.copy(), gap.copy()
        open_ = np.flatnonzero(gap > radius)
        open_ = open_[np.argsort(node[open_], kind="stable")]
        edges = np.flatnonzero(np.r_[True, node[open_][1:] != node[open_][:-1]]) if len(open_) else open_
        for own in np.split(open_, edges[1:]):
            while len(own):
                apart = _apart(self.points[own], self.points[own[:1]])
                taken = apart <= radius
                taken[0] = True
                index[own[taken]], gap[own[taken]] = len(new), apart[taken]
                new.append(own[0])
                parents.append(node[own[0]])
                own = own[~taken]
        return np.array(new, np.int64), np.array(parents, np.int64), index, gap

    def sums(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(vectors, their sum) of every node of every level."""
        out = []
        count, total, node = np.ones(len(self.points), np.int64), self.points, self.node
        for centres, parents, _ in reversed(self.levels):
            below, rows = count, total
            count, total = np.zeros(len(centres), np.int64), np.zeros((len(centres), self.points.shape[1]), np.int64)
            np.add.at(count, node, below)
            np.add.at(total, node, rows)
            out.append((count, total))
            node = parents
        return out[::-1]

    def packed(self) -> bytes:
        to = io.BytesIO()
        parts = {"points": self.points.astype(np.int32), "node": self.node.astype(np.int32)}
        for k, level in enumerate(self.levels):
            parts |= {f"{name}{k}": x for name, x in zip("cpr", level)}
        np.savez(to, **parts)
        return to.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        out = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as parts:
            out.points = parts["points"].astype(np.int64)
            out.levels = [tuple(parts[f"{name}{k}"] for name in "cpr") for k in range(sum(x[0] == "c" for x in parts.files))]
            out._members(parts["node"].astype(np.int64))
        return out


def _below(parents: np.ndarray, nodes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in nodes, child) for all children of each of the nodes."""
    order = np.argsort(parents, kind="stable")
    first = np.searchsorted(parents[order], np.arange(count + 1))
    size = first[nodes + 1] - first[nodes]
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(np.arange(len(nodes)), size), order[np.repeat(first[nodes], size) + at]


def assign(tree: Tree, aims: Tree, tally: list[int] | None = None) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(whole, members, clusters): whole nodes (level, nodes, cluster of each), and the vectors compared one by one, with
    their clusters. aims is the tree of the centroids, made with `whole`. Ties go to the smaller number.

    `tally` gets the number of distances worked out.
    """
    whole: list[tuple[int, np.ndarray, np.ndarray]] = []
    if not len(tree.points):
        return whole, np.empty(0, np.int64), np.empty(0, np.int64)
    i = j = np.zeros(1, np.int64)
    single = np.diff(aims.first) == 1
    evaluated = 0
    for level in range(1, len(tree.levels)):
        (centres, parents, cover), (targets, up, spread) = tree.levels[level], aims.levels[level]
        at, i = _below(parents, i, len(tree.levels[level - 1][0]))
        pair, j = _below(up, j[at], len(aims.levels[level - 1][0]))
        i = i[pair]
        near = np.empty(len(i))
        for k in range(0, len(i), PAIRS):
            near[k : k + PAIRS] = _apart(tree.points[centres[i[k : k + PAIRS]]], aims.points[targets[j[k : k + PAIRS]]])
        evaluated += len(i)
        # A centre of the centroids' tree is a centroid: none of a node's vectors is further from its nearest than this.
        upper = np.full(len(centres), np.inf)
        np.minimum.at(upper, i, near)
        # Rounding is far below a millionth of a distance, and of one.
        kept = near - spread[j] - 2 * cover[i] <= upper[i] * (1 + 1e-6) + 1e-3
        i, j = i[kept], j[kept]
        if level == len(tree.levels) - 1:
            break
        # Nodes with one centroid left are done. A node without a radius is the lowest one of the same number.
        done = (np.bincount(i, minlength=len(centres))[i] == 1) & (spread[j] == 0) & single[j]
        if done.any():
            whole.append((level, i[done], aims.order[aims.first[j[done]]]))
            i, j = i[~done], j[~done]
    counts = np.bincount(i, minlength=len(tree.levels[-1][0]))
    lone = (counts[i] == 1) & single[j]
    if lone.any():
        whole.append((len(tree.levels) - 1, i[lone], aims.order[aims.first[j[lone]]]))
        i, j = i[~lone], j[~lone]
    members, clusters = _exact(tree, aims, i, j)
    if tally is not None:
        tally.append(evaluated + len(members))
    return whole, members, clusters


def _exact(tree: Tree, aims: Tree, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    at, k = _spread(aims.first, j)
    i, k = i[at], aims.order[k]
    nodes, starts = np.unique(i, return_index=True)
    ends = np.r_[starts[1:], len(i)]
    members, found = [], []
    for node, a, b in zip(nodes.tolist(), starts.tolist(), ends.tolist()):
        own, some = tree.order[tree.first[node] : tree.first[node + 1]], np.sort(k[a:b])
        for p in range(0, len(own), max(1, PAIRS // len(some))):
            rows = own[p : p + max(1, PAIRS // len(some))]
            gap = tree.points[rows][:, None, :] - aims.points[some]
            members.append(rows)
            # The first of equal ones: centroids are in order.
            found.append(some[np.einsum("abc,abc->ab", gap, gap).argmin(axis=1)])
    return (np.concatenate(members), np.concatenate(found)) if members else (np.empty(0, np.int64), np.empty(0, np.int64))


def _spread(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in nodes, place) for all places of each node."""
    size = first[nodes + 1] - first[nodes]
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(np.arange(len(nodes)), size), np.repeat(first[nodes], size) + at


def totals(tree: Tree, aims: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, their sum) of each centroid."""
    count, total = np.zeros(len(aims.points), np.int64), np.zeros_like(aims.points)
    whole, members, clusters = assign(tree, aims)
    sums = tree.sums() if whole else []
    for level, nodes, own in whole:
        np.add.at(count, own, sums[level][0][nodes])
        np.add.at(total, own, sums[level][1][nodes])
    np.add.at(count, clusters, 1)
    np.add.at(total, clusters, tree.points[members])
    return count, total


def nearest(tree: Tree, aims: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of every vector."""
    out = np.zeros(len(tree.points), np.int64)
    whole, members, clusters = assign(tree, aims)
    for level, nodes, own in whole:
        node = tree.node
        for depth in range(len(tree.levels) - 1, level, -1):
            node = tree.levels[depth][1][node]
        cluster = np.full(len(tree.levels[level][0]), -1)
        cluster[nodes] = own
        out = np.where(cluster[node] >= 0, cluster[node], out)
    out[members] = clusters
    distance = np.empty(len(out), np.int64)
    for k in range(0, len(out), 4096):
        gap = tree.points[k : k + 4096] - aims.points[out[k : k + 4096]]
        distance[k : k + 4096] = np.einsum("ij,ij->i", gap, gap)
    return out, distance


def _kept(vectors: DataFrame, components: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors in whole numbers."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    fine = (F.size("embedding") == components) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("embedding is not null").where(fine)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    large = F.exists("embedding", lambda x: F.abs(x.cast("double") * scale) >= BOUND)
    limit = F.raise_error(F.lit(f"components of {BOUND // scale} or more have squared distances beyond 64 bits"))
    return rows.select("vec_id", F.when(large, limit.cast("array<bigint>")).otherwise(whole).alias("v"))


def _trees(kept: DataFrame, block: int) -> DataFrame:
    """(ids, tree): the packed tree of each block, and its vectors' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []

        def made() -> pa.RecordBatch:
            packed = Tree(np.concatenate(rows)).packed()
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, sum(map(len, ids))], pa.concat_arrays(ids)), pa.array([packed], pa.binary())], names=["ids", "tree"])

        for batch in batches:
            for k in range(0, batch.num_rows, block):
                part = batch.slice(k, block)
                v = part.column(1)
                flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
                ids.append(part.column(0))
                rows.append(flat.astype(np.int64))
                if sum(map(len, rows)) >= block:
                    yield made()
                    ids, rows = [], []
        if rows:
            yield made()

    return kept.select("vec_id", "v").mapInArrow(run, "ids array<long>, tree binary")


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of their vectors' means; those without vectors stay."""
    sent = trees.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aims, count, total = Tree(sent.value, whole=True), None, None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                n, s = totals(Tree.unpacked(data), aims)
                count, total = (n, s) if count is None else (count + n, total + s)
        if count is not None:
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    # A row for each centroid and task.
    parts = trees.select("tree").mapInArrow(run, "cluster long, n long, total array<long>")
    flat = parts.select("cluster", "n", F.posexplode("total").alias("p", "x"))
    summed = flat.groupBy("cluster", "p").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = centroids.copy()
    for r in summed:
        out[r.cluster, r.p] = int(r.x) // r.n
    sent.destroy()
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, components: int = 64, scale: int = 256, seed: str = "2", block: int = BLOCK) -> DataFrame:
    """One row per kept row of vectors: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `components` components, none null or non-finite, each turned into floor(scale * x). The
    first centroids are the k kept rows with the smallest sha256 of `seed:vec_id` (ties: the smaller vector), all rows if
    there are fewer. In every round each vector goes to its nearest centroid, ties to the smaller number, and centroids
    with vectors move to the floor of their mean. Null ids are hashed as empty text; repeated rows are vectors of their
    own; an empty table, or one without a kept vector, gives no rows; other columns are not looked at. Components beyond
    2^27 / scale are an error, as their squared distances have more than 64 bits.
    """
    spark = vectors.sparkSession
    kept = _kept(vectors, components, scale)
    place = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    # At most k rows.
    first = kept.orderBy(place, "v").limit(k).select("v").collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), components)
    trees, folder = stored(_trees(kept, block), "trees")
    for _ in range(rounds):
        centroids = _moved(trees, centroids)
    sent = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aims = Tree(sent.value, whole=True)
        for batch in batches:
            for k in range(batch.num_rows):
                own, distance = nearest(Tree.unpacked(batch.column(1)[k].as_py()), aims)
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, pa.array(own, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    found, _ = stored(trees.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    drop_folder(spark, folder)
    # A row for each centroid.
    sizes = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = F.broadcast(spark.createDataFrame([(c, sizes.get(c, 0), sum(sizes.values()), x) for c, x in enumerate(digest)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(table, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, components: int = 64, scale: int = 256, seed: str = "2") -> str:
    """cluster() of `embeddings`, in DuckDB's SQL."""
    apart = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT r, arg_min(n, (d, n)) AS cluster, min(d) AS distance FROM (SELECT r, n, {apart} AS d FROM kept, cent{r}) GROUP BY r)""")
        if r < rounds:
            steps.append(f"""flat{r} AS (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS p FROM kept JOIN near{r} USING (r)),
means{r} AS (SELECT cluster AS n, list(m ORDER BY p) AS c FROM (SELECT cluster, p, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM flat{r} GROUP BY cluster, p) GROUP BY cluster),
cent{r + 1} AS MATERIALIZED (SELECT n, coalesce(m.c, o.c) AS c FROM cent{r} o LEFT JOIN means{r} m USING (n))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) AS r, vec_id, v FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v, sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h
    FROM embeddings WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)),
cent0 AS MATERIALIZED (SELECT r - 1 AS n, v AS c FROM kept WHERE r <= {k}),
{(","+chr(10)).join(steps)},
sizes AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM near{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance, cluster_inertia, (SELECT sum(distance) FROM near{rounds})::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN near{rounds} USING (r) JOIN sizes USING (cluster) JOIN cent{rounds} ON n = cluster"""
