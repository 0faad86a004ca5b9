"""Lloyd's rounds by two trees against all distances."""

import hashlib

import numpy as np
import pytest

from loomgraph.llm import lloyd


def vectors_of(kind, n, rng):
    if kind == "clusters":
        return np.floor(256 * (rng.normal(0, 1, (8, 6))[rng.integers(0, 8, n)] + rng.normal(0, 0.02, (n, 6)))).astype(np.int64)
    if kind == "grid":
        return rng.integers(-2, 3, (n, 3))
    if kind == "equal":
        return np.full((n, 4), 7)
    return np.floor(256 * rng.normal(0, 1, (n, 16))).astype(np.int64)


@pytest.mark.parametrize("kind", ["clusters", "grid", "equal", "noise"])
@pytest.mark.parametrize("n, k", [(1, 1), (50, 3), (700, 40)])
def test_nearest_centroids_are_those_of_all_distances(kind, n, k):
    rng = np.random.default_rng(n)
    points = vectors_of(kind, n, rng)
    centroids = np.vstack([points[rng.integers(0, n, (k + 1) // 2)], vectors_of(kind, k, rng)])[:k]
    tree, aims = lloyd.Tree.unpacked(lloyd.Tree(points).packed()), lloyd.Tree(centroids, whole=True)
    apart = ((points[:, None] - centroids) ** 2).sum(axis=2)
    cluster, distance = lloyd.nearest(tree, aims)
    assert cluster.tolist() == apart.argmin(axis=1).tolist() and distance.tolist() == apart.min(axis=1).tolist()
    count, total = lloyd.totals(tree, aims)
    assert count.tolist() == np.bincount(cluster, minlength=k).tolist()
    for c in range(k):
        assert total[c].tolist() == points[cluster == c].sum(axis=0).tolist()


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(7)
    points, tally = vectors_of("clusters", 4000, rng), []
    tree, aims = lloyd.Tree(points), lloyd.Tree(points[rng.integers(0, 4000, 40)], whole=True)
    lloyd.assign(tree, aims, tally)
    assert tally[0] < 0.25 * 4000 * 40


def plain(rows, k, rounds, size):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in set(own):
            some = [v for (_, v), o in zip(kept, own) if o == c]
            centroids[c] = [sum(x) // len(some) for x in zip(*some)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    return [(i, c, d, sum(e for _, o, e in out if o == c), sum(e for *_, e in out), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in out]


@pytest.mark.parametrize("k, block", [(4, 4096), (7, 16), (500, 30)])
def test_clusters_equal_plain_rounds(spark, k, block):
    rng = np.random.default_rng(k)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 1, 5)]) for i in range(90)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[4][1]), (200, None), (201, []), (202, [1.0] * 4), (203, [1.0, None, 1.0, 1.0, 1.0]), (204, [float("nan")] * 5), (205, [float("inf")] * 5), (206, [0.0] * 5), (207, [-0.0] * 5)]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, v int").repartition(3)
    got = sorted((tuple(r) for r in lloyd.cluster(df, k, 3, 5, block=block).collect()), key=str)
    assert got == sorted(plain(rows, k, 3, 5), key=str)


def test_empty_tables_and_huge_components(spark):
    df = spark.createDataFrame([(1, [1e12] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<double>")
    assert lloyd.cluster(df.limit(0)).count() == 0
    assert [(r.cluster, r.distance) for r in lloyd.cluster(df.where("vec_id = 2")).collect()] == [(0, 0)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        lloyd.cluster(df).count()
