"""Embeddings (cover trees) and texts (SimHash) against brute force, and their edge cases."""

import math
import random
import re

import numpy as np
import pytest
import xxhash

from loomgraph.llm import covertree, simhash
from loomgraph.llm.common import connected_components


def components(n, linked):
    least = list(range(n))
    for _ in range(n):
        for i, j in linked:
            least[i] = least[j] = min(least[i], least[j])
    return least


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a B c", "a b c d", "A b\x0bc d e é É  x", "x y " * 50])
def test_fingerprint_is_the_contract(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_golay_code_is_perfect_and_keys_are_complete():
    table = simhash.decoder()
    assert np.bincount(table).tolist() == [2048] * 4096
    rng = random.Random(1)
    a = [rng.getrandbits(64) for _ in range(400)]
    b = [x ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(5))) for x in a]
    rows, keys = simhash.keys(np.array(a + b, np.uint64))
    own = [set(keys[rows == r].tolist()) for r in range(800)]
    assert all(own[i] & own[400 + i] for i in range(400))
    assert max(map(len, own)) <= 33


def documents(rng):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    texts += [texts[3]] * 5 + [None, "", "  ", "Solo", "solo", "x" * 20_000, " ".join(["long"] * 30_000)]
    for base in (5, 6, 7):  # chains of near copies of long texts
        long = " ".join(rng.choice(words) for _ in range(900)).split()
        for _ in range(6):
            long[rng.randrange(900)] = "changed"
            texts.append(" ".join(long))
    return texts


@pytest.mark.parametrize("block", [4, 2048])
def test_groups_equal_brute_force(spark, block, monkeypatch):
    texts = documents(random.Random(2))
    fps = [plain_fingerprint(t) for t in texts]
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    want = {(10 + i, f"{fps[i]:016x}", 10 + c) for i, c in enumerate(components(len(texts), linked))}
    monkeypatch.setattr(simhash.links, "__defaults__", (4, block))
    # Columns whose names the operator uses itself do no harm.
    docs = spark.createDataFrame([(10 + i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, component_id int").repartition(5)
    got = simhash.groups(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(texts)


def test_simhash_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(empty).count() == 0 and simhash.deduplicate(empty).count() == 0
    rows = spark.createDataFrame([(1, "same words here again"), (1, "same words here again"), (2, None), (3, ""), (None, "q"), (4, "same words here again")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.groups(rows).collect()}
    assert {(1, 1), (2, 2), (3, 2), (4, 1)} <= got and simhash.groups(rows).count() == 6
    kept = sorted(simhash.deduplicate(rows).collect(), key=lambda r: (r.doc_id or 0))
    assert [r.doc_id for r in kept] == [None, 1, 1, 2]


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_dual_traversal_equals_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 40, 300):
        x = rng.normal(size=(n, 12))
        x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, 12)) * rng.choice([0.01, 0.2, 0.5], size=(n - n // 2, 1))
        cosine = covertree.unit(x) @ covertree.unit(x).T
        i, j = covertree.close_pairs(x, None, 0.93)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, np.argwhere(np.triu(cosine >= 0.93, 1)).tolist()))
        y = x[::2] + 0.03
        i, j = covertree.close_pairs(x, y, 0.93)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, np.argwhere(covertree.unit(x) @ covertree.unit(y).T >= 0.93).tolist()))


def test_cover_trees_are_nested_and_cover():
    x = covertree.unit(np.random.default_rng(4).normal(size=(200, 6)))
    tree = covertree.Tree(x)
    for (above, _, _), (below, parents, cover), radius in zip(tree.levels, tree.levels[1:], covertree.RADII[1:]):
        assert set(above.tolist()) <= set(below.tolist()) and (cover <= radius + 1e-9).all() and parents.max() < len(above)


def test_no_link_is_lost_at_the_edge_of_a_bound():
    # Members a hair from their centres, at the threshold itself: computed distances near zero are off by 1e-8.
    rng = np.random.default_rng(6)
    angle = math.acos(0.93)
    for gap in (1e-9, 3e-9, 6.8e-9, 1.5e-8, 3e-8, 1e-7):
        for _ in range(60):
            u, w = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
            at = lambda x: (np.cos(x) * u + np.sin(x) * w)[None]
            x = np.concatenate([at(-gap), at(gap)])
            y = np.concatenate([at(angle + gap), at(angle - 4 * gap)])
            # Linked by the exact test, whatever the bounds say.
            want = {tuple(p) for p in np.argwhere(np.einsum("id,jd->ij", x, y) / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))) >= 0.93 + 1e-15).tolist()}
            got = set(zip(*(k.tolist() for k in covertree.close_pairs(x, y, 0.93))))
            assert want <= got


def test_bounds_save_distances():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 64))
    x = np.repeat(centres, 25, axis=0) + 0.03 * rng.normal(size=(1500, 64))
    tally = []
    i, j = covertree.close_pairs(x, None, 0.93, tally)
    assert len(i) == 60 * 25 * 24 // 2 and tally[0] < 0.12 * 1500 * 1499 / 2


def test_cells_are_split_until_they_fit(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(8, 16)), 150, axis=0) + 0.02 * rng.normal(size=(1200, 16))
    table = spark.createDataFrame([(i, v.tolist(), "s") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    nodes = table.select(covertree.F.lit("s").alias("part"), covertree.F.col("vec_id").alias("node"), covertree.F.lit(1).alias("times"), covertree.F.col("embedding").alias("v"))
    t = math.sqrt(2 - 2 * 0.93)
    assigned, pairs = covertree._blocks(nodes, t, 40, 4)
    sizes = [r["count"] for r in assigned.groupBy("block").count().collect()]
    assert sum(sizes) == 1200 and max(sizes) <= 80
    # Far fewer pairs of blocks than there are, and no link is lost.
    assert pairs.count() < 0.4 * len(sizes) * (len(sizes) + 1) / 2
    want = (covertree.unit(x) @ covertree.unit(x).T >= 0.93).sum(axis=1) - 1
    for levels in (5, 1):  # the second leaves cells that are cut by hash
        monkeypatch.setattr(covertree, "LEVELS", levels)
        got = {r.vec_id: r.n_links for r in covertree.groups(table, block=40, split=4).collect()}
        assert [got[i] for i in range(1200)] == want.tolist()


@pytest.mark.parametrize("block", [16, 1536])
def test_embedding_groups_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 8)).astype(np.float32)
    x[30:60] = x[:30] + rng.normal(size=(30, 8)).astype(np.float32) * 0.2
    rows = [(i, x[i].tolist(), int(i % 2)) for i in range(90)] + [(90 + k, x[4].tolist(), 0) for k in range(5)]
    nan, inf = float("nan"), float("inf")
    odd = [(200, None, 0), (201, [], 0), (202, [0.0] * 8, 0), (203, [nan] + [1.0] * 7, 0), (204, [inf] + [1.0] * 7, 0), (205, [None] + [1.0] * 7, 0), (206, x[4].tolist(), None), (207, [1.0, 2.0], 0), (208, [1.0, 2.0], 0), (95, x[4].tolist(), 0), (95, x[4].tolist(), 0)]
    rows += odd

    def good(r):
        return r[2] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])

    def close(a, b):
        if not (good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1])):
            return False
        u, v = np.array(a[1], float), np.array(b[1], float)
        return u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.93

    linked = [(i, j) for i in range(len(rows)) for j in range(i) if close(rows[i], rows[j])]
    ids = [r[0] for r in rows]
    order = sorted(range(len(rows)), key=lambda i: ids[i])
    rank = {i: k for k, i in enumerate(order)}
    least = components(len(rows), [(rank[i], rank[j]) for i, j in linked])
    want = sorted((ids[i], sum(i in p for p in linked), ids[order[least[rank[i]]]]) for i in range(len(rows)))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = covertree.groups(table, block=block).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_embedding_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert covertree.groups(empty).count() == 0
    one = spark.createDataFrame([(None, [1.0], 1, "x"), (5, [1.0], 1, "y")], "vec_id long, embedding array<float>, label int, node string")
    assert {tuple(r) for r in covertree.groups(one).collect()} == {(None, 0, None, False), (5, 0, 5, True)}
