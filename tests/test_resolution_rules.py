"""Titles stand with names only, variants are listed once, and bounds by characters lose no match."""

import random

import numpy as np
import pytest

from loomgraph.operators import likeness, resolve


def test_titles_need_a_name(spark):
    schema = "id int, row int, fullname string, firstname string, middlename string, surname string, gender string, aka string, profession string"
    names = spark.createDataFrame([(1, 1, None, "Ann", None, "Reed", "f", None, None)], schema)
    got = {r.variant for r in resolve.name_variants(names).collect()}
    assert got == {"ann", "reed", "ann reed", "mrs reed", "ms reed", "miss reed"}


def test_characters_bound_the_common_subsequence():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcé中\U0001f600 ") for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    counts = likeness.characters(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert min(len(a), len(b)) >= np.minimum(counts[i], counts[j]).sum() >= likeness.lcs(a, b)


def test_subsequences_of_many_pairs_equal_those_one_by_one():
    rng = random.Random(5)
    make = lambda: "".join(rng.choice("abcé中\U0001f600 ") for _ in range(rng.choice([0, 1, 5, 12, 63, 64, 65, 90])))
    a, b = [make() for _ in range(300)], [make() for _ in range(300)]
    assert likeness.lcs_many(a, b).tolist() == [likeness.lcs(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.6, 2 / 3, 0.75, 0.9, 1.0])
def test_alike_texts_share_the_pairs_that_the_index_relies_on(least):
    rng = random.Random(int(least * 100))
    gap, seen = likeness.gap_of(least), 0
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        b = "".join(c for c in a if rng.random() > 0.2) + "".join(rng.choice("abc") for _ in range(rng.randrange(0, 3)))
        if likeness.ratio(a, b) >= 100 * least:
            seen += 1
            shared = len(set(likeness.gapped_pairs(a, gap)) & set(likeness.gapped_pairs(b, gap)))
            assert shared >= max(likeness.shared_pairs(len(a), least), likeness.shared_pairs(len(b), least)) >= 2
    assert seen > 100


def test_a_text_with_all_of_a_block():
    rng = random.Random(6)
    make = lambda longest: "".join(rng.choice("abcé中\U0001f600 ") for _ in range(rng.randrange(1, longest)))
    a, b = [make(90) for _ in range(40)], [make(300) for _ in range(40)] + ["", "zq"]
    got = {(i, j): s for i, j, s in zip(*likeness._compared(a, b, 0.4))}
    assert got == {(i, j): s for i, x in enumerate(a) for j, y in enumerate(b) if (s := likeness.ratio(x, y)) >= 40}


@pytest.mark.parametrize("least", [0.5, 0.75, 0.9])
def test_index_and_blocks_find_the_same(spark, least):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(80)]
    sides = [likeness._prepared(spark.createDataFrame([(" ".join(rng.sample(words, rng.randrange(1, 4))),) for _ in range(n)], "name string")) for n in (60, 150)]
    key = lambda df: sorted(map(tuple, df.select("query", "variant", "score").collect()))
    sizes = tuple(s.count() for s in sides)
    assert key(likeness.by_index(*sides, least)) == key(likeness.by_blocks(*sides, least, sizes)) == key(likeness.by_blocks(*sides, least, sizes, 20)) != []


@pytest.mark.parametrize("threshold, few", [(50.0, 10**9), (50.0, 0), (60.0, 0), (85.0, 0), (100.0, 0)])
def test_best_matches_are_those_of_all_pairs(spark, monkeypatch, threshold, few):
    monkeypatch.setattr(likeness, "ROW_COST", 0.01 if few == 0 and threshold > 50 else 10)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    texts = [" ".join(rng.sample(words, 2)) for _ in range(120)] + ["", "  ", "x"]
    asked = {" ".join(rng.sample(words, rng.randrange(1, 3))) for _ in range(40)} | {"x", "", " ", "\u0002a", "z" * 70}
    listed = spark.createDataFrame([(v, texts.index(v)) for v in sorted(set(texts))], "variant string, id_order long")
    queries = spark.createDataFrame([(q,) for q in [*asked, *asked, None]], "query string")
    got = sorted(map(tuple, likeness.top(queries, listed, 3, threshold, few).collect()))
    plain = lambda t: " ".join(sorted(t.split()))
    want = []
    for q in asked:
        if q.strip():
            scored = sorted((-s, texts.index(v), v) for v in set(texts) if v.strip() and (s := likeness.ratio(plain(q), plain(v))) >= threshold)
            want += [(q, v, -s, k + 1) for k, (s, _, v) in enumerate(scored[:3])]
    assert got == sorted(want) and want


def test_no_names_match_nothing(spark):
    none = spark.createDataFrame([], "variant string, id_order long")
    some = spark.createDataFrame([("a b",)], "query string")
    assert likeness.top(some, none, 3, 60.0).count() == likeness.top(some.limit(0), spark.createDataFrame([("a", 1)], "variant string, id_order long"), 3, 60.0).count() == 0
    with pytest.raises(ValueError):
        likeness.top(some, none, 3, 0.0)


def test_variants_seen_lists_each_name_once(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, "b", 1), (2, None, 1)], "canonical_id int, name string, pos int")
    assert {r.canonical_id: r.name_variants for r in resolve.variants_seen(rows).collect()} == {1: ["b", "a"], 2: [None]}
