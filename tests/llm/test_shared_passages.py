"""Passages that earlier documents have: the operator against a search of all windows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import substrings


def plain(rows, window):
    """(words, words kept) of each (doc_id, text), by a set of all windows of documents before."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), words in zip(rows, split):
        for i in range(len(words) - window + 1 if d is not None else 0):
            key = tuple(words[i : i + window])
            least[key] = min(least.get(key, d), d)
    out = []
    for (d, _), words in zip(rows, split):
        gone = {i + k for i in range(len(words) - window + 1 if d is not None else 0) if least[tuple(words[i : i + window])] < d for k in range(window)}
        out.append((len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def corpus(seed, n=60, vocabulary=12):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "é中", "x y", "\U0001f600", *map(str, range(vocabulary))])
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            a = rng.randrange(len(passage))
            words[3:3] = passage[a : a + rng.randrange(1, 25)]
        if rows and rng.random() < 0.2:
            words = (rng.choice(rows)[1] or "").split()
        rows.append((rng.randrange(n), rng.choice([" ", "\n", "\t  "]).join(words)))
    return rows + [(None, "a B 1 2 3 a B 1 2 3"), (None, None), (3, None), (4, ""), (5, " \x0b\n"), (6, "1 " * 3000), (7, "1 " * 3000), (7, "1 2 3 4 5"), (8, "1 2 3 4 5"), (8, "1 2 3 4 5")]


@pytest.mark.parametrize("window, gram, sizes", [(4, 2, {}), (5, 5, {}), (13, 5, {}), (1, 5, {}), (4, 2, {"shard_words": 30, "stream_words": 40, "long": 3})])
def test_equals_a_search_of_all_windows(spark, window, gram, sizes):
    rows = corpus(window)
    docs = spark.createDataFrame([(d, t, "s", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, spans string, x int").repartition(3)
    got = sorted(tuple(r) for r in substrings.remove_shared(docs, window, gram, **sizes).na.fill(-1, ["doc_id"]).collect())
    want = sorted((-1 if d is None else d, *found) for (d, _), found in zip(rows, plain(rows, window)))
    assert got == want and sum(r[2] for r in got) > 0


def test_no_rows_give_none(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_shared(docs).count() == 0
    alone = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, substrings.remove_shared(alone).collect())) == [(1, 0, 0, ""), (2, 2, 0, "a b")]


def test_automata_know_the_first_text_of_every_window():
    rng = random.Random(1)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 25))] for _ in range(30)]
    machine = substrings.Automaton()
    numbers = [rng.randrange(50) for _ in texts]
    for words, number in zip(texts, numbers):
        machine.add(words, number)
    machine.finish()
    for window in (1, 2, 4, 7):
        least = {}
        for words, number in zip(texts, numbers):
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                least[key] = min(least.get(key, 99), number)
        for _ in range(60):
            words, own = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(0, 30))], rng.randrange(60)
            want = [least.get(tuple(words[i : i + window]), 99) < own for i in range(max(0, len(words) - window + 1))]
            assert machine.covered(words, own, window).tolist() == want


def test_words_and_anchors_depend_on_the_words_alone():
    texts = ["a bb  ccc\nd", None, "", " \t", "x bb ccc d\x0c", "é ü b \x1c"]
    for column in (pa.array(texts), pa.array(["zz", *texts, "q"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        data, first, last, row = substrings.word_spans(column)
        found = [(r, bytes(data[a:b])) for a, b, r in zip(first, last, row)]
        assert found == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split()]
    hashes = substrings.word_hashes(data, first, last)
    assert hashes[1] == hashes[5] and hashes[3] == hashes[7] and len(set(hashes.tolist())) == 7
    start, anchor = substrings.anchors(hashes, row, 3, 2)
    assert start.tolist() == [0, 1, 4, 5] and anchor[1] == anchor[3]
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    start, anchor = substrings.anchors(words, np.zeros(200, int), 13, 5)
    alone = [substrings.anchors(words[i : i + 13], np.zeros(13, int), 13, 5)[1][0] for i in range(188)]
    assert anchor.tolist() == alone and len(set(alone)) < 80
