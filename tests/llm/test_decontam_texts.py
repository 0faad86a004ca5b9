"""Passages are found within one text only, whatever stands beside it, and whatever the passages have in common."""

import random

import pytest

from loomgraph.llm import decontam


def plain(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.mark.parametrize("partitions", [1, 2, 5])
def test_halves_in_neighbouring_texts_are_no_passage(spark, partitions):
    rng = random.Random(4)
    item = plain(rng, 22)
    half = item.index(" ", len(item) // 2)
    texts = [plain(rng, 9) + " " + item[:half], item[half:] + " " + plain(rng, 9), item[: half - 3], item[half - 3 :], "x " + item]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs = docs if partitions == 1 else docs.repartition(partitions)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.edits) for r in decontam.matches(docs, bench).collect()] == [(4, 0)]
    assert sorted(r.doc_id for r in decontam.remove(docs, bench).collect()) == [0, 1, 2, 3]


def test_an_end_cut_off_costs_its_characters():
    item = "some words that stand here for a while and go on to the very end of it"
    index = decontam.build([1], [item])
    allowed = decontam.budget(len(item))
    for gone in range(allowed + 3):
        for text in (item[gone:], item[: len(item) - gone]):
            edits = [n for t, _, n, _, _ in decontam.search(["before it", text, "after it"], index) if t == 1]
            lost = len(item) - len(text.strip())
            assert (min(edits) <= lost if edits else lost > allowed), (gone, text)


def test_a_shared_sentence_finds_the_right_passages(monkeypatch):
    rng = random.Random(5)
    opening = plain(rng, 12)
    items = [opening + " " + plain(rng, 14) for _ in range(3000)]
    index = decontam.build(list(range(len(items))), items)
    texts = [opening, opening + " " + plain(rng, 14), "z " + items[5] + " " + opening, items[2999] + " " + items[7], plain(rng, 30)]
    want = {(2, 5), (3, 7), (3, 2999)}
    found = decontam.search(texts, index)
    assert {(t, i) for t, i, *_ in found} == want
    monkeypatch.setattr(decontam, "HITS", 20_000)
    monkeypatch.setattr(decontam, "CELLS", 3000)
    assert sorted(decontam.search(texts, index)) == sorted(found)


def test_short_passages_are_found_as_words():
    index = decontam.build([1, 2, 3, 4, None], ["Ab, cd", "x", "  !", "7 times", "two of"])
    texts = ["ab cd", "so ab--CD so", "cab cd", "ab cdx", "ab", "cd", "x-ray", "7 TIMES.", "seven times", "of two of", None, "", "two", "of"]
    assert {(t, i) for t, i, *_ in decontam.search(texts, index)} == {(0, 1), (1, 1), (6, 2), (7, 4), (9, None)}
    ((_, _, edits, start, end),) = decontam.search(["so ab--CD so"], decontam.build([1], ["ab cd"]))
    assert (edits, "so ab--CD so"[start:end]) == (0, "ab--CD")
