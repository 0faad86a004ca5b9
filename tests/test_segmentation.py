"""Abbreviations and starters learnt from made text, and sentences kept apart from it."""

import random

from loomgraph.functions import segmentation, text


def made(seed, n):
    """(sentences of a text) with abbreviations, initials, decimals."""
    rng = random.Random(seed)
    names, verbs, things = ["Owen", "Vera", "Lombard", "Blore"], ["sees", "takes", "leaves", "finds"], ["boat", "island", "house", "letter", "clock", "lamp"]
    who = lambda: rng.choice([f"Mr. {rng.choice(names)}", f"Dr. {rng.choice(names)}", f"{rng.choice('ABJ')}. {rng.choice(names)}", "She", "He", "They", rng.choice(names)])
    tail = lambda: rng.choice(["", "", f" at {rng.randrange(10)}.{rng.randrange(10)} miles", f", e.g. the {rng.choice(things)}", f" in St. {rng.choice(names)}"])
    return [[f"{who()} {rng.choice(verbs)} the {rng.choice(things)}{tail()}{rng.choice(['.', '.', '.', '!', '?'])}" for _ in range(12)] for _ in range(n)]


def test_learnt_sentences_of_text_kept_apart(spark):
    frame = lambda rows: spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(rows)], "doc_id int, text string").repartition(3)
    train, apart = frame(made(1, 150)), made(2, 60)
    short = segmentation.abbreviations(train)
    assert {"mr", "dr", "e.g", "st"} <= {r.w for r in short.collect()} and not {"boat", "island", "house"} & {r.w for r in short.collect()}
    begins = segmentation.starters(train, short)
    assert {"she", "he", "they"} <= {r["first"] for r in begins.collect()}
    got = {}
    for r in segmentation.segment_learnt(frame(apart), short, begins).collect():
        got.setdefault(r.doc_id, []).append((r.sentence_id, r.sentence))
    right = sum([s for _, s in sorted(got[i])] == own for i, own in enumerate(apart))
    plain = {}
    for r in text.segment(frame(apart)).collect():
        plain.setdefault(r.doc_id, []).append(r.sentence)
    assert right >= 0.95 * len(apart) and sum(len(plain[i]) == len(own) for i, own in enumerate(apart)) < 0.2 * len(apart)


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "no stop"), (4, "It costs 3.5 here. yes it does. Mr. Owen"), (5, "...")], "doc_id int, text string")
    short = spark.createDataFrame([("mr", 1.0)], "w string, score double")
    got = sorted(map(tuple, segmentation.segment_learnt(docs, short, short.limit(0).selectExpr("w as first", "score")).collect()))
    assert got == [(2, 0, ""), (3, 0, "no stop"), (4, 0, "It costs 3.5 here. yes it does."), (4, 1, "Mr. Owen"), (5, 0, "...")]
    assert segmentation.abbreviations(docs.limit(0)).count() == segmentation.starters(docs.limit(0), short).count() == 0


def test_words_are_counted_once_for_both(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(made(3, 60))], "doc_id int, text string")
    want = segmentation.starters(docs, segmentation.abbreviations(docs)).collect()
    types = segmentation.word_types(docs)
    monkeypatch.setattr(segmentation, "_types", None)
    assert sorted(segmentation.starters(docs, segmentation.abbreviations(docs, types), types).collect()) == sorted(want) != []
