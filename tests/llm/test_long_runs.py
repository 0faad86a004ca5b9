"""Runs without white space: what stands late in them counts."""

import random

import pytest
from test_text_models import toxic_corpus

from loomgraph.llm import toxicity


@pytest.fixture(scope="module")
def tagger():
    rows = toxic_corpus()
    return toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])


@pytest.mark.parametrize("mark", ["-", ".", "/", "</b><b>", "、"])
def test_toxic_words_late_in_a_run(tagger, mark):
    rng = random.Random(4)
    clean = mark.join("".join(rng.choice("abcdeiou") for _ in range(6)) for _ in range(60))
    toxic = clean + mark + "zgrumpf" + mark + clean
    few = tagger.table()
    scores = tagger.scores(*tagger.tag([clean, toxic, clean.replace(mark, " ")], few))
    assert scores[1] >= 0.5 and scores[0] < 0.5 and abs(scores[0] - scores[2]) < 0.4


def test_positions_cover_every_character():
    texts = ["x" * 64, "x" * 65, "汉字" * 500, "ตัวอย่าง" * 60, "a." * 300 + "!" * 200, "_" * 70 + "é̂" * 50, "=" * 64 + "b"]
    for text in texts:
        spans = list(toxicity.positions(text))
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 < b - a <= toxicity.LONGEST for a, b in spans)
        assert all(a < c <= b < d for (a, b), (c, d) in zip(spans, spans[1:]))
        assert toxicity.words_of(text) == [text[a:b] for a, b in spans]
    assert toxicity.words_of(None) == toxicity.words_of(" ") == []


def test_spans_of_long_runs(spark, tagger):
    text = "first " + "abab-" * 40 + "zgrumpf" + "-cdcd" * 40
    (row,) = toxicity.spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), tagger).collect()
    assert any(s.start <= text.index("zgrumpf") < s.end and s.end - s.start < 40 for s in row.spans)
