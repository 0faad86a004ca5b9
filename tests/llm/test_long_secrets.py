"""Keys in the middle of long candidates."""

import time

import numpy as np

from loomgraph.llm import secret_scan


def test_windows_cover_long_candidates():
    assert secret_scan.parts(5, 45) == [(5, 45)]
    for end in (46, 65, 66, 85, 500):
        found = secret_scan.parts(5, end)
        assert found[0][0] == 5 and found[-1][1] == end and all(b - a == secret_scan.WITHIN for a, b in found)
        assert all(a < c <= b - 20 for (a, b), (c, _) in zip(found, found[1:]))


def test_keys_inside_long_runs_are_found():
    net, rng = secret_scan.default_network(), np.random.default_rng(99)
    made = secret_scan.findings(2000, seed=123)
    harmless, keys = ([t[a:b] for t, a, b, y in made if y == label] for label in (0, 1))
    runs = {0: [], 1: []}
    for k in range(300):
        pieces = [harmless[int(i)] for i in rng.integers(0, len(harmless), 8)]
        runs[k % 2].append("see " + "/".join(pieces[:4] + [keys[int(rng.integers(0, len(keys)))]] * (k % 2) + pieces[4:]) + " end")
    share = {y: np.mean([bool(spans) for spans, _, _ in secret_scan.scan(texts, net)]) for y, texts in runs.items()}
    assert share[1] >= 0.9 and share[0] <= 0.05


def test_no_value_or_text_is_on_both_sides():
    rows = secret_scan.blotted(secret_scan.findings(400)) + secret_scan.long_findings(400)
    group = secret_scan.kept_together(rows)
    for name in (lambda r: r[0], lambda r: r[0][r[1] : r[2]]):
        held = {}
        for row, g in zip(rows, group.tolist()):
            assert held.setdefault(name(row), g) == g
    assert len(set(group.tolist())) > 300


def test_many_findings_in_one_text_take_no_longer_each():
    rng = np.random.default_rng(1)
    text = "\n".join(f"token={rng.integers(1 << 60):032x}" for _ in range(20_000))
    began = time.perf_counter()
    base = secret_scan.base_spans(text)
    found = secret_scan.candidates(text, base)
    assert len(found) == 20_000 and time.perf_counter() - began < 5


def test_plain_words_are_asked_too_if_wanted():
    text = "word ordinary password=abcdef12 ordinarily"
    base = secret_scan.base_spans(text)
    assert [text[a:b] for a, b, _ in secret_scan.candidates(text, base)] == ["abcdef12"]
    assert [text[a:b] for a, b, _ in secret_scan.candidates(text, base, words=True)] == ["abcdef12", "ordinary", "ordinarily"]
