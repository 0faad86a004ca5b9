"""Secrets in texts: three fixed patterns, and a character convolutional network over every candidate.

Candidates are the values of the fixed patterns' matches, and all other runs of MIN or more characters of
[A-Za-z0-9+/_=-] but plain words (under PLAIN letters without a capital after a small letter, or such words joined by
marks). The network sees windows of up to WITHIN characters with those around them: embedded characters and a mark for
those of the window, one convolution, the maximum over all places, and a logistic unit. Windows of a longer run overlap
by half, and it is a secret if one of them is.

It is trained on labelled findings: a bounded sample of those that the documents themselves have, labelled by rule
(see `label`), with half of the secrets' keywords blotted out so that the value must tell, and findings made by rule for
kinds of secrets that the documents lack. Its scores are calibrated on findings kept apart, and the threshold is the
highest that still finds the asked share of those. Spans of the fixed patterns stay, whatever the network says of them.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, map_texts

#: Fixed patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "other")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Shortest candidates; longest plain words.
MIN, PLAIN = 8, 24
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN)
_WORDS = re.compile(r"(?:[A-Z]?[a-z]*|[A-Z]*)(?:[+/_=-]+(?:[A-Z]?[a-z]*|[A-Z]*))*")
#: Findings of either label that are learnt from, at most.
FIT_LIMIT = 1500

BEFORE, WITHIN, AFTER = 24, 40, 8
WIDTH = BEFORE + WITHIN + AFTER
EMBED, FILTERS, KERNEL = 8, 32, 5
ALPHABET = 128
#: The share of labelled findings, kept apart from training, that the threshold must find.
RECALL = 0.98

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns' matches, in code points, by start and then kind."""
    found: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def plain(run: str) -> bool:
    """Whether a run is a plain word, or plain words joined by marks."""
    if run.isalpha():
        return len(run) < PLAIN and (run[1:].islower() or run.isupper())
    if not run.isascii() or any(map(str.isdigit, run)):
        return False
    return _WORDS.fullmatch(run) is not None and max(map(len, re.split(r"[+/_=-]+", run))) < PLAIN


def candidates(text: str, base: list[Span], words: bool = False) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is of a fixed pattern) of all candidates: values of fixed patterns, each once, and other runs
    that overlap none of their matches. Plain words are left out unless `words` asks for them."""
    own = set()
    for kind, a, b in base:
        if kind == "assign":
            # The value is what follows the last sign, quote or space.
            a += len(ASSIGN.match(text, a)[0]) - len(ASSIGN.match(text, a)[2])
        own.add((a, b))
    # Matches within another's value are that value.
    out, reached = [], -1
    for a, b in sorted(own, key=lambda s: (s[0], -s[1])):
        if b > reached:
            out.append((a, b, True))
            reached = b
    taken: list[list[int]] = []  # where fixed patterns match, in stretches that stand apart
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    k = 0
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if not words and run.isalpha() and len(run) < PLAIN and (run[1:].islower() or run.isupper()):
            continue
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if not (k < len(taken) and taken[k][0] < m.end()) and (words or not plain(run)):
            out.append((*m.span(), False))
    return out


# How tokens of well-known services begin.
PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "eyJ", "ya29", "AIza", "SG", "npm_", "pypi-")


def label(run: str, base: bool) -> int | None:
    """1 for the value of a fixed pattern, 0 for a run that looks like no key, None for one that might be one: it begins like
    a token of a well-known service, or has 16 or more characters and small letters, capitals and digits among them."""
    if base:
        return 1
    kinds = any(c.islower() for c in run) + any(c.isupper() for c in run) + any(c.isdigit() for c in run)
    return None if run.startswith(PREFIXES) or (len(run) >= 16 and kinds == 3) else 0


def parts(start: int, end: int) -> list[tuple[int, int]]:
    """The windows of a candidate: itself, or ones of WITHIN characters that overlap by half, the last one at its end."""
    if end - start <= WITHIN:
        return [(start, end)]
    return [(a, a + WITHIN) for a in (*range(start, end - WITHIN, WITHIN // 2), end - WITHIN)]


def window(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters around a place of up to WITHIN characters (the first ones of a longer one), and which of them are its own."""
    end = min(end, start + WITHIN)
    own = text[start:end]
    left, right = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    codes = np.zeros(WIDTH, np.int64)
    mark = np.zeros(WIDTH)
    at = BEFORE - len(left)
    for i, c in enumerate(left + own + right):
        codes[at + i] = ord(c) if ord(c) < ALPHABET else 1
    mark[BEFORE : BEFORE + len(own)] = 1
    return codes, mark


def windows(places: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, marks, owner) of all windows of places (text, start, end)."""
    own = [(k, text, a, b) for k, (text, start, end) in enumerate(places) for a, b in parts(start, end)]
    codes, marks = (np.stack(x) for x in zip(*(window(text, a, b) for _, text, a, b in own)))
    return codes, marks, np.array([k for k, *_ in own])


@dataclass
class Network:
    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    #: Of the findings kept apart: the share of secrets that is found, of what is found that is secret, and their number.
    recall: float = 1.0
    precision: float = 1.0
    apart: int = 0

    def _patches(self, codes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        x = np.concatenate([self.embed[codes], marks[:, :, None]], axis=2)
        view = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1)
        return view.transpose(0, 1, 3, 2).reshape(len(codes), WIDTH - KERNEL + 1, KERNEL * (EMBED + 1))

    def _forward(self, codes: np.ndarray, marks: np.ndarray):
        patches = self._patches(codes, marks)
        maps = patches @ self.kernel + self.bias
        where = maps.argmax(axis=1)
        top = np.maximum(np.take_along_axis(maps, where[:, None, :], axis=1)[:, 0], 0)
        return patches, where, top, top @ self.out[:-1] + self.out[-1]

    def logits(self, codes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 512], marks[i : i + 512])[3] for i in range(0, len(codes), 512)]) if len(codes) else np.empty(0)

    def probabilities(self, codes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes, marks) + self.shift, -60, 60)))

    def gradients(self, codes: np.ndarray, marks: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        patches, where, top, logit = self._forward(codes, marks)
        error = (1 / (1 + np.exp(-logit)) - y) / len(y)
        d_out = np.r_[top.T @ error, error.sum()]
        d_top = error[:, None] * self.out[:-1] * (top > 0)
        chosen = np.take_along_axis(patches, where[:, :, None], axis=1)  # rows x filters x patch
        d_kernel = np.einsum("nfp,nf->pf", chosen, d_top)
        d_patch = d_top[:, :, None] * self.kernel.T[None]
        d_embed = np.zeros_like(self.embed)
        for k in range(KERNEL):
            at = np.take_along_axis(codes, where + k, axis=1)
            np.add.at(d_embed, at, d_patch[:, :, k * (EMBED + 1) : k * (EMBED + 1) + EMBED])
        return [d_embed, d_kernel, d_top.sum(axis=0), d_out]


def findings(n: int = 4000, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """Labelled findings made by rule: (text, start, end, 1 for a secret), half of them secrets."""
    rng = np.random.default_rng(seed)
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def draw(alphabet: str, size: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), size))

    def pick(*options):
        return options[int(rng.integers(0, len(options)))]

    def word() -> str:
        return draw(low, int(rng.integers(2, 9)))

    def secret() -> str:
        size = int(rng.integers(16, 65))
        return pick(
            lambda: draw("0123456789abcdef", size), lambda: draw("0123456789ABCDEF", size), lambda: draw(low + up + digit, size),
            lambda: draw(low + up + digit + "+/", size) + pick("", "=", "=="), lambda: pick("ghp_", "gho_", "xoxb-", "sk_live_", "glpat-") + draw(low + up + digit, size),
            lambda: "AKIA" + draw(up + digit, 16), lambda: "eyJ" + draw(low + up + digit + "-_", size),
        )()

    def harmless() -> str:
        return pick(
            lambda: "-".join(word() for _ in range(4)) + "-" + draw(digit, int(rng.integers(1, 5))), lambda: "/".join([word(), word(), word() + draw(digit, 2), word()]) + "/index",
            lambda: f"20{draw(digit, 2)}-{draw(digit, 2)}-{draw(digit, 2)}T{draw(digit, 2)}-{draw(digit, 2)}-{draw(digit, 2)}Z", lambda: "_".join(word() for _ in range(3)) + "_v" + draw(digit, 2),
            lambda: draw(low, int(rng.integers(14, 30))) + draw(digit, int(rng.integers(1, 4))), lambda: pick("=", "-", "_") * int(rng.integers(15, 40)) + word() + draw(digit, 1),
            lambda: "ISBN-" + "-".join([draw(digit, 3), draw(digit, 1), draw(digit, 4), draw(digit, 4), draw(digit, 1)]), lambda: "+".join(word() for _ in range(5)) + "+" + draw(digit, 2),
            lambda: word() * int(rng.integers(3, 6)) + draw(digit, 1) + word() * 2, lambda: draw(digit, 8) + "-" + draw(digit, 8) + word(),
            lambda: draw(digit, int(rng.integers(8, 20))), lambda: "".join(word().title() for _ in range(int(rng.integers(2, 5)))), lambda: (word() + word() + word() + word() + word() + word())[:40].ljust(PLAIN, "e"),
        )()

    rows = []
    while len(rows) < n:
        y = len(rows) % 2
        run = secret() if y else harmless()
        if len(run) < MIN or plain(run):
            continue
        left = " ".join(word() for _ in range(int(rng.integers(0, 6))))
        left += pick(" ", "\n", " (", ' "', ": ", " | ") if not y else pick(" ", ' "', ": ", " = ", " Bearer ", " key=", ' "', "://user:", "\n")
        rows.append((left + run + pick(" ", "\n", ".", '"', ",", ")") + word(), len(left), len(left) + len(run), y))
    return rows


def long_findings(n: int = 1600, seed: int = 6) -> list[tuple[str, int, int, int]]:
    """Labelled windows of long runs: harmless parts joined, half of them with a key in between.

    A window that has 16 characters of the key, or all of it, is one of a secret; those that have fewer are left out.
    """
    rng = np.random.default_rng(seed)
    every = findings(4 * n, seed)
    # No part stands in two texts, so that texts can be kept apart.
    some = [iter([t[a:b] for t, a, b, y in every if y == label]) for label in (0, 1)]
    rows = []
    for k in range(n // 8):
        sign = "/-_=+"[int(rng.integers(0, 5))]
        pieces = list(islice(some[0], int(rng.integers(3, 9))))
        at = int(rng.integers(0, len(pieces) + 1))
        key = next(some[1]) if k % 2 else ""
        head = "see " + sign.join(pieces[:at] + [""])
        text = head + key + sign.join(([""] if key else []) + pieces[at:])
        for a, b in parts(4, len(text)):
            shared = min(b, len(head) + len(key)) - max(a, len(head))
            if not key or shared <= 0 or shared >= 16:
                rows.append((text + " end", a, b, int(bool(key) and shared >= 16)))
    return rows


def kept_together(rows: list[tuple[str, int, int, int]]) -> np.ndarray:
    """A number for each row, the same for those that share a text or a value, directly or through others."""
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    seen: dict[tuple[str, str], int] = {}
    for i, (text, a, b, _) in enumerate(rows):
        for name in (("text", text), ("value", text[a:b])):
            parent[root(i)] = root(seen.setdefault(name, i))
    return np.array([root(i) for i in range(len(rows))], np.int64)


def train(rows: list[tuple[str, int, int, int]], rounds: int = 6, recall: float = RECALL, seed: int = 11) -> Network:
    """A network from labelled findings: about two thirds train it, the others calibrate it and set its threshold.

    Findings that share a value or a text are all on one side.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (ALPHABET, EMBED)), rng.normal(0, 0.2, (KERNEL * (EMBED + 1), FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS + 1))
    codes, marks, owner = windows([r[:3] for r in rows])
    truth_ = np.array([r[3] for r in rows], float)
    y = truth_[owner]
    group = kept_together(rows)
    names = rng.permutation(np.unique(group))
    first = np.isin(group, names[: 2 * len(names) // 3])
    train_, keep = np.flatnonzero(first[owner]), np.flatnonzero(~first[owner])
    parts = [net.embed, net.kernel, net.bias, net.out]
    mean, square, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(rounds):
        order = rng.permutation(train_)
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            step += 1
            for p, g, m, s in zip(parts, net.gradients(codes[some], marks[some], y[some]), mean, square):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    logit, truth = net.logits(codes[keep], marks[keep]), y[keep]
    slope, shift = 1.0, 0.0
    for _ in range(500):  # Platt scaling
        p = 1 / (1 + np.exp(-np.clip(slope * logit + shift, -60, 60)))
        slope -= 0.05 * float(((p - truth) * logit).mean())
        shift -= 0.05 * float((p - truth).mean())
    net.slope, net.shift = slope, shift
    best = np.zeros(len(rows))
    np.maximum.at(best, owner[keep], net.probabilities(codes[keep], marks[keep]))
    found = np.sort(best[~first & (truth_ == 1)])
    net.threshold = float(found[math.floor((1 - recall) * len(found))]) if len(found) else 0.5
    said = (best >= net.threshold) & ~first
    net.recall = float((found >= net.threshold).mean()) if len(found) else 1.0
    net.precision = float(truth_[said].mean()) if said.any() else 1.0
    net.apart = int((~first).sum())
    return net


@lru_cache(maxsize=1)
def default_network() -> Network:
    """A network that has seen findings made by rule only."""
    return train(findings() + long_findings())


def around(text: str, start: int, end: int) -> tuple[str, int, int]:
    """A finding with the characters about it that a window can see, and its place in them."""
    before = max(0, start - BEFORE)
    return text[before : end + AFTER], start - before, end - before


def found_in(docs: DataFrame, limit: int = FIT_LIMIT) -> list[tuple[str, int, int, int]]:
    """Labelled findings of docs, of either label at most `limit` different ones, the first by a hash of what they look like.

    Each is as long as two windows at most: longer candidates are cut into parts, each a finding of its own.
    """

    def work(x):
        out = {"finding": [], "place": [], "stop": [], "label": []}
        for text in x["text"]:
            text = text or ""
            for a, b, base in candidates(text, base_spans(text)):
                if (y := label(text[a:b], base)) is not None:
                    for c, d in parts(a, b):
                        shown, start, end = around(text, c, d)
                        for column, value in zip(out.values(), (shown, start, end, y)):
                            column.append(value)
        return out

    rows = map_texts(docs, ["text"], "finding string, place int, stop int, label int", work).distinct()
    rows = cut(rows.withColumn("name", F.concat_ws("|", F.col("finding"), F.col("place").cast("string"), F.col("stop").cast("string"))))
    chosen = bounded_sample(rows, "name", limit, by="label").orderBy("label", "name").collect()
    return [(r.finding, r.place, r.stop, r.label) for r in chosen]


def blotted(rows: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """The rows, and every other secret once more with spaces instead of what stands before it."""
    return rows + [(" " * a + t[a:], a, b, y) for k, (t, a, b, y) in enumerate(r for r in rows if r[3]) if k % 2]


def learn(docs: DataFrame, limit: int = FIT_LIMIT) -> Network:
    """A network trained on findings of docs and on findings made by rule."""
    return train(blotted(found_in(docs, limit)) + findings() + long_findings())


def scan(texts: list[str | None], net: Network, words: bool = False) -> list[tuple[list[Span], int, int]]:
    """(all spans by start and then kind, candidates asked of the network, fixed patterns' values it accepts) of each text."""
    out, asked = [], []
    for i, text in enumerate(texts):
        base = base_spans(text or "")
        own = candidates(text or "", base, words)
        out.append((list(base), len(own)))
        asked += [(i, *c) for c in own]
    # One place for each window, so that memory doesn't follow the length of a run.
    places = ((i, a, b, base, *part) for i, a, b, base in asked for part in parts(a, b))
    accepted = set()
    while some := list(islice(places, 4096)):
        codes, marks = (np.stack(x) for x in zip(*(window(texts[i], c, d) for i, *_, c, d in some)))
        accepted.update(row[:4] for row, p in zip(some, net.probabilities(codes, marks).tolist()) if p >= net.threshold)
    confirmed = [0] * len(texts)
    for i, a, b, base in accepted:
        if base:
            confirmed[i] += 1
        else:
            out[i][0].append(("other", a, b))
    return [(sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))), n, c) for (spans, n), c in zip(out, confirmed)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", words: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_other, base_sha256, spans, n_candidates, n_confirmed.

    Spans are those of the fixed patterns and the other candidates that the network accepts, as kind:start:end in code
    points. n_candidates counts what the network was asked, n_confirmed the fixed patterns' values that it accepts.
    `words` has the network asked of plain words of MIN characters or more too, which are most of a text. Ties don't arise:
    spans are ordered by start, then kind. Without a network, one is trained on findings of docs. Null and empty texts have no spans; base_sha256 is then that
    of the empty text. Texts and runs of any length are looked at whole; repeated rows each get a row, an empty table
    gives none. Other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net or learn(docs))

    def work(x):
        found = scan(x["text"], sent.value, words)
        base = [[s for s in spans if s[0] != "other"] for spans, _, _ in found]
        out = {f"n_{k}": [sum(s[0] == k for s in spans) for spans, _, _ in found] for k in KINDS}
        out |= {"doc_id": x[id_col], "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], "spans": [joined(s) for s, _, _ in found]}
        return out | {"n_candidates": [n for _, n, _ in found], "n_confirmed": [c for _, _, c in found]}

    return map_texts(docs, [id_col, "text"], "doc_id long, n_assign long, n_access long, n_hex long, n_other long, base_sha256 string, spans string, n_candidates long, n_confirmed long", work)
