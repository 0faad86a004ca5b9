"""Quality by ordinal regression: a cumulative-link (proportional odds) model on hashed text.

P(grade > k) = logistic(w . x - t_k) with one weight vector w for all grades and ordered thresholds t_1 <= t_2 <= ...
x holds the shares of a document's words that have each hashed feature. Expected grade and the probability of the
upper grades follow from the thresholds; documents are selected by the latter.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, crc_mod, labelled_texts, map_texts

SPACE = 1 << 18
#: At most so many rated documents of each grade, and of about so many characters together, are learnt from.
FIT_LIMIT, FIT_CHARS = 800, 2_500_000
#: Shares are multiplied by this, so that steps on them are of the thresholds' size.
SCALE = 10.0
#: Thresholds differ by this at least.
APART = 1e-3

_SHAPE = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[0-9]+"), "9"))
_EDGES = re.compile(r"^\W+|\W+$")


def features(word: str) -> list[int]:
    """Hashed: the bare word, its shape, and the marks before and after it."""
    bare = _EDGES.sub("", word)
    shape = word
    for pattern, mark in _SHAPE:
        shape = pattern.sub(mark, shape)
    at = word.find(bare) if bare else len(word)
    names = ("w:" + bare.lower(), "s:" + shape, "b:" + word[:at], "e:" + word[at + len(bare) :])
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & (SPACE - 1) for n in names]


@dataclass
class Grader:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def table(self) -> WordTable:
        return WordTable(lambda words: self.weights[np.array([features(w) for w in words], np.int64).reshape(-1, 4)].sum(axis=1))

    def levels(self, texts: list[str | None], table: WordTable) -> np.ndarray:
        """w . x of each text; 0 without words."""
        split = [(t or "").split() for t in texts]
        every = [w for s in split for w in s]
        lengths = np.array([len(s) for s in split], np.int64)
        total = np.zeros(len(lengths))
        if every:
            # A text's sum doesn't depend on the texts beside it.
            some = np.flatnonzero(lengths)
            total[some] = np.add.reduceat(table(every), (np.cumsum(lengths) - lengths)[some])
        return SCALE * total / np.maximum(lengths, 1)

    def tails(self, levels: np.ndarray) -> np.ndarray:
        """P(grade > k-th grade): a column for each threshold."""
        return 1 / (1 + np.exp(-np.clip(levels[:, None] - self.thresholds, -60, 60)))

    def expected(self, levels: np.ndarray) -> np.ndarray:
        """The mean grade under the model."""
        steps = np.diff(np.array(self.grades, float))
        return self.grades[0] + self.tails(levels) @ steps


def fit(texts: list[str], ratings: list[int], rounds: int = 120, ridge: float = 2e-4) -> Grader:
    """Maximum likelihood of P(grade = k) = P(grade > k-1) - P(grade > k), by adaptive gradient steps over all rows given;
    classes count alike, whatever their sizes.

    One grade, or none, gives a model that expects that grade (0) of every document.
    """
    grades = sorted(set(ratings)) or [0]
    thresholds = np.linspace(-1, 1, len(grades) - 1) if len(grades) > 2 else np.zeros(len(grades) - 1)
    weights = np.zeros(SPACE)
    if len(grades) == 1:
        return Grader(grades, weights, thresholds)
    cells = []
    for i, text in enumerate(texts):
        words = text.split()
        if words:
            kinds, times = np.unique(np.array([features(w) for w in words]).ravel(), return_counts=True)
            cells.append((np.full(len(kinds), i), kinds, SCALE * times / len(words)))
    row, column, value = (np.concatenate(x) for x in zip(*cells)) if cells else (np.empty(0, int),) * 3
    y = np.searchsorted(grades, ratings)
    share = 1 / np.bincount(y, minlength=len(grades))[y] / len(grades)
    seen, seen_t = np.full(SPACE, 1e-8), np.full(len(grades) - 1, 1e-8)
    for _ in range(rounds):
        level = np.bincount(row, weights[column] * value, minlength=len(y))
        error, gradient_t = slopes(level, thresholds, y, share)
        gradient = np.bincount(column, error[row] * value, minlength=SPACE) - ridge * weights
        seen += gradient**2
        weights += 0.1 * gradient / np.sqrt(seen)
        seen_t += gradient_t**2
        # Thresholds stay apart, so that every grade has a probability.
        moved = thresholds + 0.1 * gradient_t / np.sqrt(seen_t)
        thresholds = np.maximum.accumulate(moved - APART * np.arange(len(moved))) + APART * np.arange(len(moved))
    return Grader(grades, weights, thresholds)


def slopes(level: np.ndarray, thresholds: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood: the slope on each row's level, and on each threshold. y: places of the rows' grades."""
    tails = 1 / (1 + np.exp(-np.clip(level[:, None] - thresholds, -60, 60)))
    tails = np.hstack([np.ones((len(y), 1)), tails, np.zeros((len(y), 1))])
    rows = np.arange(len(y))
    above, below = tails[rows, y], tails[rows, y + 1]
    held = np.maximum(above - below, 1e-12)
    by_threshold = np.zeros(len(thresholds) + 2)
    np.add.at(by_threshold, y, -share * above * (1 - above) / held)
    np.add.at(by_threshold, y + 1, share * below * (1 - below) / held)
    return share * (1 - above - below), by_threshold[1:-1]


def likelihood(level: np.ndarray, thresholds: np.ndarray, y: np.ndarray, share: np.ndarray) -> float:
    """The log likelihood that fit() raises, without its ridge."""
    tails = 1 / (1 + np.exp(-np.clip(level[:, None] - thresholds, -60, 60)))
    tails = np.hstack([np.ones((len(y), 1)), tails, np.zeros((len(y), 1))])
    rows = np.arange(len(y))
    return float((share * np.log(np.maximum(tails[rows, y] - tails[rows, y + 1], 1e-300))).sum())


def learn(docs: DataFrame, labels: DataFrame, where=None, rating: str = "quality", limit: int = FIT_LIMIT, max_chars: int = FIT_CHARS) -> Grader:
    """A grader from at most `limit` documents of each grade, of about `max_chars` characters together.

    Null ratings and texts don't count; a document with several ratings counts with the lowest, one with several texts
    with the least of them.
    """
    known = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.col(rating).cast("int").alias("label"))
    rows = labelled_texts(docs, known if where is None else known.where(where), limit, max_chars)
    return fit([text for text, _ in rows], [int(label) for _, label in rows])


def grade(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail (probability of the top grade) and selected (tail >= least) of every document.

    Learns from ratings of documents whose crc32(doc_id as text) mod 5 is not 0; held_out marks the others. Null and
    empty texts have no features and get what the thresholds alone give. Texts of any length are graded whole; equal
    texts get equal grades. Repeated rows each get a row, an empty table gives none. Columns besides doc_id and text
    are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, where=crc_mod("doc_id", 5) != 0))
    cache: list[WordTable] = []

    def work(x):
        if not cache:
            cache.append(sent.value.table())
        level = sent.value.levels(x["text"], cache[0])
        tails = sent.value.tails(level)
        return {"doc_id": x["doc_id"], "expected_grade": sent.value.expected(level), "tail": tails[:, -1] if tails.shape[1] else np.ones(len(level))}

    found = map_texts(docs, ["doc_id", "text"], "doc_id long, expected_grade double, tail double", work)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "expected_grade", "tail", (F.col("tail") >= least).alias("selected"))
